"""Language of each document and of each sentence in it, by prediction by partial matching.

For each language a context tree over the bytes of bounded, cleaned training
text predicts the next byte from up to ORDER bytes before it: the longest context
that the tree holds, from which a byte it has not seen there escapes to the next
shorter one (method C, without exclusion), down to equal chances of 256 bytes.
The statistics are frozen. The code length of every byte string of up to
ORDER + 1 bytes that stands in any training text, and of every escape, is worked
out once into tables found by hash, so the exact code length of a text under each
language is a sum of look-ups.

Bytes are those of the text in UTF-8, lower case, any run of other signs than
letters being one blank. A document is cut into sentences and headings; the
cheapest path over its sentences, paying SWITCH bits for each change of language,
gives every sentence its language, so short or unclear pieces follow their
surroundings.

Confidences weigh all languages and a background (the trees of all languages at
order 1, their chances averaged) by their code lengths, softened by a
factor that is fitted on labelled documents held out of the training.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("pt", "es", "en", "fr", "it", "de")
ORDER = 4
#: Order of the trees that clean the training text.
CLEANING = 2
#: Bits for a change of language between neighbouring sentences.
SWITCH = 12.0
#: Labelled documents a language that the model is fitted on, about, and the longest text taken for it.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
#: Part of the labels that is taken to be wrong when confidences are fitted.
WRONG = 0.1
#: Words a piece must have to count as a sentence or heading.
LEAST_WORDS = 3

#: Names and codes of the languages, without accents, as labels spell them.
LABELS = {
    "pt": "pt por ptb portugues portuguese portugais portoghese portugiesisch",
    "es": "es spa esp espanol spanish castellano castelhano espanhol espagnol spagnolo spanisch",
    "en": "en eng ingles english anglais inglese englisch",
    "fr": "fr fra fre frances french francais francese franzosisch",
    "it": "it ita italiano italian italien italienisch",
    "de": "de deu ger aleman alemao german deutsch allemand tedesco",
}
_LABEL = {n: k for k, names in LABELS.items() for n in names.split()}


def label_language(label: Column) -> Column:
    """The language that a label names in any spelling (code, region, case, name), else null."""
    t = F.regexp_replace(F.lower(F.trim(label)), "[\\u0300-\\u036f]", "")
    t = F.translate(t, "áàâãäçéèêëíìîïñóòôõöúùûü", "aaaaaceeeeiiiinooooouuuu")
    first = F.regexp_extract(t, r"^([a-z]+)(?:[^a-z].*)?$", 1)
    return F.create_map(*[F.lit(x) for kv in _LABEL.items() for x in kv])[first]


BLANK = 32


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point -> the letter in lower case, an apostrophe, 32 for a break, 0 for nothing (marks, signs of no width)."""
    out = np.full(0x20000, BLANK, np.uint32)
    for p in range(0x20000):
        c = chr(p)
        if c.isalpha():
            # signs that are forms of a letter stand for it: of full width, mathematical, in a ligature
            f = (unicodedata.normalize("NFKC", c) if p >= 0x1D400 or 0x2000 <= p < 0x2200 or p >= 0xF900 or 0x80 <= p < 0x250 else c).lower()[:1]
            out[p] = ord(f) if f.isalpha() else p
        elif unicodedata.combining(c):
            out[p] = 0
    out[[0xAA, 0xBA]] = BLANK
    out[[0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = 0
    out[[0x27, 0x2019, 0x2018, 0xB4, 0x60]] = 0x27
    return out


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(letters as code points, place in the text of each): breaks in a row are one blank."""
    if not text.isascii():
        text = _composed(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol_table()[np.minimum(points, 0x1FFFF)]
    at = np.flatnonzero(s)
    s = s[at]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
    return s[keep], at[keep]


_MARKED = re.compile("[a-zA-Z][\u0300-\u036f]")


def _composed(text: str) -> str:
    """Letters followed by a mark become one sign; a sign of no width takes the mark's place, so places stay."""
    return _MARKED.sub(lambda m: c + "\u200b" if len(c := unicodedata.normalize("NFC", m.group())) == 1 else m.group(), text)


def utf8(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the code points in UTF-8, where each code point begins, and their number at the end)."""
    data = np.frombuffer(s.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    width = 1 + (s >= 0x80).astype(np.int64) + (s >= 0x800) + (s >= 0x10000)
    return data, np.concatenate(([0], np.cumsum(width)))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """At each byte the k bytes before it and itself as one number; blanks stand before the first."""
    p = np.concatenate((np.full(k, BLANK, np.uint64), data.astype(np.uint64)))
    out = np.zeros(len(data), np.uint64)
    for i in range(k + 1):
        out = (out << np.uint64(8)) | p[i : i + len(data)]
    return out


class Rows:
    """Row numbers of distinct keys, by a hash table with open addresses."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]  # of several the last stays
            self.keys[at[free]] = keys[left[free]]
            gone = self.rows[at] == left
            left, at = left[~gone], (at[~gone] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = self._home(keys)
        out = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.rows[at]
            out[open_] = got
            wrong = (got >= 0) & (self.keys[at] != keys[open_])
            open_, at = open_[wrong], at[wrong]
        return out


class Trees:
    """Code lengths in bits of every language, and of the background as the last column.

    For each order k: the strings of k + 1 bytes of any training text with their code lengths (the last byte's, given
    those before it), and the contexts of k bytes with the length of an escape from each.
    """

    def __init__(self, training: list[np.ndarray], order: int = ORDER):
        n = len(training)
        self.order = order
        self.levels: list[tuple[Rows, np.ndarray, Rows | None, np.ndarray]] = []
        shorter = np.full((1, n), 8.0)
        prev = None
        for k in range(order + 1):
            keys, inverse = np.unique(np.concatenate([grams(t, k) for t in training]), return_inverse=True)
            count = np.bincount(inverse * n + np.repeat(np.arange(n), [len(t) for t in training]), minlength=len(keys) * n).reshape(-1, n).astype(float)
            above, own = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.stack([np.bincount(own, count[:, i], len(above)) for i in range(n)], 1)
            kinds = np.stack([np.bincount(own, count[:, i] > 0, len(above)) for i in range(n)], 1)
            escape = np.where(total > 0, -np.log2(np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)), 0.0)
            back = shorter[prev.find(keys & np.uint64((1 << 8 * k) - 1))] if prev is not None else np.broadcast_to(shorter, count.shape)
            cost = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.maximum((total + kinds)[own], 1)), escape[own] + back)
            prev, shorter = Rows(keys), cost
            self.levels.append((prev, self._wide(cost), Rows(above) if k else None, self._wide(escape)))
            if k == 1:
                # the background: of each byte after one byte
                self.background = np.full(1 << 16, 8.0, np.float32)
                self.background[keys.astype(np.int64)] = -np.log2(np.mean(np.exp2(-cost), 1))
        self.unseen = np.full(n + 1, 8.0, np.float32)

    @staticmethod
    def _wide(cost: np.ndarray) -> np.ndarray:
        """With a column of zeros for the background, whose cost is found elsewhere."""
        return np.concatenate((cost, np.zeros((len(cost), 1))), 1).astype(np.float32)

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """(bytes, languages + 1): bits of each byte."""
        gram = grams(data, self.order)
        rows, cost, above, escape = self.levels[self.order]
        at = rows.find(gram)
        out = cost.take(at, axis=0, mode="clip")
        open_ = np.flatnonzero(at < 0)
        out[open_] = 0
        for k in range(self.order, -1, -1):
            rows, cost, above, escape = self.levels[k]
            key = gram[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            if k < self.order:
                at = rows.find(key)
                seen = at >= 0
                out[open_[seen]] += cost[at[seen]]
                open_, key = open_[~seen], key[~seen]
            if not len(open_):
                break
            if above is None:
                out[open_] += escape[0] + self.unseen
            else:
                up = above.find(key >> np.uint64(8))
                known = up >= 0
                out[open_[known]] += escape[up[known]]
        out[:, -1] = self.background[(gram & np.uint64(0xFFFF)).astype(np.int64)]
        return out


_PARAGRAPH = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+")
_PIECE = re.compile(r"[.!?…]+[\"'»”’“)\]]*(?:\s+|$)|[\r\n]+")
_MASK = re.compile(r"\S*@\S*|https?://\S+|www\.\S+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_SHORT = {"sr", "sra", "srs", "dr", "dra", "art", "av", "no", "nr", "num", "tel", "cel", "prof", "ltda", "cia", "inc", "mr", "mrs", "mme", "st", "bzw", "ca", "fl", "pag", "etc", "ex", "sig"}


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts between blank lines; text that begins with a blank line has an empty part 0."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the sentences and headings of one paragraph."""
    out, at = [], start
    for m in _PIECE.finditer(text, start, end):
        stop = m.end()
        if m.group()[0] in "." and stop < end:
            i = m.start()
            j = i
            while j > at and text[j - 1].isalpha():
                j -= 1
            before = text[j:i]
            after = text[stop]
            if len(before) == 1 or before.lower() in _SHORT or after.isdigit() and len(before) < 3 and before:
                continue
        out.append((at, stop))
        at = stop
    if at < end:
        out.append((at, end))
    return out


class Detector:
    """Scores and segments texts by frozen trees."""

    def __init__(self, trees: Trees, switch: float = SWITCH):
        self.trees = trees
        self.switch = switch

    def sentences(self, texts: list[str]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """((text number, paragraph), words, bits by language) of every sentence or heading of all texts."""
        meta: list[tuple[int, int]] = []
        streams, cuts, n = [], [], 0
        gap = np.full(1, BLANK, np.uint32)
        for i, t in enumerate(texts):
            masked = _MASK.sub(lambda m: " " * len(m.group()), t) if "@" in t or "www" in t or "http" in t else t
            s, at = symbols(masked)
            places: list[int] = []
            for par, (a, b) in enumerate(paragraphs(t)):
                if a == b:
                    continue
                for x, _ in pieces(t, a, b):
                    meta.append((i, par))
                    places.append(x)
            cuts.append(np.searchsorted(at, places) + n)
            streams.append(s)
            streams.append(gap)
            n += len(s) + 1
        if not meta:
            return [], np.zeros(0, int), np.zeros((0, len(LANGUAGES) + 1))
        s = np.concatenate(streams)
        letter = np.concatenate(([False], s != BLANK, [False]))
        begins = letter[1:-1] & ~letter[:-2] & letter[2:]  # of words of two letters or more
        counts = np.concatenate(([0], np.cumsum(begins)))
        data, begin = utf8(s)
        cost = self.trees.lengths(data)
        starts = np.concatenate(cuts)
        ends = np.concatenate((starts[1:], [len(s)]))
        first, last = begin[starts], begin[ends]
        sums = np.add.reduceat(cost, np.minimum(first, len(data) - 1), axis=0)
        sums[first == last] = 0
        return meta, counts[ends] - counts[starts], sums

    def path(self, cost: np.ndarray) -> np.ndarray:
        """The language of each sentence on the cheapest path."""
        n, k = cost.shape
        best, come = cost[0].copy(), np.zeros((n, k), np.int8)
        for i in range(1, n):
            m = int(best.argmin())
            change = best[m] + self.switch
            stay = best <= change
            come[i] = np.where(stay, np.arange(k), m)
            best = np.where(stay, best, change) + cost[i]
        out = np.zeros(n, np.int8)
        out[-1] = best.argmin()
        for i in range(n - 1, 0, -1):
            out[i - 1] = come[i, out[i]]
        return out

    def segment(self, texts: list[str]) -> list[list[tuple[int, int, int, np.ndarray]]]:
        """For each text its sentences as (paragraph, language, words, bits of all languages and the background)."""
        meta, words, cost = self.sentences(texts)
        words = words.tolist()
        k = len(LANGUAGES)
        first = cost[:, :k].argmin(1) if len(meta) else None
        by: list[list[int]] = [[] for _ in texts]
        for j, (i, _) in enumerate(meta):
            if words[j] >= LEAST_WORDS:
                by[i].append(j)
        out = []
        for rows in by:
            if not rows:
                out.append([])
                continue
            lang = first[rows]
            if (lang != lang[0]).any():
                c = cost[rows, :k]
                lang = self.path(c - c.min(1, keepdims=True))
            out.append([(meta[j][1], int(g), words[j], cost[j]) for j, g in zip(rows, lang)])
        return out


def training_rows(documents: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(language, text) of about per_language labelled documents a language, chosen by the hash of their id.

    This bounded sample fits the model only; everything else covers all rows.
    """
    d = documents.filter(F.length("text").between(40, TRAIN_CHARS)).select("doc_id", "text", label_language(F.col("lang")).alias("l")).filter("l is not null")
    counts = {r["l"]: r["count"] for r in d.groupBy("l").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))]) if counts else None
    if share is None:
        return []
    h = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = d.filter(h < share[F.col("l")]).orderBy("doc_id").limit(per_language * len(LANGUAGES) * 2).collect()
    return [(r["l"], r["text"]) for r in rows]


def _stream(texts: list[str]) -> np.ndarray:
    """The bytes of the texts in a row, a blank after each."""
    gap = np.full(1, BLANK, np.uint32)
    return utf8(np.concatenate([x for t in texts for x in (symbols(t)[0], gap)]) if texts else gap)[0]


def fit(rows: list[tuple[str, str]], rounds: int = 4) -> Trees:
    """The trees. Labels may be wrong and texts mixed: after each round every sentence goes to the language that it is
    cheapest in, and the next round learns from these. Until the last round the trees are of order CLEANING, which is too
    low to learn a wrongly labelled sentence by heart."""
    own: list[int] = []
    cut: list[str] = []
    for lang, t in rows:
        masked = _MASK.sub(lambda m: " " * len(m.group()), t)
        for a, b in paragraphs(t):
            for x, y in pieces(t, a, b):
                if len(_WORD.findall(masked, x, y)) >= LEAST_WORDS:
                    own.append(LANGUAGES.index(lang))
                    cut.append(masked[x:y])
    streams = [_stream([t]) for t in cut]
    label = np.array(own, int)
    ends = np.cumsum([len(s) for s in streams], dtype=np.int64)
    whole = np.concatenate(streams) if streams else np.zeros(0, np.uint8)
    for r in range(rounds):
        trees = Trees([np.concatenate([s for g, s in zip(label, streams) if g == k] or [np.full(1, BLANK, np.uint8)]) for k in range(len(LANGUAGES))], CLEANING if r + 1 < rounds else ORDER)
        if r + 1 < rounds and cut:
            sums = np.concatenate((np.zeros((1, len(LANGUAGES))), np.cumsum(trees.lengths(whole)[:, :-1], axis=0, dtype=np.float64)))
            label = (sums[ends] - sums[np.concatenate(([0], ends[:-1]))]).argmin(1)
    return trees


def chances(bits: np.ndarray, softness: float) -> np.ndarray:
    """The chance of each language and the background (last) from rows of their code lengths."""
    x = -softness * (bits - bits.min(1, keepdims=True)) * np.log(2)
    p = np.exp(x)
    return p / p.sum(1, keepdims=True)


def soften(trees: Trees, held_out: list[tuple[str, str]]) -> float:
    """The factor on code lengths at which the chances of held-out sentences fit their labels best.

    Labels may be wrong and texts mixed, so of each document only sentences count whose language is that of most of it,
    and a part WRONG of these is taken as labelled at random.
    """
    det = Detector(trees)
    bits, right = [], []
    for (lang, _), found in zip(held_out, det.segment([t for _, t in held_out])):
        bits += [c for _, _, _, c in found]
        right += [LANGUAGES.index(lang)] * len(found)
    if not bits:
        return 0.1
    b, want = np.array(bits), np.array(right)
    best, least = 1.0, np.inf
    for softness in np.geomspace(0.005, 1.0, 40):
        p = (1 - WRONG) * chances(b, softness)[np.arange(len(want)), want] + WRONG / len(LANGUAGES)
        loss = -np.log(p).mean()
        if loss < least:
            best, least = float(softness), loss
    return best


#: Characters of text taken at once by a worker.
CHUNK = 1_000_000


def sentences(documents: DataFrame, fitted: tuple[Trees, float]) -> DataFrame:
    """(doc_id, rotulo, par, lang, confianca, palavras): a row for each paragraph and language in it.

    rotulo is the language that the label names or null; confianca the chance of
    lang against the other languages and the background, over the segment's
    sentences; palavras its words. Documents without any sentence (null, empty,
    identifiers only) have one row without par, lang and confianca and with 0 words.
    Texts are taken whole. Repeated rows come out repeatedly.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fitted)  # bounded by TRAIN_DOCS texts of TRAIN_CHARS a language

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, softness = shared.value
        det = Detector(trees)
        for f in frames:
            at = 0
            sizes = f.text.str.len().to_numpy()
            while at < len(f):
                to, n = at, 0
                while to < len(f) and (to == at or n + sizes[to] <= CHUNK):
                    n += sizes[to]
                    to += 1
                part = f.iloc[at:to]
                at = to
                rows, bits = [], []
                for doc, label, found in zip(part.doc_id, part.rotulo, det.segment(part.text.tolist())):
                    got: dict[tuple[int, int], list] = {}
                    for par, g, words, c in found:
                        if x := got.get((par, g)):
                            x[0] = x[0] + c
                            x[1] += words
                        else:
                            got[par, g] = [c, words]
                    if not got:
                        rows.append((doc, label, None, -1, 0))
                        bits.append(None)
                    for (par, g), (c, words) in got.items():
                        rows.append((doc, label, par, g, words))
                        bits.append(c)
                there = [i for i, c in enumerate(bits) if c is not None]
                p = np.full(len(rows), np.nan)
                if there:
                    p[there] = chances(np.array([bits[i] for i in there]), softness)[np.arange(len(there)), [rows[i][3] for i in there]]
                yield pd.DataFrame(
                    {
                        "doc_id": [r[0] for r in rows],
                        "rotulo": [r[1] for r in rows],
                        "par": pd.array([r[2] for r in rows], dtype="Int32"),
                        "lang": [LANGUAGES[r[3]] if r[3] >= 0 else None for r in rows],
                        "confianca": pd.array([None if np.isnan(x) else x for x in p], dtype="Float64"),
                        "palavras": [r[4] for r in rows],
                    }
                )

    rows = documents.select("doc_id", label_language(F.col("lang")).alias("rotulo"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, rotulo string, par int, lang string, confianca double, palavras int")


def model(documents: DataFrame) -> tuple[Trees, float]:
    """The trees, fitted on four fifths of the training sample, and the factor for confidences, fitted on the rest."""
    rows = training_rows(documents)
    trees = fit([r for i, r in enumerate(rows) if i % 5])
    return trees, soften(trees, rows[::5])


def documents_language(segments: DataFrame) -> DataFrame:
    """(doc_id, rotulo, lang, confianca, linguas): the language most of a document's words are in, the mean confidence of
    its words, and how many languages it has. A document without any sentence has no language, confidence 0 and 0 languages."""
    by = segments.groupBy("doc_id", "rotulo", "lang").agg(F.sum("palavras").alias("w"), F.sum(F.col("confianca") * F.col("palavras")).alias("c"))
    top = F.struct("w", "c", "lang")
    return by.groupBy("doc_id", "rotulo").agg(F.max_by("lang", top).alias("lang"), F.coalesce(F.max_by(F.try_divide("c", "w"), top), F.lit(0.0)).alias("confianca"), F.count("lang").cast("int").alias("linguas"))


def wrong_or_mixed(segments: DataFrame) -> DataFrame:
    """(doc_id, par, lang, confianca) of the documents whose label is missing, names no or another language, or that mix languages."""
    told = segments.filter("lang is not null")
    docs = documents_language(told).filter(F.col("rotulo").isNull() | (F.col("rotulo") != F.col("lang")) | (F.col("linguas") > 1)).select("doc_id")
    return told.join(docs, "doc_id", "left_semi").select("doc_id", "par", "lang", "confianca")
