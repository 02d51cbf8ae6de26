"""Text that was decoded with the wrong character encoding: found, and restored where it can be told.

Garbled sequences are precomputed for all pairs of encodings (written in, read
in), once and twice over, in both letter cases, and matched by one multi-pattern
automaton. Sequences that stem from UTF-8 (several signs for one letter) are
telling by themselves. Pairs of one-byte encodings turn one letter into one
sign, which may be intended; for these the word is read both ways and the way is
taken that the letter triples of all words of the corpus make more likely. Only
matched spans are replaced, so right parts of a mixed text stay as they are.
U+FFFD and stray C1 controls mark a text as garbled without a restoration.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that texts are read in by mistake.
READ_IN = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251")
#: One-byte encodings that texts are written in.
WRITTEN_IN = ("cp1252", "cp437", "cp850", "mac_roman")
#: Letters and signs that texts are made of.
LETTERS = "ÁÂÃÀÄÅÇÉÊÈËÍÎÌÏÑÓÔÕÒÖÚÛÙÜÝáâãàäåçéêèëíîìïñóôõòöúûùüýÿßœŒæÆøØ"
SIGNS = "ªº°§¿¡«»–—‘’“”„…•€£©®·´ "
#: Letters and signs of Portuguese; a one-byte pair may restore these and all LETTERS.
RESTORED = "ÁÂÃÀÇÉÊÍÓÔÕÚÜáâãàçéêíóôõúüªº¡"
#: How much more likely (natural logarithm) the restored word must be where a sign is a letter of
#: Portuguese, and where it is another.
MARGIN, MARGIN_FOREIGN = 2.5, 1.0
#: Letters whose second byte in UTF-8 is a control in Latin-1 and may have been dropped, leaving only Ã.
DROPPED = "ÀÁÂÃÇÉÊÍÓÔÕÚ"

_BETWEEN = r"[\s,;:/]+"
_C1 = re.compile("[\x80-\x9f]")
#: Signs that never stand in a word with Latin letters on purpose: box drawings, and Cyrillic beside Latin.
_BOX = re.compile("[\u2500-\u259f]")
_CYRILLIC, _LATIN = re.compile("[\u0400-\u04ff]"), re.compile("[A-Za-z]")


def _read(raw: bytes, enc: str) -> str | None:
    if enc == "cp1252":  # bytes without a sign pass as controls, as most readers do
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    try:
        return raw.decode(enc)
    except UnicodeDecodeError:
        return None


def _cases(seq: str, c: str) -> list[tuple[str, str]]:
    out = [(seq, c)]
    if len(seq.lower()) == len(seq) and seq.lower() != seq:
        out.append((seq.lower(), c.lower()))
    if len(seq.upper()) == len(seq) and seq.upper() != seq:
        out.append((seq.upper(), c.upper() if len(c.upper()) == 1 else c))
    return out


def several_sign_sequences() -> dict[str, str]:
    """Garbled sequence -> the letter, for texts written in UTF-8 and read in another encoding once or twice."""
    found: dict[str, str] = {}
    for variants in (False, True):
        for c in LETTERS + SIGNS:
            for enc in READ_IN:
                once = _read(c.encode("utf-8"), enc)
                if once is None:
                    continue
                seqs = [once] + [t for again in READ_IN if (t := _read(once.encode("utf-8"), again)) is not None]
                for seq in seqs:
                    for s, letter in _cases(seq, c) if variants else [(seq, c)]:
                        # a sequence that ends in a blank may be a letter before a blank
                        if len(s) > 1 and not s[-1].isspace() and not s.isascii():
                            found.setdefault(s, letter)
    return found


def one_sign_readings() -> dict[str, dict[tuple[str, str], None]]:
    """Sign -> the (pair, letter) it may stand for, over all pairs of one-byte encodings, likelier ones first.

    RESTORED come first, as read, then in the other case; then the rest of LETTERS as read, but a sign of RESTORED
    never stands for these: OLÉ isn't OLÈ.
    """
    out: dict[str, dict[tuple[str, str], None]] = defaultdict(dict)
    for letters, cases in ((RESTORED, False), (RESTORED, True), (LETTERS, False)):
        for a, b, c in product(WRITTEN_IN, READ_IN, letters):
            if a == b or {a, b} == {"latin-1", "cp1252"}:
                continue
            try:
                s = _read(c.encode(a), b)
            except UnicodeEncodeError:
                continue
            if s is None or s == c or s.isascii() or (letters is LETTERS and s in RESTORED):
                continue
            for x, y in _cases(s, c) if cases else [(s, c)]:
                if x != y and not x.isascii():
                    out[x][f"{a}>{b}", y] = None
    return out


def automaton():
    """(automaton of the sequences of several signs, readings of single signs)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for seq, c in several_sign_sequences().items():
        a.add_word(seq, (len(seq), c))
    a.make_automaton()
    return a, one_sign_readings()


_KNOWN = "".join(sorted(set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789^$") | {c for c in (LETTERS + SIGNS + "".join(one_sign_readings())).upper() if c.strip()}))


def triple_counts(texts: DataFrame, column: str) -> DataFrame:
    """(g, n): letter triples of all words with a sign outside ASCII, in upper case, with marked ends.

    Triples of signs outside a fixed alphabet are left out, so the table is
    bounded by the alphabet, not by the corpus.
    """
    words = texts.filter(F.col(column).rlike(r"[^\x00-\x7F]")).select(F.explode(F.split(F.upper(column), _BETWEEN)).alias("w")).filter(F.col("w").rlike(r"[^\x00-\x7F]"))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    marked = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    triples = counted.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(marked, i, F.lit(3)))).alias("g"))
    allowed = "[" + re.escape(_KNOWN) + "]{3}"
    return triples.filter(F.col("g").rlike(f"^{allowed}$") & (F.length("g") == 3)).groupBy("g").agg(F.sum("k").alias("n"))


class Repairer:
    """Finds and restores garbled spans; triples maps letter triples to their counts."""

    def __init__(self, triples: dict[str, int]):
        self.several, self.single = automaton()
        self.three = triples
        two: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in triples.items():
            two[g[:2]] += n
            kinds[g[:2]] += 1
        self.two, self.kinds = dict(two), dict(kinds)
        self.first = sum(n for g, n in two.items() if g[0] == "^")
        mid: dict[str, int] = defaultdict(int)
        one: dict[str, int] = defaultdict(int)
        for g, n in triples.items():
            mid[g[1:]] += n
            one[g[1]] += n
        self.mid, self.one = dict(mid), dict(one)
        self.memo: dict[str, str] = {}

    def _score(self, word: str) -> float:
        """Logarithm of the word's likelihood by its triples, backing off to pairs."""
        w = "^" + word.upper() + "$"
        return math.log((self.two.get(w[:2], 0) + 0.02) / (self.first + 5)) + self._steps(w)

    def _near(self, w: list[str], i: int) -> float:
        """The part of the score that the sign at i takes part in, so that a choice costs the same in a word of any length."""
        part = ("^" if i < 2 else "") + "".join(w[max(0, i - 2) : i + 3]).upper() + ("$" if i > len(w) - 3 else "")
        return self._steps(part) + (math.log((self.two.get(part[:2], 0) + 0.02) / (self.first + 5)) if i == 0 else 0.0)

    def _steps(self, w: str) -> float:
        s = 0.0
        for i in range(len(w) - 2):
            g = w[i : i + 3]
            back = (self.mid.get(g[1:], 0) + 0.02) / (self.one.get(g[1], 0) + 5)
            k = self.kinds.get(g[:2], 0)
            s += math.log((self.three.get(g, 0) + (k + 1) * back) / (self.two.get(g[:2], 0) + k + 1))
        return s

    def _word(self, word: str) -> str:
        """The word read as a one-byte pair would have it, or as it is."""
        got = self.memo.get(word)
        if got is not None:
            return got
        pairs: dict[str, dict[str, str]] = defaultdict(dict)
        for ch in set(word):
            for pair, letter in self.single.get(ch, ()):
                pairs[pair].setdefault(ch, letter)
        letters = [c for c in word if c.isascii() and c.isalpha()]
        upper = len(letters) > 1 and all(c.isupper() for c in letters)
        best = word
        if _BOX.search(word) or (_CYRILLIC.search(word) and _LATIN.search(word)):
            score = -math.inf
        else:
            score = self._score(word) + (MARGIN if all(c in RESTORED for c in word if not c.isascii()) else MARGIN_FOREIGN)
        readings = [word.translate({ord(a): b for a, b in table.items()}) for table in pairs.values()]
        for a, letters_ in (("Ã", DROPPED), ("ã", DROPPED.lower())):
            if a in word:
                readings.append(self._choose(word, a, letters_))
        for t in readings:
            new = [b for a, b in zip(word, t) if a != b]
            if upper and any(b.islower() and b not in "ªº" for b in new):
                continue
            if not upper and any(b.isupper() and a != b for a, b in list(zip(word, t))[1:]):
                continue
            s = self._score(t)
            if s > score:
                best, score = t, s
        if len(self.memo) < 200_000:
            self.memo[word] = best
        return best

    def _choose(self, word: str, sign: str, letters: str) -> str:
        """The word with each sign replaced by the likeliest of letters, the sign itself among them."""
        w = list(word)
        places = [i for i, c in enumerate(word) if c == sign]
        if len(places) == 2:
            (i, j), scored = places, []
            for c, d in product(letters, letters):
                w[i], w[j] = c, d
                scored.append((self._score("".join(w)), "".join(w)))
            return max(scored)[1]
        for _ in range(2 if len(places) > 1 else 1):
            for i in places:
                scored = []
                for c in letters:
                    w[i] = c
                    scored.append((self._near(w, i), c))
                w[i] = max(scored)[1]
        return "".join(w)

    def __call__(self, text: str) -> str:
        """The text with its garbled spans restored; ASCII texts come back as they are."""
        if text.isascii():
            return text
        out, at = [], 0
        for end, (n, c) in self.several.iter_long(text):
            start = end - n + 1
            out.append(text[at:start])
            out.append(c)
            at = end + 1
        if at:
            out.append(text[at:])
            text = "".join(out)
        if any(c in self.single or c in "Ãã" for c in text):
            text = "".join(w if w.isascii() else self._word(w) for w in re.split(f"({_BETWEEN})", text))
        return text

    def garbled(self, text: str) -> bool:
        return "�" in text or _C1.search(text) is not None or self(text) != text


def model(texts: list[Column | DataFrame], columns: list[str]) -> dict[str, int]:
    """Triple counts of all columns of all frames, on the driver; bounded by the alphabet (see triple_counts)."""
    frames = [t.select(F.col(c).alias("t")) for t, cs in zip(texts, columns) for c in cs]
    counts = triple_counts(reduce(DataFrame.unionAll, frames), "t")
    return {r["g"]: r["n"] for r in counts.collect()}


def find(df: DataFrame, triples: dict[str, int], keys: list[str], column: str) -> DataFrame:
    """(keys, texto, restaurado, restavel): the rows whose text is garbled in any part.

    restaurado has the garbled spans restored; restavel says that nothing
    unrestorable (U+FFFD, a stray control) is left. Null, empty and ASCII texts
    are never garbled. Repeated rows come out repeatedly. Texts are taken whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(triples)
    rows = df.filter(F.col(column).rlike(r"[^\x00-\x7F]")).select(*keys, F.col(column).alias("texto"))
    schema = rows.select(*keys, "texto", F.lit("").alias("restaurado"), F.lit(True).alias("restavel")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer(shared)
        for f in frames:
            new = f.texto.map(fix)
            bad = f.texto.map(lambda t: "�" in t or _C1.search(t) is not None) | (new != f.texto)
            f = f.assign(restaurado=new, restavel=[("�" not in t and _C1.search(t) is None) for t in new])
            yield f[bad.astype(bool)]

    return rows.mapInPandas(run, schema)


_made: dict[int, Repairer] = {}


def repairer(shared) -> Repairer:
    """The worker's repairer of a broadcast model."""
    key = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast is not None else id(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = Repairer(shared.value)
    return _made[key]
