"""Byte-pair encoding of whole texts with the vocabulary of a public tokenizer.

Texts are cut by the vocabulary's own pattern; the words of a batch that were
not met before are encoded together through a pair occurrence index: every pair
of neighbouring symbols is mapped to all its positions, the ranks that occur are
taken in ascending order, each is merged at all its positions at once, and only
the lists of the pairs touched by a merge are updated. A merged symbol can only
take part in pairs of higher rank, so each rank is taken once.

Encoded words are kept for the life of a Python worker, up to KEEP words, in one
flat array; a text's ids are then gathered from it by position.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept by a worker (about 100 bytes each); on reaching it the memory starts anew.
KEEP = 1_000_000
VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Encoder of one vocabulary file of lines "base64 token, rank"; a token's id is its rank."""

    def __init__(self, path: str, pattern: str | None = None, keep: int = KEEP):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.width = 1 << max(self.ranks.values()).bit_length()
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _merge(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all words in a row, number of ids of each word)."""
        pairs, width, byte = self.pairs, self.width, self.byte
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        token: list[int] = []
        ends: list[int] = []
        for b in raw:
            token.extend(map(byte.__getitem__, b))
            token.append(-1)  # never part of a pair
            ends.append(len(token))
        n = len(token)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        get = pairs.get
        last = -1
        for i, t in enumerate(token):
            if last >= 0 and t >= 0 and (r := get(last * width + t)) is not None:
                if r in where:
                    where[r].append(i - 1)
                else:
                    where[r] = [i - 1]
            last = t
        active = list(where)
        heapq.heapify(active)
        dead = -2
        while active:
            rank = heapq.heappop(active)
            at = where.pop(rank)
            at.sort()
            for i in at:
                a = token[i]
                if a < 0:
                    continue
                j = after[i]
                b = token[j]
                if b < 0 or get(a * width + b) != rank:
                    continue
                token[i], token[j] = rank, dead
                k = after[j]
                after[i] = k
                before[k] = i
                if (t := token[k]) >= 0 and (r := get(rank * width + t)) is not None:
                    if r in where:
                        where[r].append(i)
                    else:
                        where[r] = [i]
                        heapq.heappush(active, r)
                h = before[i]
                if h >= 0 and (t := token[h]) >= 0 and (r := get(t * width + rank)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        heapq.heappush(active, r)
        out = np.array(token, np.int32)
        live = out >= 0
        upto = np.concatenate(([0], np.cumsum(live)))[np.array([0, *ends])]
        return out[live], np.diff(upto)

    def _learn(self, words: list[str]) -> None:
        ids, lengths = self._merge(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        k = len(self.known)
        while k + len(words) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[k : k + len(words)] = lengths
        self.start[k : k + len(words)] = self.used + np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + len(words))))

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts in a row, number of words of each text)."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self._forget()
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            self._learn(list(new))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; null and empty texts give empty lists."""
        words, counts = self._words(texts)
        lengths = self.length[words]
        total = np.concatenate(([0], np.cumsum(lengths)))
        # positions in flat: each word's start, counted on inside the word
        at = np.repeat(self.start[words] - total[:-1], lengths) + np.arange(total[-1])
        bounds = total[np.concatenate(([0], np.cumsum(counts)))]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(self.flat[at], pa.int32()))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        words, counts = self._words(texts)
        total = np.concatenate(([0], np.cumsum(self.length[words])))
        return np.diff(total[np.concatenate(([0], np.cumsum(counts)))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Characters of text taken at once; a longer text goes alone.
CHUNK = 4_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > CHUNK:
            yield start, i
            start = i
            size = 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row: ids of the text without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a text
    are ordinary text. Repeated rows come out repeatedly. Other columns are
    ignored. path is the vocabulary file, readable on every executor.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _chunks(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), enc.encode(texts[i:j])], names=["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns named in keep and tokens BIGINT, the number of ids of the text (0 for null and empty)."""
    path = path or vocabulary_path()
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(*keep, F.lit(0).cast("bigint").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for i, j in _chunks(texts):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(enc.count(texts[i:j]), pa.int64())], names=[*keep, "tokens"])

    return rows.mapInArrow(run, schema)
