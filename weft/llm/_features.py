"""Hashed n-gram indicators of whole texts, and labelled training samples."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, give_back, hash_sample, kept_by_worker, text_of

BITS = 20
SIZE = 1 << BITS
MEMO_ENTRIES, MEMO_KEY_BYTES = 150_000, 64
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """The kind of a word: runs of upper case, lower case and digits become A, a and 0; other signs stay, at most three alike."""
    kind = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(lambda m: m[1] if m[1] in "Aa0" else m[0][:3], kind)


class Words:
    """Hashes of words (lower case, without signs at the ends) and of their shapes, with a bounded memory of recent ones."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.word, self.shape, self.used = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.uint64), 0

    def _add(self, raw: bytes) -> int:
        if self.used == len(self.word):
            self.word, self.shape = (np.concatenate([a, np.empty_like(a)]) for a in (self.word, self.shape))
        text = raw.decode()
        plain = re.sub(r"^\W+|\W+$", "", text).lower()
        self.word[self.used] = xxhash.xxh3_64_intdigest(plain)
        self.shape[self.used] = xxhash.xxh3_64_intdigest(shape(text), 1)
        self.used += 1
        return self.used - 1

    def hashes(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        at = self.at
        try:
            codes = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        except KeyError:
            if self.used > MEMO_ENTRIES:
                at.clear()
                self.used = 0
            for w in words:
                if w not in at:
                    at[w] = self._add(w)
            codes = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            for w in words:
                if len(w) > MEMO_KEY_BYTES:
                    at.pop(w, None)
        return self.word[codes], self.shape[codes]


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * _P1 + (b ^ (b >> np.uint64(29))) * _P2
    return h ^ (h >> np.uint64(32))


class Indicators:
    """The set of hashed n-grams of a text: one and two words, and one to three word shapes."""

    def __init__(self):
        self.words = Words()
        self.mark = np.zeros(SIZE, np.int32)

    def of(self, text: bytes) -> np.ndarray:
        w, s = self.words.hashes(text)
        parts = [_mix(w, ~w), _mix(w[:-1], w[1:])]
        if len(w):
            s = s.copy()
            s[1:][w[1:] == w[:-1]] ^= _P2  # a word said again
            pairs = _mix(s[:-1], s[1:])
            parts += [_mix(s, ~s), pairs, _mix(pairs[:-1], s[2:])]
        ids = (np.concatenate(parts) >> np.uint64(64 - BITS - 8)).astype(np.int64) & (SIZE - 1)
        order = np.arange(len(ids), dtype=np.int32)
        self.mark[ids] = order
        return ids[self.mark[ids] == order]  # each once


class Beginnings:
    """The set of hashed words and beginnings of words of a text, at three levels of how often they come.

    Level 0 is any occurrence; level 1 two or more and at least 4 in 1,000 words; level 2 three or
    more and at least 10 in 1,000.
    """

    SIZES, LEVELS = (3, 4, 5, 6, 7, 8), ((1, 0.0), (2, 0.004), (3, 0.01))

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.rows, self.used = np.zeros((1 << 15, 1 + len(self.SIZES)), np.uint64), 0

    def _add(self, raw: bytes) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        plain = re.sub(r"^\W+|\W+$", "", raw.decode()).lower()
        whole = xxhash.xxh3_64_intdigest(plain)
        parts = [xxhash.xxh3_64_intdigest(plain[:n], 1) if len(plain) >= n else whole for n in self.SIZES]
        self.rows[self.used] = [whole, *parts]
        self.used += 1
        return self.used - 1

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        counted = Counter(words)
        at = self.at
        if self.used > MEMO_ENTRIES:
            at.clear()
            self.used = 0
        codes = np.empty(len(counted), np.int64)
        for i, w in enumerate(counted):
            c = at.get(w)
            if c is None:
                c = self._add(w)
                if len(w) <= MEMO_KEY_BYTES:
                    at[w] = c
            codes[i] = c
        rows = self.rows[codes]
        if (short := rows[:, 1:] == rows[:, :1]).any():  # a beginning as long as the word says nothing new
            rows[:, 1:][short] = 0
        times = np.repeat(np.fromiter(counted.values(), np.int64, len(counted)), rows.shape[1])
        ids, where = np.unique(rows.ravel() >> np.uint64(64 - BITS - 8), return_inverse=True)
        count = np.bincount(where, times)
        if ids[0] == 0:
            ids, count = ids[1:], count[1:]
        levels = [ids[(count >= n) & (count >= share * len(words))] * np.uint64(3) + np.uint64(k) for k, (n, share) in enumerate(self.LEVELS)]
        mixed = np.concatenate(levels) * _P1
        return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int64))


def indicators(kind: str) -> Indicators | Beginnings:
    """``n-grams`` or ``beginnings``."""
    return kept_by_worker(kind, {"n-grams": Indicators, "beginnings": Beginnings}[kind])


def pieces(indptr: np.ndarray, most: int = 1 << 20):
    """(first row, row behind the last, place of each indicator's row) in runs of rows with about ``most`` indicators, as whole-sample copies would fill the driver."""
    start = 0
    while start < len(indptr) - 1:
        end = max(start + 1, int(np.searchsorted(indptr, indptr[start] + most, "right")) - 1)
        yield start, end, np.repeat(np.arange(end - start), np.diff(indptr[start : end + 1]))
        start = end


def class_counts(indptr: np.ndarray, index: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each indicator the rows among two sets of rows (masks) that have it."""
    out = np.zeros((2, SIZE), np.int64)
    for a, b, row in pieces(indptr):
        part = index[indptr[a] : indptr[b]]
        for k, rows in enumerate((first, second)):
            out[k] += np.bincount(part[rows[a:b][row]], minlength=SIZE)
    return out[0], out[1]


def in_fold(id_col: str, fold: int, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, most: int, id_col: str, text_col: str, kind: str, held_out: int = 1):
    """Indicators and labels of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the id.

    A row labelled more than once has its smallest label; rows without id or label take no part.
    """
    bounded_batches(docs.sparkSession)
    labelled = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~in_fold(id_col, held_out))
    chosen = hash_sample(labelled.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("_label")), most, "_id")

    @F.arrow_udf("array<int>")
    def found(text: pa.Array) -> pa.Array:
        of = indicators(kind).of
        return pa.array([of(t).astype(np.int32) for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))

    # at most ``most`` ids are broadcast
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    got = rows.select("_id", "_label", found("_text").alias("_found")).toArrow().sort_by("_id")
    kept = got.column("_found").combine_chunks()
    offsets = kept.offsets.to_numpy().astype(np.int64)
    label, index = got.column("_label").to_numpy(), kept.flatten().to_numpy()
    del got, kept
    give_back(docs.sparkSession)  # models are fitted here next, while the JVM rests
    return offsets - offsets[0], index, label
