"""Evaluation passages inside training texts, by pigeonhole edit matching.

A leak is a run of at least ``min_words`` consecutive words of a passage that stands in a text with at most one word in ``error_in``
changed, dropped or added. Any such run holds a shorter one of 20, 24 or 32 words (for one error in eight) with 2, 3 or 4 errors, so
these windows suffice. A window with budget e is split into e+1 pieces; one of them must stand unchanged, and it has at least
``piece`` words. So: every run of ``piece`` words of every passage goes into a hash index, texts are scanned for exact hits, and
windows around a hit are verified with Myers' bit-parallel edit distance over words.

Words are runs of letters and digits, compared without case; punctuation, quote marks and line breaks only separate them.

The items are a stated set: they are taken in blocks of ``items_per_block`` (read on the driver, sent to the tasks), each block
against all texts. Only hits leave a task.

Defined results: null and empty texts and passages have no words and no leaks; passages under min_words none; one row per text and
item, however often it stands there; rows with a null id are ignored; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows_for(min_words: int, error_in: int) -> list[tuple[int, int]]:
    """(length, errors) of the windows that every longer match contains one of."""
    out = [(min_words, min_words // error_in)]
    length = (min_words // error_in + 1) * error_in
    while length < 2 * min_words:
        if length > min_words:
            out.append((length, length // error_in))
        length += error_in
    return out


def piece_words(windows: list[tuple[int, int]]) -> int:
    return min(-(-(n - e) // (e + 1)) for n, e in windows)


def myers(pattern: list, text: list) -> int:
    """Least edit distance of the whole pattern to any part of text (words are symbols)."""
    m = len(pattern)
    masks: dict = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


class Index:
    """Passages as arrays of word numbers and the sorted hashes of all their pieces."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, error_in: int):
        self.windows = windows_for(min_words, error_in)
        self.piece = piece_words(self.windows)
        self.vocabulary: dict[str, int] = {}
        self.ids, self.passages = [], []
        for item, passage in items:
            w = words(passage or "")
            if len(w) >= min_words:
                self.ids.append(item)
                self.passages.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int64))
        hashes, owner, place = [], [], []
        for k, p in enumerate(self.passages):
            h = self.rolled(p)
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)

    def rolled(self, numbers: np.ndarray) -> np.ndarray:
        n = len(numbers) - self.piece + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(self.piece):
            h = (h ^ (numbers[i : n + i].astype(np.uint64) + np.uint64(1))) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def leaks(self, text: str) -> list[int]:
        get = self.vocabulary.get
        numbers = np.array([get(w, -1) for w in words(text)], dtype=np.int64)
        known = numbers >= 0
        if len(numbers) < self.piece or not len(self.hashes):
            return []
        runs = np.convolve(known, np.ones(self.piece, np.int64), "valid") == self.piece
        at = np.flatnonzero(runs)
        if not len(at):
            return []
        h = self.rolled(numbers)[at]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = hi - lo
        if not n.any():
            return []
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where, owner, place = np.repeat(at, n), self.owner[rows], self.place[rows]
        return [self.ids[k] for k in np.unique(owner) if self._verified(numbers, self.passages[k], where[owner == k], place[owner == k])]

    def _verified(self, numbers: np.ndarray, passage: np.ndarray, where: np.ndarray, place: np.ndarray) -> bool:
        done: set[tuple[int, int, int]] = set()
        for diagonal in np.unique(where - place):
            hits = place[(where - place) == diagonal]
            for length, errors in self.windows:
                if len(passage) < length:
                    continue
                lo, hi = max(0, int(hits.min()) + self.piece - length), min(int(hits.max()), len(passage) - length)
                if hi < lo:
                    continue
                a, z = max(0, int(diagonal) + lo - errors), min(len(numbers), int(diagonal) + hi + length + errors)
                region = numbers[a:z]
                there = np.isin(passage[lo : hi + length], region).astype(np.int64)  # a window needs length - errors of its words near by
                enough = np.convolve(there, np.ones(length, np.int64), "valid") >= length - errors
                for start in (np.flatnonzero(enough) + lo).tolist():
                    if not ((hits > start - 1) & (hits + self.piece <= start + length)).any() or (start, length, int(diagonal)) in done:
                        continue
                    done.add((start, length, int(diagonal)))
                    near = numbers[max(0, int(diagonal) + start - errors) : int(diagonal) + start + length + errors]
                    if myers(passage[start : start + length].tolist(), near.tolist()) <= errors:
                        return True
        return False


def leaks(docs: DataFrame, items: DataFrame, *, id: str, text: str, item_id: str, passage: str, min_words: int = 20, error_in: int = 8, items_per_block: int = 20_000) -> DataFrame:
    """One row per text and leaked item: doc_id, item_id."""
    spark = docs.sparkSession
    some = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and length(text) > 0")
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).cast("string").alias("passage")).filter("item_id is not null and passage is not null").dropDuplicates(["item_id"])
    schema = "doc_id long, item_id long"
    out = None
    block: list[tuple[int, str]] = []

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(Index(block, min_words, error_in))  # at most items_per_block passages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                found = [(d, i) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in index.leaks(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "item_id"])

        return some.mapInArrow(run, schema)

    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["passage"]))
        if len(block) == items_per_block:
            found = scan(block)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = scan(block)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
