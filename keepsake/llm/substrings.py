"""Substring dedup: passages of many words that another document has already, found level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.staging import staged

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 0), dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64; kept for the next document."""
    global _powers
    if _powers.shape[1] < n:
        size = 1 << max(n, 1024).bit_length()
        steps = np.full((2, size), _BASE, dtype=np.uint64)
        steps[1] = pow(_BASE, -1, 2**64)
        steps[:, 0] = 1
        _powers = np.cumprod(steps, axis=1)
    return _powers[0, :n], _powers[1, :n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word; one to one."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class Words:
    """A document's words (runs of bytes that are not ASCII white space) and hashes of any run of them."""

    def __init__(self, text: str | None) -> None:
        self.words = (text or "").encode().split()
        self.n = len(self.words)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=self.n)
        forward, self._back = powers(self.n)
        self._sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * forward, out=self._sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of words[start:end], the same wherever the run stands."""
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))


class Windows(Words):
    """The windows of ``size`` words, their anchors and the anchors' surroundings.

    A window's anchor is the run of half the words (rounded up) with the least hash in it, the leftmost of
    equals, so equal windows have equal anchors wherever they stand. About a quarter of all positions are
    anchors. ``around`` hashes the words that any window with that anchor can reach.
    """

    def __init__(self, text: str | None, size: int) -> None:
        super().__init__(text)
        self.size, half = size, (size + 1) // 2
        count = max(0, self.n - size + 1)
        if not count:
            self.of = self.anchors = self.short = self.around = np.zeros(0, dtype=np.int64)
            return
        first = np.arange(self.n - half + 1)
        short = self.runs(first, first + half)
        self.of = np.arange(count) + np.lib.stride_tricks.sliding_window_view(short, size - half + 1).argmin(axis=1)
        self.anchors = self.of[np.r_[True, self.of[1:] != self.of[:-1]]]
        self.short = short[self.anchors]
        left = np.maximum(self.anchors - (size - half), 0)
        right = np.minimum(self.anchors + size, self.n)
        self.around = mix(self.runs(left, right) ^ mix((self.anchors - left).astype(np.uint64) + np.uint64(1)))

    def of_anchors(self, chosen: np.ndarray) -> np.ndarray:
        """Start positions of the windows whose anchor is among the chosen (a mask over ``anchors``)."""
        which = np.repeat(np.arange(len(self.anchors)), np.diff(np.r_[np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]]), len(self.of)])) if len(self.of) else np.zeros(0, dtype=np.int64)
        return np.flatnonzero(chosen[which]) if len(which) else which

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Mask of the words inside the windows that begin at ``starts``."""
        edge = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.size, -1)
        return edge[:-1].cumsum() > 0


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(short, around, doc_id) of every anchor of every document, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shorts, arounds, ids, lengths = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                w = Windows(text, size)
                around, at = np.unique(w.around, return_index=True)
                if len(at):
                    shorts.append(w.short[at])
                    arounds.append(around)
                    ids.append(k)
                    lengths.append(len(at))
            if ids:
                owner = b.column(0).take(pa.array(np.repeat(ids, lengths)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shorts).view(np.int64)), pa.array(np.concatenate(arounds).view(np.int64)), owner], names=["short", "around", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "short long, around long, doc_id long")


def _window_rows(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(window, doc_id) of the windows at the wanted anchors: ``wanted`` has (doc_id, open), a list of ``around``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, ids, lengths = [], [], []
            for k, (text, asked) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                w = Windows(text, size)
                starts = w.of_anchors(np.isin(w.around.view(np.int64), np.array(asked, dtype=np.int64)))
                found = np.unique(w.runs(starts, starts + size))
                hashes.append(found)
                ids.append(k)
                lengths.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), b.column(0).take(pa.array(np.repeat(ids, lengths)))], names=["window", "doc_id"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "open").mapInArrow(run, "window long, doc_id long")


def remove_repeats(docs: DataFrame, size: int = 13, keep: tuple[str, ...] = ("doc_id",), untouched: bool = False) -> DataFrame:
    """Remove each word covered by a ``size``-word window that also starts in a document with a smaller id.

    Levels: windows of half the size, at their anchors, are counted first; those that occur in one document
    alone are dropped. The others alone are extended, on both sides, to all the words a window of full size
    with that anchor can reach. Where the whole extent occurs in an earlier document, all its windows do. The
    first occurrence of each extent is left, and is cut into its windows of full size only if its anchor has
    other extents as well; these few windows are grouped exactly. Counts and minima are aggregates with
    map-side combining and the ways back are joins that adaptive execution splits, so a passage that a third
    of all documents share stays spread out; no list is longer than one document.

    Words are runs without ASCII white space, compared unchanged. Null texts have no words. A null doc_id is
    never earlier than another and loses nothing. Rows that repeat an id are judged alike; all rows are kept.
    Returns ``keep`` (which must hold doc_id), ``text`` (kept words joined by one space), n_words, n_removed.
    With ``untouched``, a text that loses nothing is returned as it came, white space (or null) included.
    """
    anchors = staged(_anchor_rows(docs, size), "anchors")
    again = staged(anchors.groupBy("short").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("short"), "again")
    repeated = staged(anchors.join(again, "short", "left_semi"), "repeated-anchors")
    first = staged(repeated.groupBy("short", "around").agg(F.min("doc_id").alias("first")), "first-extents")
    several = first.groupBy("short").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("short")
    opened = first.join(several, "short", "left_semi").groupBy("first").agg(F.collect_set("around").alias("open")).withColumnRenamed("first", "doc_id")
    windows = staged(_window_rows(docs, opened, size), "windows")
    earliest = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "first")
    gone_windows = windows.join(earliest, "window").where("first < doc_id").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    gone_extents = repeated.join(first, ["short", "around"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_set("around").alias("extents"))
    gone = staged(gone_extents.join(gone_windows, "doc_id", "full"), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for b in batches:
            kept, words, removed = [], [], []
            for text, extents, windows in zip(*(b.column(n + k).to_pylist() for k in range(3)), strict=True):
                if not extents and not windows:
                    w = (text or "").encode().split()
                    kept.append(text if untouched else b" ".join(w).decode())
                    words.append(len(w))
                    removed.append(0)
                    continue
                w = Windows(text, size)
                starts = w.of_anchors(np.isin(w.around.view(np.int64), np.array(extents or [], dtype=np.int64)))
                if windows:
                    every = np.arange(len(w.of))
                    starts = np.union1d(starts, every[np.isin(w.runs(every, every + size).view(np.int64), np.array(windows, dtype=np.int64))])
                gone = w.covered(starts)
                if untouched and not gone.any():
                    kept.append(text)
                else:
                    kept.append(b" ".join([x for x, g in zip(w.words, gone.tolist(), strict=True) if not g]).decode())
                words.append(w.n)
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(kept, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=[*keep, "text", "n_words", "n_removed"])

    every = docs.select("doc_id", F.col("text").alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]).join(gone, "doc_id", "left")
    every = every.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "_text", "extents", "windows")
    return every.mapInArrow(cut, ", ".join(f"`{c}` {t}" for c, t in every.dtypes[: len(keep)]) + ", text string, n_words long, n_removed long")
