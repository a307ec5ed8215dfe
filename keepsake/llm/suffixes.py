"""Sparse suffix arrays: suffixes at minimiser positions, sorted across the cluster, neighbours compared and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.decontaminate import bounded
from keepsake.llm.staging import release, staged
from keepsake.llm.substrings import Words, mix, powers

#: Words of a seed, the run whose hash selects positions.
SEED = 8


def minimisers(w: Words, least: int, seed: int = SEED) -> np.ndarray:
    """Positions of the least-hashed seed in every run of ``least`` words (leftmost of equals), increasing.

    A run of words selects the same seeds wherever it stands, so any two documents that share ``least`` words
    in a row share a selected position in them. About 2 in ``least - seed + 2`` positions are selected.
    """
    if w.n < least:
        return np.zeros(0, dtype=np.int64)
    first = np.arange(w.n - seed + 1)
    grams = w.runs(first, first + seed)
    view = np.lib.stride_tricks.sliding_window_view(grams, least - seed + 1)
    chosen = np.arange(len(view)) + view.argmin(axis=1)
    return chosen[np.r_[True, chosen[1:] != chosen[:-1]]]


def _seeds(docs: DataFrame, least: int) -> DataFrame:
    """(seed, doc_id) of all selected positions, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, lengths = [np.zeros(0, np.uint64)], []
            for text in b.column(1).to_pylist():
                w = Words(text)
                at = minimisers(w, least)
                seeds.append(np.unique(w.runs(at, at + SEED)))
                lengths.append(len(seeds[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))], names=["seed", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"seed long, doc_id {_kind(docs)}")


def _positions(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(seed, extent, before, after, doc_id, at): the selected positions whose seed another document has too.

    ``extent`` is the hash of all words that a match can reach without meeting another selected position, of
    which ``before`` words stand before the position: equal extents are equal runs at equal places.
    """
    reach = least + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, owner = [[np.zeros(0, np.int64)] for _ in range(5)], []
            for text, asked in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = Words(text)
                at = minimisers(w, least)
                seed = w.runs(at, at + SEED).view(np.int64)
                mine = np.isin(seed, np.array(asked, dtype=np.int64))
                at, seed = at[mine], seed[mine]
                first, last = np.maximum(at - reach, 0), np.minimum(at + reach, w.n)
                extent = mix(w.runs(first, last) ^ mix((at - first).astype(np.uint64) + np.uint64(1)))
                owner.append(len(at))
                for col, values in zip(cols, (seed, extent.view(np.int64), at - first, last - at, at), strict=True):
                    col.append(values)
            seed, extent, before, after, at = (pa.array(np.concatenate(c)) for c in cols)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(owner)), owner)))
            yield pa.RecordBatch.from_arrays([seed, extent, before, after, ids, at], names=["seed", "extent", "before", "after", "doc_id", "at"])

    asked = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "seeds")
    return asked.mapInArrow(run, f"seed long, extent long, before long, after long, doc_id {_kind(docs)}, at long")


def _suffixes(docs: DataFrame, opened: DataFrame, least: int) -> DataFrame:
    """(seed, key, back, doc_id, at, lo, hi) of the positions in ``opened``, a list of places for each document.

    ``key`` holds the hashes of the following words, ``back`` those of the words before, nearest first.
    """
    reach = least + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field(0).type
            for k, (text, places) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                w, at = Words(text), np.array([x["at"] for x in places], dtype=np.int64)
                mine = at + SEED <= w.n  # an id may have several texts
                mine[mine] = w.runs(at[mine], at[mine] + SEED).view(np.int64) == np.array([x["seed"] for x in places], dtype=np.int64)[mine]
                codes = (w.hashes & np.uint64(0xFFFFFFFF)).astype(">u4")
                turned = codes[::-1].copy()
                mine = np.flatnonzero(mine).tolist()
                key = [codes[p : p + reach].tobytes() for p in at[mine].tolist()]
                back = [turned[w.n - p : w.n - p + reach].tobytes() for p in at[mine].tolist()]
                ids, lo, hi = b.column(0).take(pa.array(np.full(len(mine), k))), *(pa.array([places[x][c] for x in mine], kind) for c in ("lo", "hi"))
                yield pa.RecordBatch.from_arrays([pa.array([places[x]["seed"] for x in mine], pa.int64()), pa.array(key, pa.binary()), pa.array(back, pa.binary()), ids, pa.array(at[mine]), lo, hi], names=["seed", "key", "back", "doc_id", "at", "lo", "hi"])

    asked = docs.select("doc_id", "text").join(opened, "doc_id").select("doc_id", "text", "places")
    return asked.mapInArrow(run, f"seed long, key binary, back binary, doc_id {_kind(docs)}, at long, lo {_kind(docs)}, hi {_kind(docs)}")


def _kind(docs: DataFrame) -> str:
    return dict(docs.dtypes)["doc_id"]


def _windows(suffixes: DataFrame, least: int) -> DataFrame:
    """(window, doc_id, start, lo, hi): all runs of ``least`` words around each suffix's seed, by hash."""
    reach = least + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, inverse = powers(2 * reach)
        first = np.arange(reach + SEED - least, reach + 1)
        for b in batches:
            for part in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                key, n_key = _matrix(part.column(0), reach)
                back, n_back = _matrix(part.column(1), reach)
                codes = np.concatenate([back[:, ::-1], key], axis=1).astype(np.uint64)
                sums = np.zeros((len(codes), 2 * reach + 1), dtype=np.uint64)
                np.cumsum(mix(codes + np.uint64(1)) * forward, axis=1, out=sums[:, 1:])
                hashes = mix((sums[:, first + least] - sums[:, first]) * inverse[first])
                row, col = np.nonzero((first >= reach - n_back[:, None]) & (first + least <= reach + n_key[:, None]))
                start = part.column(3).to_numpy()[row] - reach + first[col]
                ids, lo, hi = (part.column(c).take(pa.array(row)) for c in (2, 4, 5))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[row, col].view(np.int64)), ids, pa.array(start), lo, hi], names=["window", "doc_id", "start", "lo", "hi"])

    kind = _kind(suffixes)
    return suffixes.select("key", "back", "doc_id", "at", "lo", "hi").mapInArrow(run, f"window long, doc_id {kind}, start long, lo {kind}, hi {kind}")


def _shared_windows(suffixes: DataFrame, least: int) -> DataFrame:
    """(doc_id, start, end, other) of every run of ``least`` words that two different extents have.

    Neighbours in an order are few, so what stands between two suffixes can hide a match of theirs; equal
    windows can't be hidden. Counts combine before the shuffle, and adaptive execution splits the way back.
    """
    windows = staged(_windows(suffixes, least), "windows")
    again = windows.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    alone = windows.where("lo = hi").select("window", "doc_id", "start")  # the others' whole extents are found as such
    met = alone.join(again, "window")
    return met.select("doc_id", "start", (F.col("start") + least).alias("end"), F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))


def _matrix(values: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of word codes, and their lengths in words."""
    raw = values.to_pylist()
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in raw), dtype=">u4").reshape(-1, width), sizes


def _common(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that rows i and j have in common from the start on."""
    same = m[i] == m[j]
    return np.minimum(np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1)), np.minimum(n[i], n[j]))


def _matches(rows: pa.Table, least: int, near: int) -> pa.RecordBatch:
    """Matches of at least ``least`` words between sorted suffixes and their neighbours: (doc_id, start, end).

    Neighbours are the rows up to ``near`` places on, and the next and the previous row of another document.
    """
    ids = rows.column("doc_id").combine_chunks()
    doc = ids.dictionary_encode().indices.to_numpy()
    seed, at = (rows.column(c).to_numpy() for c in ("seed", "at"))
    key, n_key = _matrix(rows.column("key"), least + 2)
    back, n_back = _matrix(rows.column("back"), least + 2)
    n, rows_at = len(seed), np.arange(len(seed))
    change = np.flatnonzero(doc[1:] != doc[:-1]) + 1 if n else np.zeros(0, np.int64)
    nexts = np.append(change, n)[np.searchsorted(change, rows_at, side="right")]
    before = np.concatenate([[0], change])[np.searchsorted(change, rows_at, side="right")] - 1
    pairs = [(rows_at[: n - step], rows_at[step:]) for step in range(1, min(near, max(n - 1, 0)) + 1)]
    pairs += [(rows_at[nexts < n], nexts[nexts < n]), (before[before >= 0], rows_at[before >= 0])]
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    i, j = np.unique(np.stack([i, j]), axis=1) if len(i) else (i, j)
    same = (seed[i] == seed[j]) & (doc[i] != doc[j])
    i, j = i[same], j[same]
    right, left = _common(key, n_key, i, j), _common(back, n_back, i, j)
    long = right + left >= least
    i, j, right, left = i[long], j[long], right[long], left[long]
    who = np.concatenate([i, j])
    start, end = at[who] - np.concatenate([left, left]), at[who] + np.concatenate([right, right])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], names=["doc_id", "start", "end"])


def _tail(rows: pa.Table, near: int) -> pa.Table:
    """The last rows, and those before the last document's own run: what later rows may be compared with."""
    n, doc = rows.num_rows, rows.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()
    start = int(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])[-1]) if n else 0
    keep = sorted({*range(max(0, n - near), n), *range(max(0, start - near), start)})
    return rows.take(pa.array(keep, pa.int64()))


def _sorted_matches(suffixes: DataFrame, by: str, least: int, near: int) -> DataFrame:
    """(doc_id, start, end) from one global order of the suffixes.

    The order is cut by range over the seed, the next two words, document and place, so a seed that a third
    of all documents have is spread over tasks, and what is sampled for the cut is short. Each task compares
    its sorted rows in a stream; the rows at its ends are given out too, and each task's last are compared
    with the first of the next.
    """
    kind = _kind(suffixes)
    names = ["doc_id", "start", "end", "pair", "nth", "seed", "key", "back", "at"]
    schema = f"doc_id {kind}, start long, end long, pair long, nth long, seed long, key binary, back binary, at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, first = TaskContext.get().partitionId(), None, None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if first is None or first.num_rows < near:
                first = rows.slice(0, near)
            m = _matches(rows, least, near)
            none = pa.nulls(m.num_rows)
            yield pa.RecordBatch.from_arrays([*m.columns, *[none.cast(pa.int64())] * 3, *[none.cast(pa.binary())] * 2, none.cast(pa.int64())], names=names)
            held = _tail(rows, near)
        for pair, end in ((task - 1, first), (task, held)):
            if end is not None:
                k = end.num_rows
                none = pa.nulls(k).cast(pa.int64())
                seed, key, back, ids, at = (end.column(c).combine_chunks() for c in ("seed", "key", "back", "doc_id", "at"))
                nth = pa.array(np.arange(k) + (0 if pair == task else 1 << 20))
                yield pa.RecordBatch.from_arrays([ids, none, none, pa.array([pair] * k, pa.int64()), nth, seed, key, back, at], names=names)

    cut = suffixes.repartitionByRange("seed", F.substring(F.col(by), 1, 8), "doc_id", "at").sortWithinPartitions("seed", by, "doc_id", "at")
    out = staged(cut.mapInArrow(run, schema), "neighbours")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            yield _matches(held, least, near)
            held = _tail(held, 2 * near)

    ends = out.where("pair is not null").repartition("pair").sortWithinPartitions("pair", "nth").select("seed", "key", "back", "doc_id", "at")
    return out.where("pair is null").select("doc_id", "start", "end").unionByName(ends.mapInArrow(across, f"doc_id {kind}, start long, end long"))


def _merged(spans: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, other_id): a document's overlapping spans put together, with the least partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, starts, sizes, others = [], [], [], []
            for k, found in enumerate(b.column(1).to_pylist()):
                end = None
                for x in sorted(found, key=lambda x: (x["start"], x["end"])):
                    if end is None or x["start"] > end:
                        owner.append(k)
                        starts.append(x["start"])
                        sizes.append(0)
                        others.append(None)
                        end = x["end"]
                    end = max(end, x["end"])
                    sizes[-1] = end - starts[-1]
                    if x["other"] is not None:
                        others[-1] = x["other"] if others[-1] is None else min(others[-1], x["other"])
            kind = b.schema.field(0).type
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(others, kind)], names=["doc_id", "start", "n_words", "other_id"])

    own = spans.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other")).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "other")).alias("s"))
    kind = _kind(spans)
    return own.mapInArrow(run, f"doc_id {kind}, start long, n_words long, other_id {kind}")


def repeated_passages(docs: DataFrame, least: int = 50, near: int = 2) -> DataFrame:
    """Passages of at least ``least`` words that another document has too, for every document of each group.

    Suffixes are kept at minimiser positions whose seed occurs in two documents. Where all that a match can
    reach from there is the same in several documents, the whole of it is a passage, and one of them stands
    for all. Where a seed has different surroundings, these are sorted as suffixes once by the words that
    follow and once by the words before, each is compared with its next ``near`` neighbours and the nearest
    of another document, and matches are extended to both sides. Matches that no two neighbours have are
    found by the hashes of all runs of ``least`` words around those positions. Surroundings that one document
    alone repeats are looked at in each of their places. A passage that many documents share links each to one other, never all to all.

    Words are compared unchanged, by hashes. Null ids and null, empty or short texts give nothing; rows that
    repeat an id count as one document, and repeats inside a document alone are not reported. Extra columns
    are not read. Returns (doc_id, start, n_words, other_id): merged spans in words, and the least of the
    partners that were found for its parts.
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")
    seeds = staged(_seeds(known, least), "seeds")
    again = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    wanted = seeds.join(again, "seed", "left_semi").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    positions = staged(_positions(known, wanted, least), "positions")
    release(seeds)
    extents = staged(positions.groupBy("seed", "extent").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "at")).alias("rep"), F.count(F.lit(1)).alias("n")), "extents")
    shared = positions.where(F.col("before") + F.col("after") >= least).join(extents.where("lo < hi").select("seed", "extent", "lo", "hi"), ["seed", "extent"])
    whole = shared.select("doc_id", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"), F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    several = extents.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    opened = extents.join(several, "seed", "left_semi")
    # one stands for all where all are passages as a whole; surroundings that a document alone repeats are opened at every place
    own = opened.where("lo = hi and n > 1").select("seed", "extent", "lo", "hi")
    ones = opened.where("lo < hi or n = 1").select("rep.doc_id", "rep.at", "seed", "lo", "hi")
    each = ones.unionByName(positions.select("seed", "extent", "doc_id", "at").join(bounded(own, 1_000_000), ["seed", "extent"]).select("doc_id", "at", "seed", "lo", "hi"))
    places = each.groupBy("doc_id").agg(F.collect_list(F.struct("at", "seed", "lo", "hi")).alias("places"))
    suffixes = staged(_suffixes(known, places, least), "suffixes")
    nobody = F.lit(None).cast(_kind(known)).alias("other")
    near_by = [_sorted_matches(suffixes, by, least, near).select("doc_id", "start", "end", nobody) for by in ("key", "back")]
    return _merged(whole.unionByName(near_by[0]).unionByName(near_by[1]).unionByName(_shared_windows(suffixes, least)))
