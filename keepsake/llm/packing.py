"""Best-fit packing: documents' pieces into as few training sequences as best-fit decreasing finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.staging import staged
from keepsake.llm.tokens import encode_texts, encoder


class OpenBins:
    """Open bins by remaining capacity under a segment tree that knows where any are.

    Leaf c says whether some bin has c tokens left; an inner node, whether any leaf below does. The tightest
    bin with at least ``need`` left is found by one walk up and down: logarithmic in the capacity. Bins of
    equal remainder are interchangeable and kept as runs (first bin, how many).
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, left: int) -> None:
        at, value = left + self.leaves, 1 if self.runs[left] else 0
        self.any[at] = value
        while at > 1:
            at >>= 1
            value = self.any[2 * at] | self.any[2 * at + 1]
            if self.any[at] == value:
                return
            self.any[at] = value

    def add(self, left: int, first: int, count: int) -> None:
        self.runs[left].append((first, count))
        self._mark(left)

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins with exactly ``left`` tokens left, as one run."""
        first, count = self.runs[left].pop()
        if count > most:
            self.runs[left].append((first + most, count - most))
            count = most
        self._mark(left)
        return first, count

    def tightest(self, need: int) -> int:
        """The least remainder of at least ``need`` that some bin has; -1 if none."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of piece lengths: the runs in which pieces take their places.

    Rows (length, first rank, pieces, first bin, pieces a bin, offset): among the pieces of that length, those
    ranked from ``first rank`` on go, ``pieces a bin`` to each bin in turn, from ``offset`` on. Placing equal
    pieces one at a time would fill the tightest bin until no more fits and then the next, so whole runs are
    placed at once and the packing is that of placing document after document. The work and the result
    depend on the capacity (2,048: at most some ten thousand rows), not on the number of documents.
    """
    bins, plan, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = bins.tightest(length)
            if left < 0:
                each = capacity // length
                full, rest = divmod(todo, each)
                for count, fill in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        plan.append((length, rank, count * fill, made, fill, 0))
                        if capacity - fill * length:
                            bins.add(capacity - fill * length, made, count)
                        rank, todo, made = rank + count * fill, todo - count * fill, made + count
                continue
            each = left // length
            first, count = bins.take(left, max(1, todo // each))
            fill = min(each, todo)
            count = min(count, todo // fill)
            plan.append((length, rank, count * fill, first, fill, capacity - left))
            if left - fill * length:
                bins.add(left - fill * length, first, count)
            rank, todo = rank + count * fill, todo - count * fill
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of ``capacity``; only longer ones are cut.

    Columns ``keep``, piece (from 0), start, length, ids (little-endian 32-bit binary). ``tokenizer`` is the
    path of a tokenizer file that every executor can read. Null texts are empty: their only id is ``end_id``.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, piece, ids = [], [], []
            for k, own in enumerate(encode_texts(tokenizer, b.column(len(keep)).to_pylist())):
                every = own + end
                for p, at in enumerate(range(0, len(every), 4 * capacity)):
                    owner.append(k)
                    piece.append(p)
                    ids.append(every[at : at + 4 * capacity])
            kept = [c.take(pa.array(owner, pa.int32())) for c in b.columns[: len(keep)]]
            p = np.array(piece, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array(p.astype(np.int64) * capacity), pa.array(np.array([len(x) // 4 for x in ids], dtype=np.int64)), pa.array(ids, pa.binary())], names=[*keep, "piece", "start", "length", "ids"])
        encoder(tokenizer).forget()

    small = docs.select(*keep, F.col("text").alias("_text"))
    return small.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in small.dtypes[:-1]) + ", piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``pieces`` by best-fit decreasing on ``length``.

    The histogram of lengths (at most ``capacity`` rows) comes to the driver; best-fit decreasing over it
    gives runs of places, a table whose size the capacity bounds, which is broadcast. A piece needs only its
    rank among pieces of its length. Ranks are counted in two steps, within (length, slice) groups and over
    the slices' counts, so a length that most pieces share is no single task. ``pieces`` must be a stored
    table, since it is read twice. Equal rows are told apart by nothing and take different places.
    """
    key = F.xxhash64(*order)
    if any(pieces.schema[c].nullable for c in order):  # rows without a key are dealt by what else they hold
        key = F.when(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in order]).contains("1"), F.xxhash64(*pieces.columns)).otherwise(key)
    cut = pieces.withColumn("_slice", F.pmod(key, F.lit(4096)).cast("int"))
    sizes = staged(cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    spark = pieces.sparkSession
    runs = spark.createDataFrame(plan, "length long, rank long, pieces long, bin long, fill long, offset long")
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "pieces", "bin", "fill", "offset"))).alias("runs"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_slice", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order)) - 1
    ranked = cut.withColumn("_in", inside).join(bases, ["length", "_slice"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("_run", F.element_at(F.filter("runs", lambda r: (r["rank"] <= F.col("_rank")) & (F.col("_rank") < r["rank"] + r["pieces"])), 1))
    nth = F.col("_rank") - F.col("_run.rank")
    return placed.select(*pieces.columns, (F.col("_run.bin") + F.floor(nth / F.col("_run.fill"))).cast("long").alias("sequence_id"), (F.col("_run.offset") + nth % F.col("_run.fill") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): each sequence's ids put together, at most one capacity long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.reduce("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
