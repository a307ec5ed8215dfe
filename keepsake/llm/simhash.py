"""SimHash near-duplicates: exact linking within a Hamming radius by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.components import connected_components
from keepsake.llm.staging import staged

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the whole text's word shingles, repeats included; 0 without words.

    A-Z are lower-cased, words are what ASCII white space separates, shingles of ``width`` words are joined by
    one space and hashed by XXH64; a text with fewer words is one shingle. A bit is set if more than half of
    the hashes have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return majority(np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 4) -> DataFrame:
    """``keep`` and the long ``fp`` of every document (null texts: 0); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(len(keep)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], names=[*keep, "fp"])

    small = docs.select(*keep, F.col(text).alias("_text"))
    return small.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in small.dtypes[:-1]) + ", fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """Fingerprints stored vertically: row k holds bit k of all of them, 64 to a word."""
    bits = np.unpackbits(np.ascontiguousarray(fp, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-len(fp) // 64) * 64), dtype=np.uint8)
    wide[:, : len(fp)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def within(differ: Iterator[np.ndarray], radius: int, lanes: tuple[int, ...], look: int = 8) -> np.ndarray:
    """Lanes (bits of words shaped ``lanes``) whose 64 difference planes add up to at most ``radius``.

    Carry-save counters keep every lane's distance in bit-sliced form: ``ones, twos, fours, ...`` plus a mask
    of lanes known to be beyond the radius. Every ``look`` planes the block is given up if all lanes are.
    """
    width = max(1, radius.bit_length())
    counter = [np.zeros(lanes, dtype=np.uint64) for _ in range(width)]
    beyond = np.zeros(lanes, dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k, carry in enumerate(differ):
        for c in range(width):
            counter[c], carry = counter[c] ^ carry, counter[c] & carry
        beyond |= carry
        if k % look == look - 1:
            more, equal = beyond, np.full(lanes, full)
            for c in reversed(range(width)):  # compare the counters with the radius, highest bit first
                if radius >> c & 1:
                    equal = equal & counter[c]
                else:
                    more, equal = more | (equal & counter[c]), equal & ~counter[c]
            beyond = more
            if (beyond == full).all():
                break
    return ~beyond


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """Positions of the set bits among the first n lanes, by row."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n]


def tile_hits(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i] and b[j] at most ``radius`` bits apart: every a against all of b's planes."""
    rows, cols, vertical = [], [], planes(b)
    for at in range(0, len(a), 64):
        part = a[at : at + 64]
        masks = np.where((part[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        near = within((vertical[k][None, :] ^ masks[:, k][:, None] for k in range(64)), radius, (len(part), vertical.shape[1]))
        if near.any():
            i, j = np.nonzero(unpack(near, len(b)))
            rows.append(i + at)
            cols.append(j)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 2


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n items' component under the edges (a[k], b[k])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_edges(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links inside each bucket (rows sorted by key): a star for each component.

    Small buckets are compared all together, row by row at growing offsets, in one bit-sliced sweep each;
    large ones one by one. In a bucket of two sides, sides 1 and 2, only pairs across count.
    """
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    a, b = [], []
    own = np.repeat(size, size)
    rest = np.flatnonzero((own <= 32) & (own > 1))
    offset = 1
    while len(rest):
        rest = rest[(rest + offset < n)]
        rest = rest[key[rest + offset] == key[rest]]
        if len(rest):
            gap = planes(fp[rest] ^ fp[rest + offset])
            i = rest[np.flatnonzero(unpack(within(iter(gap), radius, gap.shape[1:]), len(rest)))]
            i = i[(side[i] == 0) | (side[i] != side[i + offset])]
            a.append(i)
            b.append(i + offset)
        offset += 1
    for s, m in zip(start[size > 32], size[size > 32], strict=True):
        rows = np.arange(s, s + m)
        left, right = (rows, rows) if not side[s:s + m].any() else (rows[side[s : s + m] == 1], rows[side[s : s + m] == 2])
        i, j = tile_hits(fp[left], fp[right], radius)
        a.append(left[i])
        b.append(right[j])
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
    near = a != b
    root = roots(n, a[near], b[near])
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def block_keys(fp: Column, radius: int, agree: int = 2) -> Column:
    """The keys under which two fingerprints within the radius are sure to meet.

    The 64 bits are cut into ``radius + agree`` blocks; at most ``radius`` of them differ, so at least
    ``agree`` are equal: one key for each choice of that many blocks, with the choice's number mixed in.
    """
    parts = radius + agree
    edges = [64 * k // parts for k in range(parts + 1)]
    blocks = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1)) for k in range(parts)]
    return F.array(*[F.xxhash64(F.lit(t), *[blocks[k] for k in choice]) for t, choice in enumerate(combinations(range(parts), agree))])


def near_edges(fps: DataFrame, radius: int = 4, tile: int = 2048) -> DataFrame:
    """(src, dst) fingerprints that span all links between the distinct ``fp`` within ``radius`` bits.

    Fingerprints meet in buckets by ``block_keys``; buckets of one are dropped by a count. A bucket of more
    than ``tile`` is cut into parts by a hash, and each pair of parts is a bucket of its own in another task:
    every pair is compared, none is listed. Each bucket gives at most one edge a member.
    """
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts").cast("long")).cast("int")
    met = keyed.join(counts, "key").withColumn("part", part)
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    tiles = met.withColumn("other", F.explode(other)).select(F.xxhash64("key", lo, hi).alias("key"), side.cast("byte").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column(0).to_numpy()
            if len(key) < 65_536:
                continue
            whole = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
            if whole:
                yield from edges(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held:
            yield from edges(pa.Table.from_batches(held))

    def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        src, dst = bucket_edges(rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy().view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    dealt = tiles.repartition(F.col("key")).sortWithinPartitions("key", "side", "fp")
    return dealt.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 4, width: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its fingerprint and component: the least id reachable over links within ``radius``.

    Columns ``doc_id``, ``keep``, ``fp`` (long), ``component_id``. Equal fingerprints are linked, those of
    empty and null texts (0) like any other. Work goes by distinct fingerprints, so thousands of copies are
    one row of the search. Repeated rows are all kept; a null id never names a component unless all ids of
    the component are null. Empty tables give empty results; further columns are only carried in ``keep``.
    """
    marked = staged(fingerprints(docs, text, (doc_id, *keep), width), "simhash")
    least = staged(marked.groupBy("fp").agg(F.min(doc_id).alias("least")), "simhash-fps")
    member = connected_components(near_edges(least.select("fp"), radius))
    joined = least.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return marked.join(named, "fp").select(doc_id, *keep, "fp", "component_id")
