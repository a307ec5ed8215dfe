"""Near-duplicates by shingle similarity: SimHash links first, then every other pair at the similarity; all verified."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.components import connected_components
from keepsake.llm.decontaminate import bounded
from keepsake.llm.simhash import majority, near_edges
from keepsake.llm.staging import arrow_rows, by_bytes, release, staged
from keepsake.llm.substrings import Words, mix

#: Words of 64 bits in a sketch.
SKETCH = 16


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased; a shorter text is one run."""
    w = Words((text or "").encode().lower().decode())
    first = np.arange(max(w.n - width + 1, min(w.n, 1)))
    return np.unique(w.runs(first, np.minimum(first + width, w.n)))


def set_hash(s: np.ndarray) -> int:
    """One signed number for a whole set; equal sets have equal numbers."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set: bit k tells whether an odd number of items falls on it.

    Common items of two sets cancel out, so their sketches differ in at most as many bits as the sets have
    items that are not common: a bound that no pair breaks, unlike SimHash's estimate.
    """
    odd = np.bincount((mix(s) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(s: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The first items of a set in an order common to all sets: of two sets at the similarity, these have one in common.

    Such sets have at least ``similarity`` of either's items in common, so the rest of one can't hold them
    all. The order is by hash, with the items in ``hot`` (sorted) last; any ``hot`` gives the same pairs, a
    good one spares the comparison of all that share a common line.
    """
    n, share = len(s), Fraction(str(similarity))
    k = n - -(-n * share.numerator // share.denominator) + 1 if n else 0
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        late = hot[at] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:k]


def _hot(docs: DataFrame, width: int, similarity: float, above: int, most: int) -> np.ndarray:
    """The items that more than ``above`` prefixes have, the ``most`` frequent at most; counted in Spark over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for b in by_bytes(batches, (0,)):
            items = np.concatenate([none, *[prefix(shingles(t, width), similarity, none) for t in b.column(0).to_pylist()]])
            item, n = np.unique(items, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(item.view(np.int64)), pa.array(n)], names=["key", "n"])

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > above).orderBy(F.desc("n"), "key").limit(most).select("key").toPandas()
    return np.sort(found["key"].to_numpy(dtype=np.int64).view(np.uint64))


def _sets(docs: DataFrame, width: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """(doc_id, node, n, fp, sketch, keys) of every document: number, size, SimHash, sketch and prefix of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, (1,)):
            found = [shingles(t, width) for t in b.column(1).to_pylist()]
            fps = np.array([majority(s) for s in found], dtype=np.uint64).view(np.int64)
            keys = lists([prefix(s, similarity, shared.value).view(np.int64) for s in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_hash(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(fps), lists([sketch(s) for s in found]), keys], names=names)

    names = ["doc_id", "node", "n", "fp", "sketch", "keys"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, node long, n long, fp long, sketch array<bigint>, keys array<bigint>")


def _may(a: list[Column], b: list[Column], n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m items with these sketches may have the similarity."""
    share = Fraction(str(similarity))
    differ = sum((F.bit_count(x.bitwiseXOR(y)).cast("long") for x, y in zip(a, b, strict=True)), F.lit(0).cast("long"))
    sizes = F.least(n, m) * share.denominator >= F.greatest(n, m) * share.numerator
    return sizes & (differ * (share.denominator + share.numerator) <= (n + m) * (share.denominator - share.numerator))


def wide_sketch(s: np.ndarray) -> bytes:
    """As ``sketch``, with at least as many bits as the set has items: a power of two, so a wider one folds into a narrower."""
    bits = max(64 * SKETCH, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ: no more than the items that the sets don't have in common."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose sets have the similarity: most others fall to their sketches, the rest are counted."""
    share = Fraction(str(similarity))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, (1,)):
            found = [shingles(t, width) for t in b.column(1).to_pylist()]
            own = [set_hash(s) == node for s, node in zip(found, b.column(0).to_pylist(), strict=True)]  # an id may have several texts
            wide, items = (pa.array(x, pa.binary()) for x in ([wide_sketch(s) for s in found], [s.tobytes() for s in found]))
            yield pa.RecordBatch.from_arrays([b.column(0), wide, items], names=["node", "wide", "items"]).filter(pa.array(own, pa.bool_()))

    def bounded_difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, (3, 4)):
            stay = [least_difference(x, y) * (share.denominator + share.numerator) <= total * (share.denominator - share.numerator) for total, x, y in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["src", "dst"]).filter(pa.array(stay, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, (2, 3)):
            stay = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                stay.append(both * share.denominator >= share.numerator * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["src", "dst"]).filter(pa.array(stay, pa.bool_()))

    parts = lambda side: [F.get(F.col(f"{side}_sketch"), F.lit(k)) for k in range(SKETCH)]
    for side in ("src", "dst"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), side)
    near = staged(pairs.where(_may(parts("src"), parts("dst"), F.col("src_n"), F.col("dst_n"), similarity)).select("src", "dst", (F.col("src_n") + F.col("dst_n")).alias("total")), "alike-near")
    wanted = near.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    owners = staged(nodes.join(wanted, "node").select("doc_id", "node"), "alike-owners")
    sets = staged(docs.join(bounded(owners, 1_000_000), "doc_id").select("node", "text").mapInArrow(read, "node long, wide binary, items binary"), "alike-sets")

    def brought(found: DataFrame, column: str) -> DataFrame:
        """The pairs are short: they go to the sets, and of each pair's two sets one is sent to the other."""
        a, b = (sets.select(F.col("node").alias(c), F.col(column).alias(f"{c}_x")) for c in ("src", "dst"))
        return a.join(bounded(found, 1_000_000), "src").join(b, "dst")

    nearer = staged(brought(near, "wide").select("src", "dst", "total", "src_x", "dst_x").mapInArrow(bounded_difference, "src long, dst long"), "alike-nearer")
    edges = staged(brought(nearer, "items").select("src", "dst", "src_x", "dst_x").mapInArrow(compare, "src long, dst long"), "alike-edges")
    release(near, owners, nearer, sets)
    return edges


def _simhash_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(src, dst) of the sets whose SimHashes are within the radius: spanning links, found bit-sliced."""
    of = staged(nodes.groupBy("fp").agg(F.min("node").alias("first")), "alike-fps")
    same = nodes.join(of, "fp").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    near = near_edges(of.select("fp"), radius)
    for side in ("src", "dst"):
        near = near.join(of.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node")), side)
    return same.unionByName(near.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")))


def _across(shared: DataFrame, member: DataFrame, nodes: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(src, dst) of the sets of two components that meet and may have the similarity.

    Sets meet under the ends (lo, hi) of an item, not under the item: near copies share hundreds of items, but
    the items of a group have few different ends between them. Ends are two minima of hashes of those that have
    the item, so items of other groups seldom come under the same. More than ``tile`` sets that meet are cut
    into parts, and each pair of parts is compared by itself.
    """
    named = shared.join(member, "node", "left").select("node", "lo", "hi", F.coalesce("component", "node").alias("c"))
    mixed = named.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    met = named.join(mixed.select("lo", "hi", F.ceil(F.col("m") / tile).alias("parts")), ["lo", "hi"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), "parts"))
    tiles = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("byte")
    dealt = tiles.select("node", "c", side.alias("side"), F.xxhash64("lo", "hi", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
    words = [F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]
    left = staged(dealt.join(nodes.select("node", "n", *words), "node"), "alike-left")
    a, b = left.alias("a"), left.alias("b")
    of = lambda at: [F.col(f"{at}.s{k}") for k in range(SKETCH)]
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.side") + F.col("b.side")).isin(0, 3)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & _may(of("a"), of("b"), F.col("a.n"), F.col("b.n"), similarity))
    found = staged(pairs.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct(), "alike-across")
    release(left)
    return found


def alike_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4, hot_above: int = 32, hot_most: int = 100_000, tile: int = 2048) -> DataFrame:
    """(doc_id, component_id): the least id reachable over pairs whose shingle sets have the similarity.

    SimHash within ``radius`` bits, compared bit-sliced, offers the closest copies; the others meet under a
    common item of their prefixes (``prefix``), where every alike pair meets. Under such an item all are first
    compared with two of them; only where several components are left, pairs across components follow: they
    are formed and dropped inside a join by a bound on their difference (``sketch``), so few are ever rows.
    That join looks once or a few times at a pair, however many items it shares, and takes ``tile`` sets with
    as many others at a time.
    No pair is linked without its whole sets being compared, none at the similarity is left out. Equal sets
    are one node. Items that more than ``hot_above`` prefixes have come last in the order of all prefixes (at
    most ``hot_most`` of them, which bounds what the driver sees; the groups do not depend on either).

    Texts without words are alike. Null ids are left out. Rows that repeat an id are all kept, each in the
    group of its own text.
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")
    with arrow_rows(docs.sparkSession, 500):
        return _groups(known, width, similarity, radius, hot_above, hot_most, tile)


def _groups(known: DataFrame, width: int, similarity: float, radius: int, hot_above: int, hot_most: int, tile: int) -> DataFrame:
    sets = staged(_sets(known, width, similarity, _hot(known, width, similarity, hot_above, hot_most)), "alike")
    nodes = staged(sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("sketch").alias("sketch")), "alike-nodes")
    keyed = sets.select("node", F.explode("keys").alias("key"))
    ends = staged(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "alike-ends")
    shared = staged(keyed.join(bounded(ends, 1_000_000), "key").select("node", "lo", "hi").distinct(), "alike-meet")
    stars = shared.select(F.explode(F.array(F.struct("lo", "node"), F.struct(F.col("node").alias("lo"), F.col("hi").alias("node")))).alias("e")).select(F.col("e.lo").alias("src"), F.col("e.node").alias("dst"))
    first = staged(stars.unionByName(_simhash_pairs(nodes, radius)).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "alike-first")
    edges = _verified(first, known, nodes, width, similarity)
    member = staged(connected_components(edges), "alike-components")

    across = _across(shared, member, nodes, similarity, tile)
    release(ends, first)
    more = _verified(across, known, nodes, width, similarity)

    member = connected_components(edges.unionByName(more))
    joined = nodes.select("node", "doc_id").join(member, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    group = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return sets.select("doc_id", "node").join(joined.join(group, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
