"""Hard negatives by branch-and-bound over ball trees: one tree a tile of rows, bounds on inner products from both sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.decontaminate import bounded
from keepsake.llm.staging import release, staged
from keepsake.llm.vectors import matrix, sorted_runs, usable

LONG = np.iinfo(np.int64)
#: Rows that a slice of tiles has at most, whatever the table's size: the work of one task for one block of anchors.
SLICE = 1 << 18
#: Candidates that are gathered before they are ranked and tighten the bounds.
BUFFER = 50_000


@dataclass
class BallTree:
    """Rows ``order[start:end]`` of each node lie within ``radius`` of its ``center``; leaves have no children (-1)."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    children: np.ndarray
    center: np.ndarray
    radius: np.ndarray


def ball_tree(x: np.ndarray, leaf: int = 64) -> BallTree:
    """Halve the rows along the direction in which they spread most, until ``leaf`` are left."""
    order, todo = np.arange(len(x)), [(0, len(x), -1, 0)]
    spans, children, centers, radii = [], [], [], []
    while todo:
        start, end, parent, side = todo.pop()
        node, own = len(spans), x[order[start:end]]
        center = own.mean(axis=0)
        spans.append((start, end))
        children.append([-1, -1])
        centers.append(center)
        radii.append(float(np.sqrt(((own - center) ** 2).sum(axis=1).max())))
        if parent >= 0:
            children[parent][side] = node
        if end - start > leaf:
            along = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(along, half)]
            todo += [(start, start + half, node, 0), (start + half, end, node, 1)]
    start, end = np.array(spans).T
    return BallTree(order, start, end, np.array(children), np.stack(centers), np.array(radii))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs; those beyond a long are held at its ends."""
    if len(a) and len(b) and a.shape[1] * np.abs(a).max() * np.abs(b).max() >= 2.0**53:
        whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
        return np.clip(whole(a) @ whole(b).T, LONG.min, LONG.max).astype(np.int64)
    return (a @ b.T).astype(np.int64)


class Search:
    """A block of anchors looking for their best ``k`` rows under every query; what is found so far bounds what follows.

    The anchors' tiles come one by one; the kth score of a query carries over from tree to tree.
    """

    def __init__(self, anchors: pa.Table, size: int, k: int, queries: int) -> None:
        self.rows, self.ids, labels = (anchors.column(c).to_pylist() for c in ("row", "vec_id", "label"))
        self.id_array = np.array(self.ids, dtype=np.int64)
        self.code = {label: n for n, label in enumerate(dict.fromkeys(labels))}
        self.label = np.array([self.code[x] for x in labels], dtype=np.int64)
        self.x, self.k, self.n_queries = matrix(anchors.column("q"), size), k, len(labels) * queries
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        self.found = (np.zeros(0, np.int64),) * 3  # query, score, id: at most k of each query, best first
        self.kth = np.full(self.n_queries, LONG.min)
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def offer(self, query: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if len(query):
            self.waiting.append((query, score, other))
            if sum(len(w[0]) for w in self.waiting) >= BUFFER:
                self.settle()

    def settle(self) -> None:
        """Rank what was offered: higher scores first, ties to smaller ids."""
        if not self.waiting:
            return
        query, score, other = (np.concatenate(c) for c in zip(self.found, *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((other, ~score, query))
        query, score, other = query[order], score[order], other[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = place < self.k
        self.found = (query[keep], score[keep], other[keep])
        last = place == self.k - 1
        self.kth[query[last]] = score[last]

    def walk(self, x: np.ndarray, look: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Descend the tree of ``x`` with all anchors at once; a node is left by those whose window or kth score its bounds miss."""
        tree = ball_tree(x)
        middle, reach = self.x @ tree.center.T, self.norm[:, None] * tree.radius[None, :]
        slack = 1e-9 * (self.norm[:, None] * np.sqrt((tree.center**2).sum(axis=1))[None, :] + reach) + 1e-6
        upper, lower = middle + reach + slack, middle - reach - slack
        todo = [(0, np.arange(len(self.x)))]
        while todo:
            node, active = todo.pop()
            least, most = self.window()
            active = active[(upper[active, node] >= least[active]) & (lower[active, node] <= most[active])]
            if not len(active):
                continue
            left, right = tree.children[node]
            if left < 0:
                look(active, tree.order[tree.start[node] : tree.end[node]])
            else:  # the nearer child last, so it is looked at first
                todo += [(n, active) for n in sorted((left, right), key=lambda n: middle[active, n].sum())]
        self.settle()

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        """The scores that can still matter to each anchor, from and to."""
        raise NotImplementedError

    def look_at(self, tile: pa.Table, size: int) -> None:
        """Search one tile of rows."""
        raise NotImplementedError


class Positives(Search):
    """The best rows of the anchor's own label."""

    def __init__(self, anchors: pa.Table, size: int, k: int) -> None:
        super().__init__(anchors, size, k, 1)

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        return self.kth.astype(np.float64), np.full(len(self.x), np.inf)

    def look_at(self, tile: pa.Table, size: int) -> None:
        label = np.array([self.code.get(x, -1) for x in tile.column("label").to_pylist()], dtype=np.int64)
        own = np.flatnonzero(label >= 0)
        if not len(own):
            return
        x, label, ids = matrix(tile.column("q"), size)[own], label[own], tile.column("vec_id").to_numpy()[own]

        def look(active: np.ndarray, rows: np.ndarray) -> None:
            score = products(self.x[active], x[rows])
            hit = (self.label[active][:, None] == label[rows]) & (self.id_array[active][:, None] != ids[rows]) & (score >= self.kth[active][:, None])
            i, j = np.nonzero(hit)
            self.offer(active[i], score[i, j], ids[rows][j])

        self.walk(x, look)

    def results(self) -> pa.RecordBatch:
        anchor, score, other = self.found
        return pa.RecordBatch.from_arrays([pa.array([self.rows[a] for a in anchor], pa.int64()), pa.array(other), pa.array(score)], names=["row", "id", "score"])


class Negatives(Search):
    """For every positive the best rows of other labels within its window of scores."""

    def __init__(self, anchors: pa.Table, size: int, k: int, low: int, high: int) -> None:
        positives = anchors.column("positives").to_pylist()
        self.slots = max((len(p) for p in positives), default=0)
        super().__init__(anchors, size, k, self.slots)
        self.positive = [[(p["id"], p["score"]) for p in own] for own in positives]
        held = lambda v: max(LONG.min, min(LONG.max, v))
        bounds = [[(held(-(-low * s // 100)), held(high * s // 100)) for _, s in own] + [(LONG.max, LONG.min)] * (self.slots - len(own)) for own in self.positive]
        self.low, self.high = np.array(bounds, dtype=np.int64).reshape(-1, self.slots, 2).transpose(2, 0, 1)
        self.open = self.low <= self.high

    def needed(self) -> np.ndarray:
        """The least score that each of an anchor's windows still takes."""
        return np.maximum(self.low, self.kth.reshape(self.low.shape))

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        least = np.where(self.open, self.needed().astype(np.float64), np.inf).min(axis=1, initial=np.inf)
        return least, np.where(self.open, self.high.astype(np.float64), -np.inf).max(axis=1, initial=-np.inf)

    def look_at(self, tile: pa.Table, size: int) -> None:
        label = np.array([self.code.get(x, -1) for x in tile.column("label").to_pylist()], dtype=np.int64)
        x, ids = matrix(tile.column("q"), size), tile.column("vec_id").to_numpy()

        def look(active: np.ndarray, rows: np.ndarray) -> None:
            score = products(self.x[active], x[rows])
            other = self.label[active][:, None] != label[rows]
            least, needed = self.window()[0][active], self.needed()
            i, j = np.nonzero(other & (score >= least[:, None]))  # few are left for the windows, one by one
            s, a = score[i, j], active[i]
            for slot in range(self.slots):
                hit = np.flatnonzero(self.open[a, slot] & (s >= needed[a, slot]) & (s <= self.high[a, slot]))
                self.offer(a[hit] * self.slots + slot, s[hit], ids[rows][j[hit]])

        self.walk(x, look)

    def results(self) -> pa.RecordBatch:
        query, score, other = self.found
        anchor, slot = query // max(self.slots, 1), query % max(self.slots, 1)
        told = [self.positive[a][s] for a, s in zip(anchor, slot, strict=True)]
        columns = [pa.array([self.rows[a] for a in anchor], pa.int64()), pa.array([self.ids[a] for a in anchor], pa.int64()), pa.array(slot.astype(np.int32)), pa.array([p[0] for p in told], pa.int64()), pa.array([p[1] for p in told], pa.int64()), pa.array(other), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "anchor_id", "slot", "positive_id", "positive_score", "negative_id", "negative_score"])


KEYS = ["slice", "block", "kind", "bucket", "part", "size"]


def searched(anchors: DataFrame, rows: DataFrame, start: Callable[[pa.Table, int], Search], schema: str) -> DataFrame:
    """Every (slice, block) in one task: the block's anchors first, then the slice's tiles, one held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, searches = None, {}
        for key, table in sorted_runs(batches, len(KEYS)):
            if key[:2] != at:
                yield from (s.results() for s in searches.values())
                at, searches = key[:2], {}
            if key[2] == 0:
                searches[key[5]] = start(table, key[5])
            elif key[5] in searches:
                searches[key[5]].look_at(table, key[5])
        yield from (s.results() for s in searches.values())

    both = anchors.unionByName(rows, allowMissingColumns=True)
    return both.repartition("slice", "block").sortWithinPartitions(*KEYS).select(*KEYS, *[c for c in both.columns if c not in KEYS]).mapInArrow(run, schema)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, tile: int = 1024, block: int = 4096, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """For every anchor and each of its best rows of the same label, the best rows of other labels whose score is between ``low`` and ``high`` percent of the positive's.

    Components become floor(256 x); a score is the whole inner product with the anchor; higher scores come
    first, ties go to smaller ids. ``anchors`` is a condition on ``vectors``. Rows with a null id or label, or
    a vector that is null, empty or not finite throughout, take no part; vectors of another length have no
    score with each other. An anchor is never its own positive: rows with its id are left out there. Repeated
    anchors each get their rows. Other columns are only read by ``anchors``. Empty tables give empty results.

    Rows are dealt by label into tiles of about ``tile``, a frequent label into many; each tile is a ball tree
    in the task that reads it. Anchors go in blocks to every slice of tiles (for positives: of their label's),
    so neither a label nor the anchors are ever in one task, and no pair leaves a task but the best of each
    (anchor, positive). The search is exact: a node is left only when its bounds miss the window or lie
    strictly beneath the kth score.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    quantised = F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).cast(kind)
    good = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    rows = staged(good.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), quantised.alias("q"), F.size(vector).alias("size"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")
    n, n_anchors = rows.count(), rows.where("anchor").count()
    bucket = F.pmod(F.xxhash64("label", "size"), F.lit(max(1, -(-n // tile)))).cast("int")
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"), F.ceil(F.count_if("anchor") / block).cast("int").alias("blocks"))
    sizes = staged(sizes, "buckets")
    placed = rows.withColumn("bucket", bucket).join(bounded(sizes, 1_000_000), "bucket").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts").cast("long")).cast("int"))
    tiles_a_slice = max(1, SLICE // tile)
    upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    zero = lambda kind: F.lit(0).cast(kind)
    dealt = lambda b: F.pmod(F.xxhash64("row", F.lit(1)), b.cast("long")).cast("int")
    own = ["row", "vec_id", "label", "q"]

    slice_of = lambda k: F.col("bucket").cast("long") * 1_000_000 + k
    theirs = placed.where("anchor").withColumn("_k", upto(F.ceil(F.col("parts") / tiles_a_slice).cast("int"))).select(slice_of(F.col("_k")).alias("slice"), dealt(F.col("blocks")).alias("block"), zero("byte").alias("kind"), "bucket", F.lit(-1).alias("part"), "size", *own)
    tiles = placed.where("blocks > 0").withColumn("block", upto(F.col("blocks"))).select(slice_of(F.floor(F.col("part") / tiles_a_slice)).alias("slice"), "block", F.lit(1).cast("byte").alias("kind"), "bucket", "part", "size", *own)
    near = searched(theirs, tiles, lambda t, size: Positives(t, size, positives), "row long, id long, score long")
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))).where(F.col("place") <= positives)
    chosen = staged(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives")), "positives")

    blocks, n_tiles = max(1, -(-n_anchors // block)), sizes.agg(F.sum("parts")).first()[0] or 1
    slices = min(n_tiles, max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // SLICE)))
    theirs = placed.where("anchor").join(chosen, "row").withColumn("slice", upto(F.lit(slices))).select(F.col("slice").cast("long").alias("slice"), dealt(F.lit(blocks)).alias("block"), zero("byte").alias("kind"), F.lit(-1).alias("bucket"), F.lit(-1).alias("part"), "size", *own, "positives")
    tiles = placed.withColumn("block", upto(F.lit(blocks))).select(F.pmod(F.xxhash64("bucket", "part"), F.lit(slices)).alias("slice"), "block", F.lit(1).cast("byte").alias("kind"), "bucket", "part", "size", *own)
    hard = searched(theirs, tiles, lambda t, size: Negatives(t, size, negatives, low, high), "row long, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= negatives)
    found = staged(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    release(rows, sizes, chosen)
    return found
