"""Embedding near-duplicates: a subspace pigeonhole join of rotated vectors, exact in what it links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.components import connected_components
from keepsake.llm.simhash import roots
from keepsake.llm.staging import release, staged
from keepsake.llm.vectors import matrix, sorted_runs, usable

#: Decisions closer than this to a bound are taken by sums that don't depend on how rows lie in a matrix.
NEAR = 1e-9
#: What single precision may add to or take from the squared distance of two unit vectors' blocks, and more.
ROUGH = 1e-5
SEED = 2024
#: Grid cells have at least this width, so a coordinate's cell takes seven bits.
LEAST_CELL = 1 / 60
#: Rows of one matrix product, on either side.
STRIP, LENGTH = 256, 4096


def row_sums(a: np.ndarray) -> np.ndarray:
    """The sum of each row, by halves: the same for the same row wherever it stands, as no matrix product promises."""
    while a.shape[1] > 1:
        half = a.shape[1] // 2
        a = np.concatenate([a[:, :half] + a[:, half : 2 * half], a[:, 2 * half :]], axis=1)
    return a[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(row_sums(x * x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y, in double precision, from components scaled by powers of two."""
    x, y = (m * np.exp2(-np.floor(np.log2(np.abs(m).max(axis=1, keepdims=True)))) for m in (x, y))
    return row_sums(x * y) / (np.sqrt(row_sums(x * x)) * np.sqrt(row_sums(y * y)))


def rotate(u: np.ndarray) -> np.ndarray:
    """Rows turned by a fixed random rotation, filled with zeros to a power of two: signs and a Hadamard transform, twice.

    It spreads every direction over all coordinates, so that blocks of them have like shares of a distance.
    Sums and differences only: a row's result does not depend on the rows around it.
    """
    n, size = u.shape
    wide = 1 << max(0, size - 1).bit_length()
    a = np.zeros((n, wide))
    a[:, :size] = u
    for signs in np.random.default_rng(SEED).choice([-1.0, 1.0], (2, wide)):
        a, h = a * signs, 1
        while h < wide:
            pairs = a.reshape(n, wide // (2 * h), 2, h)
            a = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
            h *= 2
        a = a / sqrt(wide)
    return a


class Blocks:
    """How vectors of one length are split: blocks of up to ``width`` rotated coordinates, each with its share of the squared distance.

    Two unit vectors with a cosine of ``similarity`` are sqrt(2 - 2 similarity) apart at most; if every block
    had more than its share of that square, so had the whole. So such a pair is within the share in a block.
    """

    def __init__(self, size: int, similarity: float, width: int, n: int, tile: int) -> None:
        self.wide = 1 << max(0, size - 1).bit_length()
        self.width = min(1 << max(1, width).bit_length() - 1, self.wide)  # a power of two, so the blocks have all coordinates
        self.count = self.wide // self.width
        self.budget = max(0.0, 2 - 2 * similarity) * self.width / self.wide + NEAR
        self.radius = sqrt(self.budget)
        self.cell = max(2 * self.radius, LEAST_CELL)
        # as many grid coordinates as make cells of about a tile with their guests; more copies of a row, fewer pairs
        per = max(1.5, 4 / (self.cell * sqrt(self.wide)))
        self.grid = min(self.width, 6, max(1, round(log(max(1, 4 * n / tile)) / log(per))))

    def of(self, rotated: np.ndarray, block: int) -> np.ndarray:
        return rotated[:, block * self.width : (block + 1) * self.width]

    def cells(self, rotated: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, cells, home): every row's own cell, then the lower neighbours that its ball touches.

        Of two rows in different cells, the one in the higher cell is a guest in the lower: they meet once.
        """
        at = self.of(rotated, block)[:, : self.grid]
        own = np.floor(at / self.cell).astype(np.int64)
        below, above = at - own * self.cell, (own + 1) * self.cell - at
        yield np.arange(len(at)), self.pack(own), True
        for offset in product((-1, 0, 1), repeat=self.grid):
            if next((o for o in offset if o), 1) > 0:
                continue
            gap = sum(((below if o < 0 else above)[:, k] ** 2 for k, o in enumerate(offset) if o), np.zeros(len(at)))
            rows = np.flatnonzero(gap <= self.budget + NEAR)
            if len(rows):
                yield rows, self.pack(own[rows] + np.array(offset)), False

    @staticmethod
    def pack(cell: np.ndarray) -> np.ndarray:
        code = np.zeros(len(cell), dtype=np.int64)
        for k in range(cell.shape[1]):
            code = code << 7 | (cell[:, k] + 64)
        return code

    def shares(self, d: np.ndarray) -> np.ndarray:
        """Squared length of each block of each row of differences."""
        square = (d * d).reshape(len(d) * self.count, self.width)
        return row_sums(square).reshape(len(d), self.count)


class Tile:
    """The rows of a grid cell, or of two of its parts, compared in one block of coordinates."""

    def __init__(self, rows: pa.Table, size: int, blocks: Blocks, block: int, similarity: float) -> None:
        self.node, self.copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        self.home, self.side = rows.column("home").to_numpy(), rows.column("side").to_numpy()
        self.x, self.blocks, self.block, self.similarity = matrix(rows.column("v"), size), blocks, block, similarity
        self.unit = unit(self.x)
        self.rotated = rotate(self.unit)
        self.links, self.label = np.zeros(len(self.node), dtype=np.int64), np.arange(len(self.node))

    def compare(self) -> pa.RecordBatch:
        """(node, links, root) of the rows with links that this block is the first to find: how many, and a row they hang together with."""
        homes, guests = ([np.flatnonzero((self.home == h) & (self.side != s)) for s in (2, 1)] for h in (True, False))
        if (self.side > 0).any():
            pairs = [(homes[0], homes[1]), (homes[0], guests[1]), (guests[0], homes[1])]
        else:
            pairs = [(homes[0], homes[0]), (homes[0], guests[0])]  # two guests meet at home
        for p, q in pairs:
            self.strips(p, q, p is q)
        hit = np.flatnonzero(self.links)
        return pa.RecordBatch.from_arrays([pa.array(self.node[hit]), pa.array(self.links[hit]), pa.array(self.node[self.label[hit]])], names=["node", "links", "root"])

    def strips(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """Strips of p, in the order of a coordinate that is not in the grid, against the stretch of q within reach there."""
        own = self.blocks.of(self.rotated, self.block)
        along = own[:, min(self.blocks.grid, self.blocks.width - 1)]
        p, q = p[np.argsort(along[p], kind="stable")], q[np.argsort(along[q], kind="stable")]
        reach, at = self.blocks.radius + ROUGH, along[q]
        one, square = np.ones((len(own), 1)), (own * own).sum(axis=1, keepdims=True)
        left, right = np.hstack([own, square, one]).astype(np.float32)[p], np.hstack([-2 * own, one, square]).astype(np.float32)[q]
        for start in range(0, len(p), STRIP):
            i = p[start : start + STRIP]
            first, last = np.searchsorted(at, along[i[0]] - reach), np.searchsorted(at, along[i[-1]] + reach, side="right")
            for begin in range(max(first, start) if same else first, last, LENGTH):
                end = min(begin + LENGTH, last)
                near = left[start : start + STRIP] @ right[begin:end].T <= self.blocks.budget + ROUGH
                if same and begin < start + STRIP:
                    near &= np.arange(start, start + len(i))[:, None] < np.arange(begin, end)[None, :]
                if near.any():
                    self.settle(i, q[begin:end], near)

    def settle(self, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> None:
        """Link the pairs in ``near`` that are alike, and whose first block within its share is this one."""
        limit = self.blocks.budget
        sure = None
        if np.count_nonzero(near) > near.size // 16:  # many: settle them by matrix products, but for those close to a bound
            near &= (cos := self.unit[i] @ self.unit[j].T) >= self.similarity - NEAR
            apart = self.apart(i, j, self.block)
            near &= apart <= limit + NEAR
            sure = near & (cos > self.similarity + NEAR) & (apart < limit - NEAR)
            for earlier in range(self.block):
                if not near.any():
                    return
                apart = self.apart(i, j, earlier)
                near &= apart >= limit - NEAR
                sure &= apart > limit + NEAR
            near &= ~sure
        a, b = np.nonzero(near)
        for at in range(0, len(a), STRIP * LENGTH // 16):
            p, q = i[a[at : at + STRIP * LENGTH // 16]], j[b[at : at + STRIP * LENGTH // 16]]
            within = self.blocks.shares(self.rotated[p] - self.rotated[q]) <= limit
            first = within[:, self.block] & ~within[:, : self.block].any(axis=1)
            p, q = p[first], q[first]
            linked = cosines(self.x[p], self.x[q]) >= self.similarity
            self.link(p[linked], q[linked])
        if sure is not None:
            a, b = np.nonzero(sure)
            self.link(i[a], j[b])

    def apart(self, i: np.ndarray, j: np.ndarray, block: int) -> np.ndarray:
        """Squared distances in a block, by one product of lengthened rows."""
        a, b = (self.blocks.of(self.rotated, block)[k] for k in (i, j))
        one = lambda m: np.ones((len(m), 1))
        square = lambda m: (m * m).sum(axis=1, keepdims=True)
        return np.hstack([a, square(a), one(a)]) @ np.hstack([-2 * b, one(b), square(b)]).T

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        self.links += np.bincount(p, self.copies[q], len(self.links)).astype(np.int64) + np.bincount(q, self.copies[p], len(self.links)).astype(np.int64)
        p, q = self.label[p], self.label[q]
        apart = p != q
        if apart.any():
            self.label = roots(len(self.label), p[apart], q[apart])[self.label]


def near_links(classes: DataFrame, similarity: float, width: int, tile: int) -> DataFrame:
    """(node, links, root) parts of what every vector of ``classes`` (node, v, size, copies) is linked to; the sum of links counts each pair once."""
    n = classes.count()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                own = pa.Table.from_batches([b.filter(pa.array(sizes == size))])
                split, rotated = Blocks(size, similarity, width, n, tile), rotate(unit(matrix(own.column(1), size)))
                node = own.column(0).to_numpy()
                for block in range(split.count):
                    for rows, cells, home in split.cells(rotated, block):
                        whole = lambda v: pa.array(np.full(len(rows), v))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array(node[rows]), whole(np.int32(size)), whole(np.int32(block)), pa.array(cells), whole(home)], names=["node", "size", "block", "cell", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, block, *_), rows in sorted_runs(batches, 5):
            yield Tile(rows, size, Blocks(size, similarity, width, n, tile), block, similarity).compare()

    keyed = classes.select("node", "v", "size").mapInArrow(keys, "node long, size int, block int, cell long, home boolean")
    cell = ["size", "block", "cell"]
    full = keyed.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0").select(*cell, F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    placed = keyed.join(staged(full, "cells"), cell).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    tiles = placed.withColumn("other", other).select("node", *cell, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), side.cast("byte").alias("side"), "home")
    rows = tiles.join(classes.select("node", "v", "copies"), "node")
    dealt = rows.repartition(*cell, "lo", "hi").sortWithinPartitions(*cell, "lo", "hi").select(*cell, "lo", "hi", "side", "home", "node", "copies", "v")
    return dealt.mapInArrow(compare, "node long, links long, root long")


def embedding_groups(vectors: DataFrame, similarity: float = 0.95, width: int = 8, tile: int = 32_768, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row with the number of others it is linked to (cosine of ``similarity`` or more) and its component.

    Vectors are turned by a fixed rotation and cut into blocks of ``width`` coordinates. In each block, rows
    within its share of the squared distance meet in grid cells; a cell of more than ``tile`` rows is cut into
    parts, and each pair of parts is a task's work. Inside, strips of rows meet the stretch of rows that one
    more coordinate leaves them. What is left is verified by the whole vectors' cosine in double precision, each pair in
    the first block that has it, so the union of the blocks counts no pair twice. No pair is ever a row: a
    tile gives counts and one edge a member. Equal vectors are one row of the search, as often as they are.
    ``width`` and ``tile`` change cost alone.

    Vectors that are null, empty, zero or not finite throughout, and rows with a null id, link with nothing
    and are their own component (of a null id: null, not kept); so do vectors of different lengths with each
    other. Rows that repeat an id are rows of their own, with that id. Empty tables give empty results; other
    columns are not read.

    Returns id, n_links, component_id (the least id reachable, its own included), kept (id = component_id).
    """
    zero = ~F.exists(F.col(vector), lambda x: x.cast("double") != 0)
    fit = F.col(vec_id).isNotNull() & usable(F.col(vector)) & ~F.coalesce(zero, F.lit(True))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), fit.alias("fit"))
    good = rows.where("fit").select("id", "v")
    classes = staged(good.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("least")).select(F.monotonically_increasing_id().alias("node"), "v", F.size("v").alias("size"), "copies", "least"), "vectors")
    found = staged(near_links(classes, similarity, width, tile), "links")
    edges = found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct()
    member = connected_components(edges)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "v", "copies", "least").join(linked, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.select("node", "least").join(member, "node").groupBy("component").agg(F.min("least").alias("low"))
    named = staged(joined.join(least, "component", "left").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "least").alias("component_id")), "named")
    release(found)
    told = good.join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("fit")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return told.unionByName(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
