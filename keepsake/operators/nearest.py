"""Pairs of similar vectors: an exact join that leaves out what the triangle inequality rules out, and a search by signatures."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.session import checkpointed

#: Pivots at most: what every row's angles are taken to, and what the driver sees of the table.
PIVOTS = 64
#: Rows of a cell at least and at most, where none are asked for, and the bytes of vectors a cell holds at most.
BLOCK, LARGEST, CELL_BYTES = 2048, 32_768, 64 << 20
#: Bits of a signature that are compared before whole vectors are.
SKETCH = 256


def _unit(rows: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of length one."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in rows.to_pylist()])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: neither null, empty, zero, nor with a component that is null or no number."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vectors.where((F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))


def celled(vectors: DataFrame, block: int | None = None, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): every row with its cell, and each cell's size, parts and bounds.

    Some rows are pivots, about one for each ``block`` rows and ``pivots`` at most. A row belongs to the pivot
    at the least angle, and there to one of as many rings as make cells of about a block; what a cell has
    beyond a block is cut into parts. A cell's bounds are the least and greatest angle of its rows to each
    pivot. The cells number ``pivots`` times as many rings as the densest pivot needs. Where all rows are one
    block there is nothing to leave out: a cell for each length, without bounds.

    Every row is sent to all cells its own may meet, so without ``block`` the cells grow with the table, to a
    64th of it: what is sent then grows as the table does, until cells are the largest that a task should hold.
    """
    own = _usable(vectors)
    n, wide = own.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = block or max(BLOCK, min(-(-n // 64), LARGEST, CELL_BYTES // (8 * wide)))
    if n <= block:
        rows = own.select("id", "v", "least", F.struct(F.size("v").alias("size"), F.lit(0).alias("pivot"), F.lit(0).alias("ring")).alias("cell"))
        none = F.array().cast("array<double>")
        return rows, rows.groupBy("cell").agg(F.lit(1).alias("parts"), F.min("least").alias("least")).select("cell", "parts", "least", none.alias("lo"), none.alias("hi"))
    chosen = [(len(r.v), r.v) for r in own.orderBy(F.xxhash64("id"), "id").select("v").limit(min(pivots, max(1, -(-n // block)))).collect()] or [(0, [])]  # at most ``pivots``

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy().astype(np.int64)
            found = np.full((b.num_rows, len(chosen)), np.nan)
            for size in np.unique(sizes):
                rows, to = np.flatnonzero(sizes == size), [k for k, (wide, _) in enumerate(chosen) if wide == size]
                if to:
                    unit = _unit(pa.array([chosen[k][1] for k in to]))
                    found[np.ix_(rows, to)] = np.arccos(np.clip(_unit(b.column(1).take(pa.array(rows))) @ unit.T, -1, 1))
            nearest = np.where(np.isnan(found), np.inf, found).argmin(axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(chosen), dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(nearest), lists], names=["id", "v", "least", "size", "pivot", "angles"])

    kinds = dict(own.dtypes)
    placed = checkpointed(own.select("id", "v", "least").mapInArrow(angles, f"id {kinds['id']}, v {kinds['v']}, least double, size int, pivot int, angles array<double>"))
    near = F.element_at("angles", F.col("pivot") + 1)
    spread = placed.groupBy("size", "pivot").agg(F.min(near).alias("from"), F.max(near).alias("to"), F.ceil(F.count("*") / block).alias("rings"))
    ring = F.when(F.col("to") > F.col("from"), F.least(F.floor((near - F.col("from")) / (F.col("to") - F.col("from")) * F.col("rings")), F.col("rings") - 1)).otherwise(F.lit(0))
    rows = placed.join(F.broadcast(spread), ["size", "pivot"]).withColumn("ring", F.coalesce(ring, F.lit(0)).cast("int")).withColumn("cell", F.struct("size", "pivot", "ring")).select("id", "v", "least", "cell", "angles")
    bounds = [f(F.element_at("angles", k + 1)).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(len(chosen))]
    cells = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("least").alias("least"), *bounds)
    array = lambda name: F.array(*[F.col(f"{name}{k}") for k in range(len(chosen))]).alias(name)
    return rows.select("id", "v", "least", "cell"), checkpointed(cells.select("cell", "parts", "least", array("lo"), array("hi")))


def meeting(cells: DataFrame) -> DataFrame:
    """(a, b, a_parts, b_parts): pairs of cells, a <= b, that may hold a pair of rows similar enough.

    Two rows' angles to a pivot differ by no more than the angle between the rows. So where the bounds of two
    cells to one pivot lie further apart than any pair of theirs may, the cells need not be compared.
    """
    a, b = (cells.select(F.col("cell").alias(x), F.col("parts").alias(f"{x}_parts"), F.col("least").alias(f"{x}_least"), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi")) for x in ("a", "b"))
    widest = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.least("a_least", "b_least")))) + 1e-7
    gap = lambda x, y: F.exists(F.zip_with(f"{x}_lo", f"{y}_hi", lambda lo, hi: lo - hi), lambda g: (g > widest) & ~F.isnan(g))
    apart = gap("a", "b") | gap("b", "a")
    pairs = a.join(b, (F.col("a.size") == F.col("b.size")) & (F.col("a") <= F.col("b")))
    return pairs.where(~F.coalesce(apart, F.lit(False))).select("a", "b", "a_parts", "b_parts")


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j): each the least place of all that are linked; ``label`` is such a labelling before."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, low, high = i[differ], j[differ], np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def similar_pairs(vectors: DataFrame, threshold: float, block: int | None = None, pivots: int = PIVOTS, spanning: bool = False) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with a cosine of at least ``threshold``; exact.

    ``vectors``: id, v (array), and optionally least (a bound of its own; a pair needs the smaller of the two).
    Rows are dealt into cells around pivots (``celled``); only cells that the triangle inequality lets meet are
    compared, part by part, each pair of parts one task-sized matrix product, and only hits leave it. Vectors
    that are null, empty, zero or not finite throughout have no pairs, nor have vectors of different lengths.

    ``spanning``: of each two parts only links (a, b, null) that connect the same rows as their pairs do, fewer
    than rows, for what asks for components alone; such a link need not be a similar pair itself.
    """
    if "least" not in vectors.columns:
        vectors = vectors.withColumn("least", F.lit(float(threshold)))
    kind = dict(vectors.dtypes)["id"]
    rows, cells = celled(vectors.select("id", "v", F.coalesce(F.col("least").cast("double"), F.lit(float(threshold))).alias("least")).where("id is not null"), block, pivots)
    pairs = meeting(cells)
    sides = [pairs.select(F.col("a").alias("cell"), "a", "b", F.col("a_parts").alias("own"), F.col("b_parts").alias("other"), F.lit(0).alias("side")), pairs.where("a <> b").select(F.col("b").alias("cell"), "a", "b", F.col("b_parts").alias("own"), F.col("a_parts").alias("other"), F.lit(1).alias("side"))]
    dealt = rows.join(sides[0].unionByName(sides[1]), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("own").cast("long")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    # within a cell two parts meet once, as (lesser, greater); across cells every part meets every part
    same, low, high = F.col("a") == F.col("b"), F.least("part", "_o"), F.greatest("part", "_o")
    lo = F.when(same, low).when(F.col("side") == 0, F.col("part")).otherwise(F.col("_o"))
    hi = F.when(same, high).when(F.col("side") == 0, F.col("_o")).otherwise(F.col("part"))
    side = F.when(same & (F.col("part") > F.col("_o")), 1).otherwise(F.col("side"))
    tiles = dealt.select("id", "v", "least", "a", "b", lo.alias("lo"), hi.alias("hi"), side.alias("side"))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        alone = tile["a"].iloc[0] == tile["b"].iloc[0] and tile["lo"].iloc[0] == tile["hi"].iloc[0]
        parts = [tile, tile] if alone else [tile[tile["side"] == s] for s in (0, 1)]
        if not all(len(p) for p in parts):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        mats = []
        for p in parts:
            m = np.stack([np.asarray(x, dtype=np.float64) for x in p["v"]])
            mats.append(m / np.linalg.norm(m, axis=1, keepdims=True))
        least, ids = [p["least"].to_numpy() for p in parts], [p["id"].to_numpy() for p in parts]
        shift, label, out = 0 if alone else len(ids[0]), np.arange(len(ids[0]) + (0 if alone else len(ids[1]))), []
        for x in range(0, len(ids[0]), BLOCK):
            for y in range(x if alone else 0, len(ids[1]), BLOCK):
                own, other = slice(x, x + BLOCK), slice(y, y + BLOCK)
                sim = mats[0][own] @ mats[1][other].T
                i, j = np.nonzero(sim >= np.minimum(least[0][own][:, None], least[1][other][None, :]))
                if spanning:
                    label = _united(label, i + x, j + y + shift)
                    continue
                a, b = ids[0][own][i], ids[1][other][j]
                keep = (a < b) | (x < y) & (a != b) if alone else a != b
                out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": sim[i, j][keep]}))
        if not spanning:
            return pd.concat(out)
        every = ids[0] if alone else np.concatenate(ids)
        a, b = every[label], every
        keep = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": np.nan})

    return tiles.groupBy("a", "b", "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}, similarity double")


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands of ``bits`` signs that two vectors need to agree in one with the wanted chance, at the threshold."""
    agree = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - agree))) if agree < 1 else 1


def signatures(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(id, sketch, keys): on which side of random planes each vector lies; ``keys`` by bands of ``bits``, ``sketch`` of planes of its own."""
    planes = bits * bands + SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy().astype(np.int64)
            sketch, keys = np.zeros((b.num_rows, SKETCH // 64), dtype=np.int64), np.zeros((b.num_rows, bands), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                if size not in normals:
                    normals[size] = np.random.default_rng([seed, size]).normal(size=(size, planes))
                rows = np.flatnonzero(sizes == size)
                above = _unit(b.column(1).take(pa.array(rows))) @ normals[size] > 0
                sketch[rows] = np.packbits(above[:, :SKETCH], axis=1, bitorder="little").view("<i8")
                keys[rows] = above[:, SKETCH:].reshape(len(rows), bands, bits) @ weights * 1024 + size % 1024
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel())) for m in (sketch, keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["id", "sketch", "keys"])

    kind = dict(vectors.dtypes)["id"]
    return _usable(vectors).select("id", "v").mapInArrow(run, f"id {kind}, sketch array<bigint>, keys array<bigint>")


def candidate_pairs(vectors: DataFrame, threshold: float, recall: float = 0.95, bits: int = 10, seed: int = 7, exact: bool = False, between: str | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of pairs with a cosine of at least ``threshold``: those that a search by signatures finds.

    ``vectors``: id, v. A signature tells on which side of random planes a vector lies; two vectors agree in a
    sign the likelier the less the angle between them. Signs are taken in bands of ``bits``, as many as give a
    pair just at the threshold the chance ``recall`` to agree in a whole band, and the equal bands are joined:
    each row goes into as many as there are bands, however large the table. In the join, pairs whose sketches
    of further signs differ by more than a pair at the threshold would in all but one case of ten thousand
    are dropped. What is left is checked by the whole vectors, so what is found is right; what is missed is
    at most about 1 - ``recall`` of the pairs at the threshold and fewer of closer ones. ``exact``: all pairs,
    by ``similar_pairs``.

    ``between`` names a column; only pairs in which it differs count. Vectors without a direction have none.
    """
    own = vectors.where("id is not null")
    side = F.col(between) if between else F.lit(None)
    if exact:
        found = similar_pairs(own.select("id", "v"), threshold)
        if not between:
            return found
        a, b = (own.select(F.col("id").alias(x), side.alias(f"{x}_side")) for x in ("a", "b"))
        return found.join(a, "a").join(b, "b").where("a_side <> b_side").select("a", "b", "similarity")
    signed = signatures(own.select("id", "v"), bits, bands_for(threshold, recall, bits), seed)
    if between:
        signed = signed.join(own.select("id", side.alias("side")), "id")
    keyed = checkpointed(signed).select("*", F.posexplode("keys").alias("band", "key")).drop("keys")
    a, b = keyed.alias("a"), keyed.alias("b")
    chance = acos(max(-1.0, min(1.0, threshold))) / pi
    most = SKETCH * chance + 3.72 * (SKETCH * chance * (1 - chance)) ** 0.5
    bit = lambda k: F.bit_count(F.get(F.col("a.sketch"), F.lit(k)).bitwiseXOR(F.get(F.col("b.sketch"), F.lit(k))))
    near: Column = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (sum((bit(k) for k in range(1, SKETCH // 64)), bit(0)) <= most)
    if between:
        near &= F.col("a.side") != F.col("b.side")
    pairs = a.join(b, near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    v = own.select("id", "v")
    whole = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("a_v")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("b_v")), "b")
    return whole.select("a", "b", X.cosine(F.col("a_v"), F.col("b_v")).alias("similarity")).where(F.col("similarity") >= threshold)
