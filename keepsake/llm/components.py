"""Connected components of an edge table, as joins and aggregates over edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.staging import staged


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table: equal for equal tables."""
    hashed = F.xxhash64("src", "dst")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first())


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph with the columns (src, dst); component: its least node.

    Alternates the large-star and small-star steps: every node passes the least neighbour it knows to its
    larger neighbours, then to its smaller ones, until nothing changes. The rounds grow with the logarithm
    of the longest chain. A hub's edges meet only in a join against one aggregated row, which adaptive
    execution splits, never in one group; each round is written to the shared folder. Nulls and loops in
    ``edges`` are ignored, so a node without any other edge is not in the result; repeated edges count once.
    """
    edges = staged(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    seen = _fingerprint(edges)
    for _ in range(max_rounds if seen[0] else 0):
        near = _both_ways(edges)
        least = near.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = near.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()
        edges = staged(small, "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
