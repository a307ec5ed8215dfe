"""Merge suggestions kept current in slices: a run looks again only at people whose prototypes changed.

Prototypes carry the generation in which they changed last (``gen``; a person that lost all of them keeps a
row with a null vector). The stored state is a folder of runs, each with what that run alone computed:

* ``pairs``: run, lo, hi, similarity of all pairs with a person of the run
* ``done``: run, person_id, gen up to which the person's changes are in

A pair's stored row counts if it is of the later of its two people's last runs. A run's pairs are written
before its people, so one that failed leaves nothing that counts, and the next takes up the same people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators.people import SUGGEST, _as_members, component_scores, pair_scores, suggested
from keepsake.session import checkpointed, finished_folders


def _last_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """(person_id, run, gen) of every person's last run; None before the first."""
    runs = finished_folders(spark, f"{path}/done", "run")
    if not runs:
        return None
    done = spark.read.option("basePath", f"{path}/done").parquet(*[f"{path}/done/run={r}" for r in runs])
    return done.groupBy("person_id").agg(F.max("run").alias("run"), F.max_by("gen", "run").alias("gen"))


def dirty_people(prototypes: DataFrame, path: str) -> DataFrame:
    """(person_id, gen): people with a change that no run has seen."""
    newest = prototypes.where("person_id is not null").groupBy("person_id").agg(F.max("gen").alias("gen"))
    last = _last_runs(prototypes.sparkSession, path)
    if last is None:
        return newest
    return newest.join(last.select("person_id", F.col("gen").alias("_seen")), "person_id", "left").where("_seen is null or gen > _seen").drop("_seen")


def run_slice(prototypes: DataFrame, path: str, least: float = SUGGEST, limit: int | None = None) -> int:
    """Compare the changed people (the first ``limit`` by id) with all others; returns how many there were.

    ``prototypes``: person_id, v, gen. Only pairs with one of these people are computed and written: the work
    is that of the change times all people, not of all pairs. Changes that come in while a run works have a
    later generation and are taken by the next. Zero people means the state is current.
    """
    spark = prototypes.sparkSession
    dirty = dirty_people(prototypes, path)
    chosen = checkpointed(dirty.orderBy("person_id").limit(limit) if limit else dirty)
    n = chosen.count()
    if n == 0:
        return 0
    run = (finished_folders(spark, f"{path}/done", "run") or [0])[-1] + 1
    known = prototypes.where("person_id is not null and v is not null").select("person_id", "v")
    changed = checkpointed(known.join(chosen.select("person_id"), "person_id", "left_semi"))
    there = component_scores(_as_members(changed), known)
    back = component_scores(_as_members(known), changed)
    pairs = pair_scores(there.unionByName(back).distinct(), least)
    pairs.write.mode("overwrite").parquet(f"{path}/pairs/run={run}")
    chosen.select("person_id", "gen").write.mode("overwrite").parquet(f"{path}/done/run={run}")
    return n


def current_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi, similarity) as the runs so far have it; the first run must be over."""
    last = _last_runs(spark, path)
    if last is None:
        raise ValueError(f"no run is stored in {path}")
    runs = finished_folders(spark, f"{path}/done", "run")
    stored = spark.read.option("basePath", f"{path}/pairs").parquet(*[f"{path}/pairs/run={r}" for r in runs])
    a, b = (last.select(F.col("person_id").alias(x), F.col("run").alias(f"{x}_run")) for x in ("lo", "hi"))
    return stored.join(a, "lo").join(b, "hi").where("run = greatest(lo_run, hi_run)").select("lo", "hi", "similarity")


def stored_suggestions(spark: SparkSession, path: str, cannot_link: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(target, candidate, similarity, rank), as ``merge_suggestions`` would have it of the prototypes seen so far."""
    return suggested(current_pairs(spark, path), cannot_link, limit)
