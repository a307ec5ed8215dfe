"""The labelled rows a classifier may learn from, and the rows held out from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of this many groups of document ids, group 0 is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text has the remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y): at most ``per_class`` rows of each class that are not held out, by hash order of the id.

    Rows with a null id or label are left out; a document with several labels counts once, with the larger.
    The bound makes the sample small enough to broadcast: 2 x ``per_class`` rows of 12 bytes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    return known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))


def class_share(labels: DataFrame, label: str) -> float | None:
    """The share of label 1 among all labelled rows that are not held out; None without any."""
    return labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double"))).first()[0]
