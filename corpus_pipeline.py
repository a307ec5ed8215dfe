"""The corpus pipeline: from raw documents to packed training sequences, a written table after every stage.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns all it keeps; all but the
last return the columns of documents. Rows without a doc_id can't be told apart: near-duplicate, repeat and
benchmark decisions, which are about ids, leave them in.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import alike, decontaminate, packing, quality, substrings
from keepsake.llm.queries import word_tokenizer
from keepsake.llm.staging import arrow_rows, release, scratch, staged
from keepsake.session import table

#: Rows that Python workers get at a time: documents are long, and an executor runs several workers.
BATCH = 500
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_few_rows(stage):  # noqa: ANN001, ANN201
    """The stage with Python workers that get BATCH rows at a time; of its own tables those go that its result does not read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with arrow_rows(spark, BATCH), scratch() as keep:
            return keep(stage(spark, docs, sf_dir))

    return run


@by_few_rows
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.3 or more)."""
    return staged(quality.filter_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS), "good", "zstd")


@by_few_rows
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingles of five words, similarity 0.8): the one with the least id; of repeated rows, one."""
    groups = alike.alike_groups(docs)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    one_each = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one_each.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


@by_few_rows
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those of which nothing is left go, others stay as they came."""
    cut = substrings.remove_repeats(docs, keep=("doc_id", "lang", "source"), untouched=True)
    left = cut.where("n_words = 0 or n_removed < n_words").select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return staged(left, "without-repeats", "zstd")  # the texts are cut in Python: here, where its batches are small


@by_few_rows
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its own words or with other values in its slots."""
    leaks = staged(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(decontaminate.bounded(leaks, 2_000_000), "doc_id", "left_anti").select(*COLUMNS)


@by_few_rows
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with the sequence and the place that best-fit packing gave them."""
    pieces = packing.token_pieces(docs, word_tokenizer())
    return packing.pack(staged(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", clean),
    ("best-fit packing", packed),
]

#: A boosted-tree score, components of fingerprints and a tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next reads them, and go after it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        before = docs
        with scratch() as keep:
            docs = stage(spark, before, sf_dir)
            docs = keep(staged(docs, f"stage-{number}", "zstd") if number < len(STAGES) else docs)
        release(before)
    return docs
