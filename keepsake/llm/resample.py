"""Importance resampling towards a target: hashed n-gram features, inverted postings, gains by bucket, a seeded draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.decontaminate import bounded
from keepsake.llm.staging import arrow_rows, few_rows, release, staged

#: Word bytes: digits, letters (A-Z as a-z) and everything beyond ASCII; all others part words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Parts that the documents of one bucket are dealt into, so a word that all documents have is no single task.
SALTS = 16


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


def features_of(words: list[bytes], ngrams: int) -> list[bytes]:
    """All runs of 1 to ``ngrams`` words, joined by one space."""
    found = list(words)
    for n in range(2, ngrams + 1):
        found += [b" ".join(run) for run in zip(*[words[k:] for k in range(n)], strict=False)]
    return found


class Buckets(dict):
    """Feature to bucket, remembered; forgotten altogether beyond ``most`` features."""

    def __init__(self, buckets: int, most: int = 500_000) -> None:
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def postings(docs: DataFrame, ngrams: int, buckets: int, doc_id: str, text: str) -> DataFrame:
    """(row, bucket, n, words, doc_id): for every row of ``docs`` and every bucket it has, how often.

    One more line a row, in bucket -1, carries its id and its numbers of features and words, also for rows
    without any. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for b in few_rows(batches):
            texts = [words_of(t or b"") for t in b.column(2).to_pylist()]
            found = [features_of(w, ngrams) for w in texts]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            code = np.fromiter((known[x] for f in found for x in f), dtype=np.int64, count=int(sizes.sum()))
            place, n = np.unique(np.repeat(np.arange(len(found)), sizes) * buckets + code, return_counts=True)
            at, bucket, none = place // buckets, (place % buckets).astype(np.int32), pa.nulls(len(place))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, -1, np.int32)), pa.array(sizes), pa.array([len(w) for w in texts], pa.int64()), b.column(1)], names=names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(bucket), pa.array(n.astype(np.int64)), none.cast(pa.int64()), none.cast(b.schema.field(1).type)], names=names)

    names = ["row", "bucket", "n", "words", "doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row long, bucket int, n long, words long, doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their place (``rank``, from 1) in the order: a sort by range, then each part's offset; no part holds all rows."""
    part = F.shiftright(F.col("_at"), 33)
    sorted_ = staged(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", part), "ranked")
    offset, offsets = 0, []
    for p, n in sorted(sorted_.groupBy("_part").count().collect()):  # one row for each partition
        offsets.append((p, offset))
        offset += n
    before = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + inside + 1).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every document's weight towards the target's texts, and the rank of those that are drawn.

    Features are runs of 1 to ``ngrams`` words, hashed into ``buckets``. Both corpora's postings (bucket,
    document, count) are dealt by bucket, and by a part of the documents, so that a frequent word's bucket is
    many tasks; there lies, written, everything a bucket needs. Its gain is floor(1000 ln of the smoothed
    ratio of the target's share to the documents'), a document's weight the floored mean of its features'
    gains. What a bucket adds to a document is summed in each task before it is dealt by document. The totals
    of the buckets are ``buckets`` rows whatever the input, and broadcast up to a count.

    score = weight + a Gumbel draw from the seed and the id; of the N documents with ``least_words`` or more,
    the floor(percent N / 100) highest scores are drawn, ties to smaller ids. Null texts have no words and
    weight 0; a null id counts as the empty text in the draw and comes last in ties. Rows that repeat an id are
    each scored with the text they have. Empty tables, documents or target, give empty results or gains
    against nothing. Further columns are not read.

    Returns doc_id, n_features, weight, score, rank (null: not drawn), all but the id long.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, 1000):
        ours = postings(docs, ngrams, buckets, doc_id, text).withColumn("side", F.lit(0).cast("byte"))
        theirs = postings(target.withColumn("_id", F.lit(None).cast(docs.schema[doc_id].dataType)), ngrams, buckets, "_id", target_text).withColumn("side", F.lit(1).cast("byte"))
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
        both = staged(ours.unionByName(theirs).repartition(F.col("bucket"), salt).sortWithinPartitions("bucket"), "postings", "zstd")
    lists = both.where("bucket >= 0")
    counts = lists.groupBy("bucket").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("t"))
    counts = staged(counts, "bucket-counts")
    all_s, all_t = (x or 0 for x in counts.agg(F.sum("s"), F.sum("t")).first())
    double = lambda c: F.col(c).cast("double") + 1
    ratio = double("t") * F.lit(float(all_s + buckets)) / (double("s") * F.lit(float(all_t + buckets)))
    gains = counts.where("s > 0").select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))
    gained = lists.where("side = 0").join(bounded(gains, 1_000_000), "bucket").select("row", (F.col("n") * F.col("gain")).alias("gained"))
    heads = both.where("bucket < 0 and side = 0")
    nothing = lambda kind: F.lit(None).cast(kind)
    lines = gained.select("row", "gained", nothing("long").alias("n"), nothing("long").alias("words"), nothing(docs.schema[doc_id].dataType).alias("doc_id")).unionByName(heads.select("row", F.lit(0).cast("long").alias("gained"), "n", "words", "doc_id"))
    summed = lines.groupBy("row").agg(F.sum("gained").alias("gained"), F.max("n").alias("n"), F.max("words").alias("words"), F.max("doc_id").alias("doc_id"))
    whole = F.expr("(gained - pmod(gained, n)) div n")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.log(-F.log((drawn + 0.5) / 4294967296.0)) * -1000)
    weighed = summed.select("doc_id", F.col("n").alias("n_features"), "words", F.when(F.col("n") > 0, whole).otherwise(0).cast("long").alias("weight"))
    scored = staged(weighed.withColumn("score", F.col("weight") + gumbel), "scored")
    release(both, counts)
    fit = F.col("words") >= least_words
    most = scored.where(fit).count() * percent // 100
    places = ranked(scored.where(fit).select("doc_id", "n_features", "weight", "score"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features"))
    rest = scored.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return places.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(rest).withColumnRenamed("doc_id", doc_id)
