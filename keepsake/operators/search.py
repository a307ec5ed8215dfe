"""Full-text search over a stored index: postings by term, kept current by the documents that changed alone.

An index is a folder of two Parquet tables, both cut into generations, of which the building is the first and
every update one more:

* ``postings``: gen, bucket (of the term's hash), term, id, positions of the term in the document's words
* ``documents``: gen, id, gone; a document's last generation says which of its postings count, if any

A generation's postings are written before its documents, and only those count that its documents name, so an
update that fails half-way changes nothing and may be run again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.session import finished_folders

#: Folders that a generation's postings are dealt into by term, and tasks that the documents of each are dealt to.
BUCKETS, SALTS = 64, 8
#: Words between two columns of a document, so that no phrase reaches from one into the next.
APART = 1_000


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of about ``most`` bytes of text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1).flatten()).to_numpy().reshape(b.num_rows, -1).sum(axis=1))
        cuts = np.flatnonzero(np.diff(ends // most)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, positions) of rows (id, texts): a text for each column, its words parted by single spaces."""
    for b in _slices(batches):
        split = pc.split_pattern(b.column(1).flatten(), " ")
        n = split.value_lengths().to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        encoded = split.flatten().dictionary_encode()
        word = encoded.indices.to_numpy().astype(np.int64)
        real = pc.not_equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)[word]  # a text without words is one empty one
        text, place, word = text[real], place[real], word[real]
        counts = np.bincount(text, minlength=len(n)).reshape(b.num_rows, -1)
        base = (np.cumsum(counts + APART, axis=1) - counts - APART).ravel()
        row, at = text // counts.shape[1], (place + base[text]).astype(np.int32)
        order = np.lexsort((at, word, row))
        row, word, at = row[order], word[order], at[order]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(at))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[first])), encoded.dictionary.take(pa.array(word[first])), lists], names=["id", "term", "positions"])


def _write(docs: DataFrame, gone: DataFrame | None, path: str, gen: int, key: str, columns: Sequence[str], buckets: int) -> None:
    """One generation: the postings of ``docs``, then the list of what it has and what is gone.

    A document's words are grouped before they are dealt, so a posting is sent, not every word. Only documents
    whose rows repeat a key are grouped once more.
    """
    known = docs.where(F.col(key).isNotNull())
    plain = known.select(F.col(key).alias("id"), F.array(*[F.trim(X.token_text(F.coalesce(F.col(c), F.lit("")))) for c in columns]).alias("texts"))
    each = plain.mapInArrow(_postings_of, f"id {dict(plain.dtypes)['id']}, term string, positions array<int>")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    # dealt once by bucket and part of the documents
    lists = each.withColumns({"bucket": bucket_of(F.col("term"), buckets), "salt": salt}).repartition("bucket", "salt")
    if not known.groupBy(key).count().where("count > 1").isEmpty():
        lists = lists.groupBy("bucket", "salt", "term", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    lists.select("term", "id", "positions", "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/gen={gen}")
    have = known.select(F.col(key).alias("id"), F.lit(False).alias("gone"))
    if gone is not None:
        have = have.unionByName(gone.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lit(True).alias("gone")))
    have.groupBy("id").agg(F.bool_and("gone").alias("gone")).write.mode("overwrite").parquet(f"{path}/documents/gen={gen}")


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The generations whose documents are written to the end; one folder for each update."""
    return finished_folders(spark, f"{path}/documents", "gen")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    kind = dict(spark.read.parquet(f"{path}/documents").dtypes)["id"]
    return spark.read.schema(f"term string, id {kind}, positions array<int>, gen int, bucket int").parquet(f"{path}/postings")


def build_index(docs: DataFrame, path: str, key: str = "id", columns: Sequence[str] = ("text",), buckets: int = BUCKETS) -> None:
    """A new index of the words of ``columns``. Rows that repeat a key count as one document; null keys are left out."""
    _write(docs, None, path, 1, key, columns, buckets)


def update_index(changed: DataFrame, path: str, removed: DataFrame | None = None, key: str = "id", columns: Sequence[str] = ("text",), buckets: int = BUCKETS) -> int:
    """Take in new and changed documents, and drop those of ``removed``; returns the generation.

    Only these documents are read and written: postings of their older generations stay where they are and
    count no more.
    """
    gen = _generations(changed.sparkSession, path)[-1] + 1
    _write(changed, removed, path, gen, key, columns, buckets)
    return gen


def compact_index(spark: SparkSession, path: str, into: str) -> None:
    """The index with all generations made one, in another folder."""
    postings = current(spark, path, _postings(spark, path))
    postings.select("bucket", "term", "id", "positions").repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/postings/gen=1")
    _last(spark, path).where("not gone").select("id", "gone").write.mode("overwrite").parquet(f"{into}/documents/gen=1")


def _last(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents").groupBy("id").agg(F.max("gen").alias("gen"), F.max_by("gone", "gen").alias("gone"))


def current(spark: SparkSession, path: str, postings: DataFrame) -> DataFrame:
    """Those of the postings that their documents' last generations have."""
    if _generations(spark, path) == [1]:
        return postings.where("gen = 1")
    return postings.join(_last(spark, path).where("not gone").select("id", "gen"), ["id", "gen"], "left_semi")


def search_index(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(id) of the documents that hold every term of the query as whole words; a query without words finds nothing.

    Terms are parted by white space; a term of several words (``well-known``) is a phrase: its words one after
    another. Only the folders of the terms' buckets are read, and in them the row groups with the terms; the
    documents' texts never are. Documents meet the terms by counting: a phrase's words by the place where it
    would begin, then the phrases a document has.
    """
    phrases = list(dict.fromkeys(tuple(t.split()) for t in X.search_terms(query)))
    postings = _postings(spark, path)
    asked = sorted({w for p in phrases for w in p})
    if not asked:
        return postings.select("id").limit(0)
    # equalities with literals alone, which prune folders and row groups
    same = reduce(lambda a, b: a | b, [(F.col("bucket") == bucket_of(F.lit(w), buckets)) & (F.col("term") == w) for w in asked])
    hits = current(spark, path, postings.where(same))
    single = [p[0] for p in phrases if len(p) == 1]
    parts = [hits.where(F.col("term").isin(single)).select("id", F.col("term").alias("phrase"))] if single else []
    for p in (p for p in phrases if len(p) > 1):
        begins = F.explode(F.array(*[F.lit(k) for k, w in enumerate(p)])).alias("k")
        word = F.element_at(F.array(*[F.lit(w) for w in p]), F.col("k") + 1)
        at = hits.where(F.col("term").isin(*p)).select("id", "term", "positions", begins).where(word == F.col("term"))
        starts = at.select("id", "k", F.explode("positions").alias("at")).select("id", "k", (F.col("at") - F.col("k")).alias("start"))
        parts.append(starts.groupBy("id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(p)).select("id", F.lit(" ".join(p)).alias("phrase")).distinct())
    met = reduce(DataFrame.unionByName, parts)
    return met.groupBy("id").agg(F.countDistinct("phrase").alias("n")).where(F.col("n") == len(phrases)).select("id")
