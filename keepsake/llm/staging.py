"""Written intermediate tables, which cut lineage and outlive any one executor."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from keepsake.session import shared_dir

_written: dict[str, SparkSession] = {}


def staged(df: DataFrame, label: str, compression: str = "snappy", level: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with the schema it had.

    What led to it is then no longer needed: a collection on the driver lets Spark's cleaner drop the shuffle
    files of plans that nothing refers to, so a job of several steps holds about one step's shuffles.
    """
    path = _new_path(df, label)
    _writer(df, compression, level).parquet(path)
    return _back(df, path)


def staged_parts(df: DataFrame, label: str, parts: int, compression: str = "snappy", level: int | None = None) -> list[DataFrame]:
    """As ``staged``, but as up to ``parts`` tables of whole input partitions, each of which can be released by itself."""
    path = _new_path(df, label)
    _writer(df.withColumn("_part", F.spark_partition_id() % parts), compression, level).partitionBy("_part").parquet(path)
    return [_back(df, f"{path}/_part={k}") for k in range(parts) if _folder(df.sparkSession, f"{path}/_part={k}")] or [df.sparkSession.createDataFrame([], df.schema)]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: str = "8m") -> Iterator[None]:
    """While it holds, Python workers get at most so many rows and about so many bytes at a time: for long texts and large sets."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside goes at the end, but for the tables that a frame given to its function still reads."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(path for path in set(_written) - before if any(path.split(":", 1)[-1].lstrip("/") in f for f in files))
        return df

    try:
        yield keep
    finally:
        for path in set(_written) - before - kept:
            _folder(_written.pop(path), path, delete=True)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, where what is made of them is many times as large."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose values in ``columns`` (text or binary) have about ``size`` bytes together, or of one row."""
    for b in batches:
        lengths = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy().astype("int64") for c in columns)
        start, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if k > start and held + n > size:
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def _new_path(df: DataFrame, label: str) -> str:
    return f"{shared_dir(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"


def _writer(df: DataFrame, compression: str, level: int | None) -> DataFrameWriter:
    writer = df.write.option("compression", compression)
    return writer if level is None else writer.option("parquet.compression.codec.zstd.level", str(level))


def _back(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    _written[path] = spark
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` gave and nothing reads any more; frames built on them are then invalid."""
    for df in tables:
        path = df.__dict__.get("_staged_path")
        if path in _written:
            _folder(_written.pop(path), path, delete=True)


def _folder(spark: SparkSession, path: str, delete: bool = False) -> bool:
    """Whether the folder is there; with ``delete`` it is removed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(where, True) if delete else files.exists(where)


@atexit.register
def forget() -> None:
    """Remove what ``staged`` wrote; runs when the driver ends, and may be called sooner."""
    while _written:
        path, spark = _written.popitem()
        try:
            _folder(spark, path, delete=True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return
