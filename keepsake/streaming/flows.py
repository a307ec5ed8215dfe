"""Structured Streaming versions of what runs all the time: result intake, deduplication and events of a device."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keepsake.operators import relational as R
from keepsake.streaming import keyed


def table_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder; at most so many a batch, which is the queue's bound."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_per_window(results: DataFrame, key: str, time: str, minutes: int = 5) -> DataFrame:
    """A result whose key came within the window before is dropped; state is bounded by the watermark."""
    return results.withWatermark(time, f"{minutes} minutes").dropDuplicatesWithinWatermark([key])


def newest_of_batch(batch: DataFrame, key: str, time: str) -> DataFrame:
    return R.latest_per_key(batch, [key], [F.desc(time)])


def intake(results: DataFrame, key: str, time: str, checkpoint: str, store: Callable[[DataFrame, int], None], seconds: int | None = None) -> StreamingQuery:
    """Store the newest result of each key, batch by batch; a failed batch is run again as it was.

    ``store`` gets (rows, batch number) and must be idempotent for a number. Without ``seconds`` the stream
    takes what is there and ends.
    """
    writer = results.writeStream.foreachBatch(lambda b, n: store(newest_of_batch(b, key, time), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def time_sessions(photos: DataFrame, key: str, time: str, hours: int = 24, late: str = "1 day") -> DataFrame:
    """Events by the gap in time alone, with built-in session windows."""
    windowed = photos.withWatermark(time, late).groupBy(key, F.session_window(time, f"{hours} hours").alias("w"))
    return windowed.agg(F.count("*").alias("photo_count"), F.min(time).alias("start_time"), F.max(time).alias("end_time")).drop("w")


def once_per_ttl(results: DataFrame, key: str, time: str, minutes: float = 5) -> DataFrame:
    """The newest result of a key in a batch, unless the key was handled in the ``minutes`` before, by the clock.

    Each key keeps one flag that the state store forgets by itself after that time, whatever the results'
    own times are; a later batch then takes the key again. Columns are as they came. Such a query never runs
    out of batches, since time passes: trigger it by the clock, or once.
    """
    return results.where(F.col(key).isNotNull()).groupBy(key).transformWithState(keyed.Once(int(minutes * 60_000), time), results.schema, "Append", "ProcessingTime")


def events_of_device(photos: DataFrame, hours: float = 24, far_km: float = 50.0, least: int = 3, late: str = "1 day") -> DataFrame:
    """Events as photos arrive, split by time and place: (device_id, start_time, end_time, photo_count).

    Input: device_id, id, taken_at, lat, lon. A photo may come late by ``late`` and in any order; one that comes
    twice counts once, as it came last. An event is given out when the watermark has passed its end by the
    gap, so its rows can't change any more; that is a timer's doing, one for each device. A device keeps only
    its open photos. Photos without a time or an id are left out.
    """
    known = photos.where("taken_at is not null and id is not null").select("device_id", F.col("id").cast("long").alias("id"), "taken_at", F.unix_micros("taken_at").alias("us"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    device = known.schema["device_id"].dataType.simpleString()
    found = known.withWatermark("taken_at", late).groupBy("device_id").transformWithState(keyed.DeviceEvents(int(hours * 3_600_000_000), far_km, least), f"device_id {device}, start_us long, end_us long, photo_count long", "Append", "EventTime")
    return found.select("device_id", F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), "photo_count")
