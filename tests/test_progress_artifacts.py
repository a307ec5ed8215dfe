"""Counts that come with a run, and a sink of files that fails."""

import hashlib
import time
import uuid

import pytest
from pyspark.sql import functions as F

from keepsake.sources import artifacts
from keepsake.streaming import progress


def test_counts_come_with_the_one_job(spark):
    rows = spark.range(1000).withColumn("action", F.when(F.col("id") % 3 == 0, "insert").when(F.col("id") % 3 == 1, "keep"))
    told, counts = progress.observed(rows, inserts=F.col("action") == "insert", unknown=F.col("action").isNull())
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "counted")
    try:
        told.write.format("noop").mode("overwrite").save()
        assert counts.get == {"total": 1000, "inserts": 334, "unknown": 333}
        assert len(context.statusTracker().getJobIdsForGroup(group)) == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    none, counts = progress.observed(rows.limit(0), inserts=F.col("action") == "insert")
    none.collect()
    assert counts.get == {"total": 0, "inserts": 0}


def test_counts_of_a_stream(spark, tmp_path):
    schema, listener = "id long, action string", progress.Progress()
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).withColumn("action", F.when(F.col("id") % 2 == 0, "insert")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = progress.watched(stream, "scan", inserts=F.col("action") == "insert").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        for _ in range(100):  # the listener hears of it a little later
            if listener.counts("scan").get("total") == 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.counts("scan") == {"total": 30, "inserts": 15} and listener.counts("other") == {}


def told(spark, path):
    return {r.name: (bytes(r.payload), r.whole) for r in artifacts.read_artifacts(spark, path).collect()}


def test_artifacts_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = [(f"n{k}", bytes([k]) * (k * 7 % 40)) for k in range(60)]
    df = spark.createDataFrame([(n, bytearray(p), 1) for n, p in rows] + [("null", None, 1)], "name string, payload binary, start int").repartition(4)
    artifacts.write_artifacts(df, path, packbytes=50)
    assert told(spark, path) == {n: (p, True) for n, p in rows}
    listed = artifacts.manifest(spark, path).collect()
    assert {r.name: r.sha256 for r in listed} == {n: hashlib.sha256(p).hexdigest() for n, p in rows} and len({r.file for r in listed}) > 8
    artifacts.write_artifacts(spark.createDataFrame([("more", bytearray(b"x"))], "name string, payload binary"), path)
    assert told(spark, path) == {n: (p, True) for n, p in rows} | {"more": (b"x", True)}
    for file in (tmp_path / "a/packs").iterdir():
        if b"x" == file.read_bytes():
            file.write_bytes(b"y")  # damage is seen
    assert told(spark, path)["more"] == (b"y", False)
    with pytest.raises(Exception, match="only appended"):
        df.select("name", "payload").write.format("artifacts").option("path", path).mode("overwrite").save()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    artifacts.write_artifacts(spark.createDataFrame([("one", bytearray(b"1"))], "name string, payload binary"), path)
    bad = spark.range(100).select(F.when(F.col("id") != 77, F.col("id").cast("string")).alias("name"), F.lit(b"data").alias("payload")).repartition(4)
    with pytest.raises(Exception, match="no name"):
        artifacts.write_artifacts(bad, path)
    assert told(spark, path) == {"one": (b"1", True)} and artifacts.manifest(spark, path).count() == 1
    artifacts.write_artifacts(bad.where("name is not null"), path)
    assert len(told(spark, path)) == 100


def test_each_payload_is_read_by_its_range_alone(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    payload = F.substring(F.repeat(F.sha2(F.col("id").cast("string"), 256), 4), 1, (F.col("id") % 200).cast("int")).cast("binary")
    rows = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("n"), "id").alias("name"), payload.alias("payload"))
    artifacts.write_artifacts(rows, path, packbytes=100_000)
    back = artifacts.read_artifacts(spark, path)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Join" not in plan.split("MapInArrow")[0]  # no whole pack beside every row
    assert {r.name: bytes(r.payload) for r in back.collect()} == {r.name: bytes(r.payload) for r in rows.collect()}
    pack = next(f for f in (tmp_path / "a/packs").iterdir() if f.stat().st_size > 50_000)
    pack.write_bytes(pack.read_bytes()[:20_000])
    assert 0 < back.where("not whole").count() < 3000 and back.count() == 3000
