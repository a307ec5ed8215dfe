"""Files and city tables, and streams that must say what the batch says."""

import gzip
import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keepsake.operators import events
from keepsake.sources import files
from keepsake.streaming import flows


def exif_jpeg():
    """A JPEG head with orientation 6, a time and a southern place, and a frame of 40 x 30."""
    entries, extra, base = [], b"", 8 + 2 + 12 * 3 + 4
    gps_at = base
    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, gps_at + 54) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, gps_at + 78) + b"\0" * 4
    extra = gps + struct.pack("<6I", 33, 1, 30, 1, 0, 1) + struct.pack("<6I", 151, 1, 0, 1, 36, 1)
    time_at = base + len(extra)
    extra += b"2024:03:06 01:02:03\0"
    entries = [struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0), struct.pack("<HHII", 0x0132, 2, 20, time_at), struct.pack("<HHII", 0x8825, 4, 1, gps_at)]
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(entries) + b"\0" * 4 + extra
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + b"\0" * 12


def test_pictures(spark, tmp_path):
    (tmp_path / "in/skip").mkdir(parents=True)
    (tmp_path / "in/a.JPG").write_bytes(exif_jpeg())
    (tmp_path / "in/b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 5, 7))
    (tmp_path / "in/c.txt").write_text("no")
    (tmp_path / "in/skip/d.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 3, 4))
    found = files.picture_files(spark, f"{tmp_path}/in", ["skip"], content=True)
    facts = {r.file_path.rsplit("/", 1)[1]: r for r in files.picture_facts(found).collect()}
    assert facts.keys() == {"a.JPG", "b.png"}
    a = facts["a.JPG"]
    assert (a.width, a.height, a.orientation, a.taken_at, a.gps_latitude, round(a.gps_longitude, 4)) == (40, 30, 6, datetime(2024, 3, 6, 1, 2, 3), -33.5, 151.01)
    assert (facts["b.png"].width, facts["b.png"].height, facts["b.png"].orientation) == (5, 7, None)
    assert files.image_size(b"") == (None, None) and files.exif_fields(b"Exif\0\0II")["orientation"] is None


def test_snapshot_and_tables(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "file_path string, file_size long, file_mod_time timestamp"
    was = spark.createDataFrame([("a", 1, t), ("b", 1, t), ("c", 1, None), ("d", 1, t)], schema)
    now = spark.createDataFrame([("b", 2, t), ("c", 1, None), ("d", 1, t), ("e", 1, t)], schema)
    assert {r.file_path: r.action for r in files.scan_diff(was, now).collect()} == {"a": "delete", "b": "update", "c": "keep", "d": "keep", "e": "insert"}
    with gzip.open(tmp_path / "cities.tsv.gz", "wt") as f:
        f.write("1\tOslo\t奥斯陆\t12\tNO\t59.9\t10.7\n2\tBad\n3\tWorse\t\t\tNO\tx\t1\n4\tRome\t\t\tIT\t41.9\t12.5\n")
    cities = files.read_cities(spark, str(tmp_path / "cities.tsv.gz"))
    assert sorted(r.name for r in cities.collect()) == ["Oslo", "Rome"]
    names = spark.createDataFrame([(1, "zh", "B"), (1, "zh-CN", "A"), (4, "zh-TW", "C"), (4, "fr", "D")], "geoname_id int, lang string, name string")
    assert sorted((r.geoname_id, r.name_zh) for r in files.build_cities(cities, names).collect()) == [(1, "A"), (4, "C")]
    files.write_cities(files.build_cities(cities, names), str(tmp_path / "out"))
    assert sorted((r.name, r.name_zh) for r in files.read_cities(spark, str(tmp_path / "out")).collect()) == [("Oslo", "A"), ("Rome", "C")]


def test_answers(spark):
    rows = spark.createDataFrame([(1, 'ok {"description": "a dog", "main_category": "Dog", "memory_score": 7}'), (2, '{"description": "", "main_category": "x"}'), (3, "nothing"), (4, None)], "photo_id long, response string")
    assert [(r.photo_id, r.main_category, r.caption, r.memory_score) for r in files.parse_analysis(rows).collect()] == [(1, "宠物", "a dog", 7)]
    many = spark.createDataFrame([(1, 'x [{"description": "a"}, {"description": "b"}] y')], "id long, response string")
    assert [(r.place, r.description) for r in files.parse_analysis_batch(many).collect()] == [(0, "a"), (1, "b")]


def test_intake_keeps_the_newest(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "photo_id long, note string, at timestamp"
    spark.createDataFrame([(1, "old", t), (1, "new", t + timedelta(1)), (2, "only", t)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stored = f"{tmp_path}/out"
    flows.intake(flows.table_stream(spark, f"{tmp_path}/in", schema), "photo_id", "at", f"{tmp_path}/check", lambda b, n: b.write.mode("overwrite").parquet(f"{stored}/batch={n}")).awaitTermination()
    assert sorted(r.note for r in spark.read.parquet(stored).collect()) == ["new", "only"]


def drain(stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_window_dedup(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "photo_id long, at timestamp"
    spark.createDataFrame([(1, t), (1, t + timedelta(minutes=2)), (2, t)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert drain(flows.once_per_window(flows.table_stream(spark, f"{tmp_path}/in", schema), "photo_id", "at"), "dedup").count() == 2


def test_stream_events_are_batch_events(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "device_id long, id long, taken_at timestamp, lat double, lon double"
    places = [(d, 100 * d + k, t + timedelta(hours=h), la, 10.0) for d in (1, 2) for k, (h, la) in enumerate([(0, 5.0), (1, 5.0), (2, 5.0), (30, 5.0), (31, 5.0), (32, 5.0), (33, 9.0), (34, 9.0), (60, 5.0)])]
    df = spark.createDataFrame(places, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9, 900, t + timedelta(days=40), None, None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drain(flows.events_of_device(flows.table_stream(spark, f"{tmp_path}/in", schema, 1)), "device_events")
    cut = events.sessions(df, ["device_id"], "taken_at", "id", "lat", "lon").groupBy("device_id", "session").agg(F.count("*").alias("photo_count"), F.min("taken_at").alias("start_time")).where("photo_count >= 3")
    assert sorted((r.device_id, r.start_time, r.photo_count) for r in got.collect()) == sorted((r.device_id, r.start_time, r.photo_count) for r in cut.collect())
    by_time = drain(flows.time_sessions(flows.table_stream(spark, f"{tmp_path}/in", schema, 1), "device_id", "taken_at"), "time_sessions")
    assert sorted(r.photo_count for r in by_time.collect() if r.device_id == 1) == [1, 3, 5]
