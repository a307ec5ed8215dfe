"""Keyed state: late and unordered rows, restarts, and state that is forgotten."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keepsake.operators import events
from keepsake.streaming import flows

T = datetime(2024, 1, 1)
SCHEMA = "device_id long, id long, taken_at timestamp, lat double, lon double"


def run(stream, out, checkpoint, **trigger):
    """What the stream has now, added to ``out``."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    try:
        assert query.awaitTermination(60), "the stream does not end"
    finally:
        query.stop()


def add(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are taken in order of their times


def batch_events(spark, rows, until):
    """The batch operator's events that are over by ``until``."""
    df = spark.createDataFrame(rows, SCHEMA).dropDuplicates(["device_id", "id"])
    found = events.sessions(df, ["device_id"], "taken_at", "id", "lat", "lon").groupBy("device_id", "session").agg(F.min("taken_at").alias("a"), F.max("taken_at").alias("z"), F.count("*").alias("n"))
    return sorted((r.device_id, r.a, r.z, r.n) for r in found.where("n >= 3").collect() if r.z + timedelta(hours=24) <= until)


def test_unordered_rows_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, 1000 * d + k, T + timedelta(minutes=rng.randrange(0, 60 * 24 * 30)), rng.choice([None, 5.0, 5.1, 9.0]), 10.0) for d in (1, 2, 3) for k in range(45)]
    rows.sort(key=lambda r: (r[2] + timedelta(hours=rng.uniform(0, 20)), r[1]))  # up to 20 hours late
    path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for start in range(0, len(rows), 27):  # each a run of its own from the checkpoint
        add(spark, rows[start : start + 27] + rows[start : start + 2], path)  # some come twice
        run(flows.events_of_device(flows.table_stream(spark, path, SCHEMA, 1)), out, check)
    until = max(r[2] for r in rows) - timedelta(days=1)
    got = sorted((r.device_id, r.start_time, r.end_time, r.photo_count) for r in spark.read.parquet(out).collect())
    want = batch_events(spark, rows, until)
    assert got == want and len(want) > 10


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    first = [(1, k, T + timedelta(hours=k), 5.0, 10.0) for k in range(4)]
    add(spark, [*first, (2, 99, T + timedelta(days=9), None, None)], path)
    run(flows.events_of_device(flows.table_stream(spark, path, SCHEMA, 1)), out, check)
    add(spark, [(1, 50, T + timedelta(hours=5), 5.0, 10.0), (1, 51, None, 5.0, 10.0), (1, None, T, 5.0, 10.0)], path)  # eight days late, no time, no id
    run(flows.events_of_device(flows.table_stream(spark, path, SCHEMA, 1)), out, check)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, T, T + timedelta(hours=3), 4)]


def test_a_key_is_taken_again_when_its_time_is_over(spark, tmp_path):
    schema = "photo_id long, note string, at timestamp"
    path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    once = lambda minutes: run(flows.once_per_ttl(flows.table_stream(spark, path, schema), "photo_id", "at", minutes), out, check, once=True)
    add(spark, [(1, "old", T), (1, "new", T + timedelta(1)), (2, "two", None), (None, "no key", T)], path, schema)
    once(0.05)
    assert sorted(r.note for r in spark.read.parquet(out).collect()) == ["new", "two"]
    time.sleep(3.5)  # longer than the three seconds
    add(spark, [(1, "again", T)], path, schema)
    once(0.05)
    assert sorted(r.note for r in spark.read.parquet(out).collect()) == ["again", "new", "two"]


def test_a_key_is_skipped_while_its_time_lasts(spark, tmp_path):
    schema = "photo_id long, note string, at timestamp"
    path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for note in ("first", "second"):
        add(spark, [(1, note, T), (5 if note == "second" else 4, note, T)], path, schema)
        run(flows.once_per_ttl(flows.table_stream(spark, path, schema), "photo_id", "at", 30), out, check, once=True)
    assert sorted((r.photo_id, r.note) for r in spark.read.parquet(out).collect()) == [(1, "first"), (4, "first"), (5, "second")]


def test_a_batch_is_a_few_messages_to_the_state():
    from types import SimpleNamespace

    from keepsake.streaming import keyed

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):  # whatever is called counts
            calls.append(name)
            put = lambda rows=(): setattr(self, "held", list(rows))
            return {"exists": lambda: bool(self.held), "get": lambda: iter(self.held) if name_of[self] == "open" else self.held[0], "appendList": lambda rows: self.held.extend(rows), "put": put, "clear": put, "update": lambda row: put([row])}[name]

    name_of = {}

    def state(name, *_):
        name_of[found := State()] = name
        return found

    handle = SimpleNamespace(getListState=state, getValueState=state, getMapState=state, registerTimer=calls.append, deleteTimer=calls.append)
    events, hour = keyed.DeviceEvents(12 * 3_600_000_000, 50.0, 3), 3_600_000_000
    events.init(handle)
    rows = [{"id": k, "us": k * hour // 100, "lat": None, "lon": None} for k in range(500)] + [{"id": 7, "us": 100 * hour, "lat": None, "lon": None}]
    at = lambda us: SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1000)
    assert list(events.handleInputRows((1,), iter(rows), at(0))) == []
    out = list(events.handleExpiredTimer((1,), at(30 * hour), None))
    assert [(r.start_us, r.end_us, r.photo_count) for r in out] == [(0, 499 * hour // 100, 499)]
    assert [tuple(r) for r in name_of and events.open.held] == [(7, 100 * hour, None, None)] and len(calls) < 20
