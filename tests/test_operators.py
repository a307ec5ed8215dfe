"""Filters, relational operators, events, places and jobs on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.operators import events, filters, geo, jobs, relational

NOW = datetime(2024, 1, 30, 12)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def photos(spark):
    schema = "id long, status string, file_path string, file_name string, taken_at timestamp, gps_latitude double, gps_longitude double, location string, city string, thumbnail_status string, ai_analyzed boolean, description string, caption string, tags string, main_category string, memory_score int, beauty_score int, overall_score int, top_person_category string, face_count int, event_id long, file_size long, deleted_at timestamp"
    t = datetime(2020, 3, 6)
    data = [
        (1, "active", "/photos/trip/a.jpg", "a.jpg", t, 10.0, 20.0, "Oslo", "Oslo", "ready", True, "A dog", "Dog", "dog,beach", "宠物", 85, 90, 86, "family", 1, 7, 5, None),
        (2, "active", "/photos/trip/day1/b.jpg", "b.jpg", t + timedelta(2), None, None, "", "", "failed", False, "", "", "", "", 0, 0, 0, "", 0, None, 6, None),
        (3, "excluded", "/photos/trip-old/c.jpg", "c.jpg", t + timedelta(14), 0.0, 0.0, None, None, None, None, None, None, None, None, 75, 70, 73, None, None, None, None, None),
        (4, "active", "/photos/trip", "d.jpg", None, 10.5, 20.5, "Oslo", "Oslo", "ready", True, "two dogs", "", "dog", "宠物", 60, 95, 70, "friend", 2, 7, 8, None),
        (5, "active", "/photos/x.jpg", "x.jpg", t, 1.0, 1.0, "Rome", "Rome", "ready", True, "gone", "", "", "", 90, 90, 90, "", 0, None, 9, NOW),
    ]
    return spark.createDataFrame(data, schema)


def test_photo_filter(spark, photos):
    tags = spark.createDataFrame([(1, "dog"), (1, "beach"), (4, "dog")], "photo_id long, tag string")
    found = lambda **k: [r[0] for r in rows(filters.photo_filter(photos, tags, **k), "id")]
    assert found() == [1, 2, 4]
    assert found(status="all") == [1, 2, 3, 4]
    assert found(status="all", paths=["/photos/trip"]) == [1, 2, 4]
    assert found(paths=[]) == []
    assert found(analyzed=False) == [2] and found(has_thumbnail=False) == [2] and found(has_gps=True) == [1, 4]
    assert found(search="DOG") == [1, 4] and found(search="dogs", whole_words=True) == [4] and found(search="dog a", whole_words=True) == [1]
    assert found(tag="beach") == [1] and found(category="宠物", location="osl") == [1, 4]


def test_small_predicates(spark, photos):
    assert rows(filters.ready_to_analyze(photos), "id") == [] and rows(filters.needs_thumbnail(photos), "id") == [(2,)]
    assert rows(filters.excluding(photos, spark.createDataFrame([(1,), (None,)], "id long")), "id") == [(2,), (3,), (4,), (5,)]
    faces = spark.createDataFrame([(1, "pending", None, 0), (2, "pending", NOW - timedelta(minutes=4), 3), (3, "pending", NOW - timedelta(minutes=6), 3), (4, "pending", NOW - timedelta(minutes=59), 9), (5, "done", None, 0)], "id long, cluster_status string, clustered_at timestamp, retry_count int")
    assert [r.id for r in filters.due_faces(faces, NOW).collect()] == [1, 3]
    devices = spark.createDataFrame([("a", NOW - timedelta(minutes=1)), ("a", NOW - timedelta(minutes=9)), ("a", None)], "device_type string, last_seen timestamp")
    assert rows(relational.device_counts(devices, NOW), "total", "online", "offline") == [(3, 1, 2)]


def test_relational(spark, photos):
    got = relational.counts_by_prefix(photos.withColumn("status", F.col("status")), ["/photos/trip", "/photos", "/none"])
    assert rows(got, "prefix", "total", "active", "with_gps") == [("/none", 0, 0, 0), ("/photos", 1, 0, 0), ("/photos/trip", 3, 3, 2)]
    assert rows(relational.home_base(photos), "city", "n", "lat") == [("Oslo", 2, 10.25)]
    assert rows(relational.system_stats(photos), "photos", "analyzed", "bytes") == [(3, 2, 19)]
    assert rows(relational.neighbours(photos.where("taken_at is not null"), "taken_at", 2), "previous", "next") == [(5, 3)]
    paths = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",), ("/c/d/e/f",), ("/a",)], "path string")
    assert rows(relational.outermost(paths), "path") == [("/a",), ("/ab",), ("/c/d",)]
    assert relational.with_total(photos, [F.col("id")], 2, 2).select("id", "total").collect() == [(3, 5), (4, 5)]


def photo_row(i, hours, lat=None, lon=None):
    return (i, datetime(2024, 5, 1) + timedelta(hours=hours), lat and float(lat), lon and float(lon))


@pytest.mark.parametrize(("data", "want"), [
    ([photo_row(i, 2 * i) for i in range(3)], [3]),
    ([photo_row(i, 0.1 * i) for i in range(3)] + [photo_row(9 + i, 24.2 + 0.1 * i) for i in range(3)], [3, 3]),
    ([photo_row(i, 0.1 * i, 10, 10) for i in range(3)] + [photo_row(9 + i, 8 + 0.1 * i, 12, 10) for i in range(3)], [3, 3]),
    ([photo_row(i, 0.1 * i, 10, 10) for i in range(3)] + [photo_row(9 + i, 8 + 0.1 * i, 10.1, 10) for i in range(3)], [6]),
    ([photo_row(i, 0.1 * i, 10, 10) for i in range(3)] + [photo_row(9 + i, 1 + 0.1 * i, 12, 10) for i in range(3)], [3, 3]),
    ([photo_row(0, 0), photo_row(1, 1)], []),
    ([photo_row(i, 20 * i) for i in range(9)], [9]),
    ([], []),
])
def test_event_splits(spark, data, want):
    df = spark.createDataFrame(data, "id long, taken_at timestamp, gps_latitude double, gps_longitude double")
    assert sorted(r["count"] for r in events.cluster_events(df).groupBy("event").count().collect()) == want


def test_growing_and_profile(spark):
    schema = "id long, taken_at timestamp, gps_latitude double, gps_longitude double, event_id long, location string, main_category string, tags string, beauty_score int, overall_score int"
    data = [(*photo_row(i, i), None, "zzz" if i % 2 else "aaa", "风景", "b,a", 50 + i % 2, 80) for i in range(4)] + [(*photo_row(50 + i, 90 + i), None, "", "", "", 1, 1) for i in range(2)] + [(*photo_row(70 + i, 300 + i), None, "", "", "", 1, 1) for i in range(2)]
    df = spark.createDataFrame(data, schema)
    old = spark.createDataFrame([(900, datetime(2024, 5, 1) + timedelta(hours=70), datetime(2024, 5, 1) + timedelta(hours=86)), (901, datetime(2024, 5, 1) + timedelta(hours=60), datetime(2024, 5, 1) + timedelta(hours=86))], "id long, start_time timestamp, end_time timestamp")
    grown = events.grow_events(df, old)
    assert rows(grown, "id", "event", "is_new") == [(0, 0, True), (1, 0, True), (2, 0, True), (3, 0, True), (50, 900, False), (51, 900, False)]
    got = events.profile_events(df, grown.where("is_new").select("id", "event")).first()
    assert (got.cover_photo_id, got.location, got.primary_tag, got.photo_count, got.duration_hours) == (1, "aaa", "a", 4, 3.0)
    assert abs(got.event_score - 80 * 2.321928094887362) < 1e-9


def test_places(spark):
    cities = spark.createDataFrame([(1, "Beijing", "北京", "北京", "CN", 39.9, 116.4), (2, "Lyon", "", "84", "FR", 45.75, 4.85), (3, "Fiji East", "", "X", "FJ", 0.0, -179.9)], "geoname_id int, name string, name_zh string, admin_name string, country string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 39.95, 116.5), (2, 45.0, 4.0), (3, 0.0, 0.0), (4, 10.0, 10.0), (5, 0.0, 179.9), (6, None, 1.0)], "id long, gps_latitude double, gps_longitude double")
    assert rows(geo.reverse_geocode(points, cities, 110), "id", "location", "city") == [(1, "北京", "北京"), (2, "法国 Lyon", "Lyon"), (5, "FJ X Fiji East", "Fiji East")]
    answers = spark.createDataFrame([("39.9500,116.5000", " ")], "key string, location string"), spark.createDataFrame([("39.9500,116.5000", "second")], "key string, location string")
    asked = points.select("id", F.col("gps_latitude").alias("lat"), F.col("gps_longitude").alias("lon")).where("id = 1")
    assert rows(geo.geocode_chain(asked, *answers), "id", "location") == [(1, "second")]


def test_queue(spark):
    schema = "id long, photo_id long, status string, priority int, source string, queued_at timestamp, last_requested_at timestamp, updated_at timestamp, attempt_count int"
    t = NOW - timedelta(hours=3)
    queue = spark.createDataFrame([(1, 11, "pending", 1, "s", t, None, t, 0), (2, 12, "pending", 5, "s", t, None, t, 0), (3, 13, "processing", 1, "s", t, None, t, 1), (4, 14, "completed", 1, "s", t, None, t, 1)], schema)
    assert rows(jobs.claim(queue, 1, NOW), "id", "status", "attempt_count") == [(1, "pending", 0), (2, "processing", 1), (3, "processing", 1), (4, "completed", 1)]
    assert rows(jobs.recover(queue, NOW, 60).where("status = 'pending'"), "id") == [(1,), (2,), (3,)]
    wanted = spark.createDataFrame([(11, 9, "m"), (14, 2, "m"), (15, 3, "m"), (15, 4, "n")], "photo_id long, priority int, source string")
    got = jobs.enqueue(queue, wanted, NOW).where("status in ('pending', 'processing')")
    assert rows(got, "photo_id", "priority") == [(11, 9), (12, 5), (13, 1), (14, 2), (15, 4)]
    assert rows(jobs.drop_finished(queue, NOW), "id") == [(1,), (2,), (3,)]


def test_results(spark):
    library = spark.createDataFrame([(1, False, "", 0, 0, "", "", 0), (2, True, "old", 9, 9, "x", "", 9)], "id long, ai_analyzed boolean, description string, memory_score int, beauty_score int, main_category string, tags string, overall_score int")
    r = [(1, "new", 85, 90, "c", "a", NOW, 0), (1, "older", 1, 1, "c", "a", NOW - timedelta(1), 0), (2, "late", 1, 1, "c", "a", NOW, 0), (3, "who", 1, 1, "c", "a", NOW, 0), (1, "", 1, 1, "c", "a", NOW, 0), (1, "x", 101, 1, "c", "a", NOW, 0)]
    results = spark.createDataFrame(r, "photo_id long, description string, memory_score int, beauty_score int, main_category string, tags string, enqueued_at timestamp, retry_count int")
    out, report = jobs.apply_results(library, results)
    assert rows(out, "id", "description", "overall_score", "ai_analyzed") == [(1, "new", 86, True), (2, "old", 9, True)]
    assert sorted(r.verdict for r in report.collect()) == ["accepted", "already", "invalid", "invalid", "superseded", "unknown"]


def test_reviews(spark):
    s = spark.createDataFrame([(1, 5, 0.9, "pending"), (2, 5, 0.8, "pending"), (1, 6, 0.7, "pending")], "target long, candidate long, similarity double, status string")
    done = jobs.review(s, spark.createDataFrame([(1, 5, "apply", NOW), (1, 6, "dismiss", NOW), (1, 6, "apply", NOW + timedelta(1))], "target long, candidate long, action string, at timestamp"))
    assert rows(done, "target", "candidate", "status") == [(1, 5, "applied"), (1, 6, "dismissed"), (2, 5, "obsolete")]
    fresh = spark.createDataFrame([(1, 7, 0.6)], "target long, candidate long, similarity double")
    assert rows(jobs.replace_suggestions(s, fresh), "target", "candidate", "status") == [(1, 5, "obsolete"), (1, 6, "obsolete"), (1, 7, "pending"), (2, 5, "pending")]
    config = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert rows(jobs.upsert(config, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"), ["key"]), "key", "value") == [("a", "1"), ("b", "3"), ("c", "4")]
