"""The daily selection: windows, ranks, channels, score adjustments and greedy picks."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.operators import curation

DAY = date(2024, 3, 6)
PHOTO = "id long, status string, deleted_at timestamp, ai_analyzed boolean, taken_at timestamp, memory_score int, beauty_score int, overall_score int, top_person_category string, gps_latitude double, gps_longitude double, location string, file_path string, caption string, tags string, city string, event_id long, main_category string"


def photo(i, taken, overall=80, memory=80, beauty=80, analyzed=True, lat=None, lon=None, category="", event=None, caption="", tags=""):
    return (i, "active", None, analyzed, taken, memory, beauty, overall, category, lat, lon, None, f"/p/{i}.jpg", caption, tags, "Oslo" if lat is not None else None, event, "")


def test_on_this_day(spark):
    rows = [photo(1, datetime(2020, 3, 6), 75), photo(2, datetime(2021, 3, 8), 80), photo(3, datetime(2020, 3, 20), 99), photo(4, datetime(2020, 3, 5), 60, 50, 90), photo(5, datetime(2020, 3, 6), 90, analyzed=False), photo(6, datetime(2020, 8, 1), 95)]
    df = spark.createDataFrame(rows, PHOTO)
    got = curation.on_this_day(df, DAY, 2)
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(got) == [1, 2, 3] and {r.id: r.window_tier for r in got.collect()} == {1: 0, 2: 0, 3: 2}
    assert ids(curation.on_this_day(df, DAY, 2, exclude=spark.createDataFrame([(1,)], "id long"))) == [2, 3]
    assert ids(curation.on_this_day(df, DAY, 2, without_year=2020)) == [2]
    # no window has any: the best of all days; none reaches the thresholds or all are excluded: all of them
    assert ids(curation.on_this_day(df, DAY, 2, exclude=spark.createDataFrame([(1,), (2,), (3,)], "id long"))) == [6]
    assert ids(curation.on_this_day(df, DAY, 2, exclude=spark.createDataFrame([(1,), (2,), (3,), (6,)], "id long"))) == [3, 6, 2, 1, 4]
    assert set(ids(curation.on_this_day(df, DAY, 2, curation.Strategy(memory=999)))) == {1, 2, 3, 4, 6}


def test_diversity(spark):
    t = datetime(2020, 1, 1)
    rows = [(1, 1, t, "a", "x"), (2, 2, t + timedelta(minutes=10), "a", "x"), (3, 3, t + timedelta(days=2), "b", "x"), (4, 4, t + timedelta(days=4), "c", "x"), (5, 5, t + timedelta(days=6), "d", "y")]
    df = spark.createDataFrame(rows, "id long, rank int, ts timestamp, event_key string, bucket string")
    pick = lambda n: [r.id for r in curation.select_diverse(df, n).orderBy("place").collect()]
    assert pick(3) == [1, 3, 5] and pick(4) == [1, 3, 5, 4] and pick(9) == [1, 3, 5, 4, 2]


def test_daily_strategies(spark):
    rows = [photo(i, datetime(2020, 3, 6) + timedelta(days=i % 9, hours=i), 70 + i) for i in range(30)]
    df = spark.createDataFrame(rows, PHOTO)
    for name in ("random", "on_this_day", "smart"):
        got = curation.daily_selection(df, DAY, 4, name, seed=3).collect()
        assert sorted(r.place for r in got) == [1, 2, 3, 4] and len({r.id for r in got}) == 4
    hidden = spark.createDataFrame([(i,) for i in range(27)], "id long")
    assert {r.id for r in curation.daily_selection(df, DAY, 4, "random", exclude=hidden).collect()} == {27, 28, 29}
    assert curation.daily_selection(df, DAY, 4, "random", curation.Strategy(memory=999)).count() == 4
    for name in ("other", "event_curated"):
        with pytest.raises(ValueError):
            curation.daily_selection(df, DAY, 4, name)


def test_narrow_windows_come_before_the_rules(spark):
    near = [photo(i, datetime(2020, 3, 6, 10, i), 60 + i) for i in range(4)]  # one hour of one day
    far = [photo(10 + i, datetime(2010 + i, 3, 20), 99) for i in range(6)]
    df = spark.createDataFrame(near + far, PHOTO)
    assert {r.id for r in curation.daily_selection(df, DAY, 3, "on_this_day").collect()} == {3, 2, 1}  # the first window fills the list once the rules fall
    assert [r.id for r in curation.daily_selection(df, DAY, 5, "on_this_day").orderBy("place").collect()][0] == 3


def plain_diverse(rows, limit, how):
    """The greedy choice by plain loops over all rows."""
    rows, taken = sorted(rows, key=lambda r: (r[1], r[0])), []
    near = lambda a, b: a is not None and b is not None and abs(a - b) < timedelta(hours=how.time_gap_hours)
    for k in range(4):
        for i, _, ts, event, bucket in rows[: max(limit * how.pool_factor, 2 * limit, 6)]:
            if len(taken) == limit or any(t[0] == i for t in taken):
                continue
            bad = (k < 3 and any(near(ts, t[2]) for t in taken)) or (k < 2 and event and sum(t[3] == event for t in taken) >= how.per_event) or (k < 1 and bucket and sum(t[4] == bucket for t in taken) >= how.per_location)
            if not bad:
                taken.append((i, None, ts, event, bucket))
    return [t[0] for t in taken]


def test_diversity_is_the_plain_choice(spark):
    rng = random.Random(4)
    how = curation.Strategy(pool_factor=3, per_event=2)
    groups = {g: [(100 * g + k, rng.randrange(40), rng.choice([None, datetime(2020, 1, 1) + timedelta(hours=rng.randrange(200))]), rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"])) for k in range(rng.randrange(1, 60))] for g in range(12)}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g int, id long, rank int, ts timestamp, event_key string, bucket string")
    got = {}
    for r in curation.select_diverse(df, 5, how, "g").orderBy("place").collect():
        got.setdefault(r.g, []).append(r.id)
    assert got == {g: plain_diverse(rows, 5, how) for g, rows in groups.items()}
    assert [r.id for r in curation.select_diverse(df.where("g = 3").drop("g"), 5, how).orderBy("place").collect()] == got[3]


def test_event_curated(spark):
    t = datetime(2021, 3, 7)
    photos = spark.createDataFrame([photo(i, t - timedelta(days=3 * i), 80, beauty=70 + i, lat=10.0 + i, lon=10.0, event=i) for i in range(1, 7)], PHOTO)
    schema = "id long, start_time timestamp, end_time timestamp, photo_count int, cover_photo_id long, gps_latitude double, gps_longitude double, primary_category string, primary_tag string, event_score double, display_count int"
    events = spark.createDataFrame([(i, t - timedelta(days=3 * i), t, 3, i, 10.0 + i, 10.0, f"cat{i}", "tag", float(10 * i), 0) for i in range(1, 7)], schema)
    tags = spark.createDataFrame([], "photo_id long, tag string")
    got = curation.daily_selection(photos, DAY, 4, "event_curated", events=events, tags=tags).orderBy("place").collect()
    assert [r.place for r in got] == [1, 2, 3, 4] and got[0].id == max(r.id for r in got)  # the most beautiful first
    recent = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert {r.id for r in curation.daily_selection(photos, DAY, 4, "event_curated", events=events, tags=tags, recent=recent).collect()} == {6}
    # no event: as on this day
    day = lambda **k: sorted((r.id, r.place) for r in curation.daily_selection(photos, DAY, 4, **k).collect())
    assert day(strategy="event_curated", events=events.limit(0), tags=tags) == day(strategy="on_this_day")
    batch = curation.daily_batch(photos, DAY, 3, strategy="event_curated", events=events, tags=tags)
    assert [r.position for r in batch.orderBy("position").collect()] == [1, 2, 3]


def test_scores(spark):
    df = spark.createDataFrame([("x", datetime(2020, 3, 1), "family", "", 0, False), ("people_spotlight", datetime(2020, 4, 1), "acquaintance", "Cherry", 5, True)], "channel string, taken_at timestamp, category string, caption string, shown int, recent boolean")
    got = [r.s for r in df.select(curation.adjusted_score(F.lit(100.0), F.col("channel"), F.col("taken_at"), F.col("category"), [F.col("caption")], F.col("shown"), F.col("recent"), DAY).alias("s")).collect()]
    assert got == pytest.approx([100 * 1.3 + 60, (100 * 0.3 + 10 + 20) * 1.15 / 1.5])


def test_channels_and_selection(spark):
    t = datetime(2021, 3, 7)
    photos = spark.createDataFrame([photo(i, t - timedelta(days=3 * i), 80, lat=10.0 + i, lon=10.0, category="family" if i == 2 else "", event=i, caption="spring" if i == 3 else "") for i in range(1, 7)] + [photo(50, datetime(2019, 7, 1), beauty=95)], PHOTO)
    events = spark.createDataFrame([(i, t - timedelta(days=3 * i), t, 3, i, 10.0 + i, 10.0, "cat", "tag", float(10 * i), 0 if i != 4 else 2) for i in range(1, 7)], "id long, start_time timestamp, end_time timestamp, photo_count int, cover_photo_id long, gps_latitude double, gps_longitude double, primary_category string, primary_tag string, event_score double, display_count int")
    none = spark.createDataFrame([], "id long")
    tags = spark.createDataFrame([], "photo_id long, tag string")
    found = curation.nominate(events, photos, tags, none, none, DAY)
    channels = {r["channel"]: r["count"] for r in found.groupBy("channel").count().collect()}
    assert channels == {"time_tunnel": 2, "peak_memory": 6, "geo_drift": 6, "hidden_gem": 6, "people_spotlight": 1, "season_match": 1}
    assert found.where("photo_id = 50 and event_id is null").count() == 1
    chosen = curation.select_curated(found.withColumn("score", F.col("raw_score")), 5).orderBy("place").collect()
    assert len({r.photo_id for r in chosen}) == 5 and [r.channel for r in chosen][:2] == ["geo_drift", "hidden_gem"]
    less = curation.nominate(events, photos, tags, spark.createDataFrame([(6,)], "id long"), spark.createDataFrame([(5,)], "id long"), DAY)
    assert not {r.photo_id for r in less.collect()} & {5, 6}


def test_arrangement_and_playback(spark):
    df = spark.createDataFrame([(1, 90, 10, "b"), (2, 90, 99, "a"), (3, 50, 99, "c"), (4, 10, 20, "a")], "id long, beauty_score int, memory_score int, main_category string")
    assert [r.id for r in curation.arrange(df).orderBy("place").collect()] == [1, 4, 3, 2]
    items = spark.createDataFrame([(1, k, 10 * k) for k in (1, 2, 3)], "batch_id long, position int, photo_id long")
    served = spark.createDataFrame([(7, 1, 0), (8, 1, 4)], "device_id long, batch_id long, n long")
    assert sorted(tuple(r) for r in curation.served_item(items, served).collect()) == [(7, 10), (8, 20)]
