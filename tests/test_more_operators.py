"""Reclustering, stored batches, folder snapshots, locks and retries."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from keepsake.operators import curation, jobs, people
from keepsake.sources import files
from test_curation import PHOTO, photo

NOW = datetime(2024, 1, 30, 12)


def test_recluster_moves_doubtful_faces(spark):
    v = {1: [1.0, 0.0], 2: [1.0, 0.1], 3: [0.0, 1.0], 4: [0.1, 1.0], 5: [0.9, 0.1], 6: [-1.0, -1.0]}
    rows = [(i, i, 1 if i in (1, 2) else 2, x, "assigned", 0.9 if i < 5 else 0.4, i in (1, 3), 0) for i, x in v.items()]
    df = spark.createDataFrame(rows, "id long, photo_id long, person_id long, embedding array<double>, cluster_status string, cluster_score double, manual_locked boolean, retry_count int").withColumn("quality_score", F.lit(0.5)).withColumn("confidence", F.lit(0.5))
    got = {r.id: (r.person_id, r.cluster_status) for r in people.recluster(df).collect()}
    assert got == {1: (1, "assigned"), 2: (1, "assigned"), 3: (2, "assigned"), 4: (2, "assigned"), 5: (1, "assigned"), 6: (2, "assigned")}


def test_pair_similarity(spark):
    protos = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "person_id long, v array<double>")
    r = people.pair_similarity(protos, spark.createDataFrame([(1, 2)], "a long, b long")).first()
    assert (r.similarity, r.best) == ((0.5 + 1.0) / 2, 1.0)


def test_daily_batch_is_stored_by_day(spark, tmp_path):
    df = spark.createDataFrame([photo(i, datetime(2020, 3, 6) + timedelta(days=3 * i), 70 + i, caption="Lake" if i == 1 else "") for i in range(6)], PHOTO)
    for day in (date(2024, 3, 6), date(2024, 3, 7), date(2024, 3, 6)):
        curation.store_batch(curation.daily_batch(df, day, 3), f"{tmp_path}/batches")
    got = spark.read.parquet(f"{tmp_path}/batches")
    assert {r["batch_date"]: r["count"] for r in got.groupBy("batch_date").count().collect()} == {date(2024, 3, 6): 3, date(2024, 3, 7): 3}
    assert {r.title for r in got.collect()} <= {"Lake", *map(str, range(6))}


def test_changed_folders(spark):
    schema = "path string, mod_time long"
    was = spark.createDataFrame([("/a", 1), ("/a/b", 1), ("/a/c/d", 1), ("/e", 1), ("/e/f", 1)], schema)
    now = spark.createDataFrame([("/a", 1), ("/a/b", 2), ("/a/b/new", 1), ("/e", 1), ("/g", 1)], schema)
    assert sorted(r.path for r in files.changed_folders(was, now).collect()) == ["/a", "/e", "/g"]
    called = files.in_batches(now.repartition(2), ["path"], lambda rows: [(len(rows), min(r[0] for r in rows)), (0, "")], "n int, first string", 2).collect()
    assert sum(r.n for r in called) == 5 and max(r.n for r in called) == 2 and sum(r.n == 0 for r in called) == len(called) / 2


def test_locks_links_and_retries(spark):
    df = spark.createDataFrame([(1, False, "ready", None), (2, False, "ready", NOW + timedelta(1)), (3, True, "ready", None), (4, False, "ready", NOW - timedelta(1)), (5, None, "failed", None)], "id long, ai_analyzed boolean, thumbnail_status string, locked_until timestamp")
    assert tuple(jobs.analyzer_stats(df, NOW).first()) == (5, 1, 1, 2, "low")
    assert [r.id for r in jobs.lock_photos(df, 1, NOW).where(F.col("locked_until") > F.lit(NOW)).orderBy("id").collect()] == [1, 2]
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "person_id_a long, person_id_b long")
    assert [tuple(r) for r in jobs.link_apart(pairs.limit(0), pairs).collect()] == [(1, 2)]
    again, over = jobs.retry(spark.createDataFrame([(1, None), (2, 3)], "photo_id long, retry_count int"))
    assert [(r.photo_id, r.retry_count) for r in again.collect()] == [(1, 1)] and [r.photo_id for r in over.collect()] == [2]


def test_attaching_looks_at_three_blocks_and_finds_the_nearest(spark):
    import random
    from datetime import datetime, timedelta

    from keepsake.operators import events

    rng, base = random.Random(3), datetime(2024, 1, 1)

    def spans(n, first):
        starts = [(base + timedelta(minutes=rng.choice([rng.randrange(60_000), 30_000]))) for _ in range(n)]
        return [(first + k, s, s + timedelta(minutes=rng.choice([0, 5, 300, 9_000]))) for k, s in enumerate(starts)]

    new, old = spans(150, 1000), spans(200, 1)
    old.append((999, base, None))
    pad, mid = timedelta(hours=6), lambda r: (r[1].timestamp() + r[2].timestamp()) / 2
    want = {}
    for c in new:
        met = [e for e in old if e[2] and c[1] <= e[2] + pad and c[2] >= e[1] - pad]
        if met:
            want[c[0]] = min(met, key=lambda e: (abs(mid(c) - mid(e)), e[0]))[0]
    df = lambda rows: spark.createDataFrame(rows, "id long, start_time timestamp, end_time timestamp")
    for block in (8, 65_536):
        assert {r.cluster: r.event for r in events.attach(df(new), df(old), block=block).collect()} == want
    both = df(new + old)  # two sides of one table
    assert {r.cluster: r.event for r in events.attach(both.where("id >= 1000"), both.where("id < 1000"), block=50).collect()} == want
    assert events.attach(df(new), df(old[:0])).count() == 0 == events.attach(df(new[:0]), df(old)).count()
