"""State as sets: queues, leases of work, results and settings as (state, commands) -> new state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.operators import relational as R

ACTIVE = ("pending", "processing")


def claim(jobs: DataFrame, n: int, now: datetime) -> DataFrame:
    """The queue with its n foremost pending jobs taken into work."""
    taken = R.queue_order(jobs.where("status = 'pending'")).limit(n).select("id", F.lit(True).alias("_t"))
    joined = jobs.join(F.broadcast(taken), "id", "left")
    return joined.withColumns({"status": F.when(F.col("_t"), "processing").otherwise(F.col("status")), "updated_at": F.when(F.col("_t"), F.lit(now)).otherwise(F.col("updated_at")), "attempt_count": F.col("attempt_count") + F.coalesce(F.col("_t").cast("int"), F.lit(0))}).select(*jobs.columns)


def recover(jobs: DataFrame, now: datetime, stale_minutes: int) -> DataFrame:
    """Jobs in work for too long are pending again."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < F.lit(now - timedelta(minutes=stale_minutes)))
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def interrupt(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "interrupted").otherwise(F.col("status")))


def cancel(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "pending", "cancelled").otherwise(F.col("status")))


def drop_finished(jobs: DataFrame, before: datetime) -> DataFrame:
    return jobs.where(~(~F.col("status").isin(*ACTIVE) & (F.col("updated_at") < F.lit(before))))


def enqueue(jobs: DataFrame, wanted: DataFrame, now: datetime) -> DataFrame:
    """Add photos to the queue; one with an active job only gets its priority and request time raised.

    ``wanted``: photo_id, priority, source. New jobs have a null id until they are stored.
    """
    asked = wanted.groupBy("photo_id").agg(F.max("priority").alias("_p"), F.max_by("source", "priority").alias("_s"))
    joined = jobs.join(asked, "photo_id", "left")
    bump = F.col("_p").isNotNull() & F.col("status").isin(*ACTIVE)
    kept = joined.withColumns({"priority": F.when(bump, F.greatest("priority", "_p")).otherwise(F.col("priority")), "last_requested_at": F.when(bump, F.lit(now)).otherwise(F.col("last_requested_at"))}).select(*jobs.columns)
    new = asked.join(jobs.where(F.col("status").isin(*ACTIVE)).select("photo_id"), "photo_id", "left_anti")
    made = {"photo_id": F.col("photo_id"), "status": F.lit("pending"), "priority": F.col("_p"), "source": F.col("_s"), "queued_at": F.lit(now), "last_requested_at": F.lit(now), "updated_at": F.lit(now), "attempt_count": F.lit(0)}
    types = dict(jobs.dtypes)
    return kept.unionByName(new.select(*[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in jobs.columns]))


def seed(photos: DataFrame, jobs: DataFrame) -> DataFrame:
    """Photos that need work and have no active job."""
    return photos.join(jobs.where(F.col("status").isin(*ACTIVE)).select(F.col("photo_id").alias("id")), "id", "left_anti")


def apply_results(photos: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos with results, report): the newest valid result of each photo that is known and not analyzed yet.

    The report has one row a result: photo_id, verdict (accepted, superseded, invalid, unknown, already).
    """
    ok = X.valid_result(F.col("photo_id"), F.col("description"), F.col("memory_score"), F.col("beauty_score"))
    tagged = results.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    newest = R.latest_per_key(tagged.where("_ok"), ["photo_id"], [F.desc("enqueued_at"), F.desc("retry_count"), F.desc("description")])
    known = photos.select(F.col("id").alias("photo_id"), F.coalesce("ai_analyzed", F.lit(False)).alias("_done"))
    judged = tagged.join(known, "photo_id", "left").join(newest.select("photo_id", F.col("enqueued_at").alias("_newest")), "photo_id", "left")
    verdict = F.when(~F.col("_ok"), "invalid").when(F.col("_done").isNull(), "unknown").when(F.col("_done"), "already").when(F.col("enqueued_at") < F.col("_newest"), "superseded").otherwise("accepted")
    report = judged.select("photo_id", "enqueued_at", verdict.alias("verdict"))
    new = newest.select(F.col("photo_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("description", "memory_score", "beauty_score", "main_category", "tags")])
    joined = photos.join(new, "id", "left")
    fresh = F.col("_description").isNotNull() & ~F.coalesce("ai_analyzed", F.lit(False))
    changed = {c: F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("description", "memory_score", "beauty_score", "main_category", "tags")}
    changed["overall_score"] = F.when(fresh, X.overall_score(F.col("_memory_score"), F.col("_beauty_score"))).otherwise(F.col("overall_score"))
    out = joined.withColumns(changed | {"ai_analyzed": F.coalesce("ai_analyzed", F.lit(False)) | fresh})
    return out.select(*photos.columns), report


def resync_tags(tags: DataFrame, photos: DataFrame) -> DataFrame:
    """The tag table with the given photos' rows written anew from their tag texts."""
    fresh = photos.select(F.col("id").alias("photo_id"), F.explode(X.split_tags(F.col("tags"))).alias("tag"))
    return tags.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_anti").select("photo_id", "tag").unionByName(fresh)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``table`` replaced by those of ``changes`` with the same keys, and the new ones added."""
    return table.join(changes.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def replace_detections(faces: DataFrame, detected: DataFrame) -> DataFrame:
    """Faces of newly examined photos replaced as a whole; a photo with no face has a row with a null id."""
    return faces.join(detected.select("photo_id").distinct(), "photo_id", "left_anti").select(*faces.columns).unionByName(detected.where("id is not null").select(*faces.columns))


def replace_suggestions(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """New suggestions of some targets: their pending ones become obsolete, as do pending ones of the same candidates.

    Columns: target, candidate, similarity, status.
    """
    pending = F.col("status") == "pending"
    marks = state.join(fresh.select("target", F.lit(True).alias("_t")).distinct(), "target", "left").join(fresh.select("candidate", F.lit(True).alias("_c")).distinct(), "candidate", "left")
    old = marks.withColumn("status", F.when(pending & (F.col("_t").isNotNull() | F.col("_c").isNotNull()), "obsolete").otherwise(F.col("status")))
    return old.select(*state.columns).unionByName(fresh.withColumn("status", F.lit("pending")).select(*state.columns))


def review(suggestions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Apply review actions (target, candidate, action, at): the first one counts; a merged candidate's others are obsolete."""
    first = R.latest_per_key(reviews, ["target", "candidate"], [F.col("at"), F.col("action")]).select("target", "candidate", F.when(F.col("action") == "apply", "applied").otherwise("dismissed").alias("_s"))
    done = suggestions.join(first, ["target", "candidate"], "left").withColumn("status", F.when(F.col("status") == "pending", F.coalesce("_s", "status")).otherwise(F.col("status")))
    merged = done.where("status = 'applied'").select("candidate", F.lit(True).alias("_m")).distinct()
    return done.join(merged, "candidate", "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("_m"), "obsolete").otherwise(F.col("status"))).select(*suggestions.columns)


def repair_geocode_status(photos: DataFrame) -> DataFrame:
    """Photos with a place count as geocoded, those with coordinates only as pending, others as none."""
    named, located = F.coalesce(F.trim("location") != "", F.lit(False)), X.valid_gps(F.col("gps_latitude"), F.col("gps_longitude"))
    return photos.withColumn("geocode_status", F.when(named, "ready").when(located, "pending").otherwise("none"))


def set_where(rows: DataFrame, ids: DataFrame, key: str = "id", **values: Column) -> DataFrame:
    """Columns set on the rows whose key is among ``ids.id``."""
    marked = rows.join(ids.select(F.col("id").alias(key), F.lit(True).alias("_m")).distinct(), key, "left")
    return marked.withColumns({c: F.when(F.col("_m"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def display_counters(events: DataFrame, displays: DataFrame, photos: DataFrame) -> DataFrame:
    """Events with display counts and last times derived from the display facts instead of incremented."""
    shown = displays.join(photos.select(F.col("id").alias("photo_id"), "event_id"), "photo_id").groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("_n"), F.max("displayed_at").alias("_t"))
    keep = [c for c in events.columns if c not in ("display_count", "last_displayed_at")]
    return events.join(shown, "id", "left").select(*keep, F.coalesce("_n", F.lit(0)).cast("int").alias("display_count"), F.col("_t").alias("last_displayed_at"))


def lock_photos(photos: DataFrame, n: int, now: datetime, minutes: int = 30) -> DataFrame:
    """Photos with the n foremost (by id) that are ready and not locked taken for analysis until a time."""
    free = photos.where("not coalesce(ai_analyzed, false) and thumbnail_status = 'ready'").where(F.col("locked_until").isNull() | (F.col("locked_until") < F.lit(now)))
    taken = free.orderBy("id").limit(n).select("id")
    return set_where(photos, taken, locked_until=F.lit(now + timedelta(minutes=minutes)))


def analyzer_stats(photos: DataFrame, now: datetime) -> DataFrame:
    """One row: total, analyzed, locked, waiting, and how full the queue is."""
    done = F.coalesce("ai_analyzed", F.lit(False))
    locked = ~done & (F.col("locked_until") >= F.lit(now))
    ready = ~done & (F.col("thumbnail_status") == "ready") & ~F.coalesce(F.col("locked_until") >= F.lit(now), F.lit(False))
    out = photos.agg(F.count("*").alias("total"), F.count_if(done).alias("analyzed"), F.count_if(locked).alias("locked"), F.count_if(ready).alias("waiting"))
    return out.withColumn("pressure", R.queue_pressure(F.col("waiting")))


def link_apart(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table of people declared different with more pairs, the smaller id first, each once."""
    both = links.select("person_id_a", "person_id_b").unionByName(pairs.select("person_id_a", "person_id_b")).where("person_id_a <> person_id_b")
    return both.select(F.least("person_id_a", "person_id_b").alias("person_id_a"), F.greatest("person_id_a", "person_id_b").alias("person_id_b")).distinct()


def retry(failed: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(to be stored again, given up): failed results with one more try."""
    again = failed.withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + 1)
    return again.where(F.col("retry_count") <= most), again.where(F.col("retry_count") > most)
