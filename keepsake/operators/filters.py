"""Predicates over photos, events, faces and jobs; each is a filter Catalyst can push to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import exprs as X

#: Columns a plain search looks at.
SEARCHED = ("file_name", "file_path", "description", "caption", "tags", "location", "main_category")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def active(photos: DataFrame) -> DataFrame:
    return photos.where("deleted_at is null and status = 'active'")


def under_path(path: Column, prefix: str) -> Column:
    """The folder itself or anything below it; never a folder whose name only begins alike."""
    prefix = X.clean_path(prefix)
    return path.startswith("/") if prefix == "/" else (path == prefix) | path.startswith(prefix + "/")


def under_paths(path: Column, prefixes: Sequence[str] | None) -> Column:
    """None: everything; an empty list: nothing."""
    return F.lit(True) if prefixes is None else any_of([under_path(path, p) for p in prefixes])


def matches_terms(columns: Sequence[Column], query: str) -> Column:
    """Every term as a whole word in some column."""
    return reduce(lambda a, b: a & b, [any_of([F.coalesce(X.token_text(c).contains(f" {t} "), F.lit(False)) for c in columns]) for t in X.search_terms(query)], F.lit(True))


def matches_text(columns: Sequence[Column], query: str) -> Column:
    """The query as a piece of some column, whatever its case."""
    return any_of([F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in columns])


def photo_filter(photos: DataFrame, tags: DataFrame | None = None, *, status: str = "active", paths: Sequence[str] | None = None, analyzed: bool | None = None, has_thumbnail: bool | None = None, has_gps: bool | None = None, location: str | None = None, search: str | None = None, whole_words: bool = False, category: str | None = None, tag: str | None = None) -> DataFrame:
    """The grid's filter: all given conditions hold; a tag is looked up by a semi-join."""
    found = photos.where("deleted_at is null")
    if status != "all":
        found = found.where(F.col("status") == status)
    if paths is not None:
        found = found.where(under_paths(F.col("file_path"), paths))
    if analyzed is not None:
        found = found.where(F.coalesce("ai_analyzed", F.lit(False)) == analyzed)
    if has_thumbnail is not None:
        found = found.where((F.coalesce("thumbnail_status", F.lit("")) == "ready") == has_thumbnail)
    if has_gps is not None:
        found = found.where((F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull()) == has_gps)
    if location:
        found = found.where(matches_text([F.col("location")], location))
    if search:
        look = matches_terms if whole_words else matches_text
        found = found.where(look([F.col(c) for c in SEARCHED], search))
    if category:
        found = found.where(F.col("main_category") == category)
    if tag and tags is not None:
        found = found.join(tags.where(F.col("tag") == tag).select(F.col("photo_id").alias("id")), "id", "left_semi")
    return found


def ready_to_analyze(photos: DataFrame) -> DataFrame:
    return active(photos).where("not coalesce(ai_analyzed, false) and thumbnail_status = 'ready'")


def taken_between(photos: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return active(photos).where(F.col("taken_at").between(F.lit(start), F.lit(end)))


def scored_at_least(photos: DataFrame, memory: int, beauty: int) -> DataFrame:
    return photos.where((F.col("memory_score") >= memory) & (F.col("beauty_score") >= beauty))


def excluding(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids.id``; unlike NOT IN, a null among the ids excludes nothing."""
    return rows.join(ids.select(F.col("id").alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def valid_events(events: DataFrame) -> DataFrame:
    return events.where("photo_count > 0 and cover_photo_id is not null")


def overlapping(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return events.where((F.col("start_time") <= F.lit(end)) & (F.col("end_time") >= F.lit(start)))


def with_keywords(rows: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    return rows.where(any_of([F.lower(column).contains(w.lower()) for w in words]))


#: Minutes to wait after so many retries; after more, the last.
BACKOFF = (0, 0, 1, 5, 15, 60)


def backoff_minutes(retries: Column) -> Column:
    """Waiting time before a face is tried again."""
    return F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.greatest(retries, F.lit(0)), F.lit(len(BACKOFF) - 1)) + 1)


def due_faces(faces: DataFrame, now: datetime) -> DataFrame:
    """Pending faces whose waiting time is over: the least tried first, those never clustered before others."""
    waited = X.minutes_between(F.col("clustered_at"), F.lit(now))
    due = faces.where("cluster_status = 'pending'").where(F.col("clustered_at").isNull() | (waited >= backoff_minutes(F.coalesce("retry_count", F.lit(0)))))
    return due.orderBy("retry_count", F.col("clustered_at").asc_nulls_first(), "id")


def low_confidence_faces(faces: DataFrame, least: float = 0.55) -> DataFrame:
    return faces.where((F.col("cluster_score") < least) & F.col("person_id").isNotNull() & ~F.coalesce("manual_locked", F.lit(False)))


def find_people(people: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return people.where(F.lower("name").contains(q) | F.lower("category").contains(q) | F.col("id").cast("string").contains(q))


def device_online(last_seen: Column, now: datetime, minutes: int = 5) -> Column:
    """Whether the device was seen in the last minutes; never seen is offline."""
    return F.coalesce(X.minutes_between(last_seen, F.lit(now)) < minutes, F.lit(False))


def lock_free(locked_until: Column, now: datetime) -> Column:
    return locked_until.isNull() | (locked_until < F.lit(now))


def needs_thumbnail(photos: DataFrame) -> DataFrame:
    return active(photos).where("thumbnail_status is null or thumbnail_status in ('', 'none', 'pending', 'failed')")


def needs_geocode(photos: DataFrame) -> DataFrame:
    return active(photos).where(X.valid_gps(F.col("gps_latitude"), F.col("gps_longitude"))).where("coalesce(trim(location), '') = ''")


def on_date(rows: DataFrame, column: str, day: str) -> DataFrame:
    return rows.where(F.to_date(column) == F.to_date(F.lit(day)))


def page(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a totally ordered list; sizes are kept between 1 and 200."""
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_after(rows: DataFrame, key: str, cursor: int, size: int) -> DataFrame:
    """The next page by key, without an offset."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(size)
