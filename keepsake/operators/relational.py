"""Joins, aggregates, windows and set operations over the photo tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.operators import filters as P

#: Columns a grid may be sorted by; anything else means the first.
SORTABLE = ("taken_at", "created_at", "overall_score", "beauty_score", "memory_score", "file_name")


def photos_of_person(photos: DataFrame, faces: DataFrame, person_id: int) -> DataFrame:
    """Photos with a face of the person; a semi-join, so nothing has to be made distinct."""
    return P.active(photos).join(faces.where(F.col("person_id") == person_id).select(F.col("photo_id").alias("id")), "id", "left_semi").orderBy(F.desc("taken_at"), F.desc("id"))


def top_person_category(photos: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """(id, face_count, top_person_category): faces of each photo and its most important person's category.

    Faces are counted by photo before they meet the photos, so a photo's row crosses the network once.
    """
    known = faces.join(people.select(F.col("id").alias("person_id"), "category"), "person_id", "left")
    by_photo = known.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("n"), F.max(X.category_rank(F.col("category"))).alias("rank"))
    names = {v: k for k, v in X.CATEGORY_RANK.items()}
    return photos.select("id").join(by_photo, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("face_count"), X.lookup(F.coalesce("rank", F.lit(0)), names, F.lit("")).alias("top_person_category"))


def people_events(events: DataFrame, photos: DataFrame, exclude: DataFrame, names: Sequence[str], limit: int) -> DataFrame:
    """Events whose photos show family or friends, then those whose tag names people, up to a limit."""
    real = photos.where(F.col("top_person_category").isin("family", "friend")).groupBy(F.col("event_id").alias("id")).agg(F.max(X.category_rank(F.col("top_person_category"))).alias("rank"), F.count("*").alias("n"))
    pool = P.excluding(P.valid_events(events), exclude)
    first = pool.join(real, "id").select(*[pool[c] for c in pool.columns], F.lit(0).alias("tier"), "rank", "n")
    second = pool.join(real, "id", "left_anti").where(F.col("primary_tag").isin(*names)).select("*", F.lit(1).alias("tier"), F.lit(0).alias("rank"), F.lit(0).alias("n"))
    return first.unionByName(second).orderBy("tier", F.desc("rank"), F.desc("n"), F.desc("event_score"), "id").limit(limit)


def season_events(events: DataFrame, photos: DataFrame, tags: DataFrame, words: Sequence[str], exclude: DataFrame, limit: int) -> DataFrame:
    """Events with a photo whose tag or caption holds a season's word."""
    by_tag = P.with_keywords(tags, "tag", words).select(F.col("photo_id").alias("id"))
    hit = photos.join(by_tag, "id", "left_semi").select("event_id").union(P.with_keywords(photos, "caption", words).select("event_id")).distinct()
    return P.excluding(P.valid_events(events), exclude).join(hit.select(F.col("event_id").alias("id")), "id", "left_semi").orderBy(F.desc("event_score"), "id").limit(limit)


def never_displayed(photos: DataFrame, displays: DataFrame) -> DataFrame:
    return photos.join(displays.select(F.col("photo_id").alias("id")).distinct(), "id", "left_anti")


def headers_without_pending(headers: DataFrame, items: DataFrame) -> DataFrame:
    return headers.join(items.where("status = 'pending'").select(F.col("suggestion_id").alias("id")), "id", "left_anti")


def tags_by_photo(tags: DataFrame) -> DataFrame:
    return tags.groupBy("photo_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def batch_tree(batches: DataFrame, items: DataFrame, photos: DataFrame) -> DataFrame:
    """Batches with their items and the items' photos as a nested list, by two joins instead of a query each."""
    full = items.join(photos.select(F.col("id").alias("photo_id"), "file_path", "caption"), "photo_id", "left")
    nested = full.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("position", "photo_id", "file_path", "caption"))).alias("items"))
    return batches.join(nested, batches["id"] == nested["batch_id"], "left").drop("batch_id")


def conditional_counts(photos: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Ten counts of a folder's photos in one pass."""
    def has(column: str) -> Column:
        return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))

    live, gps = F.col("status") == "active", X.valid_gps(F.col("gps_latitude"), F.col("gps_longitude"))
    return photos.where("deleted_at is null").groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(F.col("status") == "excluded").alias("excluded"),
        F.count_if(live & F.col("ai_analyzed")).alias("analyzed"), F.count_if(live & ~F.coalesce("ai_analyzed", F.lit(False))).alias("unanalyzed"),
        F.count_if(live & (F.col("thumbnail_status") == "ready")).alias("thumbnails"), F.count_if(live & gps).alias("with_gps"),
        F.count_if(live & gps & has("location")).alias("geocoded"), F.count_if(live & (F.col("face_count") > 0)).alias("with_faces"), F.count_if(live & has("caption")).alias("captioned"),
    )


def counts_by_prefix(photos: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """``conditional_counts`` of many folders in one pass; the first prefix that fits takes the photo, none is left out."""
    label = F.lit(None).cast("string")
    for p in reversed(prefixes):
        label = F.when(P.under_path(F.col("file_path"), p), F.lit(p)).otherwise(label)
    counted = conditional_counts(photos.withColumn("prefix", label).where("prefix is not null"), ["prefix"])
    named = photos.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(prefixes)], "prefix string")
    return named.join(counted, "prefix", "left").na.fill(0)


def counts_desc(rows: DataFrame, column: str, limit: int | None = None, like: str | None = None) -> DataFrame:
    """Non-empty values with their counts, most frequent first, then by value."""
    found = rows.where(F.length(F.trim(column)) > 0)
    if like:
        found = found.where(F.lower(column).contains(like.lower()))
    counted = found.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counted.limit(limit) if limit else counted


def status_counts(jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """A histogram of job states as one row of columns."""
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def person_stats(faces: DataFrame) -> DataFrame:
    return faces.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("face_count"), F.countDistinct("photo_id").alias("photo_count"))


def face_stats(faces: DataFrame) -> DataFrame:
    return faces.agg(F.count_if(F.col("cluster_status") == "pending").alias("pending"), F.count_if((F.col("cluster_status") == "pending") & F.col("clustered_at").isNull()).alias("never_clustered"), F.count_if(F.col("person_id").isNotNull()).alias("assigned"))


def system_stats(photos: DataFrame) -> DataFrame:
    return P.active(photos).agg(F.count("*").alias("photos"), F.count_if(F.col("ai_analyzed")).alias("analyzed"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def queue_pressure(waiting: Column) -> Column:
    return F.when(waiting < 100, "low").when(waiting >= 1000, "high").otherwise("normal")


def home_base(photos: DataFrame) -> DataFrame:
    """The city with most located photos and their mean place; soft-deleted rows count, as before."""
    located = photos.where(X.valid_gps(F.col("gps_latitude"), F.col("gps_longitude"))).where(F.length(F.trim("city")) > 0)
    return located.groupBy("city").agg(F.avg("gps_latitude").alias("lat"), F.avg("gps_longitude").alias("lon"), F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(1)


def display_counts(displays: DataFrame, by: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    shown = displays
    if start is not None:
        shown = shown.where(F.col("displayed_at") >= F.lit(start))
    if end is not None:
        shown = shown.where(F.col("displayed_at") < F.lit(end))
    return shown.groupBy(by).agg(F.count("*").alias("n"))


def recently_displayed(displays: DataFrame, now: datetime, days: int, device_id: int | None = None) -> DataFrame:
    """Distinct photo ids shown in the last days, on one device or any."""
    recent = displays.where(F.col("displayed_at") >= F.lit(now) - F.make_interval(days=F.lit(days)))
    return (recent if device_id is None else recent.where(F.col("device_id") == device_id)).select(F.col("photo_id").alias("id")).distinct()


def device_counts(devices: DataFrame, now: datetime) -> DataFrame:
    online = P.device_online(F.col("last_seen"), now)
    return devices.groupBy("device_type").agg(F.count("*").alias("total"), F.count_if(online).alias("online"), F.count_if(~online).alias("offline"))


def suggestion_rollup(items: DataFrame) -> DataFrame:
    return items.where("status = 'pending'").groupBy("suggestion_id").agg(F.count("*").alias("candidates"), F.max("similarity").alias("top_similarity"))


def with_total(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page with the whole list's count on every row: an aggregate beside the top-k, no one-task window."""
    total = rows.agg(F.count("*").alias("total"))
    return P.page(rows, order, number, size).join(F.broadcast(total))


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n of each group; Spark cuts groups down before the shuffle as well."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def prototype_candidates(faces: DataFrame, n: int = 10) -> DataFrame:
    order = [F.col("manual_locked").desc(), F.col("quality_score").desc(), F.col("confidence").desc(), F.col("id")]
    return top_per_group(faces.where("person_id is not null"), "person_id", order, n)


def neighbours(rows: DataFrame, key: str, row_id: int) -> DataFrame:
    """(previous, next): the ids around one row in (key, id) order, by two keyset look-ups; null keys have none."""
    at = rows.where(F.col("id") == row_id).select(F.col(key).alias("k"), F.col("id").alias("i"))
    joined = rows.join(F.broadcast(at))
    before = joined.where((F.col(key) < F.col("k")) | ((F.col(key) == F.col("k")) & (F.col("id") < F.col("i"))))
    after = joined.where((F.col(key) > F.col("k")) | ((F.col(key) == F.col("k")) & (F.col("id") > F.col("i"))))
    return before.agg(F.max(F.struct(key, "id"))["id"].alias("previous")).join(after.agg(F.min(F.struct(key, "id"))["id"].alias("next")))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def sorted_photos(photos: DataFrame, by: str, descending: bool = True, number: int = 1, size: int = 20) -> DataFrame:
    column = F.col(by if by in SORTABLE else SORTABLE[0])
    return P.page(photos, [column.desc() if descending else column.asc(), F.desc("id")], number, size)


def top_weighted(photos: DataFrame, limit: int) -> DataFrame:
    score = X.weighted_score(F.col("overall_score"), F.col("top_person_category"))
    return photos.withColumn("weighted", score).orderBy(F.desc("weighted"), F.desc("overall_score"), F.desc("taken_at"), "id").limit(limit)


def random_sample(photos: DataFrame, limit: int, seed: int) -> DataFrame:
    """As many photos in an order that seed and id decide, so it is repeatable however rows are dealt."""
    return photos.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(limit)


def farthest_events(events: DataFrame, lat: float, lon: float, limit: int) -> DataFrame:
    far = X.flat_distance2(F.col("gps_latitude"), F.col("gps_longitude"), lat, lon)
    return P.valid_events(events).where("gps_latitude is not null and gps_longitude is not null").withColumn("far", far).orderBy(F.desc("far"), "id").limit(limit)


def people_list(people: DataFrame) -> DataFrame:
    return people.orderBy(X.category_rank(F.col("category")).desc(), F.desc("face_count"), "id")


def queue_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("priority"), F.coalesce("last_requested_at", "queued_at").desc(), "queued_at", "id")


def first_of_union(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """An ordered union that keeps the first row of each key: earlier parts first, then by ``order``."""
    numbered = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    joined = numbered[0]
    for p in numbered[1:]:
        joined = joined.unionByName(p)
    return latest_per_key(joined, [key], [F.col("_part"), F.col(order)]).orderBy("_part", order).drop("_part")


def outermost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Folders that lie below no other folder of the list.

    Each folder looks up its own ancestors by equality, so the work grows with depth and not with pairs.
    """
    known = paths.select(F.col(path).alias("p")).distinct()
    parts = F.split("p", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = known.where(F.size(parts) > 1).select("p", F.explode(ancestors).alias("up")).where("up <> '' and up <> p")
    inner = above.join(known.select(F.col("p").alias("up")), "up", "left_semi").select("p").distinct()
    return known.join(inner, "p", "left_anti").select(F.col("p").alias(path))
