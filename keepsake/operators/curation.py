"""The daily selection: on this day, six channels of events, score adjustments and diverse picks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.operators import filters as P
from keepsake.operators import relational as R


@dataclass(frozen=True)
class Strategy:
    """Knobs of the selection."""

    windows: tuple[int, ...] = (3, 7, 30)
    pool_factor: int = 5
    time_gap_hours: int = 24
    per_event: int = 1
    per_location: int = 2
    location_km: float = 3.0
    memory: int = 70
    beauty: int = 70
    season_boost: float = 1.3
    freshness_penalty: float = 0.3
    people_bonus: float = 20.0
    display_decay: float = 0.1
    gem_beauty: int = 80
    limits: dict = field(default_factory=lambda: {"time_tunnel": 30, "peak_memory": 20, "geo_drift": 10, "hidden_gem": 20, "scattered": 20, "people_spotlight": 10, "season_match": 10})


def month_day_window(day: date, days: int) -> tuple[str, str]:
    return (day - timedelta(days=days)).strftime("%m-%d"), (day + timedelta(days=days)).strftime("%m-%d")


def pool_size(limit: int, how: Strategy) -> int:
    """Candidates that a selection of ``limit`` chooses from."""
    return max(limit * how.pool_factor, max(2 * limit, 6))


def on_this_day(photos: DataFrame, day: date, limit: int, how: Strategy = Strategy(), exclude: DataFrame | None = None, without_year: int | None = None) -> DataFrame:
    """Candidates around a day in any year, with ``window_tier``, the narrowest window that gives them, and ``weighted``.

    Each window gives its best by score, a pool of them; wider ones hold narrower ones, so a photo may first
    come with a window wider than its own. Only if no window has any, the best of all days follow (tier: the
    number of windows); if there are none either, those below the thresholds and of the excluded as well.
    Every list is a top-k of its own query; what is put together has at most so many pools.
    """
    pool = pool_size(limit, how)
    ready = P.active(photos).where("ai_analyzed").withColumn("weighted", X.weighted_score(F.col("overall_score"), F.col("top_person_category")))
    if without_year:
        ready = ready.where(F.year("taken_at") != without_year)
    found = P.scored_at_least(ready, how.memory, how.beauty)
    if exclude is not None:
        found = P.excluding(found, exclude)
    lists = [found.where(X.in_month_days(F.col("taken_at"), *month_day_window(day, days))) for days in how.windows]
    lists += [found, P.scored_at_least(ready, 0, 0)]
    tops = [rows.orderBy(F.desc("weighted"), F.desc("overall_score"), F.desc("taken_at"), "id").limit(pool).withColumn("window_tier", F.lit(k)) for k, rows in enumerate(lists)]
    first = R.latest_per_key(fold(DataFrame.unionByName, tops), ["id"], [F.col("window_tier")])
    kind = F.greatest(F.col("window_tier") - (len(how.windows) - 1), F.lit(0))
    least = first.agg(F.min(kind).alias("_kind"))
    near, gap = (F.when(F.col("window_tier") < len(how.windows), c) for c in (X.day_distance(F.col("taken_at"), day.month, day.day), X.year_gap(F.col("taken_at"), day.year)))
    order = [near, gap, F.desc("weighted"), F.desc("overall_score"), F.desc("memory_score"), F.desc("taken_at"), F.col("id")]
    told = first.join(F.broadcast(least), kind == F.col("_kind")).drop("_kind")
    return told.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def select_diverse(ranked: DataFrame, limit: int, how: Strategy = Strategy(), group: str | None = None) -> DataFrame:
    """Pick ``limit`` of each group's ranked rows, few of a time, an event and a place; rules fall one by one.

    ``ranked``: id, rank, ts, event_key, bucket (nulls restrict nothing). Choices depend on earlier ones, so a
    group is one call, on its first rows alone: a pool of them is enough, since without rules any row is taken.
    With a column tier, rows come in tiers of a pool at most (``on_this_day``): the first tiers that fill the
    list decide, else those that fill most of it.
    """
    key, size = group or "_all", pool_size(limit, how)
    gap = pd.Timedelta(hours=how.time_gap_hours)

    def chosen_of(rows: pd.DataFrame) -> list[int]:
        """Places in ``rows``, the first of which are the pool."""
        taken: list[int] = []

        def admissible(i: int, place: bool, event: bool, time: bool) -> bool:
            mine, got = rows.loc[i], rows.loc[taken]
            if time and how.time_gap_hours > 0 and pd.notna(mine.ts) and ((got.ts - mine.ts).abs() < gap).any():
                return False
            if event and how.per_event > 0 and mine.event_key and (got.event_key == mine.event_key).sum() >= how.per_event:
                return False
            return not (place and how.per_location > 0 and mine.bucket and (got.bucket == mine.bucket).sum() >= how.per_location)

        for rules in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
            for i in range(min(len(rows), size)):
                if len(taken) < limit and i not in taken and admissible(i, *rules):
                    taken.append(i)
        return taken

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows.iloc[:0]
        for tier in sorted(rows["tier"].unique()):
            own = rows[rows["tier"] <= tier].sort_values(["rank", "id"]).reset_index(drop=True)
            taken = chosen_of(own)
            if len(taken) > len(best):
                best = own.loc[taken]
            if len(best) >= limit:
                break
        return pd.DataFrame({key: best[key], "id": best["id"], "place": range(1, len(best) + 1)})

    if "tier" in ranked.columns:
        rows = ranked
    elif group:
        rows = R.top_per_group(ranked.withColumnRenamed("rank", "_rank"), group, [F.col("_rank"), F.col("id")], size).withColumn("tier", F.lit(0))
    else:
        rows = ranked.orderBy("rank", "id").limit(size).withColumn("tier", F.lit(0))
    rows = rows if group else rows.withColumn("_all", F.lit(0))
    types = dict(rows.dtypes)
    chosen = rows.select(key, "id", "rank", "ts", "event_key", "bucket", "tier").groupBy(key).applyInPandas(pick, f"{key} {types[key]}, id {types['id']}, place int")
    return chosen if group else chosen.drop("_all")


def cover_candidates(events: DataFrame, photos: DataFrame, channel: str, exclude: DataFrame) -> DataFrame:
    """Events as candidates: their cover photo, if it is active and not excluded."""
    covers = P.excluding(P.active(photos), exclude).select(F.col("id").alias("cover_photo_id"), "taken_at", "caption", "tags", "top_person_category")
    return events.join(covers, "cover_photo_id").select(F.lit(channel).alias("channel"), F.col("cover_photo_id").alias("photo_id"), F.col("id").alias("event_id"), "taken_at", "caption", "tags", "top_person_category", "primary_category", "display_count", F.col("event_score").cast("double").alias("raw_score"))


def nominate(events: DataFrame, photos: DataFrame, tags: DataFrame, recent: DataFrame, excluded: DataFrame, day: date, how: Strategy = Strategy(), people_tags: Sequence[str] = ("人物", "家庭", "孩子")) -> DataFrame:
    """Candidates of all six channels; events shown recently are in none, photos excluded neither."""
    pool = P.excluding(P.valid_events(events), recent)
    top = lambda df, n: df.orderBy(F.desc("event_score"), "id").limit(n)
    home = R.home_base(photos).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    far = F.pow(F.col("gps_latitude") - F.col("_lat"), 2) + F.pow((F.col("gps_longitude") - F.col("_lon")) * F.cos(F.radians("_lat")), 2)
    drift = pool.join(F.broadcast(home)).where("gps_latitude is not null").withColumn("_far", far).orderBy(F.desc("_far"), "id").limit(how.limits["geo_drift"])
    words = X.SEASON_WORDS[["winter", "spring", "summer", "autumn"][day.month % 12 // 3]]
    channels = {
        "time_tunnel": top(pool.where(X.in_month_days(F.col("start_time"), *month_day_window(day, how.windows[1]))), how.limits["time_tunnel"]),
        "peak_memory": top(pool, how.limits["peak_memory"]),
        "geo_drift": drift,
        "hidden_gem": top(pool.where("coalesce(display_count, 0) = 0"), how.limits["hidden_gem"]),
        "people_spotlight": R.people_events(events, photos, recent, people_tags, how.limits["people_spotlight"]),
        "season_match": R.season_events(events, photos, tags, words, recent, how.limits["season_match"]),
    }
    parts = [cover_candidates(df, photos, name, excluded) for name, df in channels.items()]
    loose = P.excluding(P.active(photos), excluded).where((F.col("event_id").isNull()) & (F.col("beauty_score") >= how.gem_beauty)).orderBy(F.desc("beauty_score"), "id").limit(how.limits["scattered"])
    parts.append(loose.select(F.lit("hidden_gem").alias("channel"), F.col("id").alias("photo_id"), F.lit(None).cast("long").alias("event_id"), "taken_at", "caption", "tags", "top_person_category", F.lit(None).cast("string").alias("primary_category"), F.lit(0).alias("display_count"), F.col("beauty_score").cast("double").alias("raw_score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjusted_score(raw: Column, channel: Column, taken_at: Column, category: Column, texts: Sequence[Column], displays: Column, recent: Column, day: date, how: Strategy = Strategy()) -> Column:
    """The score's adjustments in their fixed order: season, freshness, people, spotlight, season words, displays."""
    score = raw * F.when(F.month(taken_at) == day.month, F.lit(how.season_boost)).otherwise(F.lit(1.0))
    score = score * F.when(recent, F.lit(how.freshness_penalty)).otherwise(F.lit(1.0))
    score = score + F.lit(how.people_bonus) * X.lookup(category, {"family": 3.0, "friend": 2.0, "acquaintance": 0.5}, F.lit(0.0))
    score = score + F.when(channel == "people_spotlight", F.lit(how.people_bonus) * X.lookup(category, {"family": 3.0, "friend": 2.0, "acquaintance": 1.0}, F.lit(0.0))).otherwise(F.lit(0.0))
    score = score * F.when(X.season_match(day.month, *texts), F.lit(1.15)).otherwise(F.lit(1.0))
    return score / (F.lit(1.0) + F.coalesce(displays, F.lit(0)) * F.lit(how.display_decay))


def select_curated(candidates: DataFrame, limit: int, group: str | None = None, per_channel: int = 30) -> DataFrame:
    """One seat for each channel, then the best overall, a day apart and two of a category; then without these rules.

    ``candidates``: channel, photo_id, event_id, taken_at, primary_category, score. A channel has its best
    ``per_channel`` candidates, which are cut before the group is formed. A photo and an event are chosen once.
    """
    key = group or "_all"

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "channel", "photo_id"], ascending=[False, True, True]).reset_index(drop=True)
        taken: list[int] = []

        def fits(i: int, strict: bool) -> bool:
            mine, got = rows.loc[i], rows.loc[taken]
            if (got.photo_id == mine.photo_id).any() or (pd.notna(mine.event_id) and (got.event_id == mine.event_id).any()):
                return False
            if strict and pd.notna(mine.taken_at) and ((got.taken_at - mine.taken_at).abs() < pd.Timedelta(hours=24)).any():
                return False
            return not (strict and pd.notna(mine.event_id) and mine.primary_category and (got.event_id.notna() & (got.primary_category == mine.primary_category)).sum() >= 2)

        for _, own in sorted(rows.groupby("channel").groups.items()):
            seat = next((i for i in own if fits(i, True)), None) if len(taken) < limit else None
            if seat is not None:
                taken.append(seat)
        for strict in (True, False):
            for i in rows.index:
                if len(taken) < limit and i not in taken and fits(i, strict):
                    taken.append(i)
        out = rows.loc[taken, [key, "channel", "photo_id"]].copy()
        out["place"] = range(1, len(taken) + 1)
        return out

    rows = candidates if group else candidates.withColumn("_all", F.lit(0))
    best = F.row_number().over(Window.partitionBy(key, "channel").orderBy(F.desc("score"), "photo_id"))
    rows = rows.withColumn("_n", best).where(F.col("_n") <= per_channel)
    types = dict(rows.dtypes)
    chosen = rows.select(key, "channel", "photo_id", "event_id", "taken_at", "primary_category", "score").groupBy(key).applyInPandas(pick, f"{key} {types[key]}, channel string, photo_id {types['photo_id']}, place int")
    return chosen if group else chosen.drop("_all")


def arrange(chosen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order a selection: the most beautiful first, the dearest (another one) last, the rest by category."""
    each = Window.partitionBy(*keys)
    first = F.row_number().over(each.orderBy(F.desc("beauty_score"), "id")) == 1
    flagged = chosen.withColumn("_first", first)
    last = F.row_number().over(each.orderBy(F.col("_first").asc(), F.desc("memory_score"), "id")) == 1
    flagged = flagged.withColumn("_last", last & ~F.col("_first"))
    order = each.orderBy(F.desc("_first"), "_last", F.coalesce("main_category", F.lit("")), "id")
    return flagged.withColumn("place", F.row_number().over(order)).drop("_first", "_last")


def curated_day(photos: DataFrame, events: DataFrame, tags: DataFrame, day: date, limit: int, how: Strategy = Strategy(), exclude: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """(id, place): a day's pictures from the six channels of events: nominated, scored anew, selected, put in order.

    ``recent``: the events (id) shown of late; ``exclude``: photos (id). Empty where no channel has a candidate.
    """
    nobody = events.select("id").limit(0)
    recent, exclude = (nobody if x is None else x.select("id") for x in (recent, exclude))
    found = nominate(events, photos, tags, recent, exclude, day, how)
    shown = recent.select(F.col("id").alias("event_id"), F.lit(True).alias("_recent")).distinct()
    flagged = found.join(shown, "event_id", "left")
    score = adjusted_score(F.col("raw_score"), F.col("channel"), F.col("taken_at"), F.col("top_person_category"), [F.col("caption"), F.col("tags")], F.col("display_count"), F.coalesce("_recent", F.lit(False)), day, how)
    chosen = select_curated(flagged.withColumn("score", score), limit)
    return arrange(chosen.select(F.col("photo_id").alias("id")).join(photos.select("id", "beauty_score", "memory_score", "main_category"), "id")).select("id", "place")


def daily_selection(photos: DataFrame, day: date, limit: int, strategy: str = "smart", how: Strategy = Strategy(), exclude: DataFrame | None = None, seed: int = 0, events: DataFrame | None = None, tags: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """(id, place) of a day's pictures by a named strategy: random, on_this_day, smart (the same) or event_curated.

    ``random`` takes photos of any score if none reaches the thresholds. ``event_curated`` needs ``events`` and
    ``tags``; a day for which its channels have nothing is chosen as ``on_this_day``.
    """
    if strategy == "event_curated":
        if events is None or tags is None:
            raise ValueError("event_curated needs events and tags")
        curated = curated_day(photos, events, tags, day, limit, how, exclude, recent)
        some = curated.limit(1).select(F.lit(True).alias("_some"))
        other = daily_selection(photos, day, limit, "on_this_day", how, exclude, seed)
        return curated.unionByName(other.join(F.broadcast(some), F.col("_some"), "left_anti"))
    if strategy == "random":
        left = P.active(photos) if exclude is None else P.excluding(P.active(photos), exclude)
        tops = [R.random_sample(rows, limit * how.pool_factor, seed).withColumn("_t", F.lit(k)) for k, rows in enumerate((P.scored_at_least(left, how.memory, how.beauty), P.scored_at_least(left, 0, 0)))]
        both = tops[0].unionByName(tops[1])
        pool = both.join(F.broadcast(both.agg(F.min("_t").alias("_t"))), "_t").drop("_t")
        ranked = pool.withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id"))).withColumn("tier", F.lit(0))
    elif strategy in ("smart", "on_this_day"):
        ranked = on_this_day(photos, day, limit, how, exclude).withColumn("tier", F.col("window_tier"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    bucket = X.location_bucket(F.col("gps_latitude"), F.col("gps_longitude"), F.col("location"), how.location_km)
    return select_diverse(ranked.select("id", "rank", "tier", F.col("taken_at").alias("ts"), X.event_key(F.col("taken_at"), bucket, F.col("file_path")).alias("event_key"), bucket.alias("bucket")), limit, how)


def served_item(items: DataFrame, served: DataFrame) -> DataFrame:
    """(device_id, photo_id): which item of its batch a device shows next, going round; ``served``: device_id, batch_id, n."""
    counted = items.join(items.groupBy("batch_id").agg(F.count("*").alias("size")), "batch_id")
    return served.join(counted, "batch_id").where(F.col("position") == F.pmod(F.col("n"), F.col("size")) + 1).select("device_id", "photo_id")


def daily_batch(photos: DataFrame, day: date, limit: int, how: Strategy = Strategy(), strategy: str = "smart", exclude: DataFrame | None = None, seed: int = 0, **curated: DataFrame) -> DataFrame:
    """(batch_date, position, photo_id, title, subtitle): a day's selection with what is written under each picture; ``curated`` is for event_curated."""
    chosen = daily_selection(photos, day, limit, strategy, how, exclude, seed, **curated)
    shown = chosen.join(photos.select("id", "caption", "file_path", "taken_at", "location"), "id")
    name = F.element_at(F.split("file_path", "/"), -1)
    return shown.select(F.lit(day).alias("batch_date"), F.col("place").alias("position"), F.col("id").alias("photo_id"), X.display_title(F.col("caption"), name).alias("title"), X.display_subtitle(F.col("taken_at"), F.col("location")).alias("subtitle"))


def store_batch(batch: DataFrame, path: str) -> None:
    """Write a day's batch, replacing that day's alone."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_date").parquet(path)
