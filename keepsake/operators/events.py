"""Photos into events: gaps in time and jumps in place, profiles, and attaching later photos."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.session import checkpointed

GAP_HOURS, FAR_KM, LEAST_PHOTOS, PAD_HOURS = 24, 50.0, 3, 6


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def _begins(now: Sequence[Column], before: Column, gap_hours: float, far_km: float) -> Column:
    """Whether a row (seconds, lat, lon) begins an event after the row ``before`` (struct s, lat, lon; null: none)."""
    ts, lat, lon = now
    known = lat.isNotNull() & lon.isNotNull() & before["lat"].isNotNull() & before["lon"].isNotNull()
    far = known & (X.haversine_km(before["lat"], before["lon"], lat, lon) > far_km)
    return F.coalesce((ts - before["s"] >= gap_hours * 3600) | far, F.lit(True))


def sessions(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, lat: str | None = None, lon: str | None = None, gap_hours: float = GAP_HOURS, far_km: float = FAR_KM, slot_seconds: int = 3600) -> DataFrame:
    """Number the events of each key: ``session`` counts from 1 along time. Rows without a time are left out.

    A key's time is cut into slots of an hour, which are windows of their own: a row's predecessor is in its
    slot or is the last row of the slot before. What crosses slots is one row a slot (last row, number of
    cuts), some hundred thousand for a key with decades of rows, and only these are put in one order. So a key
    that holds a third of all rows is many windows, however long its rows go on without a gap.
    """
    place = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    key = F.struct(F.lit(0).alias("_"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)])  # nulls in it are equal
    known = rows.where(F.col(time).isNotNull()).withColumns({"_k": key, "_row": F.struct(seconds(F.col(time)).alias("s"), place(lat).alias("lat"), place(lon).alias("lon")), "_slot": F.floor(seconds(F.col(time)) / slot_seconds)})
    over = Window.partitionBy("_k", "_slot").orderBy(time, row_id)
    along = Window.partitionBy("_k").orderBy("_slot")
    lasts = known.groupBy("_k", "_slot").agg(F.max_by("_row", F.struct(time, row_id)).alias("_last"))
    before = lasts.select("_k", "_slot", F.lag("_last").over(along).alias("_early"))
    joined = known.withColumn("_own", F.lag("_row").over(over)).join(before, ["_k", "_slot"])
    flagged = joined.withColumn("_cut", _begins((F.col("_row.s"), F.col("_row.lat"), F.col("_row.lon")), F.coalesce("_own", "_early"), gap_hours, far_km).cast("long")).drop("_own", "_early")
    cuts = flagged.groupBy("_k", "_slot").agg(F.sum("_cut").alias("_n"))
    bases = cuts.select("_k", "_slot", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    running = flagged.withColumn("_run", F.sum("_cut").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(bases, ["_k", "_slot"]).withColumn("session", (F.col("_base") + F.col("_run")).cast("int")).select(*rows.columns, "session")


def cluster_events(photos: DataFrame, gap_hours: float = GAP_HOURS, far_km: float = FAR_KM, least: int = LEAST_PHOTOS, slot_seconds: int = 3600) -> DataFrame:
    """(id, event): one timeline's photos in events of at least ``least``, each named by its first photo.

    Rows: id, taken_at, gps_latitude, gps_longitude; those without a time are left out. The timeline is cut by
    slots (``sessions``); events are counted by an aggregate.
    """
    numbered = sessions(photos.select("id", "taken_at", "gps_latitude", "gps_longitude"), [], "taken_at", "id", "gps_latitude", "gps_longitude", gap_hours, far_km, slot_seconds)
    named = numbered.groupBy("session").agg(F.count("*").alias("n"), F.min_by("id", F.struct("taken_at", "id")).alias("event")).where(F.col("n") >= least)
    return numbered.join(named, "session").select("id", "event")


def profile_events(photos: DataFrame, members: DataFrame) -> DataFrame:
    """One row an event: span, counts, mean place, modes, cover (most beautiful, the first of equals), score.

    ``photos`` has tags as text; a mode's ties go to the smallest value. Score: mean overall times log2(n + 1).
    """
    joined = photos.join(members, "id")
    named = F.when(F.length(F.trim("location")) > 0, F.col("location"))
    kind = F.when(F.length("main_category") > 0, F.col("main_category"))
    base = joined.groupBy("event").agg(
        F.min("taken_at").alias("start_time"), F.max("taken_at").alias("end_time"), F.count("*").alias("photo_count"),
        F.avg("gps_latitude").alias("gps_latitude"), F.avg("gps_longitude").alias("gps_longitude"), F.mode(named, True).alias("location"), F.mode(kind, True).alias("primary_category"),
        F.max_by("id", F.struct(F.coalesce("beauty_score", F.lit(-1)), -seconds(F.col("taken_at")), -F.col("id"))).alias("cover_photo_id"),
        (F.avg(F.coalesce("overall_score", F.lit(0))) * F.log2(F.count("*") + F.lit(1.0))).alias("event_score"),
    )
    tags = joined.select("event", F.explode(X.split_tags(F.col("tags"))).alias("tag")).groupBy("event").agg(F.mode("tag", True).alias("primary_tag"))
    hours = (seconds(F.col("end_time")) - seconds(F.col("start_time"))) / 3600
    return base.join(tags, "event", "left").withColumn("duration_hours", hours)


def _first_at_most(values: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each start the first place from there on whose value is at most ``most``; the length where there is none."""
    least = [values]  # least[k][i]: the least of 2^k values from i on
    while len(least[-1]) > 1 << (len(least) - 1):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    at = start.astype(np.int64)
    for k in reversed(range(len(least))):
        fits = at < len(least[k])
        above = fits.copy()
        above[fits] = least[k][at[fits]] > most[fits]
        at[above] += 1 << k
    return at


def attach(clusters: DataFrame, events: DataFrame, pad_hours: float = PAD_HOURS, block: int = 65_536) -> DataFrame:
    """(cluster, event): each new cluster's event among those whose padded span it overlaps, the nearest midpoint first.

    Both sides have id, start_time, end_time, the end not before the start; ties go to the smaller id. The
    nearest event after a cluster's midpoint is the first one along midpoints that begins before the cluster
    ends, the nearest before it the last one that ends after the cluster begins. So events are cut along
    midpoints into blocks of about ``block``, and a cluster goes to its own block and to the first on either
    side that has such an event, as the blocks' bounds tell: three blocks, however many spans overlap. Blocks
    of more rows (equal midpoints) are parts of their own, and a block that many clusters go to is copied.
    """

    def spans(rows: DataFrame, pad: float) -> DataFrame:
        s, e, wide = F.col("start_time").cast("timestamp"), F.col("end_time").cast("timestamp"), F.lit(round(pad * 3_600_000_000))
        mid = (seconds(F.col("start_time")) + seconds(F.col("end_time"))) / 2
        return checkpointed(rows.where("id is not null").select(F.col("id").alias("row"), (F.unix_micros(s) - wide).alias("lo"), (F.unix_micros(e) + wide).alias("hi"), mid.alias("mid")).where("mid is not null"))

    new, old = spans(clusters, 0), spans(events, pad_hours)
    cuts = min(-(-old.count() // block), 4096)
    bounds = np.unique(old.agg(F.percentile_approx("mid", [k / cuts for k in range(1, cuts)], 16 * cuts)).first()[0] if cuts > 1 else [])
    end = np.iinfo(np.int64).max
    lows, lasts = np.full(len(bounds) + 1, end), np.full(len(bounds) + 1, -end)

    @F.pandas_udf("int")
    def own(mid: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, mid, side="right"), dtype="int32")

    placed = old.withColumn("block", own("mid"))
    sizes = {r.block: r for r in placed.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # a row a block
    for k, r in sizes.items():
        lows[k], lasts[k] = r.lo, r.hi

    @F.pandas_udf("array<int>")
    def visited(lo: pd.Series, hi: pd.Series, mid: pd.Series) -> pd.Series:
        here, n = np.searchsorted(bounds, mid, side="right"), len(lows)
        after = _first_at_most(lows, here + 1, hi.to_numpy())
        before = n - 1 - _first_at_most(-lasts[::-1], n - here, -lo.to_numpy())
        return pd.Series([[int(k) for k in ks if 0 <= k < n] for ks in zip(here, after, before, strict=True)])

    parts = F.broadcast(old.sparkSession.createDataFrame([(int(k), int(r.parts)) for k, r in sizes.items()], "block int, parts int"))
    going = checkpointed(new.withColumn("block", F.explode(visited("lo", "hi", "mid"))).join(parts, "block"))
    copies = F.broadcast(going.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("copies")))
    left = going.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies").cast("long")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = placed.join(parts, "block").join(copies, "block").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts").cast("long")).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def nearest(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        start, found = np.searchsorted(np.sort(e["mid"].to_numpy()), c["mid"].to_numpy()), []
        for ascending in (True, False):
            e = e.sort_values(["mid", "row"], ascending=[ascending, True])
            at = _first_at_most(e["lo"].to_numpy(), start, c["hi"].to_numpy()) if ascending else _first_at_most(-e["hi"].to_numpy(), len(e) - start, -c["lo"].to_numpy())
            some = at < len(e)
            hit = e.iloc[at[some]]
            found.append(pd.DataFrame({"cluster": c["row"].to_numpy()[some], "event": hit["row"].to_numpy(), "away": np.abs(c["mid"].to_numpy()[some] - hit["mid"].to_numpy())}))
        return pd.concat(found)

    keys, kinds = ["block", "part", "copy"], [dict(x.dtypes)["row"] for x in (new, old)]
    met = left.select(*keys, "row", "lo", "hi", "mid").groupBy(*keys).cogroup(right.select(*keys, "row", "lo", "hi", "mid").groupBy(*keys)).applyInPandas(nearest, f"cluster {kinds[0]}, event {kinds[1]}, away double")
    return met.groupBy("cluster").agg(F.min_by("event", F.struct("away", "event")).alias("event"))


def grow_events(photos: DataFrame, events: DataFrame, **how: float) -> DataFrame:
    """(id, event, is_new): photos without an event, clustered among themselves and attached or made new events.

    A cluster of fewer than ``least`` photos may join an event but makes none.
    """
    least = int(how.pop("least", LEAST_PHOTOS))
    loose = photos.where("event_id is null")
    members = cluster_events(loose, least=1, **how)
    spans = loose.join(members, "id").groupBy(F.col("event").alias("id")).agg(F.min("taken_at").alias("start_time"), F.max("taken_at").alias("end_time"), F.count("*").alias("n"))
    found = attach(spans, events).withColumnRenamed("event", "old")
    decided = spans.select(F.col("id").alias("cluster"), "n").join(found, "cluster", "left").where((F.col("n") >= least) | F.col("old").isNotNull())
    return members.withColumnRenamed("event", "cluster").join(decided, "cluster").select("id", F.coalesce("old", "cluster").alias("event"), F.col("old").isNull().alias("is_new"))
