"""Places for coordinates without a network: the nearest city of a table, by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import exprs as X


def nearest(points: DataFrame, cities: DataFrame, max_km: float = 100.0) -> DataFrame:
    """(id, city columns, km): the nearest city within ``max_km``; points without one are left out.

    ``points``: id, lat, lon. ``cities``: geoname_id, latitude, longitude and what else is wanted. Cells of
    one degree are joined by equality; a city is put into its cell and all around it, wider towards the
    poles and over the date line, and the nearest is an aggregate with map-side combining, so a crowded cell is no single task.
    """
    reach = max_km / 111.0
    wide = F.ceil(reach / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs("latitude") + reach))))).cast("int")
    rows = F.explode(F.sequence(F.floor("latitude") - F.lit(int(-(-reach // 1))), F.floor("latitude") + F.lit(int(-(-reach // 1)))))
    across = F.explode(F.sequence(F.floor("longitude") - F.least(wide, F.lit(180)), F.floor("longitude") + F.least(wide, F.lit(180))))
    spread = cities.withColumn("_y", rows).withColumn("_x", across).withColumn("_x", F.pmod(F.col("_x") + 180, F.lit(360)) - 180)
    placed = points.where(X.valid_gps(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", F.floor("lat").alias("_y"), (F.pmod(F.floor("lon") + 180, F.lit(360)) - 180).alias("_x"))
    met = placed.join(spread, ["_y", "_x"]).withColumn("km", X.haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))).where(F.col("km") <= max_km)
    best = met.groupBy("id").agg(F.min_by(F.struct("km", *cities.columns), F.struct("km", "geoname_id")).alias("m"))
    return best.select("id", "m.*")


def reverse_geocode(photos: DataFrame, cities: DataFrame, max_km: float = 100.0) -> DataFrame:
    """(id, location, city, km) for photos with coordinates: local name first, Chinese places without the country."""
    found = nearest(photos.select("id", F.col("gps_latitude").alias("lat"), F.col("gps_longitude").alias("lon")), cities, max_km)
    name = F.coalesce(F.nullif("name_zh", F.lit("")), "name")
    province = X.province_name(F.col("country"), F.col("admin_name"))
    place = F.when(F.col("country") == "CN", F.concat_ws("", F.nullif(province, F.lit("")), F.when(province != name, name).otherwise(F.lit("")))).otherwise(F.concat_ws(" ", X.country_name(F.col("country")), F.nullif(province, F.lit("")), name))
    return found.select("id", place.alias("location"), name.alias("city"), "km")


def geocode_chain(points: DataFrame, *answers: DataFrame) -> DataFrame:
    """(id, location): the first provider's answer that is not empty, asked once for each rounded coordinate.

    ``answers``: (key, location) by ``geo_cache_key``, in order of preference.
    """
    keyed = points.withColumn("key", X.geo_cache_key(F.col("lat"), F.col("lon")))
    found = keyed
    for k, answer in enumerate(answers):
        found = found.join(answer.select("key", F.nullif(F.trim("location"), F.lit("")).alias(f"_{k}")), "key", "left")
    return found.select("id", F.coalesce(*[F.col(f"_{k}") for k in range(len(answers))]).alias("location"))
