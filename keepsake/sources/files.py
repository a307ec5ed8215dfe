"""Folders of pictures and city tables as DataFrames, snapshots compared, and result queues as JSON."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import exprs as X
from keepsake.operators.relational import outermost

#: File names a picture may end in.
EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif", "bmp", "tif", "tiff")
CITY = "geoname_id int, name string, name_zh string, admin_name string, country string, latitude double, longitude double"


def picture_files(spark: SparkSession, root: str, excluded: Sequence[str] = (), content: bool = False) -> DataFrame:
    """(file_path, file_name, file_size, file_mod_time[, content]) of the pictures below a folder of any store."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    path = F.regexp_replace("path", "^file:/*", "/")
    found = listed.where(ending.isin(*EXTENSIONS)).withColumn("file_path", path)
    for folder in excluded:
        found = found.where(~F.array_contains(F.split("file_path", "/"), folder))
    columns = ["file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mod_time")]
    return found.select(*columns, *(["content"] if content else []))


def scan_diff(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_path, action): insert, update, delete or keep, by one outer join on the path.

    A file is kept if size and change time are the same, unknown ones being equal to each other.
    """
    was = catalog.select("file_path", F.col("file_size").alias("_s"), F.col("file_mod_time").alias("_t"), F.lit(True).alias("_was"))
    now = listing.select("file_path", "file_size", "file_mod_time", F.lit(True).alias("_is"))
    same = F.col("file_size").eqNullSafe(F.col("_s")) & F.col("file_mod_time").eqNullSafe(F.col("_t"))
    action = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when(same, "keep").otherwise("update")
    return was.join(now, "file_path", "full_outer").select("file_path", action.alias("action"))


def changed_folders(was: DataFrame, now: DataFrame) -> DataFrame:
    """(path): folders to scan again: new or changed ones, and for those gone the nearest ancestor still there.

    Both snapshots: path, mod_time. A folder below another of the list is left out.
    """
    joined = was.select("path", F.col("mod_time").alias("_t"), F.lit(True).alias("_was")).join(now.select("path", "mod_time", F.lit(True).alias("_is")), "path", "full_outer")
    changed = joined.where("_is").where(F.col("_was").isNull() | ~F.col("mod_time").eqNullSafe(F.col("_t"))).select("path")
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    gone = joined.where(F.col("_is").isNull()).select(F.col("path").alias("gone"), F.explode(ups).alias("path"))
    nearest = gone.join(now.select("path"), "path", "left_semi").groupBy("gone").agg(F.max_by("path", F.length("path")).alias("path")).select("path")
    return outermost(changed.unionByName(nearest))


def in_batches(rows: DataFrame, columns: Sequence[str], call: Callable[[list[tuple]], Iterable[tuple]], schema: str, size: int = 500) -> DataFrame:
    """What ``call`` makes of lists of up to ``size`` rows, as rows of ``schema``: for clients that go through all rows.

    Each partition cuts its own rows into lists and calls where they are, one list after another; no row comes
    to the driver. A task that is run again calls again, so ``call`` must bear that.
    """
    names = rows.sparkSession.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for f in frames:
            held += f.itertuples(index=False, name=None)
            while len(held) >= size:
                yield pd.DataFrame(list(call(held[:size])), columns=names)
                held = held[size:]
        if held:
            yield pd.DataFrame(list(call(held)), columns=names)

    return rows.select(*columns).mapInPandas(run, schema)


def missing_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    return catalog.join(listing.select("file_path"), "file_path", "left_anti")


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, GIF or JPEG; else unknown."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None, None


def exif_fields(data: bytes) -> dict[str, object]:
    """Orientation, time, camera and position from a JPEG's EXIF block; what is not there is None."""
    out: dict[str, object] = dict.fromkeys(("orientation", "taken_text", "camera", "gps_latitude", "gps_longitude"))
    start = data.find(b"Exif\0\0")
    if start < 0:
        return out
    tiff = data[start + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return out
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def directory(at: int) -> dict[int, object]:
        found: dict[int, object] = {}
        if at + 2 > len(tiff):
            return found
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            size = width.get(kind, 1) * count
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            raw = tiff[where : where + size]
            if len(raw) < size:
                continue
            if kind == 2:
                found[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (3, 4):
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I") * count, raw)[0] if count == 1 else None
            elif kind == 5:
                pairs = struct.unpack(order + "II" * count, raw)
                found[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return found

    main = directory(struct.unpack_from(order + "I", tiff, 4)[0])
    detail = directory(main[0x8769]) if isinstance(main.get(0x8769), int) else {}
    place = directory(main[0x8825]) if isinstance(main.get(0x8825), int) else {}
    out.update(orientation=main.get(0x0112), camera=main.get(0x0110), taken_text=detail.get(0x9003) or main.get(0x0132))
    for name, value, side, minus in (("gps_latitude", 2, 1, "S"), ("gps_longitude", 4, 3, "W")):
        parts = place.get(value)
        if isinstance(parts, list) and len(parts) == 3:
            degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
            out[name] = -degrees if place.get(side) == minus else degrees
    return out


def picture_facts(files: DataFrame) -> DataFrame:
    """Files with content to (file_path, file_size, file_mod_time, file_hash, width, height, orientation, taken_at, camera, GPS)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sizes, facts = [image_size(bytes(x)) for x in p["content"]], pd.DataFrame([exif_fields(bytes(x)) for x in p["content"]], columns=["orientation", "taken_text", "camera", "gps_latitude", "gps_longitude"])
            yield p[["file_path", "file_size", "file_mod_time", "file_hash"]].assign(width=pd.array([s[0] for s in sizes], dtype="Int32"), height=pd.array([s[1] for s in sizes], dtype="Int32"), orientation=facts["orientation"].astype("Int32").array, taken_text=facts["taken_text"].array, camera=facts["camera"].array, gps_latitude=facts["gps_latitude"].astype("float64").array, gps_longitude=facts["gps_longitude"].astype("float64").array)

    hashed = files.select("file_path", "file_size", "file_mod_time", F.sha2("content", 256).alias("file_hash"), "content")
    out = hashed.mapInPandas(read, "file_path string, file_size long, file_mod_time timestamp, file_hash string, width int, height int, orientation int, taken_text string, camera string, gps_latitude double, gps_longitude double")
    return out.withColumn("taken_at", X.exif_time(F.col("taken_text"))).drop("taken_text")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) tab-separated city table; rows with missing fields or bad numbers are left out."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path, schema="geoname_id string, name string, name_zh string, admin_name string, country string, latitude string, longitude string")
    typed = raw.select(F.col("geoname_id").try_cast("int").alias("geoname_id"), "name", F.coalesce("name_zh", F.lit("")).alias("name_zh"), F.coalesce("admin_name", F.lit("")).alias("admin_name"), "country", F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"))
    return typed.where("geoname_id is not null and name is not null and latitude is not null and longitude is not null")


def build_cities(cities: DataFrame, names: DataFrame) -> DataFrame:
    """Cities with their best local name: zh-CN before zh before zh-TW."""
    rank = X.lookup(F.col("lang"), {"zh-CN": 3, "zh": 2, "zh-TW": 1})
    best = names.where(rank.isNotNull()).groupBy("geoname_id").agg(F.max_by("name", F.struct(rank, "name")).alias("name_zh"))
    return cities.drop("name_zh").join(best, "geoname_id", "left").withColumn("name_zh", F.coalesce("name_zh", F.lit("")))


def write_cities(cities: DataFrame, path: str) -> None:
    cities.select("geoname_id", "name", "name_zh", "admin_name", "country", "latitude", "longitude").write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").option("compression", "gzip").csv(path)


def backfill_tags(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """The tag table with every tag of the photos' texts, each once."""
    return tags.select("photo_id", "tag").unionByName(photos.select(F.col("id").alias("photo_id"), F.explode(X.split_tags(F.col("tags"))).alias("tag"))).distinct()


def decode_vectors(rows: DataFrame, column: str) -> DataFrame:
    """Vectors stored as JSON text to float arrays, with built-in parsing."""
    return rows.withColumn(column, F.from_json(column, "array<float>"))


def queue_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def queued_results(spark: SparkSession, path: str, schema: str, limit: int = 10_000) -> DataFrame:
    """The queue's foremost results: by priority, then age."""
    return spark.read.schema(schema).json(path).orderBy(F.desc("priority"), "created_at").limit(limit)


def parse_analysis(rows: DataFrame, column: str = "response") -> DataFrame:
    """A model's answers to columns: the JSON object in the text, with a description and a category folded."""
    schema = "description string, caption string, main_category string, tags string, memory_score int, beauty_score int"
    parsed = rows.withColumn("_a", F.from_json(X.json_object(F.col(column)), schema))
    good = parsed.where("length(_a.description) > 0 and length(_a.main_category) > 0")
    return good.select(*[c for c in rows.columns if c != column], "_a.description", X.short_caption(F.col("_a.caption"), F.col("_a.description")).alias("caption"), X.normal_category(F.col("_a.main_category")).alias("main_category"), "_a.tags", "_a.memory_score", "_a.beauty_score")


def parse_analysis_batch(rows: DataFrame, column: str = "response") -> DataFrame:
    """Answers for several photos at once: one row an element of the JSON array, with its place."""
    schema = "array<struct<description:string,main_category:string,memory_score:int,beauty_score:int>>"
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.from_json(X.json_array(F.col(column)), schema)).alias("place", "a")).select("*", "a.*").drop("a")
