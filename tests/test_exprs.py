"""Column helpers on the cases the domain fixtures name."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepsake.functions import exprs as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("column", "want"), [
    (lambda: X.overall_score(F.lit(85), F.lit(90)), 86),
    (lambda: X.overall_score(F.lit(1), F.lit(31)), 9),
    (lambda: X.location_bucket(F.lit(0.0), F.lit(0.0), F.lit(" Oslo "), 3), "loc:oslo"),
    (lambda: X.location_bucket(F.lit(None).cast("double"), F.lit(1.0), F.lit(" "), 3), None),
    (lambda: X.location_bucket(F.lit(0.0135135), F.lit(-0.0405405406), F.lit(""), 3), "gps:0:-1"),  # -1.49999996: a cell is narrower off the equator
    (lambda: X.location_bucket(F.lit(0.0), F.lit(-1.5), F.lit(""), 111), "gps:0:-2"),
    (lambda: X.location_bucket(F.lit(0.5), F.lit(0.0), F.lit(""), 111), "gps:1:0"),
    (lambda: X.event_key(F.lit(datetime(2024, 3, 6, 5)), F.lit(None).cast("string"), F.lit("/a/b/c.jpg")), "2024-03-06|dir:/a/b"),
    (lambda: X.day_distance(F.lit(datetime(2023, 12, 31)), 1, 1), 364),
    (lambda: X.year_gap(F.lit(datetime(2020, 1, 1)), 2024), 4),
    (lambda: X.split_tags(F.lit(" a, b,,a ,c")), ["a", "b", "c"]),
    (lambda: X.season_match(4, F.lit("Cherry tree"), F.lit(None).cast("string")), True),
    (lambda: X.season_match(12, F.lit("beach"), F.lit("海")), False),
    (lambda: X.normal_category(F.lit("Trip")), "旅行"),
    (lambda: X.normal_category(F.lit("家庭")), "家庭"),
    (lambda: X.normal_category(F.lit("unheard of")), "其他"),
    (lambda: X.json_object(F.lit("well: {\"a\": {}} ok")), '{"a": {}}'),
    (lambda: X.json_object(F.lit("none")), None),
    (lambda: X.short_caption(F.lit(" "), F.lit("é" * 40)), "é" * 30),
    (lambda: X.display_title(F.lit(None).cast("string"), F.lit("a.b.jpg")), "a.b"),
    (lambda: X.display_subtitle(F.lit(datetime(2024, 3, 6)), F.lit("")), "2024.03.06"),
    (lambda: X.place_full(F.lit("A"), F.lit(""), F.lit("[]"), F.lit("D"), F.lit("")), "A，D"),
    (lambda: X.place_short(F.lit("A"), F.lit("P"), F.lit("[]"), F.lit("D")), "P"),
    (lambda: X.place_display(F.lit("A"), F.lit("P"), F.lit("C"), F.lit("D"), F.lit("poi"), F.lit("s")), "CDpoi（s）"),
    (lambda: X.place_display(F.lit("A"), F.lit("P"), F.lit("C"), F.lit("D"), F.lit(""), F.lit(""), F.lit("whole"), F.lit("offline")), "whole"),
    (lambda: X.place_display(F.lit("A"), F.lit("P"), F.lit("C"), F.lit("D"), F.lit(""), F.lit(""), F.lit("whole"), F.lit("other")), "CD"),
    (lambda: X.province_name(F.lit("US"), F.lit("12")), ""),
    (lambda: X.province_name(F.lit("CN"), F.lit("23")), "四川省"),
    (lambda: X.province_name(F.lit("CN"), F.lit("99")), ""),
    (lambda: X.country_name(F.lit("CN")), "中国"),
    (lambda: X.country_name(F.lit("XX")), "XX"),
    (lambda: X.province_name(F.lit("US"), F.lit("California")), "California"),
    (lambda: X.gps_number(F.lit("33.5 S")), -33.5),
    (lambda: X.gps_number(F.lit("nowhere")), None),
    (lambda: X.orientation_code(F.lit("Rotate 90 CW")), 6),
    (lambda: X.rotate(F.lit(0), -90), 270),
    (lambda: X.exif_time(F.lit("2024:03:06 01:02:03")), datetime(2024, 3, 6, 1, 2, 3)),
    (lambda: X.exif_time(F.lit("bad")), None),
    (lambda: X.task_photo(X.task_id(F.lit(7), F.lit(99))), 7),
    (lambda: X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))), -1.0),
    (lambda: X.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))), 1.0),
    (lambda: X.adaptive_threshold(0.7, F.lit(1)), 0.7),
    (lambda: X.adaptive_threshold(0.7, F.lit(9)), 0.5),
    (lambda: F.round(X.adaptive_threshold(0.7, F.lit(3)), 6), 0.6),
    (lambda: X.face_quality(F.lit(1.0), F.lit(0.24), F.lit(1200.0)), 1.0),
    (lambda: F.size(X.fit_vector(F.array(F.lit(1.0).cast("float")), 4)), 4),
    (lambda: X.weighted_score(F.lit(80), F.lit("family")), 83),
])
def test_values(spark, column, want):
    assert value(spark, column()) == want


def test_haversine(spark):
    assert abs(value(spark, X.haversine_km(F.lit(39.9042), F.lit(116.4074), F.lit(31.2304), F.lit(121.4737))) - 1068) < 15
    assert abs(value(spark, X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - math.pi * 6371) < 1


def test_month_day_wrap(spark):
    rows = spark.createDataFrame([(datetime(2020, m, d),) for m, d in ((12, 30), (1, 2), (6, 15))], "t timestamp")
    assert rows.where(X.in_month_days(F.col("t"), "12-28", "01-04")).count() == 2
    assert rows.where(X.in_month_days(F.col("t"), "06-01", "06-30")).count() == 1
