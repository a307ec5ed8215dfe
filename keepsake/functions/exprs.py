"""Column helpers: scores, dates, places, tags, vectors and display texts, all built-in functions."""

from __future__ import annotations

import posixpath
import re
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Rank of a person's category (display order is the inverse) and its bonus in a score.
CATEGORY_RANK = {"family": 4, "friend": 3, "acquaintance": 2, "stranger": 1}
CATEGORY_BONUS = {"family": 3, "friend": 2, "acquaintance": 1}
#: Words that speak for a season, by its name.
SEASON_WORDS = {
    "spring": ["春", "花", "spring", "blossom", "cherry"],
    "summer": ["夏", "海", "summer", "beach", "pool"],
    "autumn": ["秋", "枫", "autumn", "fall", "harvest"],
    "winter": ["冬", "雪", "winter", "snow", "christmas"],
}
#: The categories, each with the spellings that are folded into it; anything else is the last.
CATEGORIES = {
    "人物": ["person", "people", "human"],
    "孩子": ["child", "kid", "baby"],
    "猫咪": ["cat", "kitten"],
    "家庭": ["family", "party", "celebration"],
    "旅行": ["travel", "trip"],
    "风景": ["landscape", "scenery", "nature"],
    "美食": ["food", "meal"],
    "宠物": ["pet", "dog"],
    "日常": ["daily", "life", "event", "activity"],
    "文档": ["document", "receipt", "bill"],
    "杂物": ["trash", "junk", "clutter"],
    "截屏": ["screenshot"],
    "其他": ["other", "others"],
}
#: The names that country codes are shown by; other codes are shown as they are.
COUNTRY_NAMES = {
    "CN": "中国", "US": "美国", "JP": "日本", "KR": "韩国", "GB": "英国", "FR": "法国", "DE": "德国", "IT": "意大利", "ES": "西班牙",
    "CA": "加拿大", "AU": "澳大利亚", "RU": "俄罗斯", "IN": "印度", "BR": "巴西", "MX": "墨西哥", "TH": "泰国", "SG": "新加坡",
    "MY": "马来西亚", "ID": "印度尼西亚", "VN": "越南", "PH": "菲律宾", "NZ": "新西兰", "CH": "瑞士", "AT": "奥地利", "BE": "比利时",
    "NL": "荷兰", "SE": "瑞典", "NO": "挪威", "DK": "丹麦", "FI": "芬兰", "PL": "波兰", "CZ": "捷克", "HU": "匈牙利", "GR": "希腊",
    "PT": "葡萄牙", "TR": "土耳其", "IL": "以色列", "AE": "阿联酋", "SA": "沙特阿拉伯", "EG": "埃及", "ZA": "南非", "AR": "阿根廷",
    "CL": "智利", "CO": "哥伦比亚", "PE": "秘鲁",
}
#: The names of China's first-level regions by their codes.
CN_PROVINCES = {
    "01": "北京市", "02": "天津市", "03": "河北省", "04": "山西省", "05": "内蒙古自治区", "06": "辽宁省", "07": "吉林省", "08": "黑龙江省",
    "09": "上海市", "10": "江苏省", "11": "浙江省", "12": "安徽省", "13": "福建省", "14": "江西省", "15": "山东省", "16": "河南省",
    "17": "湖北省", "18": "湖南省", "19": "广东省", "20": "广西壮族自治区", "21": "海南省", "22": "北京市", "23": "四川省", "24": "贵州省",
    "25": "云南省", "26": "西藏自治区", "27": "陕西省", "28": "甘肃省", "29": "青海省", "30": "宁夏回族自治区", "31": "新疆维吾尔自治区",
    "32": "台湾省", "33": "香港特别行政区", "34": "澳门特别行政区",
}


def lookup(key: Column, pairs: dict, default: Column | None = None) -> Column:
    """A literal dictionary as a chain of comparisons; null keys get the default."""
    chain = fold(lambda c, kv: c.when(key == F.lit(kv[0]), F.lit(kv[1])), list(pairs.items())[1:], F.when(key == F.lit(next(iter(pairs))), F.lit(next(iter(pairs.values())))))
    return chain if default is None else chain.otherwise(default)


def month_day(ts: Column) -> Column:
    """``MM-dd``, the key of on-this-day windows."""
    return F.date_format(ts, "MM-dd")


def in_month_days(ts: Column, start: str, end: str) -> Column:
    """Whether the day lies in [start, end] of ``MM-dd`` keys; a start after the end wraps over new year."""
    key = month_day(ts)
    return key.between(start, end) if start <= end else (key >= start) | (key <= end)


def minutes_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(6e7)


def day_distance(ts: Column, month: int, day: int) -> Column:
    """Days between a date and month/day of the date's own year; not over new year."""
    return F.abs(F.datediff(F.to_date(ts), F.make_date(F.year(ts), F.lit(month), F.lit(day))))


def year_gap(ts: Column, year: int) -> Column:
    return F.abs(F.lit(year) - F.year(ts))


def effective_time(*times: Column) -> Column:
    """The first known of taken, file created, file modified, row created."""
    return F.coalesce(*times)


def overall_score(memory: Column, beauty: Column) -> Column:
    """0.7 memory + 0.3 beauty in doubles, cut to a whole number."""
    return (memory * F.lit(0.7) + beauty * F.lit(0.3)).cast("int")


def category_bonus(category: Column) -> Column:
    return lookup(category, CATEGORY_BONUS, F.lit(0))


def category_rank(category: Column) -> Column:
    return lookup(category, CATEGORY_RANK, F.lit(0))


def weighted_score(overall: Column, category: Column) -> Column:
    """Overall score plus the bonus of the most important person on the photo."""
    return F.coalesce(overall, F.lit(0)) + category_bonus(category)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def flat_distance2(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Squared equirectangular distance in degrees, longitudes shrunk at the origin's latitude."""
    return F.pow(lat - lat0, 2) + F.pow(lon - lon0, 2) * F.pow(F.cos(F.radians(F.lit(lat0))), 2)


def valid_gps(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def location_bucket(lat: Column, lon: Column, location: Column, km: float) -> Column:
    """A grid cell of about ``km``, else the place's name, else null; halves are rounded away from zero."""
    cell = F.concat_ws(":", F.lit("gps"), F.round(lat / (km / 111)).cast("long").cast("string"), F.round(lon / (km / 111 / F.greatest(F.lit(0.1), F.cos(F.radians(lat))))).cast("long").cast("string"))
    name = F.lower(F.trim(location))
    return F.when(valid_gps(lat, lon), cell).when(F.length(name) > 0, F.concat(F.lit("loc:"), name))


def event_key(ts: Column, bucket: Column, path: Column) -> Column:
    """Day and place; without a place, day and folder; without both, the day."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd"), F.coalesce(bucket, F.when(F.length(folder) > 0, F.concat(F.lit("dir:"), folder))))


def split_tags(tags: Column) -> Column:
    """Comma-separated tags: trimmed, without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0))


def season_of(month: Column) -> Column:
    return F.when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn").otherwise("winter")


def season_match(month: int, *texts: Column) -> Column:
    """Whether a text holds a word of the month's season, whatever its case."""
    words = SEASON_WORDS[["winter", "spring", "summer", "autumn"][month % 12 // 3]]
    return fold(lambda a, b: a | b, [F.coalesce(F.lower(t).contains(w), F.lit(False)) for t in texts for w in words])


def clean_path(path: str) -> str:
    """A folder's literal path without doubled or trailing slashes."""
    return posixpath.normpath(path) if path else path


def search_terms(query: str) -> list[str]:
    """The terms of a search, lower-cased, without quotes; a term that marks part (``well-known``) is several words with spaces between."""
    cut = [re.sub(r"[\W_]+", " ", t).strip() for t in query.replace('"', "").lower().split()]
    return [t for t in cut if t]


def token_text(text: Column) -> Column:
    """Lower-cased letters and digits between single spaces, with one at both ends: for whole-word search."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, else null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def normal_category(category: Column) -> Column:
    """A canonical category: itself, or the one its lower-case spelling belongs to, else the last."""
    spellings = {w: c for c, words in CATEGORIES.items() for w in words}
    return F.when(category.isin(*CATEGORIES), category).otherwise(lookup(F.lower(category), spellings, F.lit(list(CATEGORIES)[-1])))


def short_caption(caption: Column, description: Column) -> Column:
    """The caption, else the description's first 30 characters."""
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.substring(F.trim(description), 1, 30))


def display_title(caption: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.regexp_replace(file_name, r"\.[^.]*$", ""))


def display_subtitle(ts: Column, location: Column) -> Column:
    return F.concat_ws(" · ", F.date_format(ts, "yyyy.MM.dd"), F.nullif(F.trim(location), F.lit("")))


def province_name(country: Column, admin: Column) -> Column:
    """A region's name: China's by their codes; other numeric codes say nothing and become empty."""
    named = F.when(country == "CN", lookup(admin, CN_PROVINCES))
    return F.coalesce(named, F.when(admin.rlike("^[0-9]+$"), F.lit("")), admin, F.lit(""))


def country_name(code: Column) -> Column:
    return lookup(code, COUNTRY_NAMES, F.coalesce(code, F.lit("")))


def _given(text: Column) -> Column:
    """Null for what does not name a place."""
    return F.when((F.length(text) > 0) & (text != "[]"), text)


def place_full(country: Column, province: Column, city: Column, district: Column, full: Column) -> Column:
    """The full name if there is one, else the known parts from the largest on."""
    return F.coalesce(_given(full), F.concat_ws("，", _given(country), _given(province), _given(city), _given(district)))


def place_short(country: Column, province: Column, city: Column, district: Column) -> Column:
    """City and district, else the province, else the country."""
    return F.coalesce(F.concat(_given(city), F.coalesce(district, F.lit(""))), _given(province), _given(country), F.lit(""))


def place_display(country: Column, province: Column, city: Column, district: Column, poi: Column, street: Column, full: Column | None = None, provider: Column | None = None) -> Column:
    """City (or province) and district, then a landmark, then the street in brackets; else the short name.

    A place from the offline table (``provider`` is ``offline``) has no such detail: its ``full`` name is shown.
    """
    head = F.concat(F.coalesce(_given(city), _given(province), F.lit("")), F.coalesce(district, F.lit("")))
    tail = F.concat(F.coalesce(poi, F.lit("")), F.coalesce(F.concat(F.lit("（"), _given(street), F.lit("）")), F.lit("")))
    shown = F.when(F.length(head) > 0, F.concat(head, tail)).otherwise(place_short(country, province, city, district))
    if full is None or provider is None:
        return shown
    return F.when((provider == "offline") & (F.length(full) > 0), full).otherwise(shown)


def municipality(display_name: Column) -> Column:
    """The part of a comma-separated address that names a city (ends in 市), else empty."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(display_name, ","), lambda t: F.trim(t)), lambda x: x.endswith("市")), F.lit(0)), F.lit(""))


def orientation_code(text: Column) -> Column:
    """EXIF orientation names to 1..8."""
    t = F.lower(text)
    return (
        F.when(t.contains("mirror horizontal and rotate 270"), 5).when(t.contains("mirror horizontal and rotate 90"), 7)
        .when(t.contains("mirror horizontal"), 2).when(t.contains("mirror vertical"), 4)
        .when(t.contains("rotate 180"), 3).when(t.contains("rotate 90"), 6).when(t.contains("rotate 270"), 8).otherwise(1)
    )


def gps_number(text: Column) -> Column:
    """A decimal coordinate with an optional N/S/E/W, south and west negative."""
    size = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.upper(text).rlike("[SW]") | F.trim(text).startswith("-"), -size).otherwise(size)


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def rotate(degrees: Column, by: int) -> Column:
    return F.pmod(degrees + F.lit(by), F.lit(360))


def geo_cache_key(lat: Column, lon: Column) -> Column:
    """Coordinates to four decimals, one key for neighbours of some ten metres."""
    return F.concat_ws(",", F.format_string("%.4f", lat), F.format_string("%.4f", lon))


def task_id(photo: Column, ts: Column) -> Column:
    return F.format_string("task_%d_%d", photo, ts)


def task_photo(task: Column) -> Column:
    return F.regexp_extract(task, r"^task_([0-9]+)_[0-9]+$", 1).try_cast("long")


def valid_result(photo: Column, description: Column, *scores: Column) -> Column:
    """A known photo, a description, and scores between 0 and 100."""
    return fold(lambda a, b: a & b, [photo > 0, F.length(F.trim(description)) > 0, *[s.between(0, 100) for s in scores]])


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for empty, unequal or zero vectors."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (l2_norm(a) > 0) & (l2_norm(b) > 0)
    return F.when(usable, dot(a, b) / (l2_norm(a) * l2_norm(b))).otherwise(F.lit(-1.0))


def adaptive_threshold(base: float, retries: Column, floor: float = 0.5) -> Column:
    """The base up to one retry, then falling evenly to the floor at the fifth."""
    return F.when(retries <= 1, F.lit(base)).when(retries >= 5, F.lit(floor)).otherwise(F.lit(base) - (F.lit(base) - floor) * (retries - 1) / 4)


def face_quality(score: Column, area: Column, sharpness: Column) -> Column:
    return score * 0.45 + F.least(area / 0.12, F.lit(1.0)) * 0.2 + F.least(sharpness / 600, F.lit(1.0)) * 0.35


def clamp_box(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """A box's side as shares of the picture, inside it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), low / size)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), high / size))


def fit_vector(v: Column, width: int) -> Column:
    """Padded with zeros or cut to ``width``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)
