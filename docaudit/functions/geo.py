"""City table, city resolution as a row-local expression, great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docaudit.functions.scalars import strip

# Code, short name, tier, latitude, longitude. Order matters for ties.
CITIES = (
    ("110000", "北京", "TIER_1", 39.9042, 116.4074),
    ("310000", "上海", "TIER_1", 31.2304, 121.4737),
    ("440100", "广州", "TIER_1", 23.1291, 113.2644),
    ("440300", "深圳", "TIER_1", 22.5431, 114.0579),
    ("330100", "杭州", "TIER_2", 30.2741, 120.1551),
    ("320100", "南京", "TIER_2", 32.0603, 118.7969),
    ("510100", "成都", "TIER_2", 30.5728, 104.0668),
    ("420100", "武汉", "TIER_2", 30.5928, 114.3055),
    ("610100", "西安", "TIER_2", 34.3416, 108.9398),
    ("500000", "重庆", "TIER_2", 29.5630, 106.5516),
    ("120000", "天津", "TIER_2", 39.0842, 117.2009),
    ("320500", "苏州", "TIER_2", 31.2990, 120.5853),
    ("430100", "长沙", "TIER_2", 28.2282, 112.9388),
    ("410100", "郑州", "TIER_2", 34.7466, 113.6253),
    ("370200", "青岛", "TIER_2", 36.0671, 120.3826),
    ("210200", "大连", "TIER_2", 38.9140, 121.6147),
    ("330200", "宁波", "TIER_2", 29.8683, 121.5440),
    ("350200", "厦门", "TIER_2", 24.4798, 118.0894),
    ("350100", "福州", "TIER_2", 26.0745, 119.2965),
    ("370100", "济南", "TIER_2", 36.6512, 117.1201),
    ("450100", "南宁", "TIER_2", 22.8170, 108.3665),
    ("530100", "昆明", "TIER_2", 24.8801, 102.8329),
    ("520100", "贵阳", "TIER_2", 26.6470, 106.6302),
    ("360100", "南昌", "TIER_2", 28.6829, 115.8582),
    ("340100", "合肥", "TIER_2", 31.8206, 117.2272),
    ("130100", "石家庄", "TIER_2", 38.0428, 114.5149),
    ("140100", "太原", "TIER_2", 37.8706, 112.5489),
    ("210100", "沈阳", "TIER_2", 41.8057, 123.4315),
    ("220100", "长春", "TIER_2", 43.8868, 125.3245),
    ("230100", "哈尔滨", "TIER_2", 45.8038, 126.5349),
    ("460100", "海口", "TIER_2", 20.0440, 110.1999),
    ("460200", "三亚", "TIER_2", 18.2528, 109.5119),
)

# Nightly lodging limit by tier, and what an unknown city gets.
TIER_LIMITS = {"TIER_1": "500.00", "TIER_2": "350.00", "TIER_3": "260.00"}
UNKNOWN_TIER = "TIER_3"

EARTH_RADIUS_KM = 6371.0


def city_rows():
    """Rows of the city table: rank, code, name, short name, tier, latitude, longitude, limit."""
    for rank, (code, short, tier, lat, lng) in enumerate(CITIES, 1):
        yield rank, code, short + "市", short, tier, lat, lng, TIER_LIMITS[tier]


def city_table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(
        list(city_rows()),
        "rank int, code string, name string, short_name string, tier string, latitude double,"
        " longitude double, hotel_limit string",
    )
    return df.withColumn("hotel_limit", F.col("hotel_limit").cast("decimal(14,2)"))


# The lookups are short literals that the optimizer folds; a long CASE chain would be copied by
# every filter it is pushed through and blow up planning and code size.
_EXACT = ",".join(f"{name}:{i}" for i, c in enumerate(CITIES, 1) for name in (c[0], c[1], c[1] + "市"))
_BY_LENGTH = ",".join(sorted((c[1] for c in CITIES), key=lambda name: -len(name)))


def city_rank(text: Column) -> Column:
    """Rank of the city a text names, or null.

    A code, short or full name decides first; else the first city whose short name occurs in the
    text, longest short name first, then table order. The expression is row-local: neither a join
    nor a shuffle is needed.
    """
    cleaned = strip(text)
    known = F.str_to_map(F.lit(_EXACT), F.lit(","), F.lit(":"))
    # The one-element transform binds the text once instead of once per city name.
    inside = F.transform(
        F.array(cleaned),
        lambda value: F.get(F.filter(F.split(F.lit(_BY_LENGTH), ","), lambda name: value.contains(name)), F.lit(0)),
    )
    exact = F.try_element_at(known, cleaned)
    return F.coalesce(exact, F.try_element_at(known, F.get(inside, F.lit(0)))).cast("int")


def _pick(rank: Column, values) -> Column:
    return F.get(F.split(F.lit(",".join(str(v) for v in values)), ","), rank - 1)


def city_short_name(rank: Column) -> Column:
    return _pick(rank, [c[1] for c in CITIES])


def city_name(rank: Column) -> Column:
    return _pick(rank, [c[1] + "市" for c in CITIES])


def city_tier(rank: Column) -> Column:
    return F.coalesce(_pick(rank, [c[2] for c in CITIES]), F.lit(UNKNOWN_TIER))


def city_latitude(rank: Column) -> Column:
    return _pick(rank, [c[3] for c in CITIES]).cast("double")


def city_longitude(rank: Column) -> Column:
    return _pick(rank, [c[4] for c in CITIES]).cast("double")


def city_limit(rank: Column) -> Column:
    """Nightly limit of a known city; null for an unknown one."""
    return _pick(rank, [TIER_LIMITS[c[2]] for c in CITIES]).cast("decimal(14,2)")


def city_limit_or_default(rank: Column) -> Column:
    return F.coalesce(city_limit(rank), F.lit(TIER_LIMITS[UNKNOWN_TIER]).cast("decimal(14,2)"))


def city_or_text(text: Column) -> Column:
    """Short name of the city a text names, else the trimmed text; empty text gives null."""
    return F.coalesce(city_short_name(city_rank(text)), F.when(text != "", strip(text)))


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d_lat = F.radians(lat2 - lat1) / 2
    d_lng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(d_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lng), 2)
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))
