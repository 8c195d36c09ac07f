"""Railway tickets from text tokens: detection and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit.functions import geo
from docaudit.functions.scalars import contains_any
from docaudit.operators.extract import _first, _found, money_candidates

# Fixed patterns.
TRAIN = r"(?<![A-Za-z0-9])([GDCKTZ]\d{1,4})(?![A-Za-z0-9])"
LEAVES = r"(?U)\d{1,2}:\d{2}\s*开"
TRAIN_TO_STATION = r"(?U)[GDCKTZ]\d{1,4}[·\-\s至到][^\s·至到\d]+站"
ARRIVAL = r"(?U)[GDCKTZ]\d{1,4}[·\-\s至到]+([^\s·至到\d]+(?:站)?)"
STATION = r"(?U)([^\s·至到\d]+站)"
DEPARTS = (
    r"(?U)([0-9]{4})\s*[年\-\.\/]\s*([0-9]{1,2})\s*[月\-\.\/]\s*([0-9]{1,2})\s*日?\s*([0-9]{1,2})[:：]([0-9]{2})\s*开?"
)
TICKET_TOP = r"(?U)\b([A-Z][0-9A-Z]{6,12})\b"
TICKET_ANY = r"(?U)\b([A-Z][0-9A-Z]{7,12})\b"
PASSENGER = r"\d{6}[\d\*]{6,12}[0-9Xx*]{1,4}\s*([\u4e00-\u9fa5]{2,4})"

# Seats in order of preference, and wording of a ticket.
SEATS = ("商务座", "特等座", "一等座", "二等座", "高级软卧", "软卧", "硬卧", "动卧", "硬座", "软座", "无座")
TICKET_WORDS = ("限乘当日当次车",) + SEATS


def train_tickets(tokens: DataFrame) -> DataFrame:
    """EX13: is a file a railway ticket."""
    text = F.col("text")
    flags = tokens.groupBy("file_id").agg(
        F.bool_or(contains_any(text, TICKET_WORDS)).alias("words"),
        F.bool_or(text.rlike(TRAIN)).alias("train"),
        F.bool_or(text.contains("站")).alias("station"),
        F.bool_or(text.rlike(LEAVES) | text.contains("开")).alias("leaves"),
        F.bool_or(text.rlike(TRAIN_TO_STATION)).alias("adjacent"),
    )
    words, train, station = F.col("words"), F.col("train"), F.col("station")
    hit = (words & (train | station)) | (train & station & F.col("leaves")) | F.col("adjacent")
    return flags.select("file_id", hit.alias("is_train_ticket"))


def _city(station: Column) -> Column:
    return F.coalesce(geo.city_short_name(geo.city_rank(station)), F.regexp_replace(station, "站", ""))


def parse_tickets(tokens: DataFrame) -> DataFrame:
    """EX14: one row per ticket file; the arrival time is never guessed."""
    text = F.col("text")
    train, arrival = _found(text, TRAIN), _found(text, ARRIVAL)
    year = F.regexp_extract(text, DEPARTS, 1)
    day = F.format_string("%04d-%02d-%02d", *[_found(text, DEPARTS, g).try_cast("int") for g in (1, 2, 3)])
    clock = F.format_string("T%02d:%02d:00", *[_found(text, DEPARTS, g).try_cast("int") for g in (4, 5)])
    departs = F.struct(day.alias("day"), F.concat(day, clock).alias("time"))
    top, anywhere, passenger = _found(text, TICKET_TOP), _found(text, TICKET_ANY), _found(text, PASSENGER)
    seats = [_first(F.lit(seat), text.contains(seat)).alias(f"_seat{i}") for i, seat in enumerate(SEATS)]
    fields = tokens.groupBy("file_id").agg(
        _first(train, train.isNotNull()).alias("train_no"),
        _first(arrival, arrival.isNotNull()).alias("_arrival"),
        _first(departs, year != "").alias("_departs"),
        _first(top, top.isNotNull() & (F.col("ymin") < 250)).alias("_top"),
        _first(anywhere, anywhere.isNotNull()).alias("_any"),
        _first(passenger, passenger.isNotNull()).alias("passenger_name"),
        *seats,
    )
    stations = tokens.where(
        text.contains("站") & ~text.endswith("售") & ~text.contains("检票") & ~text.contains("限乘")
    ).select("file_id", "token_idx", "xmin", _found(text, STATION).alias("station")).where(F.col("station").isNotNull())
    place = F.struct(F.coalesce("xmin", F.lit(0)), "token_idx")
    found = stations.join(fields.select("file_id", "_arrival"), "file_id").groupBy("file_id").agg(
        _first(F.col("station"), F.col("_arrival").isNull() | (F.col("station") != F.col("_arrival"))).alias("_departure"),
        F.min_by("station", place).alias("_left"), F.max_by("station", place).alias("_right"),
        F.count(F.lit(1)).alias("_stations"),
    )
    explicit = contains_any(text, ("¥", "￥", "$", "元"))
    fares = money_candidates(tokens).groupBy("file_id").agg(
        F.coalesce(_first(F.col("cents"), explicit, "idx"), F.min_by("cents", "idx")).alias("cents")
    )
    several = F.coalesce(F.col("_stations") >= 2, F.lit(False))
    departure = F.coalesce("_departure", F.when(several, F.col("_left")))
    arrived = F.coalesce("_arrival", F.when(several, F.col("_right")))
    number = F.coalesce("_top", "_any")
    fare = (F.col("cents") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)")
    success = (F.col("train_no").isNotNull() | number.isNotNull()) & (departure.isNotNull() | arrived.isNotNull())
    status = F.when(fare.isNull(), F.lit("FAILED")).when(success, F.lit("SUCCESS")).otherwise(F.lit("NEED_REVIEW"))
    return fields.join(found, "file_id", "left").join(fares, "file_id", "left").select(
        "file_id", "train_no", departure.alias("departure_station"), arrived.alias("arrival_station"),
        _city(departure).alias("departure_city"), _city(arrived).alias("arrival_city"),
        F.col("_departs.day").alias("travel_date"), F.col("_departs.time").alias("departure_time"),
        F.coalesce(*[f"_seat{i}" for i in range(len(SEATS))]).alias("seat_type"),
        number.alias("ticket_number"), "passenger_name", fare.alias("total_amount"), status.alias("parse_status"),
    )
