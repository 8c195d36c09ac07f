"""Space-time and travel rules over points and travel segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit import params as P
from docaudit.functions import geo
from docaudit.functions.findings import emit, finding_row
from docaudit.functions.ordered import HOT_ROWS, Step, chunked_lag, chunked_scan
from docaudit.functions.scalars import contains_any, is_lodging, strip
from docaudit.params import DEFAULTS, AuditParams

# Fixed patterns: a route "A-B" or "A至B", and a train number.
ROUTE = r"([^\s\-—至]+)[—\-至到]([^\s\-—次]+)"
TRAIN_NUMBER = r"([A-Z]\d{1,4})次?"
# Payload fields of a ticket.
PAYLOAD_FIELDS = (
    "departure_city", "arrival_city", "departure_time", "arrival_time", "train_no", "flight_no", "item_desc",
    "travel_date", "departure_date", "journey_date",
)


def parse_time(text: Column) -> Column:
    """ISO text to timestamp; text that does not start with a date is null."""
    return F.when(strip(text).rlike(r"^\d{4}-\d{2}-\d{2}"), strip(text).try_cast("timestamp"))


def parse_day(text: Column) -> Column:
    return F.when(strip(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(strip(text), 1, 10).try_cast("date"))


def route_from(text: Column) -> Column:
    """Start of the route named in a text, or null."""
    return F.nullif(strip(F.regexp_extract(text, ROUTE, 1)), F.lit(""))


def route_to(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, ROUTE, 2)), F.lit(""))


def train_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TRAIN_NUMBER, 1), F.lit(""))


def first_route_line(lines: DataFrame) -> DataFrame:
    """Per document the first line description that looks like a route."""
    return (
        lines.where(contains_any(F.col("item_desc"), ("-", "—", "至")))
        .groupBy("document_id")
        .agg(F.min_by("item_desc", "line_key").alias("route_line"))
    )


def extract_segments(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Travel segments from invoice payloads; nothing is guessed, missing stays null."""

    def payload(key: str) -> Column:
        return F.nullif(F.col(f"_payload.{key}"), F.lit(""))

    kind = F.coalesce("invoice_type", F.lit(""))
    # Without a payload only a transport type can give a segment; the payload is parsed once.
    parsed = invoices.where(F.col("raw_payload").isNotNull() | contains_any(kind, P.TRANSPORT_WORDS)).select(
        "document_id", "invoice_key", "invoice_number", "invoice_type",
        F.from_json("raw_payload", ", ".join(f"{name} string" for name in PAYLOAD_FIELDS)).alias("_payload"),
    )
    facts = parsed.select(
        "document_id", "invoice_key", "invoice_number", "invoice_type",
        geo.city_or_text(payload("departure_city")).alias("_dep"),
        geo.city_or_text(payload("arrival_city")).alias("_arr"),
        payload("departure_time").alias("_dep_time"),
        payload("arrival_time").alias("_arr_time"),
        F.coalesce(payload("train_no"), payload("flight_no")).alias("_no"),
        payload("item_desc").alias("_desc"),
        F.coalesce(payload("travel_date"), payload("departure_date"), payload("journey_date")).alias("_day"),
    )
    needs_text = (F.col("_dep").isNull() | F.col("_arr").isNull()) & contains_any(kind, P.TICKET_WORDS)
    facts = facts.join(first_route_line(lines), "document_id", "left").withColumn(
        "_text", F.when(needs_text, F.coalesce("_desc", "route_line"))
    )
    dep = F.coalesce(F.col("_dep"), geo.city_or_text(route_from(F.col("_text"))))
    arr = F.coalesce(F.col("_arr"), geo.city_or_text(route_to(F.col("_text"))))
    kept = facts.withColumn("departure_city", dep).withColumn("arrival_city", arr).where(
        F.col("departure_city").isNotNull()
        | F.col("arrival_city").isNotNull()
        | contains_any(kind, P.TRANSPORT_WORDS)
    )
    return kept.select(
        "document_id",
        F.col("invoice_key").alias("segment_id"),
        F.coalesce("departure_city", F.lit("")).alias("departure_city"),
        F.coalesce("arrival_city", F.lit("")).alias("arrival_city"),
        parse_time(F.col("_dep_time")).alias("departure_time"),
        parse_time(F.col("_arr_time")).alias("arrival_time"),
        parse_day(F.col("_day")).alias("travel_date"),
        F.when(contains_any(kind, ("铁", "车")), F.lit("TRAIN")).otherwise(F.lit("FLIGHT")).alias("transport_mode"),
        F.coalesce(F.col("_no"), train_number(F.col("_text"))).alias("transport_no"),
        "invoice_number",
    )


def resolve_segments(segments: DataFrame) -> DataFrame:
    """Given segments win over extracted ones; only their cities are resolved."""
    return segments.withColumn("departure_city", geo.city_or_text(F.col("departure_city"))).withColumn(
        "arrival_city", geo.city_or_text(F.col("arrival_city"))
    )


def line_points(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """City-centre points of travel documents: lines with a known city and a start date."""
    travel = documents.where(F.col("document_type") == P.TRAVEL).select("document_id")
    rank = F.col("_rank")
    return (
        lines.where(F.col("start_date").isNotNull())
        .withColumn("_rank", geo.city_rank(F.col("city_name")))
        .where(rank.isNotNull())
        .join(travel, "document_id", "left_semi")
        .select(
            F.col("document_id").alias("scope_id"),
            F.col("line_no").cast("bigint").alias("point_no"),
            F.col("line_key").alias("point_id"),
            F.col("start_date").cast("timestamp").alias("event_time"),
            geo.city_name(rank).alias("city_name"),
            geo.city_latitude(rank).alias("latitude"),
            geo.city_longitude(rank).alias("longitude"),
            F.coalesce("item_desc", F.lit("")).alias("source_desc"),
        )
    )


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def point_pairs(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every point with the point before it in its scope; points of one instant follow their number."""
    return chunked_lag(
        points, ["scope_id"], ["event_time", "point_no", "point_id"],
        ["point_id", "event_time", "city_name", "latitude", "longitude"], hot_rows=hot_rows,
    )


def point_collisions(points: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """R09: neighbours in time at least 100 km apart, at the same instant or faster than possible."""
    prev = F.col("prev")
    pairs = (
        point_pairs(points)
        .where(prev.isNotNull())
        .withColumn("km", geo.distance_km(prev["latitude"], prev["longitude"], F.col("latitude"), F.col("longitude")))
        .withColumn("hours", _hours(F.col("event_time"), prev["event_time"]))
        .where(F.col("km") >= params.min_distance_km)
    )
    same = F.col("hours") <= 0
    # km / hours > limit, written without dividing by zero.
    fast = (F.col("hours") < params.speed_window_hours) & (F.col("km") > params.max_speed_kmh * F.col("hours"))
    hits = pairs.where(same | fast).withColumn("document_id", F.col("scope_id"))
    return emit(hits, finding_row(
        "collision",
        F.concat_ws("|", prev["point_id"], F.col("point_id")),
        title=F.concat(prev["city_name"], F.lit(" 与 "), F.col("city_name"), F.lit(" 时空冲突")),
        actual={
            "distance_km": F.round("km", 2),
            "delta_hours": F.round("hours", 4),
            "is_simultaneous": same,
        },
        expected={"max_realistic_speed_kmh": F.lit(params.max_speed_kmh)},
    ))


def _touches(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def claimed_cities(lines: DataFrame) -> DataFrame:
    """Distinct (document, city) of the lines, cities resolved where known."""
    name = geo.city_short_name(geo.city_rank(F.col("city_name")))
    return (
        lines.where(F.coalesce("city_name", F.lit("")) != "")
        .select("document_id", F.coalesce(name, F.col("city_name")).alias("claim"))
        .distinct()
    )


def _endpoint_names(segments: DataFrame) -> DataFrame:
    def name(column: str) -> Column:
        text = F.coalesce(column, F.lit(""))
        return F.coalesce(geo.city_short_name(geo.city_rank(text)), text)

    return segments.withColumn("_dep", name("departure_city")).withColumn("_arr", name("arrival_city"))


def destination_mismatch(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """R09: a segment none of whose ends matches a claimed city (documents with claims only).

    Distinct routes meet distinct claims on the document, so copies cost nothing.
    """
    named = _endpoint_names(segments)
    routes = named.select("document_id", "_dep", "_arr").distinct()
    missed = (
        routes.join(claimed_cities(lines), "document_id")
        .groupBy("document_id", "_dep", "_arr")
        .agg(F.bool_or(_touches(F.col("_dep"), F.col("claim")) | _touches(F.col("_arr"), F.col("claim"))).alias("hit"))
        .where(~F.col("hit"))
    )
    return emit(named.join(missed, ["document_id", "_dep", "_arr"]), finding_row(
        "destination",
        F.col("segment_id"),
        title=F.concat(F.lit("行程目的地与申报城市不符: "), F.col("arrival_city")),
        actual={"ticket_from": F.col("departure_city"), "ticket_to": F.col("arrival_city")},
        expected={"destination_matches_claim": F.lit(True)},
    ))


def hotel_before_arrival(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """R09: lodging in the arrival city dated before the arrival.

    A stay can only precede an arrival if it starts before its document's last one, and the other way round, so two
    aggregates leave out most rows before stays meet arrivals.
    """
    stays = lines.where(
        is_lodging(F.col("expense_type"), F.col("item_desc"))
        & (F.coalesce("city_name", F.lit("")) != "")
        & F.col("start_date").isNotNull()
    ).select(
        "document_id", "line_key", "start_date",
        F.coalesce(geo.city_short_name(geo.city_rank(F.col("city_name"))), F.col("city_name")).alias("_city"),
    )
    arrivals = _endpoint_names(segments).select(
        "document_id", "segment_id", "_arr",
        F.coalesce(F.to_date("arrival_time"), "travel_date").alias("arrival_day"),
    ).where(F.col("arrival_day").isNotNull())
    last = arrivals.groupBy("document_id").agg(F.max("arrival_day").alias("_last"))
    early = stays.join(last, "document_id").where(F.col("start_date") < F.col("_last")).drop("_last")
    first = early.groupBy("document_id").agg(F.min("start_date").alias("_first"))
    late = arrivals.join(first, "document_id").where(F.col("arrival_day") > F.col("_first")).drop("_first")
    hits = early.join(late, "document_id").where(
        (F.col("start_date") < F.col("arrival_day")) & _touches(F.col("_city"), F.col("_arr"))
    )
    return emit(hits, finding_row(
        "hotel_date",
        F.concat_ws("|", "line_key", "segment_id"),
        title=F.concat(F.lit("住宿日期早于到达日期: "), F.col("start_date").cast("string")),
        actual={"hotel_date": F.col("start_date"), "arrival_date": F.col("arrival_day")},
        expected={"hotel_date_after_or_on_arrival": F.lit(True)},
    ))


def segment_overlaps(segments: DataFrame, prev_max: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """R09: the next segment departs before the previous one arrives.

    The previous one is the neighbour by departure, or with ``prev_max`` the one of all earlier departures that arrives
    last, so a short trip inside a long one hides nothing.
    """
    timed = segments.where(F.col("departure_time").isNotNull() & F.col("arrival_time").isNotNull())
    carried = F.struct("arrival_time", "segment_id", "departure_time", "transport_no")
    step = Step("max" if prev_max else "last", carried)
    pairs = chunked_scan(timed, ["document_id"], ["departure_time", "segment_id"], {"prev": step}, hot_rows)
    hits = pairs.where(F.col("departure_time") < F.col("prev.arrival_time"))
    return emit(hits, finding_row(
        "overlap",
        F.concat_ws("|", F.col("prev.segment_id"), "segment_id"),
        title=F.lit("行程时间重叠" if prev_max else "相邻行程时间重叠"),
        actual={"previous_arrival": F.col("prev.arrival_time"), "departure": F.col("departure_time")},
        expected={"overlap_allowed": F.lit(False)},
    ))


def transit_collisions(segments: DataFrame, points: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """R09: a point during a segment, 100 km or more from both ends; an unknown end is far away.

    Segments first meet the days on which their document has points at all, so a mistyped year makes no rows; the join
    with the points then has the day as second equality key.
    """
    dep, arr = geo.city_rank(F.col("departure_city")), geo.city_rank(F.col("arrival_city"))
    trips = (
        segments.where(F.col("departure_time").isNotNull() & (F.col("arrival_time") >= F.col("departure_time")))
        .select(
            "document_id", "segment_id", "departure_time", "arrival_time",
            geo.city_latitude(dep).alias("_dlat"), geo.city_longitude(dep).alias("_dlng"),
            geo.city_latitude(arr).alias("_alat"), geo.city_longitude(arr).alias("_alng"),
        )
    )
    seen = points.select(
        F.col("scope_id").alias("document_id"), "point_id", "event_time", "city_name", "latitude", "longitude",
        F.to_date("event_time").alias("_day"),
    )
    days = seen.select("document_id", "_day").distinct()
    trips = trips.join(days, "document_id").where(F.col("_day").between(F.to_date("departure_time"), F.to_date("arrival_time")))

    def far(lat: str, lng: str) -> Column:
        km = geo.distance_km(F.col("latitude"), F.col("longitude"), F.col(lat), F.col(lng))
        return F.coalesce(km, F.lit(params.unknown_distance_km)) >= params.min_distance_km

    hits = trips.join(seen, ["document_id", "_day"]).where(
        F.col("event_time").between(F.col("departure_time"), F.col("arrival_time"))
        & far("_dlat", "_dlng") & far("_alat", "_alng")
    )
    return emit(hits, finding_row(
        "transit_collision",
        F.concat_ws("|", "segment_id", "point_id"),
        title=F.concat(F.lit("行程途中在异地消费: "), F.col("city_name")),
        actual={"point_city": F.col("city_name"), "point_time": F.col("event_time")},
        expected={"simultaneous_transit_and_remote_consumption": F.lit(False)},
    ))


def _missing(column: str) -> Column:
    return F.coalesce(strip(F.col(column)), F.lit("")) == ""


def segment_facts(segments: DataFrame) -> DataFrame:
    """Per document: segment count and how many lack a route, a date, a departure or an arrival time."""
    route = _missing("departure_city") | _missing("arrival_city")
    day = F.col("travel_date").isNull() & F.col("departure_time").isNull()

    def count(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    return segments.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        count(route, "no_route"),
        count(day, "no_date"),
        count(F.col("departure_time").isNull(), "no_departure"),
        count(F.col("arrival_time").isNull(), "no_arrival"),
        count(F.col("departure_time").isNotNull() & F.col("arrival_time").isNotNull(), "exact_times"),
    )


def missing_segment_fields(segments: DataFrame) -> DataFrame:
    """One row per segment and missing field, for the reader of a blocked capability."""
    fields = F.array(
        F.when(_missing("departure_city") | _missing("arrival_city"), F.lit("route")),
        F.when(F.col("travel_date").isNull() & F.col("departure_time").isNull(), F.lit("travel_date")),
        F.when(F.col("departure_time").isNull(), F.lit("departure_time")),
        F.when(F.col("arrival_time").isNull(), F.lit("arrival_time")),
    )
    return segments.select("document_id", "segment_id", F.explode(F.array_compact(fields)).alias("missing_field"))
