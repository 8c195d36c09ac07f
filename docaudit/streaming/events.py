"""Transforms over audit events that run on a table and, unless they say otherwise, on a stream.

Events: event_id, event, task_id, document_id, audit_version, occurred_at, data (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit.functions.ordered import first_per_key
from docaudit.params import DEFAULTS, EVENT_ROLES, AuditParams

# Event types.
EVENT_TYPES = (
    "task_started", "task_progress", "node_status", "evidence_found", "risk_detected", "role_error", "review_reflect",
    "task_completed", "task_failed",
)
TERMINAL = ("task_completed", "task_failed")

# Fields a payload must hold, by event type.
REQUIRED = {
    "task_progress": ("percent",),
    "node_status": ("role", "status"),
    "evidence_found": ("evidence", "highlight_message"),
    "risk_detected": ("finding", "realtime_badge"),
    "task_completed": ("report_id", "overall_risk_level", "risk_score", "high_risks_count", "medium_risks_count", "low_risks_count"),
    "task_failed": ("error_code", "error_detail"),
}
# Names that stand for each other; the first one present fills the others.
ALIASES = (
    ("current_stage", "stage"), ("high_risks_count", "high_count"), ("medium_risks_count", "medium_count"),
    ("low_risks_count", "low_count"), ("duration_ms", "elapsed_ms"),
)
PERCENTAGES = {"task_progress": "percent", "task_completed": "risk_score"}
DEFAULT_STAGE = {"task_started": "STAGE_1_PARSED", "review_reflect": "STAGE_3_REVIEW_REFLECT"}


def _field(name: str) -> Column:
    """Payload field; a name with aliases takes the first one present."""
    for group in ALIASES:
        if name in group:
            return F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in (name, *[g for g in group if g != name])])
    return F.get_json_object("data", f"$.{name}")


def normalize_events(events: DataFrame) -> DataFrame:
    """SM1: alias fields filled both ways, payload checked by type; ``error`` is null for valid events."""
    kind = F.col("event")
    checks = [F.when(~kind.isin(*EVENT_TYPES), F.lit("UNKNOWN_EVENT"))]
    for name, fields in REQUIRED.items():
        missing = F.lit(False)
        for field in fields:
            missing = missing | _field(field).isNull()
        checks.append(F.when((kind == name) & missing, F.lit("FIELD_MISSING")))
    for name, field in PERCENTAGES.items():
        outside = ~F.coalesce(_field(field).try_cast("int").between(0, 100), F.lit(False))
        checks.append(F.when((kind == name) & outside, F.lit("OUT_OF_RANGE")))
    checks.append(F.when((kind == "node_status") & ~_field("role").isin(*EVENT_ROLES), F.lit("UNKNOWN_ROLE")))
    stage = _field("current_stage")
    for name, default in DEFAULT_STAGE.items():
        stage = F.coalesce(stage, F.when(kind == name, F.lit(default)))
    percent = F.when(kind == "task_completed", F.coalesce(_field("percent"), F.lit("100"))).otherwise(_field("percent"))
    counts = {f"{x}_count": _field(f"{x}_risks_count").try_cast("int") for x in ("high", "medium", "low")}
    return events.withColumns({
        "stage": stage, "percent": percent.try_cast("int"), "role": _field("role"),
        "duration_ms": _field("duration_ms").try_cast("bigint"), **counts, "error": F.coalesce(*checks),
    })



def replay_after(events: DataFrame, requests: DataFrame) -> DataFrame:
    """SM2: events of a task after the requested event id; an unknown id replays all.

    ``requests``: task_id, last_event_id (one per task and reader).
    """
    asked = requests.join(
        events.groupBy("task_id", F.col("event_id").alias("last_event_id")).agg(
            F.min(F.struct("occurred_at", "seq")).alias("_from")
        ),
        ["task_id", "last_event_id"], "left",
    )
    return events.join(asked, "task_id").where(
        F.col("_from").isNull() | (F.struct("occurred_at", "seq") > F.col("_from"))
    ).drop("_from")


def task_status(normalized: DataFrame) -> DataFrame:
    """SM3: last event, last known percent and stage, and whether the task has ended."""
    order = F.struct("occurred_at", "seq")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    return normalized.groupBy("task_id").agg(
        F.max_by("event", order).alias("last_event"), last("percent"), last("stage"),
        F.bool_or(F.col("event").isin(*TERMINAL)).alias("is_finished"),
    )


def consume_once(events: DataFrame) -> DataFrame:
    """SM4 on a table: first event per id, then first per task and version."""
    once = first_per_key(events, ["event_id"], [F.col("occurred_at"), F.col("seq")])
    return first_per_key(once, ["task_id", "audit_version"], [F.col("occurred_at"), F.col("seq")])


def missed_deadlines(events: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """SM6 on a table: started tasks without a terminal event inside the deadline."""
    started = events.where("event = 'task_started'").groupBy("task_id").agg(F.min("occurred_at").alias("started_at"))
    ended = events.where(F.col("event").isin(*TERMINAL)).join(started, "task_id").where(
        F.col("occurred_at").between(
            F.col("started_at"), F.col("started_at") + F.make_dt_interval(secs=F.lit(params.task_deadline_s))
        )
    )
    return started.join(ended.select("task_id").distinct(), "task_id", "left_anti")


def distinct_requests(requests: DataFrame) -> DataFrame:
    """SM7 re-aimed: each distinct verdict request once, with how often and when it was made.

    Asking once per distinct request is what a cache of verdicts saves; the cache itself is not rebuilt.
    """
    return requests.groupBy("request_key").agg(
        F.count(F.lit(1)).alias("requests"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )
