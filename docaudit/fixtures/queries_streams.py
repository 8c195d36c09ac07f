"""Queries for event processing, on tables and as streams over the driver's event file."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.fixtures.oracle_parts import IDENTITY
from docaudit.fixtures.registry import query
from docaudit.fixtures.views import VIEWS, SparkDialect
from docaudit.params import DEFAULTS
from docaudit.schemas import EVENTS, names
from docaudit.session import new_path
from docaudit.sources import tables
from docaudit.streaming import events as E, jobs as J


#: Files of the claim stream that make one micro-batch.
FILES_PER_BATCH = 256


def event_stream(t, view: str = "v_audit_events"):
    """The view over the driver's events read as a stream."""
    source = t.source("events")
    raw = t.spark.readStream.schema(source.schema).parquet(f"{t.sf_dir}/events.parque[t]")
    raw.createOrReplaceTempView("docaudit_stream_events")
    return t.spark.sql(VIEWS[view](SparkDialect).replace(SparkDialect.t("events"), "docaudit_stream_events"))


_J = "json_extract_string(data, '$.{0}')"


def _f(*names):
    return "coalesce(" + ", ".join(_J.format(n) for n in names) + ")"


_NORM = f"""nx as (select *, coalesce({_f('current_stage', 'stage')}, case event when 'task_started' then 'STAGE_1_PARSED' when 'review_reflect' then 'STAGE_3_REVIEW_REFLECT' end) as stage,
      try_cast(case when event = 'task_completed' then coalesce({_J.format('percent')}, '100') else {_J.format('percent')} end as int) as percent, {_J.format('role')} as role,
      try_cast({_f('duration_ms', 'elapsed_ms')} as bigint) as duration_ms, try_cast({_f('high_risks_count', 'high_count')} as int) as high_count,
      try_cast({_f('medium_risks_count', 'medium_count')} as int) as medium_count, try_cast({_f('low_risks_count', 'low_count')} as int) as low_count,
      case when event in ('evidence_found', 'risk_detected') then 'FIELD_MISSING'
        when event = 'task_progress' and {_J.format('percent')} is null then 'FIELD_MISSING'
        when event = 'node_status' and ({_J.format('role')} is null or {_J.format('status')} is null) then 'FIELD_MISSING'
        when event = 'task_completed' and ({_J.format('report_id')} is null or {_J.format('overall_risk_level')} is null or {_J.format('risk_score')} is null
          or {_f('high_risks_count', 'high_count')} is null or {_f('medium_risks_count', 'medium_count')} is null or {_f('low_risks_count', 'low_count')} is null) then 'FIELD_MISSING'
        when event = 'task_failed' and ({_J.format('error_code')} is null or {_J.format('error_detail')} is null) then 'FIELD_MISSING'
        when event = 'task_progress' and not try_cast({_J.format('percent')} as int) between 0 and 100 then 'OUT_OF_RANGE'
        when event = 'task_completed' and not try_cast({_J.format('risk_score')} as int) between 0 and 100 then 'OUT_OF_RANGE'
        when event = 'node_status' and {_J.format('role')} not in ('supervisor', 'document_agent', 'amount_agent', 'policy_agent', 'anomaly_agent', 'supplier_agent', 'reviewer_agent', 'report_agent') then 'UNKNOWN_ROLE'
      end as error from v_audit_events)"""
_NORM_COLUMNS = "seq, event, stage, percent, role, duration_ms, high_count, medium_count, low_count, error"


@query("sm1_event_normalization", ["v_audit_events"], f"with {_NORM} select {_NORM_COLUMNS} from nx")
def _(t):
    return E.normalize_events(t.audit_events).select(*_NORM_COLUMNS.split(", "))


_REPLAY_REQUESTS = """select task_id, case when document_id % 4 = 0 then 'unknown' else mid end as last_event_id from (
      select task_id, document_id, max(case when seq % 3 = 0 then event_id end) as mid from {view} group by task_id, document_id)"""


@query("sm2_replay_after", ["v_audit_events"], f"""
    with rq as ({_REPLAY_REQUESTS.format(view='v_audit_events')}),
    p as (select rq.task_id, rq.last_event_id, arg_min(e.occurred_at, (e.occurred_at, e.seq)) as fat, arg_min(e.seq, (e.occurred_at, e.seq)) as fseq
      from rq left join v_audit_events e on e.task_id = rq.task_id and e.event_id = rq.last_event_id group by 1, 2)
    select e.task_id, e.seq from v_audit_events e join p using (task_id) where fat is null or e.occurred_at > fat or (e.occurred_at = fat and e.seq > fseq)""")
def _(t):
    events = t.audit_events
    mids = events.groupBy("task_id", "document_id").agg(F.max(F.when(F.col("seq") % 3 == 0, F.col("event_id"))).alias("mid"))
    requests = mids.select(
        "task_id", F.when(F.col("document_id") % 4 == 0, F.lit("unknown")).otherwise(F.col("mid")).alias("last_event_id")
    )
    return E.replay_after(events, requests).select("task_id", "seq")


_STATUS = f"""with {_NORM} select task_id, arg_max(event, (occurred_at, seq)) as last_event, arg_max(percent, (occurred_at, seq)) filter (where percent is not null) as percent,
      arg_max(stage, (occurred_at, seq)) filter (where stage is not null) as stage, bool_or(event in ('task_completed', 'task_failed')) as is_finished from nx group by 1"""


@query("sm3_task_status", ["v_audit_events"], _STATUS)
def _(t):
    return E.task_status(E.normalize_events(t.audit_events))


@query("sm3_task_status_stream", ["v_audit_events"], _STATUS)
def _(t):
    stream = E.task_status(E.normalize_events(event_stream(t)))
    return J.newest(J.run_available(stream, "update"), ["task_id"])


_ONCE = """
    with a as (select * from (select *, row_number() over (partition by event_id order by occurred_at, seq) as r from v_audit_events) where r = 1)
    select task_id, audit_version, event_id from (select *, row_number() over (partition by task_id, audit_version order by occurred_at, seq) as q from a) where q = 1"""


@query("sm4_consume_once", ["v_audit_events"], _ONCE)
def _(t):
    return E.consume_once(t.audit_events).select("task_id", "audit_version", "event_id")


@query("sm4_consume_once_stream", ["v_audit_events"], _ONCE)
def _(t):
    landed = J.run_available(event_stream(t), "append", J.ConsumeOnce())
    return landed.where("accepted").select("task_id", "audit_version", "event_id")


def _run_completeness(t):
    """Completeness per document from its role runs."""
    bad, weak = F.col("status").isin("SKIPPED", "TIMEOUT", "FAILED"), F.col("status") == "DEGRADED"
    value = F.when(F.bool_or(bad), F.lit("INCOMPLETE")).when(F.bool_or(weak), F.lit("DEGRADED")).otherwise(F.lit("COMPLETE"))
    return t.role_runs.groupBy("document_id").agg(value.alias("audit_completeness"))


@query("sm5_completion_stream", ["v_audit_events", "v_documents", "v_stored_findings", "v_role_runs"], f"""
    with e as (select * from (select *, row_number() over (partition by task_id, audit_version order by occurred_at, seq) as r from v_audit_events
        where event in ('task_completed', 'task_failed')) where r = 1),
    fl as (select document_id, bool_or(risk_level = 'high' and not is_overridable) as veto, bool_or(rule_code = 'R14_MISSING_INVOICE') as missing from v_stored_findings group by 1),
    co as (select document_id, case when bool_or(status in ('SKIPPED','TIMEOUT','FAILED')) then 'INCOMPLETE' when bool_or(status = 'DEGRADED') then 'DEGRADED' else 'COMPLETE' end as c from v_role_runs group by 1),
    x as (select e.*, event = 'task_completed' as ok, d.document_id is not null as known, d.total_amount as amount, json_extract_string(data, '$.overall_risk_level') as lvl,
        coalesce(veto, false) as veto, coalesce(missing, false) as missing, coalesce(c, 'COMPLETE') as c
      from e left join v_documents d using (document_id) left join fl using (document_id) left join co using (document_id)),
    y as (select *, case when ok and not known then 'DOCUMENT_MISSING' when ok and amount is null then 'TOTAL_MISSING' end as err from x),
    z as (select *, case when not ok or err is not null then null when veto then 'REJECT' when lvl = 'high' and missing then 'NEED_SUPPLEMENT' when c <> 'COMPLETE' or lvl = 'high' then 'MANUAL_REVIEW'
      when lvl = 'low' and amount <= {DEFAULTS.auto_approve_limit} then 'AUTO_APPROVE' else 'MANUAL_REVIEW' end as action from y)
    select task_id, audit_version, document_id, case when ok then 'COMPLETED' else 'FAILED' end as status,
      case when not ok then coalesce(json_extract_string(data, '$.error_detail'), json_extract_string(data, '$.error_code')) end as message, action,
      case action when 'AUTO_APPROVE' then 'APPROVED' when 'MANUAL_REVIEW' then 'PENDING_APPROVAL' when 'REJECT' then 'REJECTED' when 'NEED_SUPPLEMENT' then 'NEED_SUPPLEMENT' end as target_state, err as workflow_error
    from z""")
def _(t):
    handler = J.CompletionHandler(t.documents, t.stored_findings, _run_completeness(t))
    landed = J.run_available(event_stream(t), "append", handler)
    return landed.select("task_id", "audit_version", "document_id", "status", "message", "action", "target_state", "workflow_error")


_MISSED = """
    with s as (select task_id, min(occurred_at) as started_at from {view} where event = 'task_started' group by 1),
    w as (select distinct s.task_id from s join {view} e on e.task_id = s.task_id and e.event in ('task_completed', 'task_failed')
      and e.occurred_at between s.started_at and s.started_at + to_seconds(120))
    select s.task_id, epoch_us(s.started_at){div} as {name} from s where s.task_id not in (select task_id from w)"""
_JUDGED = " and s.started_at + to_seconds(720) <= (select max(occurred_at) from {view})"


@query("sm6_missed_deadlines", ["v_audit_events"], _MISSED.format(view="v_audit_events", div="", name="started_us"))
def _(t):
    return E.missed_deadlines(t.audit_events).select("task_id", F.unix_micros("started_at").alias("started_us"))


@query("sm6_deadline_stream", ["v_audit_events"], (_MISSED + _JUDGED).format(view="v_audit_events", div=" // 1000", name="started_ms"))
def _(t):
    landed = J.run_available(event_stream(t), "append", J.DeadlineHandler())
    return J.DeadlineHandler.missed(landed).select("task_id", F.unix_millis("started_at").alias("started_ms"))


@query("sm6_deadline_ends", ["v_deadline_events"], _MISSED.format(view="v_deadline_events", div="", name="started_us"))
def _(t):
    return E.missed_deadlines(t.deadline_events).select("task_id", F.unix_micros("started_at").alias("started_us"))


@query("sm6_deadline_ends_stream", ["v_deadline_events"], (_MISSED + _JUDGED).format(view="v_deadline_events", div=" // 1000", name="started_ms"))
def _(t):
    landed = J.run_available(event_stream(t, "v_deadline_events"), "append", J.DeadlineHandler())
    return J.DeadlineHandler.missed(landed).select("task_id", F.unix_millis("started_at").alias("started_ms"))


@query("sm7_distinct_requests", ["v_verdict_requests"], """
    select request_key, count(*) as requests, epoch_us(min(occurred_at)) as first_us, epoch_us(max(occurred_at)) as last_us from v_verdict_requests group by 1""")
def _(t):
    asked = E.distinct_requests(t.verdict_requests)
    return asked.select("request_key", "requests", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query("sm8_duplicate_stream", ["v_invoices", "v_documents"], f"""
    with k as (select i.document_id, invoice_key, {IDENTITY} as identity_key, cast(coalesce(i.total_amount, 0) as decimal(38,2)) as amount,
        d.status in ({', '.join(f"'{x}'" for x in DEFAULTS.active_statuses)}) as active from v_invoices i join v_documents d using (document_id)),
    c as materialized (select * from k where identity_key is not null),
    f as (select identity_key, document_id, min(invoice_key) as fk, arg_min(amount, invoice_key) as fa from c group by 1, 2),
    ac as (select identity_key, document_id, arg_max(amount, invoice_key) as aa from c where active group by 1, 2),
    tp as (select *, row_number() over (partition by identity_key order by document_id desc) as rn from ac),
    x as (select c.*, fk < invoice_key as later, fa, case when t1.document_id <> c.document_id then t1.document_id when t2.document_id <> c.document_id then t2.document_id end as od,
        case when t1.document_id <> c.document_id then t1.aa when t2.document_id <> c.document_id then t2.aa end as oa
      from c join f using (identity_key, document_id) left join tp t1 on t1.identity_key = c.identity_key and t1.rn = 1 left join tp t2 on t2.identity_key = c.identity_key and t2.rn = 2)
    select document_id, invoice_key, identity_key, case when later then 'inside' else 'across' end as kind, case when later then document_id else od end as conflict_document,
      case when later then fa else oa end <> amount as amount_changed from x where later or od is not null""")
def _(t):
    # The columns a claim is made of; payloads and amounts that no rule of the job reads are not stored with it.
    claims = t.invoices.select("document_id", "invoice_key", "invoice_code", "invoice_number", "total_amount").join(
        t.documents.select("document_id", "document_no", "status"), "document_id"
    )
    folder = new_path(t.spark, "claims")
    claims.write.parquet(folder)
    stream = t.spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)
    landed = J.run_available(stream, "append", J.DuplicateHandler()).where("kind is not null")
    return landed.select("document_id", "invoice_key", "identity_key", "kind", "conflict_document", "amount_changed")


@query("io10_event_stream", ["v_audit_events"], "select seq, event_id, event, task_id from v_audit_events")
def _(t):
    folder = new_path(t.spark, "events")
    t.audit_events.select(*names(EVENTS)).write.parquet(folder)
    stream = tables.read_event_stream(t.spark, folder).select("seq", "event_id", "event", "task_id")
    return J.run_available(stream, "append").drop("batch")
