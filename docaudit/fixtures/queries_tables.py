"""Queries for sources and sinks, lifecycle, workflow, reports and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.fixtures.oracle_parts import CITY
from docaudit.fixtures.registry import query
from docaudit.functions import geo
from docaudit.operators import analytics as A, lifecycle as L, workflow as W
from docaudit.session import new_path
from docaudit.sources import sinks, tables

# ---------------------------------------------------------------- sources and sinks


@query("io1_filtered_scan", ["v_documents"], """
    select document_id, document_no, total_amount from v_documents where status = 'APPROVED' and document_type = 'CORP_PAYMENT'
    order by document_id limit 50 offset 20""")
def _(t):
    page = tables.filtered_scan(
        t.documents, ["document_id"], skip=20, limit=50, status="APPROVED", document_type="CORP_PAYMENT", currency=None
    )
    return page.select("document_id", "document_no", "total_amount")


@query("io2_filtered_count", ["v_documents"], "select count(*) as n from v_documents where status = 'APPROVED'")
def _(t):
    return tables.filtered_count(t.documents, status="APPROVED", document_type=None)


@query("io3_natural_key", ["v_documents"], """
    select document_id, document_no, status from v_documents where document_no in ('DOC-0000000007', 'DOC-0000001003')""")
def _(t):
    return tables.lookup(t.documents, "document_no", ["DOC-0000000007", "DOC-0000001003"]).select(
        "document_id", "document_no", "status"
    )


@query("io4_document_with_children", ["v_documents", "v_lines", "v_attachments", "v_invoices", "v_users"], """
    select d.document_id, d.document_no, u.real_name as applicant_name, coalesce(l.n, 0) as line_count, coalesce(a.n, 0) as attachment_count,
      coalesce(i.n, 0) as invoice_count, i.s as invoice_sum
    from v_documents d left join (select document_id, count(*) as n from v_lines group by 1) l using (document_id)
    left join (select document_id, count(*) as n from v_attachments group by 1) a using (document_id)
    left join (select document_id, count(*) as n, cast(sum(total_amount) as decimal(38,2)) as s from v_invoices group by 1) i using (document_id)
    left join v_users u on u.user_id = d.applicant_id""")
def _(t):
    out = tables.with_children(t.documents, t.lines, t.attachments, t.invoices, t.users)
    return out.select(
        "document_id", "document_no", "applicant_name", "line_count", "attachment_count", "invoice_count", "invoice_sum"
    )


@query("io5_payload_value", ["v_invoices"], """
    select document_id, invoice_key, coalesce(nullif(invoice_type, ''), json_extract_string(raw_payload, '$.invoice_type')) as invoice_type,
      json_extract_string(raw_payload, '$.departure_city') as departure_city from v_invoices""")
def _(t):
    return t.invoices.select(
        "document_id", "invoice_key", tables.payload_value(t.invoices, "invoice_type").alias("invoice_type"),
        tables.payload_value(t.invoices, "departure_city").alias("departure_city"),
    )


@query("io6_content_hash", [], """
    select doc_id, sha256(text) as file_hash, cast(strlen(text) as bigint) as file_size_bytes from documents""")
def _(t):
    return tables.text_fingerprints(t.source("documents"), "doc_id", "text")


def _saved(t, name: str):
    """A report store that held all reports, after re-audits of every third document were saved into it."""
    old = t.reports.select("task_id", "document_id", "overall_risk_level", "final_score")
    new = t.reports.where("report_id = document_id").select(
        "task_id", "document_id", F.lit("low").alias("overall_risk_level"), F.lit(100).alias("final_score")
    )
    found = t.stored_findings.select(
        F.concat(F.lit("T"), F.col("report_id").cast("string")).alias("task_id"), "finding_id", "rule_code"
    )
    fresh = new.select("task_id", F.lit("new").alias("finding_id"), F.lit("R01_HEADER_LINE_MISMATCH").alias("rule_code"))
    tasks = t.reports.where("report_id % 2 = 0").select(
        "task_id", "document_id", F.lit("RUNNING").alias("status"), F.lit(70).alias("progress_pct")
    )
    store = sinks.ReportStore(t.spark, new_path(t.spark, "reports"))
    store.load(old, found, tasks)
    store.save(new, fresh)
    return store.read(name)


@query("io7_report_upsert", ["v_reports"], """
    select task_id, document_id, case when report_id = document_id then 'low' else overall_risk_level end as overall_risk_level,
      case when report_id = document_id then 100 else final_score end as final_score from v_reports""")
def _(t):
    return _saved(t, "reports")


@query("io7_finding_replace", ["v_reports", "v_stored_findings"], """
    select 'T' || cast(report_id as varchar) as task_id, finding_id, rule_code from v_stored_findings where report_id <> document_id
    union all select task_id, 'new', 'R01_HEADER_LINE_MISMATCH' from v_reports where report_id = document_id""")
def _(t):
    return _saved(t, "findings")


@query("io7_task_completion", ["v_reports"], """
    select task_id, document_id, case when report_id = document_id then 'COMPLETED' else 'RUNNING' end as status,
      case when report_id = document_id then 100 else 70 end as progress_pct from v_reports where report_id = document_id or report_id % 2 = 0""")
def _(t):
    return _saved(t, "tasks")


@query("io8_version_snapshot", ["v_documents", "v_lines", "v_attachments"], """
    select document_id, current_version as version_no, 'document' as part, '' as part_key, cast(json_object('document_no', document_no, 'document_type', document_type, 'title', title,
      'total_amount', cast(total_amount as varchar), 'currency', 'CNY', 'status', status, 'current_version', current_version, 'is_manual_override', document_id % 5 = 0) as varchar) as payload from v_documents
    union all select l.document_id, d.current_version, 'line', l.line_key, cast(json_object('line_no', l.line_no, 'expense_type', l.expense_type, 'item_desc', l.item_desc, 'amount', l.amount,
      'city_name', l.city_name) as varchar) from v_lines l join v_documents d using (document_id)
    union all select a.document_id, d.current_version, 'attachment', a.attachment_key, cast(json_object('file_name', string_split(a.file_path, '/')[-1], 'file_hash', a.file_hash,
      'file_size', cast(length(a.file_path) as bigint)) as varchar) from v_attachments a join v_documents d using (document_id)""")
def _(t):
    documents = t.documents.withColumns({"currency": F.lit("CNY"), "is_manual_override": F.col("document_id") % 5 == 0})
    attachments = t.attachments.withColumn("file_size_bytes", F.length("file_path").cast("bigint"))
    return sinks.snapshot_rows(documents, t.lines, attachments)


@query("io9_city_usage", ["v_points"], f"""
    with {CITY} select c.code, c.name, c.tier, c.lim as hotel_limit, count(p.point_id) as points from city c left join v_points p on p.city_name = c.short_name group by 1, 2, 3, 4""")
def _(t):
    cities = geo.city_table(t.spark)
    used = t.points.groupBy(F.col("city_name").alias("short_name")).agg(F.count("*").alias("points"))
    return cities.join(used, "short_name", "left").select(
        "code", "name", "tier", "hotel_limit", F.coalesce("points", F.lit(0)).alias("points")
    )


# ---------------------------------------------------------------- lifecycle


@query("lc1_idempotent_create", ["v_documents"], """
    select document_id, idempotency_key from v_documents where idempotency_key is null union all
    select min(document_id), idempotency_key from v_documents where idempotency_key is not null group by idempotency_key""")
def _(t):
    return L.idempotent_create(t.documents, ["document_id"]).select("document_id", "idempotency_key")


@query("lc2_one_task_per_version", ["v_submissions"], """
    select document_id, audit_version, task_id as requested_task, f as task_id, task_id <> f as reused from (
      select *, first_value(task_id) over (partition by document_id, audit_version order by submitted_at, task_id) as f from v_submissions)""")
def _(t):
    return L.one_task_per_version(t.submissions)


_MOVES = """m as (select *, coalesce(lag(status) over (partition by document_id order by occurred_at, event_id), 'DRAFT') as from_status from v_status_events)"""


@query("lc3_version_assignment", ["v_status_events"], f"""
    with {_MOVES} select document_id, event_id, from_status, status, cast(1 + sum(case when status = 'SUBMITTED' and from_status in ('REJECTED','NEED_SUPPLEMENT') then 1 else 0 end)
      over (partition by document_id order by occurred_at, event_id rows unbounded preceding) as int) as version from m""")
def _(t):
    return L.assign_versions(t.status_events)


@query("lc4_transition_violations", ["v_status_events"], f"""
    with {_MOVES} select document_id, event_id, from_status, status from m
    where (status = 'SUBMITTED' and from_status not in ('DRAFT','REJECTED','NEED_SUPPLEMENT')) or (status = 'CANCELLED' and from_status not in ('SUBMITTED','IN_REVIEW','PENDING_APPROVAL'))""")
def _(t):
    return L.transition_violations(t.status_events)


@query("lc4_edit_violations", ["v_documents", "v_submissions"], """
    select s.document_id, s.task_id, d.status from v_submissions s join v_documents d using (document_id) where d.status not in ('DRAFT','REJECTED')""")
def _(t):
    return L.edit_violations(t.submissions.select("document_id", "task_id"), t.documents)


@query("lc5_latest_report", ["v_reports"], """
    select document_id, report_id from (select *, row_number() over (partition by document_id order by created_at desc, report_id desc) as rn from v_reports) where rn = 1""")
def _(t):
    return L.latest_reports(t.reports).select("document_id", "report_id")


@query("lc5_latest_task", ["v_submissions"], """
    select document_id, audit_version, max(task_id) as task_id from v_submissions group by 1, 2""")
def _(t):
    return L.latest_tasks(t.submissions).select("document_id", "audit_version", "task_id")


_CANCELLED = "documents_cancelled as (select document_id from v_documents where status in ('CANCELLED', 'REJECTED'))"


def _cancelled(t):
    return L.cancel_cascade(t.documents.where("status in ('CANCELLED', 'REJECTED')"), t.instances, t.tasks)


@query("lc6_cancel_instances", ["v_documents", "v_instances"], f"""
    with {_CANCELLED} select instance_id, case when status = 'RUNNING' and document_id in (select document_id from documents_cancelled) then 'CANCELLED' else status end as status from v_instances""")
def _(t):
    return _cancelled(t)[0].select("instance_id", "status")


@query("lc6_cancel_tasks", ["v_documents", "v_instances", "v_tasks"], f"""
    with {_CANCELLED} select t.task_id, case when t.status = 'PENDING' and i.status = 'RUNNING' and i.document_id in (select document_id from documents_cancelled) then 'CANCELLED' else t.status end as status
    from v_tasks t join v_instances i using (instance_id)""")
def _(t):
    return _cancelled(t)[1].select("task_id", "status")


def _invoices_with_path(t):
    path = F.when(F.length("invoice_key") % 2 == 0, F.concat(F.lit("/in/"), "invoice_key", F.lit(".jpeg")))
    return t.invoices.withColumn("file_path", F.when(F.col("attachment_id") % 3 == 0, F.lit("/in/x.pdf")).otherwise(path))


@query("lc7_attachment_links", ["v_invoices", "v_attachments"], """
    with a as (select document_id, file_hash, max(attachment_key) as attachment_key from v_attachments group by 1, 2),
    i as (select *, case when attachment_id % 3 = 0 then '.pdf' when length(invoice_key) % 2 = 0 then '.jpeg' else '.png' end as ext from v_invoices)
    select i.document_id, i.invoice_key, a.attachment_key, a.attachment_key is null as is_derived,
      case when a.attachment_key is null then '发票_' || coalesce(i.invoice_number, 'None') || ext end as derived_name,
      case when a.attachment_key is null then upper(substr(ext, 2)) end as derived_type
    from i left join a on a.document_id = i.document_id and a.file_hash = i.invoice_hash""")
def _(t):
    return L.link_attachments(_invoices_with_path(t), t.attachments)


@query("lc8_ingest_defaults", ["v_invoices"], """
    select document_id, invoice_key, coalesce(nullif(invoice_code, ''), 'NONE') as invoice_code,
      coalesce(nullif(invoice_number, ''), 'UNKNOWN_' || sha256(cast(document_id as varchar) || '|' || invoice_key)) as invoice_number,
      coalesce(nullif(invoice_type, ''), '增值税电子普通发票') as invoice_type, total_amount from v_invoices""")
def _(t):
    return L.ingest_defaults(t.invoices).select(
        "document_id", "invoice_key", "invoice_code", "invoice_number", "invoice_type", "total_amount"
    )


@query("lc9_status_log", ["v_status_events"], f"""
    with {_MOVES} select document_id, event_id, from_status, status as to_status, operator_id,
      case when status = 'SUBMITTED' and from_status in ('REJECTED','NEED_SUPPLEMENT') then 'RESUBMIT' when status = 'SUBMITTED' then 'SUBMIT' when status = 'CANCELLED' then 'CANCEL' end as comment
    from m where status <> from_status""")
def _(t):
    return L.status_log(t.status_events)


# ---------------------------------------------------------------- workflow

_ACTION = "case document_id % 4 when 0 then 'AUTO_APPROVE' when 1 then 'REJECT' when 2 then 'NEED_SUPPLEMENT' else 'MANUAL_REVIEW' end"
_PICK = """wf as (select d.document_id, d.document_type, d.applicant_id, coalesce(w.workflow_id, (select min(workflow_id) from v_workflows where is_active)) as workflow_id
      from v_documents d left join (select document_type, min(workflow_id) as workflow_id from v_workflows where is_active group by 1) w using (document_type))"""
_ASSIGN = """asg as (select f.document_id, n.node_id, n.node_order, coalesce(n.user_id, case when n.approver_type = 'MANAGER' then u.manager_id end,
        case when n.approver_type = 'ROLE' then case n.role_code when 'CFO' then 4 when 'FINANCE' then 3 end end, 2) as assignee_id
      from wf f join v_nodes n using (workflow_id) left join v_users u on u.user_id = f.applicant_id)"""
WORKFLOW_VIEWS = ["v_documents", "v_workflows", "v_nodes", "v_users", "v_instances"]


def _role_users(t):
    # Users standing for the roles.
    return t.spark.createDataFrame([("CFO", 4), ("FINANCE", 3), ("DEFAULT", 2)], "role_code string, user_id bigint")


@query("wf1_workflow_start", WORKFLOW_VIEWS, f"""
    with {_PICK}, {_ASSIGN}, t as (select f.*, {_ACTION} as action from wf f where document_id not in (select document_id from v_instances where status = 'RUNNING'))
    select t.document_id, t.workflow_id, t.action,
      case action when 'AUTO_APPROVE' then 'COMPLETED' when 'REJECT' then 'TERMINATED' when 'NEED_SUPPLEMENT' then 'SUSPENDED' else 'RUNNING' end as instance_status,
      case action when 'AUTO_APPROVE' then 'APPROVED' when 'REJECT' then 'REJECTED' when 'NEED_SUPPLEMENT' then 'NEED_SUPPLEMENT' else 'PENDING_APPROVAL' end as document_status,
      case action when 'AUTO_APPROVE' then 'AUTO_PASSED' when 'MANUAL_REVIEW' then 'PENDING' end as task_status,
      case when action in ('AUTO_APPROVE', 'MANUAL_REVIEW') then a.node_id end as node_id, case when action = 'MANUAL_REVIEW' then a.assignee_id end as assignee_id
    from t left join asg a on a.document_id = t.document_id and a.node_order = 1""")
def _(t):
    decisions = t.documents.select("document_id", "document_type", "applicant_id", F.expr(_ACTION).alias("action"))
    started = W.start_workflows(
        decisions, t.workflows, t.nodes, t.users, _role_users(t), t.instances.where("status = 'RUNNING'")
    )
    return started.drop("log_action", "workflow_error")


@query("wf2_assignees", WORKFLOW_VIEWS, f"with {_PICK}, {_ASSIGN} select document_id, node_id, assignee_id from asg")
def _(t):
    chosen = W.pick_workflow(t.documents, t.workflows)
    return W.assignees(chosen, t.nodes, t.users, _role_users(t)).select("document_id", "node_id", "assignee_id")


_REPLAY = """
    with recursive ins as materialized (select instance_id, min(operator_id) as applicant from v_actions group by 1),
    a as materialized (select v.*, applicant, row_number() over (partition by instance_id order by seq) as r from v_actions v join ins using (instance_id)),
    w as (
      select instance_id, cast(0 as bigint) as r, cast(null as bigint) as seq, cast(null as varchar) as action, cast(null as varchar) as err, 'RUNNING' as st, 'PENDING_APPROVAL' as doc,
        false as appr, 1 as ord, cast(1 + instance_id % 4 as bigint) as cur, cast([] as bigint[]) as stack, [cast(1 + instance_id % 4 as bigint)] as visited from ins
      union all
      select instance_id, r, seq, action, err,
        case when err is not null then st when action = 'REJECT' then 'TERMINATED' when action = 'REVOKE' then 'CANCELLED' when done then 'COMPLETED' else st end,
        case when err is not null then doc when action = 'REJECT' then 'REJECTED' when action = 'REVOKE' then 'CANCELLED' when done then 'APPROVED' else doc end,
        appr or (err is null and (action = 'APPROVE' or (action = 'ADD_SIGN' and kind = 'AFTER'))),
        case when moved then ord + 1 else ord end,
        case when err is not null then cur when action in ('REJECT', 'REVOKE') or done then null when moved then 1 + (instance_id + ord) % 4 when action = 'APPROVE' then stack[-1] else target end,
        case when err is not null then stack when action = 'APPROVE' then stack[:-2] when action = 'ADD_SIGN' and kind = 'BEFORE' then list_append(stack, cur) when action in ('TRANSFER', 'ADD_SIGN') then [] else stack end,
        case when err is not null then visited when moved then [1 + (instance_id + ord) % 4] when action in ('TRANSFER', 'ADD_SIGN') then list_append(visited, target) else visited end
      from (select *, err is null and action = 'APPROVE' and len(stack) = 0 and ord >= 2 as done, err is null and action = 'APPROVE' and len(stack) = 0 and ord < 2 as moved from (
        select w.instance_id, a.r, a.seq, a.action, a.target_user_id as target, a.add_sign_type as kind, w.st, w.doc, w.appr, w.ord, w.cur, w.stack, w.visited,
          case when w.cur is null then 'TASK_CLOSED' when a.operator_id <> case when a.action = 'REVOKE' then a.applicant else w.cur end then 'NOT_ALLOWED'
            when a.action in ('TRANSFER', 'ADD_SIGN') and a.target_user_id is null then 'TARGET_MISSING' when a.action in ('TRANSFER', 'ADD_SIGN') and a.target_user_id = a.operator_id then 'TARGET_IS_SELF'
            when a.action = 'TRANSFER' and list_contains(w.visited, a.target_user_id) then 'TRANSFER_LOOP'
            when a.action = 'ADD_SIGN' and coalesce(a.add_sign_type not in ('BEFORE', 'AFTER'), true) then 'ADD_SIGN_TYPE_MISSING'
            when a.action = 'REVOKE' and w.appr then 'REVOKE_AFTER_APPROVAL' end as err
        from w join a on a.instance_id = w.instance_id and a.r = w.r + 1)))
"""


def _replayed(t):
    instances = t.actions.groupBy("instance_id").agg(F.min("operator_id").alias("applicant_id")).withColumn(
        "assignees", F.expr("array(cast(1 + instance_id % 4 as bigint), cast(1 + (instance_id + 1) % 4 as bigint))")
    )
    return W.replay(t.actions, instances)


@query("wf3_workflow_replay", ["v_actions"], _REPLAY + """
    select instance_id, seq, action, err is null as accepted, err as error, st as instance_status, doc as document_status, cast(ord as int) as current_order, cur as pending_assignee from w where r > 0""")
def _(t):
    return _replayed(t)


@query("wf3_final_states", ["v_actions"], _REPLAY + """
    select instance_id, arg_max(st, r) as instance_status, arg_max(doc, r) as document_status, cast(arg_max(ord, r) as int) as current_order,
      (list(cur order by r desc))[1] as pending_assignee, count(*) filter (err is null) as accepted, count(*) filter (err is not null) as refused from w where r > 0 group by 1""")
def _(t):
    return W.final_states(_replayed(t))


@query("wf4_action_violations", ["v_actions"], """
    with part as (select instance_id, task_no, user_id, min(seq) as joined from (select instance_id, task_no, operator_id as user_id, seq from v_actions
      union all select instance_id, task_no, target_user_id, seq from v_actions where action = 'TRANSFER' and target_user_id is not null) group by 1, 2, 3),
    ap as (select instance_id, min(seq) as approved from v_actions where action = 'APPROVE' group by 1),
    x as (select a.instance_id, a.seq, a.action, case when a.action in ('TRANSFER','ADD_SIGN') and a.target_user_id is null then 'TARGET_MISSING'
      when a.action in ('TRANSFER','ADD_SIGN') and a.target_user_id = a.operator_id then 'TARGET_IS_SELF'
      when a.action = 'ADD_SIGN' and a.add_sign_type is null then 'ADD_SIGN_TYPE_MISSING' when a.action = 'TRANSFER' and p.joined < a.seq then 'TRANSFER_LOOP'
      when a.action = 'REVOKE' and ap.approved < a.seq then 'REVOKE_AFTER_APPROVAL' end as violation
      from v_actions a left join part p on p.instance_id = a.instance_id and p.task_no = a.task_no and p.user_id = a.target_user_id left join ap on ap.instance_id = a.instance_id)
    select * from x where violation is not null""")
def _(t):
    return W.action_violations(t.actions)


@query("wf5_pending_tasks", ["v_tasks", "v_instances", "v_documents", "v_nodes"], """
    select t.assignee_id, t.task_id, t.instance_id, d.document_id, d.document_no, d.document_type, d.title, d.total_amount, n.node_name, n.node_order
    from v_tasks t join v_instances i using (instance_id) join v_documents d using (document_id) join v_nodes n on n.node_id = t.node_id where t.status = 'PENDING'""")
def _(t):
    return W.pending_tasks(t.tasks, t.instances, t.documents, t.nodes).drop("created_at")


@query("wf6_instance_trace", ["v_tasks", "v_instances", "v_nodes", "v_actions"], """
    select i.instance_id, i.document_id, i.status as instance_status, r.kind, r.position, r.entry from (
      select t.instance_id, 'task' as kind, t.task_id as position, n.node_name || ' ' || t.status as entry from v_tasks t join v_nodes n on n.node_id = t.node_id
      union all select instance_id, 'log', lpad(cast(seq as varchar), 19, '0'), action || ' ' || cast(operator_id as varchar) from v_actions) r
    join v_instances i using (instance_id)""")
def _(t):
    return W.instance_trace(t.instances, t.tasks, t.nodes, t.actions)


# ---------------------------------------------------------------- reports and access


@query("da1_totals", ["v_documents"], """
    select count(*) as total_documents, cast(sum(total_amount) as decimal(38,2)) as total_amount from v_documents""")
def _(t):
    return A.totals(t.documents)


@query("da2_blocked_amount", ["v_documents", "v_reports"], """
    select cast(sum(d.total_amount) as decimal(38,2)) as blocked_amount from v_documents d join v_reports r using (document_id) where r.overall_risk_level = 'high'""")
def _(t):
    return A.blocked_amount(t.documents, t.reports)


@query("da2_blocked_amount_latest", ["v_documents", "v_reports"], """
    select cast(sum(d.total_amount) as decimal(38,2)) as blocked_amount from v_documents d join (
      select *, row_number() over (partition by document_id order by created_at desc, report_id desc) as rn from v_reports) r using (document_id)
    where rn = 1 and r.overall_risk_level = 'high'""")
def _(t):
    return A.blocked_amount(t.documents, t.reports, latest_only=True)


@query("da3_risk_distribution", ["v_reports"], """
    select count(*) filter (where overall_risk_level = 'high') as high_count, count(*) filter (where overall_risk_level = 'medium') as medium_count,
      count(*) filter (where overall_risk_level = 'low') as low_count, round(count(*) filter (where overall_risk_level = 'low') * 100.0::double / count(*), 1) as auto_pass_rate,
      round(avg(final_score), 1) as avg_score from v_reports""")
def _(t):
    return A.risk_distribution(t.reports)


@query("da4_top_rules", ["v_stored_findings"], """
    select rule_code, rule_name, risk_level, count(*) as n from v_stored_findings group by 1, 2, 3 order by n desc, 1, 2, 3 limit 5""")
def _(t):
    return A.top_rules(t.stored_findings)


@query("da5_department_stats", ["v_documents", "v_reports"], f"""
    select coalesce(nullif(department_name, ''), '{A.UNASSIGNED}') as department_name, count(*) as document_count, cast(sum(total_amount) as decimal(38,2)) as total_amount,
      round(count(*) filter (where document_id not in (select document_id from v_reports where overall_risk_level = 'high')) * 100.0::double / count(*), 1) as compliance_rate
    from v_documents group by 1""")
def _(t):
    return A.department_stats(t.documents, t.reports)


@query("da6_daily_trend", ["v_reports"], """
    with last as (select max(cast(created_at as date)) as d from v_reports), cal as (select cast(d - to_days(cast(i as int)) as date) as day from last, range(7) r(i))
    select cal.day, count(r.report_id) as review_count, count(r.report_id) filter (where r.overall_risk_level = 'high') as high_risk_count
    from cal left join v_reports r on cast(r.created_at as date) = cal.day group by 1""")
def _(t):
    return A.daily_trend(t.reports)


@query("da7_recent_activities", ["v_documents", "v_users"], """
    select d.document_id, d.document_no, d.title, coalesce(u.real_name, '经办员工') as applicant_name, coalesce(d.department_name, '通用部门') as department_name,
      d.total_amount, d.status, strftime(d.created_at, '%Y-%m-%d %H:%M') as created_at
    from (select * from v_documents order by created_at desc, document_id desc limit 6) d left join v_users u on u.user_id = d.applicant_id""")
def _(t):
    return A.recent_activities(t.documents, t.users)


_HIGH = "document_id in (select document_id from v_reports where overall_risk_level = 'high')"
for _name, _user, _roles, _dept, _where in (
    ("admin", 7, ("ADMIN",), None, "true"),
    ("cfo", 7, ("CFO", "FINANCE"), None, f"(coalesce(total_amount >= 10000, false) or {_HIGH} or applicant_id = 7)"),
    ("finance", 8, ("FINANCE",), None, "(status <> 'DRAFT' or applicant_id = 8)"),
    ("manager", 9, ("MANAGER",), "BUILDING", "((coalesce(department_name = 'BUILDING', false) and status <> 'DRAFT') or applicant_id = 9)"),
    ("employee", 10, ("EMPLOYEE",), None, "applicant_id = 10"),
):
    query(f"da8_listing_{_name}", ["v_documents", "v_reports"], f"select document_id, status from v_documents where {_where}")(
        lambda t, u=_user, r=_roles, d=_dept: A.list_documents(
            t.documents, t.reports, user_id=u, roles=r, department=d
        ).select("document_id", "status")
    )


@query("da8_listing_page", ["v_documents"], """
    select document_id, status from v_documents where (status <> 'DRAFT' or applicant_id = 8) and document_type = 'CORP_PAYMENT'
    order by created_at desc, document_id desc limit 20 offset 20""")
def _(t):
    listed = A.list_documents(t.documents, t.reports, user_id=8, roles=("FINANCE",), document_type="CORP_PAYMENT")
    return A.list_page(listed, 2, 20).select("document_id", "status")


@query("da8_listing_total", ["v_documents"], """
    select count(*) as n from v_documents where (status <> 'DRAFT' or applicant_id = 8) and document_type = 'CORP_PAYMENT'""")
def _(t):
    return A.listing_total(A.list_documents(t.documents, t.reports, user_id=8, roles=("FINANCE",), document_type="CORP_PAYMENT"))


@query("da8_listing_after", ["v_documents"], """
    with l as (select * from v_documents where (status <> 'DRAFT' or applicant_id = 8) and document_type = 'CORP_PAYMENT'),
    m as (select created_at as stamp, document_id as id from l order by created_at desc, document_id desc limit 1 offset 39)
    select document_id, status from l, m where created_at < stamp or (created_at = stamp and document_id < id) order by created_at desc, document_id desc limit 20""")
def _(t):
    listed = A.list_documents(t.documents, t.reports, user_id=8, roles=("FINANCE",), document_type="CORP_PAYMENT")
    last = A.list_page(listed, 40, 1).first()  # the last row of the page before
    return A.list_after(listed, last and last["created_at"], last and last["document_id"], 20).select("document_id", "status")


_ASKED = "rq as (select distinct l_suppkey as user_id, l_orderkey as document_id from lineitem)"


@query("da9_access_check", ["v_documents", "v_reports", "v_users", "v_user_roles"], f"""
    with {_ASKED}, lr as (select document_id, arg_max(overall_risk_level, (created_at, report_id)) as lvl from v_reports group by 1),
    ro as (select user_id, bool_or(role_code = 'ADMIN') as adm, bool_or(role_code = 'CFO') as cfo, bool_or(role_code = 'FINANCE') as fin, bool_or(role_code = 'MANAGER') as mgr from v_user_roles group by 1)
    select rq.user_id, rq.document_id, coalesce(adm, false) or d.applicant_id = rq.user_id or (coalesce(cfo, false) and (coalesce(d.total_amount >= 10000, false) or coalesce(lvl = 'high', false)))
      or (coalesce(fin, false) and d.status <> 'DRAFT') or (coalesce(mgr, false) and coalesce(d.department_name = u.department_name, false) and d.status <> 'DRAFT') as allowed
    from rq join v_documents d using (document_id) left join lr using (document_id) left join ro on ro.user_id = rq.user_id left join v_users u on u.user_id = rq.user_id""")
def _(t):
    requests = t.source("lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("document_id")
    ).distinct()
    return A.access_checks(requests, t.documents, t.reports, t.users, t.user_roles)


@query("da10_citations", ["v_questions", "v_stored_findings"], """
    with q as (select *, regexp_matches(lower(message), '超标|发票|金额|公司|连号|行程') as generic from v_questions),
    m as (select q.message_id, q.document_id, f.finding_id, f.rule_code, f.title from q join v_stored_findings f using (document_id)
      where generic or contains(lower(q.message), lower(f.rule_name)) or contains(lower(q.message), lower(f.title))),
    k as (select *, row_number() over (partition by document_id order by finding_id) as rn from v_stored_findings)
    select * from m union all select q.message_id, q.document_id, k.finding_id, k.rule_code, k.title from q join k using (document_id)
    where rn <= 2 and q.message_id not in (select message_id from m)""")
def _(t):
    return A.citations(t.questions, t.stored_findings)


@query("da11_role_summary", ["v_role_runs"], """
    select role, status, count(*) as runs, cast(sum(findings_count) as bigint) as findings, cast(sum(duration_ms) as bigint) as total_ms, max(duration_ms) as max_ms from v_role_runs group by 1, 2""")
def _(t):
    return A.role_summary(t.role_runs)


@query("da12_user_roles", ["v_users", "v_user_roles"], """
    select u.user_id, bool_or(role_code = 'ADMIN') as is_admin, bool_or(role_code = 'CFO') as is_cfo, bool_or(role_code = 'FINANCE') as is_finance,
      bool_or(role_code = 'MANAGER') as is_manager, count(distinct role_code) as role_count from v_users u left join v_user_roles r using (user_id) group by 1""")
def _(t):
    return A.user_roles(t.users, t.user_roles).drop("department_name")
