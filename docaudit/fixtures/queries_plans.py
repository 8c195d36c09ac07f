"""Queries for plan, capabilities, reflection, score, decision and the full audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.fixtures import queries_rules as R
from docaudit.fixtures.oracle_parts import CITY, city_map
from docaudit.fixtures.registry import brief, query
from docaudit.functions.findings import normalize_findings
from docaudit.operators import amount, policy, supplier, travel
from docaudit.plans import audit, capabilities as cap, decide, planner as PL, reflect, score

# ---------------------------------------------------------------- plan and capabilities

FACT_VIEWS = ["v_documents", "v_lines", "v_invoices", "v_segments", "v_doc_points"]


def _plan_facts(t):
    points = t.doc_points.groupBy(F.col("scope_id").alias("document_id")).agg(F.count("*").alias("point_count"))
    suppliers = supplier.document_suppliers(t.invoices).groupBy("document_id").agg(F.count("*").alias("supplier_count"))
    segments = travel.segment_facts(t.segments)
    facts = PL.plan_facts(
        t.documents.select("document_id", "document_type"), amount.line_totals(t.lines), amount.invoice_totals(t.invoices),
        segments, points, suppliers,
    ).join(segments.select("document_id", "no_route", "no_date", "no_departure", "no_arrival"), "document_id", "left")
    gaps = ("no_route", "no_date", "no_departure", "no_arrival")
    return facts.withColumns({c: F.coalesce(c, F.lit(0)) for c in gaps})


PLAN_FACTS = f"""{R.SEGMENT_FACTS.format(view='v_segments')},
    fx as (select d.document_id, d.document_type, coalesce(l.n, 0) as lines, coalesce(i.n, 0) as invs, coalesce(sf.segment_count, 0) as segs,
      coalesce(sf.exact_times, 0) as exact_times, coalesce(p.n, 0) as pts, coalesce(u.n, 0) as sups, coalesce(no_route, 0) as no_route,
      coalesce(no_date, 0) as no_date, coalesce(no_departure, 0) as no_departure, coalesce(no_arrival, 0) as no_arrival
    from v_documents d left join (select document_id, count(*) as n from v_lines group by 1) l using (document_id)
    left join (select document_id, count(*) as n from v_invoices group by 1) i using (document_id) left join sf using (document_id)
    left join (select scope_id as document_id, count(*) as n from v_doc_points group by 1) p using (document_id)
    left join (select document_id, count(distinct upper(trim(seller_tax_id))) as n from v_invoices
      where trim(coalesce(seller_tax_id,'')) <> '' and trim(coalesce(seller_name,'')) <> '' group by 1) u using (document_id)),
    corp as (select *, document_type in ('CORP_PAYMENT','ADVANCE_PAYMENT','BATCH_PAYMENT') as corporate from fx),
    caps as (select *, concat_ws(',', case when invs >= 1 then 'duplicate_invoice_hash_check' end, case when invs >= 2 then 'sequential_invoice_number_check' end,
      case when segs >= 1 then 'travel_route_consistency,travel_date_consistency,departure_time_check,in_transit_collision_check,travel_segment_consistency' end,
      case when pts >= 2 then 'spatio_temporal_trajectory_conflict' end) as anomaly_caps from corp)"""

PLAN_ROWS = """select document_id, 'amount_agent' as role, true as enabled, true as mandatory, 'MANDATORY_DETERMINISTIC_RECONCILIATION' as reason, 'five_way_reconciliation' as capabilities from caps
    union all select document_id, 'policy_agent', true, true, case when document_type = 'TRAVEL_REIMBURSEMENT' then 'TRAVEL_POLICY_RULESET' when corporate then 'CORPORATE_PROCUREMENT_RULESET' else 'GENERAL_EXPENSE_RULESET' end,
      case when document_type = 'TRAVEL_REIMBURSEMENT' then 'travel_hotel_limit,business_purpose_check' else 'business_purpose_check' end from caps
    union all select document_id, 'anomaly_agent', anomaly_caps <> '', false, case when segs >= 1 and exact_times = 0 and invs <= 1 then 'PARTIAL: TRAVEL_TIME_MISSING' when segs >= 1 then 'TRAVEL_SEGMENT_DETECTED'
      when anomaly_caps <> '' then 'INVOICE_OR_SPATIO_FACTS_DETECTED' when document_type = 'TRAVEL_REIMBURSEMENT' and lines > 0 then 'SKIPPED_INSUFFICIENT_FACTS'
      else 'NOT_APPLICABLE: NO_INVOICE_AND_INSUFFICIENT_TRAJECTORY_POINTS' end, anomaly_caps from caps
    union all select document_id, 'supplier_agent', corporate and sups > 0, corporate, case when not corporate then 'NOT_APPLICABLE: DOCUMENT_TYPE_EXEMPT' when sups > 0 then 'CORPORATE_PAYMENT_SUPPLIER_DILIGENCE'
      else 'DATA_MISSING: SUPPLIER_IDENTITY_MISSING' end, case when corporate and sups > 0 then 'uscc_checksum_validation,dishonest_debtor_check,shell_company_investigation,business_scope_matching' else '' end from caps"""


@query("pl1_audit_plan", FACT_VIEWS, f"with {PLAN_FACTS} {PLAN_ROWS}")
def _(t):
    return PL.build_plan(_plan_facts(t)).select(
        "document_id", "role", "enabled", "mandatory", "reason", F.array_join("capabilities", ",").alias("capabilities")
    )


@query("pl2_plan_summary", FACT_VIEWS, f"""
    with {PLAN_FACTS}, pr as ({PLAN_ROWS}) select document_id,
      cast(sum(case when enabled then len(string_split(capabilities, ',')) else 0 end) as int) as capability_count,
      coalesce(string_agg(case when enabled then role end, ',' order by case role when 'amount_agent' then 1 when 'policy_agent' then 2 when 'anomaly_agent' then 3 else 4 end), '') as enabled_roles,
      coalesce(string_agg(case when not enabled then role || '(' || reason || ')' end, ',' order by case role when 'amount_agent' then 1 when 'policy_agent' then 2 when 'anomaly_agent' then 3 else 4 end), '') as skipped_roles
    from pr group by document_id""")
def _(t):
    return PL.plan_summary(_plan_facts(t))


def _capability_facts(t):
    facts = _plan_facts(t)
    return facts.withColumn("capabilities", PL.plan_columns()[2]["capabilities"])


CAP_ROWS = """select document_id, 'duplicate_invoice_hash_check' as capability, 'VERIFIED' as status, true as mandatory, 0 as missing_count from caps where invs >= 1
    union all select document_id, 'sequential_invoice_number_check', 'VERIFIED', false, 0 from caps where invs >= 2
    union all select document_id, 'travel_route_consistency', case when no_route > 0 then 'BLOCKED' else 'VERIFIED' end, true, no_route from caps where segs >= 1
    union all select document_id, 'travel_date_consistency', case when no_date > 0 then 'BLOCKED' else 'VERIFIED' end, true, no_date from caps where segs >= 1
    union all select document_id, 'departure_time_check', case when no_departure > 0 then 'BLOCKED' else 'VERIFIED' end, true, no_departure from caps where segs >= 1
    union all select document_id, 'in_transit_collision_check', case when no_departure > 0 then 'BLOCKED' when no_arrival > 0 then 'PARTIAL' else 'VERIFIED' end, false,
      case when no_departure > 0 then no_departure else no_arrival end from caps where segs >= 1
    union all select document_id, 'spatio_temporal_trajectory_conflict', 'VERIFIED', false, 0 from caps where pts >= 2"""


@query("an6_capability_status", FACT_VIEWS, f"""
    with {PLAN_FACTS} select document_id, capability, status, mandatory, cast(missing_count as bigint) as missing_count from ({CAP_ROWS})""")
def _(t):
    return cap.capability_status(_capability_facts(t)).select(
        "document_id", "capability", "status", "mandatory", "missing_count"
    )


ANOMALY_REASON = """case when no_departure > 0 then 'PARTIAL: TRAVEL_TIME_MISSING' when no_route > 0 then 'ROUTE_CITY_MISSING'
      when no_date > 0 then 'TRAVEL_DATE_MISSING' when no_arrival > 0 then '能力受限：ARRIVAL_TIME_MISSING' else '执行成功' end"""


@query("an7_anomaly_role_status", FACT_VIEWS, f"""
    with {PLAN_FACTS} select document_id, case when no_departure + no_route + no_date > 0 then 'DEGRADED' else 'SUCCESS' end as status,
      {ANOMALY_REASON} as reason from caps""")
def _(t):
    return cap.anomaly_role_status(_capability_facts(t)).select("document_id", "status", "reason")


@query("an8_capability_gating", FACT_VIEWS, f"""
    with {PLAN_FACTS} select i.document_id, i.invoice_key from v_invoices i join caps using (document_id) where invs >= 2""")
def _(t):
    plan = PL.build_plan(_plan_facts(t))
    return PL.gate(t.invoices, plan, PL.SEQUENTIAL).select("document_id", "invoice_key")


# ---------------------------------------------------------------- reflection

ALLOW = f"""al as (select d.document_id, cast(coalesce(l.total, 0) as decimal(38,2)) as allowance_total,
      coalesce(l.ev, false) or coalesce(json_extract_string(d.extra_attributes, '$.allowance_policy_verified') = 'true', false) as has_evidence
    from v_documents d left join (select document_id, sum(case when {R._ALLOW} and {R.dec('amount')} > 0 then {R.dec('amount')} end) as total,
      bool_or({R._ALLOW} and coalesce(allowance_verified, false)) as ev from v_lines group by 1) l using (document_id))"""
RF = f"""{R.INVOICE_SUMS}, {ALLOW}, r02 as ({R.AM2}),
    rx as (select r.*, allowance_total, case when allowance_total > 0 and has_evidence and abs(discrepancy_amount - allowance_total) <= 0.01 then 'AUTO_RESOLVED_FULL'
      when allowance_total > 0 and has_evidence and allowance_total < discrepancy_amount then 'PARTIAL_DEDUCTED' end as action from r02 r join al using (document_id))"""


@query("sc17_allowance_evidence", ["v_documents", "v_lines"], f"with {ALLOW} select * from al")
def _(t):
    return reflect.allowance_facts(t.documents, t.lines)


def _r02(t):
    return amount.invoice_sum_mismatch(t.documents, t.invoices), reflect.allowance_facts(t.documents, t.lines)


@query("rf1_reflection", ["v_documents", "v_lines", "v_invoices"], f"""
    with {RF} select document_id, rule_code, risk_level, case when action is null then 'amount_agent' else 'reviewer_agent' end as agent_role,
      cast(case when action is null then discrepancy_amount else discrepancy_amount - allowance_total end as decimal(38,2)) as discrepancy_amount
    from rx where action is distinct from 'AUTO_RESOLVED_FULL'""")
def _(t):
    return reflect.reflect(*_r02(t)).select("document_id", "rule_code", "risk_level", "agent_role", "discrepancy_amount")


@query("rf2_reflection_log", ["v_documents", "v_lines", "v_invoices"], f"""
    with {RF} select document_id, action, rule_code as original_rule, discrepancy_amount as original_diff, allowance_total,
      cast(case when action = 'PARTIAL_DEDUCTED' then discrepancy_amount - allowance_total end as decimal(38,2)) as remaining_gap from rx where action is not null""")
def _(t):
    return reflect.reflection_log(*_r02(t))


# ---------------------------------------------------------------- role outcomes


@query("hn1_finding_validation", ["v_stored_findings"], """
    select document_id, subject_key, discrepancy_amount from (select document_id, finding_id as subject_key, length(title) as n,
      cast(case when length(title) % 2 = 0 then 7.5 else 2 end as decimal(38,2)) as discrepancy_amount, risk_level from v_stored_findings)
    where risk_level in ('high', 'low')""")
def _(t):
    raw = t.stored_findings.select(
        "document_id", "rule_code", "rule_name",
        F.when(F.col("risk_level") == "medium", F.lit("severe")).otherwise(F.col("risk_level")).alias("risk_level"),
        F.lit("policy_agent").alias("agent_role"), F.col("finding_id").alias("subject_key"),
        F.when(F.length("title") % 2 == 0, F.lit("-7.5")).otherwise(F.lit("2")).cast("decimal(38,2)").alias("discrepancy_amount"),
        "is_overridable", F.create_map().cast("map<string,string>").alias("actual_value"),
        F.create_map().cast("map<string,string>").alias("expected_value"), "title", F.col("title").alias("description"),
        F.lit("").alias("suggestion"), F.array().cast("array<string>").alias("evidence_ids"),
    )
    return normalize_findings(raw).select("document_id", "subject_key", "discrepancy_amount")


@query("hn2_role_outcome", FACT_VIEWS + ["v_purpose_verdicts"], f"""
    with {PLAN_FACTS}, {R.PURPOSE} select document_id, 'anomaly_agent' as role, case when no_departure + no_route + no_date > 0 then 'DEGRADED' else 'SUCCESS' end as status from caps
    union all select document_id, 'policy_agent', case when source = 'HEURISTIC_RULE' then 'DEGRADED' else 'SUCCESS' end from pf""")
def _(t):
    facts = _capability_facts(t)
    purpose = policy.purpose_facts(t.documents, t.lines, t.purpose_verdicts)
    flags = facts.select("document_id").withColumns({
        "is_degraded": F.lit(False), "reason": F.lit(None).cast("string"), "source": F.lit(None).cast("string"),
    })
    roles = flags.withColumn("role", F.lit("anomaly_agent")).unionByName(
        policy.policy_role_status(purpose).select("document_id", "is_degraded", "reason", "source", "role")
    )
    return score.role_outcome(roles, cap.capability_status(facts), policy.purpose_findings(purpose)).select(
        "document_id", "role", "status"
    )


@query("hn3_role_timeouts", ["v_role_runs"], """
    select document_id, 'H99_AGENT_TIMEOUT' as rule_code, role as agent_role, case when role = 'amount_agent' then 'high' else 'low' end as risk_level
    from v_role_runs where role <> 'supplier_agent' and duration_ms > case role when 'amount_agent' then 3000 when 'policy_agent' then 15000 else 10000 end""")
def _(t):
    return score.role_timeouts(t.role_runs).select("document_id", "rule_code", "agent_role", "risk_level")


# ---------------------------------------------------------------- score and decision

COUNTS = """ct as (select report_id, count(*) filter (where risk_level = 'high') as h, count(*) filter (where risk_level = 'medium') as m,
      count(*) filter (where risk_level = 'low') as l, bool_or(risk_level = 'high' and not is_overridable) as veto, bool_or(rule_code = 'R14_MISSING_INVOICE') as miss
      from {view} group by report_id)"""


@query("sco1_risk_score", ["v_stored_findings", "v_documents"], """
    with f as (select report_id as document_id, risk_level from v_stored_findings),
    c as (select d.document_id, count(*) filter (where risk_level = 'high') as h, count(*) filter (where risk_level = 'medium') as m,
      count(*) filter (where risk_level = 'low') as l from v_documents d left join f using (document_id) group by 1)
    select document_id, h as high_count, m as medium_count, l as low_count, case when h > 0 then 'high' when m > 0 then 'medium' else 'low' end as overall_risk_level,
      cast(greatest(0, 100 - 25 * h - 10 * m - 3 * l) as int) as risk_score from c""")
def _(t):
    findings = t.stored_findings.select(F.col("report_id").alias("document_id"), "risk_level")
    return score.risk_score(t.documents, findings)


@query("sco2_completeness", FACT_VIEWS + ["v_role_runs"], f"""
    with {PLAN_FACTS}, pr as ({PLAN_ROWS}), j as (select p.document_id, p.mandatory, r.status, r.role from pr p
        left join v_role_runs r on r.document_id = p.document_id and r.role = p.role
      union all select r.document_id, false, r.status, r.role from v_role_runs r where r.document_id not in (select document_id from caps))
    select document_id, case when bool_or(mandatory and (status is null or status in ('SKIPPED','TIMEOUT','FAILED'))) then 'INCOMPLETE'
      when bool_or(coalesce(status = 'DEGRADED' or (not mandatory and status in ('TIMEOUT','FAILED')), false)) then 'DEGRADED' else 'COMPLETE' end as audit_completeness
    from j group by 1""")
def _(t):
    roles = t.role_runs.withColumn("reason", F.lit(None).cast("string"))
    return score.completeness(PL.build_plan(_plan_facts(t)), roles)


@query("sco3_summary", ["v_documents"], """
    with f as (select document_id, document_id % 4 as h, document_id % 3 as m, document_id % 5 as l, case document_id % 3 when 0 then 'COMPLETE' when 1 then 'DEGRADED' else 'INCOMPLETE' end as c from v_documents)
    select document_id, concat_ws('；', '审核完整度 ' || c, '风险评分 ' || greatest(0, 100 - 25 * h - 10 * m - 3 * l) || ' 分', '高危 ' || h || ' 项，中危 ' || m || ' 项，低危 ' || l || ' 项',
      case c when 'INCOMPLETE' then '未完成的必要环节 amount_agent' when 'DEGRADED' then '降级原因 policy_agent: DEGRADED' end,
      case when document_id % 2 = 0 then '【标题】' end, case when c = 'INCOMPLETE' then '须人工复审，禁止自动放行' end) as summary from f""")
def _(t):
    rest = F.col("document_id") % 3
    facts = t.documents.select(
        "document_id", *[(F.col("document_id") % n).alias(f"{x}_count") for x, n in (("high", 4), ("medium", 3), ("low", 5))],
        F.when(rest == 0, "COMPLETE").when(rest == 1, "DEGRADED").otherwise("INCOMPLETE").alias("audit_completeness"),
        F.lit("amount_agent").alias("failed_roles"), F.lit("policy_agent: DEGRADED").alias("degraded_reasons"),
        F.when(F.col("document_id") % 2 == 0, "【标题】").otherwise("").alias("leading"),
    ).withColumns(score.risk_columns())
    return facts.select("document_id", score.summary_text().alias("summary"))


@query("sco3_leading_findings", ["v_stored_findings"], """
    select document_id, string_agg('【' || title || '】', '；' order by rule_code, subject_key) as leading from (
      select report_id as document_id, rule_code, finding_id as subject_key, title,
        row_number() over (partition by report_id order by rule_code, finding_id) as rn from v_stored_findings) where rn <= 3 group by 1""")
def _(t):
    findings = t.stored_findings.select(
        F.col("report_id").alias("document_id"), "rule_code", F.col("finding_id").alias("subject_key"), "title",
        F.lit("policy_agent").alias("agent_role"), F.lit(None).cast("decimal(38,2)").alias("discrepancy_amount"),
    )
    return score.leading_findings(findings)


ACTION = """case when not has_report then 'MANUAL_REVIEW' when coalesce(veto, false) then 'REJECT' when lvl = 'high' and coalesce(miss, false) then 'NEED_SUPPLEMENT'
      when comp <> 'COMPLETE' or lvl = 'high' then 'MANUAL_REVIEW' when lvl = 'low' and total_amount <= 500 then 'AUTO_APPROVE' else 'MANUAL_REVIEW' end"""
NODES = """case when action <> 'MANUAL_REVIEW' then '' when has_report and (lvl = 'high' or coalesce(total_amount >= 10000, false)) then 'DIRECTOR,FINANCE,CFO'
      else 'DIRECTOR,FINANCE' end"""
STATE = "case action when 'AUTO_APPROVE' then 'APPROVED' when 'REJECT' then 'REJECTED' when 'NEED_SUPPLEMENT' then 'NEED_SUPPLEMENT' else 'PENDING_APPROVAL' end"
DECISION = f"""{COUNTS.format(view='v_stored_findings')},
    dx as (select d.document_id, d.total_amount, r.report_id, r.report_id is not null as has_report, r.overall_risk_level as lvl,
      case r.report_id % 5 when 0 then 'INCOMPLETE' when 1 then 'DEGRADED' else 'COMPLETE' end as comp, ct.veto, ct.miss
      from v_documents d left join v_reports r using (document_id) left join ct using (report_id)), da as (select *, {ACTION} as action from dx)"""
DECISION_VIEWS = ["v_documents", "v_reports", "v_stored_findings"]


def _decisions(t):
    kind = F.when(F.col("report_id") % 5 == 0, F.lit("INCOMPLETE")).when(F.col("report_id") % 5 == 1, F.lit("DEGRADED"))
    reports = t.reports.withColumn("audit_completeness", kind.otherwise(F.lit("COMPLETE")))
    return decide.decide_reports(t.documents, reports, t.stored_findings)


@query("de1_decision", DECISION_VIEWS, f"with {DECISION} select document_id, report_id, action, {STATE} as target_state from da")
def _(t):
    return _decisions(t).select("document_id", "report_id", "action", "target_state")


@query("de2_required_nodes", DECISION_VIEWS, f"with {DECISION} select document_id, report_id, {NODES} as required_nodes from da")
def _(t):
    return _decisions(t).select("document_id", "report_id", F.array_join("required_nodes", ",").alias("required_nodes"))


# ---------------------------------------------------------------- full audit

AUDIT_VIEWS = ["v_documents", "v_lines", "v_invoices", "v_suppliers", "v_purpose_verdicts", "v_scope_verdicts"]


def audit_inputs(t) -> audit.AuditInputs:
    """Lines and invoices are made row by row of a driver row, so no copies of them are stored."""
    return audit.AuditInputs(
        documents=t.stored("documents"), lines=t.lines, invoices=t.invoices, suppliers=t.suppliers,
        purpose_verdicts=t.purpose_verdicts, scope_verdicts=t.scope_verdicts,
    )


def _body(text: str) -> str:
    """CTE list of a text that starts with WITH."""
    return text.strip()[5:]


_cities = city_map(
    "select dep0 as txt from r union select arr0 from r union select rdep from r union select rarr from r "
    "union select city_name from v_lines union select short_name from city"
)
_tf1_head = _body(R._TF1).split(CITY)[0]
_tf1_tail = R._TF1[R._TF1.rindex("s as (select r.*"):]
_gate = "(select document_id from sf where {0})"
_travel = "(select document_id from v_documents where document_type = 'TRAVEL_REIMBURSEMENT')"
_known = "(select document_id from v_documents where total_amount is not null)"

FULL = f"""{_tf1_head}{_cities}, {_tf1_tail.strip()},
    segs as materialized (select document_id, invoice_key as segment_id, coalesce(dep, '') as departure_city, coalesce(arr, '') as arrival_city,
      try_cast(dt as timestamp) as departure_time, try_cast(at_ as timestamp) as arrival_time, try_cast(td as date) as travel_date from s
      where dep is not null or arr is not null or regexp_matches(kind, '铁路|火车|航空|机票|客票|行程单|出租车|打车|网约车|交通')),
    pts as (select l.document_id as scope_id, cast(l.line_no as bigint) as point_no, l.line_key as point_id, cast(l.start_date as timestamp) as event_time,
      c.full_name as city_name, c.lat as latitude, c.lng as longitude from v_lines l join v_documents d using (document_id) join cmap c on c.txt = l.city_name
      where d.document_type = 'TRAVEL_REIMBURSEMENT'),
    {R.SEGMENT_FACTS.format(view='segs')}, sn as (select g.*, coalesce(a.short_name, g.departure_city) as dep, coalesce(b.short_name, g.arrival_city) as arr
      from segs g left join cmap a on a.txt = g.departure_city left join cmap b on b.txt = g.arrival_city),
    {R.CLAIMS}, {R.LINE_SUMS}, {R.INVOICE_SUMS}, {R.KEYED}, {R.HIST}, {R.sequential_sql('v_invoices')}, {R.LODGING}, {R.PURPOSE}, {R.SUPPLIER_FACTS}, {ALLOW},
    {R.ST1.format(view='pts')},
    raw as ({R.AM1} union all {R.AM2} union all {R.AM3} and document_id in {_known} union all {R.AM4} and document_id in {_known}
      union all {R.PO3} union all {R.PO1} and document_id in {_travel} union all {R.PO2} and document_id in {_travel}
      union all {R.AN1} union all {R.AN2} union all {R.AN5}
      union all {R.ST2} and document_id in {_gate.format('no_route = 0')} union all {R.ST3} and l.document_id in {_gate.format('no_date = 0')}
      union all {R.ST4.format(view='segs')} and document_id in {_gate.format('no_departure = 0 and no_arrival = 0')}
      union all select s.document_id, 'R09_SPATIO_TEMPORAL_COLLISION', 'high', s.segment_id || '|' || p.point_id, null, true
        {R.ST5.format(view='segs', points='pts')} and s.document_id in {_gate.format('no_departure = 0 and no_arrival = 0')}
      union all select scope_id, 'R09_SPATIO_TEMPORAL_COLLISION', 'high', p_id || '|' || point_id, null, true {R.ST1_HITS}
      union all {R.SU3} union all {R.SU5} union all {R.SU6} union all {R.SU7}),
    act as (select raw.*, allowance_total, case when rule_code = 'R02_INVOICE_SUM_MISMATCH' and allowance_total > 0 and has_evidence then
      case when abs(discrepancy_amount - allowance_total) <= 0.01 then 'FULL' when allowance_total < discrepancy_amount then 'PART' end end as fix
      from raw join al using (document_id)),
    found as materialized (select document_id, rule_code, risk_level, subject_key, is_overridable,
      cast(case when fix = 'PART' then discrepancy_amount - allowance_total else discrepancy_amount end as decimal(38,2)) as discrepancy_amount
      from act where fix is distinct from 'FULL')"""


@query("de3_findings", AUDIT_VIEWS, f"with {FULL} select * from found")
def _(t):
    return brief(audit.audit(audit_inputs(t), with_summary=False).findings)


@query("de3_full_audit", AUDIT_VIEWS, f"""
    with {FULL}, {COUNTS.format(view='(select document_id as report_id, * from found)')}, ss as ({R.SUPPLIER_STATUS}),
    pc as (select scope_id as document_id, count(*) as n from pts group by 1),
    b as (select d.document_id, d.document_type, d.total_amount, coalesce(h, 0) as h, coalesce(m, 0) as m, coalesce(l, 0) as l, veto, miss,
      d.document_type in ('CORP_PAYMENT','ADVANCE_PAYMENT','BATCH_PAYMENT') as corporate, ss.status as sup_status, pf.source as psource,
      coalesce(ls.lines_valid, true) as lv, coalesce(ivs.invoices_valid, true) as iv, coalesce(ivs.invoice_count, 0) as invs, coalesce(ls.line_count, 0) as lns,
      coalesce(sf.segment_count, 0) as segs, coalesce(no_route, 0) as no_route, coalesce(no_date, 0) as no_date, coalesce(no_departure, 0) as no_departure,
      coalesce(no_arrival, 0) as no_arrival, coalesce(pc.n, 0) as pn
      from v_documents d left join ct on ct.report_id = d.document_id left join ss on ss.document_id = d.document_id left join pf on pf.document_id = d.document_id
      left join ls on ls.document_id = d.document_id left join ivs on ivs.document_id = d.document_id left join sf on sf.document_id = d.document_id
      left join pc on pc.document_id = d.document_id),
    st as (select *, case when h > 0 then 'high' when m > 0 then 'medium' else 'low' end as lvl, true as has_report,
      case when total_amount is null then 'FAILED' when not lv or not iv then 'DEGRADED' else 'SUCCESS' end as amount_status,
      case when psource = 'HEURISTIC_RULE' then 'DEGRADED' else 'SUCCESS' end as policy_status,
      case when invs >= 1 or segs >= 1 or pn >= 2 then case when no_departure + no_route + no_date > 0 then 'DEGRADED' else 'SUCCESS' end else 'SKIPPED' end as anomaly_status,
      coalesce(sup_status, 'SKIPPED') as supplier_status,
      case when invs >= 1 or segs >= 1 or pn >= 2 then {ANOMALY_REASON} when document_type = 'TRAVEL_REIMBURSEMENT' and lns > 0 then 'SKIPPED_INSUFFICIENT_FACTS'
        else 'NOT_APPLICABLE: NO_INVOICE_AND_INSUFFICIENT_TRAJECTORY_POINTS' end as anomaly_reason from b),
    cp as (select *, case when amount_status = 'FAILED' or (corporate and supplier_status in ('SKIPPED','FAILED')) then 'INCOMPLETE'
      when amount_status = 'DEGRADED' or policy_status = 'DEGRADED' or anomaly_status = 'DEGRADED' or supplier_status = 'DEGRADED'
        or (anomaly_status = 'SKIPPED' and not contains(anomaly_reason, 'NOT_APPLICABLE')) then 'DEGRADED' else 'COMPLETE' end as comp from st),
    da as (select *, {ACTION} as action from cp)
    select document_id, lvl as overall_risk_level, cast(greatest(0, 100 - 25 * h - 10 * m - 3 * l) as int) as risk_score, h as high_count, m as medium_count,
      l as low_count, comp as audit_completeness, amount_status, policy_status, anomaly_status, supplier_status, anomaly_reason, action,
      concat_ws(',', case when amount_status = 'FAILED' then 'amount_agent' end, case when corporate and supplier_status in ('SKIPPED','FAILED') then 'supplier_agent' end) as failed_roles,
      concat_ws(',', case when amount_status = 'DEGRADED' then 'amount_agent' end, case when policy_status = 'DEGRADED' then 'policy_agent' end,
        case when anomaly_status = 'DEGRADED' or (anomaly_status = 'SKIPPED' and not contains(anomaly_reason, 'NOT_APPLICABLE')) then 'anomaly_agent' end,
        case when supplier_status = 'DEGRADED' then 'supplier_agent' end) as degraded_roles,
      {STATE} as target_state, {NODES} as required_nodes from da""")
def _(t):
    report = audit.audit(audit_inputs(t), with_summary=False).report
    return report.select(
        "document_id", "overall_risk_level", "risk_score", "high_count", "medium_count", "low_count", "audit_completeness",
        "amount_status", "policy_status", "anomaly_status", "supplier_status", "anomaly_reason", "failed_roles", "degraded_roles",
        "action", "target_state", F.array_join("required_nodes", ",").alias("required_nodes"),
    )
