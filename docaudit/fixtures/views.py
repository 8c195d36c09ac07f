"""Audit-domain views over the driver tables, as SQL text valid in Spark and in DuckDB.

A view derives every row from a driver row, so its size grows with the input. The few functions
whose names differ are taken from a dialect object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docaudit.functions.geo import CITIES
from docaudit.functions.scalars import USCC_ALPHABET, USCC_WEIGHTS
from docaudit.session import materialize, tune

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


class SparkDialect:
    @staticmethod
    def t(name: str) -> str:
        return f"docaudit_src_{name}"

    @staticmethod
    def add_minutes(ts: str, minutes: str) -> str:
        return f"timestampadd(MINUTE, cast(floor({minutes}) as int), cast({ts} as timestamp))"

    @staticmethod
    def add_days(day: str, days: str) -> str:
        return f"date_add(date '{day}', cast({days} as int))"

    @staticmethod
    def ts(expr: str) -> str:
        return f"cast({expr} as timestamp)"

    @staticmethod
    def micros(expr: str) -> str:
        return f"unix_micros(cast({expr} as timestamp))"

    @staticmethod
    def named(name: str, expr: str) -> str:
        """An expression that many entries of ``unrolled`` mention: computed once per row, under its name."""
        return name

    @classmethod
    def unrolled(cls, name: str, rows: list[dict[str, str]], shared: dict[str, str] | None = None) -> str:
        """Every row of a table once per entry, with the entry's columns; ``shared`` has what stands behind names (see ``named``).

        The entries are built in a projection, whose code Spark generates and cuts into methods the JVM compiles; the
        generator only deals them out. No row lacks entries; ``outer`` keeps Spark from asking for that in a filter, which
        would build them all once more.
        """
        source = cls.t(name)
        for held, expr in (shared or {}).items():
            source = f"(select *, {expr} as {held} from {source})"
        structs = ", ".join("named_struct(" + ", ".join(f"'{k}', {c}" for k, c in row.items()) + ")" for row in rows)
        return f"(select *, array({structs}) as _entries from {source}) lateral view outer inline(_entries) entries as {', '.join(rows[0])}"


class DuckDialect:
    @staticmethod
    def t(name: str) -> str:
        return name

    @staticmethod
    def add_minutes(ts: str, minutes: str) -> str:
        return f"({ts} + to_minutes(cast(floor({minutes}) as bigint)))"

    @staticmethod
    def add_days(day: str, days: str) -> str:
        return f"(date '{day}' + cast({days} as int))"

    @staticmethod
    def ts(expr: str) -> str:
        return f"cast({expr} as timestamp)"

    @staticmethod
    def micros(expr: str) -> str:
        return f"epoch_us({expr})"

    @staticmethod
    def named(name: str, expr: str) -> str:
        return expr

    @classmethod
    def unrolled(cls, name: str, rows: list[dict[str, str]], shared: dict[str, str] | None = None) -> str:
        structs = ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in row.items()) + "}" for row in rows)
        return f"(select *, unnest([{structs}], recursive := true) from {cls.t(name)})"


def _pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def _city(expr: str) -> str:
    """Short name of the city number expr % 32."""
    arms = " ".join(f"when {i} then '{c[1]}'" for i, c in enumerate(CITIES))
    return f"case ({expr}) % {len(CITIES)} {arms} end"


def _city_number(expr: str, field: int) -> str:
    arms = " ".join(f"when {i} then {c[field]}" for i, c in enumerate(CITIES))
    return f"cast(case ({expr}) % {len(CITIES)} {arms} end as double)"


def _uscc(key: str) -> str:
    """A company code for a supplier key; every tenth one has a wrong check character."""
    prefix = "91110000MA"
    fixed = sum(USCC_ALPHABET.index(ch) * w for ch, w in zip(prefix, USCC_WEIGHTS))
    padded = _pad(f"{key} % 10000000", 7)
    digits = " + ".join(
        f"cast(floor(({key}) % 10000000 / {10 ** (6 - i)}) as int) % 10 * {USCC_WEIGHTS[10 + i]}" for i in range(7)
    )
    check = f"((31 - ({fixed} + {digits}) % 31) % 31 + case when {key} % 10 = 0 then 1 else 0 end) % 31"
    return f"concat('{prefix}', {padded}, substr('{USCC_ALPHABET}', cast({check} as int) + 1, 1))"


_LINE_KEY = "concat(" + ", '-', ".join(
    [_pad("l_linenumber", 2), _pad("l_partkey", 10), _pad("l_suppkey", 10), _pad("cast(l_quantity as int)", 2)]
) + ")"
_AMOUNT = "cast(cast(l_extendedprice as decimal(14,2)) * cast(0.01 as decimal(3,2)) as decimal(14,2))"
_NUMBER = (
    f"case when l_linenumber = 7 then {_pad('l_partkey', 8)} "
    f"when l_linenumber = 6 and l_partkey % 17 = 0 then null "
    f"else concat('No.', {_pad('l_orderkey', 8)}, cast(l_linenumber as string)) end"
)
_CODE = f"case when l_suppkey % 13 = 0 then 'NONE' when l_suppkey % 37 = 1 then '  ' else {_pad('l_suppkey', 10)} end"
_INVOICE_TYPE = (
    "case l_partkey % 7 when 0 then '铁路电子客票' when 1 then '航空行程单' when 2 then '出租车发票' "
    "when 3 then '增值税专用发票' when 4 then '增值税普通发票' when 5 then '电子发票' else null end"
)


def _pairs(*pairs: tuple[str, str]) -> str:
    """A JSON object text from (key, SQL text) pairs; the value '~' leaves the key out."""
    parts = [
        f"""case when ({expr}) = '~' then '' else concat('"{key}":"', {expr}, '",') end""" for key, expr in pairs
    ]
    return "concat(chr(123), " + ", ".join(parts) + """, '"v":"1"', chr(125))"""


def v_lines(d):
    return f"""
    select l_orderkey as document_id, l_linenumber as line_no, {_LINE_KEY} as line_key,
      case l_partkey % 7 when 0 then '住宿费' when 1 then '酒店住宿' when 2 then '交通费' when 3 then '出差补贴'
        when 4 then '餐饮费' when 5 then '办公用品' else '技术服务费' end as expense_type,
      case l_suppkey % 10 when 0 then '北京-上海 G13次' when 1 then '住宿 2 间夜' when 2 then 'KTV 招待'
        when 3 then '高尔夫会费' when 4 then null when 5 then '杭州至宁波 D3233' when 6 then '外勤餐补'
        when 7 then '客户拜访' when 8 then '设备采购' else '会议服务' end as item_desc,
      case when l_partkey % 53 = 0 then case when l_suppkey % 2 = 0 then 'abc' else null end
        when l_partkey % 59 = 0 then concat('  ', cast({_AMOUNT} as string), ' ')
        else cast({_AMOUNT} as string) end as amount,
      case l_suppkey % 11 when 0 then '北京' when 1 then '上海市' when 2 then '广州天河区' when 3 then '310000'
        when 4 then '火星' when 5 then null when 6 then '' when 7 then '石家庄站' when 8 then ' 深圳 '
        when 9 then '三亚湾' else '月球基地' end as city_name,
      cast(l_shipdate as date) as start_date, cast(l_shipdate as date) as end_date,
      case l_partkey % 5 when 0 then cast(cast(l_quantity as int) % 4 as string) when 1 then 'x' else null end
        as stay_nights,
      case l_partkey % 3 when 0 then '2' else null end as nights,
      cast(cast(l_quantity as int) % 6 as string) as quantity,
      case l_suppkey % 4 when 0 then '晚' when 1 then '间' when 2 then '间/夜' else null end as unit,
      case when l_partkey % 14 = 3 then true else false end as allowance_verified
    from {d.t('lineitem')}"""


def v_documents(d):
    return f"""
    select o.o_orderkey as document_id, concat('DOC-', {_pad('o.o_orderkey', 10)}) as document_no,
      case when o.o_orderkey % 10 = 0 then null
        else concat('K', cast(o.o_custkey as string), '-', cast(o.o_orderkey % 3 as string)) end as idempotency_key,
      case o.o_orderkey % 5 when 0 then 'TRAVEL_REIMBURSEMENT' when 1 then 'EXPENSE_REIMBURSEMENT'
        when 2 then 'CORP_PAYMENT' when 3 then 'ADVANCE_PAYMENT' else 'BATCH_PAYMENT' end as document_type,
      case when o.o_orderkey % 23 = 0 then '' else concat('事由 ', cast(o.o_custkey as string)) end as title,
      o.o_custkey as applicant_id,
      case when o.o_custkey % 17 = 0 then null else c.c_mktsegment end as department_name,
      case when o.o_orderkey % 97 = 0 then null
        when s.line_sum is null then cast(cast(o.o_totalprice as decimal(14,2)) * cast(0.01 as decimal(3,2)) as decimal(14,2))
        when o.o_orderkey % 7 = 0 then cast(s.line_sum + 50 as decimal(14,2))
        when o.o_orderkey % 11 = 0 then cast(s.line_sum + 0.01 as decimal(14,2))
        else cast(s.line_sum as decimal(14,2)) end as total_amount,
      case when o.o_orderstatus = 'F' then case o.o_orderkey % 4 when 0 then 'REJECTED' else 'APPROVED' end
        when o.o_orderstatus = 'P' then case o.o_orderkey % 3 when 0 then 'IN_REVIEW' else 'PENDING_APPROVAL' end
        else case o.o_orderkey % 5 when 0 then 'DRAFT' when 1 then 'NEED_SUPPLEMENT' when 2 then 'CANCELLED'
          else 'SUBMITTED' end end as status,
      cast(1 + o.o_orderkey % 3 as int) as current_version,
      case when o.o_orderkey % 9 = 0 then '{{"allowance_policy_verified": true}}' else null end as extra_attributes,
      {d.ts('o.o_orderdate')} as created_at
    from {d.t('orders')} o
    left join {d.t('customer')} c on o.o_custkey = c.c_custkey
    left join (select l_orderkey, cast(sum({_AMOUNT}) as decimal(14,2)) as line_sum
               from {d.t('lineitem')} group by l_orderkey) s on o.o_orderkey = s.l_orderkey"""


def v_invoices(d):
    dep = "case when l_suppkey % 4 = 3 then '~' when l_suppkey % 4 = 2 then '北京南站' else " + _city("l_partkey") + " end"
    arr = "case when l_suppkey % 5 = 4 then '~' else " + _city("l_partkey + l_suppkey") + " end"
    day = "substr(cast(cast(l_shipdate as date) as string), 1, 10)"
    dep_time = (
        f"case when l_quantity < 8 then '~' when l_quantity < 10 then 'soon' else concat({day}, 'T', "
        f"{_pad('cast(l_quantity as int) % 24', 2)}, ':30:00') end"
    )
    arr_time = f"case when l_quantity < 12 then '~' else concat({day}, ' 23:59:00') end"
    travel_day = f"case when l_suppkey % 7 = 6 then '~' else {day} end"
    payload = _pairs(
        ("departure_city", dep), ("arrival_city", arr), ("departure_time", dep_time), ("arrival_time", arr_time),
        ("travel_date", travel_day),
    )
    return f"""
    select l_orderkey as document_id, {_LINE_KEY} as invoice_key, l_suppkey as attachment_id,
      {_CODE} as invoice_code,
      case when l_partkey % 6 = 0 then ' ' || lower({_NUMBER}) || ' ' else {_NUMBER} end as invoice_number,
      {_INVOICE_TYPE} as invoice_type,
      case when l_partkey % 61 = 0 then null else {_AMOUNT} end as total_amount,
      case when l_partkey % 23 = 0 then null
        else cast({_AMOUNT} * cast(0.94 as decimal(3,2)) as decimal(14,2)) end as untaxed_amount,
      cast({_AMOUNT} - cast({_AMOUNT} * cast(0.94 as decimal(3,2)) as decimal(14,2))
        + case when l_partkey % 19 = 0 then cast(0.02 as decimal(3,2)) when l_partkey % 19 = 1 then cast(0.01 as decimal(3,2))
          else cast(0 as decimal(3,2)) end as decimal(14,2)) as tax_amount,
      case when l_partkey % 29 = 0 then ' ' else concat('Supplier#', {_pad('l_suppkey', 9)}) end as seller_name,
      case when l_partkey % 41 = 0 then null when l_partkey % 43 = 0 then lower({_uscc('l_suppkey')})
        else {_uscc('l_suppkey')} end as seller_tax_id,
      substr(cast(cast(l_shipdate as date) as string), 1, 10) as issue_date,
      case when l_linenumber = 7 then concat('H', {_pad('l_suppkey', 6)}, {_pad('l_partkey', 8)}) else null end as invoice_hash,
      l_partkey % 31 = 0 as is_manual_modified,
      case when l_partkey % 62 = 0 then {_AMOUNT} else null end as original_extracted_amount,
      case when l_partkey % 7 < 3 then {payload} else null end as raw_payload
    from {d.t('lineitem')}"""


def v_statements(d):
    return f"""
    select l_suppkey as document_id, {_pad('l_orderkey', 12)} as invoice_key, 'C' as invoice_code,
      concat('No.', cast(l_orderkey as string)) as invoice_number,
      concat('S', cast(l_suppkey as string)) as seller_tax_id, cast(null as string) as seller_name,
      cast('2024-01-01' as string) as issue_date,
      case when l_orderkey % 89 = 0 then null else cast(sum({_AMOUNT}) as decimal(14,2)) end as total_amount
    from {d.t('lineitem')} group by l_suppkey, l_orderkey"""


def v_segments(d):
    start = d.add_minutes("l_shipdate", "l_quantity * 20")
    return f"""
    select l_orderkey as document_id, {_LINE_KEY} as segment_id,
      case when l_partkey % 33 = 32 then '火星站' else {_city('l_partkey')} end as departure_city,
      case when l_partkey % 47 = 0 then '' else {_city('l_suppkey')} end as arrival_city,
      case when l_partkey % 19 = 0 then null else {start} end as departure_time,
      case when l_partkey % 13 = 0 then null else {d.add_minutes('l_shipdate', 'l_quantity * 20 + 30 + l_discount * 90000')} end
        as arrival_time,
      case when l_partkey % 17 = 0 then null else cast(l_shipdate as date) end as travel_date,
      concat('G', cast(l_partkey % 1000 as string)) as transport_no
    from {d.t('lineitem')}"""


def v_trips(d):
    """Segments gathered by carrier: many overlap, short ones inside long ones."""
    start = d.add_minutes("l_shipdate", "l_quantity * 20")
    return f"""
    select l_suppkey as document_id, concat({_pad('l_orderkey', 10)}, '-', {_LINE_KEY}) as segment_id,
      case when l_partkey % 19 = 0 then null else {start} end as departure_time,
      case when l_partkey % 13 = 0 then null else {d.add_minutes('l_shipdate', 'l_quantity * 20 + 30 + l_discount * 90000')} end
        as arrival_time,
      concat('G', cast(l_partkey % 1000 as string)) as transport_no
    from {d.t('lineitem')}"""


def v_doc_points(d):
    return f"""
    select l_orderkey as scope_id, cast(l_linenumber as bigint) as point_no, {_LINE_KEY} as point_id,
      {d.add_minutes('l_shipdate', 'l_quantity * 25')} as event_time, {_city('l_partkey + l_linenumber')} as city_name,
      {_city_number('l_partkey + l_linenumber', 3)} as latitude, {_city_number('l_partkey + l_linenumber', 4)} as longitude
    from {d.t('lineitem')}"""


def v_points(d):
    return f"""
    select user_id as scope_id, event_id as point_no, cast(event_id as string) as point_id,
      case when event_id % 50 = 1 then {d.ts("concat(substr(cast(ts as string), 1, 10), ' 00:00:00')")}
        else {d.ts('ts')} end as event_time,
      {_city('event_id')} as city_name, {_city_number('event_id', 3)} as latitude,
      {_city_number('event_id', 4)} as longitude
    from {d.t('events')}"""


def v_suppliers(d):
    return f"""
    select case when s_suppkey % 8 = 7 then concat('X', cast(s_suppkey as string)) else {_uscc('s_suppkey')} end as uscc,
      s_name as supplier_name,
      case s_suppkey % 6 when 0 then '存续' when 1 then '已注销' when 2 then '吊销' when 3 then '经营异常'
        when 4 then null else '在业' end as operating_status,
      s_acctbal < 0 as is_dishonest, s_suppkey % 9 = 0 as is_shell_company,
      case s_suppkey % 5 when 0 then null when 1 then '' when 2 then ' ' else '技术服务' end as business_scope,
      case when s_suppkey % 10 = 0 then '{{"business_scope": "设备销售"}}' else null end as risk_tags
    from {d.t('supplier')}"""


def v_purpose_verdicts(d):
    return f"""
    select o_orderkey as document_id,
      case o_orderkey % 6 when 0 then 'true' when 1 then 'FALSE' when 2 then 'maybe' when 3 then null
        else 'yes' end as verdict,
      'model text' as analysis,
      case when o_orderkey % 12 = 6 then 'HEURISTIC_RULE' else 'LLM_INFERENCE' end as source
    from {d.t('orders')}"""


def v_scope_verdicts(d):
    return f"""
    select distinct l_orderkey as document_id, {_uscc('l_suppkey')} as uscc,
      case (l_orderkey + l_suppkey) % 5 when 0 then 'false' when 1 then null else '1' end as verdict,
      'model text' as analysis, 'LLM_INFERENCE' as source
    from {d.t('lineitem')}"""


def v_users(d):
    return f"""
    select c_custkey as user_id, c_name as real_name,
      case when c_custkey % 19 = 0 then null else c_mktsegment end as department_name,
      case when c_custkey % 4 = 0 then null else cast(c_nationkey as bigint) end as manager_id
    from {d.t('customer')}"""


def v_user_roles(d):
    return f"""
    select c_custkey as user_id, case c_custkey % 6 when 0 then 'ADMIN' when 1 then 'CFO' when 2 then 'FINANCE'
      when 3 then 'MANAGER' else 'EMPLOYEE' end as role_code
    from {d.t('customer')}
    union
    select c_custkey as user_id, case when c_custkey % 4 = 0 then 'MANAGER' else 'EMPLOYEE' end as role_code
    from {d.t('customer')}"""


def v_reports(d):
    return f"""
    select o_orderkey as report_id, concat('T', cast(o_orderkey as string)) as task_id,
      o_orderkey - o_orderkey % 3 as document_id,
      case substr(o_orderpriority, 1, 1) when '1' then 'high' when '2' then 'medium' else 'low' end as overall_risk_level,
      cast(100 - o_orderkey % 60 as int) as final_score, {d.ts('o_orderdate')} as created_at
    from {d.t('orders')}"""


def v_stored_findings(d):
    return f"""
    select l_orderkey as report_id, l_orderkey - l_orderkey % 3 as document_id, {_LINE_KEY} as finding_id,
      case l_partkey % 6 when 0 then 'R05_POLICY_EXCEEDED' when 1 then 'R08_INVOICE_DUPLICATE'
        when 2 then 'R10_SEQUENTIAL_INVOICES' when 3 then 'R14_POLICY_NOT_FOUND' when 4 then 'R07_MANUAL_OVERRIDE_FLAG'
        else 'R14_MISSING_INVOICE' end as rule_code,
      case l_partkey % 6 when 0 then 'Lodging over limit' when 1 then 'Duplicate invoice' when 2 then 'Consecutive numbers'
        when 3 then 'No standard' when 4 then 'Manual change' else 'Missing invoice' end as rule_name,
      case l_partkey % 6 when 0 then 'medium' when 1 then 'high' when 2 then 'medium' when 3 then 'low'
        when 4 then 'medium' else 'high' end as risk_level,
      concat('Title ', cast(l_partkey % 50 as string)) as title,
      l_partkey % 6 <> 1 as is_overridable
    from {d.t('lineitem')}"""


def v_attachments(d):
    return f"""
    select l_orderkey as document_id, {_LINE_KEY} as attachment_key,
      case when l_partkey % 3 = 0 then concat('H', {_pad('l_suppkey', 6)}, {_pad('l_partkey', 8)})
        else concat('F', {_pad('l_partkey', 8)}) end as file_hash,
      concat('/files/', cast(l_partkey as string), case when l_suppkey % 3 = 0 then '.PDF' when l_suppkey % 3 = 1 then '.jpg'
        else '' end) as file_path
    from {d.t('lineitem')}"""


def v_nodes(d):
    return f"""
    select cast(n_nationkey as bigint) as node_id, cast(n_regionkey as bigint) as workflow_id, n_name as node_name,
      cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) as node_order,
      case n_nationkey % 3 when 0 then 'USER' when 1 then 'MANAGER' else 'ROLE' end as approver_type,
      case when n_nationkey % 3 = 0 and n_nationkey % 2 = 0 then cast(100 + n_nationkey as bigint) else null end as user_id,
      case when n_nationkey % 3 = 2 then case n_nationkey % 2 when 0 then 'CFO' else 'FINANCE' end else null end as role_code
    from {d.t('nation')}"""


def v_workflows(d):
    return f"""
    select cast(r_regionkey as bigint) as workflow_id,
      case r_regionkey when 0 then 'TRAVEL_REIMBURSEMENT' when 1 then 'EXPENSE_REIMBURSEMENT' when 2 then 'CORP_PAYMENT'
        when 3 then 'ADVANCE_PAYMENT' else 'OTHER' end as document_type,
      r_regionkey <> 3 as is_active
    from {d.t('region')}"""


def v_instances(d):
    return f"""
    select o_orderkey as instance_id, o_orderkey as document_id, o_orderkey % 5 as workflow_id,
      case o_orderkey % 4 when 0 then 'RUNNING' when 1 then 'COMPLETED' when 2 then 'RUNNING' else 'TERMINATED' end as status
    from {d.t('orders')}"""


def v_tasks(d):
    return f"""
    select concat({_pad('l_orderkey', 10)}, '-', {_LINE_KEY}) as task_id, l_orderkey as instance_id,
      l_suppkey % 25 as node_id, l_partkey % 50 as assignee_id,
      case l_partkey % 4 when 0 then 'APPROVED' when 1 then 'TRANSFERRED' else 'PENDING' end as status,
      {d.ts('l_shipdate')} as created_at
    from {d.t('lineitem')}"""


def v_status_events(d):
    return f"""
    select user_id as document_id, event_id, {d.ts('ts')} as occurred_at,
      case event_id % 9 when 0 then 'DRAFT' when 1 then 'SUBMITTED' when 2 then 'IN_REVIEW' when 3 then 'PENDING_APPROVAL'
        when 4 then 'APPROVED' when 5 then 'REJECTED' when 6 then 'SUBMITTED' when 7 then 'NEED_SUPPLEMENT'
        else 'CANCELLED' end as status,
      event_id % 40 as operator_id
    from {d.t('events')}"""


def v_submissions(d):
    return f"""
    select l_orderkey as document_id, cast(1 + l_linenumber % 3 as int) as audit_version,
      concat('T', {_pad('l_orderkey', 10)}, '-', {_LINE_KEY}) as task_id, {d.ts('l_shipdate')} as submitted_at
    from {d.t('lineitem')}"""


def v_actions(d):
    return f"""
    select user_id as instance_id, event_id as seq, cast(1 + event_id % 3 as int) as task_no,
      1 + event_id % 4 as operator_id,
      case event_type when 'signup' then 'APPROVE' when 'view' then 'TRANSFER' when 'click' then 'ADD_SIGN'
        when 'error' then case when event_id % 7 = 0 then 'REJECT' else 'TRANSFER' end
        else case when event_id % 5 = 0 then 'REVOKE' else 'APPROVE' end end as action,
      case when event_id % 13 = 0 then null else 1 + (event_id * 7) % 9 end as target_user_id,
      case event_id % 5 when 0 then 'BEFORE' when 1 then 'AFTER' when 2 then 'AFTER' when 3 then 'BEFORE' else null end
        as add_sign_type
    from {d.t('events')}"""


def v_audit_events(d):
    kind = (
        "case event_id % 9 when 0 then 'task_started' when 1 then 'task_progress' when 2 then 'node_status' "
        "when 3 then 'evidence_found' when 4 then 'risk_detected' when 5 then 'role_error' "
        "when 6 then 'review_reflect' when 7 then 'task_completed' else 'task_failed' end"
    )
    percent = "cast(cast(floor(value) as int) % 130 as string)"
    return f"""
    select concat('E', cast(event_id - case when event_id % 11 = 0 and event_id > 0 then 1 else 0 end as string)) as event_id,
      event_id as seq, {kind} as event, concat('K', cast(user_id as string)) as task_id, user_id as document_id,
      cast(1 + event_id % 2 as int) as audit_version, {d.ts('ts')} as occurred_at,
      case event_id % 9
        when 0 then '{{"stage":"STAGE_1_PARSED","items_count":3}}'
        when 1 then concat('{{"current_stage":"STAGE_2","percent":', {percent}, '}}')
        when 2 then concat('{{"role":"', case event_id % 4 when 0 then 'amount_agent' when 1 then 'policy_agent' when 2 then 'anomaly_agent'
          else 'nobody' end, '","status":"SUCCESS","elapsed_ms":', cast(cast(floor(value) as int) as string), '}}')
        when 6 then '{{"disambiguated_count":1}}'
        when 7 then concat('{{"report_id":', cast(event_id as string), ',"overall_risk_level":"low","risk_score":',
          cast(cast(floor(value) as int) % 120 as string), ',"high_count":0,"medium_risks_count":1,"low_risks_count":2}}')
        when 8 then case when event_id % 2 = 0 then '{{"error_code":"X","error_detail":"y"}}' else '{{"error_code":"X"}}' end
        else '{{}}' end as data
    from {d.t('events')}"""


def v_deadline_events(d):
    """Tasks that start once or twice and end in time, exactly at the deadline, late, or never."""
    rows = [
        {"event": "'task_started'", "shift": "0"},
        {"event": "case when event_id % 4 = 0 then 'task_started' else 'task_progress' end", "shift": "1"},
        {"event": "case event_id % 7 when 0 then 'role_error' when 1 then 'task_failed' else 'task_completed' end", "shift": "cast(event_id % 5 as int)"},
    ]
    return f"""
    select concat('D', cast(event_id as string), '-', cast(shift as string)) as event_id, event_id as seq, event,
      concat('D', cast(event_id as string)) as task_id, {d.add_minutes(d.ts('ts'), 'shift')} as occurred_at
    from {d.unrolled('events', rows)} where event_id % 3 = 0"""


def v_role_runs(d):
    return f"""
    select event_id as document_id, case event_id % 4 when 0 then 'amount_agent' when 1 then 'policy_agent' when 2 then 'anomaly_agent'
        else 'supplier_agent' end as role,
      case event_id % 7 when 0 then 'DEGRADED' when 1 then 'FAILED' else 'SUCCESS' end as status,
      cast(floor(value * 300) as bigint) as duration_ms, cast(event_id % 5 as int) as findings_count
    from {d.t('events')}"""


def v_questions(d):
    return f"""
    select concat({_pad('conv_id', 10)}, '-', {_pad('turn', 6)}) as message_id, conv_id * 3 as document_id,
      concat(text, case conv_id % 5 when 0 then ' 发票' when 1 then ' duplicate INVOICE' when 2 then ' title 7 '
        else '' end) as message
    from {d.t('conversations')}"""


def v_model_texts(d):
    return f"""
    select o_orderkey as text_id,
      case o_orderkey % 6
        when 0 then concat('{{"is_rational": true, "n": ', cast(o_custkey as string), '}}')
        when 1 then concat('好的：{{"is_rational": false, "n": ', cast(o_custkey as string), '}} 请查收')
        when 2 then concat('```json', chr(10), '{{"is_rational": "yes", "n": ', cast(o_custkey as string), '}}', chr(10), '```')
        when 3 then 'no json here' when 4 then '{{broken' else '[1, 2]' end as reply
    from {d.t('orders')}"""


def v_verdict_requests(d):
    return f"""
    select event_id, {d.ts('ts')} as occurred_at, user_id % 40 as request_key from {d.t('events')}"""


def _tokens(rows: list[tuple[str, str, str, str]]) -> list[dict[str, str]]:
    return [
        {"token_idx": f"cast({i} as int)", "text": f"cast({text} as string)", "ymin": f"cast({y} as int)", "xmin": f"cast({x} as int)"}
        for i, text, y, x in rows
    ]


def capital_digit(key: str, n: int) -> str:
    """The n-th digit (1-9) of the capital amount that the scanned invoice of an order prints."""
    return f"(1 + cast(floor({key} / {9 ** (n - 1)}) as int) % 9)"


def v_tokens(d):
    """One scanned invoice per order: about a dozen tokens each, one row per token."""
    shared: dict[str, str] = {}

    def named(name: str, expr: str) -> str:
        shared[name] = expr
        return d.named(name, expr)

    cents = named("_cents", "cast(round(o_totalprice, 0) as bigint) % 900000 + 10000")
    untaxed = named("_untaxed", f"cast(({cents}) * 100 as bigint)")
    rate = named("_rate", "case o_orderkey % 4 when 0 then 13 when 1 then 6 when 2 then 9 else 3 end")
    tax = named("_tax", f"({cents}) * ({rate})")
    day_text = named("_ordered", "cast(o_orderdate as string)")

    def money(c: str) -> str:
        whole = f"cast(floor(({c}) / 100) as bigint)"
        return f"concat(cast({whole} as string), '.', {_pad(f'cast(({c}) - {whole} * 100 as bigint)', 2)})"

    def grouped(c: str) -> str:
        """The same with commas between groups of three digits."""
        whole = f"cast(floor(({c}) / 100) as bigint)"
        low, mid = _pad(f"({whole}) % 1000", 3), f"cast(floor(({whole}) / 1000) as bigint)"
        text = (
            f"case when {whole} >= 1000000 then concat(cast(cast(floor(({whole}) / 1000000) as bigint) as string), ',', {_pad(f'{mid} % 1000', 3)}, ',', {low}) "
            f"else concat(cast({mid} as string), ',', {low}) end"
        )
        return f"concat({text}, '.', {_pad(f'cast(({c}) - {whole} * 100 as bigint)', 2)})"

    def numeral(n: str) -> str:
        return f"substr('零壹贰叁肆伍陆柒捌玖', cast(1 + {n} as int), 1)"

    one, two, three = (numeral(capital_digit("o_orderkey", n)) for n in (1, 2, 3))
    capital = (
        f"case o_orderkey % 4 when 0 then concat({one}, '万', {two}, '仟', {three}, '佰元整') "
        f"when 1 then concat({one}, '亿', {two}, '仟万零', {three}, '元整') "
        f"when 2 then concat({one}, '拾', {two}, '元', {three}, '角', {one}, '分') else concat({one}, '佰零', {two}, '圆整') end"
    )
    year, month, day = (f"substr({day_text}, {a}, {n})" for a, n in ((1, 4), (6, 2), (9, 2)))
    short = [f"cast(cast({part} as int) as string)" for part in (month, day)]
    issued = (
        f"case o_orderkey % 4 when 0 then concat({year}, '-', {month}, '-', {day}) when 1 then concat({year}, '/', {short[0]}, '/', {short[1]}) "
        f"when 2 then concat({year}, '.', {month}, '.', {short[1]}) else concat({year}, '年', {month}, '月', {day}, '日') end"
    )
    plain_untaxed = (
        f"case o_orderkey % 6 when 2 then concat(cast(cast(floor({untaxed} / 100) as bigint) as string), '元') "
        f"when 3 then concat('¥', cast(cast(floor({untaxed} / 100) as bigint) as string)) else concat('¥', {money(untaxed)}) end"
    )
    total = named("_total", f"({untaxed} + {tax})")
    no_tax = "o_orderkey % 10 = 3"
    lonely = "o_orderkey % 10 = 4"
    rows = [
        ("0", "case when o_orderkey % 7 = 0 then '增值税专用发票' when o_orderkey % 7 = 1 then '电子发票 普通发票' else '数电票' end", "40", "320"),
        ("1", f"case when o_orderkey % 8 = 0 then {_pad('o_orderkey', 12)} else concat('发票代码: ', {_pad('o_orderkey', 12)}) end", "90", "650"),
        ("2", f"case when o_orderkey % 9 = 0 then '票号不清' when o_orderkey % 9 = 1 then {_pad('o_orderkey', 8)} "
              f"else concat('发票号码: ', {_pad('o_orderkey', 8)}) end", "120", "650"),
        ("3", f"concat('开票日期: ', {issued})", "160", "650"),
        ("4", "concat('购买方名称: 买方', cast(o_custkey % 50 as string), '有限公司')", "200", "100"),
        ("5", f"{_uscc('o_custkey % 1000')}", "220", "100"),
        ("6", f"case when {no_tax} or {lonely} then '见清单' else {plain_untaxed} end", "400", "600"),
        ("7", f"case when {no_tax} or {lonely} then '免税' else concat(cast({rate} as string), '%') end", "400", "750"),
        ("8", f"case when {no_tax} or {lonely} then '无' else {money(tax)} end", "400", "820"),
        ("9", f"case when {lonely} then '合计' else concat('合计 ', {money(untaxed)}) end", "650", "550"),
        ("10", f"case when {no_tax} or {lonely} then '备注' else concat('税额 ', {money(tax)}) end", "650", "800"),
        ("11", f"case when o_orderkey % 3 = 0 then concat('价税合计(大写) ', {capital}) else '大写见附' end", "700", "100"),
        ("12", f"concat(case when o_orderkey % 5 = 0 then '' else '(小写) ' end, '¥', case when o_orderkey % 6 = 1 then {grouped(total)} else {money(total)} end)", "720", "700"),
        ("13", "concat('销售方名称: 卖方', cast(o_custkey % 70 as string), case o_orderkey % 3 when 0 then '酒店' when 1 then "
               "'科技公司' else '餐饮店' end)", "760", "100"),
        ("14", f"concat('销售方税号 ', {_uscc('o_custkey % 777')})", "800", "100"),
        ("15", "case o_orderkey % 5 when 0 then '住宿服务' when 1 then '餐饮服务' when 2 then '软件开发' when 3 then '客票' else '文具' end", "350", "100"),
    ]
    return f"""
    select o_orderkey as file_id, token_idx, text, ymin, xmin, cast(50 + (o_orderkey + token_idx) % 50 as double) / 100 as confidence
    from {d.unrolled('orders', _tokens(rows), shared)}"""


def v_tickets(d):
    """One railway ticket per order."""
    train = "concat('D', cast(1000 + o_orderkey % 8000 as string))"
    rows = [
        ("0", f"concat(case when o_orderkey % 3 = 0 then 'Z31G' else 'A12B' end, {_pad('o_orderkey', 6)})", "60", "80"),
        ("1", f"case when o_orderkey % 4 = 0 then concat({_city('o_custkey')}, '南站') else concat({_city('o_custkey')}, '站') end", "150", "100"),
        ("2", f"case when o_orderkey % 2 = 0 then concat({train}, '·', {_city('o_custkey + 5')}, '站') else {train} end", "160", "400"),
        ("3", f"case when o_orderkey % 2 = 0 then '检票口 12A' else concat({_city('o_custkey + 5')}, '东站') end", "150", "700"),
        ("4", "concat(substr(cast(o_orderdate as string), 1, 4), '年', substr(cast(o_orderdate as string), 6, 2), '月', "
              f"substr(cast(o_orderdate as string), 9, 2), '日', {_pad('o_orderkey % 24', 2)}, ':05开')", "300", "100"),
        ("5", "concat('￥', cast(20 + o_orderkey % 700 as string), '.5元')", "360", "100"),
        ("6", "case o_orderkey % 4 when 0 then '二等座' when 1 then '一等座' when 2 then '商务座' else '无座' end", "360", "700"),
        ("7", "concat('330106', '19900101', '****', case o_orderkey % 2 when 0 then '张三丰' else '李四' end)", "500", "100"),
        ("8", "case when o_orderkey % 5 = 0 then '杭州东售' else '限乘当日当次车' end", "600", "100"),
    ]
    return f"""
    select o_orderkey as file_id, token_idx, text, ymin, xmin, cast(0.9 as double) as confidence
    from {d.unrolled('orders', _tokens(rows))}"""


def v_policy_versions(d):
    return f"""
    select p_partkey % 40 as policy_key, cast(floor(p_partkey / 40) as bigint) as version_no,
      {d.add_days('1995-01-01', 'p_partkey * 613 % 2500')} as effective_from
    from {d.t('part')}"""


def v_policy_uses(d):
    """Lines and the policy version they were settled by; four of ten lie with one policy."""
    return f"""
    select l_orderkey as document_id, {_LINE_KEY} as line_key,
      case when l_partkey % 10 < 4 then 0 else l_suppkey % 41 end as policy_key, (l_orderkey * 7 + l_partkey) % 53 as used_version,
      case when l_partkey % 37 = 0 then null else cast(l_shipdate as date) end as expense_day
    from {d.t('lineitem')}"""


def v_expenses(d):
    """Lines with their applicant; a third of the documents is one applicant's."""
    return f"""
    select l_orderkey as document_id, case when o_orderkey % 3 = 0 then 1 when o_custkey % 90 = 0 then null else o_custkey end as applicant_id,
      case l_partkey % 5 when 0 then '采购' when 1 then '招待' when 2 then '办公' when 3 then '会务' else null end as category,
      case when l_suppkey % 31 = 0 then null else cast(l_shipdate as date) end as expense_day,
      case when l_partkey % 53 = 0 then null when l_partkey % 47 = 0 then -{_AMOUNT} else {_AMOUNT} end as amount
    from {d.t('lineitem')} join {d.t('orders')} on l_orderkey = o_orderkey"""


def v_contracts(d):
    return f"""
    select c_custkey as contract_id, case when c_custkey % 31 = 0 then null
      when c_custkey = 7 then cast(900000 as decimal(14,2)) else cast(1500 + c_custkey % 4000 as decimal(14,2)) end as contract_total
    from {d.t('customer')}"""


def v_payments(d):
    """One payment per order; three of ten go to one contract."""
    return f"""
    select case when o_orderkey % 10 < 3 then 7 when o_orderkey % 71 = 0 then null else o_custkey end as contract_id,
      cast(o_orderdate as date) as paid_on, o_orderkey as document_id,
      case when o_orderkey % 41 = 0 then null
        else cast(cast(o_totalprice as decimal(14,2)) * cast(0.01 as decimal(3,2)) as decimal(14,2)) end as amount
    from {d.t('orders')}"""


def _prepaid(d, condition: str, factor: str) -> str:
    return f"""
    select case when o_orderkey % 10 < 3 then 7 else o_custkey end as account_id, cast(o_orderdate as date) as day, o_orderkey as entry_id,
      case when o_orderkey % 61 = 0 then null
        else cast(cast(o_totalprice as decimal(14,2)) * cast({factor} as decimal(3,2)) as decimal(14,2)) end as amount
    from {d.t('orders')} where {condition}"""


def v_advances(d):
    return _prepaid(d, "o_orderstatus = 'F'", "0.06")


def v_offsets(d):
    return _prepaid(d, "o_orderstatus <> 'F'", "0.03")


def v_pre_approvals(d):
    """One approval per order; number 3 is a large one that is valid for long."""
    return f"""
    select o_orderkey as approval_id, case when o_orderkey % 3 = 0 then 1 else o_custkey end as applicant_id,
      case when (o_orderkey + case when o_orderkey % 17 = 0 then 1 else 0 end) % 2 = 0 then '采购' else '招待' end as category,
      case when o_orderkey = 3 then date '1990-01-01' when o_orderkey % 43 = 0 then null else cast(o_orderdate as date) end as valid_from,
      case when o_orderkey = 3 then date '2005-12-31' else cast(cast(o_orderdate as date) + cast(20 + o_orderkey % 90 as int) as date) end as valid_to,
      case when o_orderkey = 3 then cast(900000 as decimal(14,2)) when o_orderkey % 59 = 0 then null
        else cast(cast(o_totalprice as decimal(14,2)) * cast(0.70 as decimal(3,2)) as decimal(14,2)) end as amount,
      case when o_orderkey % 13 = 0 then 'REJECTED' when o_orderkey % 61 = 0 then null else 'APPROVED' end as status
    from {d.t('orders')}"""


def v_gated_expenses(d):
    """Lines and the approval they name; an eighth names number 3, whoever the applicant is."""
    return f"""
    select l_orderkey as document_id, {_LINE_KEY} as line_key, case when o_orderkey % 3 = 0 then 1 else o_custkey end as applicant_id,
      case when l_partkey % 11 = 0 then '办公' when o_orderkey % 2 = 0 then '采购' else '招待' end as category,
      case when l_suppkey % 31 = 0 then null else cast(l_shipdate as date) end as expense_day,
      case when l_partkey % 53 = 0 then null else cast(l_extendedprice as decimal(14,2)) end as amount,
      case when l_partkey % 7 = 0 then null when l_partkey % 101 = 0 then -1 when l_partkey % 8 = 0 then 3 else l_orderkey end as approval_id
    from {d.t('lineitem')} join {d.t('orders')} on l_orderkey = o_orderkey"""


_BATCH = "case when l_orderkey % 5 = 0 then 5 else l_orderkey end"
_PAID_AMOUNT = "case when l_partkey % 71 = 0 then null else cast(l_extendedprice as decimal(14,2)) end"


def v_batch_payments(d):
    """One payment per line; a fifth of them is one batch."""
    return f"""
    select {_BATCH} as document_id, case when l_partkey % 20 = 0 then 'A 0' when l_partkey % 67 = 0 then ' ' else concat('A', cast(l_partkey as string)) end as account_no,
      case when l_partkey % 83 = 0 then null when l_partkey % 9 = 0 then concat('Payee', cast(l_suppkey % 3 as string))
        when l_suppkey % 2 = 0 then concat(' payee', cast(l_partkey as string)) else concat('PAYEE', cast(l_partkey as string), ' ') end as payee_name,
      {_PAID_AMOUNT} as amount
    from {d.t('lineitem')}"""


def v_batches(d):
    """Headers of the batches, some wrong; batches of number 4 are announced and never paid."""
    return f"""
    select document_id, cast(case when document_id % 29 = 0 then null when document_id % 11 = 0 then total + 1 else total end as decimal(38,2)) as total_amount,
      case when document_id % 37 = 0 then null when document_id % 13 = 0 then n + 1 else n end as declared_count
    from (select {_BATCH} as document_id, coalesce(sum({_PAID_AMOUNT}), 0) as total, count(*) as n from {d.t('lineitem')} group by {_BATCH}) s
    union all select -o_orderkey as document_id, cast(o_totalprice as decimal(38,2)) as total_amount, 1 as declared_count from {d.t('orders')} where o_orderkey % 101 = 4"""


def v_purchases(d):
    """Lines as purchases of an item at a unit price; a tenth is one item's, and some lines are dear."""
    return f"""
    select l_orderkey as document_id, {_LINE_KEY} as line_key, case when l_partkey % 10 = 0 then 10 when l_partkey % 73 = 0 then null else l_partkey end as item_key,
      case when l_suppkey % 31 = 0 then null else cast(l_shipdate as date) end as day,
      case when l_orderkey % 89 = 0 then null when l_orderkey % 97 = 0 then cast(0 as decimal(14,2))
        else cast(cast(100 + l_partkey % 50 + l_suppkey % 7 as decimal(14,2)) * case when l_orderkey % 23 = 0 then cast(1.20 as decimal(3,2))
          when l_orderkey % 19 = 0 then cast(1.60 as decimal(3,2)) else cast(1.00 as decimal(3,2)) end as decimal(14,2)) end as unit_price
    from {d.t('lineitem')}"""


VIEWS = {name: fn for name, fn in list(globals().items()) if name.startswith("v_") and callable(fn)}


#: Views that make many rows of each row of orders.
UNROLLED = {"tokens", "tickets"}
#: Rows of orders that a task unrolls at most, so that what it sorts or groups by file does not grow with the table.
DEALT_ROWS = 100_000


class Tables:
    """Lazy access to the driver tables and to the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self._views: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in DRIVER_TABLES:
            if SparkDialect.t(name) in text:
                self.source(name).createOrReplaceTempView(SparkDialect.t(name))
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        view = VIEWS.get(f"v_{name}")
        if view is None:
            raise AttributeError(name)
        if name not in self._views:
            text = view(SparkDialect)
            if name in UNROLLED:
                # A row becomes many here, and a driver table may be a single file: deal its narrow rows out first, by file,
                # so that what gathers the many rows of a file finds them together.
                orders = self.source("orders")
                parts = max(2 * self.spark.sparkContext.defaultParallelism, -(-orders.count() // DEALT_ROWS))
                orders.repartition(parts, "o_orderkey").createOrReplaceTempView(SparkDialect.t("orders"))
                self._views[name] = self.spark.sql(text)
            else:
                self._views[name] = self.sql(text)
        return self._views[name]

    def stored(self, name: str) -> DataFrame:
        """The view as a stored table, as an audit would find its inputs."""
        self._views[name] = materialize(getattr(self, name))
        return self._views[name]


def with_views(names: list[str], body: str) -> str:
    """DuckDB text: the named views as CTEs, then the body (a SELECT, or further CTEs)."""
    ctes = ",\n".join(f"{name} as materialized ({VIEWS[name](DuckDialect)})" for name in names)
    body = body.strip()
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}" if ctes else body
    return f"with {ctes}\n{body}" if ctes else body
