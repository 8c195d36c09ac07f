"""Queries for the scalar expressions and the audit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.fixtures.oracle_parts import CITY, IDENTITY, TO_BOOL, USCC_OK, city_map, dec, km
from docaudit.fixtures.registry import brief, brief_sql, query
from docaudit.functions import geo, scalars as S
from docaudit.operators import amount, invoices, policy, supplier, travel

# ---------------------------------------------------------------- scalar expressions


@query("sc1_safe_decimal", ["v_lines"], f"""
    select document_id, line_key, {dec('amount')} as amount_value, {dec('quantity')} as quantity_value from v_lines""")
def _(t):
    return t.lines.select(
        "document_id", "line_key", S.safe_decimal(F.col("amount")).alias("amount_value"),
        S.safe_decimal(F.col("quantity")).alias("quantity_value"),
    )


@query("sc2_safe_boolean", ["v_purpose_verdicts"], f"""
    select document_id, {TO_BOOL.format('verdict')} as verdict_value from v_purpose_verdicts""")
def _(t):
    return t.purpose_verdicts.select("document_id", S.safe_bool(F.col("verdict")).alias("verdict_value"))


@query("sc3_json_object", ["v_model_texts"], """
    select text_id, cast(o_custkey as varchar) as n from (
      select m.text_id, case when m.text_id % 6 < 3 then o.o_custkey end as o_custkey
      from v_model_texts m join orders o on o.o_orderkey = m.text_id)""")
def _(t):
    found = S.safe_json_object(F.col("reply"))
    return t.model_texts.select("text_id", F.get_json_object(found, "$.n").alias("n"))


@query("sc4_identity_key", ["v_invoices"], f"select document_id, invoice_key, {IDENTITY} as identity_key from v_invoices")
def _(t):
    return t.invoices.select(
        "document_id", "invoice_key", S.identity_key(F.col("invoice_code"), F.col("invoice_number")).alias("identity_key")
    )


_MONEY = "coalesce(cast(cast(total_amount as decimal(38,2)) as varchar), '0.00')"


@query("sc5_content_hash", ["v_invoices"], f"""
    select document_id, invoice_key, case when k is null then null
      else sha256(k || '#' || {_MONEY} || '#' || coalesce(trim(issue_date), '')) end as content_hash
    from (select *, {IDENTITY} as k from v_invoices)""")
def _(t):
    return t.invoices.select(
        "document_id", "invoice_key",
        S.content_hash(*[F.col(c) for c in ("invoice_code", "invoice_number", "total_amount", "issue_date")]).alias("content_hash"),
    )


@query("sc6_fingerprint", ["v_invoices"], f"""
    select document_id, invoice_key, case when k is null then ''
      when total_amount is null and d = '' then sha256(k)
      else sha256(k || '#' || {_MONEY} || '#' || trim(d)) end as fingerprint
    from (select *, {IDENTITY} as k, case when document_id % 3 = 0 then '' else issue_date end as d from v_invoices)""")
def _(t):
    day = F.when(F.col("document_id") % 3 == 0, F.lit("")).otherwise(F.col("issue_date"))
    return t.invoices.select(
        "document_id", "invoice_key",
        S.fingerprint(F.col("invoice_code"), F.col("invoice_number"), F.col("total_amount"), day).alias("fingerprint"),
    )


@query("sc7_ingest_hash", ["v_invoices"], """
    select document_id, invoice_key, case when coalesce(invoice_number, '') = '' or total_amount is null then null
      else sha256(coalesce(nullif(invoice_code, ''), 'NONE') || '#' || invoice_number || '#' ||
        cast(cast(total_amount as decimal(38,2)) as varchar) || '#' || coalesce(nullif(issue_date, ''), 'UNKNOWN')) end as ingest_hash
    from v_invoices""")
def _(t):
    return t.invoices.select(
        "document_id", "invoice_key",
        S.ingest_hash(*[F.col(c) for c in ("invoice_code", "invoice_number", "total_amount", "issue_date")]).alias("ingest_hash"),
    )


@query("sc8_trailing_number", ["v_invoices"], """
    select document_id, invoice_key,
      nullif(regexp_replace(regexp_extract(trim(invoice_number), '([0-9]+)$', 1), '^0+([0-9])', '\\1'), '') as trailing
    from v_invoices""")
def _(t):
    return t.invoices.select(
        "document_id", "invoice_key", S.trailing_number(F.col("invoice_number")).alias("trailing")
    )


@query("sc9_uscc_checksum", ["v_invoices"], f"""
    select document_id, invoice_key, coalesce({USCC_OK.format('u')}, false) as valid
    from (select *, upper(trim(seller_tax_id)) as u from v_invoices)""")
def _(t):
    return t.invoices.select("document_id", "invoice_key", S.uscc_valid(F.col("seller_tax_id")).alias("valid"))


@query("sc10_distance", ["v_points"], f"""
    select point_no, round({km('latitude', 'longitude', '39.9042', '116.4074')}, 2) as km_to_capital from v_points""")
def _(t):
    return t.points.select(
        "point_no",
        F.round(geo.distance_km(F.col("latitude"), F.col("longitude"), F.lit(39.9042), F.lit(116.4074)), 2).alias("km_to_capital"),
    )


@query("sc11_city_resolution", ["v_lines"], f"""
    with {city_map('select city_name as txt from v_lines')}
    select l.document_id, l.line_key, c.short_name, c.full_name from v_lines l left join cmap c on c.txt = l.city_name""")
def _(t):
    rank = geo.city_rank(F.col("city_name"))
    return t.lines.select(
        "document_id", "line_key", geo.city_short_name(rank).alias("short_name"), geo.city_name(rank).alias("full_name")
    )


@query("sc12_city_tier_limit", ["v_lines"], f"""
    with {city_map('select city_name as txt from v_lines')}
    select l.document_id, l.line_key, coalesce(c.tier, 'TIER_3') as tier, coalesce(c.lim, cast(260 as decimal(14,2))) as hotel_limit
    from v_lines l left join cmap c on c.txt = l.city_name""")
def _(t):
    rank = geo.city_rank(F.col("city_name"))
    return t.lines.select(
        "document_id", "line_key", geo.city_tier(rank).alias("tier"), geo.city_limit_or_default(rank).alias("hotel_limit")
    )


@query("sc13_station_city", ["v_segments"], f"""
    with {city_map("select departure_city as txt from v_segments union select arrival_city from v_segments")}
    select s.document_id, s.segment_id, coalesce(a.short_name, trim(nullif(s.departure_city, ''))) as departure,
      coalesce(b.short_name, trim(nullif(s.arrival_city, ''))) as arrival
    from v_segments s left join cmap a on a.txt = s.departure_city left join cmap b on b.txt = s.arrival_city""")
def _(t):
    return t.segments.select(
        "document_id", "segment_id", geo.city_or_text(F.col("departure_city")).alias("departure"),
        geo.city_or_text(F.col("arrival_city")).alias("arrival"),
    )


_NIGHT_UNIT = "(coalesce(trim(unit), '') in ('晚','夜','间夜','间/夜','间·夜') or contains(coalesce(unit,''), '晚') or contains(coalesce(item_desc,''), '间夜'))"


def _whole(expr):
    return f"(case when trunc(try_cast(trim({expr}) as decimal(24,6))) > 0 then cast(trunc(try_cast(trim({expr}) as decimal(24,6))) as bigint) end)"


_NIGHTS = f"coalesce({_whole('coalesce(stay_nights, nights)')}, case when {_NIGHT_UNIT} then {_whole('quantity')} end)"


@query("sc14_night_count", ["v_lines"], f"select document_id, line_key, {_NIGHTS} as nights_counted from v_lines")
def _(t):
    return t.lines.select(
        "document_id", "line_key",
        S.night_count(*[F.col(c) for c in ("stay_nights", "nights", "quantity", "unit", "item_desc")]).alias("nights_counted"),
    )


@query("sc15_night_unit", ["v_lines"], f"select document_id, line_key, {_NIGHT_UNIT} as night_unit from v_lines")
def _(t):
    return t.lines.select("document_id", "line_key", S.is_night_unit(F.col("unit"), F.col("item_desc")).alias("night_unit"))


_ALLOW = ("(trim(coalesce(expense_type,'')) in ('差旅津贴','交通补贴','伙食补贴','通讯补贴','定额补助','出差补贴','加班餐补','市内交通补贴','包干补贴','自驾油补','误餐补助')"
          " or regexp_matches(coalesce(expense_type,''), '津贴|补贴|补助|包干|餐补|油补|车补|房补|外勤')"
          " or regexp_matches(coalesce(item_desc,''), '津贴|补贴|补助|包干|餐补|油补|车补|房补|外勤'))")


@query("sc16_allowance_candidate", ["v_lines"], f"select document_id, line_key, {_ALLOW} as candidate from v_lines")
def _(t):
    return t.lines.select(
        "document_id", "line_key", S.is_candidate_allowance(F.col("expense_type"), F.col("item_desc")).alias("candidate")
    )


_SENSITIVE = "regexp_matches(lower(coalesce(item_desc,'') || coalesce(expense_type,'')), '高尔夫|游戏充值|酒吧|ktv|美容美发|奢侈品|名牌包|个人烟酒|度假村套票')"


@query("sc18_sensitive_spending", ["v_lines"], f"""
    select document_id, bool_or({_SENSITIVE}) as sensitive from v_lines group by document_id""")
def _(t):
    return t.lines.groupBy("document_id").agg(policy.sensitive_column())


@query("sc19_lodging_line", ["v_lines"], """
    select document_id, line_key, regexp_matches(coalesce(expense_type,''), '住宿|酒店') or regexp_matches(coalesce(item_desc,''), '住宿|酒店') as for_dates,
      contains(coalesce(expense_type,''), '住宿') as for_limits from v_lines""")
def _(t):
    return t.lines.select(
        "document_id", "line_key", S.is_lodging(F.col("expense_type"), F.col("item_desc")).alias("for_dates"),
        S.is_lodging_by_type(F.col("expense_type")).alias("for_limits"),
    )


@query("sc20_abnormal_status", ["v_suppliers"], """
    select uscc, supplier_name, regexp_matches(coalesce(operating_status,''), '注销|吊销|异常|撤销') as abnormal from v_suppliers""")
def _(t):
    return t.suppliers.select("uscc", "supplier_name", S.is_abnormal_status(F.col("operating_status")).alias("abnormal"))


@query("sc21_document_number", ["v_documents"], """
    select document_id, case document_type when 'TRAVEL_REIMBURSEMENT' then 'TRV' when 'EXPENSE_REIMBURSEMENT' then 'EXP'
      when 'CORP_PAYMENT' then 'CORP' when 'ADVANCE_PAYMENT' then 'ADV' when 'BATCH_PAYMENT' then 'BAT' else 'DOC' end
      || '-' || strftime(created_at, '%Y%m%d') || '-' || upper(substr(sha256(cast(document_id as varchar)), 1, 32)) as generated_no
    from v_documents""")
def _(t):
    return t.documents.select(
        "document_id",
        S.document_number(F.col("document_type"), F.col("created_at"), F.col("document_id")).alias("generated_no"),
    )


@query("sc22_cache_key", ["v_documents"], """
    select document_id, 'supplier_scope:' || substr(sha256('{"department":' || case when department_name is null then 'null' else '"' || department_name || '"' end ||
      ',"title":"' || title || '"}'), 1, 24) as cache_key from v_documents""")
def _(t):
    return t.documents.select(
        "document_id",
        S.cache_key("supplier_scope", title=F.col("title"), department=F.col("department_name")).alias("cache_key"),
    )


# ---------------------------------------------------------------- travel facts

_TF1 = f"""
    with p as (select document_id, invoice_key, invoice_number, coalesce(invoice_type, '') as kind,
        nullif(json_extract_string(raw_payload, '$.departure_city'), '') as dep0,
        nullif(json_extract_string(raw_payload, '$.arrival_city'), '') as arr0,
        json_extract_string(raw_payload, '$.departure_time') as dt, json_extract_string(raw_payload, '$.arrival_time') as at_,
        json_extract_string(raw_payload, '$.travel_date') as td from v_invoices),
    rl as (select document_id, arg_min(item_desc, line_key) as route_line from v_lines
      where contains(coalesce(item_desc,''), '-') or contains(coalesce(item_desc,''), '—') or contains(coalesce(item_desc,''), '至') group by document_id),
    q as (select p.*, case when (dep0 is null or arr0 is null) and regexp_matches(kind, '铁路|火车|航空|机票|客票|行程单') then route_line end as txt0
      from p left join rl using (document_id)),
    r as (select *, nullif(trim(regexp_extract(txt0, '([^\\s\\-—至]+)[—\\-至到]([^\\s\\-—次]+)', 1)), '') as rdep,
      nullif(trim(regexp_extract(txt0, '([^\\s\\-—至]+)[—\\-至到]([^\\s\\-—次]+)', 2)), '') as rarr,
      nullif(regexp_extract(txt0, '([A-Z]\\d{{1,4}})次?', 1), '') as rno from q),
    {city_map("select dep0 as txt from r union select arr0 from r union select rdep from r union select rarr from r")},
    s as (select r.*, coalesce(a.short_name, trim(dep0), b.short_name, trim(rdep)) as dep, coalesce(c.short_name, trim(arr0), e.short_name, trim(rarr)) as arr
      from r left join cmap a on a.txt = dep0 left join cmap b on b.txt = rdep left join cmap c on c.txt = arr0 left join cmap e on e.txt = rarr)
"""


@query("tf1_segment_extraction", ["v_invoices", "v_lines"], _TF1 + """
    select document_id, invoice_key as segment_id, coalesce(dep, '') as departure_city, coalesce(arr, '') as arrival_city,
      epoch_us(try_cast(dt as timestamp)) as departure_us, epoch_us(try_cast(at_ as timestamp)) as arrival_us,
      try_cast(td as date) as travel_date, case when regexp_matches(kind, '铁|车') then 'TRAIN' else 'FLIGHT' end as transport_mode, rno as transport_no
    from s where dep is not null or arr is not null or regexp_matches(kind, '铁路|火车|航空|机票|客票|行程单|出租车|打车|网约车|交通')""")
def _(t):
    return travel.extract_segments(t.invoices, t.lines).select(
        "document_id", "segment_id", "departure_city", "arrival_city",
        F.unix_micros("departure_time").alias("departure_us"), F.unix_micros("arrival_time").alias("arrival_us"),
        "travel_date", "transport_mode", "transport_no",
    )


@query("tf2_route_text", ["v_lines"], """
    select document_id, line_key, nullif(trim(regexp_extract(item_desc, '([^\\s\\-—至]+)[—\\-至到]([^\\s\\-—次]+)', 1)), '') as route_from,
      nullif(trim(regexp_extract(item_desc, '([^\\s\\-—至]+)[—\\-至到]([^\\s\\-—次]+)', 2)), '') as route_to,
      nullif(regexp_extract(item_desc, '([A-Z]\\d{1,4})次?', 1), '') as train_no from v_lines""")
def _(t):
    text = F.col("item_desc")
    return t.lines.select(
        "document_id", "line_key", travel.route_from(text).alias("route_from"), travel.route_to(text).alias("route_to"),
        travel.train_number(text).alias("train_no"),
    )


@query("tf3_travel_date", ["v_invoices"], """
    select document_id, invoice_key, try_cast(coalesce(json_extract_string(raw_payload, '$.travel_date'), json_extract_string(raw_payload, '$.departure_date'),
      json_extract_string(raw_payload, '$.journey_date')) as date) as travel_date from v_invoices""")
def _(t):
    def field(key):
        return F.nullif(F.get_json_object("raw_payload", f"$.{key}"), F.lit(""))

    day = F.coalesce(field("travel_date"), field("departure_date"), field("journey_date"))
    return t.invoices.select("document_id", "invoice_key", travel.parse_day(day).alias("travel_date"))


@query("tf4_line_points", ["v_lines", "v_documents"], f"""
    with {city_map('select city_name as txt from v_lines')}
    select l.document_id as scope_id, l.line_key as point_id, l.start_date as day, c.full_name as city_name, round(c.lat, 4) as latitude, round(c.lng, 4) as longitude
    from v_lines l join v_documents d using (document_id) join cmap c on c.txt = l.city_name
    where d.document_type = 'TRAVEL_REIMBURSEMENT' and l.start_date is not null""")
def _(t):
    return travel.line_points(t.documents, t.lines).select(
        "scope_id", "point_id", F.to_date("event_time").alias("day"), "city_name",
        F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"),
    )


@query("tf5_time_parse", ["v_invoices"], """
    select document_id, invoice_key, epoch_us(try_cast(json_extract_string(raw_payload, '$.departure_time') as timestamp)) as departure_us from v_invoices""")
def _(t):
    time = travel.parse_time(F.get_json_object("raw_payload", "$.departure_time"))
    return t.invoices.select("document_id", "invoice_key", F.unix_micros(time).alias("departure_us"))


# ---------------------------------------------------------------- amount rules

LINE_SUMS = f"""ls as (select document_id, count(*) as line_count, bool_and({dec('amount')} is not null) as lines_valid,
      cast(sum({dec('amount')}) as decimal(38,2)) as line_sum from v_lines group by document_id)"""
INVOICE_SUMS = """ivs as (select document_id, count(*) as invoice_count, bool_and(total_amount is not null) as invoices_valid,
      cast(sum(total_amount) as decimal(38,2)) as invoice_sum from v_invoices group by document_id)"""

AM1 = brief_sql("R01_HEADER_LINE_MISMATCH", "'high'", "'document'", "abs(d.total_amount - s.line_sum)", False,
                "from v_documents d join ls s using (document_id) where s.lines_valid and d.total_amount <> s.line_sum")
AM2 = brief_sql("R02_INVOICE_SUM_MISMATCH", "'high'", "'document'", "abs(d.total_amount - s.invoice_sum)", False,
                "from v_documents d join ivs s using (document_id) where s.invoices_valid and d.total_amount <> s.invoice_sum")
AM3 = brief_sql("R05_TAX_AMOUNT_MISMATCH", "'medium'", "invoice_key", "abs(total_amount - (untaxed_amount + tax_amount))", True,
                "from v_invoices where abs(total_amount - (untaxed_amount + tax_amount)) > 0.01 and (untaxed_amount > 0 or tax_amount > 0)")
AM4 = brief_sql("R07_MANUAL_OVERRIDE_FLAG", "'medium'", "invoice_key", "null", True, "from v_invoices where is_manual_modified")


@query("am1_header_line_mismatch", ["v_documents", "v_lines"], f"with {LINE_SUMS} {AM1}")
def _(t):
    return brief(amount.header_line_mismatch(t.documents, t.lines))


@query("am2_invoice_sum_mismatch", ["v_documents", "v_invoices"], f"with {INVOICE_SUMS} {AM2}")
def _(t):
    return brief(amount.invoice_sum_mismatch(t.documents, t.invoices))


@query("am3_tax_mismatch", ["v_invoices"], AM3)
def _(t):
    return brief(amount.tax_mismatch(t.invoices))


@query("am4_manual_override", ["v_invoices"], f"""
    select b.*, coalesce(cast(i.original_extracted_amount as varchar), 'UNKNOWN') as extracted
    from ({AM4}) b join v_invoices i on i.document_id = b.document_id and i.invoice_key = b.subject_key""")
def _(t):
    found = amount.manual_override(t.invoices)
    return found.select(
        *brief(found).columns, F.col("expected_value")["ocr_extracted_amount"].alias("extracted")
    )


AMOUNT_STATUS = f"""select d.document_id, case when d.total_amount is null then 'FAILED'
        when not coalesce(s.lines_valid, true) or not coalesce(i.invoices_valid, true) then 'DEGRADED' else 'SUCCESS' end as status,
      case when d.total_amount is null then 'DATA_MISSING: CORE_TOTAL_AMOUNT_MISSING'
        when not coalesce(s.lines_valid, true) and not coalesce(i.invoices_valid, true) then '{amount.LINES_SKIPPED}；{amount.INVOICES_SKIPPED}'
        when not coalesce(s.lines_valid, true) then '{amount.LINES_SKIPPED}' when not coalesce(i.invoices_valid, true) then '{amount.INVOICES_SKIPPED}'
        else '执行成功' end as reason
    from v_documents d left join ls s using (document_id) left join ivs i using (document_id)"""


@query("am5_amount_degradation", ["v_documents", "v_lines", "v_invoices"], f"""
    with {LINE_SUMS}, {INVOICE_SUMS} select document_id, reason from ({AMOUNT_STATUS}) where status = 'DEGRADED'""")
def _(t):
    status = amount.amount_role_status(amount.reconcile(t.documents, t.lines, t.invoices))
    return status.where("is_degraded").select("document_id", "reason")


@query("am6_core_total_missing", ["v_documents", "v_lines", "v_invoices"], f"""
    with {LINE_SUMS}, {INVOICE_SUMS} {AMOUNT_STATUS}""")
def _(t):
    return amount.amount_role_status(amount.reconcile(t.documents, t.lines, t.invoices)).select(
        "document_id", "status", "reason"
    )


@query("am7_unbalanced_requests", ["v_documents", "v_lines"], f"""
    with {LINE_SUMS} select d.document_id, d.total_amount, s.line_sum, cast(abs(d.total_amount - s.line_sum) as decimal(38,2)) as difference
    from v_documents d join ls s using (document_id) where s.lines_valid and abs(d.total_amount - s.line_sum) > 0.01""")
def _(t):
    return amount.unbalanced_requests(t.documents, t.lines)


# ---------------------------------------------------------------- invoice anomaly rules

KEYED = f"""k as (select * from (select document_id, invoice_key, {IDENTITY} as id_key, cast(coalesce(total_amount, 0) as decimal(38,2)) as amt,
      row_number() over (partition by document_id, {IDENTITY} order by invoice_key) as rn,
      first_value(coalesce(total_amount, 0)) over (partition by document_id, {IDENTITY} order by invoice_key) as first_amt
      from v_invoices) where id_key is not null)"""
HIST = """hist as (select k.id_key, k.document_id, d.document_no, d.status, k.amt from k join v_documents d using (document_id)
      where d.status in ('APPROVED','PENDING_APPROVAL','IN_REVIEW')
        and k.rn = (select max(k2.rn) from k k2 where k2.document_id = k.document_id and k2.id_key = k.id_key))"""
AN1 = brief_sql("R08_INVOICE_DUPLICATE", "'high'", "invoice_key", "amt", False, "from k where rn > 1")
AN2 = brief_sql("R08_INVOICE_DUPLICATE", "'high'", "invoice_key", "amt", False, """from (
      select k.*, h.amt as h_amt, h.document_no, row_number() over (partition by k.document_id, k.id_key order by h.document_id desc) as pick
      from k join hist h on h.id_key = k.id_key and h.document_id <> k.document_id where k.rn = 1) where pick = 1""")


@query("an1_duplicates_inside", ["v_invoices"], f"""
    with {KEYED} select b.*, k.amt <> k.first_amt as amount_changed from ({AN1}) b
    join k on k.document_id = b.document_id and k.invoice_key = b.subject_key""")
def _(t):
    found = invoices.duplicates_inside(t.invoices)
    return found.select(
        *brief(found).columns, (F.col("actual_value")["is_amount_modified"] == "true").alias("amount_changed")
    )


@query("an2_duplicates_across", ["v_documents", "v_invoices"], f"""
    with {KEYED}, {HIST} select document_id, invoice_key as subject_key, document_no as conflict, amt as discrepancy_amount,
      amt <> h_amt as amount_changed from (
      select k.*, h.amt as h_amt, h.document_no, row_number() over (partition by k.document_id, k.id_key order by h.document_id desc) as pick
      from k join hist h on h.id_key = k.id_key and h.document_id <> k.document_id where k.rn = 1) where pick = 1""")
def _(t):
    shared = invoices.shared_invoices(t.invoices)
    found = invoices.duplicates_across(shared, invoices.historical_fingerprints(shared, t.documents))
    return found.select(
        "document_id", "subject_key", F.col("actual_value")["conflict_document_no"].alias("conflict"), "discrepancy_amount",
        (F.col("actual_value")["is_amount_modified"] == "true").alias("amount_changed"),
    )


@query("an3_history", ["v_documents", "v_invoices"], f"""
    with {KEYED}, {HIST} select id_key as identity_key, max(document_id) as newest_document, arg_max(document_no, document_id) as newest_no,
      arg_max(amt, document_id) as newest_amount,
      coalesce(max(document_id) filter (where r = 2), max(document_id)) as other_document
    from (select *, row_number() over (partition by id_key order by document_id desc) as r from hist) group by id_key""")
def _(t):
    history = invoices.historical_fingerprints(t.invoices, t.documents)
    return history.select(
        "identity_key", F.col("newest.document_id").alias("newest_document"), F.col("newest.document_no").alias("newest_no"),
        F.col("newest.total_amount").alias("newest_amount"), F.col("older.document_id").alias("other_document"),
    )


_HASHED = """h as (select i.invoice_hash, i.document_id, i.invoice_key, d.status in ('APPROVED','PENDING_APPROVAL','IN_REVIEW') as active,
      d.document_no, d.status from v_invoices i join v_documents d using (document_id) where i.invoice_hash is not null)"""


@query("an4_conflict_counts", ["v_documents", "v_invoices"], f"""
    with {_HASHED}, a as (select * from h where active),
    m as (select invoice_hash, document_id, count(*) as invoices from h group by 1, 2)
    select m.invoice_hash, m.document_id, m.invoices, count(*) as conflicting_invoices, count(distinct a.document_id) as conflicting_documents
    from m join a on a.invoice_hash = m.invoice_hash and a.document_id <> m.document_id group by 1, 2, 3""")
def _(t):
    return invoices.conflicts_by_hash(t.invoices, t.documents)


@query("an4_conflict_pairs", ["v_documents", "v_invoices"], f"""
    with {_HASHED}, r as (select invoice_hash, max(document_id) as current_document_id from h group by 1)
    select h.invoice_hash, r.current_document_id, h.document_id, h.invoice_key, h.document_no, h.status
    from r join h on h.invoice_hash = r.invoice_hash and h.document_id <> r.current_document_id where h.active""")
def _(t):
    requests = (
        t.invoices.where("invoice_hash is not null").groupBy("invoice_hash")
        .agg(F.max("document_id").alias("current_document_id"))
    )
    return invoices.conflicts_of(requests, t.invoices, t.documents)


def sequential_sql(view: str) -> str:
    """Runs of consecutive numbers by gaps and islands over all rows of a seller."""
    return f"""n as (select document_id, seller_tax_id, invoice_key, invoice_number, coalesce(total_amount, 0) as amt,
        try_cast(nullif(regexp_extract(trim(invoice_number), '([0-9]+)$', 1), '') as decimal(36,0)) as num
      from {view} where coalesce(seller_tax_id, '') <> ''),
    g as (select *, case when num - lag(num) over w = 1 then 0 else 1 end as brk from n where num is not null
      window w as (partition by document_id, seller_tax_id order by num, invoice_key)),
    i as (select *, sum(brk) over (partition by document_id, seller_tax_id order by num, invoice_key rows unbounded preceding) as island from g),
    runs as (select document_id, seller_tax_id, island, count(*) as run_length, cast(sum(amt) as decimal(38,2)) as run_total,
      arg_min(num, (num, invoice_key)) as first_number from i group by 1, 2, 3)"""


AN5 = brief_sql("R10_SEQUENTIAL_INVOICES", "case when run_total >= 10000 or run_length >= 4 then 'high' else 'medium' end",
                "seller_tax_id || '|' || cast(first_number as varchar)", "run_total", True,
                "from runs where run_length >= 3 and run_total >= 3000")


@query("an5_sequential_invoices", ["v_statements"], f"with {sequential_sql('v_statements')} {AN5}")
def _(t):
    return brief(invoices.sequential_invoices(t.statements))


@query("an5_sequential_runs", ["v_invoices"], f"""
    with {sequential_sql('v_invoices')} select document_id, seller_tax_id, cast(first_number as varchar) as first_number, run_length, run_total from runs where run_length > 1""")
def _(t):
    return invoices.sequential_runs(t.invoices).select(
        "document_id", "seller_tax_id", "first_number", "run_length", "run_total"
    )


# ---------------------------------------------------------------- space-time and travel rules

ST1 = f"""pp as (select *, lag(point_id) over w as p_id, lag(event_time) over w as p_time, lag(latitude) over w as p_lat, lag(longitude) over w as p_lng
      from {{view}} window w as (partition by scope_id order by event_time, point_no, point_id)),
    pd as (select *, {km('p_lat', 'p_lng', 'latitude', 'longitude')} as d, (epoch_us(event_time) - epoch_us(p_time)) / 3.6e9 as h from pp where p_id is not null)"""
ST1_HITS = "from pd where d >= 100 and (h <= 0 or (h < 2 and d / nullif(h, 0) > 250))"


@query("st1_point_collisions", ["v_points"], f"""
    with {ST1.format(view='v_points')} select scope_id as document_id, p_id || '|' || point_id as subject_key, round(d, 2) as distance_km, h <= 0 as simultaneous {ST1_HITS}""")
def _(t):
    return travel.point_collisions(t.points).select(
        "document_id", "subject_key", F.col("actual_value")["distance_km"].cast("double").alias("distance_km"),
        (F.col("actual_value")["is_simultaneous"] == "true").alias("simultaneous"),
    )


def segment_names(view: str = "v_segments") -> str:
    return f"""sn as (select s.*, coalesce(a.short_name, s.departure_city, '') as dep, coalesce(b.short_name, s.arrival_city, '') as arr
      from {view} s left join cmap a on a.txt = s.departure_city left join cmap b on b.txt = s.arrival_city)"""


def _touch(a, b):
    return f"(contains({a}, {b}) or contains({b}, {a}))"


CLAIMS = """cl as (select distinct l.document_id, coalesce(c.short_name, l.city_name) as claim from v_lines l left join cmap c on c.txt = l.city_name
      where coalesce(l.city_name, '') <> '')"""


def travel_cities(view: str) -> str:
    return city_map(
        f"select departure_city as txt from {view} union select arrival_city from {view} union select city_name from v_lines"
    )


ST2 = brief_sql("R09_TRAVEL_DESTINATION_MISMATCH", "'high'", "segment_id", "null", True, f"""from sn
      where exists (select 1 from cl where cl.document_id = sn.document_id)
        and not exists (select 1 from cl where cl.document_id = sn.document_id and ({_touch('dep', 'claim')} or {_touch('arr', 'claim')}))""")
ST3 = brief_sql("R09_TRAVEL_HOTEL_DATE_CONFLICT", "'high'", "l.line_key || '|' || sn.segment_id", "null", True, f"""from v_lines l
      join sn on sn.document_id = l.document_id left join cmap c on c.txt = l.city_name
      where (regexp_matches(coalesce(l.expense_type,''), '住宿|酒店') or regexp_matches(coalesce(l.item_desc,''), '住宿|酒店'))
        and coalesce(l.city_name, '') <> '' and l.start_date < coalesce(cast(sn.arrival_time as date), sn.travel_date)
        and {_touch('coalesce(c.short_name, l.city_name)', 'sn.arr')}""", doc="l.document_id")
ST4 = brief_sql("R09_TRAVEL_SEGMENT_OVERLAP", "'high'", "p_id || '|' || segment_id", "null", True, """from (
      select *, lag(segment_id) over w as p_id, lag(arrival_time) over w as p_arr from {view}
      where departure_time is not null and arrival_time is not null
      window w as (partition by document_id order by departure_time, segment_id)) where departure_time < p_arr""")
ST5 = f"""from {{view}} s join {{points}} p on p.scope_id = s.document_id and p.event_time between s.departure_time and s.arrival_time
      left join cmap a on a.txt = s.departure_city left join cmap b on b.txt = s.arrival_city
      where coalesce({km('p.latitude', 'p.longitude', 'a.lat', 'a.lng')}, 999) >= 100 and coalesce({km('p.latitude', 'p.longitude', 'b.lat', 'b.lng')}, 999) >= 100"""


@query("st2_destination_mismatch", ["v_segments", "v_lines"], f"with {travel_cities('v_segments')}, {segment_names()}, {CLAIMS} {ST2}")
def _(t):
    return brief(travel.destination_mismatch(t.segments, t.lines))


@query("st3_hotel_before_arrival", ["v_segments", "v_lines"], f"with {travel_cities('v_segments')}, {segment_names()} {ST3}")
def _(t):
    return brief(travel.hotel_before_arrival(t.segments, t.lines))


@query("st4_segment_overlap", ["v_segments"], ST4.format(view="v_segments"))
def _(t):
    return brief(travel.segment_overlaps(t.segments))


@query("st5_transit_collision", ["v_segments", "v_doc_points", "v_lines"], f"with {travel_cities('v_segments')} " + brief_sql(
    "R09_SPATIO_TEMPORAL_COLLISION", "'high'", "s.segment_id || '|' || p.point_id", "null", True,
    ST5.format(view="v_segments", points="v_doc_points"), doc="s.document_id"))
def _(t):
    return brief(travel.transit_collisions(t.segments, t.doc_points))


SEGMENT_FACTS = """sf as (select document_id, count(*) as segment_count,
      count(*) filter (where trim(coalesce(departure_city,'')) = '' or trim(coalesce(arrival_city,'')) = '') as no_route,
      count(*) filter (where travel_date is null and departure_time is null) as no_date,
      count(*) filter (where departure_time is null) as no_departure, count(*) filter (where arrival_time is null) as no_arrival,
      count(*) filter (where departure_time is not null and arrival_time is not null) as exact_times from {view} group by 1)"""


@query("st6_segment_gates", ["v_segments"], f"with {SEGMENT_FACTS.format(view='v_segments')} select * from sf")
def _(t):
    return travel.segment_facts(t.segments)


@query("st6_missing_fields", ["v_segments"], """
    select document_id, segment_id, 'route' as missing_field from v_segments where trim(coalesce(departure_city,'')) = '' or trim(coalesce(arrival_city,'')) = ''
    union all select document_id, segment_id, 'travel_date' from v_segments where travel_date is null and departure_time is null
    union all select document_id, segment_id, 'departure_time' from v_segments where departure_time is null
    union all select document_id, segment_id, 'arrival_time' from v_segments where arrival_time is null""")
def _(t):
    return travel.missing_segment_fields(t.segments)


# ---------------------------------------------------------------- policy rules

LODGING = f"""lod as (select l.document_id, l.line_key, {dec('l.amount')} as claimed, c.short_name, c.lim, {_NIGHTS} as nn
      from v_lines l left join cmap c on c.txt = l.city_name
      where contains(coalesce(l.expense_type,''), '住宿') and {dec('l.amount')} is not null)"""
PO1 = brief_sql("R05_POLICY_EXCEEDED", "case when claimed >= lim * coalesce(nn, 1) * 1.5 then 'high' else 'medium' end", "line_key",
                "claimed - lim * coalesce(nn, 1)", True, "from lod where claimed > lim * coalesce(nn, 1)")
PO2 = brief_sql("R14_POLICY_NOT_FOUND", "'low'", "line_key", "null", True, "from lod where short_name is null")
LINE_CITIES = city_map("select city_name as txt from v_lines")


@query("po1_lodging_over_limit", ["v_lines"], f"with {LINE_CITIES}, {LODGING} {PO1}")
def _(t):
    return brief(policy.lodging_findings(t.lines, rules=("policy_exceeded",)))


@query("po2_lodging_without_standard", ["v_lines"], f"with {LINE_CITIES}, {LODGING} {PO2}")
def _(t):
    return brief(policy.lodging_findings(t.lines, rules=("policy_missing",)))


PURPOSE = f"""pf as (select d.document_id, coalesce({TO_BOOL.format('v.verdict')}, not coalesce(s.sensitive, false)) as is_rational,
      case when {TO_BOOL.format('v.verdict')} is null then 'HEURISTIC_RULE' else coalesce(v.source, 'LLM_INFERENCE') end as source
    from v_documents d left join v_purpose_verdicts v using (document_id)
    left join (select document_id, bool_or({_SENSITIVE}) as sensitive from v_lines group by 1) s using (document_id))"""
PO3 = brief_sql("R16_BUSINESS_PURPOSE_MISMATCH", "'high'", "'document'", "0", True, "from pf where not is_rational")


@query("po3_purpose_mismatch", ["v_documents", "v_lines", "v_purpose_verdicts"], f"with {PURPOSE} {PO3}")
def _(t):
    return brief(policy.purpose_findings(policy.purpose_facts(t.documents, t.lines, t.purpose_verdicts)))


@query("po4_purpose_degradation", ["v_documents", "v_lines", "v_purpose_verdicts"], f"""
    with {PURPOSE} select document_id, case when source = 'HEURISTIC_RULE' then 'DEGRADED' else 'SUCCESS' end as status, source from pf""")
def _(t):
    facts = policy.purpose_facts(t.documents, t.lines, t.purpose_verdicts)
    return policy.policy_role_status(facts).select("document_id", "status", "source")


# ---------------------------------------------------------------- supplier rules

SUPPLIERS = """ds as (select document_id, upper(trim(seller_tax_id)) as uscc, arg_min(trim(seller_name), invoice_key) as name from v_invoices
      where trim(coalesce(seller_tax_id,'')) <> '' and trim(coalesce(seller_name,'')) <> '' group by 1, 2),
    pr as (select upper(trim(uscc)) as uscc, supplier_name, is_dishonest, coalesce(nullif(operating_status,''), '存续') as operating_status, is_shell_company,
      coalesce(nullif(business_scope,''), json_extract_string(risk_tags, '$.business_scope')) as business_scope from v_suppliers)"""
SUPPLIER_FACTS = SUPPLIERS + f""",
    sp as (select ds.document_id, ds.uscc, d.title, pr.uscc is not null as found, {USCC_OK.format('ds.uscc')} as code_ok, pr.is_dishonest, pr.operating_status,
      pr.is_shell_company, trim(coalesce(pr.business_scope,'')) <> '' as has_scope, d.title <> '' as has_title, {TO_BOOL.format('v.verdict')} as verdict, v.source as vsource
    from ds join v_documents d using (document_id) left join pr on pr.uscc = ds.uscc
    left join v_scope_verdicts v on v.document_id = ds.document_id and v.uscc = ds.uscc
    where d.document_type in ('CORP_PAYMENT','ADVANCE_PAYMENT','BATCH_PAYMENT')),
    sx as (select *, case when not found then 'SUPPLIER_PROFILE_MISSING' when has_title and not has_scope then 'SUPPLIER_BUSINESS_SCOPE_MISSING'
      when has_title and (verdict is null or vsource = 'HEURISTIC_RULE') then 'SUPPLIER_SCOPE_FALLBACK_RULE' end as degraded_reason from sp)"""
SU3 = brief_sql("R12_SUPPLIER_UNREGISTERED", "'high'", "uscc", "null", False, "from sx where not code_ok")
SU5 = brief_sql("R13_SUPPLIER_DISHONEST", "'high'", "uscc", "null", False, "from sx where found and is_dishonest")
SU6 = brief_sql("R15_SHELL_COMPANY", "'high'", "uscc", "null", False,
                "from sx where found and (is_shell_company or regexp_matches(operating_status, '注销|吊销|异常|撤销'))")
SU7 = brief_sql("R17_SUPPLIER_SCOPE_DEVIATION", "'high'", "uscc", "null", True, "from sx where found and has_title and has_scope and verdict = false")
SUPPLIER_VIEWS = ["v_documents", "v_invoices", "v_suppliers", "v_scope_verdicts"]


def _supplier_facts(t):
    return supplier.supplier_facts(t.documents, t.invoices, t.suppliers, t.scope_verdicts)


@query("su1_document_suppliers", ["v_invoices", "v_suppliers"], f"with {SUPPLIERS} select * from ds")
def _(t):
    return supplier.document_suppliers(t.invoices)


@query("su2_supplier_profiles", ["v_invoices", "v_suppliers"], f"""
    with {SUPPLIERS} select ds.document_id, ds.uscc, pr.supplier_name, pr.operating_status, pr.business_scope, pr.uscc is not null as profile_found
    from ds left join pr on pr.uscc = ds.uscc""")
def _(t):
    profiles = supplier.supplier_profiles(t.suppliers).withColumn("_found", F.lit(True))
    return supplier.document_suppliers(t.invoices).join(profiles, "uscc", "left").select(
        "document_id", "uscc", "supplier_name", "operating_status", "business_scope",
        F.coalesce("_found", F.lit(False)).alias("profile_found"),
    )


for _name, _rule, _sql in (
    ("su3_unregistered", "unregistered", SU3), ("su7_scope_deviation", "scope", SU7),
):
    query(_name, SUPPLIER_VIEWS, f"with {SUPPLIER_FACTS} {_sql}")(
        lambda t, rule=_rule: brief(supplier.supplier_findings(_supplier_facts(t), (rule,)))
    )

for _name, _rule, _sql in (("su5_dishonest", "dishonest", SU5), ("su6_shell_company", "shell", SU6)):
    query(_name, SUPPLIER_VIEWS, f"with {SUPPLIER_FACTS} {_sql}")(
        lambda t, rule=_rule: brief(supplier.profile_findings(t.documents, t.invoices, t.suppliers, rule))
    )


@query("su4_missing_profile", SUPPLIER_VIEWS, f"""
    with {SUPPLIER_FACTS} select document_id, uscc, degraded_reason from sx where degraded_reason is not null""")
def _(t):
    return _supplier_facts(t).where("degraded_reason is not null").select("document_id", "uscc", "degraded_reason")


SUPPLIER_STATUS = """select document_id, case when count(degraded_reason) = 0 then 'SUCCESS' else 'DEGRADED' end as status,
      count(*) as total, count(degraded_reason) as degraded from sx group by document_id"""


@query("su8_supplier_status", SUPPLIER_VIEWS, f"with {SUPPLIER_FACTS} select document_id, status, degraded > 0 as is_degraded from ({SUPPLIER_STATUS})")
def _(t):
    return supplier.supplier_role_status(_supplier_facts(t)).select("document_id", "status", "is_degraded")
