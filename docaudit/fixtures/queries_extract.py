"""Queries for field extraction over the token views."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.fixtures.oracle_parts import city_map
from docaudit.fixtures.registry import query
from docaudit.fixtures.views import capital_digit
from docaudit.functions.scalars import fraction_box
from docaudit.operators import extract as E, tickets as K

# A token of the view holds at most one amount, and no other digits before it (a date with dots begins like an amount).
_M = r"""m as materialized (select file_id, token_idx, text, confidence, regexp_matches(text, '价税合计|小写|总计') as lt, regexp_matches(text, '合计|金额|不含税') as lu,
      cast(cast(replace(regexp_extract(text, '([0-9][0-9,]*(\.[0-9]{2})?)', 1), ',', '') as decimal(20,2)) * 100 as bigint) as cents
      from v_tokens where regexp_matches(text, '[0-9]\.[0-9]{2}($|[^0-9])|¥[0-9]|[0-9]元'))"""
_R = r"""rt as materialized (select file_id, token_idx * 2 as idx, confidence, cast(cast(regexp_extract(text, '([0-9]{1,2}(\.[0-9]{1,2})?)\s*%', 1) as decimal(6,2)) / 100 as decimal(8,4)) as rate
      from v_tokens where regexp_matches(text, '[0-9]\s*%') union all
      select file_id, token_idx * 2 + 1, confidence, cast(0 as decimal(8,4)) from v_tokens where contains(text, '免税') or contains(text, '不征税'))"""
_D = r"""dt as materialized (select file_id, token_idx, case when xmin > 780 then 'tax' else 'amount' end as kind,
      cast(cast(regexp_extract(text, '([0-9]+\.[0-9]{2})', 1) as decimal(20,2)) * 100 as bigint) as cents
      from v_tokens where regexp_full_match(text, '[¥￥]?\s*[0-9]+\.[0-9]{2}') and ymin between 260 and 720 and xmin > 550)"""
_ONE, _TWO, _THREE = (capital_digit("o_orderkey", n) for n in (1, 2, 3))
_C = f"""cap as materialized (select o_orderkey as file_id, cast(case o_orderkey % 4 when 0 then ({_ONE} * 10000 + {_TWO} * 1000 + {_THREE} * 100) * 100
      when 1 then ({_ONE} * 100000000 + {_TWO} * 10000000 + {_THREE}) * cast(100 as bigint) when 2 then ({_ONE} * 10 + {_TWO}) * 100 + {_THREE} * 10 + {_ONE}
      else ({_ONE} * 100 + {_TWO}) * 100 end as bigint) as capital from orders where o_orderkey % 3 = 0)"""
_TRIPLES = f"""{_M}, {_R}, {_D}, {_C},
    dl as materialized (select file_id, coalesce(list(cents) filter (where kind = 'amount'), []) as amts, coalesce(list(cents) filter (where kind = 'tax'), []) as txs from dt group by 1),
    rl as materialized (select file_id, list(rate order by idx) as rates from rt group by 1),
    pairs as materialized (select a.file_id, a.token_idx as i, b.token_idx as j, a.cents as u, b.cents as x, a.confidence as uc, b.confidence as xc, a.lu,
      unnest([a.cents + b.cents - 1, a.cents + b.cents, a.cents + b.cents + 1]) as want
      from m a join m b on b.file_id = a.file_id where b.token_idx <> a.token_idx),
    found as materialized (select p.file_id, p.i, p.j, c.token_idx as k, p.u, p.x, c.cents as t, p.uc, p.xc, c.confidence as tc, c.lt, p.lu
      from pairs p join m c on c.file_id = p.file_id and c.cents = p.want where c.token_idx <> p.i and c.token_idx <> p.j),
    t0 as materialized (select f.*, round_even(f.x::double / f.u, 4) as ratio,
      list_filter(coalesce(dl.amts, []), lambda z: z <> f.u and z <> f.t) as la, list_filter(coalesce(dl.txs, []), lambda z: z <> f.x and z <> f.t) as lx,
      coalesce(rl.rates, []) as rates, coalesce(abs(f.t - cap.capital) <= 1, false) as capok
      from found f left join dl on dl.file_id = f.file_id left join rl on rl.file_id = f.file_id left join cap on cap.file_id = f.file_id),
    t1 as (select *, coalesce(len(la) > 0 and abs(u - list_sum(la)) <= 1, false) as aok, coalesce(len(lx) > 0 and abs(x - list_sum(lx)) <= 1, false) as xok,
      list_filter(rates, lambda r: abs(ratio - r) <= 0.005)[1] as printed from t0),
    t2 as (select *, case when aok then 10 else 0 end + case when xok then 10 else 0 end + case when printed is not null then 10 else 0 end + case when capok then 15 else 0 end
      + case when lt then 5 else 0 end + case when lu then 3 else 0 end as score from t1),
    best as materialized (select * from (select *, row_number() over (partition by file_id order by score desc, i, j, k) as rn from t2) where rn = 1)"""
_RATE = "cast(coalesce(case when printed <> 0 then printed end, ratio) as decimal(18,4))"
_FALL = """fm as materialized (select m.*, cap.capital from m left join cap using (file_id) where not exists (select 1 from best where best.file_id = m.file_id)),
    ft as materialized (select file_id, coalesce(arg_min(token_idx, token_idx) filter (where lt), arg_min(token_idx, token_idx) filter (where abs(cents - capital) <= 1),
      arg_min(token_idx, (-cents, token_idx))) as ti, max(capital) as capital from fm group by 1),
    fb as materialized (select f.*, ft.capital as cap2, tt.cents as t, tt.confidence as tc from fm f join ft using (file_id) join m tt on tt.file_id = f.file_id and tt.token_idx = ft.ti),
    fx as materialized (select file_id, min(token_idx) as xi from fb where contains(text, '税额') and cents < t group by 1),
    fu as materialized (select fb.file_id, min(token_idx) as ui from fb left join fx using (file_id) where lu and cents < t and token_idx is distinct from xi group by 1),
    fr as materialized (select file_id, arg_min(rate, idx) as rate, arg_min(confidence, idx) as rc from rt group by 1),
    fall as materialized (select ft.file_id, tt.cents as t, tt.confidence as tc, coalesce(abs(tt.cents - ft.capital) <= 1, false) as sure, mx.cents as x0, mx.confidence as xc0, mu.cents as u0, mu.confidence as uc0, fr.rate, fr.rc
      from ft join m tt on tt.file_id = ft.file_id and tt.token_idx = ft.ti left join fx on fx.file_id = ft.file_id left join m mx on mx.file_id = ft.file_id and mx.token_idx = fx.xi
      left join fu on fu.file_id = ft.file_id left join m mu on mu.file_id = ft.file_id and mu.token_idx = fu.ui left join fr on fr.file_id = ft.file_id),
    amt as materialized (select file_id, t as total_cents, 'CONFIRMED' as total_status, u as untaxed_cents, 'CONFIRMED' as untaxed_status, x as tax_cents, 'CONFIRMED' as tax_status, {RATE} as tax_rate,
        'CONFIRMED' as rate_status, true as eq, aok, xok, {RATE} <> 0 as rok, false as conflict,
        least(1.0, tc + 0.05) as total_conf, least(1.0, uc + 0.05) as untaxed_conf, least(1.0, xc + 0.05) as tax_conf, 0.99::double as rate_conf from best
      union all select file_id, t, case when sure then 'CONFIRMED' else 'UNCERTAIN' end, case when (x0 is null) <> (u0 is null) then coalesce(u0, t - x0) end,
        case when (x0 is null) = (u0 is null) then 'MISSING' when u0 is null then 'DERIVED' else 'CONFIRMED' end,
        case when (x0 is null) <> (u0 is null) then coalesce(x0, t - u0) end, case when (x0 is null) = (u0 is null) then 'MISSING' when x0 is null then 'DERIVED' else 'CONFIRMED' end,
        cast(rate as decimal(18,4)), case when rate is null then 'MISSING' else 'CONFIRMED' end, (x0 is null) <> (u0 is null), false, false, false, x0 is not null and u0 is not null,
        tc, case when (x0 is null) <> (u0 is null) then coalesce(uc0, least(tc, xc0) * 0.9) end, case when (x0 is null) <> (u0 is null) then coalesce(xc0, least(tc, uc0) * 0.9) end, rc from fall)""".replace("{RATE}", _RATE)


def _whole(*names: str):
    """Cents of the views fit a long."""
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query("ex1_money_candidates", ["v_tokens"], f"with {_M} select file_id, token_idx, cents from m")
def _(t):
    return E.money_candidates(t.tokens).select("file_id", "token_idx", F.col("cents").cast("bigint").alias("cents"))


@query("ex2_tax_rates", ["v_tokens"], f"with {_R} select file_id, cast(idx // 2 as int) as token_idx, rate from rt")
def _(t):
    return E.tax_rate_candidates(t.tokens).select(
        "file_id", F.expr("cast(idx div 1000000 as int)").alias("token_idx"), "rate"
    )


_DAY = r"([0-9]{4})\s*[年\-\./]\s*([0-9]{1,2})\s*[月\-\./]\s*([0-9]{1,2})"
_DATE = f"(regexp_extract(text, '{_DAY}', 1) || '-' || lpad(regexp_extract(text, '{_DAY}', 2), 2, '0') || '-' || lpad(regexp_extract(text, '{_DAY}', 3), 2, '0'))"
_DATED = f"regexp_matches(text, '{_DAY}') and cast(regexp_extract(text, '{_DAY}', 1) as int) between 2000 and 2035"


@query("ex3_dates", ["v_tokens"], f"select file_id, token_idx, {_DATE} as issue_date from v_tokens where {_DATED}")
def _(t):
    return E.date_candidates(t.tokens).select("file_id", "token_idx", "issue_date")


@query("ex4_tax_ids", ["v_tokens"], r"""
    select file_id, token_idx, regexp_extract(text, '([0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10})', 1) as tax_id
    from v_tokens where regexp_matches(text, '(^|[^0-9A-Za-z])[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}($|[^0-9A-Za-z])')""")
def _(t):
    return E.tax_id_candidates(t.tokens).select("file_id", "token_idx", "tax_id")


_NUMBERS = r"""nn as (select file_id,
      coalesce(arg_min(regexp_extract(text, '(?:发票号码|No|NO|N0|凭证号|单号)[:：\s\.]*([0-9A-Za-z]{8,20})', 1), token_idx) filter (where regexp_matches(text, '(?:发票号码|No|NO|N0|凭证号|单号)[:：\s\.]*[0-9A-Za-z]{8,20}')),
        arg_min(text, token_idx) filter (where regexp_full_match(text, '[0-9]{8}|[0-9]{20}'))) as number,
      coalesce(arg_min(confidence, token_idx) filter (where regexp_matches(text, '(?:发票号码|No|NO|N0|凭证号|单号)[:：\s\.]*[0-9A-Za-z]{8,20}')),
        arg_min(confidence, token_idx) filter (where regexp_full_match(text, '[0-9]{8}|[0-9]{20}')) * 0.9) as number_conf,
      arg_min(confidence, token_idx) filter (where regexp_matches(text, '发票代码[:：\s]*[0-9]{10,12}')) as c1_conf,
      arg_min(regexp_extract(text, '发票代码[:：\s]*([0-9]{10,12})', 1), token_idx) filter (where regexp_matches(text, '发票代码[:：\s]*[0-9]{10,12}')) as c1 from v_tokens group by 1),
    nc as (select n.file_id, n.number, n.number_conf, coalesce(n.c1_conf, (select arg_min(k.confidence, k.token_idx) * 0.85 from v_tokens k where k.file_id = n.file_id and regexp_full_match(k.text, '[0-9]{10}|[0-9]{12}')
      and k.text is distinct from n.number)) as code_conf, coalesce(n.c1, (select arg_min(k.text, k.token_idx) from v_tokens k where k.file_id = n.file_id and regexp_full_match(k.text, '[0-9]{10}|[0-9]{12}')
      and k.text is distinct from n.number)) as code from nn n)"""


@query("ex5_invoice_numbers", ["v_tokens"], f"with {_NUMBERS} select file_id, number, code from nc")
def _(t):
    return E.invoice_numbers(t.tokens).select("file_id", F.col("number.value").alias("number"), F.col("code.value").alias("code"))


@query("ex6_detail_rows", ["v_tokens"], f"with {_D} select file_id, token_idx, kind, cents from dt")
def _(t):
    return E.detail_rows(t.tokens).withColumn("cents", F.col("cents").cast("bigint"))


@query("ex7_capital_amounts", ["v_tokens"], f"with {_C} select file_id, capital from cap")
def _(t):
    return E.capital_amounts(t.tokens).withColumn("capital", F.col("capital").cast("bigint"))


@query("ex8_amount_triplets", ["v_tokens"], f"""
    with {_TRIPLES} select file_id, score, t as total_cents, u as untaxed_cents, x as tax_cents, {_RATE} as tax_rate, aok as detail_amount_sum_valid, xok as detail_tax_sum_valid from best""")
def _(t):
    tokens = t.stored("tokens")
    money, rates = E.money_candidates(tokens), E.tax_rate_candidates(tokens)
    best = E.amount_triplets(money, rates, E.detail_rows(tokens), E.capital_amounts(tokens))
    return best.select(
        "file_id", "score", *_whole("total_cents", "untaxed_cents", "tax_cents"), "tax_rate", "detail_amount_sum_valid", "detail_tax_sum_valid"
    )


@query("ex9_amount_fallback", ["v_tokens"], f"""
    with {_TRIPLES}, {_FALL} select file_id, total_cents, total_status, untaxed_cents, untaxed_status, tax_cents, tax_status, tax_rate, rate_status, eq as amount_equation_valid, conflict as amount_conflict from amt""")
def _(t):
    return E.amount_fields(t.tokens).select(
        "file_id", "total_status", "untaxed_status", "tax_status", "tax_rate", *_whole("total_cents", "untaxed_cents", "tax_cents"),
        "rate_status", "amount_equation_valid", "amount_conflict",
    )


_NAME = r"(?:名\s*称|单位名称|销售方|购买方)[:：\s]*([^\n\r]+(?:公司|店|部|中心|网|馆|院|局|所|酒店|厂))"
_PARTIES = rf"""tk as (select *, regexp_extract(text, '([0-9A-HJ-NPQRTUWXY]{{2}}[0-9]{{6}}[0-9A-HJ-NPQRTUWXY]{{10}})', 1) as tid,
      trim(regexp_replace(trim(regexp_extract(text, '{_NAME}', 1)), '^(?:名\s*称|单位名称|购买方|销售方|称)[:：\s]*', '')) as nm,
      contains(text, '销售方') or ymin > 600 as sell, contains(text, '购买方') or ymin < 450 as buy from v_tokens),
    pt as (select file_id, arg_min(tid, token_idx) filter (where tid <> '' and sell) as sc, arg_min(tid, token_idx) filter (where tid <> '' and not sell and buy) as bc,
      arg_min(tid, token_idx) filter (where tid <> '') as ac, arg_min(nm, token_idx) filter (where nm <> '' and sell) as sn1, arg_min(nm, token_idx) filter (where nm <> '' and not sell and buy) as bn1,
      arg_min(trim(text), token_idx) filter (where ymin > 600 and regexp_matches(text, '(公司|有限公司|商行|酒店)$')) as sn2,
      arg_min(trim(text), token_idx) filter (where ymin < 450 and regexp_matches(text, '(公司|有限公司|学校)$')) as bn2,
      arg_min(confidence, token_idx) filter (where tid <> '' and sell) as scf, arg_min(confidence, token_idx) filter (where tid <> '' and not sell and buy) as bcf,
      arg_min(confidence, token_idx) filter (where tid <> '') as acf, arg_min(confidence, token_idx) filter (where nm <> '' and sell) as sn1f,
      arg_min(confidence, token_idx) filter (where nm <> '' and not sell and buy) as bn1f,
      arg_min(confidence, token_idx) filter (where ymin > 600 and regexp_matches(text, '(公司|有限公司|商行|酒店)$')) * 0.9 as sn2f,
      arg_min(confidence, token_idx) filter (where ymin < 450 and regexp_matches(text, '(公司|有限公司|学校)$')) * 0.9 as bn2f from tk group by 1),
    pf as (select file_id, coalesce(sn1f, sn2f) as seller_conf, coalesce(bn1f, bn2f) as buyer_conf, coalesce(scf, case when bcf is null then acf end) as seller_code_conf, bcf as buyer_code_conf from pt),
    pa as (select file_id, coalesce(sn1, sn2) as seller_name, coalesce(bn1, bn2) as buyer_name, coalesce(sc, case when bc is null then ac end) as seller_tax_id, bc as buyer_tax_id from pt)"""


@query("ex10_parties", ["v_tokens"], f"with {_PARTIES} select * from pa")
def _(t):
    return E.party_fields(t.tokens).select(
        "file_id", F.col("seller_name.value").alias("seller_name"), F.col("buyer_name.value").alias("buyer_name"),
        F.col("seller_code.value").alias("seller_tax_id"), F.col("buyer_code.value").alias("buyer_tax_id"),
    )


_TYPE = r"""ty as (select file_id, case when bool_or(contains(text, '专用发票')) then '增值税专用发票' when bool_or(regexp_matches(text, '全电|数电')) then '全电增值税普通发票'
      when bool_or(contains(text, '普通发票')) then '增值税普通发票' when bool_or(regexp_matches(text, '客运|车票|火车')) then '铁路电子客票' else '增值税电子普通发票' end as invoice_type,
      bool_or(regexp_matches(text, '住宿|客房|酒店|宾馆|房费')) as k1, bool_or(regexp_matches(text, '客票|车票|运输|火车|高铁|二等座|机票|滴滴|乘车')) as k2,
      bool_or(regexp_matches(text, '餐饮|餐费|外卖|酒楼|饭店|食品|咖啡')) as k3, bool_or(regexp_matches(text, '技术|服务|软件|运维|开发|咨询')) as k4, bool_or(contains(text, '上海')) as sh from v_tokens group by 1)"""
_WORDS = "case {c} when '住宿费' then coalesce(seller_name, '') || ' 住宿' when '交通费' then '商务出行客票' when '餐饮费' then coalesce(seller_name, '') || ' 餐饮消费' " \
    "when '技术服务费' then coalesce(seller_name, '') || ' 技术服务采购' else coalesce(seller_name, '') || ' 采购支出' end"
_CITY = "case when {c} = '住宿费' and (sh or contains(coalesce(seller_name, ''), '上海')) then '上海' else '北京' end"
_CATEGORY = "case when k1 or regexp_matches(coalesce(seller_name,''), '酒店|客栈|宾馆') then '住宿费' when k2 then '交通费' when k3 then '餐饮费' when k4 then '技术服务费' else '办公用品' end"


@query("ex11_invoice_type", ["v_tokens"], f"with {_TYPE} select file_id, invoice_type from ty")
def _(t):
    return E.text_flags(t.tokens).select("file_id", E.invoice_type().alias("invoice_type"))


@query("ex12_expense_category", ["v_tokens"], f"""
    with {_TYPE}, {_PARTIES}, c as (select *, {_CATEGORY} as c from ty join pa using (file_id))
    select file_id, c as expense_type, {_WORDS.format(c='c')} as item_desc, cast(file_id / 100 as decimal(38,2)) as amount, {_CITY.format(c='c')} as city_name from c where file_id > 0""")
def _(t):
    facts = E.flags_and_parties(t.tokens)
    line = E.recommended_line(F.col("file_id").cast("decimal(36,0)"), F.col("seller_name.value"))
    return facts.select("file_id", line.alias("line")).where("line is not null").select("file_id", "line.*")


@query("ex13_train_detection", ["v_tokens", "v_tickets"], r"""
    with a as (select file_id, text from v_tokens union all select -1 - file_id, text from v_tickets)
    select file_id, bool_or(regexp_matches(text, '限乘当日当次车|商务座|特等座|一等座|二等座|高级软卧|软卧|硬卧|动卧|硬座|软座|无座')) and (bool_or(regexp_matches(text, '(^|[^A-Za-z0-9])[GDCKTZ][0-9]{1,4}($|[^A-Za-z0-9])')) or bool_or(contains(text, '站')))
      or (bool_or(regexp_matches(text, '(^|[^A-Za-z0-9])[GDCKTZ][0-9]{1,4}($|[^A-Za-z0-9])')) and bool_or(contains(text, '站')) and bool_or(contains(text, '开')))
      or bool_or(regexp_matches(text, '[GDCKTZ][0-9]{1,4}[·\-\s至到][^\s·至到0-9]+站')) as is_train_ticket from a group by 1""")
def _(t):
    both = t.tokens.unionByName(t.tickets.withColumn("file_id", -1 - F.col("file_id")))
    return K.train_tickets(both)


@query("ex14_train_fields", ["v_tickets"], f"""
    with st as (select file_id, max(text) filter (where token_idx = 1) as s1, max(text) filter (where token_idx = 2) as s2, max(text) filter (where token_idx = 3) as s3,
      max(text) filter (where token_idx = 0) as t0, max(text) filter (where token_idx = 4) as t4, max(text) filter (where token_idx = 5) as t5, max(text) filter (where token_idx = 6) as t6,
      max(text) filter (where token_idx = 7) as t7 from v_tickets group by 1),
    x as (select *, case when file_id % 2 = 0 then regexp_extract(s2, '·(.*)$', 1) end as arr0 from st),
    y as (select *, case when s1 <> coalesce(arr0, '') then s1 end as dep0 from x),
    z as (select *, coalesce(dep0, case when file_id % 2 = 0 then s1 end) as dep, case when file_id % 2 = 0 then arr0 else s3 end as arr from y),
    {city_map('select dep as txt from z union select arr from z')}
    select z.file_id, substr(s2, 1, 5) as train_no, z.dep as departure_station, z.arr as arrival_station, coalesce(a.short_name, replace(z.dep, '站', '')) as departure_city,
      coalesce(b.short_name, replace(z.arr, '站', '')) as arrival_city, replace(replace(replace(substr(t4, 1, 10), '年', '-'), '月', '-'), '日', '') as travel_date,
      replace(replace(substr(t4, 1, 10), '年', '-'), '月', '-') || 'T' || substr(t4, 12, 2) || ':05:00' as departure_time, t6 as seat_type, t0 as ticket_number,
      case when file_id % 2 = 0 then '张三丰' else '李四' end as passenger_name, cast(cast(regexp_extract(t5, '([0-9.]+)', 1) as decimal(20,2)) as decimal(38,2)) as total_amount, 'SUCCESS' as parse_status
    from z left join cmap a on a.txt = z.dep left join cmap b on b.txt = z.arr""")
def _(t):
    return K.parse_tickets(t.tickets)


_PARSE = f"""{_TRIPLES}, {_FALL}, {_NUMBERS}, {_PARTIES}, {_TYPE},
    dd as (select file_id, arg_min({_DATE}, token_idx) as issue_date, arg_min(confidence, token_idx) as issued_conf from v_tokens where {_DATED} group by 1),
    ff as (select c_custkey as file_id from customer union select o_orderkey from orders)"""


@query("ex15_parse_invoices", ["v_tokens"], f"""
    with {_PARSE} select ff.file_id, case when ty.file_id is not null then coalesce(nc.code, 'NONE') end as invoice_code, nc.number as invoice_number, ty.invoice_type,
      cast(total_cents / 100 as decimal(38,2)) as total_amount, cast(untaxed_cents / 100 as decimal(38,2)) as untaxed_amount, cast(tax_cents / 100 as decimal(38,2)) as tax_amount, tax_rate,
      seller_name, seller_tax_id, buyer_name, buyer_tax_id, dd.issue_date, case when ty.file_id is null then 'FAILED' when total_cents is null or number is null then 'NEED_REVIEW' else 'SUCCESS' end as parse_status,
      case when ty.file_id is null then 'OCR_PARSE_FAILED' else concat_ws(',', case when total_cents is null then 'INVOICE_TOTAL_AMOUNT_MISSING' end,
        case when total_cents is not null and coalesce(untaxed_status, 'MISSING') = 'MISSING' and not coalesce(conflict, false) then 'INVOICE_UNTAXED_AMOUNT_MISSING' end,
        case when total_cents is not null and coalesce(tax_status, 'MISSING') = 'MISSING' and not coalesce(conflict, false) then 'INVOICE_TAX_AMOUNT_MISSING' end, case when number is null then 'INVOICE_NUMBER_MISSING' end) end as quality_issues,
      case when total_cents > 0 then {_CATEGORY} end as expense_type, case when total_cents > 0 then {_WORDS.format(c='(' + _CATEGORY + ')')} end as item_desc,
      case when total_cents > 0 then case when {_CATEGORY} = '住宿费' and (sh or contains(coalesce(seller_name, ''), '上海')) then '上海' else '北京' end end as expense_city,
      case when number is not null and total_cents is not null then sha256(coalesce(nc.code, 'NONE') || '#' || number || '#' || cast(cast(total_cents / 100 as decimal(38,2)) as varchar) || '#' || coalesce(dd.issue_date, 'UNKNOWN')) end as invoice_hash
    from ff left join ty using (file_id) left join nc using (file_id) left join amt using (file_id) left join pa using (file_id) left join dd using (file_id)""")
def _(t):
    files = t.source("orders").select(F.col("o_orderkey").alias("file_id")).union(
        t.source("customer").select("c_custkey")
    ).distinct()
    return E.parse_invoices(t.tokens, files).select(
        "file_id", "invoice_code", "invoice_number", "invoice_type", "total_amount", "untaxed_amount", "tax_amount", "tax_rate",
        "seller_name", "seller_tax_id", "buyer_name", "buyer_tax_id", "issue_date", "parse_status", "quality_issues",
        "expense_type", F.col("line.item_desc").alias("item_desc"), "expense_city", "invoice_hash",
    )


@query("ex16_confidence", ["v_tokens"], f"""
    with {_PARSE}, cf as (select ty.file_id, list_filter([total_conf, untaxed_conf, tax_conf, rate_conf, seller_conf, seller_code_conf, buyer_conf, buyer_code_conf, issued_conf, number_conf, code_conf, 0.98::double],
        lambda c: c is not null) as c, total_cents, number
      from ty left join nc using (file_id) left join amt using (file_id) left join pf using (file_id) left join dd using (file_id))
    select file_id, round(cast(cast(list_reduce(c, lambda a, b: a + b) / len(c) as varchar) as decimal(24,20)), 3)::double as confidence,
      case when total_cents is null or number is null then 'NEED_REVIEW' else 'SUCCESS' end as parse_status from cf""")
def _(t):
    return E.parse_invoices(t.tokens).select("file_id", "confidence", "parse_status")


@query("ex17_box_grid", ["v_tokens"], """
    select file_id, token_idx, cast(greatest(0, least(1000, trunc(cast((ymin * 3 - 100) as double) / 2480 * 1000))) as int) as y, cast(greatest(0, least(1000, trunc(cast((xmin * 5) as double) / 3508 * 1000))) as int) as x from v_tokens""")
def _(t):
    return t.tokens.select(
        "file_id", "token_idx",
        fraction_box((F.col("ymin") * 3 - 100).cast("double"), F.lit(2480)).alias("y"),
        fraction_box((F.col("xmin") * 5).cast("double"), F.lit(3508)).alias("x"),
    )
