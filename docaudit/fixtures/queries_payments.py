"""Queries for approvals in advance, batch payments and market prices."""

from __future__ import annotations

from docaudit.fixtures.registry import brief, brief_sql, query
from docaudit.operators import approvals as A, batches as B

_USED = """gated as (select * from v_gated_expenses where category in ('招待', '采购') and amount > 2000),
  linked as (
    select g.*, a.valid_from, a.amount as approved,
      case when g.approval_id is null then 'NOT_LINKED' when a.approval_id is null then 'NOT_FOUND' when a.status is distinct from 'APPROVED' then 'NOT_APPROVED'
        when coalesce(a.applicant_id <> g.applicant_id or a.category <> g.category, true) then 'WRONG_HOLDER'
        when coalesce(g.expense_day not between a.valid_from and a.valid_to, true) then 'NOT_VALID' end as reason
    from gated g left join v_pre_approvals a on a.approval_id = g.approval_id),
  summed as (
    select *, sum(amount) over (partition by approval_id order by expense_day, document_id, line_key, amount rows unbounded preceding) - coalesce(approved, 0) as beyond
    from linked where reason is null),
  judged as (
    select document_id, line_key, applicant_id, category, expense_day, amount, approval_id, case when beyond > 0 then 'EXHAUSTED' end as reason,
      greatest(least(beyond, amount), 0) as uncovered from summed
    union all select document_id, line_key, applicant_id, category, expense_day, amount, approval_id, reason, amount from linked where reason is not null),
  days as (select distinct applicant_id, category, expense_day from judged where reason is not null),
  fitting as (
    select d.applicant_id, d.category, d.expense_day, arg_min(a.approval_id, (a.valid_to, a.approval_id)) as candidate_id
    from days d join v_pre_approvals a on a.applicant_id = d.applicant_id and a.category = d.category and d.expense_day between a.valid_from and a.valid_to
    where a.status = 'APPROVED' group by all),
  used as (
    select j.*, f.candidate_id from judged j left join fitting f
      on j.reason is not null and f.applicant_id = j.applicant_id and f.category = j.category and f.expense_day = j.expense_day)"""


@query("ma5_approval_use", ["v_gated_expenses", "v_pre_approvals"], f"""
    with {_USED} select document_id, line_key, approval_id, reason, cast(uncovered as decimal(38,2)) as uncovered, candidate_id from used""")
def _(t):
    return A.approval_use(t.gated_expenses, t.pre_approvals).select("document_id", "line_key", "approval_id", "reason", "uncovered", "candidate_id")


@query("ma5_missing_pre_approval", ["v_gated_expenses", "v_pre_approvals"], f"with {_USED} " + brief_sql(
    "R10_MISSING_PRE_APPROVAL", "'high'", "line_key", "uncovered", False, "from used where reason is not null"))
def _(t):
    return brief(A.missing_pre_approvals(A.approval_use(t.gated_expenses, t.pre_approvals)))


_PAYMENTS = r"""payments as (
    select document_id, nullif(regexp_replace(account_no, '\s', '', 'g'), '') as account_no, nullif(upper(trim(payee_name)), '') as name, amount from v_batch_payments),
  headed as (
    select b.document_id, b.total_amount, b.declared_count, coalesce(sum(p.amount), 0) as paid, count(p.document_id) as n
    from v_batches b left join payments p on p.document_id = b.document_id group by all),
  uses as (select document_id, account_no, sum(amount) as amount, count(*) as n from payments where account_no is not null group by all),
  shared as (select account_no from payments where account_no is not null group by all having count(distinct name) > 1)"""


@query("ma6_payee_facts", ["v_batch_payments"], r"""
    with payments as (
      select document_id, nullif(regexp_replace(account_no, '\s', '', 'g'), '') as account_no, nullif(upper(trim(payee_name)), '') as name, amount from v_batch_payments),
    facts as (
      select document_id, null as account_no, 'batch' as level, amount, name from payments union all
      select document_id, account_no, 'use', amount, name from payments union all select null, account_no, 'account', amount, name from payments)
    select document_id, account_no, level, cast(sum(amount) as decimal(38,2)) as amount, count(*) as n, min(name) as low_name, max(name) as high_name from facts
    group by document_id, account_no, level""")
def _(t):
    return B.payee_facts(t.batch_payments)


@query("ma6_batch_findings", ["v_batch_payments", "v_batches"], f"with {_PAYMENTS} " + " union all ".join([
    brief_sql("R04_BATCH_TOTAL_MISMATCH", "'high'", "document_id", "abs(paid - total_amount)", False, "from headed where paid <> total_amount"),
    brief_sql("R04_BATCH_COUNT_MISMATCH", "'high'", "document_id", "null", False, "from headed where n <> declared_count"),
    brief_sql("R04_REPEATED_ACCOUNT", "'medium'", "concat_ws('|', document_id, account_no)", "amount", True, "from uses where n > 1"),
    brief_sql("R04_SHARED_ACCOUNT", "'medium'", "concat_ws('|', document_id, account_no)", "amount", True, "from uses where account_no in (select account_no from shared)"),
]))
def _(t):
    return brief(B.batch_findings(t.batches, t.batch_payments))


PERIOD = ("1993-01-01", "1997-12-31")
_MARKET = f"""known as (
    select item_key, unit_price from v_purchases where item_key is not null and unit_price > 0 and day between date '{PERIOD[0]}' and date '{PERIOD[1]}'),
  ranked as (
    select item_key, unit_price, count(*) over (partition by item_key order by unit_price range unbounded preceding) as upto, count(*) over (partition by item_key) as n_purchases from known),
  market as (select item_key, min(unit_price) filter (where upto * 100 >= n_purchases * 90) as upper_price, any_value(n_purchases) as n_purchases from ranked group by item_key)"""


@query("ma7_price_benchmarks", ["v_purchases"], f"with {_MARKET} select item_key, upper_price, n_purchases from market")
def _(t):
    return B.price_benchmarks(B.price_counts(t.purchases), *PERIOD)


@query("ma7_price_deviation", ["v_purchases"], f"with {_MARKET} " + brief_sql(
    "R06_MARKET_PRICE_DEVIATION", "case when (unit_price - upper_price) * 100 > upper_price * 30 then 'high' else 'medium' end", "line_key",
    "unit_price - upper_price", True,
    "from v_purchases join market using (item_key) where n_purchases >= 10 and (unit_price - upper_price) * 100 > upper_price * 10"))
def _(t):
    return brief(B.price_deviations(t.purchases, B.price_benchmarks(B.price_counts(t.purchases), *PERIOD)))
