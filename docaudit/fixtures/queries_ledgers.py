"""Queries for the rules over ledgers: policy versions, split purchases, contracts, prepayments."""

from __future__ import annotations

from docaudit.fixtures.registry import brief, brief_sql, query
from docaudit.operators import ledgers as L, travel

_IN_FORCE = """days as (select policy_key, effective_from, max(version_no) as version_no from v_policy_versions group by all),
  named as (select policy_key, version_no as used_version, min(effective_from) as used_from from v_policy_versions group by all),
  timed as (
    select u.*, d.version_no, d.effective_from, n.used_from from v_policy_uses u
    asof left join days d on u.policy_key = d.policy_key and u.expense_day >= d.effective_from
    left join named n on n.policy_key = u.policy_key and n.used_version = u.used_version)"""


@query("ma1_policy_in_force", ["v_policy_versions", "v_policy_uses"], f"""
    with {_IN_FORCE} select document_id, line_key, policy_key, used_version, used_from, version_no, effective_from from timed""")
def _(t):
    return L.policies_in_force(t.policy_uses, t.policy_versions).select(
        "document_id", "line_key", "policy_key", "used_version", "used_from", "in_force.version_no", "in_force.effective_from"
    )


@query("ma1_policy_version_mismatch", ["v_policy_versions", "v_policy_uses"], f"with {_IN_FORCE} " + brief_sql(
    "R12_POLICY_VERSION_MISMATCH", "'low'", "line_key", "null", True,
    "from timed where version_no <> used_version and used_from < effective_from"))
def _(t):
    return brief(L.policy_version_mismatch(t.policy_uses, t.policy_versions))


_WINDOWS = """known as (select * from v_expenses where applicant_id is not null and category is not null and expense_day is not null and amount > 0),
  ends as (select distinct applicant_id, category, expense_day as last_day from known),
  windows as (
    select e.applicant_id, e.category, e.last_day, min(k.expense_day) as first_day, cast(sum(k.amount) as decimal(38,2)) as spent, count(*) as n_lines,
      min(k.document_id) <> max(k.document_id) as several, max(case when k.expense_day = e.last_day then k.document_id end) as document_id
    from ends e join known k on k.applicant_id = e.applicant_id and k.category = e.category
      and k.expense_day between e.last_day - 2 and e.last_day group by e.applicant_id, e.category, e.last_day),
  maximal as (
    select * from windows w where several and spent > 3000 and not exists (
      select 1 from ends e where e.applicant_id = w.applicant_id and e.category = w.category and e.last_day > w.last_day and e.last_day - 2 <= w.first_day))"""


@query("ma2_split_windows", ["v_expenses"], f"""
    with {_WINDOWS} select applicant_id, category, first_day, last_day, document_id, spent, n_lines from maximal""")
def _(t):
    return L.split_windows(t.expenses).select("applicant_id", "category", "first_day", "last_day", "document_id", "spent", "n_lines")


@query("ma2_split_purchase", ["v_expenses"], f"with {_WINDOWS} " + brief_sql(
    "R07_SPLIT_PURCHASE", "'high'", "concat_ws('|', applicant_id, category, first_day, last_day)", "spent - 3000", True, "from maximal"))
def _(t):
    return brief(L.split_purchases(t.expenses))


_PAID = """paid as (
    select p.*, c.contract_total, sum(p.amount) over (partition by p.contract_id order by paid_on, document_id, amount nulls first rows unbounded preceding) as paid
    from v_payments p join v_contracts c on p.contract_id = c.contract_id)"""


@query("ma4_contract_ledger", ["v_payments", "v_contracts"], f"""
    with {_PAID} select contract_id, document_id, amount, cast(paid as decimal(38,2)) as paid, contract_total from paid""")
def _(t):
    return L.contract_ledger(t.payments, t.contracts).select("contract_id", "document_id", "amount", "paid", "contract_total")


@query("ma4_contract_overpayment", ["v_payments", "v_contracts"], f"with {_PAID} " + brief_sql(
    "R03_CONTRACT_OVERPAYMENT", "'high'", "concat_ws('|', contract_id, document_id)", "least(amount, paid - contract_total)", False,
    "from paid where amount is not null and paid > contract_total"))
def _(t):
    return brief(L.contract_overpayments(t.payments, t.contracts))


_LEDGER = """entries as (
    select *, 0 as kind from v_advances where amount > 0 union all select *, 1 as kind from v_offsets where amount > 0),
  summed as (
    select *, cast(sum(case when kind = 0 then amount else -amount end) over (partition by account_id order by day, kind, entry_id rows unbounded preceding) as decimal(38,2)) as net
    from entries),
  lost as (
    select *, max(greatest(-net, 0)) over (partition by account_id order by day, kind, entry_id rows unbounded preceding) as after,
      coalesce(max(greatest(-net, 0)) over (partition by account_id order by day, kind, entry_id rows between unbounded preceding and 1 preceding), 0) as before
    from summed),
  ledger as (
    select account_id, day, kind, entry_id, cast(amount as decimal(38,2)) as amount, cast(after - before as decimal(38,2)) as uncovered,
      cast(net + after as decimal(38,2)) as balance from lost)"""
_PARTS = _LEDGER + """,
  parts as (
    select account_id, kind, entry_id, amount - uncovered as part,
      sum(amount - uncovered) over (partition by account_id, kind order by day, entry_id rows unbounded preceding) as hi
    from ledger where amount > uncovered),
  met as (
    select a.account_id, a.entry_id as advance_id, o.entry_id as offset_id, least(a.hi, o.hi) - greatest(a.hi - a.part, o.hi - o.part) as amount
    from parts a join parts o on a.account_id = o.account_id and a.kind = 0 and o.kind = 1 and o.hi - o.part < a.hi and a.hi - a.part < o.hi),
  unused as (
    select a.account_id, a.entry_id as advance_id, cast(null as bigint) as offset_id, a.part - coalesce(sum(m.amount), 0) as amount
    from parts a left join met m on m.account_id = a.account_id and m.advance_id = a.entry_id where a.kind = 0 group by a.account_id, a.entry_id, a.part)"""


@query("ma3_prepayment_ledger", ["v_advances", "v_offsets"], f"with {_LEDGER} select * from ledger")
def _(t):
    return L.prepayment_ledger(t.advances, t.offsets)


@query("ma3_prepayment_allocation", ["v_advances", "v_offsets"], f"""
    with {_PARTS} select account_id, advance_id, offset_id, cast(amount as decimal(38,2)) as amount
    from (select * from met union all select * from unused where amount > 0)""")
def _(t):
    return L.prepayment_allocation(L.prepayment_ledger(t.advances, t.offsets))


@query("ma3_advance_balances", ["v_advances", "v_offsets"], f"""
    with {_PARTS} select u.account_id, u.advance_id as entry_id, l.amount, cast(u.amount as decimal(38,2)) as remaining
    from unused u join ledger l on l.account_id = u.account_id and l.kind = 0 and l.entry_id = u.advance_id""")
def _(t):
    ledger = L.prepayment_ledger(t.advances, t.offsets)
    return L.advance_balances(ledger, L.prepayment_allocation(ledger))


@query("ma3_prepayment_over_offset", ["v_advances", "v_offsets"], f"with {_LEDGER} " + brief_sql(
    "R04_PREPAYMENT_OVER_OFFSET", "'high'", "concat_ws('|', account_id, entry_id)", "uncovered", False,
    "from ledger where kind = 1 and uncovered > 0", doc="entry_id"))
def _(t):
    return brief(L.prepayment_over_offsets(L.prepayment_ledger(t.advances, t.offsets)))


@query("st4_segment_overlap_max", ["v_trips"], "with " + """r as (
      select *, max({'a': arrival_time, 's': segment_id}) over (partition by document_id order by departure_time, segment_id
        rows between unbounded preceding and 1 preceding) as p
      from v_trips where departure_time is not null and arrival_time is not null) """ + brief_sql(
    "R09_TRAVEL_SEGMENT_OVERLAP", "'high'", "p.s || '|' || segment_id", "null", True, "from r where departure_time < p.a"))
def _(t):
    return brief(travel.segment_overlaps(t.trips, prev_max=True))
