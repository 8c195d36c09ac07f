"""Rules over ledgers against row-by-row folds, with one key that holds most rows, whole and cut into pieces."""

import random
from collections import defaultdict, deque
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docaudit.operators import ledgers as L, travel

DAY = date(2024, 1, 1)
CUT = pytest.mark.parametrize("hot_rows", [5, 10**6])


def money(rng, low=1, high=90_000):
    return Decimal(rng.randint(low, high)) / 100


def account(rng):
    return rng.choice(["hot"] * 9 + ["a", "b", None])


def fold(advances, offsets):
    """The queue of advances of every account, one entry at a time."""
    entries = [(*a, L.ADVANCE) for a in advances] + [(*o, L.OFFSET) for o in offsets]
    entries = sorted((e for e in entries if e[0] and e[1] is not None and e[3] is not None and e[3] > 0), key=lambda e: (e[0], e[1], e[4], e[2]))
    queues, ledger, paid = defaultdict(deque), [], []
    for who, day, entry, amount, kind in entries:
        queue = queues[who]
        if kind == L.ADVANCE:
            queue.append([entry, amount])
            ledger.append((who, kind, entry, Decimal(0), sum(left for _, left in queue)))
            continue
        rest = amount
        while rest and queue:
            part = min(rest, queue[0][1])
            paid.append((who, queue[0][0], entry, part))
            queue[0][1] -= part
            rest -= part
            if not queue[0][1]:
                queue.popleft()
        ledger.append((who, kind, entry, rest, sum(left for _, left in queue)))
    paid += [(who, entry, None, left) for who, queue in queues.items() for entry, left in queue]
    return ledger, paid


@CUT
def test_prepayments_by_fold(spark, hot_rows):
    rng = random.Random(4)
    advances = [(account(rng), DAY + timedelta(rng.randint(0, 20)), 1000 + i, rng.choice([None, Decimal(0), *[money(rng)] * 8])) for i in range(120)]
    offsets = [(account(rng), rng.choice([None, *[DAY + timedelta(rng.randint(0, 20))] * 9]), 5000 + i, rng.choice([None, *[money(rng)] * 8])) for i in range(130)]
    schema = "account_id string, day date, entry_id long, amount decimal(14,2)"
    ledger = L.prepayment_ledger(spark.createDataFrame(advances, schema), spark.createDataFrame(offsets, schema), hot_rows)
    expected, paid = fold(advances, offsets)
    key = lambda r: tuple(map(str, r))
    got = [(r["account_id"], r["kind"], r["entry_id"], r["uncovered"], r["balance"]) for r in ledger.collect()]
    assert sorted(got, key=key) == sorted([(*e[:3], e[3].quantize(Decimal("0.01")), Decimal(e[4]).quantize(Decimal("0.01"))) for e in expected], key=key)
    allocation = L.prepayment_allocation(ledger, hot_rows)
    assert sorted((tuple(r) for r in allocation.collect()), key=key) == sorted(paid, key=key)
    left = {(r["account_id"], r["entry_id"]): r["remaining"] for r in L.advance_balances(ledger, allocation).collect()}
    open_ = {(who, entry): part for who, entry, offset, part in paid if offset is None}
    assert left == {(who, entry): open_.get((who, entry), Decimal("0.00")) for who, kind, entry, *_ in expected if kind == L.ADVANCE}
    over = {r["document_id"]: r["discrepancy_amount"] for r in L.prepayment_over_offsets(ledger).collect()}
    assert over == {e[2]: e[3] for e in expected if e[3] > 0} and over


@CUT
def test_contract_payments_by_fold(spark, hot_rows):
    rng = random.Random(5)
    payments = [(account(rng), DAY + timedelta(rng.randint(0, 9)), i, rng.choice([None, *[money(rng, -2000)] * 9])) for i in range(300)]
    totals = {"hot": Decimal("40000.00"), "a": None, "b": Decimal("0.00")}
    found = L.contract_overpayments(
        spark.createDataFrame(payments, "contract_id string, paid_on date, document_id long, amount decimal(14,2)"),
        spark.createDataFrame(list(totals.items()), "contract_id string, contract_total decimal(14,2)"), hot_rows,
    )
    paid, want = defaultdict(Decimal), []
    for who, day, doc, amount in sorted((p for p in payments if p[0]), key=lambda p: (p[0], p[1], p[2])):
        before = paid[who]
        paid[who] += amount or 0
        if amount is not None and totals[who] is not None and paid[who] > totals[who]:
            want.append((doc, min(amount, paid[who] - totals[who]), str(before <= totals[who]).lower()))
    assert sorted((r["document_id"], r["discrepancy_amount"], r["actual_value"]["first_crossing"]) for r in found.collect()) == sorted(want) and want


def test_contract_example(spark):
    """Total 100,000, paid 80,000, claimed 30,000: 10,000 too much."""
    payments = spark.createDataFrame([("k", DAY, 1, Decimal(80000)), ("k", DAY, 2, Decimal(30000))], "contract_id string, paid_on date, document_id long, amount decimal(14,2)")
    found = L.contract_overpayments(payments, spark.createDataFrame([("k", Decimal(100000))], "contract_id string, contract_total decimal(14,2)")).collect()
    assert [(r["document_id"], r["rule_code"], r["discrepancy_amount"]) for r in found] == [(2, "R03_CONTRACT_OVERPAYMENT", Decimal("10000.00"))]


def test_prepayment_example(spark):
    """Balance 5,000, offset 6,000: 1,000 too much; a later advance does not pay it."""
    schema = "account_id string, day date, entry_id long, amount decimal(14,2)"
    advances = spark.createDataFrame([("k", DAY, 1, Decimal(5000)), ("k", DAY + timedelta(9), 3, Decimal(700))], schema)
    ledger = L.prepayment_ledger(advances, spark.createDataFrame([("k", DAY, 2, Decimal(6000))], schema))
    assert [(r["document_id"], r["rule_code"], r["discrepancy_amount"]) for r in L.prepayment_over_offsets(ledger).collect()] == [(2, "R04_PREPAYMENT_OVER_OFFSET", Decimal("1000.00"))]
    assert {(r["entry_id"], r["balance"]) for r in ledger.collect()} == {(1, Decimal(5000)), (2, Decimal(0)), (3, Decimal(700))}


def test_split_purchases_by_definition(spark):
    rng = random.Random(6)
    rows = [
        (rng.randrange(40), rng.choice([1, 1, 1, 1, 2, None]), rng.choice(["采购", "采购", "招待", None]), rng.choice([None, *[DAY + timedelta(rng.randrange(40))] * 9]),
         rng.choice([None, Decimal(-500), *[money(rng, 1, 120_000)] * 8]))
        for _ in range(160)
    ]
    rows += [(900, 9, "采购", DAY, Decimal(9000)), (901, 8, "采购", DAY, Decimal(2000)), (902, 8, "采购", DAY + timedelta(3), Decimal(2000)), (903, 7, "采购", DAY, Decimal(1500)), (904, 7, "采购", DAY + timedelta(2), Decimal("1500.01"))]
    found = L.split_windows(spark.createDataFrame(rows, "document_id long, applicant_id long, category string, expense_day date, amount decimal(14,2)"))
    good = [r for r in rows if None not in r and r[4] > 0]
    windows = {}
    for doc, who, what, day, _ in good:
        held = [r for r in good if r[1:3] == (who, what) and day - timedelta(2) <= r[3] <= day]
        if sum(r[4] for r in held) > 3000 and len({r[0] for r in held}) > 1:
            windows[who, what, day] = (min(r[3] for r in held), sum(r[4] for r in held), len(held), max(r[0] for r in held if r[3] == day))
    sets = {k: frozenset(i for i, r in enumerate(good) if r[1:3] == k[:2] and k[2] - timedelta(2) <= r[3] <= k[2]) for k in windows}
    want = [(k[0], k[1], v[0], k[2], v[3], v[1], v[2]) for k, v in windows.items() if not any(sets[k] < other for other in sets.values())]
    got = found.select("applicant_id", "category", "first_day", "last_day", "document_id", "spent", "n_lines").collect()
    assert sorted(map(tuple, got)) == sorted(want) and (7, "采购") in {w[:2] for w in want} and not {8, 9} & {w[0] for w in want}


@CUT
def test_policy_versions_by_definition(spark, hot_rows):
    rng = random.Random(9)
    versions = [(rng.choice([0, 0, 0, 1, 2]), v, DAY + timedelta(rng.randrange(60))) for v in range(40)]
    uses = [(i, f"l{i}", rng.choice([0] * 9 + [1, 5]), rng.randrange(45), rng.choice([None, DAY + timedelta(rng.randrange(-5, 70))])) for i in range(400)]
    found = L.policy_version_mismatch(
        spark.createDataFrame(uses, "document_id long, line_key string, policy_key long, used_version long, expense_day date"),
        spark.createDataFrame(versions, "policy_key long, version_no long, effective_from date"), hot_rows,
    )
    want = []
    for doc, line, policy, used, day in uses:
        fits = [(start, v) for k, v, start in versions if k == policy and day is not None and start <= day]
        own = [start for k, v, start in versions if (k, v) == (policy, used)]
        if fits and own and max(fits)[1] != used and min(own) < max(fits)[0]:
            want.append((doc, line))
    assert sorted((r["document_id"], r["subject_key"]) for r in found.collect()) == sorted(want) and want


@CUT
def test_running_maximum_of_arrivals(spark, hot_rows):
    """A short trip inside a long one must not hide the overlap of the next."""
    rng = random.Random(10)
    rows = [(rng.choice([1] * 8 + [2]), f"s{i:03d}", rng.randrange(300), rng.randrange(1, 50)) for i in range(200)] + [(3, "s1", 0, 100), (3, "s2", 10, 5), (3, "s3", 50, 5)]
    df = spark.createDataFrame(rows, "document_id long, segment_id string, a long, n long").select(
        "document_id", "segment_id", F.timestamp_seconds(F.col("a") * 60).alias("departure_time"), F.timestamp_seconds((F.col("a") + F.col("n")) * 60).alias("arrival_time"), F.lit("G1").alias("transport_no"))
    for prev_max in (False, True):
        want = []
        for doc in (1, 2, 3):
            trips = sorted((a, s, a + n) for d, s, a, n in rows if d == doc)
            for i in range(1, len(trips)):
                end, name = max((t[2], t[1]) for t in trips[:i]) if prev_max else (trips[i - 1][2], trips[i - 1][1])
                if trips[i][0] < end:
                    want.append((doc, f"{name}|{trips[i][1]}"))
        got = travel.segment_overlaps(df, prev_max, hot_rows).collect()
        assert sorted((r["document_id"], r["subject_key"]) for r in got) == sorted(want)
        assert ((3, "s1|s3") in want) == prev_max
