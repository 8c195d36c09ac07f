"""Approvals in advance, batch payments and market prices against row-by-row folds, with a key that holds most rows."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest

from docaudit.functions.intervals import LEVELS, stab
from docaudit.operators import approvals as A, batches as B

CUT = pytest.mark.parametrize("hot_rows", [5, 10**6])


def test_the_least_interval_that_holds_a_point(spark):
    rng = random.Random(8)
    place = lambda: rng.choice([None, rng.randint(-70, 70), rng.randint(-9000, 9000), rng.choice([-1, 0, 1, 2**LEVELS, -(2**LEVELS)])])
    key = lambda: rng.choice(["hot"] * 8 + ["a", None])
    points = [(key(), place(), i) for i in range(400)]
    intervals = []
    for i in range(300):
        low = place()
        high = None if low is None else rng.choice([None, low - 1, low, low + 1, low + rng.randint(0, 40), low + rng.randint(0, 20000)])
        intervals.append((key(), low, high, rng.randint(0, 20), i))
    got = stab(
        spark.createDataFrame(points, "k string, at int, i int"), spark.createDataFrame(intervals, "k string, low int, high int, rank int, id int"),
        ["k"], "at", "low", "high", ["rank", "id"],
    )
    assert got.columns == ["k", "at", "i", "found"]
    fits = lambda p, v: None not in (p[0], p[1], v[1], v[2]) and p[0] == v[0] and v[1] <= p[1] <= v[2]
    expected = {p[2]: min(((v[3], v[4]) for v in intervals if fits(p, v)), default=None) for p in points}
    assert {r["i"]: r["found"] and tuple(r["found"]) for r in got.collect()} == expected and len(expected) == 400
    assert sum(v is None for v in expected.values()) > 20


def test_intervals_are_cut_into_few_blocks(spark):
    longest = spark.createDataFrame([("k", 1, 2 * 2**LEVELS - 2, 0)], "k string, low int, high int, id int")
    points = spark.createDataFrame([("k", 0), ("k", 1), ("k", 2 * 2**LEVELS - 2), ("k", 2 * 2**LEVELS - 1)], "k string, at int")
    assert sorted((r["at"], r["found"] is not None) for r in stab(points, longest, ["k"], "at", "low", "high", ["id"]).collect()) == [
        (0, False), (1, True), (2 * 2**LEVELS - 2, True), (2 * 2**LEVELS - 1, False)]


@CUT
def test_approvals_by_fold(spark, hot_rows):
    rng = random.Random(3)
    start = date(2024, 1, 1)
    day = lambda: rng.choice([None, *[start + timedelta(rng.randint(0, 60))] * 12])
    who, kind = (lambda: rng.choice([None, *[1] * 8, 2])), (lambda: rng.choice([None, *["招待"] * 6, "采购", "办公"]))
    approvals = []
    for i in range(40):
        low = day()
        amount = Decimal(10**6) if i == 0 else rng.choice([None, Decimal(rng.randint(0, 9000))])
        approvals.append((i, 1 if i == 0 else who(), "招待" if i == 0 else kind(), start if i == 0 else low, start + timedelta(55) if i == 0 else (low and low + timedelta(rng.randint(-2, 40))),
                          amount, rng.choice([None, "REJECTED", *["APPROVED"] * 8]) if i else "APPROVED"))
    expenses = [
        (n, f"l{n % 3}", who(), kind(), day(), rng.choice([None, Decimal(2000), *[Decimal(rng.randint(1500, 9000))] * 8]), rng.choice([None, 99, *[0] * 6, *range(1, 12)]))
        for n in range(260)
    ]
    got = A.approval_use(
        spark.createDataFrame(expenses, "document_id long, line_key string, applicant_id long, category string, expense_day date, amount decimal(14,2), approval_id long"),
        spark.createDataFrame(approvals, "approval_id long, applicant_id long, category string, valid_from date, valid_to date, amount decimal(14,2), status string"),
        hot_rows=hot_rows,
    )
    known, used, expected = {a[0]: a for a in approvals}, defaultdict(Decimal), {}
    valid = lambda a, at: None not in (at, a[3], a[4]) and a[3] <= at <= a[4]
    for n, _, person, category, at, amount, link in sorted((e for e in expenses if e[3] in ("招待", "采购") and e[5] and e[5] > 2000), key=lambda e: (e[4] or date.min, e[0])):
        a, uncovered = known.get(link), amount
        if link is None:
            reason = "NOT_LINKED"
        elif a is None:
            reason = "NOT_FOUND"
        elif a[6] != "APPROVED":
            reason = "NOT_APPROVED"
        elif person is None or (a[1], a[2]) != (person, category):
            reason = "WRONG_HOLDER"
        elif not valid(a, at):
            reason = "NOT_VALID"
        else:
            covered = max(min((a[5] or 0) - used[link], amount), Decimal(0))
            used[link] += amount
            uncovered, reason = amount - covered, None if covered == amount else "EXHAUSTED"
        fitting = [(b[4], b[0]) for b in approvals if b[6] == "APPROVED" and person is not None and (b[1], b[2]) == (person, category) and valid(b, at)]
        expected[n] = (reason, uncovered, min(fitting)[1] if reason and fitting else None)
    rows = got.collect()
    assert {r["document_id"]: (r["reason"], r["uncovered"], r["candidate_id"]) for r in rows} == expected and len(rows) == len(expected)
    assert set(Counter(e[0] for e in expected.values())) == {None, "NOT_LINKED", "NOT_FOUND", "NOT_APPROVED", "WRONG_HOLDER", "NOT_VALID", "EXHAUSTED"}
    found = A.missing_pre_approvals(got)
    assert found.count() == sum(e[0] is not None for e in expected.values())
    assert found.where("rule_code <> 'R10_MISSING_PRE_APPROVAL' or risk_level <> 'high' or is_overridable").count() == 0


def test_batches(spark):
    pay = lambda rows: spark.createDataFrame(rows, "document_id long, account_no string, payee_name string, amount decimal(14,2)")
    rows = [
        (1, "A1", "Ann", Decimal(10)), (1, "A 1", " ann ", Decimal(5)), (1, "B", "Bob", None),  # A1 twice, one unknown amount
        (2, "B", "Ben", Decimal(7)), (2, None, "Ann", Decimal(1)), (2, " ", "x", Decimal(1)),  # B is Bob's and Ben's
        (3, "C", None, Decimal(3)), (3, "D", "Dan", Decimal(4)), (9, "C", "Cy", Decimal(2)), (None, "D", "dan", Decimal(2)),
    ]
    heads = [(1, Decimal(15), 3), (2, Decimal(8), 3), (3, Decimal(7), 1), (4, Decimal(0), 0), (5, Decimal(2), None), (6, None, 2)]
    batches = spark.createDataFrame(heads, "document_id long, total_amount decimal(14,2), declared_count long")
    got = sorted((r["document_id"], r["rule_code"][4:], r["subject_key"], r["discrepancy_amount"]) for r in B.batch_findings(batches, pay(rows)).collect())
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([
        (1, "REPEATED_ACCOUNT", "1|A1", Decimal(15)), (1, "SHARED_ACCOUNT", "1|B", None), (2, "SHARED_ACCOUNT", "2|B", Decimal(7)),
        (2, "BATCH_TOTAL_MISMATCH", "2", Decimal(1)), (3, "BATCH_COUNT_MISMATCH", "3", None), (5, "BATCH_TOTAL_MISMATCH", "5", Decimal(2)),
        (6, "BATCH_COUNT_MISMATCH", "6", None),
    ], key=key)
    assert B.batch_findings(batches.where("false"), pay([])).count() == 0


@CUT
def test_market_prices_are_exact(spark, hot_rows):
    rng = random.Random(6)
    rows = [
        (n, "l", rng.choice([None, *["hot"] * 8, "few"]), rng.choice([None, *[date(2024, 1, rng.randint(1, 31))] * 9]), rng.choice([None, Decimal(0), *[Decimal(rng.randint(80, 140))] * 9]))
        for n in range(400)
    ] + [(n, "l", "ten", date(2024, 1, 5), Decimal(price)) for n, price in enumerate([100] * 9 + [200], 1000)]
    purchases = spark.createDataFrame(rows, "document_id long, line_key string, item_key string, day date, unit_price decimal(14,2)")
    counts = B.price_counts(purchases)
    # Tables of two periods give what one of both gives.
    parts = B.price_counts(purchases.where("document_id % 2 = 0")).unionByName(B.price_counts(purchases.where("document_id % 2 = 1")))
    market = lambda c: {r["item_key"]: (r["upper_price"], r["n_purchases"]) for r in B.price_benchmarks(c, "2024-01-03", "2024-01-28", hot_rows=hot_rows).collect()}
    known = defaultdict(list)
    for _, _, item, day, price in rows:
        if item and day and price and date(2024, 1, 3) <= day <= date(2024, 1, 28):
            known[item].append(price)
    expected = {item: (sorted(p)[(len(p) * 90 + 99) // 100 - 1], len(p)) for item, p in known.items()}
    assert market(counts) == market(parts) == expected and expected["ten"][0] == 100
    found = {
        r["document_id"]: (r["risk_level"], r["discrepancy_amount"])
        for r in B.price_deviations(purchases, B.price_benchmarks(counts, "2024-01-03", "2024-01-28", hot_rows=hot_rows)).collect()
    }
    over = {n: (price, expected[item][0]) for n, _, item, _, price in rows if item in expected and expected[item][1] >= 10 and price}
    assert found == {n: ("high" if (p - u) * 100 > u * 30 else "medium", p - u) for n, (p, u) in over.items() if (p - u) * 100 > u * 10}
    assert found[1009] == ("high", Decimal(100))
