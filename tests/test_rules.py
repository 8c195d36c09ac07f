"""Small cases per rule, written as tiny tables."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from docaudit import schemas
from docaudit.functions import geo, scalars as S
from docaudit.operators import amount, invoices as I, policy, supplier, travel
from docaudit.plans import decide, reflect


def table(spark, ddl, *rows):
    names = schemas.names(ddl)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def lines(spark, *rows):
    return table(spark, schemas.LINES, *[{"document_id": 1, "line_no": i, "line_key": f"{i:03d}"} | r for i, r in enumerate(rows, 1)])


def bills(spark, *rows):
    return table(spark, schemas.INVOICES, *[
        {"document_id": 1, "invoice_key": f"{i:03d}"} | {k: D(str(v)) if k.endswith("_amount") and v is not None else v for k, v in r.items()}
        for i, r in enumerate(rows, 1)
    ])


def docs(spark, *rows):
    return table(spark, schemas.DOCUMENTS, *[{"document_id": 1} | r for r in rows])


def codes(df):
    return sorted((r.rule_code[:3], r.risk_level, r.discrepancy_amount) for r in df.collect())


def test_balanced_document_has_no_finding(spark):
    found = amount.amount_findings(
        docs(spark, {"total_amount": D("1000.00")}), lines(spark, {"amount": "600"}, {"amount": "400"}),
        bills(spark, {"total_amount": 600, "untaxed_amount": 566.04, "tax_amount": 33.96},
              {"total_amount": 400, "untaxed_amount": 377.36, "tax_amount": 22.64}),
    )
    assert codes(found) == []


def test_header_line_difference(spark):
    found = amount.header_line_mismatch(docs(spark, {"total_amount": D("1000.00")}), lines(spark, {"amount": "600"}, {"amount": "350"}))
    assert codes(found) == [("R01", "high", D("50.00"))]


def test_manual_change_and_sum_difference(spark):
    found = amount.amount_findings(
        docs(spark, {"total_amount": D("1000.00")}), lines(spark, {"amount": "1000"}),
        bills(spark, {"total_amount": 900, "is_manual_modified": True, "original_extracted_amount": 800}),
    )
    assert codes(found) == [("R02", "high", D("100.00")), ("R07", "medium", None)]


def test_bad_amount_degrades_instead_of_counting_as_zero(spark):
    doc, rows = docs(spark, {"total_amount": D("10.00")}), lines(spark, {"amount": "1,000"}, {"amount": "10"})
    assert codes(amount.header_line_mismatch(doc, rows)) == []
    status = amount.amount_role_status(amount.reconcile(doc, rows, bills(spark))).first()
    assert (status.status, status.reason) == ("DEGRADED", amount.LINES_SKIPPED)


def test_duplicate_inside_compares_with_first(spark):
    same = {"invoice_code": "0110023", "invoice_number": "88889999"}
    found = I.duplicates_inside(bills(spark, same | {"total_amount": 500}, same | {"total_amount": 500}, {"invoice_code": " 0110023 ", "invoice_number": "88889999", "total_amount": 700}))
    changed = sorted((r.subject_key, r.actual_value["is_amount_modified"]) for r in found.collect())
    assert changed == [("002", "false"), ("003", "true")]


def test_duplicate_across_uses_newest_other_active_document(spark):
    key = {"invoice_code": "A", "invoice_number": "1"}
    rows = bills(spark, *[key | {"document_id": d, "total_amount": a} for d, a in ((1, 5), (2, 6), (3, 7), (4, 5))])
    states = docs(spark, *[{"document_id": d, "document_no": f"D{d}", "status": s} for d, s in ((1, "APPROVED"), (2, "REJECTED"), (3, "IN_REVIEW"), (4, "SUBMITTED"))])
    found = I.duplicates_across(I.shared_invoices(rows), I.historical_fingerprints(rows, states))
    got = sorted((r.document_id, r.actual_value["conflict_document_no"], r.actual_value["is_amount_modified"]) for r in found.collect())
    assert got == [(1, "D3", "true"), (2, "D3", "true"), (3, "D1", "true"), (4, "D3", "true")]


def test_duplicate_by_fingerprint(spark):
    rows = bills(spark, {"invoice_code": "A", "invoice_number": "1", "total_amount": 5, "issue_date": "2024-01-01"})
    empty = I.historical_fingerprints(rows, docs(spark, {"status": "DRAFT"}))
    fp = rows.select(S.fingerprint(F.col("invoice_code"), F.col("invoice_number"), F.col("total_amount"), F.col("issue_date")).alias("fingerprint"))
    history = fp.selectExpr("fingerprint", "9L document_id", "'D9' document_no", "'APPROVED' status", "cast(5 as decimal(18,2)) total_amount")
    assert I.duplicates_across(rows, empty, history).count() == 1


@pytest.mark.parametrize("amounts, expected", [
    ((3000, 3000, 3000), [("R10", "medium", D("9000.00"))]), ((5000, 5000), []), ((800, 800, 800), []),
    ((1000, 1000, 1500), [("R10", "medium", D("3500.00"))]), ((3000,) * 4, [("R10", "high", D("12000.00"))]),
])
def test_sequential_invoices(spark, amounts, expected):
    rows = bills(spark, *[{"seller_tax_id": "S", "invoice_number": f"No.{10001 + i}", "total_amount": a} for i, a in enumerate(amounts)])
    assert codes(I.sequential_invoices(rows)) == expected


def points(spark, *rows):
    city = {c[1]: c for c in geo.CITIES}
    data = [(1, i, str(i), t, c, city[c][3], city[c][4]) for i, (t, c) in enumerate(rows)]
    return spark.createDataFrame(data, "scope_id long, point_no long, point_id string, t string, city_name string, latitude double, longitude double").withColumn("event_time", F.to_timestamp("t"))


@pytest.mark.parametrize("rows, simultaneous", [
    ([("2024-01-01 09:00:00", "北京"), ("2024-01-01 10:00:00", "上海")], ["false"]),
    ([("2024-01-01 09:00:00", "北京"), ("2024-01-01 11:00:00", "北京")], []),
    ([("2024-01-01 09:00:00", "北京"), ("2024-01-01 09:00:00", "上海")], ["true"]),
    ([("2024-01-01 09:59:00", "北京"), ("2024-01-01 10:01:00", "上海")], ["false"]),
])
def test_point_collisions(spark, rows, simultaneous):
    found = travel.point_collisions(points(spark, *rows)).collect()
    assert [r.actual_value["is_simultaneous"] for r in found] == simultaneous


def segment(spark, **values):
    base = {"document_id": 1, "segment_id": "s1", "departure_city": "北京", "arrival_city": "上海", "dep": "2024-01-01 08:00:00", "arr": "2024-01-01 12:30:00"} | values
    return spark.createDataFrame([base], "document_id long, segment_id string, departure_city string, arrival_city string, dep string, arr string").select(
        "*", F.to_timestamp("dep").alias("departure_time"), F.to_timestamp("arr").alias("arrival_time"),
        F.lit(None).cast("date").alias("travel_date"), F.lit("G1").alias("transport_no"))


def test_travel_rules(spark):
    import datetime

    seg, day = segment(spark), datetime.date(2024, 1, 1)
    stay = lines(spark, {"expense_type": "住宿费", "city_name": "上海市", "start_date": day})
    assert travel.destination_mismatch(seg, stay).count() == 0
    assert travel.hotel_before_arrival(seg, stay).count() == 0
    early = lines(spark, {"expense_type": "住宿费", "city_name": "上海", "start_date": day - datetime.timedelta(1)})
    assert travel.hotel_before_arrival(seg, early).count() == 1
    assert travel.destination_mismatch(seg, lines(spark, {"city_name": "成都"})).count() == 1
    far = points(spark, ("2024-01-01 11:00:00", "广州"))
    near = points(spark, ("2024-01-01 11:00:00", "上海"))
    assert travel.transit_collisions(seg, far).count() == 1
    assert travel.transit_collisions(seg, near).count() == 0
    second = segment(spark, segment_id="s2", dep="2024-01-01 12:00:00", arr="2024-01-02 01:00:00")
    assert travel.segment_overlaps(seg.unionByName(second)).count() == 1


@pytest.mark.parametrize("line, expected", [
    ({"amount": "1400", "city_name": "北京", "stay_nights": "2"}, [("R05", "medium", D("400.00"))]),
    ({"amount": "800", "city_name": "北京", "quantity": "2", "unit": "间"}, [("R05", "high", D("300.00"))]),
    ({"amount": "800", "city_name": "北京", "quantity": "2", "unit": "间夜"}, []),
    ({"amount": "800", "city_name": None}, [("R14", "low", None)]), ({"amount": "800", "city_name": "火星"}, [("R14", "low", None)]),
    ({"amount": "x", "city_name": None}, []),
])
def test_lodging(spark, line, expected):
    assert codes(policy.lodging_findings(lines(spark, {"expense_type": "住宿费"} | line))) == expected


def test_purpose_verdict_and_fallback(spark):
    d = docs(spark, *[{"document_id": i} for i in (1, 2, 3)])
    rows = lines(spark, {"document_id": 2, "item_desc": "KTV 消费"}, {"document_id": 3, "item_desc": "KTV 消费"})
    verdicts = table(spark, schemas.PURPOSE_VERDICTS, {"document_id": 1, "verdict": "no", "source": "LLM_INFERENCE"}, {"document_id": 3, "verdict": "true", "source": "LLM_INFERENCE"})
    facts = {r.document_id: (r.is_rational, r.source) for r in policy.purpose_facts(d, rows, verdicts).collect()}
    assert facts == {1: (False, "LLM_INFERENCE"), 2: (False, "HEURISTIC_RULE"), 3: (True, "LLM_INFERENCE")}


def test_supplier_states(spark):
    d = docs(spark, {"document_type": "CORP_PAYMENT", "title": "设备"})
    inv = bills(spark, {"seller_tax_id": "91110000MA0000001X", "seller_name": "甲"}, {"seller_tax_id": "bad", "seller_name": "乙"})
    profile = table(spark, schemas.SUPPLIERS, {"uscc": "91110000ma0000001x", "supplier_name": "甲", "operating_status": "已注销", "is_dishonest": True, "business_scope": "x"})
    verdicts = table(spark, schemas.SCOPE_VERDICTS, {"document_id": 1, "uscc": "91110000MA0000001X", "verdict": "0", "source": "LLM_INFERENCE"})
    facts = supplier.supplier_facts(d, inv, profile, verdicts)
    found = {(r.rule_code[:3], r.subject_key) for r in supplier.supplier_findings(facts).collect()}
    assert {("R13", "91110000MA0000001X"), ("R15", "91110000MA0000001X"), ("R17", "91110000MA0000001X"), ("R12", "BAD")} <= found
    assert supplier.supplier_role_status(facts).first().status == "DEGRADED"
    failed = spark.createDataFrame([(1, "BAD", "TIMEOUT"), (1, "91110000MA0000001X", "TIMEOUT")], "document_id long, uscc string, error string")
    assert supplier.supplier_role_status(supplier.supplier_facts(d, inv, profile, verdicts, failed)).first().status == "FAILED"


@pytest.mark.parametrize("gap, allowance, evidence, expected", [
    (200, 200, True, ([], ["AUTO_RESOLVED_FULL"])), (200, 200, False, ([D("200.00")], [])),
    (300, 200, True, ([D("100.00")], ["PARTIAL_DEDUCTED"])), (100, 200, True, ([D("100.00")], [])),
])
def test_reflection(spark, gap, allowance, evidence, expected):
    d = docs(spark, {"total_amount": D(gap)})
    found = amount.invoice_sum_mismatch(d, bills(spark, {"total_amount": 0}))
    allowances = reflect.allowance_facts(d, lines(spark, {"expense_type": "出差补贴", "amount": str(allowance), "allowance_verified": evidence}))
    kept = [r.discrepancy_amount for r in reflect.reflect(found, allowances).collect()]
    assert (kept, [r.action for r in reflect.reflection_log(found, allowances).collect()]) == expected


def test_document_flag_must_be_strictly_true(spark):
    d = docs(spark, *[{"document_id": i, "extra_attributes": x} for i, x in enumerate(('{"allowance_verified": true}', '{"allowance_verified": "true"}', '{"is_exempt": true}', "allowance{"))])
    assert [r.document_id for r in reflect.document_evidence(d).collect()] == [0]


@pytest.mark.parametrize("facts, action, nodes", [
    (("600", "low", "COMPLETE", False, False), "MANUAL_REVIEW", 2), (("200", "low", "COMPLETE", False, False), "AUTO_APPROVE", 0),
    (("200", "medium", "COMPLETE", False, False), "MANUAL_REVIEW", 2), (("200", "low", "DEGRADED", False, False), "MANUAL_REVIEW", 2),
    (("200", "low", "INCOMPLETE", True, False), "REJECT", 0), (("200", "high", "COMPLETE", False, False), "MANUAL_REVIEW", 3),
    (("200", "high", "COMPLETE", False, True), "NEED_SUPPLEMENT", 0), (("20000", "low", "COMPLETE", False, False), "MANUAL_REVIEW", 3),
])
def test_decision(spark, facts, action, nodes):
    df = spark.createDataFrame([(D(facts[0]),) + facts[1:] + (True,)],
                               "total_amount decimal(14,2), overall_risk_level string, audit_completeness string, has_veto boolean, invoice_missing boolean, has_report boolean")
    row = decide.decide(df).first()
    assert (row.action, len(row.required_nodes)) == (action, nodes)


@pytest.mark.parametrize("text, city", [
    ("上海陆家嘴", "上海"), ("北京南站", "北京"), ("440100", "广州"), ("上海到北京", "北京"), ("火星", None), ("", None), (" 石家庄市 ", "石家庄"),
])
def test_city_resolution(spark, text, city):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(geo.city_short_name(geo.city_rank(F.col("t")))).first()[0] == city


def test_json_and_boolean_text(spark):
    df = spark.createDataFrame([('x {"a": 1} y',), ('```json\n{"a": 1}\n```',), ("[1]",), (None,), ("{broken",)], "t string")
    assert [r[0] is not None for r in df.select(S.safe_json_object(F.col("t"))).collect()] == [True, True, False, False, False]
    flags = spark.createDataFrame([("Yes",), ("0",), ("maybe",)], "t string").select(S.safe_bool(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, False, None]
