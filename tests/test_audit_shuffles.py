"""Rules that look for repeated keys move hashes and counts of all invoices, and whole invoices of the repeated keys only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docaudit.operators import analytics, invoices as inv
from docaudit.operators.approvals import approval_use
from docaudit.streaming import jobs as J


def _moved(df) -> list[str]:
    """Shuffles of the plan that was run, by their input columns."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    return [line for line in text.split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in line]


def _invoices(spark):
    rows = [
        (1, "a", "C1", "No.1", 10, "S"), (2, "b", " c1", "no.1 ", 10, "S"), (3, "c", "C2", "No.7", 5, "S"), (3, "d", "C2", "No.7", 6, "S"),
        (4, "e", "C3", "No.8", 1, "S"), (5, "f", None, "No.1", 1, "S"), (6, "g", "C3", " ", 1, None), (6, "h", "C3", " ", 1, None),
    ]
    return spark.createDataFrame(rows, "document_id long, invoice_key string, invoice_code string, invoice_number string, total_amount long, seller_tax_id string").withColumns({
        "issue_date": F.lit("2024-01-01"), "seller_name": F.lit("n"), "raw_payload": F.lit("x"),
    })


def test_repeated_invoices_hold_every_duplicate(spark):
    invoices = _invoices(spark)
    repeated = inv.repeated_invoices(invoices)
    assert repeated.columns == invoices.columns
    assert sorted(r.invoice_key for r in repeated.collect()) == ["a", "b", "c", "d"]
    assert [r.subject_key for r in inv.duplicates_inside(repeated).collect()] == [r.subject_key for r in inv.duplicates_inside(invoices).collect()] == ["d"]
    assert sorted(r.invoice_key for r in inv.shared_invoices(repeated).collect()) == ["a", "b"]
    assert not _moved(repeated)


def test_sellers_with_few_invoices_are_not_moved(spark):
    rows = [(1, f"k{i}", "C", f"No.{100 + i}", 50_000, "S") for i in range(4)] + [(2, "x", "C", "No.900", 50_000, "S"), (2, "y", "C", "No.901", 50_000, "S")]
    invoices = spark.createDataFrame(rows, _invoices(spark).drop("issue_date", "seller_name", "raw_payload").schema).withColumn("seller_name", F.lit("n"))
    found = inv.sequential_invoices(invoices)
    assert [(r.document_id, r.subject_key) for r in found.collect()] == [(1, "S|100")]
    assert "_hash" in found._jdf.queryExecution().optimizedPlan().toString()


def test_findings_of_documents_nobody_asks_about_are_not_moved(spark):
    questions = spark.createDataFrame([("m1", 1, "what about title a"), ("m2", 2, "hello")], "message_id string, document_id long, message string")
    findings = spark.createDataFrame(
        [(1, "f1", "R", "rule", "Title A"), (2, "f2", "R", "rule", "t"), (2, "f3", "R", "rule", "t"), (2, "f4", "R", "rule", "t"), (9, "f9", "R", "rule", "t")],
        "document_id long, finding_id string, rule_code string, rule_name string, title string",
    )
    df = analytics.citations(questions, findings)
    assert sorted((r.message_id, r.finding_id) for r in df.collect()) == [("m1", "f1"), ("m2", "f2"), ("m2", "f3")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_covered_expenses_ask_no_interval(spark):
    day = dt.date(2024, 1, 2)
    expenses = spark.createDataFrame(
        [(1, "a", 1, "采购", day, 3000, 10), (2, "b", 1, "采购", day, 3000, None), (3, "c", 1, "采购", None, 3000, None), (4, "d", None, "采购", day, 3000, 10)],
        "document_id long, line_key string, applicant_id long, category string, expense_day date, amount long, approval_id long",
    ).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    approvals = spark.createDataFrame(
        [(10, 1, "采购", dt.date(2024, 1, 1), dt.date(2024, 1, 9), 5000, "APPROVED")],
        "approval_id long, applicant_id long, category string, valid_from date, valid_to date, amount long, status string",
    ).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    used = approval_use(expenses, approvals)
    got = {r.line_key: (r.reason, r.candidate_id) for r in used.collect()}
    assert got == {"a": (None, None), "b": ("NOT_LINKED", 10), "c": ("NOT_LINKED", None), "d": ("WRONG_HOLDER", None)}
    # What is judged is stored, so the search computes no running sum again.
    assert "Window" not in used._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_judges_claims_of_repeated_keys_only(spark, tmp_path, monkeypatch):
    judged, seen = J.DuplicateHandler.judged, []
    monkeypatch.setattr(J.DuplicateHandler, "judged", lambda self, new, before: (seen.append(sorted(r.invoice_key for r in new.collect())), judged(self, new, before))[1])
    columns = "document_id long, invoice_key string, invoice_code string, invoice_number string, total_amount decimal(14,2), document_no string, status string"
    batches = [[(1, "a", "C", "1", None, "D1", "APPROVED"), (2, "b", "C", "2", None, "D2", "APPROVED")],
               [(3, "c", "c", "1", None, "D3", "APPROVED"), (3, "d", "C", "3", None, "D3", "APPROVED")]]
    for i, rows in enumerate(batches):
        J.land(spark, str(tmp_path), J.DuplicateHandler(), spark.createDataFrame(rows, columns), i)
    landed = spark.read.schema(J.DuplicateHandler.schema).parquet(f"{tmp_path}/out")
    assert {r.invoice_key: (r.kind, r.conflict_document) for r in landed.collect()} == {
        "a": (None, None), "b": (None, None), "c": ("across", 1), "d": (None, None),
    }
    assert seen == [[], ["c"]]
