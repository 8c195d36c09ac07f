"""Values beyond the usual sizes, resumed stream jobs, and the report store."""

import os
import subprocess
import sys
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docaudit.functions import scalars as S
from docaudit.operators import extract as E, invoices as I, lifecycle as L
from docaudit.sources.sinks import ReportStore
from docaudit.streaming import jobs as J

INVOICES = "document_id long, invoice_key string, invoice_number string, seller_tax_id string, seller_name string, total_amount decimal(14,2)"


def run_of(numbers, amount="2000.00"):
    return [(1, f"{i:03d}", n, "S", "Seller", Decimal(amount)) for i, n in enumerate(numbers)]


@pytest.mark.parametrize(("first", "count"), [
    (12345678901234567890123456789012345670, 3),
    (10**40 - 2, 4),  # grows by a digit
    (10**18 - 2, 4), (5 * 10**36 - 1, 3), (999, 3), (0, 3),
])
def test_runs_of_numbers_of_any_length(spark, first, count):
    df = spark.createDataFrame(run_of([f"No.{first + i}" for i in range(count)]), INVOICES)
    runs = I.sequential_runs(df).collect()
    assert [(r["run_length"], r["run_total"], r["first_number"]) for r in runs] == [(count, Decimal(2000 * count), str(first))]
    assert I.sequential_invoices(df).count() == 1


def test_numbers_apart_are_no_run(spark):
    for numbers in (["1" + "0" * 38, "2" + "0" * 37 + "1", "3" + "0" * 37 + "2"], ["9" * 18, "1" + "0" * 18 + "1"], ["7", "7", "7"]):
        assert I.sequential_runs(spark.createDataFrame(run_of(numbers), INVOICES)).count() == 0


def test_trailing_number_is_whole(spark):
    df = spark.createDataFrame([("A0" + "9" * 50,), ("B000",), ("C",), (None,), (" 12 ",)], "n string")
    assert [r[0] for r in df.select(S.trailing_number(F.col("n"))).collect()] == ["9" * 50, "0", None, None, "12"]


@pytest.mark.parametrize(("digits", "after"), [("", "1"), ("9", "10"), ("19", "20"), ("1299", "1300"), ("999", "1000"), ("120", "121")])
def test_next_digits(spark, digits, after):
    assert spark.range(1).select(S.next_digits(F.lit(digits))).first()[0] == after


def tokens(spark, texts):
    rows = [(1, i, t, 400, 600, 0.9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_id long, token_idx int, text string, ymin int, xmin int, confidence double")


def test_large_amounts_neither_fail_nor_vanish(spark):
    big = "9" * 18
    found = E.money_candidates(tokens(spark, [f"¥{big}.50", "¥1,234.5", f"¥{'8' * 40}", "54元"])).orderBy("token_idx").collect()
    assert [(r["token_idx"], r["cents"]) for r in found] == [(0, Decimal(big + "50")), (1, Decimal(123450)), (3, Decimal(5400))]
    detail = E.detail_rows(tokens(spark, [f"¥{big}.50", f"{'8' * 40}.00", "12.34"])).orderBy("token_idx").collect()
    assert [r["cents"] for r in detail] == [Decimal(big + "50"), Decimal(1234)]
    whole = E.parse_invoices(tokens(spark, [f"(小写) ¥{big}.00", "合计 ¥1.00", f"税额 ¥{int(big) - 1}.00"])).collect()[0]
    assert whole["total_amount"] == Decimal(big) and whole["untaxed_amount"] == Decimal(1)


def test_missing_sides_are_issues(spark):
    only_total = E.parse_invoices(tokens(spark, ["(小写) ¥100.00", "发票号码 12345678"])).collect()[0]
    assert only_total["quality_issues"] == "INVOICE_UNTAXED_AMOUNT_MISSING,INVOICE_TAX_AMOUNT_MISSING"
    derived = E.parse_invoices(tokens(spark, ["(小写) ¥100.00", "税额 ¥6.00", "发票号码 12345678"])).collect()[0]
    assert derived["quality_issues"] == "" and derived["untaxed_amount"] == Decimal("94.00")


def test_large_decimal_stays(spark):
    assert spark.range(1).select(S.safe_decimal(F.lit("1" + "0" * 17 + ".25"))).first()[0] == Decimal("1" + "0" * 17 + ".25")


def test_made_up_numbers_differ(spark):
    n = 300_000
    df = spark.range(n).select(
        F.col("id").alias("document_id"), F.lit("1").alias("invoice_key"), F.lit("").alias("invoice_code"), F.lit(None).cast("string").alias("invoice_number"),
        F.lit("").alias("invoice_type"), F.lit(None).cast("decimal(14,2)").alias("total_amount"),
    )
    assert L.ingest_defaults(df).select("invoice_number").distinct().count() == n
    day = F.lit("2024-01-02").cast("date")
    assert df.select(S.document_number(F.lit("X"), day, F.col("document_id"))).distinct().count() == n


EVENTS = "event_id string, event string, task_id string, document_id long, audit_version int, occurred_at timestamp, seq long, data string"


def event(seq, event_id, kind="task_started", task="K1", version=1, data="{}"):
    return (event_id, kind, task, 1, version, datetime(2024, 1, 1) + timedelta(seconds=seq), seq, data)


def append(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_a_job_resumes_and_consumes_nothing_twice(spark, tmp_path):
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    append(spark, source, [event(1, "a"), event(2, "a"), event(3, "b"), event(4, "c", version=2)])
    run = lambda: J.run_available(spark.readStream.schema(EVENTS).parquet(source), "append", J.ConsumeOnce(), job)
    accepted = lambda df: sorted((r["event_id"], r["audit_version"]) for r in df.where("accepted").collect())
    assert accepted(run()) == [("a", 1), ("c", 2)]
    assert accepted(run()) == [("a", 1), ("c", 2)]
    # A repeat long after the first, a late new event, and a new task.
    append(spark, source, [event(10**6, "a"), event(0, "late", version=2), event(5, "d", task="K2")])
    landed = run()
    assert accepted(landed) == [("a", 1), ("c", 2), ("d", 1)]
    assert landed.count() == 5 and landed.select("event_id").distinct().count() == 5


def test_a_late_event_corrects_a_missed_deadline(spark, tmp_path):
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    run = lambda: J.run_available(spark.readStream.schema(EVENTS).parquet(source), "append", J.DeadlineHandler(), job)
    missed = lambda df: sorted((r["task_id"], r["started_at"].minute) for r in J.DeadlineHandler.missed(df).collect())
    append(spark, source, [event(0, "a"), event(0, "b", task="K2"), event(30, "c", "task_completed", "K2"), event(300, "d", task="K3")])
    assert missed(run()) == []
    append(spark, source, [event(3600, "e", "task_progress", "K9")])
    assert missed(run()) == [("K1", 0), ("K3", 5)]
    # Far behind the clock: the end of K1, an earlier start of K3, and a task not seen before.
    append(spark, source, [event(60, "f", "task_completed"), event(240, "g", task="K3"), event(120, "h", task="K4")])
    landed = run()
    assert missed(landed) == [("K3", 4), ("K4", 2)]
    assert sorted(r["task_id"] for r in landed.where("event = 'withdrawn'").collect()) == ["K1", "K3"]


def test_completion_saves_reports_and_marks_failures(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "store"))
    store.load(
        spark.createDataFrame([("K1", 1, "high")], "task_id string, document_id long, overall_risk_level string"),
        spark.createDataFrame([("K1", "old")], "task_id string, finding_id string"),
        spark.createDataFrame([("K1", 1, "RUNNING", 50), ("K9", 9, "RUNNING", 10)], "task_id string, document_id long, status string, progress_pct int"),
    )
    documents = spark.createDataFrame([(1, Decimal("100.00"))], "document_id long, total_amount decimal(14,2)")
    findings = spark.createDataFrame([], "document_id long, rule_code string, risk_level string, is_overridable boolean")
    complete = spark.createDataFrame([(1, "COMPLETE")], "document_id long, audit_completeness string")
    handler = J.CompletionHandler(documents, findings, complete, store=store)
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    append(spark, source, [
        event(1, "a", "task_completed", data='{"overall_risk_level":"low"}'), event(2, "b", "task_failed", "K2", data='{"error_code":"X","error_detail":"broken"}'),
        event(3, "c", "task_completed"),
    ])
    run = lambda: J.run_available(spark.readStream.schema(EVENTS).parquet(source), "append", handler, job)
    for _ in range(2):
        got = {r["task_id"]: r for r in run().collect()}
        assert (got["K1"]["status"], got["K1"]["action"], got["K2"]["status"], got["K2"]["message"], got["K2"]["action"]) == ("COMPLETED", "AUTO_APPROVE", "FAILED", "broken", None)
    assert [tuple(r) for r in store.read("reports").select("task_id", "overall_risk_level").collect()] == [("K1", "low")]
    assert store.read("findings").count() == 0
    assert {r["task_id"]: r["status"] for r in store.read("tasks").collect()} == {"K1": "COMPLETED", "K9": "RUNNING"}


def test_plain_install_runs_and_cleans_up(tmp_path):
    """A local session without any configuration: stored tables get a folder, and scratch() leaves nothing behind."""
    code = """
import glob, sys
from pyspark.sql import SparkSession
from docaudit.session import materialize, release, scratch, shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept = materialize(spark.range(5))
with scratch(spark):
    assert materialize(spark.range(7)).count() == 7
    assert len(glob.glob(shared_folder(spark) + "/docaudit/*")) == 2
assert len(glob.glob(shared_folder(spark) + "/docaudit/*")) == 1 and kept.count() == 5
assert release(spark) == 1 and not glob.glob(shared_folder(spark) + "/docaudit/*")
print(shared_folder(spark))
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert not os.path.exists(done.stdout.strip().splitlines()[-1])


def test_pages_without_extent_and_large_totals(spark):
    rows = [(10.0, 100.0), (10.0, 0.0), (-5.0, 100.0), (1e300, 1.0), (None, 10.0), (10.0, None)]
    boxes = spark.createDataFrame(rows, "v double, e double").select(S.fraction_box(F.col("v"), F.col("e")).alias("b"))
    assert [r["b"] for r in boxes.collect()] == [100, None, 0, 1000, None, None]
    big = spark.sql("select 1L document_id, 'k' invoice_key, null invoice_code, '' invoice_number, null invoice_type, cast('99999999999999999999.25' as decimal(38,2)) total_amount")
    row = L.ingest_defaults(big).first()
    assert str(row["total_amount"]) == "99999999999999999999.25" and row["invoice_code"] == "NONE"
    assert L.ingest_defaults(big.withColumn("total_amount", F.lit(None).cast("decimal(14,2)")), zero_fill_total=True).first()["total_amount"] == 0
