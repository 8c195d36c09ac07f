"""What lies on disk at once: shuffles go with the write they belong to, stored tables with their last reader."""

from __future__ import annotations

import datetime as dt
import os
import time
from decimal import Decimal

from pyspark.sql import functions as F

from docaudit import schemas, session
from docaudit.functions.intervals import LEVELS, stab
from docaudit.operators.approvals import approval_use
from docaudit.plans.audit import AuditInputs, audit
from tests.test_rules import bills, docs, lines, table


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _lying(spark, since: int) -> list[str]:
    return [p for p in session._STORED[spark.sparkContext.applicationId][since:] if os.path.isdir(p)]


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    key, held = session._FREES_SHUFFLES, _shuffle_files(spark)
    before = spark.conf.get(key, None)
    table = session.materialize(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    until = time.time() + 20
    while _shuffle_files(spark) > held and time.time() < until:  # deleted behind the driver's back
        time.sleep(0.2)
    assert _shuffle_files(spark) <= held
    assert table.count() == 100
    assert spark.conf.get(key, None) == before


def test_discarded_tables_are_gone_and_others_stay(spark):
    first, second, plain = session.materialize(spark.range(3)), session.materialize(spark.range(4)), spark.range(5)
    since = len(session._STORED[spark.sparkContext.applicationId]) - 2
    assert len(_lying(spark, since)) == 2
    session.discard(first, plain)
    session.discard(first)
    assert len(_lying(spark, since)) == 1 and second.count() == 4


def test_approval_use_keeps_what_its_result_reads(spark):
    day = dt.date(2024, 1, 2)
    expenses = spark.createDataFrame(
        [(1, "a", 1, "采购", day, 3000, 10), (2, "b", 1, "采购", day, 3000, None), (3, "c", 2, "采购", day, 3000, 11)],
        "document_id long, line_key string, applicant_id long, category string, expense_day date, amount long, approval_id long",
    ).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    approvals = spark.createDataFrame(
        [(10, 1, "采购", dt.date(2024, 1, 1), dt.date(2024, 1, 9), 5000, "APPROVED")],
        "approval_id long, applicant_id long, category string, valid_from date, valid_to date, amount long, status string",
    ).withColumn("amount", F.col("amount").cast("decimal(14,2)"))
    session.materialize(spark.range(1))
    since = len(session._STORED[spark.sparkContext.applicationId])
    used = approval_use(expenses, approvals)
    read = {os.path.dirname(f).removeprefix("file://") for f in used.inputFiles()}
    lying = [p for p in _lying(spark, since) if spark.read.parquet(p).columns != ["approval_id"]]  # the list of hot groups is small
    assert {p.removeprefix("file://") for p in lying} == read
    assert {r.line_key: (r.reason, r.candidate_id) for r in used.collect()} == {"a": (None, None), "b": ("NOT_LINKED", 10), "c": ("NOT_FOUND", None)}


def test_places_are_not_multiplied_by_sizes_of_blocks(spark):
    """At, before and behind borders of the largest blocks, with a key that holds many intervals and places."""
    size = 2**LEVELS
    intervals = [("k", a, b, i) for i, (a, b) in enumerate([(-size - 1, -size), (-1, 0), (size - 1, 2 * size), (5, 5), (0, 3 * size), (7, 6), (2, None)])]
    places = [("k", at, at) for at in (-size - 1, -size, -size + 1, -1, 0, 5, 7, size - 1, size, 2 * size, 3 * size, 3 * size + 1)] + [(None, 5, 99), ("other", 5, 98)]
    points, held = spark.createDataFrame(places, "k string, at int, i int"), spark.createDataFrame(intervals, "k string, low int, high int, id int")
    found = stab(points, held, ["k"], "at", "low", "high", ["id"])
    fits = lambda p, v: p[0] == v[0] and v[2] is not None and v[1] <= p[1] <= v[2]
    assert {r["i"]: r["found"] and r["found"]["id"] for r in found.collect()} == {p[2]: min((v[3] for v in intervals if fits(p, v)), default=None) for p in places}
    assert "sequence(0" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_audit_leaves_what_its_results_read(spark):
    """Segments, points, supplier and line facts and repeated invoices go with their last rule; tables that were given stay."""
    points = session.materialize(spark.createDataFrame(
        [(1, 1, "p", dt.datetime(2024, 1, 1), "北京", 39.9, 116.4)],
        "scope_id long, point_no long, point_id string, event_time timestamp, city_name string, latitude double, longitude double",
    ))
    since = len(session._STORED[spark.sparkContext.applicationId])
    result = audit(AuditInputs(
        documents=docs(spark, {"document_id": 1, "total_amount": Decimal(10), "document_type": "CORP_PAYMENT"}), lines=lines(spark, {"amount": "7"}),
        invoices=bills(spark, {"invoice_key": "a", "is_manual_modified": True}, {"invoice_key": "b"}), suppliers=table(spark, schemas.SUPPLIERS),
        purpose_verdicts=table(spark, schemas.PURPOSE_VERDICTS), scope_verdicts=table(spark, schemas.SCOPE_VERDICTS), points=points,
    ), with_summary=False)
    read = {os.path.dirname(f).removeprefix("file://") for f in result.report.inputFiles() + result.findings.inputFiles()}
    lying = [p.removeprefix("file://") for p in _lying(spark, since) if len(spark.read.parquet(p).columns) > 1]  # lists of hashes and of hot groups are small
    assert set(lying) <= read
    assert points.count() == 1
    assert {"R01", "R07"} <= {r.rule_code[:3] for r in result.findings.collect()}
    assert result.report.count() == 1
