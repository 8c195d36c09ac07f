"""Operators that split hot groups must equal the plain computation, whatever the piece size."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window, functions as F

from docaudit.functions.ordered import Step, as_of_join, chunked_lag, chunked_scan, first_per_key
from docaudit.operators.invoices import sequential_runs
from docaudit.params import DEFAULTS


def brute_runs(rows):
    """Runs by sorting all invoices of a seller, as one list."""
    groups, out = {}, []
    for doc, seller, key, number, cents in rows:
        groups.setdefault((doc, seller), []).append((int(number), key, cents))
    for (doc, seller), items in groups.items():
        items.sort()
        run = [items[0]]
        for before, item in zip(items, items[1:] + [(-10, "", 0)]):
            if item[0] - before[0] == 1:
                run.append(item)
            else:
                if len(run) > 1:
                    out.append((doc, seller, str(run[0][0]), len(run), sum(r[2] for r in run)))
                run = [item]
    return sorted(out)


def test_runs_across_range_borders(spark):
    rng = random.Random(7)
    rows = []
    for doc in (1, 2):
        for i in range(400):
            number = rng.choice([rng.randint(0, 90), 10**18 - 5 + rng.randint(0, 9), 10**20 + rng.randint(0, 30)])
            rows.append((doc, f"S{rng.randint(0, 1)}", f"{i:05d}", str(number), rng.randint(1, 500)))
    df = spark.createDataFrame(rows, "document_id long, seller_tax_id string, invoice_key string, invoice_number string, cents long").select(
        "*", F.lit("n").alias("seller_name"), (F.col("cents").cast("decimal(14,2)")).alias("total_amount"))
    for chunk in (4, 65536):
        got = sequential_runs(df, replace(DEFAULTS, run_chunk=chunk)).collect()
        assert sorted((r.document_id, r.seller_tax_id, r.first_number, r.run_length, int(r.run_total)) for r in got) == brute_runs(rows)


@pytest.mark.parametrize("hot_rows", [1, 40, 10**6])
def test_chunked_scan_equals_window(spark, hot_rows):
    """Also with nearly all rows of a table at one instant of one group, null groups and null values."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), 7 if rng.random() < 0.8 else rng.randint(0, 12), i, rng.choice([None, i % 11])) for i in range(700)]
    df = spark.createDataFrame(rows, "g long, t long, id long, v long").withColumn("m", F.col("v").cast("decimal(14,2)")).repartition(5)
    steps = {
        "lag": Step("last", F.struct("id", "v")), "known": Step("last", F.col("v"), inclusive=True), "total": Step("sum", F.col("m"), inclusive=True),
        "before": Step("sum", F.col("v")), "high": Step("max", F.struct("v", "id")), "low": Step("min", F.col("v"), inclusive=True),
    }
    w = Window.partitionBy("g").orderBy("t", "id")
    past, here = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.lag(F.struct("id", "v")).over(w).alias("lag"), F.last("v", ignorenulls=True).over(here).alias("known"), F.sum("m").over(here).alias("total"),
        F.sum("v").over(past).alias("before"), F.max(F.struct("v", "id")).over(past).alias("high"), F.min("v").over(here).alias("low"),
    )
    got = chunked_scan(df, ["g"], ["t", "id"], steps, hot_rows)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    lag = chunked_lag(df, ["g"], ["t", "id"], ["id"], hot_rows=hot_rows).select("id", F.col("prev.id").alias("p"))
    assert sorted(map(str, lag.collect())) == sorted(map(str, df.select("id", F.lag("id").over(w).alias("p")).collect()))


def test_hot_group_is_cut_into_pieces(spark):
    """A group at one instant is spread over tasks, and no piece holds it whole."""
    df = spark.range(4000).selectExpr("1 g", "0 t", "id", "1 v").repartition(4)
    from docaudit.functions import ordered

    seen = []
    keep = ordered.materialize
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share a task
    ordered.materialize = lambda d: seen.append(keep(d)) or seen[-1]
    try:
        got = chunked_scan(df, ["g"], ["t", "id"], {"n": Step("sum", F.col("v"), inclusive=True)}, 10)
        assert got.where("n = id + 1").count() == 4000
    finally:
        ordered.materialize = keep
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    dealt = next(d for d in seen if "id" in d.columns and "_piece" in d.columns)
    assert max(r["count"] for r in dealt.groupBy("_piece").count().collect()) < 2500


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_as_of_join_by_definition(spark, hot_rows):
    """One key holds nine tenths of the rows; ties on time go to the highest version."""
    rng = random.Random(8)
    left = [(i, rng.choice([1] * 9 + [2, None]), rng.choice([None, rng.randint(0, 30)])) for i in range(300)]
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, rng.randint(0, 30)]), v) for v in range(40)]
    found = as_of_join(
        spark.createDataFrame(left, "id long, k long, day long"), spark.createDataFrame(right, "k long, since long, version long"),
        ["k"], "day", "since", ["version"], ["version", "since"], hot_rows=hot_rows,
    )
    for r in found.collect():
        fits = [(s, v) for k, s, v in right if None not in (k, s, r["k"], r["day"]) and k == r["k"] and s <= r["day"]]
        assert (r["as_of"] and (r["as_of"]["since"], r["as_of"]["version"])) == max(fits, default=None)
    assert found.count() == 300 and found.columns == ["id", "k", "day", "as_of"]


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 k", "id v")
    top = first_per_key(df, ["k"], [F.col("v").desc()], 2)
    assert top.count() == 6
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
