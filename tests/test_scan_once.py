"""Scans over large groups compute their input a fixed number of times, however many scans follow each other."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docaudit.operators import ledgers as L


def _entries(spark, count, first, n):
    """n entries of two accounts, one of which holds most; every computed row is counted."""

    @F.udf("long")
    def counted(x):
        count.add(1)
        return x

    day = dt.date(2024, 1, 1)
    rows = [(1 if i % 5 else 2, day + dt.timedelta(days=i % 7), first + i) for i in range(n)]
    df = spark.createDataFrame(rows, "account_id long, day date, entry_id long")
    amount = counted("entry_id") % 11 + 1
    return df.withColumn("amount", amount.cast("decimal(14,2)"))


def _plain(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_prepayments_with_hot_accounts_compute_their_input_thrice(spark):
    count, n = spark.sparkContext.accumulator(0), 40
    advances, offsets = _entries(spark, count, 0, n), _entries(spark, count, 100, n)
    ledger = L.prepayment_ledger(advances, offsets, hot_rows=10)
    got = _plain(L.prepayment_allocation(ledger, hot_rows=10))
    # Once for the count and once to store; the filter and the column may each call the function.
    assert count.value <= 3 * 2 * 2 * n
    assert got == _plain(L.prepayment_allocation(L.prepayment_ledger(advances, offsets)))
