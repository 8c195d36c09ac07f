"""Batch payments against their header, repeated and shared accounts, and unit prices against the market's upper end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docaudit.functions.findings import emit, emit_where, finding_row, union_findings
from docaudit.functions.ordered import HOT_ROWS, Step, chunked_scan
from docaudit.params import DEFAULTS, AuditParams
from docaudit.session import materialize

MONEY = "decimal(38,2)"


# ---------------------------------------------------------------- batch payments


def payee_facts(payments: DataFrame) -> DataFrame:
    """Sums per batch, per account in a batch, and per account, in one pass: document_id, account_no, level (``batch``,
    ``use`` or ``account``), amount, n, low_name, high_name.

    payments: document_id, account_no, payee_name, amount. Names are compared without outer blanks and letter case; blanks
    in an account number do not count, and an account without any other sign is unknown. Unknown amounts add nothing.
    """
    account, name = F.regexp_replace("account_no", r"\s", ""), F.upper(F.trim("payee_name"))
    rows = payments.select(
        "document_id", F.when(account != "", account).alias("account_no"), F.when(name != "", name).alias("name"), F.col("amount").cast(MONEY).alias("amount")
    )
    level = F.when(F.grouping("account_no") == 1, F.lit("batch")).when(F.grouping("document_id") == 1, F.lit("account")).otherwise(F.lit("use"))
    sets = [[F.col("document_id")], [F.col("document_id"), F.col("account_no")], [F.col("account_no")]]
    return rows.groupingSets(sets, "document_id", "account_no").agg(
        level.alias("level"), F.sum("amount").cast(MONEY).alias("amount"), F.count(F.lit(1)).alias("n"),
        F.min("name").alias("low_name"), F.max("name").alias("high_name"),
    )


def batch_findings(batches: DataFrame, payments: DataFrame) -> DataFrame:
    """R04 for batch payments: total and number of payments against the header (high), an account paid several times in one
    batch, and an account that payees of different names share anywhere (medium, one per batch and account).

    batches: document_id, total_amount, declared_count. A header without total or count is not judged by it; a batch without
    payments has sum and number 0; payments without header are judged by their accounts only.
    """
    facts = materialize(payee_facts(payments))
    sums = facts.where("level = 'batch'").select("document_id", "amount", "n")
    headed = batches.select("document_id", F.col("total_amount").cast(MONEY).alias("total"), "declared_count").join(sums, "document_id", "left").select(
        "document_id", "total", "declared_count", F.coalesce("amount", F.lit(0).cast(MONEY)).alias("paid"), F.coalesce("n", F.lit(0)).alias("n"),
    )
    key = F.col("document_id").cast("string")
    header = emit_where(headed, [
        (F.col("paid") != F.col("total"), finding_row(
            "batch_total", key, amount=F.abs(F.col("paid") - F.col("total")), actual={"paid": F.col("paid")}, expected={"total": F.col("total")})),
        (F.col("n") != F.col("declared_count"), finding_row(
            "batch_count", key, actual={"payments": F.col("n")}, expected={"payments": F.col("declared_count")})),
    ])
    names = facts.where("level = 'account' and account_no is not null and low_name < high_name").select(
        "account_no", F.col("low_name").alias("first_name"), F.col("high_name").alias("other_name")
    )
    uses = facts.where("level = 'use' and account_no is not null and document_id is not null").join(names, "account_no", "left")
    subject = F.concat_ws("|", key, "account_no")
    accounts = emit_where(uses, [
        (F.col("n") > 1, finding_row("batch_repeated", subject, amount=F.col("amount"), actual={"payments": F.col("n")}, expected={"payments": F.lit(1)})),
        (F.col("first_name").isNotNull(), finding_row(
            "batch_shared", subject, amount=F.col("amount"), actual={"payee": F.col("first_name"), "other_payee": F.col("other_name")})),
    ])
    return union_findings([header, accounts])


# ---------------------------------------------------------------- market prices


def price_counts(purchases: DataFrame) -> DataFrame:
    """How often an item was bought at a unit price on a day: item_key, day, unit_price, n. Tables of several periods or
    sources are put together by union; prices of 0 and less are left out."""
    return purchases.where("item_key is not null and day is not null and unit_price > 0").groupBy("item_key", "day", "unit_price").agg(F.count(F.lit(1)).alias("n"))


def price_benchmarks(counts: DataFrame, first_day: str, last_day: str, params: AuditParams = DEFAULTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The market's upper end per item over a period: the lowest price that at least ``price_percent`` of a hundred
    purchases do not exceed, exactly; with the number of purchases it rests on.

    Purchases of one price are one row before the prices of an item are ordered.
    """
    prices = counts.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).groupBy("item_key", "unit_price").agg(F.sum("n").alias("n"))
    ranked = chunked_scan(prices, ["item_key"], ["unit_price"], {"_upto": Step("sum", F.col("n"), inclusive=True)}, hot_rows)
    totals = prices.groupBy("item_key").agg(F.sum("n").alias("n_purchases"))
    return ranked.join(totals, "item_key").groupBy("item_key").agg(
        F.min(F.when(F.col("_upto") * 100 >= F.col("n_purchases") * params.price_percent, F.col("unit_price"))).alias("upper_price"),
        F.first("n_purchases").alias("n_purchases"),
    )


def price_deviations(purchases: DataFrame, benchmarks: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """R06: a unit price above the market's upper end by more than 10 % (medium) or 30 % (high).

    purchases: document_id, line_key, item_key, day, unit_price. An item with fewer than ``price_min_purchases`` has no
    market and judges nothing.
    """
    market = benchmarks.where(F.col("n_purchases") >= params.price_min_purchases)
    price, upper = F.col("unit_price").cast(MONEY), F.col("upper_price").cast(MONEY)
    over = (price - upper) * 100
    dear = purchases.join(market, "item_key").where(over > upper * params.price_medium_percent)
    return emit(dear, finding_row(
        "price", F.col("line_key"), amount=price - upper,
        level=F.when(over > upper * params.price_high_percent, F.lit("high")).otherwise(F.lit("medium")),
        actual={"unit_price": F.col("unit_price")}, expected={"upper_price": F.col("upper_price"), "purchases": F.col("n_purchases")},
    ))
