"""Rules over ledgers: policy versions, split purchases, contract payments and prepayments, each in order of time.

All of them are folds along a time line. ``chunked_scan`` cuts a key that holds most rows into pieces, so a single
contract, account or policy is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docaudit.functions.findings import emit, finding_row
from docaudit.functions.ordered import HOT_ROWS, Scan, Step, as_of_join, by_group_size, chunked_scan
from docaudit.params import DEFAULTS, AuditParams
from docaudit.session import materialize

MONEY = "decimal(38,2)"


def _money(value: str) -> Column:
    return F.lit(value).cast(MONEY)


# ---------------------------------------------------------------- policy versions


def policies_in_force(uses: DataFrame, versions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every use of a policy with the version in force on its day and the version it names.

    uses: document_id, line_key, policy_key, used_version, expense_day; versions: policy_key, version_no, effective_from. Of
    versions that start on one day the highest counts. A use without a day or before the first version has none in force.
    """
    timed = as_of_join(
        uses, versions, ["policy_key"], "expense_day", "effective_from", ["version_no"], ["version_no", "effective_from"], "in_force", hot_rows
    )
    starts = versions.groupBy("policy_key", F.col("version_no").alias("used_version")).agg(F.min("effective_from").alias("used_from"))
    return timed.join(starts, ["policy_key", "used_version"], "left")


def policy_version_mismatch(uses: DataFrame, versions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """R12: a line settled by a version that a later one had replaced on the day of the expense."""
    timed = policies_in_force(uses, versions, hot_rows)
    old = timed.where((F.col("in_force.version_no") != F.col("used_version")) & (F.col("used_from") < F.col("in_force.effective_from")))
    return emit(old, finding_row(
        "policy_version",
        F.col("line_key"),
        title=F.concat(F.lit("制度版本已更新: "), F.col("policy_key").cast("string")),
        actual={"used_version": F.col("used_version"), "expense_day": F.col("expense_day")},
        expected={"version_in_force": F.col("in_force.version_no"), "effective_from": F.col("in_force.effective_from")},
    ))


# ---------------------------------------------------------------- split purchases


def split_windows(expenses: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """Maximal windows of ``split_days`` days in which one applicant's spending of one category exceeds the approval limit.

    expenses: document_id, applicant_id, category, expense_day, amount. Amounts are summed by day before they meet, so a
    window sees one row per day of a key, whatever its number of rows. Only positive known amounts count, so every later
    window that starts no later holds the earlier one; a window needs two documents. Rows without applicant, category or
    day are in no window.
    """
    known = expenses.where("applicant_id is not null and category is not null and expense_day is not null and amount > 0")
    days = known.groupBy("applicant_id", "category", "expense_day").agg(
        F.sum("amount").cast(MONEY).alias("spent"), F.count(F.lit(1)).alias("n"), F.min("document_id").alias("low"), F.max("document_id").alias("high"),
    ).withColumn("day_no", F.datediff("expense_day", F.lit("1970-01-01").cast("date")))
    by_day = Window.partitionBy("applicant_id", "category").orderBy("day_no")
    back = by_day.rangeBetween(1 - params.split_days, 0)
    summed = days.select(
        "applicant_id", "category", F.col("expense_day").alias("last_day"), F.col("high").alias("document_id"), "day_no",
        F.min("expense_day").over(back).alias("first_day"), F.min("day_no").over(back).alias("first_no"), F.lead("day_no").over(by_day).alias("next_no"),
        F.sum("spent").over(back).cast(MONEY).alias("spent"), F.sum("n").over(back).alias("n_lines"),
        (F.min("low").over(back) < F.max("high").over(back)).alias("several"),
    )
    held = F.coalesce(F.col("next_no") < F.col("first_no") + params.split_days, F.lit(False))  # the next window holds this one
    return summed.where(F.col("several") & (F.col("spent") > _money(params.split_limit)) & ~held).drop("day_no", "first_no", "next_no", "several")


def split_purchases(expenses: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """Suspected splitting: one finding per maximal window, on the last document in it."""
    return emit(split_windows(expenses, params), finding_row(
        "split_purchase",
        F.concat_ws("|", F.col("applicant_id").cast("string"), "category", F.col("first_day").cast("string"), F.col("last_day").cast("string")),
        amount=F.col("spent") - _money(params.split_limit),
        title=F.concat(F.lit("短期内同科目累计超限: "), F.col("category")),
        actual={"spent": F.col("spent"), "lines": F.col("n_lines")},
        expected={"approval_limit": F.lit(params.split_limit), "days": F.lit(params.split_days)},
    ))


# ---------------------------------------------------------------- contract payments


def contract_ledger(payments: DataFrame, contracts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every payment with what its contract has paid up to and with it, and the contract's total.

    payments: contract_id, paid_on, document_id, amount; contracts: contract_id, contract_total. Payments of a day go by
    document. An unknown amount adds nothing and is judged by nothing; a contract without a known total judges nothing.
    """
    run = chunked_scan(
        payments.where("contract_id is not null"), ["contract_id"], ["paid_on", "document_id", "amount"],
        {"paid": Step("sum", F.col("amount").cast(MONEY), inclusive=True)}, hot_rows,
    )
    return run.join(contracts.select("contract_id", "contract_total"), "contract_id").withColumn("paid", F.col("paid").cast(MONEY))


def contract_overpayments(payments: DataFrame, contracts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """R03: the payment with which a contract's total is exceeded, and all that leave it exceeded.

    The discrepancy is the part of the payment beyond the total: all of it after the first crossing.
    """
    over = contract_ledger(payments, contracts, hot_rows).where((F.col("amount").isNotNull()) & (F.col("paid") > F.col("contract_total")))
    before = F.col("paid") - F.col("amount")
    return emit(over, finding_row(
        "contract",
        F.concat_ws("|", F.col("contract_id").cast("string"), F.col("document_id").cast("string")),
        amount=F.least(F.col("amount").cast(MONEY), F.col("paid") - F.col("contract_total")),
        title=F.concat(F.lit("合同累计付款超过总额: "), F.col("contract_id").cast("string")),
        actual={"paid_before": before, "amount": F.col("amount"), "first_crossing": before <= F.col("contract_total")},
        expected={"contract_total": F.col("contract_total")},
    ))


# ---------------------------------------------------------------- prepayments

ADVANCE, OFFSET = 0, 1


def prepayment_ledger(advances: DataFrame, offsets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per advance and offset of an account, in order of time: account_id, day, kind (ADVANCE or OFFSET), entry_id, amount,
    uncovered (of an offset, what the advances paid up to then could not cover), balance (left after the entry).

    advances: account_id, day, entry_id, amount; offsets likewise. Advances of a day come before its offsets. What an
    offset does not find is uncovered for good; later advances do not pay it. With n the sum of advances less offsets up
    to an entry, all that was uncovered so far is the highest -n so far, or 0; both are folds, so no row waits for the
    one before it. Entries of unknown or no positive amount, day or account are left out. The ledger is stored, since
    allocation and balances read it again.
    """
    columns = ["account_id", "day", "entry_id", F.col("amount").cast(MONEY).alias("amount")]
    both = advances.select(*columns, F.lit(ADVANCE).alias("kind")).unionByName(offsets.select(*columns, F.lit(OFFSET).alias("kind")))
    rows = both.where("account_id is not null and day is not null and amount > 0")
    order = ["day", "kind", "entry_id", "amount"]
    signed = F.when(F.col("kind") == ADVANCE, F.col("amount")).otherwise(-F.col("amount"))
    steps = {"net": Step("sum", signed, inclusive=True)}
    short = F.greatest(-F.col("net").cast(MONEY), _money("0"))
    lost = {"before": Step("max", short), "after": Step("max", short, inclusive=True)}

    def fold(part: DataFrame, scan: Scan) -> DataFrame:
        return scan(scan(part, ["account_id"], order, steps), ["account_id"], order, lost)

    return materialize(by_group_size(rows, ["account_id"], fold, hot_rows).select(
        "account_id", "day", "kind", "entry_id", "amount",
        (F.col("after") - F.coalesce("before", _money("0"))).cast(MONEY).alias("uncovered"),
        (F.col("net") + F.col("after")).cast(MONEY).alias("balance"),
    ))


def prepayment_allocation(ledger: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Which advance pays which offset, first in first out: account_id, advance_id, offset_id, amount (offset_id null: what is left
    of an advance).

    Advances fill a line of money one after the other, and so do the covered parts of the offsets. Between two
    neighbouring ends of either kind exactly one advance meets one offset: the next ends of both kinds, which two folds
    from behind tell. So there are fewer rows than advances and offsets together, and no intervals are joined.
    """
    part = ledger.select("account_id", "day", "kind", "entry_id", (F.col("amount") - F.col("uncovered")).cast(MONEY).alias("part")).where("part > 0")
    last = {"begin": Step("last", F.col("end"))}
    following = {
        "advance_id": Step("last", F.when(F.col("kind") == ADVANCE, F.col("entry_id")), inclusive=True),
        "offset_id": Step("last", F.when(F.col("kind") == OFFSET, F.col("entry_id")), inclusive=True),
    }

    def fold(rows: DataFrame, scan: Scan) -> DataFrame:
        ends = scan(rows, ["account_id", "kind"], ["day", "entry_id", "part"], {"end": Step("sum", F.col("part"), inclusive=True)})
        ends = ends.select("account_id", "kind", "entry_id", F.col("end").cast(MONEY).alias("end"))
        cut = scan(ends, ["account_id"], ["end", "kind"], last)
        # From behind: ends of one place in the opposite order, so that each sees the other.
        back = cut.withColumn("_end", -F.col("end")).withColumn("_kind", -F.col("kind"))
        return scan(back, ["account_id"], ["_end", "_kind"], following)

    met = by_group_size(part, ["account_id"], fold, hot_rows, stored=True)
    size = (F.col("end") - F.coalesce("begin", _money("0"))).cast(MONEY)
    return met.select("account_id", "advance_id", "offset_id", size.alias("amount")).where("amount > 0")


def advance_balances(ledger: DataFrame, allocation: DataFrame) -> DataFrame:
    """What is left of every advance."""
    left = allocation.groupBy("account_id", F.col("advance_id").alias("entry_id")).agg(
        F.sum(F.when(F.col("offset_id").isNull(), F.col("amount")).otherwise(_money("0"))).cast(MONEY).alias("remaining")
    )
    return ledger.where(F.col("kind") == ADVANCE).select("account_id", "entry_id", "amount").join(left, ["account_id", "entry_id"])


def prepayment_over_offsets(ledger: DataFrame) -> DataFrame:
    """R04: an offset that exceeds what is left of the prepayments on its day; entry_id is the document of the offset."""
    over = ledger.where((F.col("kind") == OFFSET) & (F.col("uncovered") > 0)).withColumn("document_id", F.col("entry_id"))
    return emit(over, finding_row(
        "prepayment",
        F.concat_ws("|", F.col("account_id").cast("string"), F.col("entry_id").cast("string")),
        amount=F.col("uncovered"),
        title=F.concat(F.lit("冲销额超过预付余额: "), F.col("account_id").cast("string")),
        actual={"offset": F.col("amount")},
        expected={"available": F.col("amount") - F.col("uncovered")},
    ))
