"""Expenses that need an approval in advance: links, validity, and what is left of the approved amount."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docaudit.functions.findings import emit, finding_row
from docaudit.functions.intervals import stab
from docaudit.functions.ordered import HOT_ROWS, Step, chunked_scan
from docaudit.params import DEFAULTS, AuditParams
from docaudit.session import discard, materialize

MONEY = "decimal(38,2)"


def approval_use(expenses: DataFrame, approvals: DataFrame, params: AuditParams = DEFAULTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every expense that needs an approval, with ``reason`` (null: covered), ``uncovered`` and ``candidate_id``.

    expenses: document_id, line_key, applicant_id, category, expense_day, amount, approval_id; approvals: approval_id (one
    row each), applicant_id, category, valid_from, valid_to, amount, status. An expense above ``gate_limit`` of a gated
    category must name an approval: NOT_LINKED, NOT_FOUND, NOT_APPROVED, WRONG_HOLDER (another applicant or category) and
    NOT_VALID (not valid on the day, or no day known) tell why it has none. The others use their approval in order of day,
    document and line, every yuan of it once; beyond its amount (unknown: 0) they are EXHAUSTED, with the part not covered.
    ``candidate_id`` is an approval that would have fitted an uncovered expense: the one that ends first.
    """
    # Stored step by step, and deleted with the next step: what lies on disk at once is one step and what it moves.
    gated = materialize(expenses.where(F.col("category").isin(*params.gated_categories) & (F.col("amount") > F.lit(params.gate_limit).cast(MONEY))))
    held = approvals.where("approval_id is not null").select(
        "approval_id", F.struct("applicant_id", "category", "valid_from", "valid_to", "amount", "status").alias("approval")
    )
    holder = (F.col("approval.applicant_id") == F.col("applicant_id")) & (F.col("approval.category") == F.col("category"))
    reason = (
        F.when(F.col("approval_id").isNull(), F.lit("NOT_LINKED")).when(F.col("approval").isNull(), F.lit("NOT_FOUND"))
        .when(~F.col("approval.status").eqNullSafe(F.lit("APPROVED")), F.lit("NOT_APPROVED"))
        .when(~F.coalesce(holder, F.lit(False)), F.lit("WRONG_HOLDER"))
        .when(~F.coalesce(F.col("expense_day").between(F.col("approval.valid_from"), F.col("approval.valid_to")), F.lit(False)), F.lit("NOT_VALID"))
    )
    # Of the approval only its amount is needed beyond this.
    linked = materialize(gated.join(held, "approval_id", "left").withColumn("reason", reason).withColumn("_approved", F.col("approval.amount").cast(MONEY)).drop("approval"))
    discard(gated)
    using = chunked_scan(
        linked.where("reason is null"), ["approval_id"], ["expense_day", "document_id", "line_key", "amount"],
        {"_used": Step("sum", F.col("amount").cast(MONEY), inclusive=True)}, hot_rows, stored=True,
    )
    over = F.col("_used").cast(MONEY) - F.coalesce("_approved", F.lit("0").cast(MONEY))
    used = using.withColumn("reason", F.when(over > 0, F.lit("EXHAUSTED"))).withColumn(
        "uncovered", F.greatest(F.least(over, F.col("amount").cast(MONEY)), F.lit("0").cast(MONEY)).cast(MONEY)
    ).drop("_used")
    judged = used.unionByName(linked.where("reason is not null").withColumn("uncovered", F.col("amount").cast(MONEY)))
    # Stored, as the search reads it for the places and for the rows; covered expenses ask nothing.
    open_ = materialize(judged.drop("_approved").withColumn("_day", F.when(F.col("reason").isNotNull(), F.unix_date("expense_day"))))
    discard(linked)
    fitting = approvals.where("status = 'APPROVED' and approval_id is not null").select(
        "applicant_id", "category", F.unix_date("valid_from").alias("_from"), F.unix_date("valid_to").alias("_to"), "approval_id"
    )
    found = stab(open_, fitting, ["applicant_id", "category"], "_day", "_from", "_to", ["_to", "approval_id"], "_candidate")
    return found.withColumn("candidate_id", F.col("_candidate.approval_id")).drop("_day", "_candidate")


def missing_pre_approvals(used: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """R10: one finding per expense of ``approval_use`` that is not covered, over the part not covered."""
    return emit(used.where(F.col("reason").isNotNull()), finding_row(
        "pre_approval",
        F.col("line_key"),
        amount=F.col("uncovered"),
        title=F.concat(F.lit("缺少有效事前审批: "), F.col("category")),
        actual={"reason": F.col("reason"), "amount": F.col("amount"), "approval_id": F.col("approval_id")},
        expected={"limit_without_approval": F.lit(params.gate_limit), "fitting_approval": F.col("candidate_id")},
    ))
