"""Amount rules: header, lines and invoices must agree to the cent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit.functions.findings import emit, emit_where, finding_row, union_findings
from docaudit.functions.scalars import safe_decimal
from docaudit.params import DEFAULTS, AuditParams


def line_total_columns() -> list[Column]:
    """Aggregates over the lines of a document: count, all amounts valid, sum of the valid amounts."""
    amount = safe_decimal(F.col("amount"))
    return [
        F.count(F.lit(1)).alias("line_count"), F.bool_and(amount.isNotNull()).alias("lines_valid"),
        F.sum(amount).cast("decimal(38,2)").alias("line_sum"),
    ]


def line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("document_id").agg(*line_total_columns())


def invoice_totals(invoices: DataFrame) -> DataFrame:
    """Per document: invoice count, all totals valid, sum of the valid totals."""
    return invoices.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.bool_and(F.col("total_amount").isNotNull()).alias("invoices_valid"),
        F.sum("total_amount").cast("decimal(38,2)").alias("invoice_sum"),
    )


def reconcile(documents: DataFrame, lines: DataFrame, invoices: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Documents with both totals and the two differences; a difference exists only over valid data.

    ``totals`` are line totals computed before.
    """
    totals = line_totals(lines) if totals is None else totals.select("document_id", "line_count", "lines_valid", "line_sum")
    total = F.col("total_amount")
    return (
        documents.select("document_id", "total_amount")
        .join(totals, "document_id", "left")
        .join(invoice_totals(invoices), "document_id", "left")
        .withColumn("line_diff", F.when(F.col("lines_valid"), F.abs(total - F.col("line_sum"))))
        .withColumn("invoice_diff", F.when(F.col("invoices_valid"), F.abs(total - F.col("invoice_sum"))))
    )


def header_line_check():
    """(condition, finding) over reconciled documents."""
    diff = F.col("line_diff").cast("decimal(38,2)")
    return diff > 0, finding_row(
        "header_line",
        F.lit("document"),
        amount=diff,
        title=F.concat(F.lit("明细合计与申报总额相差 "), diff.cast("string"), F.lit(" 元")),
        actual={"sum_line_items": F.col("line_sum")},
        expected={"document_total": F.col("total_amount")},
    )


def invoice_sum_check():
    """(condition, finding) over reconciled documents."""
    diff = F.col("invoice_diff").cast("decimal(38,2)")
    return diff > 0, finding_row(
        "invoice_sum",
        F.lit("document"),
        amount=diff,
        title=F.concat(F.lit("发票合计与申报总额相差 "), diff.cast("string"), F.lit(" 元")),
        actual={"sum_invoices": F.col("invoice_sum")},
        expected={"document_total": F.col("total_amount")},
    )


def tax_check(params: AuditParams = DEFAULTS):
    """(condition, finding) over invoices: total differs from untaxed plus tax."""
    total, untaxed, tax = F.col("total_amount"), F.col("untaxed_amount"), F.col("tax_amount")
    diff = F.abs(total - (untaxed + tax)).cast("decimal(38,2)")
    bad = (diff > F.lit(params.tax_tolerance).cast("decimal(38,2)")) & ((untaxed > 0) | (tax > 0))
    return bad, finding_row(
        "tax",
        F.col("invoice_key"),
        amount=diff,
        title=F.concat(F.lit("发票价税相差 "), diff.cast("string"), F.lit(" 元")),
        actual={"untaxed_plus_tax": untaxed + tax},
        expected={"total_amount": total, "tolerance": F.lit(params.tax_tolerance)},
    )


def manual_check():
    """(condition, finding) over invoices: amounts changed by hand."""
    return F.col("is_manual_modified"), finding_row(
        "manual",
        F.col("invoice_key"),
        title=F.concat(F.lit("发票金额经人工修改: "), F.coalesce("invoice_number", F.lit("未知"))),
        actual={"manual_amount": F.coalesce(F.col("total_amount").cast("string"), F.lit("UNKNOWN"))},
        expected={
            "ocr_extracted_amount": F.coalesce(
                F.col("original_extracted_amount").cast("string"), F.lit("UNKNOWN")
            )
        },
    )


def header_line_mismatch(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """R01: document total against the sum of its lines."""
    facts = (
        documents.select("document_id", "total_amount")
        .join(line_totals(lines), "document_id")
        .withColumn("line_diff", F.when(F.col("lines_valid"), F.abs(F.col("total_amount") - F.col("line_sum"))))
    )
    return emit_where(facts, [header_line_check()])


def invoice_sum_mismatch(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """R02: document total against the sum of its invoices."""
    facts = (
        documents.select("document_id", "total_amount")
        .join(invoice_totals(invoices), "document_id")
        .withColumn(
            "invoice_diff", F.when(F.col("invoices_valid"), F.abs(F.col("total_amount") - F.col("invoice_sum")))
        )
    )
    return emit_where(facts, [invoice_sum_check()])


def tax_mismatch(invoices: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """R05: total, untaxed and tax of one invoice; skipped when one of them is missing."""
    return emit_where(invoices, [tax_check(params)])


def manual_override(invoices: DataFrame) -> DataFrame:
    """R07: fires on the flag alone, even when tax fields are missing."""
    return emit_where(invoices, [manual_check()])


def amount_findings(documents: DataFrame, lines: DataFrame, invoices: DataFrame,
                    params: AuditParams = DEFAULTS) -> DataFrame:
    """All amount rules: one pass over the invoices, one over the reconciled documents."""
    known = documents.where(F.col("total_amount").isNotNull())
    return union_findings([
        emit_where(reconcile(known, lines, invoices), [header_line_check(), invoice_sum_check()]),
        emit_where(invoices, [manual_check(), tax_check(params)]).join(
            known.select("document_id"), "document_id", "left_semi"
        ),
    ])


# Reasons joined by a full-width semicolon, lines first.
LINES_SKIPPED = "部分明细行金额缺失或非法，跳过明细累加比对"
INVOICES_SKIPPED = "部分发票金额缺失或非法，跳过发票汇总比对"
TOTAL_MISSING = "DATA_MISSING: CORE_TOTAL_AMOUNT_MISSING"
RUN_OK = "执行成功"


def amount_role_status(reconciled: DataFrame) -> DataFrame:
    """Role status of the amount checks per document (AM5, AM6)."""
    known = F.col("total_amount").isNotNull()
    lines_bad = known & ~F.coalesce("lines_valid", F.lit(True))
    invoices_bad = known & ~F.coalesce("invoices_valid", F.lit(True))
    reason = F.concat_ws("；", F.when(lines_bad, F.lit(LINES_SKIPPED)), F.when(invoices_bad, F.lit(INVOICES_SKIPPED)))
    degraded = lines_bad | invoices_bad
    return reconciled.select(
        "document_id",
        F.lit("amount_agent").alias("role"),
        F.when(~known, F.lit("FAILED")).when(degraded, F.lit("DEGRADED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.when(~known, F.lit(TOTAL_MISSING)).when(degraded, reason).otherwise(F.lit(RUN_OK)).alias("reason"),
        F.when(known, F.lit("DETERMINISTIC_RULE")).alias("source"),
        (known & degraded).alias("is_degraded"),
    )


def unbalanced_requests(documents: DataFrame, lines: DataFrame, params: AuditParams = DEFAULTS) -> DataFrame:
    """AM7: documents to reject before they are stored, total and lines differ by more than a cent."""
    return (
        documents.select("document_id", "total_amount")
        .join(line_totals(lines), "document_id")
        .withColumn("difference", F.abs(F.col("total_amount") - F.col("line_sum")).cast("decimal(38,2)"))
        .where(F.col("lines_valid"))
        .where(F.col("difference") > F.lit(params.balance_tolerance).cast("decimal(38,2)"))
        .select("document_id", "total_amount", "line_sum", "difference")
    )
