"""Supplier rules: registration code, court record, shell companies, business scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docaudit import params as P
from docaudit.functions.findings import emit_where, finding_row
from docaudit.functions.ordered import first_per_key
from docaudit.functions.scalars import blank_to_null, is_abnormal_status, safe_bool, uscc_valid

HEURISTIC = "HEURISTIC_RULE"
PROFILE_MISSING = "SUPPLIER_PROFILE_MISSING"
SCOPE_MISSING = "SUPPLIER_BUSINESS_SCOPE_MISSING"
SCOPE_FALLBACK = "SUPPLIER_SCOPE_FALLBACK_RULE"
IDENTITY_MISSING = "DATA_MISSING: SUPPLIER_IDENTITY_MISSING"


def document_suppliers(invoices: DataFrame) -> DataFrame:
    """SU1: distinct suppliers of a document by normalized code; the first name wins."""
    return (
        invoices.select(
            "document_id", "invoice_key",
            F.upper(blank_to_null(F.col("seller_tax_id"))).alias("uscc"),
            blank_to_null(F.col("seller_name")).alias("name"),
        )
        .where(F.col("uscc").isNotNull() & F.col("name").isNotNull())
        .groupBy("document_id", "uscc")
        .agg(F.min_by("name", "invoice_key").alias("name"))
    )


def supplier_profiles(suppliers: DataFrame) -> DataFrame:
    """SU2: one profile per normalized code with the reference defaults filled in."""
    one = first_per_key(
        suppliers.withColumn("_code", F.upper(blank_to_null(F.col("uscc")))).where(F.col("_code").isNotNull()),
        ["_code"], [F.col("uscc").desc()],
    )
    scope = F.coalesce(F.nullif("business_scope", F.lit("")), F.get_json_object("risk_tags", "$.business_scope"))
    return one.select(
        F.col("_code").alias("uscc"),
        "supplier_name",
        F.coalesce("is_dishonest", F.lit(False)).alias("is_dishonest"),
        F.coalesce(F.nullif("operating_status", F.lit("")), F.lit("存续")).alias("operating_status"),
        F.coalesce("is_shell_company", F.lit(False)).alias("is_shell_company"),
        scope.alias("business_scope"),
    )


def corporate_suppliers(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """The suppliers of corporate documents, with the title of the document."""
    titles = documents.where(F.col("document_type").isin(*P.CORPORATE_TYPES)).select("document_id", "title")
    return document_suppliers(invoices).join(titles, "document_id")


def supplier_facts(
    documents: DataFrame, invoices: DataFrame, suppliers: DataFrame, verdicts: DataFrame,
    failures: DataFrame | None = None, named: DataFrame | None = None,
) -> DataFrame:
    """One row per (document, supplier) with everything the supplier rules look at.

    ``failures`` (document_id, uscc, error) marks suppliers whose check did not finish. ``named`` are corporate suppliers
    computed before.
    """
    given = verdicts.select(
        "document_id", F.upper(blank_to_null(F.col("uscc"))).alias("uscc"),
        safe_bool(F.col("verdict")).alias("_verdict"), "analysis", F.col("source").alias("_source"),
    )
    facts = (
        (corporate_suppliers(documents, invoices) if named is None else named)
        .join(given, ["document_id", "uscc"], "left")
        .join(supplier_profiles(suppliers).withColumn("profile_found", F.lit(True)), "uscc", "left")
    )
    if failures is not None:
        facts = facts.join(failures.select("document_id", "uscc", "error"), ["document_id", "uscc"], "left")
    else:
        facts = facts.withColumn("error", F.lit(None).cast("string"))
    found = F.coalesce("profile_found", F.lit(False))
    has_title = F.coalesce("title", F.lit("")) != ""
    has_scope = blank_to_null(F.col("business_scope")).isNotNull()
    asked = found & has_title & has_scope
    source = F.when(F.col("_verdict").isNull(), F.lit(HEURISTIC)).otherwise(
        F.coalesce("_source", F.lit("LLM_INFERENCE"))
    )
    return facts.select(
        "document_id", "uscc",
        F.coalesce(F.nullif("supplier_name", F.lit("")), "name").alias("supplier_name"),
        "title", "error", "analysis",
        found.alias("profile_found"),
        uscc_valid(F.col("uscc")).alias("code_valid"),
        (found & F.col("is_dishonest")).alias("dishonest"),
        F.when(found, F.col("operating_status")).alias("operating_status"),
        (found & is_abnormal_status(F.col("operating_status"))).alias("abnormal"),
        (found & F.col("is_shell_company")).alias("shell"),
        F.when(asked, F.coalesce("_verdict", F.lit(True))).alias("scope_match"),
        F.when(asked, source).alias("scope_source"),
        F.when(~found, F.lit(PROFILE_MISSING))
        .when(has_title & ~has_scope, F.lit(SCOPE_MISSING))
        .when(asked & (source == HEURISTIC), F.lit(SCOPE_FALLBACK))
        .alias("degraded_reason"),
    )


SUPPLIER_RULES = ("unregistered", "dishonest", "shell", "scope")


def supplier_findings(facts: DataFrame, rules: tuple[str, ...] = SUPPLIER_RULES) -> DataFrame:
    """R12, R13, R15 and R17, or those asked for, in one pass over the supplier facts."""
    name = F.col("supplier_name")
    ok = F.col("error").isNull()

    def row(rule: str, text: str, actual: dict, expected: dict):
        return finding_row(
            rule, F.col("uscc"), title=F.concat(F.lit("供应商 "), name, F.lit(text)), actual=actual, expected=expected
        )

    state = {"operating_status": F.col("operating_status"), "is_shell_company": F.col("shell")}
    scope = {
        "purchase_desc": F.col("title"),
        "source": F.col("scope_source"),
        "is_degraded": F.col("scope_source") == HEURISTIC,
    }
    checks = {
        "unregistered": (ok & ~F.col("code_valid"), row("unregistered", " 登记代码非法", {"uscc": F.col("uscc")}, {"is_valid_uscc": F.lit(True)})),
        "dishonest": (ok & F.col("dishonest"), row("dishonest", " 为失信被执行人", {"is_dishonest": F.lit(True)}, {"is_dishonest": F.lit(False)})),
        "shell": (ok & (F.col("abnormal") | F.col("shell")), row("shell", " 经营状态异常", state, {"operating_status": F.lit("存续")})),
        "scope": (ok & ~F.col("scope_match"), row("scope", " 经营范围不符", scope, {"is_scope_matched": F.lit(True)})),
    }
    return emit_where(facts, [checks[rule] for rule in rules])


def profile_findings(
    documents: DataFrame, invoices: DataFrame, suppliers: DataFrame, rule: str, failures: DataFrame | None = None
) -> DataFrame:
    """R13 ("dishonest") or R15 ("shell") alone: both need a conspicuous profile.

    Such profiles are few, so they are picked before invoices are read, and invoices of other suppliers are left out
    before suppliers are made distinct per document.
    """
    profiles = supplier_profiles(suppliers)
    abnormal = is_abnormal_status(F.col("operating_status"))
    hit = F.col("is_dishonest") if rule == "dishonest" else F.col("is_shell_company") | abnormal
    picked = profiles.where(hit)
    code = F.upper(blank_to_null(F.col("seller_tax_id")))
    named = invoices.where(blank_to_null(F.col("seller_name")).isNotNull()).withColumn("_code", code)
    claimed = named.join(picked.select(F.col("uscc").alias("_code")), "_code", "left_semi")
    corporate = documents.where(F.col("document_type").isin(*P.CORPORATE_TYPES)).select("document_id")
    facts = document_suppliers(claimed).join(corporate, "document_id").join(picked, "uscc")
    if failures is not None:
        failed = failures.where(F.col("error").isNotNull()).select("document_id", "uscc")
        facts = facts.join(failed, ["document_id", "uscc"], "left_anti")
    facts = facts.select(
        "document_id", "uscc", F.coalesce(F.nullif("supplier_name", F.lit("")), "name").alias("supplier_name"),
        F.lit(None).cast("string").alias("error"), F.col("is_dishonest").alias("dishonest"), "operating_status",
        abnormal.alias("abnormal"), F.col("is_shell_company").alias("shell"), F.lit("").alias("title"), F.lit("").alias("scope_source"),
        F.lit(True).alias("scope_match"), F.lit(True).alias("code_valid"),
    )
    return supplier_findings(facts, (rule,))


def supplier_role_status(facts: DataFrame) -> DataFrame:
    """SU8: role status per document from its suppliers."""
    total, ok, degraded = F.col("total"), F.col("ok"), F.col("degraded")
    counts = facts.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNull() & F.col("degraded_reason").isNotNull()).alias("degraded"),
    )
    status = (
        F.when((ok == total) & (degraded == 0), F.lit("SUCCESS"))
        .when(ok > 0, F.lit("DEGRADED"))
        .otherwise(F.lit("FAILED"))
    )
    return counts.select(
        "document_id",
        F.lit("supplier_agent").alias("role"),
        status.alias("status"),
        F.concat_ws(
            ", ",
            F.concat(F.lit("完成 "), ok.cast("string"), F.lit("/"), total.cast("string")),
            F.when(degraded > 0, F.concat(F.lit("降级 "), degraded.cast("string"))),
        ).alias("reason"),
        F.when(degraded > 0, F.lit(HEURISTIC)).otherwise(F.lit("LLM_INFERENCE")).alias("source"),
        ((degraded > 0) | (status == "DEGRADED")).alias("is_degraded"),
    )
