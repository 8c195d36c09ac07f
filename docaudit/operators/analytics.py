"""Report queries: dashboard aggregates, role-scoped listings, access, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit import params as P
from docaudit.functions.ordered import first_per_key
from docaudit.functions.scalars import contains_any
from docaudit.operators.lifecycle import latest_reports
from docaudit.params import DEFAULTS, AuditParams
from docaudit.session import materialize

UNASSIGNED = "未分配部门"


def totals(documents: DataFrame) -> DataFrame:
    """DA1: document count and sum of totals."""
    return documents.agg(
        F.count(F.lit(1)).alias("total_documents"), F.sum("total_amount").cast("decimal(38,2)").alias("total_amount")
    )


def blocked_amount(documents: DataFrame, reports: DataFrame, latest_only: bool = False) -> DataFrame:
    """DA2: sum of totals over high reports; a document with two of them counts twice unless ``latest_only``.

    High reports are counted per document before the join.
    """
    source = latest_reports(reports) if latest_only else reports
    high = source.where("overall_risk_level = 'high'").groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    return documents.join(high, "document_id").agg(
        F.sum(F.col("total_amount") * F.col("_n")).cast("decimal(38,2)").alias("blocked_amount")
    )


def risk_distribution(reports: DataFrame) -> DataFrame:
    """DA3: counts per level, share of low reports in percent, mean score."""
    level = F.col("overall_risk_level")
    known = F.count_if(level.isin("high", "medium", "low"))
    return reports.agg(
        *[F.count_if(level == name).alias(f"{name}_count") for name in ("high", "medium", "low")],
        F.round(F.count_if(level == "low") * 100.0 / F.greatest(known, F.lit(1)), 1).cast("double").alias("auto_pass_rate"),
        F.round(F.avg("final_score"), 1).alias("avg_score"),
    )


def top_rules(findings: DataFrame, n: int = 5) -> DataFrame:
    """DA4: the n most frequent rules; the limit is the report itself."""
    return (
        findings.groupBy("rule_code", "rule_name", "risk_level").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "rule_code", "rule_name", "risk_level").limit(n)
    )


def department_stats(documents: DataFrame, reports: DataFrame) -> DataFrame:
    """DA5: documents, sum and share of documents without a high report, per department."""
    high = reports.where("overall_risk_level = 'high'").select("document_id").distinct().withColumn("_high", F.lit(True))
    return documents.join(high, "document_id", "left").groupBy(
        F.coalesce(F.nullif("department_name", F.lit("")), F.lit(UNASSIGNED)).alias("department_name")
    ).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.sum("total_amount").cast("decimal(38,2)").alias("total_amount"),
        F.round(F.count_if(F.col("_high").isNull()) * 100.0 / F.count(F.lit(1)), 1).cast("double").alias("compliance_rate"),
    )


def daily_trend(reports: DataFrame, days: int = 7) -> DataFrame:
    """DA6: reviews and high-risk reviews per day over the last days of the data, empty days included."""
    day = F.to_date("created_at")
    last = reports.agg(F.max(day).alias("_last"))
    calendar = last.where("_last is not null").select(
        F.explode(F.sequence(F.date_sub("_last", days - 1), F.col("_last"))).alias("day")
    )
    counted = reports.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("review_count"), F.count_if(F.col("overall_risk_level") == "high").alias("high_risk_count")
    )
    return calendar.join(counted, "day", "left").select(
        "day", F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("high_risk_count", F.lit(0)).alias("high_risk_count"),
    )


def recent_activities(documents: DataFrame, users: DataFrame, n: int = 6) -> DataFrame:
    """DA7: the newest documents with the applicant's name; the limit is the report itself."""
    newest = documents.orderBy(F.col("created_at").desc(), F.col("document_id").desc()).limit(n)
    names = users.select(F.col("user_id").alias("applicant_id"), "real_name")
    return newest.join(names, "applicant_id", "left").select(
        "document_id", "document_no", "title",
        F.coalesce("real_name", F.lit("经办员工")).alias("applicant_name"),
        F.coalesce("department_name", F.lit("通用部门")).alias("department_name"),
        "total_amount", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
    )


def _large(params: AuditParams) -> Column:
    return F.coalesce(F.col("total_amount") >= F.lit(params.cfo_limit).cast("decimal(14,2)"), F.lit(False))


def _with_high(documents: DataFrame, reports: DataFrame) -> DataFrame:
    high = reports.where("overall_risk_level = 'high'").select("document_id").distinct()
    return documents.join(high.withColumn("_high", F.lit(True)), "document_id", "left").withColumn(
        "_high", F.coalesce("_high", F.lit(False))
    )


def list_documents(
    documents: DataFrame, reports: DataFrame, *, user_id: int, roles: tuple[str, ...], department: str | None = None,
    applicant_id: int | None = None, status: str | None = None, document_type: str | None = None,
    params: AuditParams = DEFAULTS,
) -> DataFrame:
    """DA8: documents a user may list; the first matching role decides the scope."""
    own = F.col("applicant_id") == user_id
    open_to_others = F.col("status") != "DRAFT"
    source = documents
    if "ADMIN" in roles:
        scope = F.lit(True)
    elif "CFO" in roles:
        source = _with_high(documents, reports)
        scope = _large(params) | F.col("_high") | own
    elif "FINANCE" in roles:
        scope = open_to_others | own
    elif "MANAGER" in roles and department:
        scope = (F.coalesce(F.col("department_name") == department, F.lit(False)) & open_to_others) | own
    else:
        scope = own
    wanted = {"applicant_id": applicant_id, "status": status, "document_type": document_type}
    for name, value in wanted.items():
        if value:
            scope = scope & (F.col(name) == value)
    return source.where(scope).select(*documents.columns)


def list_page(listed: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a listing, newest first."""
    return (
        listed.orderBy(F.col("created_at").desc(), F.col("document_id").desc())
        .offset((page - 1) * page_size).limit(page_size)
    )


def list_after(listed: DataFrame, created_at, document_id: int | None, page_size: int = 20) -> DataFrame:
    """The rows after a known one, newest first: a task keeps ``page_size`` rows however deep the page lies."""
    if document_id is None:
        return list_page(listed, 1, page_size)
    at = F.lit(created_at)
    later = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("document_id") < document_id))
    return list_page(listed.where(later), 1, page_size)


def listing_total(listed: DataFrame) -> DataFrame:
    """Number of rows of a listing, for its pages."""
    return listed.agg(F.count(F.lit(1)).alias("n"))


def user_roles(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """DA12: one row per user with a flag per role and their number."""
    flags = [F.bool_or(F.col("role_code") == r).alias(f"is_{r.lower()}") for r in ("ADMIN", "CFO", "FINANCE", "MANAGER")]
    grouped = memberships.groupBy("user_id").agg(*flags, F.count_distinct("role_code").alias("role_count"))
    return users.select("user_id", "department_name").join(grouped, "user_id", "left")


def access_checks(
    requests: DataFrame, documents: DataFrame, reports: DataFrame, users: DataFrame, memberships: DataFrame,
    params: AuditParams = DEFAULTS,
) -> DataFrame:
    """DA9: may the user of a request (user_id, document_id) see the document; roles add up.

    The newest report decides whether a document is high.
    """
    high = latest_reports(reports).select("document_id", (F.col("overall_risk_level") == "high").alias("_high"))
    who = user_roles(users, memberships).withColumnRenamed("department_name", "_department")
    facts = (
        requests.join(
            documents.select("document_id", "applicant_id", "total_amount", "department_name", "status"), "document_id"
        )
        .join(high, "document_id", "left")
        .join(who, "user_id", "left")
    )

    def has(flag: str) -> Column:
        return F.coalesce(F.col(flag), F.lit(False))

    submitted = F.coalesce(F.col("status") != "DRAFT", F.lit(False))
    same = F.coalesce(F.col("department_name") == F.col("_department"), F.lit(False))
    allowed = (
        has("is_admin")
        | F.coalesce(F.col("applicant_id") == F.col("user_id"), F.lit(False))
        | (has("is_cfo") & (_large(params) | has("_high")))
        | (has("is_finance") & submitted)
        | (has("is_manager") & same & submitted)
    )
    return facts.select("user_id", "document_id", allowed.alias("allowed"))


def citations(questions: DataFrame, findings: DataFrame) -> DataFrame:
    """DA10: findings a question refers to; without a match the first two of the document.

    A question matches a finding when it holds the rule name, the title or a generic word. The
    fallback uses the two first findings per document only. Findings of documents that nobody asks about are
    left out first: the documents asked about are stored, so that few of them are broadcast and no finding moves.
    """
    asked = questions.withColumn("_text", F.lower("message")).withColumn(
        "_generic", contains_any(F.col("_text"), P.GENERIC_QUESTION_WORDS)
    )
    about = materialize(questions.select("document_id").distinct())
    known = findings.select("document_id", "finding_id", "rule_code", "rule_name", "title").join(about, "document_id", "left_semi")
    matched = asked.join(known, "document_id").where(
        F.col("_generic") | F.col("_text").contains(F.lower("rule_name")) | F.col("_text").contains(F.lower("title"))
    ).select("message_id", "document_id", "finding_id", "rule_code", "title")
    first_two = first_per_key(known, ["document_id"], [F.col("finding_id")], 2)
    unmatched = asked.join(matched.select("message_id").distinct(), "message_id", "left_anti")
    fallback = unmatched.join(first_two, "document_id").select("message_id", "document_id", "finding_id", "rule_code", "title")
    return matched.unionByName(fallback)


def role_summary(runs: DataFrame) -> DataFrame:
    """DA11: runs, findings and durations per role and status."""
    return runs.groupBy("role", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("findings_count").alias("findings"),
        F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
    )
