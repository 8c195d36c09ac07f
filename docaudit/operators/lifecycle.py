"""Document lifecycle as table jobs over request, task and status logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docaudit import params as P
from docaudit.functions.ordered import HOT_ROWS, Step, chunked_lag, chunked_scan, first_per_key


def idempotent_create(requests: DataFrame, order: list[str]) -> DataFrame:
    """LC1: the first request per idempotency key; requests without a key are all kept."""
    keyed = requests.where(F.col("idempotency_key").isNotNull())
    first = first_per_key(keyed, ["idempotency_key"], [F.col(c) for c in order])
    return first.unionByName(requests.where(F.col("idempotency_key").isNull()))


def one_task_per_version(submissions: DataFrame) -> DataFrame:
    """LC2: every submission with the task it gets; later ones of a version reuse the first task."""
    first = submissions.groupBy("document_id", "audit_version").agg(
        F.min(F.struct("submitted_at", "task_id")).alias("first")
    )
    return submissions.join(first, ["document_id", "audit_version"]).select(
        "document_id", "audit_version", F.col("task_id").alias("requested_task"),
        F.col("first.task_id").alias("task_id"), (F.col("task_id") != F.col("first.task_id")).alias("reused"),
    )


def _with_previous(events: DataFrame) -> DataFrame:
    """Status events with the state before each one."""
    moves = chunked_lag(events, ["document_id"], ["occurred_at", "event_id"], ["status"])
    return moves.withColumn("from_status", F.coalesce("prev.status", F.lit("DRAFT"))).drop("prev")


def is_resubmission(from_status: Column, to_status: Column) -> Column:
    return (to_status == "SUBMITTED") & from_status.isin(*P.RESUBMITTABLE)


def assign_versions(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """LC3: version of a document after each status event; a resubmission adds one."""
    flagged = _with_previous(events).withColumn("_step", is_resubmission(F.col("from_status"), F.col("status")).cast("int"))
    counted = chunked_scan(flagged, ["document_id"], ["occurred_at", "event_id"], {"_run": Step("sum", F.col("_step"), inclusive=True)}, hot_rows)
    return counted.select("document_id", "event_id", "from_status", "status", (1 + F.coalesce("_run", F.lit(0))).cast("int").alias("version"))


def allowed_transition(from_status: Column, to_status: Column) -> Column:
    """True for a submit or cancel from an allowed state; other moves belong to the audit itself."""
    submit = (to_status == "SUBMITTED") & from_status.isin(*P.SUBMITTABLE)
    cancel = (to_status == "CANCELLED") & from_status.isin(*P.CANCELLABLE)
    return submit | cancel | ~to_status.isin("SUBMITTED", "CANCELLED")


def transition_violations(events: DataFrame) -> DataFrame:
    """LC4: submits and cancels from a state that does not allow them."""
    moves = _with_previous(events)
    return moves.where(~allowed_transition(F.col("from_status"), F.col("status"))).select(
        "document_id", "event_id", "from_status", "status"
    )


def edit_violations(edits: DataFrame, documents: DataFrame) -> DataFrame:
    """LC4: edits of documents that are neither draft nor rejected."""
    closed = documents.where(~F.col("status").isin(*P.EDITABLE)).select("document_id", "status")
    return edits.join(closed, "document_id")


def status_log(events: DataFrame) -> DataFrame:
    """LC9: (from, to, operator, comment) per change of state; submissions and cancellations get a comment."""
    moves = _with_previous(events)
    comment = (
        F.when(is_resubmission(F.col("from_status"), F.col("status")), F.lit("RESUBMIT"))
        .when(F.col("status") == "SUBMITTED", F.lit("SUBMIT"))
        .when(F.col("status") == "CANCELLED", F.lit("CANCEL"))
    )
    return moves.where(F.col("status") != F.col("from_status")).select(
        "document_id", "event_id", "from_status", F.col("status").alias("to_status"), "operator_id", comment.alias("comment")
    )


def latest_reports(reports: DataFrame) -> DataFrame:
    """LC5: newest report per document by creation time, then id."""
    return first_per_key(reports, ["document_id"], [F.col("created_at").desc(), F.col("report_id").desc()])


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """LC5: newest task per document and version."""
    return first_per_key(tasks, ["document_id", "audit_version"], [F.col("task_id").desc()])


def cancel_cascade(cancelled: DataFrame, instances: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LC6: running instances of cancelled documents and their pending tasks become CANCELLED."""
    gone = cancelled.select("document_id").distinct().withColumn("_gone", F.lit(True))
    marked = instances.join(gone, "document_id", "left")
    hit = F.coalesce("_gone", F.lit(False)) & (F.col("status") == "RUNNING")
    new_instances = marked.withColumn("_hit", hit).withColumn(
        "status", F.when(F.col("_hit"), F.lit("CANCELLED")).otherwise(F.col("status"))
    )
    stopped = new_instances.where("_hit").select("instance_id").withColumn("_stopped", F.lit(True))
    new_tasks = tasks.join(stopped, "instance_id", "left").withColumn(
        "status",
        F.when(F.coalesce("_stopped", F.lit(False)) & (F.col("status") == "PENDING"), F.lit("CANCELLED")).otherwise(F.col("status")),
    )
    return new_instances.drop("_gone", "_hit"), new_tasks.drop("_stopped")


def link_attachments(invoices: DataFrame, attachments: DataFrame) -> DataFrame:
    """LC7: attachment of every invoice by hash; a missing one is derived from number and path.

    Several attachments of a document may share a hash: the last one wins.
    """
    by_hash = attachments.groupBy("document_id", F.col("file_hash").alias("invoice_hash")).agg(
        F.max("attachment_key").alias("attachment_key")
    )
    extension = F.regexp_extract(F.coalesce("file_path", F.lit("")), r"(\.[^./]*)$", 1)
    ext = F.when(extension == "", F.lit(".png")).otherwise(extension)
    made = F.concat(F.lit("发票_"), F.coalesce("invoice_number", F.lit("None")), ext)
    return invoices.join(by_hash, ["document_id", "invoice_hash"], "left").select(
        "document_id", "invoice_key", "attachment_key",
        F.col("attachment_key").isNull().alias("is_derived"),
        F.when(F.col("attachment_key").isNull(), made).alias("derived_name"),
        F.when(F.col("attachment_key").isNull(), F.upper(F.substring(ext, 2, 20))).alias("derived_type"),
    )


def ingest_defaults(invoices: DataFrame, zero_fill_total: bool = False) -> DataFrame:
    """LC8: defaults of a stored invoice. A missing total stays missing unless ``zero_fill_total``."""
    unknown = F.concat(F.lit("UNKNOWN_"), F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "invoice_key"), 256))
    total = F.coalesce("total_amount", F.lit(0).cast("decimal(14,2)")) if zero_fill_total else F.col("total_amount")
    return invoices.withColumns({
        "invoice_code": F.coalesce(F.nullif("invoice_code", F.lit("")), F.lit("NONE")),
        "invoice_number": F.coalesce(F.nullif("invoice_number", F.lit("")), unknown),
        "invoice_type": F.coalesce(F.nullif("invoice_type", F.lit("")), F.lit("增值税电子普通发票")),
        "total_amount": total,  # of any size: extraction returns amounts beyond 14 digits
    })
