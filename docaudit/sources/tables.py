"""Reads over stored audit tables: filtered scans, natural keys, parent with children, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docaudit import schemas

TABLES = {
    "documents": schemas.DOCUMENTS, "lines": schemas.LINES, "invoices": schemas.INVOICES, "points": schemas.POINTS,
    "segments": schemas.SEGMENTS, "suppliers": schemas.SUPPLIERS, "purpose_verdicts": schemas.PURPOSE_VERDICTS,
    "scope_verdicts": schemas.SCOPE_VERDICTS, "tokens": schemas.TOKENS, "role_status": schemas.ROLE_STATUS,
    "actions": schemas.ACTIONS, "events": schemas.EVENTS,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored audit table with its declared schema (no inference)."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def equal_filters(**filters) -> Column:
    """AND of column equalities; a filter whose value is None is ignored."""
    cond = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            cond = cond & (F.col(name) == value)
    return cond


def filtered_scan(df: DataFrame, order: list[str], skip: int = 0, limit: int = 100, **filters) -> DataFrame:
    """IO1: a page of the rows that match all given equalities, in a stated order."""
    return df.where(equal_filters(**filters)).orderBy(*order).offset(skip).limit(limit)


def filtered_count(df: DataFrame, **filters) -> DataFrame:
    """IO2: number of rows that match all given equalities."""
    return df.where(equal_filters(**filters)).agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, column: str, values: list) -> DataFrame:
    """IO3: rows by natural key; the predicate reaches the Parquet scan."""
    return df.where(F.col(column).isin(values))


def with_children(
    documents: DataFrame, lines: DataFrame, attachments: DataFrame, invoices: DataFrame, users: DataFrame
) -> DataFrame:
    """IO4: one row per document with child counts, sums and the applicant's name.

    Every child is aggregated before its join, so no child multiplies another one and no list of
    children is built.
    """
    line = lines.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.max("line_no").alias("last_line_no")
    )
    attachment = attachments.groupBy("document_id").agg(F.count(F.lit(1)).alias("attachment_count"))
    invoice = invoices.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("invoice_count"), F.sum("total_amount").cast("decimal(38,2)").alias("invoice_sum")
    )
    out = documents
    for child in (line, attachment, invoice):
        out = out.join(child, "document_id", "left")
    names = users.select(F.col("user_id").alias("applicant_id"), F.col("real_name").alias("applicant_name"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("line_count", "attachment_count", "invoice_count")}
    return out.join(names, "applicant_id", "left").withColumns(counts)


def payload_value(df: DataFrame, key: str) -> Column:
    """IO5: the column of that name when filled, else the field of ``raw_payload``."""
    own = F.nullif(F.col(key).cast("string"), F.lit("")) if key in df.columns else F.lit(None).cast("string")
    return F.coalesce(own, F.nullif(F.get_json_object("raw_payload", f"$.{key}"), F.lit("")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """IO6: uploaded files with content hash, extension, size and stored name; content is not kept."""
    name = F.element_at(F.split("path", "/"), -1)
    dot = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    digest = F.sha2(F.col("content"), 256)
    extension = F.when(dot == "", F.lit(".pdf")).otherwise(F.lower(dot))
    return spark.read.format("binaryFile").load(path).select(
        name.alias("file_name"),
        F.upper(F.substring(extension, 2, 20)).alias("file_type"),
        digest.alias("file_hash"),
        F.col("length").alias("file_size_bytes"),
        F.concat(F.lit("inv_"), digest, extension).alias("stored_name"),
    )


def text_fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """IO6 over a table of texts: hash and byte length of the whole content."""
    return df.select(key, F.sha2(F.col(text), 256).alias("file_hash"), F.octet_length(text).cast("bigint").alias("file_size_bytes"))


def read_event_stream(spark: SparkSession, folder: str, delay: str = "10 minutes", max_files: int = 1000) -> DataFrame:
    """IO10: audit events as a stream of Parquet files with a watermark on the event time.

    The watermark bounds the state of operators that keep some; ``jobs.ConsumeOnce`` and the handlers need none and
    drop no late row.
    """
    return (
        spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)
        .withWatermark("occurred_at", delay)
    )
