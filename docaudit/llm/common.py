"""Session settings and small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docaudit.session import materialize, tune

#: Rows and bytes in one Arrow batch: what a Python worker holds at once.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

#: Stands for a missing doc_id where an order is needed: after every real id.
NULL_ID = 2**63 - 1


def ready(spark: SparkSession) -> SparkSession:
    """Adaptive execution with skew splitting, and Arrow batches of bounded size."""
    tune(spark)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def store(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lost executors recompute nothing beyond it, plans stay small."""
    return materialize(df)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of a table that may hold any other columns."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def id_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name), F.lit(NULL_ID))


def bounded_sample(df: DataFrame, group: str, n: int) -> DataFrame:
    """At most ``n`` doc_ids of every value of ``group``, chosen by a hash of doc_id: (doc_id, group, n), stored.

    Counts set how much of the hash range a group needs, so the ordering sees little more than ``n`` rows of a group
    however large it is. The result has at most ``n`` rows a group.
    """
    counts = store(df.groupBy(group).agg(F.count("*").alias("rows")))  # stored, so its size is known when the join is planned
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    few = df.select("doc_id", group).join(counts, group).where(draw <= F.lit(1.5 * n * (1 << 30)) / F.col("rows"))
    order = Window.partitionBy(group).orderBy(draw, "doc_id")
    return store(few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("doc_id", group, "n"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name the table does not have yet."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of one is about ``limit`` bytes, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size or 0
        yield batch.slice(first)
