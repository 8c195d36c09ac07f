"""Writers: report upsert and version snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace the rows of ``old`` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def save_results(
    old_reports: DataFrame, old_findings: DataFrame, tasks: DataFrame, new_reports: DataFrame, new_findings: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO7: reports replaced by task, findings of replaced reports deleted and rewritten, tasks completed.

    Reports and findings are keyed by task_id; a task without a row is created.
    """
    done = new_reports.select("task_id", "document_id").distinct().withColumn("_done", F.lit(True))
    reports = upsert(old_reports, new_reports, "task_id")
    findings = old_findings.join(done.select("task_id"), "task_id", "left_anti").unionByName(
        new_findings, allowMissingColumns=True
    )
    marked = tasks.join(done.withColumnRenamed("document_id", "_document"), "task_id", "full").select(
        "task_id",
        F.coalesce("document_id", "_document").alias("document_id"),
        F.when(F.col("_done"), F.lit("COMPLETED")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_done"), F.lit(100)).otherwise(F.col("progress_pct")).alias("progress_pct"),
    )
    return reports, findings, marked


class ReportStore:
    """IO7: stored reports, findings and tasks that readers always see whole and of one state.

    Each table is a set of Parquet folders, one per bucket of task_id. A save writes the buckets its tasks fall into to new
    folders and then, in one rename, a small file that names the folders of all buckets: the next version. Readers take
    the newest such file, so they see a save in all three tables or in none, and folders are never changed. A save that
    fails leaves nothing that is read; repeating one gives the same tables. The last ``keep`` versions stay readable,
    older folders that none of them names are deleted. One save runs at a time: of two, the second to finish fails and is to be repeated.
    """

    TABLES = ("reports", "findings", "tasks")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, keep: int = 8):
        """``buckets`` counts for a store that is loaded anew; choose it so that a bucket is what one task reads well."""
        self.spark, self.folder, self.buckets, self.keep = spark, folder.rstrip("/"), buckets, keep

    def load(self, reports: DataFrame, findings: DataFrame, tasks: DataFrame) -> None:
        """First content of the tables, or all of it anew."""
        state = {"buckets": self.buckets, "tables": {}}
        number = self._next()
        for name, df in zip(self.TABLES, (reports, findings, tasks)):
            state["tables"][name] = {"schema": df.schema.jsonValue(), "parts": self._write(name, df, number, self.buckets)}
        self._commit(number, state)

    def read(self, name: str) -> DataFrame:
        """A table as the newest version has it."""
        return self.tables()[name]

    def tables(self) -> dict[str, DataFrame]:
        """All three tables of one version, the newest."""
        state = self._state(self.versions()[-1])
        return {name: self._rows(state, name) for name in self.TABLES}

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        return sorted(int(n[:-5]) for n in self._list(f"{self.folder}/versions") if n.endswith(".json") and not n.startswith("."))

    def save(self, new_reports: DataFrame, new_findings: DataFrame) -> None:
        """Replace the reports of these tasks with their findings, and complete the tasks."""
        state, number = self._state(self.versions()[-1]), self._next()
        buckets = state["buckets"]
        touched = {r[0] for r in new_reports.select(_bucket(buckets)).distinct().collect()}  # at most as many numbers as buckets
        if not touched:
            return
        merged = save_results(*[self._rows(state, name, touched) for name in self.TABLES], new_reports, new_findings)
        for name, df in zip(self.TABLES, merged):
            table = state["tables"][name]
            kept = {k: path for k, path in table["parts"].items() if int(k) not in touched}
            state["tables"][name] = {"schema": df.schema.jsonValue(), "parts": kept | self._write(name, df, number, buckets)}
        self._commit(number, state)
        self._forget()

    def _rows(self, state: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        table = state["tables"][name]
        schema = StructType.fromJson(table["schema"])
        paths = [f"{self.folder}/{path}" for k, path in table["parts"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, df: DataFrame, number: int, buckets: int) -> dict[str, str]:
        """New folders of a table, by bucket; no two saves share one."""
        part = f"{name}/{number}-{uuid.uuid4().hex}"
        (
            df.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.mode("overwrite")
            .option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.folder}/{part}")
        )
        return {n[7:]: f"{part}/{n}" for n in self._list(f"{self.folder}/{part}") if n.startswith("bucket=")}

    def _next(self) -> int:
        return max(self.versions(), default=-1) + 1

    def _state(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{number}.json", wholetext=True).first()[0])

    def _commit(self, number: int, state: dict) -> None:
        made, fs = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = fs.create(made, True)
        out.write(json.dumps(state).encode())
        out.close()
        target = self._path(f"{self.folder}/versions/{number}.json")[0]
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            raise RuntimeError(f"another save has written version {number}; repeat this one")

    def _forget(self) -> None:
        """Delete versions before the last ``keep``, and the folders older than these that none of them names."""
        versions = self.versions()
        if len(versions) <= self.keep:
            return
        kept = versions[-self.keep :]
        held = {path for n in kept for t in self._state(n)["tables"].values() for path in t["parts"].values()}
        for save in [f"{name}/{n}" for name in self.TABLES for n in self._list(f"{self.folder}/{name}")]:
            if int(save.split("/")[1].split("-")[0]) < kept[0]:  # an unfinished save of such a number can no longer succeed
                parts = {f"{save}/{n}" for n in self._list(f"{self.folder}/{save}")}
                for path in parts - held if parts & held else {save}:
                    self._delete(f"{self.folder}/{path}")
        for n in versions[: -self.keep]:
            self._delete(f"{self.folder}/versions/{n}.json")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")


def _payload(df: DataFrame, fields: dict[str, str | None]):
    """JSON text of named columns; a field whose column the table lacks is null, decimals are text."""
    parts = []
    for name, column in fields.items():
        known = (column or name) in df.columns
        value = F.col(column or name) if known else F.lit(None).cast("string")
        if known and df.schema[column or name].dataType.typeName() == "decimal":
            value = value.cast("string")
        parts.append(value.alias(name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("payload")


def snapshot_rows(documents: DataFrame, lines: DataFrame, attachments: DataFrame) -> DataFrame:
    """IO8: the version snapshot as rows: one for the document, one per line, one per attachment.

    The reference packs a document into one JSON value. A document may hold very many lines, so the
    payload is stored as ordered JSON rows under (document_id, version_no, part, part_key).
    ``attachments``: document_id, attachment_key, file_path, file_hash, file_size_bytes.
    """
    names = ("document_no", "document_type", "title", "total_amount", "currency", "status", "current_version", "is_manual_override")
    head = documents.select(
        "document_id", F.col("current_version").alias("version_no"), F.lit("document").alias("part"), F.lit("").alias("part_key"),
        _payload(documents, dict.fromkeys(names)),
    )
    versions = documents.select("document_id", F.col("current_version").alias("version_no"))
    body = lines.select(
        "document_id", F.lit("line").alias("part"), F.col("line_key").alias("part_key"),
        _payload(lines, dict.fromkeys(("line_no", "expense_type", "item_desc", "amount", "city_name"))),
    )
    files = attachments.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
    proof = files.select(
        "document_id", F.lit("attachment").alias("part"), F.col("attachment_key").alias("part_key"),
        _payload(files, {"file_name": None, "file_hash": None, "file_size": "file_size_bytes"}),
    )
    parts = body.unionByName(proof).join(versions, "document_id")
    return head.unionByName(parts)
