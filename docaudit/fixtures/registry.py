"""Registry of queries over the driver tables and of the DuckDB text each one must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from docaudit.fixtures.views import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register a query; ``views`` and ``sql`` give its DuckDB counterpart."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views or [], sql)
        return fn

    return wrap


def brief(findings: DataFrame) -> DataFrame:
    """The columns of a finding that the oracle also computes."""
    return findings.select(
        "document_id", "rule_code", "risk_level", "subject_key",
        F.col("discrepancy_amount").alias("discrepancy_amount"), "is_overridable",
    )


def brief_sql(rule: str, level: str, subject: str, amount: str, overridable: bool, source: str, doc: str = "document_id") -> str:
    """SELECT of the same columns in DuckDB."""
    return f"""select {doc} as document_id, '{rule}' as rule_code, {level} as risk_level,
      cast({subject} as varchar) as subject_key, cast({amount} as decimal(38,2)) as discrepancy_amount,
      {'true' if overridable else 'false'} as is_overridable {source}"""
