"""Loads every query module and exposes the registry."""

from docaudit.fixtures import queries_ledgers, queries_payments, queries_rules, queries_plans, queries_tables, queries_extract, queries_streams  # noqa: F401
from docaudit.fixtures.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
