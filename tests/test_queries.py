"""Registered queries against DuckDB on the smallest driver tables (all of them: oracle_check.py)."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
NAMES = (
    "am1_header_line_mismatch", "an1_duplicates_inside", "an2_duplicates_across", "an5_sequential_invoices", "st1_point_collisions",
    "st2_destination_mismatch", "st5_transit_collision", "po1_lodging_over_limit", "su7_scope_deviation", "pl1_audit_plan",
    "rf1_reflection", "sco2_completeness", "de1_decision", "de3_full_audit", "lc3_version_assignment", "lc7_attachment_links",
    "wf1_workflow_start", "da6_daily_trend", "da9_access_check", "da10_citations", "ex15_parse_invoices", "sm1_event_normalization",
    "sm3_task_status_stream", "sm7_distinct_requests", "sm4_consume_once_stream", "sm5_completion_stream", "io7_report_upsert",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
