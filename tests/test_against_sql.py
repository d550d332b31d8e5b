"""Queries next to their SQL on the smallest data; ALL_QUERIES=1 runs every one."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = ["pool_text", "report_status_single", "evidence_excerpt", "redact_text", "event_validate", "compare_schema", "run_history", "context_normalize"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check_oracle.TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert check_oracle.compare(spark, con, name, SF).startswith("ok")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
