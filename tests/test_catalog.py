"""A cross-section of the queries against their SQL on the smallest folder; tools/check.py compares all of them."""

import os

import pytest

import __spark_entry__ as spec
from tools.check import TABLES, _kind, _rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "csv_rows", "csv_rejected", "standardize_table", "column_types", "issue_table", "dup_rows", "dedup_first", "clean_table",
    "filter_all", "numeric_summary", "quantiles_narrowed", "correlation_pairs", "outliers_by_status", "histogram",
    "segment_gap_by_status", "trend_by_status", "quality_score_by_status", "route_requests", "latest_events", "clean_by_status",
    "correlation_wide", "column_rules_decided",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = spec.queries()[name](spark, FOLDER)
    want = duck.sql(spec.oracle_sql()[name])
    assert {c: _kind(t) for c, t in df.dtypes} == {c: _kind(t) for c, t in zip(want.columns, map(str, want.types))}
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(spec.oracle_sql()) <= set(spec.queries())


def test_entry(spark):
    assert spec.entry(spark).count() > 0
