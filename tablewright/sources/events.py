"""Append-only JSON Lines logs: pipeline events and the registry of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "timestamp string, event_type string, status string, run_id string, payload map<string,string>"
REGISTRY_SCHEMA = (
    "run_id string, created_at string, run_dir string, report_path string, brief_path string, cleaned_path string, "
    "active_path string, rejected_path string, rows_cleaned bigint, rows_active bigint, rejected_row_count bigint"
)


def _read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a fixed schema; lines that are no JSON are left out."""
    bad = "_bad"
    rows = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", bad
    ).json(path)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _read_lines(spark, path, EVENT_SCHEMA)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return _read_lines(spark, path, REGISTRY_SCHEMA)


def newest(rows: DataFrame, order: str, limit: int, tie: str | None = None) -> DataFrame:
    """The last entries, newest first (a top-k report)."""
    keys = [F.desc(order)] + ([F.desc(tie)] if tie else [])
    return rows.orderBy(*keys).limit(limit)


def status_counts(events: DataFrame, status: str = "status") -> DataFrame:
    return events.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def latest_event(events: DataFrame, order: str, tie: str) -> DataFrame:
    """The newest event, found by aggregation and not by sorting."""
    row = F.max_by(F.struct(*events.columns), F.struct(order, tie)).alias("e")
    return events.agg(row).filter(F.col("e").isNotNull()).select("e.*")


def event_snapshot(events: DataFrame, limit: int = 20, tie: str = "run_id") -> DataFrame:
    """Counts by status over the last events, with the newest event of each status; equal times go by ``tie``."""
    recent = newest(events, "timestamp", limit, tie)
    return recent.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_seen"),
        F.max_by("event_type", F.struct("timestamp", tie)).alias("last_event_type"),
    )
