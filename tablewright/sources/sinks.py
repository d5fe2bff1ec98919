"""What a run leaves behind: tables, documents, a manifest in the registry and events in the log."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .events import EVENT_SCHEMA, REGISTRY_SCHEMA

RUNS, REGISTRY, EVENTS = "runs", "run_registry", "monitoring/events"


def run_id(stem: Column) -> Column:
    """UTC time, source name and eight random hexadecimal digits."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("_", now, stem, F.substring(F.uuid(), 1, 8))


def new_run_id(spark: SparkSession, stem: str) -> str:
    return spark.range(1).select(run_id(F.lit(stem)).alias("id")).first()["id"]


@dataclass(frozen=True)
class Manifest:
    """Where a run's results are and how many rows they have."""

    run_id: str
    created_at: str
    run_dir: str
    report_path: str
    brief_path: str
    cleaned_path: str
    active_path: str
    rejected_path: str | None
    rows_cleaned: int
    rows_active: int
    rejected_row_count: int


def _write_table(df: DataFrame, path: str, fmt: str) -> int:
    """Write and count in the same job."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
    return int(seen.get["rows"])


def persist_run(
    root: str, stem: str, report: DataFrame, brief: DataFrame, cleaned: DataFrame, active: DataFrame,
    rejected: DataFrame | None = None, fmt: str = "parquet",
) -> Manifest:
    """Write a run's tables and documents under ``root`` and add its manifest to the registry.

    ``fmt`` is parquet for large tables or csv for exchange. Rejected rows are written only if there are any.
    """
    spark = cleaned.sparkSession
    rid = new_run_id(spark, stem)
    base = f"{root.rstrip('/')}/{RUNS}/{rid}"
    report.select(F.col("report").alias("value")).write.mode("overwrite").text(f"{base}/report")
    brief.select(F.col("brief").alias("value")).write.mode("overwrite").text(f"{base}/brief")
    rows_cleaned = _write_table(cleaned, f"{base}/cleaned", fmt)
    rows_active = _write_table(active, f"{base}/active", fmt)
    rejected_path, n_rejected = None, 0
    if rejected is not None and not rejected.isEmpty():
        rejected_path = f"{base}/rejected"
        n_rejected = _write_table(rejected, rejected_path, "csv")
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t"))
    manifest = Manifest(
        rid, now.first()["t"], base, f"{base}/report", f"{base}/brief", f"{base}/cleaned", f"{base}/active",
        rejected_path, rows_cleaned, rows_active, n_rejected,
    )
    append_registry(spark, root, manifest)
    return manifest


def append_registry(spark: SparkSession, root: str, manifest: Manifest) -> None:
    row = spark.createDataFrame([tuple(asdict(manifest).values())], REGISTRY_SCHEMA)
    row.coalesce(1).write.mode("append").option("ignoreNullFields", False).json(f"{root.rstrip('/')}/{REGISTRY}")


def log_event(
    spark: SparkSession, root: str, event_type: str, status: str = "INFO", payload: dict | None = None,
    run: str | None = None,
) -> None:
    """Append one event; the time is the session's, in ISO form, so texts sort by time."""
    texts = {str(k): str(v) for k, v in (payload or {}).items()}
    event = spark.createDataFrame([(None, event_type, status, run, texts)], EVENT_SCHEMA)
    stamped = event.withColumn(
        "timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    )
    stamped.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/{EVENTS}")


def write_rejected(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("overwrite").option("header", True).csv(path)


def json_preview(df: DataFrame, row_id: str, limit: int = 25) -> DataFrame:
    """The first rows as JSON texts with ISO times (a top-k report)."""
    cells = [
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(f"`{c}`")
        for c, t in df.dtypes
    ]
    return df.orderBy(row_id).limit(limit).select(F.col(row_id).alias("row_id"), F.to_json(F.struct(*cells)).alias("json"))
