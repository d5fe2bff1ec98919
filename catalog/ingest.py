"""Irregular comma-separated lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.profile import column_types
from tablewright.sources import delimited as dl

from .inputs import RAW_HEADER, RAW_LINES, derived, duck, table


def _classified(spark, sf):
    return dl.classify_records(derived(spark, sf, RAW_LINES), len(RAW_HEADER))


def csv_rows(spark, sf):
    return dl.kept_rows(_classified(spark, sf), RAW_HEADER).withColumnRenamed("_line_no", "line_no")


def csv_kinds(spark, sf):
    return _classified(spark, sf).select(
        F.col("_line_no").alias("line_no"), F.col("_kind").alias("kind"), F.col("_n").alias("field_count")
    )


def csv_rejected(spark, sf):
    return dl.rejected_rows(_classified(spark, sf))


def csv_metrics(spark, sf):
    return dl.ingest_metrics(_classified(spark, sf))


def csv_samples(spark, sf):
    return dl.sample_line_numbers(_classified(spark, sf))


def csv_notes(spark, sf):
    return dl.ingest_notes(dl.ingest_metrics(_classified(spark, sf))).select("ord", "rule", "n")


def csv_document_cells(spark, sf):
    """Whole document texts read as records: how many cells each would have."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("_line_no"), F.col("text").alias("line"))
    return dl.classify_records(docs, 3).select(
        F.col("_line_no").alias("doc_id"), F.col("_n").alias("field_count")
    )


def csv_types(spark, sf):
    """Types of what was kept."""
    rows = dl.kept_rows(_classified(spark, sf), RAW_HEADER)
    return column_types(rows).select("column", "non_null", "detected_type")


QUERIES = {
    f.__name__: f
    for f in (
        csv_rows, csv_kinds, csv_rejected, csv_metrics, csv_samples, csv_notes, csv_document_cells, csv_types,
    )
}

# One field is a quoted text with doubled quotes or a run without commas.
_LINES = f"""WITH raw AS ({duck(RAW_LINES)}),
cells AS (SELECT _line_no, line, CASE WHEN line = '' THEN []
  ELSE regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^,]*)', 1) END AS parts FROM raw),
clean AS (SELECT _line_no, line, len(parts) AS n, list_transform(parts, lambda x: CASE WHEN starts_with(x, '"')
  THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS c FROM cells),
kinds AS (SELECT *, CASE WHEN len(list_filter(c, lambda x: trim(x) <> '')) = 0 THEN 'blank' WHEN n < 3 THEN 'short'
  WHEN n > 3 THEN 'long' ELSE 'ok' END AS kind FROM clean)"""

ORACLES = {
    "csv_rows": f"""{_LINES} SELECT _line_no AS line_no, c[1] AS id, coalesce(c[2], '') AS status,
        coalesce(c[3], '') AS priority FROM kinds WHERE kind IN ('ok', 'short')""",
    "csv_kinds": f"{_LINES} SELECT _line_no AS line_no, kind, CAST(n AS INTEGER) AS field_count FROM kinds",
    "csv_rejected": f"""{_LINES} SELECT _line_no AS line_number, 'Too many fields for the detected header' AS reason,
        CAST(n AS INTEGER) AS field_count, line AS row_text FROM kinds WHERE kind = 'long'""",
    "csv_metrics": f"""{_LINES} SELECT count(*) AS record_count, count(*) FILTER (kind IN ('ok', 'short')) AS row_count,
        count(*) FILTER (kind = 'blank') AS blank_row_count, count(*) FILTER (kind = 'short') AS repaired_row_count,
        count(*) FILTER (kind = 'long') AS skipped_row_count,
        count(*) FILTER (kind IN ('ok', 'short')) = 0 AS empty_dataset FROM kinds""",
    "csv_samples": f"""{_LINES} SELECT CASE kind WHEN 'short' THEN 'repaired' ELSE 'skipped' END AS outcome,
        _line_no AS line_number, CAST(row_number() OVER (PARTITION BY kind ORDER BY _line_no) AS INTEGER) AS ord
        FROM kinds WHERE kind IN ('short', 'long') QUALIFY ord <= 10""",
    "csv_notes": f"""{_LINES} SELECT * FROM (
        SELECT 1 AS ord, 'repaired' AS rule, count(*) FILTER (kind = 'short') AS n FROM kinds
        UNION ALL SELECT 2, 'skipped', count(*) FILTER (kind = 'long') FROM kinds
        UNION ALL SELECT 3, 'blank', count(*) FILTER (kind = 'blank') FROM kinds) WHERE n > 0""",
    "csv_document_cells": """SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(',' || text,
        ',("(?:[^"]|"")*"[^,]*|"(?:[^"]|"")*$|[^,]*)')) END AS INTEGER) AS field_count FROM documents""",
    "csv_types": f"""{_LINES}, k AS (SELECT c[1] AS id, c[2] AS status, c[3] AS priority FROM kinds
          WHERE kind IN ('ok', 'short'))
        SELECT 'id' AS "column", count(id) AS non_null, 'Numeric' AS detected_type FROM k
        UNION ALL SELECT 'status', count(status), 'Categorical' FROM k
        UNION ALL SELECT 'priority', count(priority), 'Categorical' FROM k""",
}
