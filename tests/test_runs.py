"""Scores at their thresholds, routing, whole runs, written results and the event stream."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import scoring as sc
from tablewright.plans.runs import base_run, filtered_run, upload_run
from tablewright.sources.delimited import read_csv
from tablewright.sources.events import event_snapshot, newest, read_events, read_registry
from tablewright.sources.sinks import log_event, persist_run
from tablewright.streaming import event_stream, start_status_counts


def test_quality_score_thresholds(spark):
    rows = [(100, 1, 0, 0, 0, 0, 100, "Excellent"), (100, 1, 0, 100, 0, 0, 75, "Good"), (100, 1, 100, 0, 0, 0, 65, "Fair"),
            (100, 1, 100, 100, 100, 0, 20, "Needs attention"), (8, 1, 0, 0, 0, 0, 100, "Excellent"),
            (40, 1, 1, 0, 0, 0, 95, "Excellent"), (80, 1, 1, 0, 0, 0, 98, "Excellent")]  # 97.5 rounds to even
    df = spark.createDataFrame(rows, "rows int, columns int, missing int, duplicates int, invalid_numeric int, "
                                     "invalid_dates int, want int, label string")
    for r in sc.quality_score(df).collect():
        assert (r["quality_score"], r["quality_label"]) == (r["want"], r["label"])


def test_confidence_thresholds(spark):
    rows = [(0, 0.0, 0, 0, 0.0, 0, "Low"), (7, 0.0, 0, 0, 0.0, 70, "Medium"), (19, 0.0, 0, 0, 0.0, 85, "High"),
            (20, 0.0, 0, 0, 0.0, 100, "High"), (20, 0.1, 1, 1, 0.15, 43, "Low"), (20, 0.03, 0, 0, 0.14, 84, "High")]
    df = spark.createDataFrame(rows, "rows int, missing_ratio double, duplicates int, invalid_values int, "
                                     "max_outlier_share double, want int, label string")
    got = sc.confidence_score(df).collect()
    assert all((r["confidence_score"], r["confidence_label"]) == (r["want"], r["label"]) for r in got)
    assert list(got[3]["confidence_reasons"]) == ["stable evidence"]


def test_routing(spark):
    df = spark.createDataFrame([("show sales trend",), ("about Sales",), ("hello",), ("name of it",)], "r string")
    offered = ["quality_overview", "missing_breakdown", "trend_analysis", "numeric_distribution"]
    got = [r["primary_key"] for r in sc.route_requests(df, "r", offered, {"sales": "Numeric"}).collect()]
    assert got == ["trend_analysis", "numeric_distribution", "quality_overview", "missing_breakdown"]
    strict = [r["primary_key"] for r in sc.route_requests(df, "r", offered, {"sales": "Numeric"}, word=True).collect()]
    assert strict[3] == "quality_overview"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    lines = ["order_id,region,sales,profit,day"]
    for i in range(24):
        region = ("North", "South", "West")[i % 3]
        sales = "oops" if i == 5 else ("" if i == 7 else str(100 + 10 * i + (90 if region == "North" else 0)))
        lines.append(f"{1000 + i},{region},{sales},{20 + i},2024-01-{i % 20 + 1:02d}")
    lines += ["1024,North,290", "1025,North,290,43,2024-01-04,extra"]
    path = folder / "sales.csv"
    path.write_text("\n".join(lines) + "\n")
    upload = upload_run(read_csv(spark, str(path)), "sales.csv")
    base = base_run(upload, audience="operator", preferences={"column_roles": {"metric_column": "sales"}})
    return folder, upload, base


def test_upload(run):
    _, upload, _ = run
    assert upload.types == {"order_id": "Numeric", "region": "Categorical", "sales": "Numeric", "profit": "Numeric",
                            "day": "Date"}
    assert upload.profile["order_id"].is_id and not upload.profile["sales"].is_id
    assert [r["value"] for r in upload.invalid_numeric.collect()] == ["oops"]


def test_base_run(run):
    _, _, base = run
    assert base.view.choice.value == "sales" and base.view.choice.time == "day"
    report = json.loads(base.view.report.first()["report"])
    assert report["file_name"] == "sales.csv" and report["view_label"] == "cleaned dataset"
    assert report["analysis_summary"]["shape"] == {"rows": 25, "columns": 5}
    assert report["ingestion_metadata"]["record_count"] == 26 and report["duplicate_diagnostics"]["total_rows"] == 25
    assert [x["penalty"] for x in report["insight_summary"]["quality_score_breakdown"]][3] == 0
    assert all(x["penalty"] > 0 for x in report["insight_summary"]["confidence_breakdown"])
    assert {m["metric"]: m["after"] for m in base.impact.collect()}["invalid numeric values"] == 0
    brief = base.view.brief.first()["brief"]
    order = [brief.index(f"## {t}") for t in ("Executive Summary", "Top Risk", "Cleaning Impact", "Scoring Note", "Column Roles")]
    assert order == sorted(order) and "Operational review" in brief


def test_filtered_run_and_results_on_disk(spark, run):
    folder, upload, base = run
    filtered = filtered_run(base, categorical={"region": ["North", "South"]}, numeric={"sales": (0, 400)})
    assert len(filtered.filters) == 2 and filtered.view.label == "filtered cleaned dataset"
    keys = [r["key"] for r in filtered.suggested.orderBy("ord").collect()]
    assert keys[0] == "quality_overview" and "trend_analysis" in keys
    assert filtered.answer("top_categories").first()["column"] == "region"
    document = json.loads(filtered.context.first()["document"])
    assert len(document["preview_rows"]) == 6 and len(document["columns"]) == 5
    root = f"{folder}/results"
    first = persist_run(root, "sales", base.view.report, base.view.brief, base.cleaned.rows, base.view.rows, upload.csv.rejected)
    assert (first.rows_cleaned, first.rejected_row_count) == (25, 1)
    second = persist_run(root, "sales", base.view.report, base.view.brief, base.cleaned.rows, filtered.view.rows)
    assert second.rejected_path is None
    entries = newest(read_registry(spark, f"{root}/run_registry"), "created_at", 5).collect()
    assert [e["run_id"] for e in entries] == [second.run_id, first.run_id]
    assert spark.read.parquet(second.cleaned_path).count() == 25


def test_event_log_and_stream(spark, tmp_path):
    root = str(tmp_path)
    for kind, status in (("upload", "INFO"), ("failed", "ERROR"), ("done", "INFO")):
        log_event(spark, root, kind, status, {"n": 1})
    log = f"{root}/monitoring/events"
    (tmp_path / "monitoring" / "events" / "broken.json").write_text("{no json\n")
    snapshot = {r["status"]: (r["n"], r["last_event_type"]) for r in event_snapshot(read_events(spark, log)).collect()}
    assert snapshot == {"INFO": (2, "done"), "ERROR": (1, "failed")}
    query = start_status_counts(event_stream(spark, log, max_files=1), "status_counts", f"{root}/ckpt")
    assert query.awaitTermination(120)
    assert {r["status"]: r["n"] for r in spark.table("status_counts").collect()} == {"INFO": 2, "ERROR": 1}
