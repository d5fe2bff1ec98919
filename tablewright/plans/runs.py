"""The three stages of a run: upload, base view, filtered view. Tables stay lazy; decisions are small."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CleaningConfig, Preferences
from ..operators.base import DATE, NUMERIC, ROW_ID, data_columns
from ..operators.cleaning import CleanResult, clean, standardize
from ..operators.duplicates import duplicate_rows, key_diagnostics, suggest_key
from ..operators.filters import apply_filters
from ..operators.profile import (
    ColumnProfile,
    collect_profile,
    invalid_values,
    missing_counts,
    profile_table,
)
from ..operators.scoring import quality_metrics, suggested_analyses
from ..operators.selection import ColumnChoice, choose_columns, measures
from ..operators.statistics import numeric_summary, outlier_summary, summarised_categories, top_values
from ..session import keep
from ..sources.delimited import CsvTable
from . import documents
from .answers import AnswerSource, guided_answer
from .findings import slice_findings
from .narrative import insight_sections

DUPLICATE_PREVIEW = 10


@dataclass
class UploadRun:
    """A raw table with its profile: types, suggested duplicate key, missing and invalid values."""

    raw: DataFrame
    source: str
    profile_table: DataFrame
    profile: dict[str, ColumnProfile]
    types: dict[str, str]
    suggested_subset: list[str] | None
    missing: DataFrame
    invalid_numeric: DataFrame
    invalid_dates: DataFrame
    csv: CsvTable | None = None
    row_id: str = ROW_ID


@dataclass
class View:
    """One view of the table with its signals and texts."""

    rows: DataFrame
    label: str
    profile_table: DataFrame
    profile: dict[str, ColumnProfile]
    choice: ColumnChoice
    measures: list[str]
    findings: DataFrame
    sections: DataFrame
    report: DataFrame
    brief: DataFrame


@dataclass
class BaseRun:
    """The cleaned (or only typed) table and everything said about it."""

    upload: UploadRun
    config: CleaningConfig
    preferences: Preferences
    audience: str
    cleaned: CleanResult
    diagnostics: DataFrame
    duplicate_preview: DataFrame
    impact: DataFrame
    view: View


@dataclass
class FilteredRun:
    """A filtered view of a base run. Its scores use the raw table as uploaded, its signals the filtered rows."""

    base: BaseRun
    filters: list[str]
    view: View
    suggested: DataFrame
    context: DataFrame = field(repr=False)

    def answer(self, key: str, focus=None) -> DataFrame:
        upload = self.base.upload
        source = AnswerSource(
            upload.raw, self.view.rows, upload.types, self.view.choice, self.view.measures,
            list(self.base.preferences.duplicate_subset or []) or None, upload.row_id,
        )
        return guided_answer(key, source, focus)


def upload_run(raw: DataFrame | CsvTable, source: str = "table", row_id: str = ROW_ID) -> UploadRun:
    csv = raw if isinstance(raw, CsvTable) else None
    rows = keep(csv.rows) if csv else raw  # parse the text once
    table = profile_table(rows, row_id=row_id)
    profile = collect_profile(table)
    types = {n: p.detected_type for n, p in profile.items()}
    return UploadRun(
        rows, source, table, profile, types, suggest_key(table), missing_counts(rows),
        invalid_values(rows, types, NUMERIC, row_id=row_id), invalid_values(rows, types, DATE, row_id=row_id),
        csv, row_id,
    )


def cleaning_impact(raw: DataFrame, cleaned: DataFrame, types: dict[str, str], subset=None) -> DataFrame:
    """``(metric, before, after)`` of missing cells, repeated rows and invalid values."""
    def long(df: DataFrame, side: str, known) -> DataFrame:
        m = quality_metrics(df, known, subset)
        return m.selectExpr(
            "stack(4, 1, 'missing cells', missing, 2, 'duplicate rows', duplicates, "
            "3, 'invalid numeric values', invalid_numeric, 4, 'invalid date values', invalid_dates) "
            f"as (ord, metric, {side})"
        )

    before, after = long(raw, "before", types), long(cleaned, "after", types)
    return before.join(after, ["ord", "metric"]).select("ord", "metric", "before", "after")


def _view(
    upload: UploadRun, rows: DataFrame, label: str, prefs: Preferences, audience: str, config, impact_lines,
    log_lines, filters=(),
) -> View:
    subset = list(prefs.duplicate_subset or []) or None
    table = profile_table(rows, row_id=upload.row_id)
    profile = collect_profile(table)
    choice = choose_columns(rows, table, profile, prefs.segment_column, prefs.metric_column, prefs.time_column)
    used = measures(profile)
    findings = slice_findings(upload.raw, rows, upload.types, choice, None, used, subset)
    preferred = {"time": prefs.time_column, "metric": prefs.metric_column, "segment": prefs.segment_column}
    sections = insight_sections(findings, audience, prefs.column_roles, preferred)
    static = {
        "file_name": json.dumps(upload.source), "view_label": json.dumps(label),
        "cleaning_config": json.dumps(config.to_dict()), "preferences": json.dumps(prefs.to_dict()),
        "applied_filters": json.dumps(list(filters)), "cleaning_impact": json.dumps(impact_lines),
        "transformation_log": json.dumps(log_lines),
        "ingestion_metadata": documents.row_as_json(upload.csv.metrics) if upload.csv else "null",
        "duplicate_diagnostics": documents.row_as_json(
            key_diagnostics(upload.raw, subset, [n for n, p in upload.profile.items() if p.is_id])
        ),
    }
    report = documents.run_report(findings, sections, static)
    from .narrative import AUDIENCES

    brief = documents.decision_brief(
        findings, sections, upload.source, label, AUDIENCES.get(audience, AUDIENCES["executive"])["label"],
        impact_lines, list(filters), prefs.column_roles.to_dict() if prefs.column_roles.given else None,
    )
    return View(rows, label, table, profile, choice, used, findings, sections, report, brief)


def base_run(upload: UploadRun, cleaned_view: bool = True, config=None, audience="executive", preferences=None) -> BaseRun:
    cfg, prefs = CleaningConfig.of(config), Preferences.of(preferences)
    subset = list(prefs.duplicate_subset or []) or None
    result = clean(upload.raw, upload.types, subset, cfg, upload.row_id)
    rows = keep(result.rows if cleaned_view else standardize(upload.raw, upload.types, cfg))
    ids = [n for n, p in upload.profile.items() if p.is_id]
    impact = keep(cleaning_impact(upload.raw, result.rows, upload.types, subset))
    lines = [f"{r['metric']}: {r['before']} -> {r['after']}" for r in impact.orderBy("ord").collect()]
    label = "cleaned dataset" if cleaned_view else "raw dataset"
    view = _view(upload, rows, label, prefs, audience, cfg, lines, result.log_texts())
    return BaseRun(
        upload, cfg, prefs, audience, result, key_diagnostics(upload.raw, subset, ids),
        duplicate_rows(upload.raw, subset).orderBy(upload.row_id).limit(DUPLICATE_PREVIEW), impact, view,
    )


def filtered_run(base: BaseRun, categorical=None, numeric=None, dates=None, end_of_day: bool = False) -> FilteredRun:
    upload = base.upload
    rows, filters = apply_filters(base.view.rows, categorical, numeric, dates, end_of_day)
    label = f"filtered {base.view.label}" if filters else base.view.label
    lines = [f"{r['metric']}: {r['before']} -> {r['after']}" for r in base.impact.orderBy("ord").collect()]
    view = _view(
        upload, rows, label, base.preferences, base.audience, base.config, lines, base.cleaned.log_texts(), filters
    )
    flags = view.findings.select("missing", "duplicates", "chart_keys")
    names = summarised_categories(view.profile_table)
    shapes = {
        "raw": (next(iter(upload.profile.values())).rows, len(data_columns(upload.raw))),
        "active": (next(iter(view.profile.values())).rows, len(data_columns(rows))),
    }
    used = view.measures or [n for n, p in view.profile.items() if p.detected_type == NUMERIC]
    context = documents.context_document(
        upload.types, shapes, upload.missing,
        upload.invalid_numeric.unionByName(upload.invalid_dates),
        numeric_summary(rows, used), top_values(rows, names or data_columns(rows)[:1], 5),
        outlier_summary(rows, used), documents.preview(rows, upload.row_id), view.findings, label, filters,
    )
    return FilteredRun(base, filters, view, suggested_analyses(flags), context)
