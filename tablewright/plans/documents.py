"""Run report, context document and decision brief: one text per slice, built by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_key
from ..functions.numbers import display_number
from ..operators.base import DATE, NUMERIC
from ..operators.profile import issue_table
from ..operators.scoring import confidence_lines, quality_lines
from ..session import keep
from .findings import SLICE
from .narrative import SECTIONS, insight_sections

# How many rows, columns and summaries a context document shows.
PREVIEW_ROWS, PREVIEW_COLUMNS = 6, 8
NUMERIC_SUMMARIES, CATEGORY_SUMMARIES, OUTLIER_SUMMARIES = 8, 6, 6

BRIEF_TITLE = "# Decision Brief"
SCORING_NOTE = (
    "Readiness and confidence are rules over missing cells, repeats, parsing, row count and outliers; they are no "
    "statistical guarantee."
)


def _texts_per_slice(sections: DataFrame) -> DataFrame:
    """The lines of each section as arrays: a few dozen short lines per slice at most."""
    lines = sections.groupBy(SLICE, "section").agg(
        F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("lines")
    )
    return lines.groupBy(SLICE).agg(
        *[
            F.first(F.when(F.col("section") == s, F.transform("lines", lambda t: t["text"])), ignorenulls=True).alias(s)
            for s in SECTIONS
        ]
    )


def run_report(findings: DataFrame, sections: DataFrame, static: dict[str, str] | None = None) -> DataFrame:
    """``(slice, report)``: the nested summary of a run as JSON.

    ``static`` holds JSON texts about the whole run; they are parsed into the document as variants, so a text that is no
    JSON raises instead of spoiling the document.
    """
    texts = _texts_per_slice(sections)
    f = findings.join(texts, SLICE, "left")
    body = F.struct(
        F.col(SLICE),
        F.struct(
            F.col("missing").alias("missing_cells"), F.col("duplicates").alias("duplicate_count"),
            "duplicate_subset", F.col("invalid_numeric").alias("invalid_numeric_count"),
            F.col("invalid_dates").alias("invalid_date_count"),
        ).alias("validation_summary"),
        F.struct(
            F.struct(F.col("rows").alias("rows"), F.col("active_columns").alias("columns")).alias("shape"),
            _rounded_correlation().alias("strongest_correlation"), F.col("trend").alias("trend_signal"),
            F.col("segment").alias("segment_signal"), F.col("outlier_columns").alias("outlier_summary"),
        ).alias("analysis_summary"),
        F.struct(
            "quality_score", "quality_label", quality_lines().alias("quality_score_breakdown"), "confidence_score", "confidence_label",
            "confidence_reasons", confidence_lines().alias("confidence_breakdown"),
            "executive_summary", "risk_flags", "next_steps", "next_questions", "assumption_badges",
        ).alias("insight_summary"),
        F.col("charts").alias("chart_recommendations"),
        *[F.parse_json(F.lit(text)).alias(name) for name, text in (static or {}).items()],
    )
    return f.select(SLICE, F.to_json(body).alias("report"))


def row_as_json(df: DataFrame) -> str:
    """The only row of a table as a JSON text; null if it has none."""
    first = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("j")).first()
    return first["j"] if first else "null"


def _rounded_correlation() -> Column:
    c = F.col("correlation")
    return F.when(c.isNotNull(), F.struct(
        c["column_a"].alias("column_a"), c["column_b"].alias("column_b"), display_number(c["r"], 4).alias("r"),
        c["n"].alias("n"), c["support"].alias("support"), c["reason"].alias("reason"),
    ))


def decision_brief(
    findings: DataFrame, sections: DataFrame, source: str, view: str, audience_label: str,
    impact: list[str] | None = None, filters: list[str] | None = None, roles: dict | None = None,
) -> DataFrame:
    """``(slice, brief)``: the Markdown brief in its fixed order of sections."""
    f = findings.join(_texts_per_slice(sections), SLICE, "left")

    def bullets(c: Column) -> Column:
        return F.transform(c, lambda t: F.concat(F.lit("- "), t))

    def fixed(*lines: str) -> Column:
        return F.array(*[F.lit(x) for x in lines]).cast("array<string>")

    def given(title: str, lines) -> Column:
        return fixed("", f"## {title}", *[f"- {x}" for x in lines]) if lines else fixed()

    def section(title: str, c: Column) -> Column:
        return F.concat(fixed("", f"## {title}"), bullets(F.coalesce(c, fixed())))

    def optional(title: str, c: Column) -> Column:
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, section(title, c)).otherwise(fixed())

    head = F.concat(
        fixed(BRIEF_TITLE, "", f"- File: {source}", f"- View: {view}", f"- Audience: {audience_label}"),
        F.array(
            F.format_string("- Readiness: %d (%s)", "quality_score", "quality_label"),
            F.format_string("- Confidence: %s", "confidence_label"),
        ),
    )
    charts = F.transform(F.slice("charts", 1, 3), lambda c: F.concat(c["key"], F.lit(": "),
                                                                    F.array_join(c["columns"], ", ")))
    lines = F.concat(
        head,
        section("Executive Summary", F.col("executive_summary")),
        section("Top Risk", F.slice("risk_flags", 1, 1)),
        section("Key Driver", F.slice("key_drivers", 1, 1)),
        section("Recommended Actions", F.col("next_steps")),
        fixed("", "## Cleaning Impact", *[f"- {x}" for x in impact or []]),
        section("Confidence Notes", F.col("confidence_reasons")),
        fixed("", "## Scoring Note", f"- {SCORING_NOTE}"),
        optional("Next Questions", F.col("next_questions")),
        optional("Recommended Charts", charts),
        given("Active Filters", filters),
        given("Column Roles", [f"{k}: {v}" for k, v in (roles or {}).items() if v]),
    )
    return f.select(SLICE, F.array_join(lines, "\n").alias("brief"))


def preview(df: DataFrame, row_id: str | None = None) -> Column | DataFrame:
    """The first rows and columns for a context document (a top-k report), as JSON texts."""
    names = [c for c in df.columns if not c.startswith("_")][:PREVIEW_COLUMNS]
    ordered = df.orderBy(row_id) if row_id else df
    cells = [
        (display_number(F.col(f"`{c}`"), 4) if t in ("double", "float") else F.col(f"`{c}`").cast("string")).alias(c)
        for c, t in df.dtypes
        if c in names
    ]
    return ordered.limit(PREVIEW_ROWS).select(F.to_json(F.struct(*cells)).alias("row"))


def context_document(
    types: dict[str, str], shapes: dict[str, tuple[int, int]], missing: DataFrame, invalid: DataFrame,
    summary: DataFrame, top: DataFrame, outliers: DataFrame, rows: DataFrame, findings: DataFrame, view: str,
    filters: list[str] | None = None,
) -> DataFrame:
    """``(slice, document)``: shapes, types, validation, summaries and a preview in one compact JSON text.

    Each part is a small table (one row per column or less) turned into one array; the parts are stacked under
    their names and put together once. Summaries are those of the first columns in table order. Bad values are given
    as exact counts with a preview per column, numbers and dates apart; ``invalid`` itself is the full list.
    """
    order = F.array(*[F.lit(c) for c in types]).cast("array<string>")

    def as_array(frame: DataFrame, name: str, limit: int | None = None) -> DataFrame:
        placed = frame.withColumn("_place", F.array_position(order, F.col("column")))
        if limit:
            first = [r["_place"] for r in placed.select("_place").distinct().orderBy("_place").limit(limit).collect()]
            placed = placed.filter(F.col("_place").isin(*first))
        rank = F.col("rank") if "rank" in frame.columns else F.lit(0)
        packed = placed.select(F.struct("_place", rank.alias("_rank"), F.to_json(F.struct(*frame.columns)).alias("j")).alias("p"))
        items = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["j"])
        return packed.agg(items.alias("items")).select(F.lit(name).alias("part"), "items")

    numeric = summary.select("column", "count", *[
        display_number(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")
    ])
    parts = as_array(missing, "missing_values")
    invalid = keep(invalid)  # read four times: counts and previews, of numbers and of dates
    for kind, name in ((NUMERIC, "invalid_numeric"), (DATE, "invalid_dates")):
        columns = [c for c, t in types.items() if t == kind]
        bad = invalid.filter(F.col("column").isin(*columns))
        bad = bad if "first_row" in bad.columns else bad.withColumn("first_row", F.lit(0))  # then by value
        parts = parts.unionByName(as_array(issue_table(bad), name))
    for frame, name, limit in (
        (numeric, "numeric_summary", NUMERIC_SUMMARIES),
        (top.select("column", "rank", "value", "n"), "categorical_summary", CATEGORY_SUMMARIES),
        (outliers.select("column", "outliers", display_number(F.col("share"), 4).alias("share")), "outlier_summary",
         OUTLIER_SUMMARIES),
    ):
        parts = parts.unionByName(as_array(frame, name, limit))
    preview_rows = rows.agg(F.collect_list("row").alias("items")).select(F.lit("preview_rows").alias("part"), "items")
    parts = parts.unionByName(preview_rows)
    joined = F.concat(F.lit('"'), F.col("part"), F.lit('":['), F.array_join("items", ","), F.lit("]"))
    body = parts.select("part", joined.alias("text")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), ",")
        .alias("_body")
    ).withColumn(SLICE, F.lit("all"))
    import json

    fixed = json.dumps({
        "view_label": view,
        "columns": [{"name": c, "detected_type": t} for c, t in types.items()],
        "shapes": {k: {"rows": r, "columns": c} for k, (r, c) in shapes.items()},
        "active_filters": filters or [],
    })[:-1]
    scored = findings.select(
        SLICE,
        F.to_json(F.struct("quality_score", "quality_label", F.col("duplicates").alias("duplicate_count"),
                           "duplicate_subset", _rounded_correlation().alias("strongest_correlation"),
                           F.col("charts").alias("recommended_charts"))).alias("_scores"),
    )
    document = F.concat(
        F.lit(fixed), F.lit(',"scores":'), F.col("_scores"), F.lit(","), F.col("_body"), F.lit("}")
    )
    return scored.join(body, SLICE).select(SLICE, document.alias("document"))


def document_key(documents: DataFrame, text: str, **parts: str) -> DataFrame:
    """A stable key of a document together with the named settings it was made for."""
    named = {name: F.lit(value) for name, value in parts.items()} | {"context": F.col(text)}
    return documents.withColumn("content_key", content_key(named))


def sections_and_brief(findings: DataFrame, source: str, view: str, audience: str = "executive", **more):
    from .narrative import AUDIENCES

    sections = insight_sections(findings, audience, more.pop("roles", None), more.pop("preferred", None))
    label = AUDIENCES.get(audience, AUDIENCES["executive"])["label"]
    return sections, decision_brief(findings, sections, source, view, label, **more)
