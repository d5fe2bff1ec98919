"""From an analysis key or a chart request to its result table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import statistics as st
from ..operators.base import CATEGORICAL, NUMERIC, classes
from ..operators.duplicates import duplicate_rows
from ..operators.profile import missing_counts
from ..operators.scoring import recommendation_table, chart_recommendations, quality_metrics, quality_score
from ..operators.selection import ColumnChoice
from ..operators.signals import time_series

# Fixed value: a histogram of a column with outliers is clipped to these quantiles for display.
DISPLAY_CLIP = (0.01, 0.99)
DUPLICATE_PREVIEW = 10


@dataclass
class AnswerSource:
    """What the guided analyses read: the raw and the typed table with the columns chosen for them."""

    raw: DataFrame
    active: DataFrame
    types: dict[str, str]
    choice: ColumnChoice
    measures: list[str]
    subset: list[str] | None = None
    row_id: str = "_row_id"


def display_histogram(df: DataFrame, column: str) -> DataFrame:
    """12 bins; clipped for display where the column has outliers."""
    clip = DISPLAY_CLIP if st.outlier_summary(df, [column]).count() else None
    return st.histogram(df, column, clip=clip)


def guided_answer(key: str, source: AnswerSource, focus: list[str] | None = None) -> DataFrame:
    """The table behind one guided analysis; ``focus`` names the columns a request mentioned."""
    focus = focus or []
    df, choice = source.active, source.choice
    kinds = classes(df)
    numeric_focus = [c for c in focus if kinds.get(c) == NUMERIC]
    value = next(iter(numeric_focus), choice.value)

    def category() -> str | None:
        return next((c for c in focus if kinds.get(c) == CATEGORICAL), choice.category)

    def trend_points() -> DataFrame:
        return time_series(df, choice.time, value, choice.axis).orderBy("t")

    def pair_points() -> DataFrame:
        pair = numeric_focus[:2] if len(numeric_focus) >= 2 else choice.pair
        return st.pair_points(df, *pair)

    answers = {
        "quality_overview": lambda: quality_score(quality_metrics(source.raw, source.types, source.subset)),
        "missing_breakdown": lambda: missing_counts(source.raw),
        "duplicate_review": lambda: duplicate_rows(source.raw, source.subset).orderBy(source.row_id).limit(
            DUPLICATE_PREVIEW),
        "summary_statistics": lambda: st.numeric_summary(df, source.measures),
        "top_categories": lambda: st.category_frequency(df, category(), 10, include_null=True),
        "numeric_distribution": lambda: display_histogram(df, value),
        "outlier_check": lambda: st.outlier_table(st.outlier_summary(df, source.measures)),
        "correlation_analysis": lambda: st.correlation_matrix(df, source.measures),
        "scatter_relationship": pair_points,
        "trend_analysis": trend_points,
        "recommended_charts": lambda: recommendation_table(df.sparkSession, chart_recommendations(choice)),
    }
    if key not in answers:
        raise KeyError(f"unknown analysis: {key}")
    return answers[key]()


def chart_data(kind: str, df: DataFrame, **o) -> DataFrame:
    """The table behind a chart the user puts together: bar, line, histogram, scatter or box."""
    if kind == "bar":
        return st.grouped_metric(df, o["group"], o.get("value"), o.get("agg", "count"), o.get("top_n", 12),
                                 o.get("sort", "descending"))
    if kind == "line":
        return st.grouped_metric(df, o["x"], o["value"], o.get("agg", "mean"), None, "natural")
    if kind == "histogram":
        return display_histogram(df, o["column"])
    if kind == "scatter":
        return st.pair_points(df, o["x"], o["y"])
    if kind == "box":
        return st.box_by_group(df, o["group"], o["value"], o.get("max_groups", 10))
    raise KeyError(f"unknown chart: {kind}")
