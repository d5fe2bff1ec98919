"""Which columns a chart or a signal should use. All rules read small per-column tables only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CATEGORICAL, DATE, NUMERIC, UNKNOWN
from .profile import ColumnProfile, groupable_columns
from .signals import time_axis_evidence
from .statistics import correlation_pairs, moments, strongest_correlation

# How many distinct values a chart column may have, and the periods a good axis has.
MAX_CHART_CATEGORIES = 15
MIN_PERIODS = 4


def category_ranking(profile: DataFrame) -> DataFrame:
    """Categorical columns with 2 to 15 values; the one with most rows per value first, ties by name downwards."""
    return (
        profile.filter(
            F.col("detected_type").isin(CATEGORICAL, UNKNOWN)
            & F.col("distinct").between(2, MAX_CHART_CATEGORIES)
        )
        .select("column", (F.col("non_null") - F.col("distinct")).alias("score"))
        .orderBy(F.desc("score"), F.desc("column"))
    )


def numeric_ranking(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Measures first, then identifiers; measures by filled cells and spread, identifiers in column order."""
    usable = profile.filter((F.col("detected_type") == NUMERIC) & (F.col("distinct") > 1))
    names = [r["column"] for r in usable.orderBy("ord").select("column").collect()]
    if not names:
        return usable.select("ord", "column", "is_id", F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("std"))
    return (
        usable.select("ord", "column", "is_id")
        .join(moments(df, names).select("column", "count", F.coalesce("std", F.lit(0.0)).alias("std")), "column")
        .orderBy(
            "is_id", F.when(~F.col("is_id"), -F.col("count")), F.when(~F.col("is_id"), -F.col("std")), "ord"
        )
    )


def time_axis_ranking(df: DataFrame, profile: DataFrame, exclude=()) -> DataFrame:
    """Candidate time axes, best first: dates, enough periods, coverage, periods, span, name."""
    dates = profile.filter(F.col("detected_type") == DATE).select("column")
    names = {r["column"] for r in dates.unionByName(groupable_columns(profile, 40).select("column")).collect()}
    ids = {r["column"] for r in profile.filter("id_by_name").select("column").collect()}
    ordered = [c for c in df.columns if c in names and c not in ids and c not in set(exclude)]
    if not ordered:
        return profile.limit(0).select(
            "column", *[F.lit(None).cast(t).alias(n) for n, t in
                        (("axis", "string"), ("periods", "bigint"), ("coverage", "double"), ("span", "double"))]
        )
    evidence = time_axis_evidence(df, ordered).select("column", "axis", "periods", "coverage", "span")
    return evidence.orderBy(
        F.desc(F.col("axis") == "datetime"), F.desc(F.col("periods") >= MIN_PERIODS),
        F.desc(F.bround("coverage", 4)), F.desc("periods"), F.desc("span"), F.desc("column"),
    )


@dataclass(frozen=True)
class ColumnChoice:
    """The columns the signals and charts of one run use."""

    category: str | None = None
    value: str | None = None
    pair: tuple[str, str] | None = None
    time: str | None = None
    axis: str | None = None


def measures(profile: dict[str, ColumnProfile]) -> list[str]:
    """Numeric columns with two distinct values or more that are no identifiers."""
    return [n for n, p in profile.items() if p.detected_type == NUMERIC and not p.is_id and p.distinct > 1]


def choose_category(table: DataFrame, profile: dict[str, ColumnProfile], preferred: str | None = None) -> str | None:
    if preferred in profile:
        facts = profile[preferred]
        if 2 <= facts.distinct <= max(30, min(facts.non_null, 50)):
            return preferred
    best = category_ranking(table).first()
    return best["column"] if best else None


def choose_value(df, table: DataFrame, profile: dict[str, ColumnProfile], preferred: str | None = None) -> str | None:
    if preferred in measures(profile):
        return preferred
    best = numeric_ranking(df, table).first()
    return best["column"] if best else None


def choose_pair(df: DataFrame, profile: dict[str, ColumnProfile], preferred=None) -> tuple[str, str] | None:
    names = measures(profile)
    if preferred and len(preferred) == 2 and set(preferred) <= set(names):
        return tuple(preferred)
    if len(names) < 2:
        return None
    best = strongest_correlation(correlation_pairs(df, names)).first()
    return (best["column_a"], best["column_b"]) if best else (names[0], names[1])


def choose_time(df: DataFrame, table: DataFrame, preferred: str | None = None, exclude=()) -> tuple:
    """``(column, axis kind)``; a preferred column is taken if it parses as an axis at all."""
    if preferred in df.columns and preferred not in set(exclude):
        found = time_axis_evidence(df, [preferred]).first()
        if found:
            return preferred, found["axis"]
    best = time_axis_ranking(df, table, exclude).first()
    if best:
        return best["column"], best["axis"]
    # Without a usable axis the first date column stands in, if there is one.
    dates = table.filter((F.col("detected_type") == DATE) & ~F.col("column").isin(*exclude)).orderBy("ord").select("column").first()
    return (dates["column"], "datetime") if dates else (None, None)


def choose_columns(
    df: DataFrame, table: DataFrame, profile: dict[str, ColumnProfile], category=None, value=None, time=None
) -> ColumnChoice:
    chosen = choose_value(df, table, profile, value)
    axis_column, axis = choose_time(df, table, time, {chosen} if chosen else ())
    return ColumnChoice(
        category=choose_category(table, profile, category),
        value=chosen,
        pair=choose_pair(df, profile),
        time=axis_column,
        axis=axis,
    )
