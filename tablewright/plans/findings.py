"""One row of findings per dataset or slice: the input of narratives, documents and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import CATEGORICAL, DATE, NUMERIC, classes, columns_of, data_columns, q
from ..operators.profile import missing_counts
from ..operators.scoring import chart_recommendations, confidence_score, quality_metrics, quality_score
from ..operators.selection import ColumnChoice
from ..operators.signals import segment_gap, trend
from ..session import keep
from ..operators.statistics import completeness, correlation_pairs, moments, outlier_summary, strongest_correlation, top_values

SLICE = "slice"


def with_slice(df: DataFrame, by: str | None) -> DataFrame:
    """Name the slice each row belongs to; without a slicing column the whole table is one slice."""
    value = F.coalesce(q(by).cast("string"), F.lit("Missing")) if by else F.lit("all")
    return df.withColumn(SLICE, value)


def slice_findings(
    raw: DataFrame, active: DataFrame, types: dict[str, str], choice: ColumnChoice, by: str | None = None,
    measures: list[str] | None = None, subset=None,
) -> DataFrame:
    """Scores and signals of every slice.

    ``raw`` is the table before cleaning (its quality is scored), ``active`` the typed view (its signals are
    read). Every part is an aggregate with one row per slice, so the joins at the end are small.
    """
    raw, active = with_slice(raw, by), with_slice(active, by)
    dims = [SLICE] + ([by] if by else [])
    values = active.drop(by) if by else active
    key = [SLICE]
    raw_values = raw.drop(by) if by else raw
    raw_types = {c: t for c, t in types.items() if c in data_columns(raw_values, key)}
    measures = [c for c in (measures or columns_of(values, NUMERIC, key)) if c in values.columns]
    categories = columns_of(values, CATEGORICAL, key)
    kinds = classes(values, key)

    scored = quality_score(quality_metrics(raw_values, raw_types, subset, key))
    filled = completeness(values, key).select(
        SLICE, F.col("rows").alias("active_rows"), F.col("columns").alias("active_columns"),
        F.col("missing").alias("active_missing"), "completeness",
    )
    parts = [scored, filled]
    first_missing = F.struct(-F.col("missing"), F.col("column"))
    gaps = missing_counts(raw_values, key).groupBy(SLICE).agg(
        F.min_by(F.struct("column", "missing"), first_missing).alias("top_missing")
    )
    parts.append(gaps)
    if measures:
        outliers = outlier_summary(values, measures, key).groupBy(SLICE).agg(
            F.min_by(F.struct("column", "share", "outliers"), F.struct(-F.col("share"), F.col("column"))).alias(
                "top_outlier"
            ),
            F.sort_array(F.collect_list(F.struct("column", "outliers", "share"))).alias("outlier_columns"),
        )
        spread = moments(values, measures, key).groupBy(SLICE).agg(
            F.max_by("column", "std").alias("widest_spread"),
            F.max_by("column", F.col("max") - F.col("min")).alias("widest_range"),
        )
        parts += [outliers, spread]
    if len(measures) > 1:
        best = strongest_correlation(correlation_pairs(values, measures, key), key)
        parts.append(best.select(SLICE, F.struct(*[c for c in best.columns if c != SLICE]).alias("correlation")))
    if choice.time and choice.value:
        moved = trend(values, choice.time, choice.value, choice.axis, key)
        parts.append(moved.select(SLICE, F.struct(*[c for c in moved.columns if c != SLICE]).alias("trend")))
    if choice.category and choice.category != by and choice.value:
        gap = segment_gap(values, choice.category, choice.value, key)
        parts.append(gap.select(SLICE, F.struct(*[c for c in gap.columns if c != SLICE]).alias("segment")))
    if categories:
        first = categories[0]
        top = top_values(values, [first], 5, key).groupBy(SLICE).agg(
            F.struct(
                F.lit(first).alias("column"), F.min_by("value", "rank").alias("value"), F.max("n").alias("n"),
                (F.max("n") / F.greatest(F.sum("n"), F.lit(1))).alias("share"),
            ).alias("leading")
        )
        parts.append(top)
    if choice.category and choice.category in values.columns:
        bars = top_values(values, [choice.category], 3, key, include_null=False).groupBy(SLICE).agg(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("category_top")  # three at most
        )
        parts.append(bars)
    out = parts[0]
    for i, part in enumerate(parts[1:], start=1):
        out = out.join(part, SLICE, "left")
        # One row per slice: caching in between keeps the generated code of the chain of joins small.
        out = keep(out) if i % 3 == 0 else out
    out = keep(out)
    charts = [
        (i, k, cols) for i, k, cols in chart_recommendations(choice) if not by or by not in cols
    ]
    absent = {
        "top_outlier": "struct<column:string,share:double,outliers:bigint>",
        "outlier_columns": "array<struct<column:string,outliers:bigint,share:double>>",
        "widest_spread": "string",
        "widest_range": "string",
        "correlation": "struct<column_a:string,column_b:string,r:double,n:bigint,support:string,strength:string,"
                       "reason:string>",
        "trend": "struct<time_column:string,value_column:string,axis_kind:string,first_value:double,"
                 "last_value:double,direction:string,start_label:string,end_label:string,sample_size:bigint,"
                 "distinct_periods:bigint,coverage:double,support:string,reason:string>",
        "segment": "struct<category_column:string,numeric_column:string,top_label:string,top_value:double,"
                   "bottom_label:string,bottom_value:double,group_count:bigint,min_group_size:bigint,"
                   "effect_size:double,support:string,reason:string>",
        "leading": "struct<column:string,value:string,n:bigint,share:double>",
        "category_top": "array<struct<rank:int,value:string,n:bigint>>",
    }
    out = out.withColumns({n: F.lit(None).cast(t) for n, t in absent.items() if n not in out.columns})
    chart_type = "array<struct<key:string,columns:array<string>>>"
    chart_array = F.array(*[
        F.struct(F.lit(k).alias("key"), F.array(*[F.lit(c) for c in cols]).alias("columns")) for _, k, cols in charts
    ]).cast(chart_type)
    out = out.withColumns(
        {
            "charts": chart_array,
            "chart_keys": F.array(*[F.lit(k) for _, k, _ in charts]).cast("array<string>"),
            "numeric_columns": F.lit(sum(k == NUMERIC for k in kinds.values())),
            "categorical_columns": F.lit(sum(k == CATEGORICAL for k in kinds.values())),
            "date_columns": F.lit(sum(k == DATE for k in kinds.values())),
            "duplicate_subset": F.lit(", ".join(subset) if subset else None).cast("string"),
        }
    )
    facts = {
        "raw_rows": F.col("rows"),
        "rows": F.coalesce("active_rows", F.lit(0)),
        "missing_ratio": F.coalesce(F.lit(1.0) - F.col("completeness"), F.lit(0.0)),
        "invalid_values": F.col("invalid_numeric") + F.col("invalid_dates"),
        "max_outlier_share": F.coalesce("top_outlier.share", F.lit(0.0)),
    }
    # One row per slice, read by every text and document: computed once, and a small plan for what follows.
    return keep(confidence_score(out.withColumns(facts)))
