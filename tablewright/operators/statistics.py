"""Summaries: moments, frequent values, correlation, outliers, grouped metrics, histogram and box data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import correlation_reason, correlation_support, relationship_strength
from ..functions.numbers import to_number
from .base import CATEGORICAL, DATE, NUMERIC, as_text, classes, columns_of, data_columns, join_slices, q, stack
from .gram import gram_correlations
from .profile import value_frequencies
from .quantiles import number_columns, quantiles

# Pairs of columns per aggregation; more take matrix products, or per slice further passes over the table.
PAIRS_PER_PASS = 66
MISSING_GROUP = "Missing"


def _keys(by) -> list[Column]:
    return [q(b) for b in by]


# --- per column -----------------------------------------------------------------------------------------------


def moments(df: DataFrame, columns, by=()) -> DataFrame:
    """Count, mean, sample deviation and ends per column, in one pass."""
    numbers = number_columns(df, columns, by)
    wide = numbers.groupBy(*_keys(by)).agg(
        *[
            agg(q(c)).alias(f"{name}{i}")
            for i, c in enumerate(columns)
            for name, agg in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))
        ]
    )
    rows = [
        {
            "column": F.lit(c),
            "count": F.col(f"n{i}"),
            "mean": F.col(f"m{i}"),
            "std": F.col(f"s{i}"),
            "min": F.col(f"lo{i}"),
            "max": F.col(f"hi{i}"),
        }
        for i, c in enumerate(columns)
    ]
    return stack(wide, by, rows)


def numeric_summary(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Count, mean, deviation, ends and quartiles per numeric column, optionally per slice."""
    columns = columns or columns_of(df, NUMERIC, by)
    parts = quantiles(df, columns, (0.25, 0.5, 0.75), by).select(
        *_keys(by), "column", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")
    )
    return join_slices(moments(df, columns, by), parts, [*by, "column"], "left").select(
        *_keys(by), "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def top_values(df: DataFrame, columns=None, k: int = 5, by=(), include_null: bool = True) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller value, NULL counts as a value."""
    columns = columns or columns_of(df, CATEGORICAL, by)
    counts = value_frequencies(df, columns, by)
    if not include_null:
        counts = counts.filter(F.col("value").isNotNull())
    # The rank filter also runs before the shuffle, so a column's value list never meets in one task.
    order = W.partitionBy(*_keys(by), "column").orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def summarised_categories(profile: DataFrame) -> list[str]:
    """Categorical columns whose top values say something: at most 20 distinct, or at most half of the cells."""
    rows = profile.filter(
        F.col("detected_type").isin(CATEGORICAL, "Unknown")
        & (F.col("non_null") > 0)
        & ((F.col("distinct") <= 20) | (F.col("unique_ratio") <= 0.5))
    ).orderBy("ord")
    return [r["column"] for r in rows.select("column").collect()]


def leading_share(top: DataFrame) -> DataFrame:
    """Per column, the leading value and its share of the top values listed (not of all rows)."""
    return top.groupBy("column").agg(
        F.min_by("value", "rank").alias("value"),
        F.max("n").alias("n"),
        (F.max("n") / F.greatest(F.sum("n"), F.lit(1))).alias("share"),
    )


def widest_spread(summary: DataFrame) -> DataFrame:
    return _largest(summary, F.coalesce(F.col("std"), F.lit(0.0)), "std")


def widest_range(summary: DataFrame) -> DataFrame:
    return _largest(summary, F.coalesce(F.col("max") - F.col("min"), F.lit(0.0)), "range")


def heaviest_outlier(outliers: DataFrame) -> DataFrame:
    return _largest(outliers, F.col("share"), "share")


def _largest(table: DataFrame, size: Column, name: str) -> DataFrame:
    """The column with the largest size above zero; ties go to the smaller name."""
    best = F.min_by("column", F.struct(-F.col(name), "column"))
    return (
        table.select("column", size.alias(name))
        .agg(best.alias("column"), F.max(name).alias(name))
        .filter(F.col(name) > 0)
    )


def completeness(df: DataFrame, by=()) -> DataFrame:
    """Filled cells over all cells."""
    names = data_columns(df, by)
    empty = sum((F.count_if(q(c).isNull()) for c in names), F.lit(0))
    sums = df.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("rows"), empty.alias("missing"))
    cells = F.greatest(F.col("rows") * max(len(names), 1), F.lit(1))
    return sums.withColumns(
        {
            "columns": F.lit(len(names)),
            "completeness": F.greatest(F.lit(0.0), F.lit(1.0) - F.col("missing") / cells),
        }
    )


# --- correlation ------------------------------------------------------------------------------------------------


def correlation_pairs(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Pearson correlation and complete rows of every pair of columns; constant columns give NULL.

    Pairs are moments of one aggregation over the table; those of wide tables are blocks of matrix products, also in
    one scan. A pair uses only the rows where both cells are filled, so each side's deviation is taken over those rows.
    """
    columns = list(columns or columns_of(df, NUMERIC, by))
    pairs = list(combinations(columns, 2))
    numbers = number_columns(df, columns, by)
    if not by and len(pairs) > PAIRS_PER_PASS:
        return gram_correlations(numbers, columns)
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        aggs = []
        for i, (a, b) in enumerate(chunk):
            both = q(a).isNotNull() & q(b).isNotNull()
            aggs += [
                F.covar_samp(q(a), q(b)).alias(f"c{i}"),
                F.stddev_samp(F.when(both, q(a))).alias(f"a{i}"),
                F.stddev_samp(F.when(both, q(b))).alias(f"b{i}"),
                F.count_if(both).alias(f"n{i}"),
                # Rounding can leave a constant column a deviation; its ends cannot differ.
                (F.min(F.when(both, q(a))) < F.max(F.when(both, q(a)))).alias(f"u{i}"),
                (F.min(F.when(both, q(b))) < F.max(F.when(both, q(b)))).alias(f"v{i}"),
            ]
        rows = []
        for i, (a, b) in enumerate(chunk):
            r = F.when(F.col(f"u{i}") & F.col(f"v{i}"), F.try_divide(F.col(f"c{i}"), F.col(f"a{i}") * F.col(f"b{i}")))
            rows.append(
                {
                    "pair_ord": F.lit(start + i),
                    "column_a": F.lit(a),
                    "column_b": F.lit(b),
                    "r": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) * F.when(r.isNotNull(), 1.0),
                    "n": F.col(f"n{i}"),
                }
            )
        parts.append(stack(numbers.groupBy(*_keys(by)).agg(*aggs), by, rows))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def correlation_matrix(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Both halves and the diagonal in long form, for columns that are not constant."""
    pairs = correlation_pairs(df, columns, by).filter(F.col("r").isNotNull())
    one = F.lit(1.0)
    cells = F.array(
        F.struct(F.col("column_a").alias("row"), F.col("column_b").alias("column"), F.col("r").alias("r")),
        F.struct(F.col("column_b").alias("row"), F.col("column_a").alias("column"), F.col("r").alias("r")),
        F.struct(F.col("column_a").alias("row"), F.col("column_a").alias("column"), one.alias("r")),
        F.struct(F.col("column_b").alias("row"), F.col("column_b").alias("column"), one.alias("r")),
    )
    return pairs.select(*_keys(by), F.inline_outer(cells)).distinct()


def strongest_correlation(pairs: DataFrame, by=()) -> DataFrame:
    """The pair with the largest effect, then the larger sample, then the earlier columns; with its label."""
    usable = pairs.filter((F.col("n") >= 3) & F.col("r").isNotNull())
    order = F.struct(-F.abs("r"), -F.col("n"), F.col("pair_ord"))
    best = usable.groupBy(*_keys(by)).agg(F.min_by(F.struct("column_a", "column_b", "r", "n"), order).alias("_s"))
    best = best.filter(F.col("_s").isNotNull()).select(*_keys(by), "_s.*")
    label = correlation_support(F.col("n"), F.col("r"))
    return best.withColumn("support", label).withColumns(
        {
            "strength": relationship_strength(F.col("r")),
            "reason": correlation_reason(F.col("n"), F.col("r"), F.col("support")),
        }
    )


# --- outliers ---------------------------------------------------------------------------------------------------


def outlier_summary(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Values outside 1.5 interquartile ranges, for columns with four values and four distinct values at least.

    Two passes: quartiles and ends, then counts against those bounds. The bounds have one row per slice.
    """
    columns = list(columns or columns_of(df, NUMERIC, by))
    by = list(by)
    bounds = quantiles(df, columns, (0.0, 0.25, 0.5, 0.75, 1.0), by)
    iqr = F.col("q")[3] - F.col("q")[1]
    bounds = bounds.select(
        *_keys(by), "column", "n",
        F.col("q")[0].alias("min"), F.col("q")[2].alias("median"), F.col("q")[4].alias("max"),
        (F.col("q")[1] - iqr * 1.5).alias("lower_bound"), (F.col("q")[3] + iqr * 1.5).alias("upper_bound"),
        (iqr != 0).alias("_spread"),
    ).filter(F.col("_spread") & (F.col("n") >= 4))
    counted = _against_bounds(df, columns, by, bounds, ["n", "median", "max", "lower_bound", "upper_bound"], {
        "outliers": lambda v, b: F.count_if((v < b("lower_bound")) | (v > b("upper_bound"))),
        # Second smallest below second largest: four distinct values or more, without counting them.
        "_second": lambda v, b: F.min(F.when(v > b("min"), v)),
        "_second_last": lambda v, b: F.max(F.when(v < b("max"), v)),
    })
    return counted.filter((F.col("outliers") > 0) & (F.col("_second") < F.col("_second_last"))).select(
        *_keys(by), "column", F.col("outliers"), (F.col("outliers") / F.col("n")).alias("share"),
        "lower_bound", "upper_bound", "median", "max", "n",
    )


def _against_bounds(df: DataFrame, columns, by, bounds: DataFrame, keep_facts, aggs) -> DataFrame:
    """Aggregate each column's values against its bounds.

    For a whole table the bounds (one row per column) become literals of one wide aggregation. Per slice, cells
    join their slice's bounds.
    """
    if not by:
        known = {r["column"]: r for r in bounds.collect()}
        names = [c for c in columns if c in known]
        if not names:
            extra = [F.lit(None).cast("double").alias(n) for n in aggs]
            return bounds.limit(0).select("column", *keep_facts, *extra)
        wide = number_columns(df, names).agg(*[
            agg(q(c), lambda f, c=c: F.lit(known[c][f])).alias(f"{name}{i}")
            for i, c in enumerate(names)
            for name, agg in aggs.items()
        ])
        stored = dict(bounds.dtypes)
        rows = [
            {"column": F.lit(c), **{f: F.lit(known[c][f]).cast(stored[f]) for f in keep_facts},
             **{name: F.col(f"{name}{i}") for name in aggs}}
            for i, c in enumerate(names)
        ]
        return stack(wide, (), rows)
    cells = number_columns(df, columns, by).unpivot(_keys(by), [q(c) for c in columns], "column", "v")
    joined = join_slices(cells.filter(F.col("v").isNotNull()), bounds, [*by, "column"], broadcast=True)
    return joined.groupBy(*_keys(by), "column", *keep_facts).agg(
        *[agg(F.col("v"), F.col).alias(name) for name, agg in aggs.items()]
    )


def outlier_table(outliers: DataFrame) -> DataFrame:
    """The summary for display: two decimals, most outliers first."""
    return outliers.select(
        "column", "outliers", F.bround(F.col("share") * 100, 0).cast("int").alias("share_pct"),
        F.bround("lower_bound", 2).alias("lower_bound"), F.bround("upper_bound", 2).alias("upper_bound"),
    ).orderBy(F.desc("outliers"), "column")


# --- grouped metrics ----------------------------------------------------------------------------------------------

_AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def grouped_metric(
    df: DataFrame, group: str, value: str | None = None, agg: str = "count", top_n: int | None = 15,
    sort: str = "descending",
) -> DataFrame:
    """A metric per group, sorted and cut to the first groups (a top-k report), or all groups with ``top_n`` None.

    ``count`` counts rows, whatever the value. For the others rows without a value are left out. A missing
    group is called "Missing"; where the group is a date, rows without it are left out.
    """
    kinds = classes(df)
    counting = value is None or agg == "count"
    rows = df.withColumn("_v", F.lit(1) if counting else _as_number(df, value, kinds))
    if not counting:
        rows = rows.filter(F.col("_v").isNotNull())
    if kinds[group] == DATE and not counting:
        rows = rows.filter(q(group).isNotNull()).withColumn("_g", q(group))
    else:
        rows = rows.withColumn("_g", F.coalesce(as_text(q(group), df.schema[group].dataType), F.lit(MISSING_GROUP)))
    if counting:
        out = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("value"))
    elif agg == "median":
        out = quantiles(rows, ["_v"], (0.5,), ["_g"]).select("_g", F.col("q")[0].alias("value"))
    else:
        out = rows.groupBy("_g").agg(_AGGREGATES.get(agg, F.avg)("_v").alias("value"))
    if sort == "ascending":
        order = [F.asc("value"), F.asc("_g")]
    elif sort == "natural":
        order = {
            DATE: [F.asc("_g")],
            NUMERIC: [F.expr("try_cast(_g as double)").asc_nulls_last(), F.asc("_g")],
        }.get(kinds[group], [F.lower("_g").asc(), F.asc("_g")])
    else:
        order = [F.desc("value"), F.asc("_g")]
    ordered = out.orderBy(*order)
    # A limit gathers its rows in one task; without one the sort stays spread over the cluster.
    shown = ordered if top_n is None else ordered.limit(top_n)
    return shown.select(F.col("_g").alias(group), "value")


def _as_number(df: DataFrame, c: str, kinds) -> Column:
    return q(c).cast("double") if kinds[c] == NUMERIC else to_number(q(c).cast("string"))


def category_frequency(df: DataFrame, column: str, k: int = 10, include_null: bool = False) -> DataFrame:
    return top_values(df, [column], k, include_null=include_null)


# --- chart data ---------------------------------------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 12, clip: tuple[float, float] | None = None) -> DataFrame:
    """Counts in equal bins between the ends; ``clip`` pulls values to two quantiles first, for display.

    A constant column gives one bin. Empty bins are listed with a count of zero.
    """
    numbers = number_columns(df, [column]).select(q(column).alias("v")).filter(F.col("v").isNotNull())
    probs = [0.0, 0.5, 1.0, *(clip or ())]
    found = quantiles(numbers, ["v"], probs).first()
    if found is None:
        empty = "bin int, low double, high double, n bigint, median double"
        return df.sparkSession.createDataFrame([], empty)
    points = found["q"]
    low, median, high = points[:3]
    if clip:
        low, high = points[3], points[4]
    if low == high:
        bins = 1
        bucket = F.lit(1)
    else:
        clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("v")))
        bucket = F.least(F.width_bucket(clipped, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counts = numbers.groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.lit(median).alias("median"),
    )


def box_stats(df: DataFrame, columns, by=()) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the number of values beyond."""
    columns, by = list(columns), list(by)
    parts = quantiles(df, columns, (0.25, 0.5, 0.75), by)
    iqr = F.col("q")[2] - F.col("q")[0]
    parts = parts.select(
        *_keys(by), "column", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        (F.col("q")[0] - iqr * 1.5).alias("_low"), (F.col("q")[2] + iqr * 1.5).alias("_high"),
    )
    return _against_bounds(df, columns, by, parts, ["n", "q1", "median", "q3"], {
        "whisker_low": lambda v, b: F.min(F.when(v >= b("_low"), v)),
        "whisker_high": lambda v, b: F.max(F.when(v <= b("_high"), v)),
        "fliers": lambda v, b: F.count_if((v < b("_low")) | (v > b("_high"))),
    })


def box_by_group(df: DataFrame, group: str, value: str, max_groups: int = 12) -> DataFrame:
    """Box statistics of the most frequent groups (a top-k report)."""
    kinds = classes(df)
    rows = df.select(
        as_text(q(group), df.schema[group].dataType).alias("group"), _as_number(df, value, kinds).alias("value")
    ).dropna()
    top = (
        rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group").limit(max_groups)
        .select("group")
    )
    # At most max_groups rows.
    shown = rows.join(F.broadcast(top), "group", "left_semi")
    return box_stats(shown, ["value"], ["group"]).drop("column")


def pair_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """The complete pairs of two measures."""
    kinds = classes(df)
    return df.select(_as_number(df, x, kinds).alias("x"), _as_number(df, y, kinds).alias("y")).dropna()
