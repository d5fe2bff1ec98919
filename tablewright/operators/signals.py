"""Segment gaps and trends with evidence labels, for a whole table or per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_date_time
from ..functions.labels import segment_reason, segment_support, trend_reason, trend_support
from ..functions.numbers import to_number
from ..functions.text import strip
from .base import DATE, NUMERIC, as_text, classes, q
from .profile import value_frequencies

# Fixed value: groups of one row are not compared.
MIN_GROUP = 2

NUMERIC_AXIS, DATE_AXIS = "numeric", "datetime"


def effect_size(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    """Difference of means over the root mean square of the deviations; 0 where nothing varies."""
    a, b = F.coalesce(sd_a, F.lit(0.0)), F.coalesce(sd_b, F.lit(0.0))
    pooled = F.sqrt((a * a + b * b) / 2)
    return F.coalesce(F.try_divide(mean_a - mean_b, pooled), F.lit(0.0))


def segment_gap(df: DataFrame, category: str, value: str, by=()) -> DataFrame:
    """The group with the highest and the one with the lowest mean, and how far apart they are."""
    kinds = classes(df)
    keys = [q(b) for b in by]
    number = q(value).cast("double") if kinds[value] == NUMERIC else to_number(q(value))
    rows = df.select(
        *keys, strip(as_text(q(category), df.schema[category].dataType)).alias("_g"), number.alias("_v")
    ).filter(F.col("_g").isNotNull() & F.col("_v").isNotNull())
    groups = (
        rows.groupBy(*keys, "_g")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"), F.stddev_samp("_v").alias("sd"))
        .filter(F.col("n") >= MIN_GROUP)
    )
    side = F.struct(F.col("_g").alias("label"), "n", "m", "sd")
    order = F.struct(-F.col("m"), F.col("_g"))
    ends = groups.groupBy(*keys).agg(
        F.min_by(side, order).alias("t"), F.max_by(side, order).alias("b"), F.count(F.lit(1)).alias("group_count")
    )
    out = ends.filter("group_count >= 2").select(
        *keys,
        F.lit(category).alias("category_column"),
        F.lit(value).alias("numeric_column"),
        F.col("t.label").alias("top_label"), F.col("t.m").alias("top_value"),
        F.col("b.label").alias("bottom_label"), F.col("b.m").alias("bottom_value"),
        "group_count",
        F.least("t.n", "b.n").alias("min_group_size"),
        effect_size(F.col("t.m"), F.col("t.sd"), F.col("b.m"), F.col("b.sd")).alias("effect_size"),
    )
    label = segment_support(F.col("group_count"), F.col("min_group_size"), F.col("effect_size"))
    return out.withColumn("support", label).withColumn("reason", segment_reason(
        F.col("group_count"), F.col("min_group_size"), F.col("effect_size"), F.col("support"),
    ))


# --- time ---------------------------------------------------------------------------------------------------------


def time_axis_evidence(df: DataFrame, columns) -> DataFrame:
    """For each column: would it do as a number axis or as a date axis, and how well does it cover the rows?

    Each distinct value is parsed once. A stored number is tried as a number first, everything else as a date
    first; an axis needs half of the rows and two distinct values.
    """
    kinds = classes(df)
    columns = list(columns)
    # Ids and dates alike are compared by value, so distinct values are counted on the parsed form.
    stored = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])
    freq = value_frequencies(df, columns).withColumn("stored", F.element_at(stored, F.col("column")))
    number = F.when(F.col("stored") == NUMERIC, F.col("value").try_cast("double")).when(
        F.col("stored") != DATE, to_number(F.col("value"))
    )
    moment = F.when(F.col("stored") == DATE, F.col("value").try_cast("timestamp_ntz")).when(
        F.col("stored") != NUMERIC, to_date_time(F.col("value"))
    )
    seconds = F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)
    both = F.array(
        F.struct(F.lit(NUMERIC_AXIS).alias("axis"), number.alias("t")),
        F.struct(F.lit(DATE_AXIS).alias("axis"), seconds.alias("t")),
    )
    points = freq.select("column", "stored", "n", F.inline_outer(both))
    per_point = points.groupBy("column", "stored", "axis", "t").agg(F.sum("n").alias("n"))
    per_axis = per_point.groupBy("column", "stored", "axis").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("valid"),
        F.count("t").alias("periods"),
        (F.max("t") - F.min("t")).alias("span"),
    )
    usable = per_axis.withColumn("coverage", F.try_divide("valid", "rows")).filter(
        "periods > 1 and coverage >= 0.5"
    )
    first = F.when((F.col("stored") == NUMERIC) == (F.col("axis") == NUMERIC_AXIS), 0).otherwise(1)
    picked = usable.groupBy("column").agg(
        F.min_by(F.struct("axis", "rows", "valid", "periods", "span", "coverage"), first).alias("_s")
    )
    return picked.select("column", "_s.*")


def axis_value(df: DataFrame, column: str, axis: str) -> Column:
    kind = classes(df)[column]
    if axis == NUMERIC_AXIS:
        return q(column).cast("double") if kind == NUMERIC else to_number(q(column))
    return q(column).cast("timestamp_ntz") if kind == DATE else to_date_time(q(column))


def time_series(df: DataFrame, time: str, value: str, axis: str = DATE_AXIS, by=()) -> DataFrame:
    """The mean per point in time; rows without a time or a value are left out."""
    keys = [q(b) for b in by]
    number = q(value).cast("double") if classes(df)[value] == NUMERIC else to_number(q(value))
    points = df.select(*keys, axis_value(df, time, axis).alias("t"), number.alias("v"))
    return points.dropna(subset=["t", "v"]).groupBy(*keys, "t").agg(
        F.avg("v").alias("value"), F.count(F.lit(1)).alias("n")
    )


def trend(df: DataFrame, time: str, value: str, axis: str = DATE_AXIS, by=()) -> DataFrame:
    """First and last mean along the axis, with direction, coverage and label; no global sort is needed."""
    keys = [q(b) for b in by]
    number = q(value).cast("double") if classes(df)[value] == NUMERIC else to_number(q(value))
    cells = df.select(*keys, axis_value(df, time, axis).alias("t"), number.alias("v"))
    points = cells.groupBy(*keys, F.when(F.col("v").isNotNull(), F.col("t")).alias("t")).agg(
        F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")
    )
    real = F.col("t").isNotNull()
    ends = points.groupBy(*keys).agg(
        F.sum("n").alias("_rows"),
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("sample_size"),
        F.count("t").alias("distinct_periods"),
        F.min_by("m", "t").alias("first_value"),
        F.max_by("m", "t").alias("last_value"),
        F.min("t").alias("_start"),
        F.max("t").alias("_end"),
    )
    last, first = F.col("last_value"), F.col("first_value")
    direction = F.when(last > first, "upward").when(last < first, "downward").otherwise("flat")
    out = ends.filter("distinct_periods > 0").select(
        *keys,
        F.lit(time).alias("time_column"), F.lit(value).alias("value_column"), F.lit(axis).alias("axis_kind"),
        "first_value", "last_value", direction.alias("direction"),
        _axis_label(F.col("_start"), axis).alias("start_label"), _axis_label(F.col("_end"), axis).alias("end_label"),
        "sample_size", "distinct_periods", (F.col("sample_size") / F.col("_rows")).alias("coverage"),
    )
    label = trend_support(F.col("sample_size"), F.col("distinct_periods"), F.col("coverage"))
    return out.withColumn("support", label).withColumn("reason", trend_reason(
        F.col("sample_size"), F.col("distinct_periods"), F.col("coverage"), F.col("support"),
    ))


def _axis_label(t: Column, axis: str) -> Column:
    if axis == DATE_AXIS:
        return F.date_format(t, "yyyy-MM-dd")
    return F.when(t == F.floor(t), F.floor(t).cast("string")).otherwise(t.cast("string"))
