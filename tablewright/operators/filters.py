"""Conjunctive row filters on stored types, so that they reach the scan, with an audit of what was applied."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import to_date_time
from ..functions.numbers import to_number
from .base import CATEGORICAL, DATE, NUMERIC, classes, q


def _number(df: DataFrame, c: str) -> Column:
    return q(c) if classes(df)[c] == NUMERIC else to_number(q(c).cast("string"))


def _moment(df: DataFrame, c: str) -> Column:
    return q(c) if classes(df)[c] == DATE else to_date_time(q(c).cast("string"))


_WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _whole(v) -> int | None:
    """A value as a whole number, None if it is none: 1.9 is not cut to 1."""
    try:
        number = Decimal(v.strip() if isinstance(v, str) else str(v) if isinstance(v, float) else v)
        return int(number) if number == number.to_integral_value() else None
    except (ArithmeticError, ValueError, TypeError):
        return None


def _same_number(given, held) -> bool:
    """Whether a value that was cast to a decimal or double is still the one given; others are not numbers."""
    if not isinstance(held, (Decimal, float)):
        return True
    try:
        return Decimal(str(given).strip()) == Decimal(str(held)) or float(given) == float(held) and isinstance(held, float)
    except (ArithmeticError, ValueError, TypeError):
        return False


def _is_any(df: DataFrame, c: str, values) -> Column:
    """Whether the cell is one of the values; a value that the column's type cannot hold exactly matches nothing."""
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.StringType):
        kept = [F.lit(str(v).lower() if isinstance(v, bool) else str(v)) for v in values if v is not None]
    elif type(dtype) in _WHOLE:
        limit = 1 << _WHOLE[type(dtype)]
        kept = [F.lit(n).cast(dtype) for n in map(_whole, values) if n is not None and -limit <= n < limit]
    else:
        # Few literals of a type that only Spark reads: dates, decimals, booleans.
        casts = [F.lit(v).try_cast(dtype) for v in values]
        held = df.sparkSession.range(1).select(*[x.alias(f"v{i}") for i, x in enumerate(casts)]).first()
        kept = [F.lit(h).cast(dtype) for v, h in zip(values, held) if h is not None and _same_number(v, h)]
    return q(c).isin(*kept) if kept else F.lit(False)


def predicates(df: DataFrame, categorical=None, numeric=None, dates=None, end_of_day: bool = False):
    """``(condition, audit row)`` per usable filter; an empty value list or an unknown column filters nothing.

    A date range ends at midnight of its last day unless ``end_of_day`` is set.
    """
    out = []
    for c, values in (categorical or {}).items():
        if c in df.columns and values:
            out.append((_is_any(df, c, values), (c, "values", f"{c}: {len(values)} selected value(s)")))
    for c, bounds in (numeric or {}).items():
        if c in df.columns and bounds is not None:
            low, high = bounds
            text = f"{c}: between {low:.2f} and {high:.2f}"
            out.append((_number(df, c).between(F.lit(low), F.lit(high)), (c, "range", text)))
    for c, bounds in (dates or {}).items():
        if c in df.columns and bounds is not None:
            low, high = (str(b) for b in bounds)
            first, last = F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")
            when = _moment(df, c)
            inside = (when >= first) & (
                (when < last + F.make_dt_interval(F.lit(1))) if end_of_day else (when <= last)
            )
            out.append((inside, (c, "dates", f"{c}: {low[:10]} to {high[:10]}")))
    return out


def apply_filters(df: DataFrame, categorical=None, numeric=None, dates=None, end_of_day: bool = False):
    """The rows that meet all filters (a NULL meets none), and the list of filters as texts."""
    found = predicates(df, categorical, numeric, dates, end_of_day)
    if not found:
        return df, []
    return df.filter(reduce(and_, [c for c, _ in found])), [audit[2] for _, audit in found]


def filter_audit(df: DataFrame, categorical=None, numeric=None, dates=None, end_of_day: bool = False) -> DataFrame:
    """One row per applied filter, with the rows it keeps on its own; all are counted in one pass."""
    found = predicates(df, categorical, numeric, dates, end_of_day)
    counts = df.agg(*[F.count_if(c).alias(f"_{i}") for i, (c, _) in enumerate(found)])
    rows = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(a[0]).alias("column"), F.lit(a[1]).alias("kind"),
            F.lit(a[2]).alias("description"), F.col(f"_{i}").alias("rows_kept"),
        )
        for i, (_, a) in enumerate(found)
    ]
    return counts.select(F.inline_outer(F.array(*rows)))


def category_domain(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values a categorical filter can offer, in order."""
    from .profile import value_frequencies

    return value_frequencies(df, columns).filter(F.col("value").isNotNull()).select("column", "value")


def range_domain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest value per numeric or date column, as text for dates; constant columns offer nothing."""
    from .base import stack

    kinds = classes(df)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}")]
    def shown(name: str, kind: str) -> Column:
        return F.date_format(F.col(name), "yyyy-MM-dd") if kind == DATE else F.lit(None).cast("string")
    def number(name: str, kind: str) -> Column:
        return F.col(name).cast("double") + 0.0 if kind == NUMERIC else F.lit(None).cast("double")
    rows = [
        {
            "column": F.lit(c),
            "kind": F.lit(kinds[c]),
            "low": number(f"lo{i}", kinds[c]),
            "high": number(f"hi{i}", kinds[c]),
            "first_day": shown(f"lo{i}", kinds[c]),
            "last_day": shown(f"hi{i}", kinds[c]),
        }
        for i, c in enumerate(columns)
        if kinds[c] != CATEGORICAL
    ]
    domain = stack(df.agg(*aggs), (), rows)
    return domain.filter((F.col("kind") == DATE) & F.col("first_day").isNotNull() | (F.col("low") < F.col("high")))
