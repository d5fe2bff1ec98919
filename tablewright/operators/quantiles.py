"""Exact quantiles (linear interpolation) in two scans, or three of very large tables.

The first scan makes a mergeable sketch of every column. It names, for each wanted rank, two values between which the
value of that rank lies. The last scan counts what lies before, between and after these brackets and lists the distinct
values between them, so ranks are exact. Where a bracket would hold too many values, a scan in between sketches the
brackets alone: what is left is the square of a sketch's error. A rank that a sketch puts outside its bracket is seen in
the counts and looked for again where it is; nothing is sampled and nothing is dropped.

Slices with few distinct values use Spark's ``percentile``, which keeps a counter per value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..session import keep
from .base import join_slices, q, stack

# Up to this many distinct values per column the built-in aggregate is used per slice.
COUNTERS_PER_TASK = 1_000_000
# Values that the brackets of one column and slice may hold; larger ones are narrowed first.
BRACKET_ROWS = 4_000_000

# Size of a sketch of a whole column and of a slice's, with three times the rank error that holds in 99 of 100 cases.
_WHOLE, _SLICE = (4096, 0.0029), (1024, 0.0107)
# Quantiles read from a sketch; brackets are made of these.
_GRID = 1_000
_GRID_POINTS = f"array({', '.join(f'{i / _GRID!r}D' for i in range(_GRID + 1))})"


def number_columns(df: DataFrame, columns, by=()) -> DataFrame:
    """The columns as doubles. NaN and infinities are missing; adding zero turns negative zero into zero."""
    return df.select(*[q(b) for b in by], *[(finite(q(c).cast("double")) + 0.0).alias(c) for c in columns])


def many_distinct(df: DataFrame, columns, limit: int = COUNTERS_PER_TASK) -> set[str]:
    """The columns with too many distinct values for one counter per value, by a sketch over the whole table."""
    if not columns:
        return set()
    estimate = df.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return {c for c, d in zip(columns, estimate) if d > limit}


def quantiles(df: DataFrame, columns, probs, by=(), limit: int = COUNTERS_PER_TASK) -> DataFrame:
    """``(by..., column, n, q array<double>)`` with one quantile per probability, for columns with values."""
    columns, by, probs = list(columns), list(by), list(probs)
    numbers = number_columns(df, columns, by)
    many = many_distinct(numbers, columns, limit) if by else set(columns)
    few = [c for c in columns if c not in many]
    if not few:
        return bracketed_quantiles(numbers, columns, probs, by)
    wide = numbers.groupBy(*[q(b) for b in by]).agg(
        *[F.count(q(c)).alias(f"_n{i}") for i, c in enumerate(few)],
        *[F.percentile(q(c), F.array(*[F.lit(p) for p in probs])).alias(f"_q{i}") for i, c in enumerate(few)],
    )
    rows = [{"column": F.lit(c), "n": F.col(f"_n{i}"), "q": F.col(f"_q{i}")} for i, c in enumerate(few)]
    counted = stack(wide, by, rows).filter("n > 0")
    if not many:
        return counted
    return counted.unionByName(bracketed_quantiles(numbers, [c for c in columns if c in many], probs, by))


def bracketed_quantiles(numbers: DataFrame, columns, probs, by=(), bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """The quantiles of columns of doubles (see ``number_columns``), by brackets whatever their distinct values."""
    columns, by, probs = list(columns), list(by), list(probs)
    size, error = _SLICE if by else _WHOLE
    group = [*[q(b) for b in by], F.col("column")]
    sketch = [
        agg.alias(f"{name}{i}")
        for i, c in enumerate(columns)
        for name, agg in (
            ("n", F.count(q(c))), ("lo", F.min(q(c))), ("hi", F.max(q(c))), ("s", F.kll_sketch_agg_double(q(c), F.lit(size))),
        )
    ]
    wide = numbers.groupBy(*[q(b) for b in by]).agg(*sketch)
    first = stack(wide, by, [
        {"column": F.lit(c), "n": F.col(f"n{i}"), "before": F.lit(0).cast("bigint"), "here": F.col(f"n{i}"), "lo": F.col(f"lo{i}"),
         "hi": F.col(f"hi{i}"), "grid": F.expr(_grid(f"CASE WHEN n{i} > 0 THEN s{i} END"))}
        for i, c in enumerate(columns)
    ]).filter("n > 0")
    brackets = settled(_brackets(first, group, probs, error), by)
    if by:
        largest = brackets.agg(F.max("n")).first()[0] or 0
    else:
        largest = max((r["n"] for r in brackets), default=0)
    if largest * (2 * error + 3 / _GRID) * len(probs) > bracket_rows:
        cells = _placed(numbers, brackets, columns, by, len(probs))
        inside = F.col("at").isNotNull()
        parts = cells.groupBy(*group, "gap", "at").agg(
            F.count(F.lit(1)).alias("here"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.kll_sketch_agg_double(F.when(inside, F.col("v")), F.lit(size)).alias("_s"),
        ).withColumn("grid", F.expr(_grid("CASE WHEN at IS NOT NULL THEN _s END"))).drop("_s")
        brackets = settled(_brackets(_ranked(parts, group, "lo"), group, probs, error), by)
    while True:
        cells = _placed(numbers, brackets, columns, by, len(probs))
        value = F.when(F.col("at").isNotNull(), F.col("v"))
        parts = cells.groupBy(*group, "gap", value.alias("value")).agg(
            F.count(F.lit(1)).alias("here"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        )
        brackets = settled(_found(_ranked(parts, group, "lo"), group, probs), by)
        if by and not brackets.filter("missed").limit(1).count():
            return brackets.select(*group, "n", "q")
        if not by and not any(r["missed"] for r in brackets):
            return numbers.sparkSession.createDataFrame([(r["column"], r["n"], r["q"]) for r in brackets], "column string, n long, q array<double>")


def settled(per_column: DataFrame, by) -> DataFrame | list[Row]:
    """A table with a row per slice and column is cached; one with a row per column comes to the driver."""
    return keep(per_column) if by else per_column.collect()


def _grid(sketch: str) -> str:
    return f"kll_sketch_get_quantile_double({sketch}, {_GRID_POINTS})"


def _ranks(prob: float) -> tuple[str, str]:
    """The two ranks (from 0) between which a quantile lies."""
    return f"floor((n - 1) * {float(prob)!r}D)", f"ceil((n - 1) * {float(prob)!r}D)"


def _at(rank: str, value: str) -> str:
    """The value of the part of a column that holds a rank."""
    return f"max(CASE WHEN {rank} >= before AND {rank} < before + here THEN {value} END)"


def _brackets(parts: DataFrame, group, probs, error: float) -> DataFrame:
    """``lo`` and ``hi`` per probability, from disjoint parts of a column in order: ``before`` and ``here`` are exact
    counts, ``grid`` the quantiles of a part's sketch (NULL: the whole part is taken)."""
    margin = int(error * _GRID) + 2

    def bound(rank: str, low: bool) -> str:
        share = f"floor(({rank} - before) / here * {_GRID}) - {margin}" if low else f"ceil(({rank} - before + 1) / here * {_GRID}) + {margin}"
        point = f"coalesce(get(grid, CAST(greatest(0, least({_GRID}, {share})) AS INT)), {'lo' if low else 'hi'})"
        # The ends are known exactly.
        return _at(rank, f"CASE WHEN {last} = 0 THEN lo WHEN {first} = n - 1 THEN hi ELSE {point} END")

    lows, highs = [], []
    for p in probs:
        first, last = _ranks(p)
        lows.append(bound(first, True))
        highs.append(bound(last, False))
    return parts.groupBy(*group, "n").agg(F.expr(f"array({', '.join(lows)}) AS lo"), F.expr(f"array({', '.join(highs)}) AS hi"))


def _placed(numbers: DataFrame, brackets: DataFrame | list[Row], columns, by, n_probs: int) -> DataFrame:
    """``(by..., column, v, at, gap)`` per value: the first bracket it lies in, else NULL; and how many lie below it."""
    if by:
        ends = F.struct("lo", "hi")
        wide = brackets.groupBy(*[q(b) for b in by]).agg(
            *[F.max(F.when(F.col("column") == c, ends)).alias(f"_e{i}") for i, c in enumerate(columns)]
        )
        rows = join_slices(numbers, wide, by, broadcast=True)
        edges = {c: [(f"_e{i}.lo[{j}]", f"_e{i}.hi[{j}]") for j in range(n_probs)] for i, c in enumerate(columns)}
    else:
        rows = numbers
        edges = {r["column"]: [(f"{a!r}D", f"{b!r}D") for a, b in zip(r["lo"], r["hi"])] for r in brackets}
    cells = []
    for c in columns:
        if c in edges:
            v = "`" + c.replace("`", "``") + "`"
            at = " ".join(f"WHEN {v} >= {low} AND {v} <= {high} THEN {j}" for j, (low, high) in enumerate(edges[c]))
            gap = " + ".join(f"CAST({v} > {high} AS INT)" for _, high in edges[c])
            cells.append(F.struct(F.lit(c).alias("column"), q(c).alias("v"), F.expr(f"CASE {at} END").alias("at"), F.expr(gap).alias("gap")))
    if not cells:
        none = F.struct(F.lit("").alias("column"), F.lit(0.0).alias("v"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("gap"))
        return rows.limit(0).select(*[q(b) for b in by], F.inline(F.array(none)))
    return rows.select(*[q(b) for b in by], F.inline(F.array(*cells))).filter(F.col("v").isNotNull())


def _ranked(parts: DataFrame, group, order: str) -> DataFrame:
    """Adds to disjoint parts of each column the number of values before them, and of all."""
    earlier = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumns({
        "before": F.coalesce(F.sum("here").over(earlier), F.lit(0)), "n": F.sum("here").over(W.partitionBy(*group)),
    })


def _found(values: DataFrame, group, probs) -> DataFrame:
    """The quantiles, from single values and the gaps between brackets; or, if a rank is in a gap, that gap's ends."""
    ends = values.groupBy(*group, "n").agg(*[
        F.expr(f"{_at(rank, value)} AS {value}{side}{i}")
        for i, p in enumerate(probs)
        for side, rank in zip("ab", _ranks(p))
        for value in ("value", "lo", "hi")
    ])
    points = [f"valuea{i} + (valueb{i} - valuea{i}) * ((n - 1) * {float(p)!r}D - {_ranks(p)[0]})" for i, p in enumerate(probs)]
    missed = [f"valuea{i} IS NULL OR valueb{i} IS NULL" for i in range(len(probs))]
    return ends.select(
        *group, "n", F.expr(f"array({', '.join(points)}) AS q"), F.expr(" OR ".join(missed)).alias("missed"),
        F.array(*[f"loa{i}" for i in range(len(probs))]).alias("lo"), F.array(*[f"hib{i}" for i in range(len(probs))]).alias("hi"),
    )
