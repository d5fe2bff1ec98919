"""Cleaning per slice: every slice is cleaned as if it were a table of its own, all in the same few jobs.

What cleaning decides per column (identifiers, high cardinality, fill values) becomes a table with a row per slice, which
is joined to the rows; nothing per slice comes to the driver, so there may be any number of slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleaningConfig
from ..session import keep
from .base import CATEGORICAL, DATE, NUMERIC, ROW_ID, UNKNOWN, classes, data_columns, join_slices, q, stack
from .cardinality import has_id_name
from .cleaning import UNKNOWN_FILL, standardize
from .duplicates import first_rows
from .profile import (
    HIGH_CARDINALITY_MIN, HIGH_CARDINALITY_RATIO, ID_NAME_RATIO, ID_SEQUENCE_MIN, ID_SEQUENCE_RATIO, distinct_values, sequences,
)
from .quantiles import quantiles
from .statistics import top_values

LOG_COLUMNS = ("ord", "column", "action", "n", "value")


@dataclass
class SlicedCleanResult:
    """The cleaned rows, the typed ones before filling, and the log: ``(by..., ord, column, action, n, value)``."""

    rows: DataFrame
    standardized: DataFrame
    log: DataFrame


def slice_facts(typed: DataFrame, types: dict[str, str], by, row_id: str = ROW_ID) -> DataFrame:
    """``(by..., column, rows, non_null, distinct, is_id, high_cardinality)``, one row per slice and column."""
    by = list(by)
    keys = [q(b) for b in by]
    names = data_columns(typed, by)
    kinds = {c: types.get(c, k) for c, k in classes(typed, by).items()}
    wide = typed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(q(c)).alias(f"_n{i}") for i, c in enumerate(names)])
    cells = stack(wide, by, [
        {"column": F.lit(c), "kind": F.lit(kinds[c]), "rows": F.col("_rows"), "non_null": F.col(f"_n{i}"), "named": F.lit(has_id_name(c))}
        for i, c in enumerate(names)
    ])
    # Dates need no count: no rule asks for it.
    counted = [c for c in names if kinds[c] != DATE]
    values = distinct_values(typed, counted, by)
    facts = join_slices(cells, values, [*by, "column"], "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    numbers = [c for c in counted if kinds[c] == NUMERIC]
    if numbers and row_id in typed.columns:
        runs = sequences(typed, numbers, row_id, by)
        runs = stack(runs, by, [{"column": F.lit(c), "_values": F.col(f"v{i}")} for i, c in enumerate(numbers)])
        facts = join_slices(facts, runs, [*by, "column"], "left")
    else:
        facts = facts.withColumn("_values", F.lit(None).cast("long"))
    ratio = F.try_divide(F.col("distinct"), F.col("non_null"))
    text = F.col("kind").isin(CATEGORICAL, UNKNOWN)
    is_id = (F.col("named") & (ratio >= ID_NAME_RATIO)) | (
        F.col("_values").isNotNull() & (ratio >= ID_SEQUENCE_RATIO) & (F.col("non_null") >= ID_SEQUENCE_MIN)
    )
    return facts.withColumns({
        "is_id": F.coalesce(is_id, F.lit(False)),
        "high_cardinality": text & F.coalesce((F.col("non_null") >= HIGH_CARDINALITY_MIN) & (ratio >= HIGH_CARDINALITY_RATIO), F.lit(False)),
    }).drop("_values", "named")


def _strategies(kinds: dict[str, str], cfg: CleaningConfig) -> dict[str, tuple[str, str | None]]:
    """Per column the strategy that holds unless a slice protects it, and what would protect it."""
    out = {}
    for c, kind in kinds.items():
        if kind == NUMERIC:
            own = cfg.numeric_column_strategies.get(c)
            out[c] = (own or cfg.numeric_missing_strategy, None if own else "is_id")
        elif kind in (CATEGORICAL, UNKNOWN):
            own = cfg.categorical_column_strategies.get(c)
            out[c] = (own or cfg.categorical_missing_strategy, None if own else "high_cardinality")
    return out


def clean_slices(df: DataFrame, types: dict[str, str], by, subset=None, config=None, row_id: str = ROW_ID) -> SlicedCleanResult:
    """Standardise, fill and drop repeats within each slice of ``by``; a NULL slice is a slice.

    Types and strategies hold for all slices. The slicing columns stay as they are; row numbers are unique in the table.
    """
    cfg, by = CleaningConfig.of(config), list(by)
    keys = [q(b) for b in by]
    subset = [c for c in subset if c not in by] if subset else None
    raw = {b: f"_by{i}" for i, b in enumerate(by)}
    typed = standardize(df.select("*", *[q(b).alias(a) for b, a in raw.items()]), types, cfg)
    # Parsed once, read by the facts, the fills and the result.
    typed = keep(typed.select(*[q(raw[c]).alias(c) if c in raw else q(c) for c in df.columns]))
    names = data_columns(typed, by)
    stored = classes(typed, by)
    kinds = {c: types.get(c, stored[c]) for c in names}
    strategies = _strategies(kinds, cfg)
    facts = slice_facts(typed, types, by, row_id)

    parts = []
    means = [c for c, (s, _) in strategies.items() if s == "mean" and kinds[c] == NUMERIC]
    medians = [c for c, (s, _) in strategies.items() if s not in ("mean", "leave") and kinds[c] == NUMERIC]
    modes = [c for c, (s, _) in strategies.items() if s == "mode" and kinds[c] != NUMERIC]
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if means:
        wide = typed.groupBy(*keys).agg(*[F.avg(q(c)).alias(f"_m{i}") for i, c in enumerate(means)])
        parts.append(stack(wide, by, [{"column": F.lit(c), "number": F.col(f"_m{i}"), "word": text} for i, c in enumerate(means)]))
    if medians:
        parts.append(quantiles(typed, medians, (0.5,), by).select(*keys, "column", F.col("q")[0].alias("number"), text.alias("word")))
    if modes:
        best = top_values(typed, modes, 1, by, include_null=False)
        parts.append(best.select(*keys, "column", number.alias("number"), F.col("value").alias("word")))
    plan = facts.withColumn("strategy", _per_column({c: s for c, (s, _) in strategies.items()})).withColumn(
        "rule", _per_column({c: r for c, (_, r) in strategies.items() if r}),
    ).withColumn("protected", F.when(F.col("rule") == "is_id", F.col("is_id")).when(F.col("rule") == "high_cardinality", F.col("high_cardinality")).otherwise(F.lit(False)))
    if parts:
        values = parts[0]
        for more in parts[1:]:
            values = values.unionByName(more)
        plan = join_slices(plan, values, [*by, "column"], "left")
    else:
        plan = plan.withColumns({"number": number, "word": text})
    constant = ~F.col("strategy").isin("leave", "mode") & F.col("kind").isin(CATEGORICAL, UNKNOWN)
    open_ = ~F.col("protected") & (F.col("strategy") != "leave")
    plan = plan.withColumns({
        "missing": F.col("rows") - F.col("non_null"),
        "number": F.when(open_, F.col("number")), "word": F.when(open_, F.when(constant, F.lit(UNKNOWN_FILL)).otherwise(F.col("word"))),
    })
    plan = keep(plan)  # one row per slice and column, read by the fills and by the log

    used = [c for c in names if c in strategies and strategies[c][0] != "leave"]
    filled = typed
    if used:
        wide = plan.groupBy(*keys).agg(*[
            F.max(F.when(F.col("column") == c, F.col("number" if kinds[c] == NUMERIC else "word"))).alias(f"_f{i}") for i, c in enumerate(used)
        ])
        joined = join_slices(typed, wide, by, broadcast=True)
        fill = {c: F.col(f"_f{i}") for i, c in enumerate(used)}
        filled = joined.select(*[_filled(c, kinds, fill).alias(c) if c in fill else q(c) for c in typed.columns])
    rows = filled
    counts = first_rows(filled, subset, row_id, by)
    if cfg.duplicate_action == "remove":
        rows = filled.join(counts.select(row_id), row_id, "left_semi").select(*typed.columns)
    repeats = counts.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("n"))
    return SlicedCleanResult(rows, typed, _log(plan, repeats, cfg, by, names))


def _filled(c: str, kinds: dict[str, str], fill: dict[str, Column]) -> Column:
    return F.coalesce(q(c).cast("double") if kinds[c] == NUMERIC else q(c), fill[c])


def _per_column(values: dict[str, str]) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("column"))


def _log(plan: DataFrame, repeats: DataFrame, cfg: CleaningConfig, by, names: list[str]) -> DataFrame:
    """What was done per slice and column, and to how many repeated rows."""
    keys = [q(b) for b in by]
    order = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i + 1)])
    value = F.coalesce(F.col("number").cast("string"), F.col("word"))
    action = (
        F.when(F.col("protected"), "protect").when(F.col("kind") == DATE, "keep_blank").when(value.isNotNull(), "fill").otherwise("leave")
    )
    lines = plan.filter("missing > 0 OR protected").select(
        *keys, F.try_element_at(order, F.col("column")).alias("ord"), "column", action.alias("action"), F.col("missing").alias("n"),
        F.when(action == "fill", value).when(action == "protect", F.when(F.col("rule") == "is_id", "identifier").otherwise("high cardinality")).alias("value"),
    )
    kept = "remove_duplicates" if cfg.duplicate_action == "remove" else "keep_duplicates"
    last = repeats.select(
        *keys, F.lit(len(names) + 1).alias("ord"), F.lit(None).cast("string").alias("column"), F.lit(kept).alias("action"), "n",
        F.lit(None).cast("string").alias("value"),
    )
    return lines.unionByName(last)
