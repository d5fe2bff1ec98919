"""Rules about the number of distinct values, decided from sketches and counted only where a sketch cannot tell.

Most rules ask whether a column has few values, or nearly as many as cells. One scan sketches all columns. A column far
from every threshold is decided by its sketch's bounds; one with few values is counted exactly, as its values fit into
every task; numbers that may be row numbers are counted by the changes along the rows; only what is left, columns whose
bounds straddle a threshold, is grouped by value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import CATEGORICAL, DATE, NUMERIC, ROW_ID, UNKNOWN, classes, normalise, q
from .profile import (
    HIGH_CARDINALITY_MIN, HIGH_CARDINALITY_RATIO, ID_NAME_RATIO, ID_SEQUENCE_MIN, ID_SEQUENCE_RATIO, TYPE_RATE, _by_column,
    _key_counts, _parsed, _stored, sequence_values, type_evidence, value_frequencies,
)

#: Sketched distinct values up to which a column is counted exactly in every task.
FEW = 200
#: log2 of a sketch's buckets, and five times its standard error: the bounds of a sketched count.
SKETCH_SIZE = 14
SKETCH_ERROR = 0.042


@dataclass(frozen=True)
class ColumnRules:
    """What the choosing rules need of a column. ``distinct`` is exact, or None where no rule needed it."""

    name: str
    detected_type: str
    stored: str
    rows: int
    non_null: int
    distinct: int | None
    high_cardinality: bool
    id_by_name: bool
    id_by_sequence: bool

    @property
    def is_id(self) -> bool:
        return self.id_by_name or self.id_by_sequence

    def filterable(self, max_unique: int = 25) -> bool:
        return self.detected_type in (CATEGORICAL, UNKNOWN) and self.distinct is not None and 2 <= self.distinct <= min(max_unique, FEW // 2)

    def groupable(self, max_unique: int = 30) -> bool:
        limit = min(max_unique, FEW // 2, max(8, int(max(self.rows, 1) * 0.6)))
        few = self.distinct is not None and 2 <= self.distinct <= limit
        return self.non_null > 0 and (few or self.detected_type in (CATEGORICAL, UNKNOWN))


def has_id_name(name: str) -> bool:
    name = name.lower()
    return name in ("id", "index") or name.endswith(("_id", " id", "_index"))


def column_rules(df: DataFrame, types: dict[str, str] | None = None, row_id: str = ROW_ID) -> dict[str, ColumnRules]:
    """The rules' facts on the driver, one entry per column; equal to those of ``profile_table`` wherever both have them."""
    base = normalise(df)
    kinds = classes(base)
    names = list(kinds)
    if not names:
        return {}
    seen = base.agg(F.count(F.lit(1)).alias("rows"), *[a for i, c in enumerate(names) for a in _sketched(q(c), i)]).first()
    rows = seen["rows"]
    filled = {c: seen[f"n{i}"] for i, c in enumerate(names)}
    estimate = {c: seen[f"d{i}"] or 0 for i, c in enumerate(names)}
    bounds = {c: (estimate[c] * (1 - SKETCH_ERROR), estimate[c] * (1 + SKETCH_ERROR)) for c in names}

    few = [c for c in names if estimate[c] <= FEW]
    distinct, types = _few_values(base, few, kinds, types or {}) if few else ({}, dict(types or {}))
    types = _types_of_many(base, [c for c in names if c not in types], kinds, types)

    def at_least(c: str, ratio: float, least: int) -> bool | None:
        """Whether a column has that many distinct values per cell; None if it must be counted."""
        n = filled[c]
        if n < max(least, 1):
            return False
        if c in distinct:
            return distinct[c] / n >= ratio
        low, high = bounds[c]
        return True if low >= ratio * n else False if high < ratio * n else None

    wanted = {}
    for c in names:
        if types[c] in (CATEGORICAL, UNKNOWN):
            wanted[c, "high"] = (HIGH_CARDINALITY_RATIO, HIGH_CARDINALITY_MIN)
        if has_id_name(c):
            wanted[c, "name"] = (ID_NAME_RATIO, 1)
    sequences = {}
    if row_id in df.columns:
        near = [c for c in names if types[c] == NUMERIC and at_least(c, ID_SEQUENCE_RATIO, ID_SEQUENCE_MIN) is not False]
        found = sequence_values(base, near, row_id)
        for c, values in found.items():
            if kinds[c] == NUMERIC:
                distinct.setdefault(c, values)
            else:  # every number has one spelling at least
                bounds[c] = (max(bounds[c][0], values), max(bounds[c][1], values))
            sequences[c] = True
            wanted[c, "sequence"] = (ID_SEQUENCE_RATIO, ID_SEQUENCE_MIN)
    unsure = sorted({c for (c, _), rule in wanted.items() if at_least(c, *rule) is None}, key=names.index)
    if unsure:
        part = base.select(*[q(c) for c in unsure])
        counted = _key_counts(part, {c: kinds[c] for c in unsure}, parse=False).groupBy("column").agg(F.sum("variants").alias("n")).collect()
        distinct |= {r["column"]: r["n"] for r in counted}
    decided = {key: at_least(key[0], *rule) for key, rule in wanted.items()}
    return {
        c: ColumnRules(
            c, types[c], _stored(kinds)[c], rows, filled[c], distinct.get(c), bool(decided.get((c, "high"))),
            bool(decided.get((c, "name"))), bool(sequences.get(c) and decided.get((c, "sequence"))),
        )
        for c in names
    }


def _sketched(c: Column, i: int) -> list[Column]:
    hashed = F.when(c.isNotNull(), F.xxhash64(c))
    return [F.count(c).alias(f"n{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(SKETCH_SIZE))).alias(f"d{i}")]


def _few_values(base: DataFrame, few: list[str], kinds: dict[str, str], types: dict[str, str]) -> tuple[dict[str, int], dict[str, str]]:
    """Exact distinct counts of columns with few values, and the types of those that have none given."""
    values = value_frequencies(base, few).withColumn("stored", _by_column(_stored({c: kinds[c] for c in few})))
    parsed = _parsed(values) if any(c not in types for c in few) else values.withColumns({"_x": F.lit(False), "_d": F.lit(False)})
    n = F.col("n")
    counted = parsed.groupBy("column").agg(
        F.count("value").alias("distinct"), F.sum(F.when(F.col("value").isNotNull(), n)).alias("non_null"),
        F.sum(F.when(F.col("_x"), n)).alias("numeric_ok"), F.sum(F.when(F.col("_d"), n)).alias("date_ok"),
    ).collect()
    types = dict(types)
    for r in counted:
        types.setdefault(r["column"], _type(_stored(kinds)[r["column"]], r["non_null"] or 0, r["numeric_ok"] or 0, r["date_ok"] or 0))
    for c in few:
        types.setdefault(c, UNKNOWN)  # an empty table has no cells
    return {c: 0 for c in few} | {r["column"]: r["distinct"] for r in counted}, types


def _types_of_many(base: DataFrame, names: list[str], kinds: dict[str, str], types: dict[str, str]) -> dict[str, str]:
    """The types of columns with many values: by what is stored, for texts by reading their cells, which are not shuffled."""
    types = types | {c: kinds[c] for c in names if kinds[c] in (NUMERIC, DATE)}
    texts = [c for c in names if c not in types]
    if texts:
        for r in type_evidence(base.select(*[q(c) for c in texts])).collect():
            types[r["column"]] = _type(r["stored"], r["non_null"], r["numeric_ok"], r["date_ok"])
    return types


def _type(stored: str, non_null: int, numeric_ok: int, date_ok: int) -> str:
    if not non_null:
        return UNKNOWN
    if stored != "Text":
        return stored
    return NUMERIC if numeric_ok / non_null >= TYPE_RATE else DATE if date_ok / non_null >= TYPE_RATE else CATEGORICAL


def rules_table(spark, rules: dict[str, ColumnRules]) -> DataFrame:
    """The decisions as a table, one row per column."""
    rows = [
        (i, r.name, r.detected_type, r.rows, r.non_null, r.distinct, r.filterable(), r.groupable(), r.high_cardinality, r.id_by_name,
         r.id_by_sequence, r.is_id)
        for i, r in enumerate(rules.values())
    ]
    return spark.createDataFrame(
        rows, "ord int, column string, detected_type string, rows long, non_null long, distinct long, filterable boolean, "
        "groupable boolean, high_cardinality boolean, id_by_name boolean, id_by_sequence boolean, is_id boolean",
    )
