"""Typed standardisation, filling of missing cells under explicit strategies, and the log of what was done."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleaningConfig
from ..functions.dates import to_date_time
from ..functions.numbers import to_number
from ..functions.text import text_mode
from ..session import keep
from .base import CATEGORICAL, DATE, NUMERIC, ROW_ID, UNKNOWN, classes, normalise, q
from .cardinality import ColumnRules, column_rules
from .duplicates import duplicate_count, first_rows
from .quantiles import quantiles
from .statistics import top_values

# Fixed value: the fill text for categorical cells.
UNKNOWN_FILL = "Unknown"

LOG_SCHEMA = "ord int, column string, action string, n bigint, value string, text string"


def standardize(df: DataFrame, types: dict[str, str], config=None) -> DataFrame:
    """Cast every column to its detected type; all rows stay, cells that do not parse become NULL."""
    mode = CleaningConfig.of(config).categorical_text_strategy
    base = normalise(df)
    kinds = classes(base)

    def cell(name: str) -> Column:
        kind, stored = types.get(name), kinds.get(name)
        if stored != CATEGORICAL:
            return q(name)
        if kind == NUMERIC:
            return to_number(q(name), trimmed=True).alias(name)
        if kind == DATE:
            return to_date_time(q(name), trimmed=True).alias(name)
        return text_mode(q(name), mode).alias(name) if kind and mode != "strip" else q(name)

    return base.select(*[cell(c) for c in df.columns])


@dataclass
class FillPlan:
    """The strategy and the fill value chosen for each column, decided from the rules' facts of the typed table."""

    strategies: dict[str, str] = field(default_factory=dict)
    protected: dict[str, str] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)


def plan_fills(typed: DataFrame, profile: dict[str, ColumnRules], config=None) -> FillPlan:
    """Choose strategies, then compute all fill values in one aggregation per kind.

    A column's own strategy wins; otherwise identifiers and high-cardinality texts are left as they are. Dates
    are never filled.
    """
    cfg = CleaningConfig.of(config)
    plan = FillPlan()
    for name, facts in profile.items():
        plan.missing[name] = facts.rows - facts.non_null
        if facts.detected_type == NUMERIC:
            own = cfg.numeric_column_strategies.get(name)
            plan.strategies[name] = own or cfg.numeric_missing_strategy
            if own is None and facts.is_id:
                plan.strategies[name], plan.protected[name] = "leave", "identifier"
        elif facts.detected_type in (CATEGORICAL, UNKNOWN):
            own = cfg.categorical_column_strategies.get(name)
            plan.strategies[name] = own or cfg.categorical_missing_strategy
            if own is None and facts.high_cardinality:
                plan.strategies[name], plan.protected[name] = "leave", "high cardinality"
            if plan.strategies[name] not in ("leave", "mode") and plan.missing[name]:
                plan.values[name] = UNKNOWN_FILL
    gaps = {n: s for n, s in plan.strategies.items() if plan.missing[n] and profile[n].non_null}
    means = [n for n, s in gaps.items() if s == "mean" and profile[n].detected_type == NUMERIC]
    medians = [
        n for n, s in gaps.items() if s not in ("mean", "leave") and profile[n].detected_type == NUMERIC
    ]
    modes = [n for n, s in gaps.items() if s == "mode" and profile[n].detected_type in (CATEGORICAL, UNKNOWN)]
    if means:
        row = typed.agg(*[F.avg(q(n)).alias(f"m{i}") for i, n in enumerate(means)]).first()
        plan.values |= dict(zip(means, row))
    if medians:
        plan.values |= {r["column"]: r["q"][0] for r in quantiles(typed, medians, (0.5,)).collect()}
    if modes:
        best = top_values(typed, modes, 1, include_null=False)
        plan.values |= {r["column"]: r["value"] for r in best.collect()}
    return plan


def apply_fills(typed: DataFrame, plan: FillPlan) -> DataFrame:
    """Fill from the plan: the values are literals, so this is a projection that fuses with what follows."""
    kinds = classes(typed)

    def cell(name: str) -> Column:
        value = plan.values.get(name)
        if value is None:
            return q(name)
        filled = q(name).cast("double") if kinds[name] == NUMERIC else q(name)
        return F.coalesce(filled, F.lit(value)).alias(name)

    return typed.select(*[cell(c) for c in typed.columns])


@dataclass
class CleanResult:
    """The cleaned table, the typed one before filling, and the ordered log."""

    rows: DataFrame
    standardized: DataFrame
    filled: DataFrame
    log: list[tuple]
    plan: FillPlan
    duplicates_found: int

    def log_table(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(self.log, LOG_SCHEMA)

    def log_texts(self) -> list[str]:
        return [entry[5] for entry in self.log]


def clean(df: DataFrame, types: dict[str, str], subset=None, config=None, row_id: str = ROW_ID) -> CleanResult:
    """Standardise, fill, then handle rows that repeat after filling.

    Only counts and fill values, one per column, come to the driver; the tables stay lazy.
    """
    cfg = CleaningConfig.of(config)
    subset = list(subset) if subset else None
    typed = keep(standardize(df, types, cfg))  # parsed once, read by the profile, the fills and the result
    profile = column_rules(typed, types, row_id)
    plan = plan_fills(typed, profile, cfg)
    filled = apply_fills(typed, plan)
    if cfg.duplicate_action == "remove":
        first = keep(first_rows(filled, subset, row_id))  # keys are made once, for the count and for the result
        found = first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()["n"]
        rows = filled.join(first.select(row_id), row_id, "left_semi") if found else filled
    else:
        found, rows = duplicate_count(filled, subset).first()["duplicate_count"], filled
    log = _log(cfg, plan, profile, types, subset, found)
    return CleanResult(rows, typed, filled, log, plan, found)


def _log(cfg: CleaningConfig, plan: FillPlan, profile, types, subset, found: int) -> list[tuple]:
    out: list[tuple] = []

    def add(column, action, n, value, text):
        out.append((len(out) + 1, column, action, n, value, text))

    for action, value, label in (
        ("numeric_strategy", cfg.numeric_missing_strategy, "Numeric missing strategy"),
        ("categorical_strategy", cfg.categorical_missing_strategy, "Categorical missing strategy"),
        ("duplicate_action", cfg.duplicate_action, "Duplicate handling"),
        ("text_strategy", cfg.categorical_text_strategy, "Categorical text normalization"),
    ):
        add(None, action, None, value, f"{label}: {value}.")
    for name in types:
        if name not in profile:
            continue
        missing, kind = plan.missing[name], profile[name].detected_type
        if plan.protected.get(name) == "identifier":
            add(name, "protect", missing, "identifier", f"'{name}': left as it is, a probable identifier.")
        elif name in plan.protected:
            add(name, "protect", missing, "high cardinality",
                f"'{name}': left as it is, a high-cardinality categorical field.")
        if not missing:
            continue
        if kind == DATE:
            add(name, "keep_blank", missing, None, f"'{name}': {missing} missing or invalid date(s) stay blank.")
        elif name in plan.values:
            value = plan.values[name]
            add(name, "fill", missing, str(value),
                f"'{name}': filled {missing} missing value(s) with {plan.strategies[name]} ({value}).")
        else:
            add(name, "leave", missing, None, f"'{name}': left {missing} missing value(s) unchanged.")
    keyed = f"the key {', '.join(subset)}" if subset else "whole rows"
    add(None, "compare", None, ", ".join(subset) if subset else None, f"Compared {keyed} for duplicates.")
    if cfg.duplicate_action != "remove":
        add(None, "keep_duplicates", found, None, f"Kept {found} detected duplicate row(s).")
    elif found:
        add(None, "remove_duplicates", found, None, f"Removed {found} duplicate row(s).")
    else:
        add(None, "remove_duplicates", 0, None, "No duplicate rows were removed.")
    return out
