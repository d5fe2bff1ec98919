"""Evidence labels: pure expressions over sample sizes, effects and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORTED, DIRECTIONAL, WEAK, INSUFFICIENT = "Supported", "Directional", "Weak", "Insufficient"


def _cascade(steps, last: str) -> Column:
    out = None
    for condition, label in steps:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(last)


def relationship_strength(r: Column) -> Column:
    a = F.abs(r)
    return _cascade(
        [(a >= 0.8, "very strong"), (a >= 0.6, "strong"), (a >= 0.4, "moderate"), (a >= 0.2, "light")], "weak"
    )


def correlation_support(n: Column, r: Column) -> Column:
    a = F.abs(r)
    return _cascade(
        [(n < 5, INSUFFICIENT), (n < 8, DIRECTIONAL), (a < 0.2, WEAK), ((n < 15) | (a < 0.35), DIRECTIONAL)],
        SUPPORTED,
    )


def trend_support(n: Column, periods: Column, coverage: Column) -> Column:
    return _cascade(
        [((n < 4) | (periods < 3), INSUFFICIENT), ((periods < 7) | (coverage < 0.65), DIRECTIONAL)], SUPPORTED
    )


def segment_support(groups: Column, smallest: Column, effect: Column) -> Column:
    return _cascade(
        [
            ((groups < 2) | (smallest < 2), INSUFFICIENT),
            ((smallest < 5) | (F.abs(effect) < 0.6), DIRECTIONAL),
        ],
        SUPPORTED,
    )


def readiness_label(score: Column) -> Column:
    return _cascade([(score >= 90, "Excellent"), (score >= 75, "Good"), (score >= 60, "Fair")], "Needs attention")


def confidence_label(score: Column) -> Column:
    return _cascade([(score >= 80, "High"), (score >= 55, "Medium")], "Low")


def correlation_reason(n: Column, r: Column, label: Column) -> Column:
    """What the label of a correlation rests on, in figures."""
    figures = F.format_string("r = %.2f over %d complete rows", r, n)
    return (
        F.when(label == INSUFFICIENT, F.format_string("%d complete rows; 5 are needed.", n))
        .when(label == WEAK, F.concat(figures, F.lit("; below 0.20 in size.")))
        .when((label == DIRECTIONAL) & (n < 15), F.concat(figures, F.lit("; 15 rows are needed for more.")))
        .when(label == DIRECTIONAL, F.concat(figures, F.lit("; 0.35 in size is needed for more.")))
        .when(label == SUPPORTED, F.concat(figures, F.lit(".")))
    )


def trend_reason(n: Column, periods: Column, coverage: Column, label: Column) -> Column:
    """What the label of a trend rests on: too few periods and too little coverage are told apart."""
    seen = F.format_string("%d rows in %d periods", n, periods)
    filled = F.format_string("%.0f%% of rows usable", coverage * 100)
    return (
        F.when(label == INSUFFICIENT, F.concat(seen, F.lit("; 4 rows in 3 periods are needed.")))
        .when((label == DIRECTIONAL) & (periods < 7), F.concat(seen, F.lit("; 7 periods are needed for more.")))
        .when(label == DIRECTIONAL, F.concat(seen, F.lit(", but only "), filled, F.lit("; 65% are needed for more.")))
        .when(label == SUPPORTED, F.concat(seen, F.lit(", "), filled, F.lit(".")))
    )


def segment_reason(groups: Column, smallest: Column, effect: Column, label: Column) -> Column:
    """What the label of a gap between segments rests on, in figures."""
    seen = F.format_string("%d groups, the smaller of the two compared with %d rows", groups, smallest)
    return (
        F.when(label == INSUFFICIENT, F.concat(seen, F.lit("; 2 groups of 2 rows are needed.")))
        .when((label == DIRECTIONAL) & (smallest < 5), F.concat(seen, F.lit("; 5 rows are needed for more.")))
        .when(label == DIRECTIONAL, F.concat(seen, F.format_string("; the effect size %.2f is below 0.60.", effect)))
        .when(label == SUPPORTED, F.concat(seen, F.format_string("; effect size %.2f.", effect)))
    )
