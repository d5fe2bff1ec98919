"""Number expressions: parsing, rounding and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed value: the accepted spelling of a number (no suffixes, no hexadecimal, no underscores).
NUMBER_PATTERN = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
# Fixed value: whole numbers and decimals that no parser refuses.
PLAIN_NUMBER = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?\z"
# Fixed value: a number in brackets is negative.
BRACKETS = r"^\s*\((.*)\)\s*$"


def finite(c: Column) -> Column:
    """NaN and the infinities carry no value here: make them NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def _number_text(c: Column, trimmed: bool) -> Column:
    """The text to be cast, NULL if it is no number: a failing cast would cost an exception per cell.

    No step computes another one twice, and the bracket rule runs only on cells that hold a bracket.
    """
    cell = c if trimmed else strip(c)
    bare = F.translate(cell, ",$", "")
    signed = F.when(cell.contains("("), F.regexp_replace(bare, BRACKETS, "-$1")).otherwise(bare)
    return F.nullif(F.regexp_extract(signed, NUMBER_PATTERN, 1), F.lit(""))


def plain_number(trimmed: Column) -> Column:
    """Whether a trimmed text is surely a number, by a cheap test; any other text is left to ``to_number``."""
    return trimmed.rlike(PLAIN_NUMBER)


def to_number(c: Column, trimmed: bool = False) -> Column:
    """Parse ``1,200``, ``$5``, ``(3.5)`` and plain or scientific numbers; anything else is NULL.

    ``trimmed`` says that the column holds trimmed texts already.
    """
    # A number too large for a double comes out infinite.
    value = _number_text(c, trimmed).try_cast("double")
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


def display_number(c: Column, digits: int = 3) -> Column:
    """Round half to even for display (3 digits) or for context documents (4 digits)."""
    return F.bround(c.cast("double"), digits)


def metric_text(c: Column) -> Column:
    """Thousands without decimals, whole numbers as such, all else with one decimal."""
    v = c.cast("double")
    return (
        F.when(F.abs(v) >= 1000, F.format_number(F.bround(v, 0), 0))
        .when(v == F.floor(v), F.format_string("%.0f", v))
        # Rounding to zero would lose the sign.
        .when(v.isNotNull(), F.concat(F.when(v < 0, "-").otherwise(""), F.format_string("%.1f", F.abs(F.bround(v, 1)))))
    )


def percent_text(c: Column) -> Column:
    """A share as a whole per cent."""
    return F.concat(F.format_string("%.0f", F.bround(c * 100, 0)), F.lit("%"))
