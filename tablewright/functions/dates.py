"""Date expressions: one cell may use any of the accepted spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The accepted shapes of a date text.
ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ].*)?)?)?$"
COMPACT_SHAPE = r"^\d{8}$"
NUMBER_SHAPE = r"^\d{1,4}([-/.])\d{1,2}\1\d{2,4}([ T]\d.*)?$"
DAY_NAME_SHAPE = r"^\d{1,2} \p{L}{3,9} \d{4}$"
NAME_SHAPE = r"^\p{L}{3,9} (\d{1,2}, )?\d{4}$"
# Fixed value: ISO dates that are in any calendar.
PLAIN_DATE = r"^(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8])\z"
# The patterns tried for each; month comes before day when both fit.
NUMBER_PATTERNS = ("M-d-yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]")
DAY_NAME_PATTERNS = ("d MMM yyyy", "d MMMM yyyy")
NAME_PATTERNS = ("MMM d, yyyy", "MMMM d, yyyy", "MMMM yyyy", "MMM yyyy")

_ANY_SHAPE = "|".join(
    s.replace(r"\1", "[-/.]") for s in (ISO_SHAPE, COMPACT_SHAPE, NUMBER_SHAPE, DAY_NAME_SHAPE, NAME_SHAPE)
)


def plain_date(trimmed: Column) -> Column:
    """Whether a trimmed text is surely a date, by a cheap test; any other text is left to ``to_date_time``.

    Days up to the 28th are in every month.
    """
    return trimmed.rlike(PLAIN_DATE)


def _attempt(text: Column, patterns) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])


def to_date_time(c: Column, trimmed: bool = False) -> Column:
    """Parse a text in any accepted spelling to a wall-clock timestamp; anything else is NULL.

    ``trimmed`` says that the column holds trimmed texts already, which keeps the expression small.
    """
    t = c if trimmed else strip(c)
    dashes = F.regexp_replace(t, r"^(\d{1,4})([-/.])(\d{1,2})\2(\d)", "$1-$3-$4")
    # Two-digit years: 69-99 mean 1969-1999, the others 2000-2068.
    late = F.regexp_replace(dashes, r"^(?<md>\d{1,2}-\d{1,2}-)(?<y>69|[7-9]\d)$", "${md}19${y}")
    full_year = F.regexp_replace(late, r"^(?<md>\d{1,2}-\d{1,2}-)(?<y>\d\d)$", "${md}20${y}")
    # The first test settles all texts that are no date; a try that fails costs an exception, so few are made.
    return (
        F.when(~t.rlike(_ANY_SHAPE), F.lit(None).cast("timestamp"))
        .when(t.rlike(ISO_SHAPE), F.try_to_timestamp(t))
        .when(t.rlike(r"^\d{4}[/.]"), F.try_to_timestamp(dashes))
        .when(t.rlike(COMPACT_SHAPE), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        .when(t.rlike(r"^\d{1,2} "), _attempt(t, DAY_NAME_PATTERNS))
        .when(t.rlike(r"^\d"), _attempt(full_year, NUMBER_PATTERNS))
        .otherwise(_attempt(t, NAME_PATTERNS))
        .cast("timestamp_ntz")
    )
