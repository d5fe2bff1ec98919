"""Content keys: a fixed-width digest of one or more values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _canonical(columns: dict[str, Column]) -> Column:
    # Values go in as text: JSON would cut timestamps to milliseconds.
    cells = [columns[n].cast("string").alias(n) for n in sorted(columns)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def content_key(columns: dict[str, Column]) -> Column:
    """SHA-256 (hex) over the named values in name order, so the order of arguments does not matter."""
    return F.sha2(_canonical(columns), 256)


def row_key(columns: dict[str, Column]) -> Column:
    """The digest as 32 bytes: never NULL, NULL cells equal each other, and its width does not grow with the text."""
    return F.unhex(content_key(columns))
