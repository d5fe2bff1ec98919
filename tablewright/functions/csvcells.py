"""Comma-separated text as expressions: split a record, test for open quotes, write a record back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A field is quoted (doubled quotes inside, loose text after the closing quote) or plain.
# Every repetition is possessive, so long fields neither backtrack nor use stack.
_QUOTED_BODY = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf',({_QUOTED_BODY}(?:"[^,]*+|\z)|[^,]*+)'
_ENDS_OPEN = rf'^(?:,(?:{_QUOTED_BODY}"[^,]*+|[^,"][^,]*+|(?=,|\z)))*+,{_QUOTED_BODY}\z'
_CELL = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'


def _cell_value(raw: Column) -> Column:
    body = F.replace(F.regexp_extract(raw, _CELL, 1), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"'), F.concat(body, F.regexp_extract(raw, _CELL, 2))).otherwise(raw)


def split_record(record: Column) -> Column:
    """The cells of one record; an empty record has no cells."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), 1)
    return (
        F.when(record == "", F.array().cast("array<string>"))
        .when(~record.contains('"'), F.split(record, ",", -1))
        .otherwise(F.transform(quoted, _cell_value))
    )


def ends_open(line: Column, starts_open: bool = False) -> Column:
    """Whether a quoted field is still open at the end of the line, given whether one is open at its start."""
    # The leading "x" keeps a quote at the start of the line from pairing with the opening one.
    test = F.concat(F.lit(',"x' if starts_open else ","), line).rlike(_ENDS_OPEN)
    return F.when(line.contains('"'), test).otherwise(starts_open)


def write_record(cells: Column) -> Column:
    """Cells to one line, quoting only where a cell needs it."""
    def put(cell: Column) -> Column:
        escaped = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(cell.rlike('[,"\r\n]'), escaped).otherwise(cell)

    return F.array_join(F.transform(cells, put), ",")
