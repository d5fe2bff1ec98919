"""What all operators share: column classes, entry normalisation and size-checked joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..functions.text import strip, token_to_null
from ..session import keep

ROW_ID = "_row_id"
NUMERIC, DATE, CATEGORICAL, UNKNOWN = "Numeric", "Date", "Categorical", "Unknown"

# A join side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 1_000_000

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def q(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame, by: Iterable[str] = ()) -> list[str]:
    """All columns but the slicing ones and the bookkeeping ones, which start with an underscore."""
    skip = set(by)
    return [c for c in df.columns if not c.startswith("_") and c not in skip]


def native_class(dtype: T.DataType) -> str:
    if isinstance(dtype, _NUMERIC_TYPES):
        return NUMERIC
    if isinstance(dtype, _DATE_TYPES):
        return DATE
    return CATEGORICAL


def classes(df: DataFrame, by: Iterable[str] = ()) -> dict[str, str]:
    """Column class by stored type."""
    return {c: native_class(df.schema[c].dataType) for c in data_columns(df, by)}


def columns_of(df: DataFrame, kind: str, by: Iterable[str] = ()) -> list[str]:
    return [c for c, k in classes(df, by).items() if k == kind]


def normalise(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Make every kind of "missing" NULL: tokens in texts, NaN in floats; nested values become JSON text.

    Texts are trimmed in a first projection and tested in a second one, so no cell is trimmed twice.
    """
    fields = {n: df.schema[n].dataType for n in data_columns(df, by)}
    texts = [n for n, t in fields.items() if isinstance(t, T.StringType)]
    first = {n: strip(q(n)) for n in texts}
    for n, t in fields.items():
        if isinstance(t, (T.FloatType, T.DoubleType)):
            first[n] = finite(q(n))
        elif isinstance(t, NESTED_TYPES):
            first[n] = F.to_json(q(n))
        elif isinstance(t, T.BooleanType):
            first[n] = q(n).cast("string")
    out = df.select(*[first[n].alias(n) if n in first else q(n) for n in df.columns])
    return out.select(*[token_to_null(q(n)).alias(n) if n in texts else q(n) for n in df.columns])


def as_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text, one text per value."""
    return c if isinstance(dtype, T.StringType) else c.cast("string")


def long_form(df: DataFrame, columns: list[str], ids: Iterable[str] = (), value: str = "value") -> DataFrame:
    """One row per cell: ``(ids..., column, value as text)``."""
    ids = list(ids)
    cells = df.select(*[q(c) for c in ids], *[as_text(q(c), df.schema[c].dataType).alias(c) for c in columns])
    return cells.unpivot([q(c) for c in ids], [q(c) for c in columns], "column", value)


def stack(df: DataFrame, keys: Iterable[str], rows: list[dict[str, Column]]) -> DataFrame:
    """Turn aggregates side by side into rows, without a shuffle.

    The outer form keeps Spark from adding a filter that would compute all the aggregates' expressions again.
    """
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows]
    return df.select(*[q(k) for k in keys], F.inline_outer(F.array(*structs)))


def join_slices(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on equal keys where a NULL key (a slice of its own) equals NULL; the keys appear once."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_right{i}" for i, k in enumerate(keys)})
    same = reduce(and_, [q(k).eqNullSafe(F.col(f"_right{i}")) for i, k in enumerate(keys)])
    joined = left.join(checked_broadcast(other) if broadcast else other, same, how)
    return joined.drop(*[f"_right{i}" for i in range(len(keys))])


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Count a derived table and mark it for broadcast only if it is small; otherwise Spark joins by shuffle."""
    small = keep(small)
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
