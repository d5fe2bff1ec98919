"""What the columns hold: types, missing and invalid values, distinct counts, identifiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import plain_date, to_date_time
from ..functions.numbers import plain_number, to_number
from ..session import keep
from .base import (
    CATEGORICAL,
    DATE,
    NUMERIC,
    ROW_ID,
    UNKNOWN,
    classes,
    data_columns,
    long_form,
    normalise,
    q,
    stack,
)

# Thresholds of the profile rules.
TYPE_RATE = 0.8
ID_NAME_RATIO = 0.8
ID_SEQUENCE_RATIO = 0.98
ID_SEQUENCE_MIN = 5
HIGH_CARDINALITY_RATIO = 0.8
HIGH_CARDINALITY_MIN = 4

_SEQUENCE_BLOCK = 1_000_000
# Texts beyond this size are grouped by a digest.
_DIGEST_BYTES = 64
# How a text of that size begins if it is a number or a date: dates with month names are shorter.
_LONG_START = r"[0-9+\-.,$(]"


# --- types ------------------------------------------------------------------------------------------------


def _by_column(columns: dict[str, object]) -> Column:
    """A value per column name, for tables in long form."""
    table = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    return F.try_element_at(table, F.col("column"))


def _stored(kinds: dict[str, str]) -> dict[str, str]:
    return {c: "Text" if k == CATEGORICAL else k for c, k in kinds.items()}


def _parsed(cells: DataFrame) -> DataFrame:
    """Add, to cells in long form, whether they count as number and as date: by stored type, else by their text."""
    text, there = F.col("stored") == "Text", F.col("value").isNotNull()
    cells = cells.withColumn("_t", F.when(text, F.col("value")))  # stored numbers and dates need no parsing
    parsed = cells.withColumns({"_x": to_number(F.col("_t"), trimmed=True), "_d": to_date_time(F.col("_t"), trimmed=True)})
    return parsed.withColumns(
        {
            "_x": F.when(text, F.col("_x").isNotNull()).otherwise(there & (F.col("stored") == NUMERIC)),
            "_d": F.when(text, F.col("_d").isNotNull()).otherwise(there & (F.col("stored") == DATE)),
        }
    )


def type_evidence(df: DataFrame, by=()) -> DataFrame:
    """Rows, non-null cells and cells that parse as number or date, per column: one pass, no shuffle of cells.

    Cells go through one expression in long form, so the plan does not grow with the number of columns.
    """
    base = normalise(df, by)
    kinds = classes(base, by)
    cells = _parsed(long_form(base, list(kinds), by).withColumn("stored", _by_column(_stored(kinds))))
    return (
        cells.groupBy(*[q(b) for b in by], "column", "stored")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("value").alias("non_null"),
            F.count(F.when(F.col("_x"), 1)).alias("numeric_ok"),
            F.count(F.when(F.col("_d"), 1)).alias("date_ok"),
        )
        .withColumn("ord", _by_column({c: i for i, c in enumerate(kinds)}))
    )


def detected_type() -> Column:
    """Numeric is tested before Date, so a column of years or of ``20240105`` is Numeric."""
    n = F.col("non_null")
    return (
        F.when(n == 0, UNKNOWN)
        .when(F.col("stored") != "Text", F.col("stored"))
        .when(F.col("numeric_ok") / n >= TYPE_RATE, NUMERIC)
        .when(F.col("date_ok") / n >= TYPE_RATE, DATE)
        .otherwise(CATEGORICAL)
    )


def column_types(df: DataFrame, by=()) -> DataFrame:
    return type_evidence(df, by).withColumn("detected_type", detected_type())


def type_map(df: DataFrame) -> dict[str, str]:
    """The detected types on the driver: one row per column."""
    return {r["column"]: r["detected_type"] for r in column_types(df).orderBy("ord").collect()}


# --- missing and invalid ------------------------------------------------------------------------------------


def missing_counts(df: DataFrame, by=()) -> DataFrame:
    """Columns with missing cells, most affected first."""
    base = normalise(df, by)
    names = data_columns(base, by)
    wide = base.groupBy(*[q(b) for b in by]).agg(
        *[F.count_if(q(c).isNull()).alias(f"_m{i}") for i, c in enumerate(names)]
    )
    rows = [{"column": F.lit(c), "missing": F.col(f"_m{i}")} for i, c in enumerate(names)]
    return stack(wide, by, rows).filter("missing > 0").orderBy(F.desc("missing"), "column")


def value_frequencies(df: DataFrame, columns=None, by=(), row_id: str | None = None) -> DataFrame:
    """Every distinct value of every column with its count (NULL included) and, if asked, its first row.

    Cells are counted before they are shuffled, so a value that fills a third of a column costs no more than
    any other, and each distinct value lands in exactly one task.
    """
    columns = columns or data_columns(df, by)
    ids = list(by) + ([row_id] if row_id else [])
    cells = long_form(df, columns, ids)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(q(row_id)).alias("first_row")] if row_id else [])
    return cells.groupBy(*[q(b) for b in by], "column", "value").agg(*aggs)


def distinct_values(df: DataFrame, columns, by=()) -> DataFrame:
    """``(by..., column, distinct)``: exact counts; numbers are compared as stored, as their texts cost more than the rest."""
    keys = [q(b) for b in by]
    groups: dict[str, list[str]] = {}
    for c in columns:
        dtype = df.schema[c].dataType
        whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        name = "bigint" if whole else "double" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "string"
        groups.setdefault(name, []).append(c)
    parts = []
    for name, names in groups.items():
        cells = df.select(*keys, *[q(c).cast(name).alias(c) for c in names]).unpivot(keys, [q(c) for c in names], "column", "value")
        parts.append(cells.filter(F.col("value").isNotNull()).select(*keys, "column", "value").distinct().groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("distinct")))
    # A column is in one group, so the groups' rows need not be summed.
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0).select(*keys, F.lit("").alias("column"), F.lit(0).cast("long").alias("distinct"))


def invalid_values(df: DataFrame, types: dict[str, str], kind: str, by=(), row_id: str | None = None) -> DataFrame:
    """Distinct non-null texts of Numeric (or Date) columns that do not parse, each tested once."""
    base = normalise(df, by)
    names = [c for c, t in types.items() if t == kind and classes(base, by)[c] == CATEGORICAL]
    if not names:
        names = data_columns(base, by)[:1]
        base = base.limit(0)
    value = F.col("value")
    parse, plain = (to_number, plain_number) if kind == NUMERIC else (to_date_time, plain_date)
    parse = parse(value, trimmed=True)
    # Plain cells are left out before they are counted, so that only few are parsed and shuffled.
    values = value_frequencies(base, names, by, row_id).filter(value.isNotNull() & ~plain(value))
    return values.withColumn("_p", parse).filter(F.col("_p").isNull()).drop("_p")


def invalid_counts(df: DataFrame, types: dict[str, str], by=()) -> DataFrame:
    """Number of distinct invalid values over all columns (values, not cells)."""
    parts = []
    for kind, name in ((NUMERIC, "invalid_numeric_count"), (DATE, "invalid_date_count")):
        per_kind = invalid_values(df, types, kind, by).groupBy(*[q(b) for b in by]).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_kind.select(*[q(b) for b in by], F.lit(name).alias("metric"), "n"))
    both = parts[0].unionByName(parts[1])
    return both.groupBy(*[q(b) for b in by]).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m)
            for m in ("invalid_numeric_count", "invalid_date_count")
        ]
    )


def issue_table(invalid: DataFrame, preview: int = 5) -> DataFrame:
    """Per column: how many distinct bad values there are and the first few of them by row, as one text."""
    totals = invalid.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    first = W.partitionBy("column").orderBy("first_row", "value")
    # The rank filter is applied before the shuffle as well, so no task sees a column's full list.
    shown = (
        invalid.withColumn("_k", F.row_number().over(first))
        .filter(F.col("_k") <= preview)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "value"))).alias("_shown"))
    )
    text = F.array_join(F.transform("_shown", lambda s: s["value"]), ", ")
    return totals.join(shown, "column").select(
        "column",
        F.when(F.col("n") > preview, F.concat(text, F.lit(", ..."))).otherwise(text).alias("preview"),
        "n",
    )


# --- distinct values and identifiers ----------------------------------------------------------------------------


def has_id_name(column: Column) -> Column:
    name = F.lower(column)
    return (
        name.isin("id", "index") | name.endswith("_id") | name.endswith(" id") | name.endswith("_index")
    )


def sequence_columns(df: DataFrame, columns: list[str], row_id: str = ROW_ID) -> list[str]:
    """Of these numeric columns, the ones whose values are whole numbers and never rise (or never fall) by row."""
    return list(sequence_values(df, columns, row_id))


def sequence_values(df: DataFrame, columns: list[str], row_id: str = ROW_ID) -> dict[str, int]:
    """The columns that are such sequences, with the exact number of their distinct values."""
    if not columns:
        return {}
    found = sequences(df, columns, row_id).first()
    return {c: found[f"v{i}"] for i, c in enumerate(columns) if found[f"v{i}"] is not None}


def sequences(df: DataFrame, columns: list[str], row_id: str = ROW_ID, by=()) -> DataFrame:
    """``(by..., v0, v1, ...)``: per slice and column the number of distinct values, NULL where it is no sequence.

    Rows are compared inside blocks of one million row numbers; the blocks' ends are compared afterwards, so
    neither step gathers the table.
    """
    by = list(by)
    slices = [F.col(f"_s{i}") for i in range(len(by))]
    kinds = classes(df)
    number = {c: q(c).cast("double") if kinds[c] == NUMERIC else to_number(q(c)) for c in columns}
    rows = df.select(
        *[q(b).alias(f"_s{i}") for i, b in enumerate(by)],
        q(row_id).alias("_r"),
        F.floor(q(row_id) / _SEQUENCE_BLOCK).alias("_b"),
        *[number[c].alias(f"v{i}") for i, c in enumerate(columns)],
        *[q(c).isNotNull().alias(f"p{i}") for i, c in enumerate(columns)],
    )
    earlier = W.partitionBy(*slices, "_b").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns(
        {f"u{i}": F.last(f"v{i}", ignorenulls=True).over(earlier) for i in range(len(columns))}
    )
    aggs = []
    for i in range(len(columns)):
        v, u = F.col(f"v{i}"), F.col(f"u{i}")
        aggs += [
            F.count_if(F.col(f"p{i}") & v.isNull()).alias(f"bad{i}"),
            F.count_if(v % 1 != 0).alias(f"frac{i}"),
            F.count_if(v < u).alias(f"down{i}"),
            F.count_if(v > u).alias(f"up{i}"),
            F.min_by(v, F.when(v.isNotNull(), F.col("_r"))).alias(f"first{i}"),
            F.max_by(v, F.when(v.isNotNull(), F.col("_r"))).alias(f"last{i}"),
        ]
    blocks = rows.groupBy(*slices, "_b").agg(*aggs)
    # One row per slice and million rows remains, so ordering all blocks together is cheap.
    before = W.partitionBy(*slices, F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {f"prev{i}": F.last(f"last{i}", ignorenulls=True).over(before) for i in range(len(columns))}
    )
    checks = []
    for i in range(len(columns)):
        first, prev = F.col(f"first{i}"), F.col(f"prev{i}")
        up = F.sum(f"up{i}") + F.count_if(first > prev)
        down = F.sum(f"down{i}") + F.count_if(first < prev)
        clean = (F.sum(f"bad{i}") == 0) & (F.sum(f"frac{i}") == 0)
        # A sequence takes a new value wherever it changes.
        values = F.when(F.max(f"last{i}").isNull(), 0).otherwise(up + down + 1)
        checks.append(F.when(clean & ((up == 0) | (down == 0)), values).alias(f"v{i}"))
    return blocks.groupBy(*slices).agg(*checks).select(
        *[c.alias(b) for c, b in zip(slices, by)], *[f"v{i}" for i in range(len(columns))],
    )


def _key_counts(base: DataFrame, kinds: dict[str, str], parse: bool) -> DataFrame:
    """``(column, stored, _key, n, _x, _d, variants)``: cells, cells read as number and as date, and spellings per
    comparison key (trimmed, lower case) of every column.

    Numbers are grouped as they are stored. Texts longer than a digest are grouped by one, so that no long text is
    shuffled. Distinct values are parsed, each once, and counted with their weight; without ``parse`` none is.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    stored = {c: base.schema[c].dataType for c in kinds}
    groups = {
        "bigint": [c for c, t in stored.items() if isinstance(t, whole)],
        "double": [c for c, t in stored.items() if isinstance(t, (T.FloatType, T.DoubleType))],
    }
    rest = [c for c in kinds if c not in groups["bigint"] + groups["double"]]
    kind = _by_column(_stored(kinds))
    parts = []
    for name, columns in groups.items():
        if columns:
            cells = base.select(*[q(c).cast(name).alias(c) for c in columns]).unpivot([], [q(c) for c in columns], "column", "value")
            counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            read = F.when(F.col("value").isNotNull(), F.col("n"))
            parts.append(counted.select(
                "column", kind.alias("stored"), F.col("value").cast("string").alias("_key"), "n", read.alias("_x"),
                F.lit(None).cast("bigint").alias("_d"), F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("bigint").alias("variants"),
            ))
    if rest:
        cells = long_form(base, rest).withColumn("stored", kind)
        text = F.col("value")
        long = F.octet_length(text) > _DIGEST_BYTES
        cells = cells.withColumns({"_v": F.when(long, F.concat(F.lit("\0"), F.md5(text))).otherwise(text),
                                   "_k": F.when(long, F.concat(F.lit("\0"), F.md5(F.lower(text)))),
                               "_long": F.when(long & F.substring(text, 1, 1).rlike(_LONG_START), text)})
        if parse:
            cells = cells.withColumns({"_lx": to_number(F.col("_long"), trimmed=True).isNotNull(), "_ld": to_date_time(F.col("_long"), trimmed=True).isNotNull()})
        else:
            cells = cells.withColumns({"_lx": F.lit(False), "_ld": F.lit(False)})
        values = cells.groupBy("column", "stored", "_v", "_k", "_lx", "_ld").agg(F.count(F.lit(1)).alias("n"))
        values = values.withColumnRenamed("_v", "value")
        if parse:
            short = _parsed(values.withColumn("value", F.when(F.col("_k").isNull(), F.col("value"))))
            values = short.withColumns({"_x": F.col("_x") | F.col("_lx"), "_d": F.col("_d") | F.col("_ld")})
            values = values.withColumn("value", F.coalesce("value", "_k"))
        else:
            there = F.col("value").isNotNull()
            values = values.withColumns({"_x": there & (F.col("stored") == NUMERIC), "_d": there & (F.col("stored") == DATE)})
        n = F.col("n")
        parts.append(values.groupBy("column", "stored", F.coalesce("_k", F.lower("value")).alias("_key")).agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("_x"), n)).alias("_x"), F.sum(F.when(F.col("_d"), n)).alias("_d"),
            F.count("value").alias("variants"),
        ).select("column", "stored", "_key", "n", "_x", "_d", "variants"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_table(df: DataFrame, types: dict[str, str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    """One row per column with everything the choosing rules need. It is small, and cached for them.

    ``id_by_name`` and ``id_by_sequence`` are the two ways a column counts as an identifier. The sequence test
    runs only on columns that are numeric and nearly unique, and only where the table has row numbers.
    """
    base = normalise(df)
    kinds = classes(base)
    per_key = _key_counts(base, kinds, parse=not types or any(c not in types for c in kinds))

    def total(c) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    counted = per_key.groupBy("column", "stored").agg(
        total("n").alias("rows"),
        total(F.when(F.col("_key").isNotNull(), F.col("n"))).alias("non_null"),
        total("_x").alias("numeric_ok"),
        total("_d").alias("date_ok"),
        total("variants").alias("distinct"),
        F.count("_key").alias("distinct_keys"),
    )
    every = df.sparkSession.createDataFrame(
        [(i, c, s) for i, (c, s) in enumerate(_stored(kinds).items())], "ord int, column string, stored string"
    )
    facts = ("rows", "non_null", "numeric_ok", "date_ok", "distinct", "distinct_keys")
    # An empty table has no cells; its columns are listed all the same.
    table = every.join(counted.drop("stored"), "column", "left").withColumns(
        {f: F.coalesce(f, F.lit(0)) for f in facts}
    )
    given = _by_column(types) if types else F.lit(None).cast("string")
    table = keep(table.withColumn("detected_type", F.coalesce(given, detected_type())))
    ratio = F.try_divide(F.col("distinct"), F.col("non_null"))
    near_unique = (
        (F.col("detected_type") == NUMERIC) & (ratio >= ID_SEQUENCE_RATIO) & (F.col("non_null") >= ID_SEQUENCE_MIN)
    )
    sequences: list[str] = []
    if row_id in df.columns:
        candidates = [r["column"] for r in table.filter(near_unique).select("column").collect()]
        sequences = sequence_columns(base, candidates, row_id)
    return table.withColumns(
        {
            "unique_ratio": ratio,
            "id_by_name": F.coalesce(has_id_name(F.col("column")) & (ratio >= ID_NAME_RATIO), F.lit(False)),
            "id_by_sequence": F.col("column").isin(*sequences) if sequences else F.lit(False),
        }
    ).withColumn("is_id", F.col("id_by_name") | F.col("id_by_sequence"))


def high_cardinality(profile: DataFrame) -> DataFrame:
    """Categorical columns too varied for a fill value to make sense."""
    return profile.filter(
        F.col("detected_type").isin(CATEGORICAL, UNKNOWN)
        & (F.col("non_null") >= HIGH_CARDINALITY_MIN)
        & (F.col("unique_ratio") >= HIGH_CARDINALITY_RATIO)
    )


def column_classes(profile: DataFrame) -> DataFrame:
    """Each column's class, and whether it counts as a measure (numeric and no identifier)."""
    return profile.select(
        "ord", "column", "detected_type", "is_id",
        ((F.col("detected_type") == NUMERIC) & ~F.col("is_id")).alias("is_measure"),
    )


def filterable_columns(profile: DataFrame, max_unique: int = 25) -> DataFrame:
    return profile.filter(
        F.col("detected_type").isin(CATEGORICAL, UNKNOWN) & F.col("distinct").between(2, max_unique)
    )


def groupable_columns(profile: DataFrame, max_unique: int = 30) -> DataFrame:
    """Few enough distinct values for the table's size, or any categorical column with values."""
    limit = F.least(F.lit(max_unique), F.greatest(F.lit(8), F.floor(F.greatest(F.col("rows"), F.lit(1)) * 0.6)))
    return profile.filter(
        (F.col("non_null") > 0)
        & (F.col("distinct").between(F.lit(2), limit) | F.col("detected_type").isin(CATEGORICAL, UNKNOWN))
    )


def dataset_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(data_columns(df))))


@dataclass(frozen=True)
class ColumnProfile:
    """One row of ``profile_table`` on the driver."""

    name: str
    detected_type: str
    stored: str
    rows: int
    non_null: int
    distinct: int
    distinct_keys: int
    is_id: bool
    id_by_name: bool

    @property
    def unique_ratio(self) -> float:
        return self.distinct / self.non_null if self.non_null else 0.0

    @property
    def high_cardinality(self) -> bool:
        return self.non_null >= HIGH_CARDINALITY_MIN and self.unique_ratio >= HIGH_CARDINALITY_RATIO


def collect_profile(profile: DataFrame) -> dict[str, ColumnProfile]:
    """The profile on the driver, in column order: one entry per column, whatever the table's size."""
    names = [f for f in ColumnProfile.__dataclass_fields__ if f != "name"]
    rows = profile.orderBy("ord").select("column", *names).collect()
    return {r["column"]: ColumnProfile(r["column"], *[r[f] for f in names]) for r in rows}
