"""Cleaning per slice gives what cleaning each slice alone gives."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators.cleaning import clean
from tablewright.operators.slices import clean_slices

TYPES = {"n": "Numeric", "seq": "Numeric", "t": "Categorical", "own": "Categorical", "d": "Date"}


def frame(spark):
    """Slice a: gaps everywhere; b: an identifier-like sequence and unique texts; NULL: all cells missing; c: one row."""
    rows = []
    for i in range(40):
        s = ("a", "b", None)[i % 3]
        k = i // 3
        rows.append((
            i, s, None if s is None or k % 4 == 0 else str((k * 7) % 5), str(k * 3) if s == "b" and k != 4 else (None if s is None else str(k % 2)),
            None if k % 5 == 0 or s is None else f"v{k % 2}", f"text {i}" if s == "b" and k != 2 else (None if k % 3 == 0 else "x"),
            "2024-01-01" if k % 2 else None,
        ))
    rows += [(100 + i, "a", "3", "1", "v1", "x", "2024-01-01") for i in range(3)] + [(200, "c", None, "1", None, "x", None)]
    return spark.createDataFrame(rows, "_row_id long, s string, n string, seq string, t string, own string, d string")


@pytest.mark.parametrize("config, subset", [
    (None, ["n", "t"]), ({"numeric_missing_strategy": "mean", "categorical_missing_strategy": "mode"}, None),
    ({"numeric_column_strategies": {"seq": "median"}, "categorical_missing_strategy": "leave", "duplicate_action": "keep"}, None),
])
def test_equals_cleaning_each_slice(spark, config, subset):
    df = frame(spark).cache()
    got = clean_slices(df, TYPES, ["s"], subset, config)
    rows = sorted(map(str, got.rows.collect()))
    want = []
    for s in ("a", "b", "c", None):
        part = df.filter(F.col("s").eqNullSafe(F.lit(s)))
        alone = clean(part.drop("s"), TYPES, subset, config)
        want += alone.rows.select("_row_id", F.lit(s).cast("string").alias("s"), "n", "seq", "t", "own", "d").collect()
        log = {(r["column"], r["action"], r["n"]) for r in got.log.filter(F.col("s").eqNullSafe(F.lit(s))).collect()}
        own = {(e[1], e[2], e[3]) for e in alone.log if e[2] in ("fill", "leave", "keep_blank") and e[1] is not None}
        protected = {c for c, a, _ in log if a == "protect"}
        assert {e for e in log if e[1] in ("fill", "leave", "keep_blank")} == {e for e in own if e[0] not in protected}
        assert protected == set(alone.plan.protected)
        assert {e[2] for e in log if "duplicates" in e[1]} == {alone.duplicates_found}
    assert rows == sorted(map(str, want))


def test_slices_of_an_empty_table(spark):
    got = clean_slices(frame(spark).limit(0), TYPES, ["s"])
    assert got.rows.collect() == [] and got.log.collect() == []
