"""Correlations of wide tables: equal to the pairwise ones, in one scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import gram
from tablewright.operators import statistics as st


def frame(spark, rows=3000, columns=30, parts=7):
    parts_of = [
        F.when(F.pmod(F.hash("id", F.lit(i)), F.lit(4)) > 0, F.hash("id", F.lit(i % 6)) / 2.0**28 + F.col("id") * (i % 3) / 500 + 10.0 ** (i % 7))
        .alias(f"c{i}") for i in range(columns)
    ]
    odd = [
        F.lit(0.1).alias("same"), F.when(F.col("id") < 1, 5.0).alias("once"), F.lit(None).cast("double").alias("never"),
        F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") % 3).alias("far"), F.when(F.col("c1").isNull(), 7.0).otherwise(F.col("id")).alias("in_part"),
    ]
    return spark.range(rows, numPartitions=parts).select("id", *parts_of).select(*[f"c{i}" for i in range(columns)], *odd)


@pytest.mark.parametrize("block", [64, 8])
def test_gram_equals_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK_COLUMNS", block)
    df = frame(spark, columns=12).cache()
    names = df.columns
    want = {(r.column_a, r.column_b): r for r in st.correlation_pairs(df, names).collect()}
    got = gram.gram_correlations(st.number_columns(df, names), names).collect()
    assert [r.pair_ord for r in sorted(got, key=lambda r: r.pair_ord)] == list(range(len(want)))
    for r in got:
        w = want[r.column_a, r.column_b]
        assert r.n == w.n and r.pair_ord == w.pair_ord
        assert (r.r is None) == (w.r is None) and (r.r is None or math.isclose(r.r, w.r, abs_tol=1e-9)), (r, w)


def test_two_hundred_columns_in_one_scan(spark):
    df = frame(spark, rows=2000, columns=195).cache()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {(r.column_a, r.column_b): r for r in st.correlation_pairs(df.mapInArrow(counted, df.schema)).collect()}
    assert len(got) == 200 * 199 // 2 and seen.value == 2000
    local = df.toPandas()
    for a, b in (("c0", "c6"), ("c5", "c194"), ("c100", "c101"), ("c3", "far")):
        both = local[[a, b]].dropna()
        assert got[a, b].n == len(both) and abs(got[a, b].r - np.corrcoef(both[a], both[b])[0, 1]) < 1e-9


def test_no_rows(spark):
    df = frame(spark, columns=4).limit(0)
    got = gram.gram_correlations(df, df.columns).collect()
    assert all(r.r is None and r.n == 0 for r in got)


def test_large_numbers_that_differ_little(spark):
    df = spark.range(4000, numPartitions=5).select(
        (F.lit(1e11) + F.hash("id") % 100).alias("a"), (F.lit(-3e10) + F.hash("id") % 100 + F.hash("id", F.lit(1)) % 50).alias("b"),
    )
    local = df.toPandas()
    want = np.corrcoef(local["a"] - 1e11, local["b"] + 3e10)[0, 1]
    assert abs(gram.gram_correlations(df, ["a", "b"]).first().r - want) < 1e-12
