"""One answer whatever the size and the slice: NULL slices, NaN, infinities and negative zero."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import quantiles as quantiles_module
from tablewright.operators import selection
from tablewright.operators import statistics as st
from tablewright.operators.cleaning import clean
from tablewright.operators.duplicates import key_diagnostics
from tablewright.operators.filters import apply_filters
from tablewright.operators.profile import type_map
from tablewright.operators.quantiles import bracketed_quantiles, number_columns, quantiles
from tablewright.session import kept_tables
from tablewright.sources.delimited import read_csv
from tablewright.sources.events import event_snapshot

NAN, INF = float("nan"), float("inf")
PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


@pytest.fixture
def odd(spark):
    values = [1.0, 2.0, 3.0, 10.0, -0.0, 0.0, NAN, INF, -INF, None, 1e300, -1e-300, 7.5]
    rows = [(g, v, (i * 37 % 11) * 1.0) for g in ("a", None, "b") for i, v in enumerate(values) if g != "b" or v is None or v != v]
    return spark.createDataFrame(rows, "g string, v double, w double")


def as_rows(df):
    return sorted((str(r.g) if "g" in df.columns else "", r.column, r.n, [round(x, 9) + 0.0 for x in r.q]) for r in df.collect())


@pytest.mark.parametrize("by", [(), ("g",)])
def test_both_quantile_paths_agree(odd, by):
    a, b = (quantiles(odd, ["v", "w"], PROBS, by, limit=n) for n in (1_000_000, 0))
    assert as_rows(a) == as_rows(b) and any(r[0] == "None" for r in as_rows(a)) == bool(by)


@pytest.mark.parametrize("rows", [4_000_000, 1])
def test_far_values_and_a_scan_between(spark, rows):
    """Values that differ in the last digits, one far from all, and brackets narrowed by a scan of their own."""
    df = spark.range(4000).select((1.0 + F.col("id") * 1e-12).alias("v")).union(spark.createDataFrame([(1.01,)], "v double"))
    got = bracketed_quantiles(number_columns(df, ["v"]), ["v"], (0.5, 0.999), bracket_rows=rows).first()
    want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.999))).alias("q")).first()
    assert got.n == 4001 and all(math.isclose(a, b, rel_tol=1e-15) for a, b in zip(got.q, want.q))


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("error", [None, -0.02])
def test_quantiles_of_many_values(spark, monkeypatch, by, error):
    """Skewed values, ties over several brackets; with brackets that miss (a negative error), ranks are looked for again."""
    if error:
        for name in ("_WHOLE", "_SLICE"):
            monkeypatch.setattr(quantiles_module, name, (512, error))
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"), F.exp(F.hash("id") / 2.0**28).alias("a"),
        F.when(F.col("id") % 5 < 3, 7.0).otherwise(F.floor(F.hash("id") / 1e6).cast("double")).alias("b"),
    )
    probs = (0.0, 0.01, 0.25, 0.5, 0.5001, 0.75, 0.999, 1.0)
    got = bracketed_quantiles(number_columns(df, ["a", "b"], by), ["a", "b"], probs, by, bracket_rows=100 if error is None else 10**9)
    want = {}
    for r in df.groupBy(*by).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "ab"]).collect():
        want |= {(str(r["g"]) if by else "", c): r[c] for c in "ab"}
    found = {(str(r["g"]) if by else "", r["column"]): r["q"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(x, y, rel_tol=1e-12) for k in want for x, y in zip(found[k], want[k]))


def test_quantiles_scan_the_table_twice(spark, tmp_path):
    """One scan for the sketches, one for the counts: seen by the rows that the scans read."""
    spark.range(50_000).selectExpr("CAST(hash(id) AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b").write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(str(tmp_path / "t"))

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert len(quantiles(df.mapInArrow(counted, df.schema), ["a", "b"], (0.25, 0.5, 0.75)).collect()) == 2
    assert seen.value <= 3 * 50_000


def test_summary_counts_only_numbers(odd):
    whole = st.numeric_summary(odd, ["v"]).first()
    assert whole["count"] == 18 and whole["max"] == 1e300 and not math.isnan(whole["p50"])
    sliced = {r.g: r for r in st.numeric_summary(odd, ["v"], ["g"]).collect()}
    assert sliced[None]["p50"] == sliced["a"]["p50"] is not None and sliced["b"]["count"] == 0


def test_outliers_of_the_slice_without_a_name(spark):
    rows = [(g, float(v)) for g in ("a", None) for v in (10, 20, 30, 40, 50, 60, 70, 80, 9999)]
    got = st.outlier_summary(spark.createDataFrame(rows, "g string, v double"), ["v"], ["g"]).collect()
    assert sorted(str(r.g) for r in got) == ["None", "a"] and all(r.outliers == 1 for r in got)


def test_correlation_ignores_nan(spark):
    rows = [(1.0, 4.0), (2.0, 1.0), (3.0, 3.0), (4.0, 2.0), (NAN, 9.0), (5.0, INF)]
    r = st.correlation_pairs(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
    assert r.n == 4 and abs(r.r - (-0.4)) < 1e-12


def test_unknown_key_compares_nothing(spark):
    r = key_diagnostics(spark.createDataFrame([(1,), (1,)], "x int"), ["nope"]).first()
    assert (r.status, r.total_rows, r.duplicate_group_count, r.completeness_ratio) == ("Unavailable", 0, 0, 0.0)


def test_filter_values_of_another_type(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    assert [r.n for r in apply_filters(df, {"n": ["2", "x"]})[0].collect()] == [2]
    assert apply_filters(df, {"n": ["x"]})[0].count() == 0
    assert apply_filters(df, {"s": ["b", 1]})[0].count() == 1


@pytest.mark.parametrize("kind", ["int", "long", "decimal(10,0)", "double"])
def test_filter_values_are_not_cut(spark, kind):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int").selectExpr(f"CAST(n AS {kind}) AS n")
    assert [int(r.n) for r in apply_filters(df, {"n": [1.9, 2.0]})[0].collect()] == [2]
    assert apply_filters(df, {"n": [1e30, float("nan"), float("inf"), "1.5"]})[0].count() == 0
    assert apply_filters(df, {"n": [1, "2 ", None, True]})[0].count() in (1, 2)


def test_equal_times_do_not_change_the_snapshot(spark):
    rows = [("t1", f"type{i}", "ok", f"r{i}") for i in range(5)]
    for some in (rows, rows[::-1]):
        got = event_snapshot(spark.createDataFrame(some, "timestamp string, event_type string, status string, run_id string"), 3).first()
        assert (got.n, got.last_event_type) == (3, "type4")


def test_first_date_stands_in_for_an_axis(spark, monkeypatch):
    table = spark.createDataFrame([("a", "Categorical", 0), ("d", "Date", 1), ("e", "Date", 2)], "column string, detected_type string, ord int")
    df = spark.createDataFrame([("x", None, None)], "a string, d date, e date")
    monkeypatch.setattr(selection, "time_axis_ranking", lambda *a: table.limit(0))
    assert selection.choose_time(df, table) == ("d", "datetime")
    assert selection.choose_time(df, table, exclude={"d"}) == ("e", "datetime")
    assert selection.choose_time(df, table, exclude={"d", "e"}) == (None, None)


def test_a_run_leaves_no_cached_table(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", str(i * 7 % 20)) for i in range(60)], "_row_id bigint, g string, v string")
    persisted = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = persisted()
    with kept_tables():
        result = clean(df, type_map(df), ["g", "v"])
        assert result.rows.count() == 60 and persisted() > before
    assert persisted() == before


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def test_files_with_other_columns_are_refused(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,2\n")
    write(tmp_path, "b.csv", "v,k\n2,1\n")
    with pytest.raises(ValueError, match="another order"):
        read_csv(spark, str(tmp_path))
    write(tmp_path, "b.csv", "k,v,w\n2,1,3\n")
    with pytest.raises(ValueError, match="not the same"):
        read_csv(spark, str(tmp_path))


def test_other_files_of_a_folder_are_left_out(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,2\n")
    write(tmp_path, "n.txt", "no data\n")
    assert [r.k for r in read_csv(spark, str(tmp_path)).rows.collect()] == ["1"]


def test_stray_quote_is_reported(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = ["k,v"] + [f"{i},x{i}" for i in range(4000)]
        lines[7] = '6,"open'
        write(tmp_path, "a.csv", "\n".join(lines) + "\n")
        with pytest.raises(ValueError, match="never closed"):
            read_csv(spark, str(tmp_path))
        lines[3000] = 'closed",1'
        write(tmp_path, "a.csv", "\n".join(lines) + "\n")
        assert read_csv(spark, str(tmp_path)).rows.count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
