"""Operators on small tables: the facts of each rule, ties, gaps and independence of physical order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.config import CleaningConfig, ColumnRoles, Preferences
from tablewright.operators import duplicates as dup
from tablewright.operators import profile as prof
from tablewright.operators import selection as sel
from tablewright.operators import signals as sig
from tablewright.operators import statistics as st
from tablewright.operators.cleaning import clean, standardize
from tablewright.operators.filters import apply_filters, filter_audit
from tablewright.operators.quantiles import bracketed_quantiles, quantiles


def table(spark, columns: dict, types: str):
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, f"_row_id bigint, {types}")


def cleaned(df, subset=None, config=None):
    result = clean(df, prof.type_map(df), subset, config)
    return result, [r.asDict() for r in result.rows.orderBy("_row_id").collect()]


def test_first_spelling_of_each_key_stays(spark):
    """Five berths of two harbours, three written twice in other letters; the later spelling goes, the row order counts."""
    df = table(spark, {"harbour": ["Óbidos", "ÓBIDOS ", "Lund", "lund", "Óbidos", "Lund"], "berth": ["b1", "B1", "b1", " b1", "b2", "n/a"],
                       "depth": ["7.50", "7.50", "3", "3", "9", None]}, "harbour string, berth string, depth string")
    result, rows = cleaned(df, ["harbour", "berth"])
    assert [(r["_row_id"], r["harbour"]) for r in rows] == [(0, "Óbidos"), (2, "Lund"), (4, "Óbidos"), (5, "Lund")]
    assert any("Removed 2 " in t for t in result.log_texts())
    backwards = df.withColumn("_row_id", 5 - F.col("_row_id"))
    assert [r["harbour"] for r in cleaned(backwards, ["harbour", "berth"])[1]] == ["Lund", "Óbidos", "lund", "ÓBIDOS"]


@pytest.mark.parametrize("strategy, want", [("mean", 4.0), ("median", 3.0), ("leave", None)])
def test_fills_of_numbers(spark, strategy, want):
    df = table(spark, {"load": ["1", "3", "-", None, "8"]}, "load string").replace("-", "null", "load")
    _, rows = cleaned(df, config={"numeric_missing_strategy": strategy, "duplicate_action": "keep"})
    assert [r["load"] for r in rows] == [1.0, 3.0, want, want, 8.0]


def test_a_column_of_its_own_rule_ignores_the_general_one(spark):
    df = table(spark, {"wind": ["2", "4", None, "9"], "rain": ["1", None, "2", "3"], "crew": ["x", "y", "y", None], "flag": ["r", None, "s", "s"]},
               "wind string, rain string, crew string, flag string")
    config = CleaningConfig(numeric_missing_strategy="mean", numeric_column_strategies={"rain": "leave", "unknown": "mean"},
                            categorical_column_strategies={"flag": "mode"}, duplicate_action="keep")
    _, rows = cleaned(df, config=config)
    assert rows[2]["wind"] == 5.0 and rows[1]["rain"] is None
    assert rows[1]["flag"] == "s" and rows[3]["crew"] == "Unknown"


def test_identifiers_and_long_tails_are_not_filled(spark):
    n = 30
    df = table(spark, {"buoy_id": [None if i == 4 else str(70 + 3 * i) for i in range(n)], "note": [None if i == 9 else f"seen at {i}" for i in range(n)],
                       "swell": [None if i == 20 else str(i % 5) for i in range(n)]}, "buoy_id string, note string, swell string")
    result, rows = cleaned(df)
    assert rows[4]["buoy_id"] is None and rows[9]["note"] is None and rows[20]["swell"] is not None
    texts = " ".join(result.log_texts())
    assert "buoy_id" in texts and "note" in texts


def test_types_from_cells(spark):
    """Nine readable cells of ten make a type; signs, brackets and unit marks of numbers are read."""
    df = table(spark, {"flow": ["(12)", "$4,500", "+.5", "dry", *"123456"], "seen": ["5 Jan 2024", "2023/12/31", "20240229", "soon"] + ["2024-01-01"] * 6,
                       "tag": ["7a", "8", "x", "y", *"123abc"], "void": ["none", " NaT ", None, "missing"] + [""] * 6},
               "flow string, seen string, tag string, void string")
    types = prof.type_map(df)
    assert types == {"flow": "Numeric", "seen": "Date", "tag": "Categorical", "void": "Unknown"}
    rows = standardize(df, types).orderBy("_row_id").collect()
    assert [r.flow for r in rows][:4] == [-12.0, 4500.0, 0.5, None]
    assert [str(r.seen)[:10] for r in rows][:4] == ["2024-01-05", "2023-12-31", "2024-02-29", "None"]
    assert [r.void for r in rows] == [None] * 10


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "_row_id bigint, v double")
    assert prof.missing_counts(df).first()["missing"] == 2


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "_row_id bigint, a string, b double")
    assert {p.detected_type for p in prof.collect_profile(prof.profile_table(df)).values()} == {"Unknown"}


@pytest.mark.parametrize("values, is_id", [
    ([1, 2, 3, 4, 5], True), ([9, 7, 5, 3, 1], True), ([1, 3, 2, 4, 5], False), ([1, 2, 3, 4, 5.5], False),
    ([1, None, 3, 4, 5, 6], True), ([1, 2, 3, 4], False),
])
def test_sequence_identifiers(spark, values, is_id):
    df = table(spark, {"v": [None if v is None else float(v) for v in values]}, "v double")
    assert prof.collect_profile(prof.profile_table(df))["v"].is_id is is_id


def test_sequence_across_blocks(spark):
    """The break lies exactly between two blocks of row numbers."""
    rows = [(999_998, 1.0), (999_999, 2.0), (1_000_000, 3.0), (1_000_001, 4.0), (3_000_000, 5.0)]
    up = spark.createDataFrame(rows, "_row_id bigint, v double")
    assert prof.sequence_columns(up, ["v"]) == ["v"]
    broken = spark.createDataFrame(rows[:4] + [(3_000_000, 3.5)], "_row_id bigint, v double")
    assert prof.sequence_columns(broken, ["v"]) == []


def test_weak_key_and_null_keys(spark):
    df = table(spark, {"region": ["North", "North", "South", None, None]}, "region string")
    found = dup.key_diagnostics(df, ["region"]).first()
    assert found["status"] == "Weak" and found["duplicate_row_count"] == 2 and found["complete_rows"] == 3
    assert dup.duplicate_count(df, ["region"]).first()[0] == 2  # here NULL keys equal each other


def test_duplicates_with_a_hot_key(spark):
    """A third of all rows share one key; the salted path gives the same rows as the plain one."""
    df = spark.range(3000).select(F.col("id").alias("_row_id"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("k"))
    want = df.toPandas()
    want = set(want[want.duplicated("k", keep=False)]["_row_id"])
    repeated = dup.key_counts(df).filter("n > 1").withColumn("_hot", F.col("n") >= 100)
    keyed = dup.with_key(df).drop("_filled")
    for got in (dup.duplicate_rows(df), dup._salted_semi_join(keyed, repeated, 1)):
        assert sorted(r["_row_id"] for r in got.collect()) == sorted(want)
    kept = {r["_row_id"] for r in dup.drop_repeats(df).collect()}
    assert kept == set(df.toPandas().drop_duplicates("k")["_row_id"])


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, 10.0], [5.0], [-3.5, 0.0, 0.0, 2.0, 1e300, -1e-300, 7.0], list(np.random.default_rng(1).normal(size=999)),
    [4.0] * 50 + [4.000001], list(np.random.default_rng(2).pareto(0.5, 500) * 1e6),
])
def test_quantiles_equal_pandas(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    want = pd.Series(values).quantile(probs).to_list()
    for got in (quantiles(df, ["v"], probs), bracketed_quantiles(df, ["v"], probs)):
        assert got.first()["q"] == pytest.approx(want, rel=1e-12)


def test_quantile_paths_mix(spark):
    df = spark.range(1000).select((F.col("id") * 1.0).alias("many"), (F.col("id") % 3).alias("few"))
    got = {r["column"]: r["q"][0] for r in quantiles(df, ["many", "few"], (0.5,), limit=100).collect()}
    assert got == {"many": 499.5, "few": 1.0}


def test_summary_and_correlation_with_gaps(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "c": 1.0})
    pdf.loc[pdf.index % 7 == 0, "a"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in df.columns])
    pairs = {(r["column_a"], r["column_b"]): (r["r"], r["n"]) for r in st.correlation_pairs(df).collect()}
    assert pairs["a", "b"][0] == pytest.approx(pdf["a"].corr(pdf["b"])) and pairs["a", "b"][1] == len(pdf[["a", "b"]].dropna())
    assert pairs["a", "c"][0] is None
    want = pdf["a"].describe()
    got = st.numeric_summary(df, ["a"]).first()
    for name, key in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        assert got[name] == pytest.approx(want[key])


def test_outliers(spark):
    """Bounds are not outliers themselves, a column without spread has none, and three distinct values are too few."""
    edge = [0.0, 10.0, 10.0, 12.0, 14.0, 14.0, 20.0]  # quartiles 10 and 14: bounds 4 and 20
    df = spark.createDataFrame(list(zip(edge, [5] * 6 + [500], [1, 1, 1, 1, 2, 2, 90])), "tide double, flat int, few int")
    got = {r["column"]: (r["outliers"], r["lower_bound"], r["upper_bound"]) for r in st.outlier_summary(df).collect()}
    assert got == {"tide": (1, 4.0, 20.0)}


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert [(r["bin"], r["n"]) for r in st.histogram(df, "v").collect()] == [(1, 4)]


def test_natural_order_of_groups(spark):
    """Numbers by size and texts by letters, whatever the metric; blanks are a group when rows are counted."""
    df = table(spark, {"deck": [10, 9, 100, 9, None], "port": ["Vigo", "Ærø", "Bari", "Bari", "Vigo"], "tons": [4, 8, 1, 2, 3]},
               "deck int, port string, tons int")
    decks = st.grouped_metric(df.filter("deck IS NOT NULL"), "deck", "tons", "sum", sort="natural").collect()
    assert [(r[0], r[1]) for r in decks] == [("9", 10.0), ("10", 4.0), ("100", 1.0)]
    assert [r[0] for r in st.grouped_metric(df, "port", "tons", "max", sort="natural").collect()] == ["Bari", "Vigo", "Ærø"]
    counted = {r[0]: r[1] for r in st.grouped_metric(df, "deck").collect()}
    assert counted == {"9": 2, "10": 1, "100": 1, "Missing": 1}


def test_filters_and_audit(spark):
    """A NULL meets no filter, both ends of a range belong to it, and each filter's own share is told."""
    df = spark.sql("""SELECT * FROM VALUES (1, 'kelp', 2.5D, date'2023-02-28'), (2, 'Kelp', 2.5D, date'2023-03-01'), (3, NULL, 7D, date'2023-03-02'),
        (4, 'moss', NULL, date'2023-03-02'), (5, 'moss', 7.01D, NULL), (6, 'moss', 7D, date'2023-03-02') t(k, plant, mass, picked)""")
    wanted = {"categorical": {"plant": ["kelp", "moss"], "no_such": ["x"], "k": []}, "numeric": {"mass": (2.5, 7)},
              "dates": {"picked": ("2023-02-28", "2023-03-02")}}
    rows, audit = apply_filters(df, **wanted)
    assert sorted(r["k"] for r in rows.collect()) == [1, 6] and len(audit) == 3
    assert {r["column"]: r["rows_kept"] for r in filter_audit(df, **wanted).collect()} == {"plant": 4, "mass": 4, "picked": 5}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("string").alias("s"), F.lit(1).alias("z")).write.parquet(f"{tmp_path}/t")
    rows, _ = apply_filters(spark.read.parquet(f"{tmp_path}/t"), {"s": ["1"]}, {"id": (0, 5)})
    plan = rows.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,0)" in plan and "In(s" in plan.replace("EqualTo(s", "In(s") and "z:int" not in plan


def test_time_axis_and_segment(spark):
    df = spark.sql("""SELECT id AS _row_id, timestamp_ntz'2024-01-01' AS snapshot,
        timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) AS day, cast(10 + 2 * id as int) AS sales FROM range(4)""")
    profile = prof.profile_table(df)
    assert sel.choose_time(df, profile, exclude={"sales"})[0] == "day"
    moved = sig.trend(df, "day", "sales").first()
    assert (moved["direction"], moved["distinct_periods"], moved["support"]) == ("upward", 4, "Directional")
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 9.0)], "g string, v double")
    gap = sig.segment_gap(flat, "g", "v").first()
    assert (gap["top_label"], gap["bottom_label"], gap["effect_size"]) == ("a", "b", 0.0)


def test_results_do_not_depend_on_physical_order(spark):
    df = spark.range(2000).select(F.col("id").alias("_row_id"), (F.col("id") % 7).cast("string").alias("g"),
                                  F.concat(F.lit("$"), (F.col("id") * 37 % 501).cast("string")).alias("v"))
    seen = []
    for frame in (df.repartition(1), df.repartition(64)):
        result = clean(frame, prof.type_map(frame), ["g", "v"])
        seen.append((result.log, sorted(map(tuple, result.rows.collect()))))
    assert seen[0] == seen[1]


def test_config_forms():
    class Loose:
        duplicate_action = "keep"
        categorical_text_strategy = "lower"
        categorical_column_strategies = {"deck": "mode"}
        unrelated = object()

    found = CleaningConfig.of(Loose())
    assert (found.duplicate_action, found.categorical_text_strategy) == ("keep", "lower")
    assert found.categorical_column_strategies == {"deck": "mode"} and found.numeric_missing_strategy == CleaningConfig().numeric_missing_strategy
    assert CleaningConfig.of(found) == found and CleaningConfig.of(None) == CleaningConfig.of({}) == CleaningConfig()
    for wrong in ({"numeric_strategy": "mean"}, {"duplicate_action": "keep", "x": 0}):
        with pytest.raises(TypeError):
            CleaningConfig.of(wrong)
    roles = ColumnRoles(id_columns=("buoy", "mast"), time_column="seen")
    prefs = Preferences(column_roles=roles, duplicate_subset=("buoy",))
    assert Preferences.of(prefs.to_dict()) == prefs == Preferences.of(prefs)
    assert roles.given and not ColumnRoles().given and "buoy" in " ".join(roles.describe())
