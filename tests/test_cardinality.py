"""Rules from sketches give what the exact profile gives, and group only what they must."""

from pyspark.sql import functions as F

from tablewright.operators import cardinality
from tablewright.operators.cardinality import column_rules, rules_table
from tablewright.operators.profile import collect_profile, profile_table


def wide(spark, n=6000):
    return spark.range(n).select(
        F.col("id").alias("_row_id"), F.col("id").alias("up"), (n - F.col("id")).cast("double").alias("down"), F.hash("id").alias("mixed"),
        (F.col("id") % 7).alias("seven"), F.concat(F.lit("v"), F.col("id") % 25).alias("t25"), F.concat(F.lit("v"), F.col("id") % 26).alias("t26"),
        F.concat(F.lit("name "), F.col("id")).alias("own"), F.concat(F.lit("k"), F.floor(F.col("id") * 0.81)).alias("near81"),
        F.concat(F.lit("k"), F.floor(F.col("id") * 0.79)).alias("near79"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("order_id"),
        F.when(F.col("id") % 10 < 9, F.col("id").cast("string")).otherwise("n/a").alias("digits"), F.lit(None).cast("string").alias("void"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("long " * 30), F.col("id"))).alias("long"), (F.col("id") % 1000).alias("again"),
        F.when(F.col("id") % 50 > 0, F.col("id") + 0.5).alias("halves"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
    )


def test_rules_equal_the_profile(spark):
    df = wide(spark).cache()
    rules, exact = column_rules(df), collect_profile(profile_table(df))
    assert list(rules) == list(exact)
    for name, r in rules.items():
        p = exact[name]
        assert (r.detected_type, r.rows, r.non_null, r.is_id, r.id_by_name) == (p.detected_type, p.rows, p.non_null, p.is_id, p.id_by_name), name
        assert r.distinct in (None, p.distinct), name
        text = p.detected_type in ("Categorical", "Unknown")
        assert r.filterable() == (text and 2 <= p.distinct <= 25), name
        assert r.groupable() == (p.non_null > 0 and (2 <= p.distinct <= 30 or text)), name
        if text:
            assert r.high_cardinality == p.high_cardinality, name


def test_only_what_straddles_is_grouped(spark, monkeypatch):
    grouped = []
    counts = cardinality._key_counts
    monkeypatch.setattr(cardinality, "_key_counts", lambda df, kinds, **kw: grouped.extend(kinds) or counts(df, kinds, **kw))
    column_rules(wide(spark))
    assert set(grouped) <= {"near81", "near79"} and grouped


def test_given_types_and_empty_tables(spark):
    df = spark.createDataFrame([], "_row_id long, a string, b double")
    assert {r.detected_type for r in column_rules(df).values()} == {"Unknown"}
    few = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "_row_id long, a string")
    assert column_rules(few, {"a": "Categorical"})["a"].detected_type == "Categorical"
    assert column_rules(few)["a"].detected_type == "Numeric"
    assert rules_table(spark, column_rules(few)).count() == 1
    assert column_rules(spark.createDataFrame([(1,)], "_row_id long")) == {}
