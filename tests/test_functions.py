from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright.functions.csvcells import split_record, write_record
from tablewright.functions.labels import segment_support

NUMBERS = {
    "$1,200": 1200.0, "(5)": -5.0, "($3.5)": -3.5, "1e5": 1e5, "+4": 4.0, ".5": 0.5, "1.": 1.0, " 7 ": 7.0,
    "$ 5": 5.0, "10d": None, "10f": None, "0x10": None, "0x1p3": None, "1_000": None, "5%": None, "True": None,
    "-(3)": None, "1 000": None, "1e400": None, "inf": None, "Infinity": None, "nan": None, "": None, None: None,
}
DATES = {
    "2024-01-05": (2024, 1, 5), "2024/01/05": (2024, 1, 5), "01/05/2024": (2024, 1, 5), "5 Jan 2024": (2024, 1, 5),
    "Jan 5, 2024": (2024, 1, 5), "20240105": (2024, 1, 5), "2024-1-5": (2024, 1, 5), "01-05-24": (2024, 1, 5),
    "13/05/2024": (2024, 5, 13), "5.1.2024": (2024, 5, 1), "January 2024": (2024, 1, 1), "2024": (2024, 1, 1),
    "2024-01": (2024, 1, 1), "January 5, 2024": (2024, 1, 5), "01-05-99": (1999, 1, 5), "1/5/2024 9:30": (2024, 1, 5, 9, 30),
    "2024-01-05 10:20:30": (2024, 1, 5, 10, 20, 30), " 2024-01-05 ": (2024, 1, 5),
    "2026-02-30": None, "invalid_date": None, "E100": None, "T-001": None, "12.5": None, "2024-W05": None,
    "10:30": None, "today": None, "2024Q1": None, None: None,
}


def test_numbers(texts):
    got = texts(NUMBERS).select("s", fn.to_number(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in got} == NUMBERS


def test_dates(texts):
    got = texts(DATES).select("s", fn.to_date_time(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in got} == {k: v and datetime(*v) for k, v in DATES.items()}


def test_null_tokens(texts):
    values = [" N/A ", "None", "NaT", "missing", "\t", "", "--", "unknown", " Keep Me ", "\xa0na　"]
    got = [r["v"] for r in texts(values).select(fn.null_tokens_to_null(F.col("s")).alias("v")).collect()]
    assert got == [None, None, None, None, None, None, "--", "unknown", "Keep Me", None]


def test_text_modes(texts):
    row = texts([" o'neil north-east mcDONALD 3rd "]).select(
        fn.text_mode(F.col("s"), "title").alias("t"), fn.text_mode(F.col("s"), "lower").alias("l"),
        fn.text_mode(F.col("s")).alias("s"),
    ).first()
    assert row["t"] == "O'Neil North-East Mcdonald 3Rd"
    assert row["l"] == "o'neil north-east mcdonald 3rd"
    assert row["s"] == "o'neil north-east mcDONALD 3rd"


def test_metric_text_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1234.5,), (12.0,), (2.25,), (-1500.0,), (0.35,)], "v double")
    assert [r[0] for r in df.select(fn.metric_text(F.col("v"))).collect()] == ["1,234", "12", "2.2", "-1,500", "0.4"]


def test_metric_text_keeps_the_sign_of_small_values(spark):
    df = spark.createDataFrame([(-0.04,), (-0.01,), (0.04,), (-12.36,), (-999.0,), (None,)], "v double")
    assert [r[0] for r in df.select(fn.metric_text(F.col("v"))).collect()] == ["-0.0", "-0.0", "0.0", "-12.4", "-999", None]


@pytest.mark.parametrize(
    "line, cells",
    [
        ('"q,1",5', ["q,1", "5"]), ('"a ""x"", b",5', ['a "x", b', "5"]), ("East,7,", ["East", "7", ""]),
        ("South", ["South"]), ("", []), ('5" pipe,x', ['5" pipe', "x"]), ('"ab"c,d', ["abc", "d"]), ('""', [""]),
        ('"a\nb",c', ["a\nb", "c"]), (",", ["", ""]),
    ],
)
def test_split_record(texts, line, cells):
    assert texts([line]).select(split_record(F.col("s"))).first()[0] == cells


def test_long_quoted_fields_use_no_stack(texts):
    line = '"' + '""' * 60_000 + '",x'
    assert [len(c) for c in texts([line]).select(split_record(F.col("s"))).first()[0]] == [60_000, 1]


def test_write_record(spark):
    df = spark.createDataFrame([(["a", "b,c", 'd"e', "f\ng"],)], "c array<string>")
    assert df.select(write_record(F.col("c"))).first()[0] == 'a,"b,c","d""e","f\ng"'


def test_content_key_ignores_argument_order(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    one = fn.content_key({"a": F.col("a"), "b": F.col("b")})
    two = fn.content_key({"b": F.col("b"), "a": F.col("a")})
    other = fn.content_key({"a": F.col("b"), "b": F.col("a")})
    row = df.select(one.alias("k1"), two.alias("k2"), other.alias("k3")).first()
    assert row["k1"] == row["k2"] != row["k3"]


def test_support_labels(spark):
    corr = [(4, 0.9, "Insufficient"), (7, 0.9, "Directional"), (8, 0.1, "Weak"), (14, 0.9, "Directional"),
            (15, 0.3, "Directional"), (15, 0.35, "Supported")]
    df = spark.createDataFrame(corr, "n int, r double, want string")
    assert not df.filter(fn.correlation_support(F.col("n"), F.col("r")) != F.col("want")).count()
    trend = [(3, 9, 1.0, "Insufficient"), (9, 2, 1.0, "Insufficient"), (9, 3, 1.0, "Directional"),
             (9, 8, 0.44, "Directional"), (9, 6, 1.0, "Directional"), (9, 8, 0.65, "Supported")]
    df = spark.createDataFrame(trend, "n int, p int, c double, want string")
    assert not df.filter(fn.trend_support(F.col("n"), F.col("p"), F.col("c")) != F.col("want")).count()
    seg = [(1, 9, 1.0, "Insufficient"), (2, 1, 1.0, "Insufficient"), (2, 2, 9.0, "Directional"),
           (2, 9, 0.3, "Directional"), (2, 4, 9.0, "Directional"), (2, 5, 0.59, "Directional"), (2, 5, -0.6, "Supported")]
    df = spark.createDataFrame(seg, "g int, n int, e double, want string")
    assert not df.filter(segment_support(F.col("g"), F.col("n"), F.col("e")) != F.col("want")).count()
