"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright.operators.cleaning import standardize

from .inputs import DIRTY_TYPES, dirty, sql_date, sql_norm, sql_number, sql_with, table


def null_tokens(spark, sf):
    return dirty(spark, sf).select(
        F.col("_row_id").alias("row_id"),
        *[fn.null_tokens_to_null(F.col(c)).alias(c) for c in ("priority", "amount", "order_date")],
    )


def compare_text(spark, sf):
    return dirty(spark, sf).select(F.col("_row_id").alias("row_id"), fn.compare_text(F.col("priority")).alias("key"))


def coerce_numeric(spark, sf):
    return dirty(spark, sf).select(F.col("_row_id").alias("row_id"), fn.to_number(F.col("amount")).alias("amount"))


def coerce_dates(spark, sf):
    return dirty(spark, sf).select(
        F.col("_row_id").alias("row_id"), fn.to_date_time(F.col("order_date")).alias("order_date")
    )


def text_modes(spark, sf):
    return dirty(spark, sf).select(
        F.col("_row_id").alias("row_id"),
        *[fn.text_mode(F.col("priority"), m).alias(f"{m}_text") for m in ("strip", "lower", "title")],
    )


def standardize_table(spark, sf):
    return standardize(dirty(spark, sf), DIRTY_TYPES).withColumnRenamed("_row_id", "row_id")


def metric_format(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.metric_text(F.col("c_acctbal")).alias("shown"))


def strength_labels(spark, sf):
    r = F.col("l_tax") * 10 - F.col("l_discount") * 5
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.relationship_strength(r).alias("strength")
    )


def display_rounding(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        fn.display_number(F.col("o_totalprice") / 7, 3).alias("shown"),
        fn.display_number(F.col("o_totalprice") / 7, 4).alias("in_context"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso_time"),
    )


def content_keys(spark, sf):
    cells = {c: F.col(c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")}
    return table(spark, sf, "orders").select("o_orderkey", fn.content_key(cells).alias("content_key"))


QUERIES = {
    f.__name__: f
    for f in (
        null_tokens, compare_text, coerce_numeric, coerce_dates, text_modes, standardize_table, metric_format,
        strength_labels, display_rounding, content_keys,
    )
}

_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(lower(trim(priority)), '[a-z]+|[^a-z]+'), "
    "lambda x: upper(x[1]) || x[2:]), '')"
)

ORACLES = {
    "null_tokens": sql_with() + " SELECT _row_id AS row_id, priority, amount, order_date FROM norm",
    "compare_text": sql_with() + " SELECT _row_id AS row_id, lower(trim(priority)) AS key FROM raw",
    "coerce_numeric": sql_with() + f" SELECT _row_id AS row_id, {sql_number('trim(amount)')} AS amount FROM raw",
    "coerce_dates": sql_with() + f" SELECT _row_id AS row_id, {sql_date('trim(order_date)')} AS order_date FROM raw",
    "text_modes": sql_with() + f""" SELECT _row_id AS row_id, trim(priority) AS strip_text,
        lower(trim(priority)) AS lower_text, {_TITLE} AS title_text FROM raw""",
    "standardize_table": sql_with() + " SELECT _row_id AS row_id, * EXCLUDE (_row_id) FROM typed",
    "metric_format": """SELECT c_custkey, CASE
        WHEN abs(c_acctbal) >= 1000 THEN format('{:,}', CAST(round_even(c_acctbal, 0) AS BIGINT))
        WHEN c_acctbal = floor(c_acctbal) THEN printf('%.0f', c_acctbal)
        ELSE printf('%.1f', round_even(c_acctbal, 1)) END AS shown FROM customer""",
    "strength_labels": """SELECT l_orderkey, l_linenumber, CASE WHEN a >= 0.8 THEN 'very strong'
        WHEN a >= 0.6 THEN 'strong' WHEN a >= 0.4 THEN 'moderate' WHEN a >= 0.2 THEN 'light' ELSE 'weak' END
        AS strength FROM (SELECT l_orderkey, l_linenumber,
          abs(l_tax * 10::DOUBLE - l_discount * 5::DOUBLE) AS a FROM lineitem)""",
    "display_rounding": """SELECT o_orderkey, round_even(o_totalprice / 7, 3) AS shown,
        round_even(o_totalprice / 7, 4) AS in_context, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso_time
        FROM orders""",
    "content_keys": """SELECT o_orderkey, sha256('{"o_custkey":"' || o_custkey || '","o_orderpriority":"' ||
        o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS content_key FROM orders""",
}
