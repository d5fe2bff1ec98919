"""Filling, cleaning and the log of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.config import CleaningConfig
from tablewright.operators.cardinality import column_rules
from tablewright.operators.cleaning import apply_fills, clean, plan_fills, standardize
from tablewright.operators.profile import type_map
from tablewright.operators.slices import clean_slices
from tablewright.operators.statistics import grouped_metric
from tablewright.session import keep

from .inputs import DIRTY_TYPES, REPLAYED, dirty, replayed, rounded, sql_with, table

KEY = ["order_id", "order_date"]


def _filled(spark, sf, config):
    typed = keep(standardize(dirty(spark, sf), DIRTY_TYPES, config))  # parsed once, read by the rules, the fills and the result
    plan = plan_fills(typed, column_rules(typed, DIRTY_TYPES), config)
    return apply_fills(typed, plan)


def fill_median(spark, sf):
    return _filled(spark, sf, None).select(F.col("_row_id").alias("row_id"), "amount")


def fill_mean(spark, sf):
    df = _filled(spark, sf, {"numeric_missing_strategy": "mean"})
    return rounded(df.select(F.col("_row_id").alias("row_id"), "amount"), {"amount": 4})


def fill_mode(spark, sf):
    df = _filled(spark, sf, {"categorical_missing_strategy": "mode", "categorical_text_strategy": "lower"})
    return df.select(F.col("_row_id").alias("row_id"), "priority", "status")


def fill_unknown(spark, sf):
    return _filled(spark, sf, None).select(F.col("_row_id").alias("row_id"), "priority", "order_date")


def fill_overrides(spark, sf):
    """A column's own strategy comes first: amounts stay empty although the table's strategy is the mean."""
    config = CleaningConfig(
        numeric_missing_strategy="mean", numeric_column_strategies={"amount": "leave"},
        categorical_column_strategies={"priority": "leave"},
    )
    return _filled(spark, sf, config).select(F.col("_row_id").alias("row_id"), "priority", "amount")


def fill_protection(spark, sf):
    """Identifiers and high-cardinality texts are left as they are, with the reason."""
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("_row_id"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey").cast("string")).alias("customer_id"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    types = type_map(df)
    result = clean(df, types)
    return result.rows.withColumnRenamed("_row_id", "row_id")


def clean_table(spark, sf):
    return clean(replayed(spark, sf), DIRTY_TYPES, KEY).rows.withColumnRenamed("_row_id", "row_id")


def clean_log(spark, sf):
    log = clean(replayed(spark, sf), DIRTY_TYPES, KEY).log_table()
    return log.select("ord", "column", "action", "n")


def clean_group_mean(spark, sf):
    """Profile the irregular lines, clean by what was found, and average per priority."""
    df = replayed(spark, sf)
    rows = clean(df, type_map(df), KEY, {"categorical_text_strategy": "title"}).rows
    return rounded(grouped_metric(rows, "priority", "amount", "mean"), {"value": 4})


def clean_by_status(spark, sf):
    """Every order status is a table of its own: its median, its duplicates."""
    return clean_slices(replayed(spark, sf), DIRTY_TYPES, ["status"], KEY).rows.withColumnRenamed("_row_id", "row_id")


def clean_by_status_log(spark, sf):
    log = clean_slices(replayed(spark, sf), DIRTY_TYPES, ["status"], KEY).log
    return log.withColumn("value", F.round(F.col("value").try_cast("double"), 4)).drop("ord")


QUERIES = {
    f.__name__: f
    for f in (
        fill_median, fill_mean, fill_mode, fill_unknown, fill_overrides, fill_protection, clean_table, clean_log,
        clean_group_mean, clean_by_status, clean_by_status_log,
    )
}

_FIRST = """firsts AS (SELECT min(_row_id) AS r FROM filled GROUP BY order_id, order_date),
  cleaned AS (SELECT * FROM filled WHERE _row_id IN (SELECT r FROM firsts))"""
_FILLED = """med AS (SELECT median(amount) AS m FROM typed), filled AS (SELECT _row_id, order_id,
  coalesce(priority, 'Unknown') AS priority, coalesce(amount, m) AS amount, order_date, status FROM typed, med)"""
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(lower(priority), '[a-z]+|[^a-z]+'), "
    "lambda x: upper(x[1]) || x[2:]), '')"
)

_BY_STATUS = f"""{sql_with(REPLAYED)}, med AS (SELECT status, median(amount) AS m FROM typed GROUP BY status),
  filled AS (SELECT _row_id, order_id, coalesce(priority, 'Unknown') AS priority, coalesce(amount, m) AS amount, order_date, t.status
    FROM typed t JOIN med ON t.status IS NOT DISTINCT FROM med.status),
  firsts AS (SELECT min(_row_id) AS r FROM filled GROUP BY status, order_id, order_date),
  cleaned AS (SELECT * FROM filled WHERE _row_id IN (SELECT r FROM firsts))"""

ORACLES = {
    "clean_by_status": f"{_BY_STATUS} SELECT _row_id AS row_id, * EXCLUDE (_row_id) FROM cleaned",
    "clean_by_status_log": f"""{_BY_STATUS}
        SELECT status, 'order_id' AS "column", 'protect' AS action, 0 AS n, NULL::DOUBLE AS value FROM med
        UNION ALL SELECT status, 'priority', 'fill', count(*), NULL FROM typed WHERE priority IS NULL GROUP BY status
        UNION ALL SELECT t.status, 'amount', 'fill', count(*), round(any_value(m), 4) FROM typed t JOIN med USING (status)
          WHERE amount IS NULL GROUP BY t.status
        UNION ALL SELECT status, 'order_date', 'keep_blank', count(*), NULL FROM typed WHERE order_date IS NULL GROUP BY status
        UNION ALL SELECT f.status, NULL, 'remove_duplicates', count(*) - (SELECT count(*) FROM cleaned c WHERE c.status = f.status), NULL
          FROM filled f GROUP BY f.status""",
    "fill_median": f"{sql_with()}, {_FILLED} SELECT _row_id AS row_id, amount FROM filled",
    "fill_mean": f"""{sql_with()} SELECT _row_id AS row_id,
        round(coalesce(amount, (SELECT avg(amount) FROM typed)), 4) AS amount FROM typed""",
    "fill_mode": f"""{sql_with()}, top AS (SELECT lower(priority) AS p FROM typed WHERE priority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT _row_id AS row_id, coalesce(lower(priority), (SELECT p FROM top)) AS priority, lower(status) AS status
        FROM typed""",
    "fill_unknown": f"{sql_with()}, {_FILLED} SELECT _row_id AS row_id, priority, order_date FROM filled",
    "fill_overrides": f"{sql_with()} SELECT _row_id AS row_id, priority, amount FROM typed",
    "fill_protection": """SELECT c_custkey AS row_id,
        CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS customer_id,
        CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name,
        CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE 'Unknown' END AS segment FROM customer
        QUALIFY row_number() OVER (PARTITION BY customer_id, name, segment ORDER BY c_custkey) = 1""",
    "clean_table": f"{sql_with(REPLAYED)}, {_FILLED}, {_FIRST} SELECT _row_id AS row_id, * EXCLUDE (_row_id) FROM cleaned",
    "clean_log": f"""{sql_with(REPLAYED)}, {_FILLED}, {_FIRST},
        nulls AS (SELECT count(*) FILTER (priority IS NULL) AS p, count(*) FILTER (amount IS NULL) AS a,
          count(*) FILTER (order_date IS NULL) AS d FROM typed),
        gone AS (SELECT (SELECT count(*) FROM filled) - (SELECT count(*) FROM cleaned) AS g)
        SELECT 1 AS ord, NULL AS "column", 'numeric_strategy' AS action, CAST(NULL AS BIGINT) AS n
        UNION ALL SELECT 2, NULL, 'categorical_strategy', NULL UNION ALL SELECT 3, NULL, 'duplicate_action', NULL
        UNION ALL SELECT 4, NULL, 'text_strategy', NULL UNION ALL SELECT 5, 'order_id', 'protect', 0
        UNION ALL SELECT 6, 'priority', 'fill', p FROM nulls UNION ALL SELECT 7, 'amount', 'fill', a FROM nulls
        UNION ALL SELECT 8, 'order_date', 'keep_blank', d FROM nulls UNION ALL SELECT 9, NULL, 'compare', NULL
        UNION ALL SELECT 10, NULL, 'remove_duplicates', g FROM gone""",
    "clean_group_mean": f"""{sql_with(REPLAYED)}, {_FILLED}, {_FIRST}
        SELECT {_TITLE} AS priority, round(avg(amount), 4) AS value FROM cleaned GROUP BY 1""",
}
