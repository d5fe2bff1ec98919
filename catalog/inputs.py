"""Inputs shared by the queries: the driver tables, and irregular tables derived from all of their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import prepare

DIRTY_ORDERS = """
SELECT o_orderkey AS _row_id, CAST(o_orderkey AS STRING) AS order_id,
  CASE WHEN o_orderkey % 13 = 0 THEN concat('  ', lower(o_orderpriority), ' ')
       WHEN o_orderkey % 31 = 0 THEN ' N/A '
       WHEN o_orderkey % 37 = 0 THEN 'missing' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 17 = 0 THEN 'null'
       WHEN o_orderkey % 29 = 0 THEN 'pending'
       WHEN o_orderkey % 41 = 0 THEN concat('(', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ')')
       WHEN o_orderkey % 97 = 0 THEN concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) * 100 AS STRING))
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS amount,
  CASE WHEN o_orderkey % 19 = 0 THEN ''
       WHEN o_orderkey % 43 = 0 THEN 'invalid_date'
       WHEN o_orderkey % 47 = 0 THEN concat(CAST(month(o_orderdate) AS STRING), '/',
            CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
  o_orderstatus AS status
FROM {orders}"""

REPLAYED = f"""
SELECT * FROM ({DIRTY_ORDERS})
UNION ALL
SELECT _row_id + 100000000, order_id, upper(priority), amount, order_date, status
FROM ({DIRTY_ORDERS}) WHERE _row_id % 50 = 0"""

RAW_LINES = """
SELECT o_orderkey + 2 AS _line_no,
  CASE WHEN o_orderkey % 53 = 0 THEN ''
       WHEN o_orderkey % 59 = 0 THEN ' , , '
       WHEN o_orderkey % 7 = 0 THEN concat(CAST(o_orderkey AS STRING), ',', o_orderstatus)
       WHEN o_orderkey % 11 = 0 THEN
         concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',', o_orderpriority, ',extra')
       WHEN o_orderkey % 23 = 0 THEN
         concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',"', o_orderpriority, ', quoted"')
       ELSE concat(CAST(o_orderkey AS STRING), ',', o_orderstatus, ',', o_orderpriority) END AS line
FROM {orders}"""
RAW_HEADER = ["id", "status", "priority"]

REQUESTS = """
SELECT o_orderkey AS request_id, CASE o_orderkey % 12
  WHEN 0 THEN 'Which cells are EMPTY?' WHEN 1 THEN 'show repeat records'
  WHEN 2 THEN 'give me summary stats' WHEN 3 THEN 'compare the groups'
  WHEN 4 THEN 'heatmap please' WHEN 5 THEN 'histogram of the prices'
  WHEN 6 THEN 'any extreme points?' WHEN 7 THEN 'scatter of both'
  WHEN 8 THEN 'weekly trend' WHEN 9 THEN 'visualize the file'
  WHEN 10 THEN concat('tell me of o_orderstatus ', o_orderstatus) ELSE 'hello there' END AS request
FROM {orders}"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql, orders=table(spark, sf, "orders"))


def dirty(spark, sf) -> DataFrame:
    return derived(spark, sf, DIRTY_ORDERS)


def replayed(spark, sf) -> DataFrame:
    return derived(spark, sf, REPLAYED)


def duck(sql: str) -> str:
    """The same derivation for the SQL side, where the tables are views."""
    return sql.replace("{orders}", "orders")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round sums and moments, whose last digits depend on the order of rows."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def stacked(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- pieces of SQL for the other side -----------------------------------------------------------------------

TOKENS = "('', 'na', 'n/a', 'null', 'none', 'nan', 'nat', 'missing')"
TEXTS = ("order_id", "priority", "amount", "order_date", "status")


def sql_norm(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {TOKENS} THEN trim({c}) END"


def sql_number(c: str) -> str:
    x = rf"regexp_replace(replace(replace({c}, ',', ''), '$', ''), '^\((.*)\)$', '-\1')"
    return (
        rf"CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
        rf"THEN TRY_CAST({x} AS DOUBLE) END"
    )


def sql_date(c: str) -> str:
    return (
        f"coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y'), "
        f"CASE WHEN regexp_full_match({c}, '[0-9]{{4}}') THEN make_timestamp(CAST({c} AS BIGINT), 1, 1, 0, 0, 0) END)"
    )


def sql_with(source: str = DIRTY_ORDERS) -> str:
    """CTEs: the raw table, its normalised texts, and the typed table."""
    norm = ", ".join(f"{sql_norm(c)} AS {c}" for c in TEXTS)
    return f"""WITH raw AS ({duck(source)}),
norm AS (SELECT _row_id, {norm} FROM raw),
typed AS (SELECT _row_id, {sql_number('order_id')} AS order_id, priority, {sql_number('amount')} AS amount,
  {sql_date('order_date')} AS order_date, status FROM norm)"""


def sql_long(source: str, names=TEXTS) -> str:
    parts = [f"SELECT _row_id, {i} AS ord, '{c}' AS col, {c} AS v FROM {source}" for i, c in enumerate(names)]
    return " UNION ALL ".join(parts)


DIRTY_TYPES = {
    "order_id": "Numeric", "priority": "Categorical", "amount": "Numeric", "order_date": "Date",
    "status": "Categorical",
}
