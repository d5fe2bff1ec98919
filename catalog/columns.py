"""Profile of the columns: types, missing and invalid values, identifiers, column classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile as p
from tablewright.operators.cardinality import column_rules, rules_table
from tablewright.operators.base import CATEGORICAL, DATE, NUMERIC, columns_of
from tablewright.operators.scoring import quality_metrics
from tablewright.operators.cleaning import clean
from tablewright.plans.runs import cleaning_impact as impact

from .inputs import (
    DIRTY_TYPES, REPLAYED, TEXTS, dirty, replayed, sql_date, sql_long, sql_number, sql_with, stacked, table,
)

KEY = ["order_id", "order_date"]


def _customer(spark, sf):
    return table(spark, sf, "customer").withColumn("_row_id", F.col("c_custkey"))


def _texts(df):
    """Rules on categorical columns read no others."""
    return df.select(*columns_of(df, CATEGORICAL))


def column_types(spark, sf):
    return p.column_types(dirty(spark, sf)).select(
        "column", "rows", "non_null", "numeric_ok", "date_ok", "detected_type"
    )


def column_types_by_status(spark, sf):
    return p.column_types(dirty(spark, sf), by=["status"]).select("status", "column", "rows", "detected_type")


def missing_counts(spark, sf):
    return p.missing_counts(replayed(spark, sf))


def invalid_numeric(spark, sf):
    return p.invalid_values(dirty(spark, sf), DIRTY_TYPES, NUMERIC, row_id="_row_id")


def invalid_dates(spark, sf):
    return p.invalid_values(dirty(spark, sf), DIRTY_TYPES, DATE, row_id="_row_id")


def invalid_counts(spark, sf):
    return p.invalid_counts(dirty(spark, sf), DIRTY_TYPES)


def issue_table(spark, sf):
    # Order keys read as dates: most are no date, which gives a column with very many distinct bad values.
    types = {"order_id": DATE, "amount": NUMERIC, "order_date": DATE}
    frame = dirty(spark, sf).select("_row_id", "order_id", "amount", "order_date")
    bad = stacked([p.invalid_values(frame, types, k, row_id="_row_id") for k in (NUMERIC, DATE)])
    return p.issue_table(bad)


def value_frequencies(spark, sf):
    return p.value_frequencies(dirty(spark, sf), ["priority", "status"], row_id="_row_id")


def id_columns(spark, sf):
    frames = []
    for name, row_id in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")):
        df = table(spark, sf, name).withColumn("_row_id", F.col(row_id))
        frames.append(p.profile_table(df).select(
            F.lit(name).alias("table_name"), "column", "distinct", "id_by_name", "id_by_sequence", "is_id"
        ))
    named = dirty(spark, sf)
    frames.append(p.profile_table(named).select(
        F.lit("dirty_orders").alias("table_name"), "column", "distinct", "id_by_name", "id_by_sequence", "is_id"
    ))
    return stacked(frames)


def high_cardinality(spark, sf):
    frames = [
        p.high_cardinality(p.profile_table(_texts(table(spark, sf, name)))).select(
            F.lit(name).alias("table_name"), "column", F.round("unique_ratio", 6).alias("unique_ratio"))
        for name in ("customer", "part", "documents", "orders")
    ]
    return stacked(frames)


def column_classes(spark, sf):
    return p.column_classes(p.profile_table(_customer(spark, sf))).select(
        "column", "detected_type", "is_id", "is_measure"
    )


def filterable_columns(spark, sf):
    frames = []
    for name in ("customer", "part", "lineitem", "events"):
        rules = rules_table(spark, column_rules(_texts(table(spark, sf, name))))
        frames.append(rules.filter("filterable").select(F.lit(name).alias("table_name"), "column", "distinct"))
    return stacked(frames)


def column_rules_decided(spark, sf):
    """What a sketch, an exact count of few values or a count along the rows decides, for every column."""
    frames = []
    for name, row_id in (("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey")):
        rules = rules_table(spark, column_rules(table(spark, sf, name).withColumn("_row_id", F.col(row_id))))
        frames.append(rules.select(
            F.lit(name).alias("table_name"), "column", "non_null", "filterable", "groupable", "high_cardinality", "id_by_name", "id_by_sequence",
        ))
    return stacked(frames)


def groupable_columns(spark, sf):
    frames = [
        p.groupable_columns(p.profile_table(table(spark, sf, name))).select(
            F.lit(name).alias("table_name"), "column", "distinct")
        for name in ("customer", "part", "lineitem", "nation", "supplier")
    ]
    return stacked(frames)


def dataset_shape(spark, sf):
    frames = [
        p.dataset_shape(table(spark, sf, name)).select(F.lit(name).alias("table_name"), "rows", "columns")
        for name in ("orders", "lineitem", "customer")
    ]
    return stacked(frames)


def validation_snapshot(spark, sf):
    return quality_metrics(replayed(spark, sf), DIRTY_TYPES, KEY)


def cleaning_impact(spark, sf):
    raw = replayed(spark, sf)
    return impact(raw, clean(raw, DIRTY_TYPES, KEY).rows, DIRTY_TYPES, KEY)


QUERIES = {
    f.__name__: f
    for f in (
        column_types, column_types_by_status, missing_counts, invalid_numeric, invalid_dates, invalid_counts,
        issue_table, value_frequencies, id_columns, high_cardinality, column_classes, filterable_columns,
        groupable_columns, dataset_shape, validation_snapshot, cleaning_impact, column_rules_decided,
    )
}

_NUM, _DATE = sql_number("v"), sql_date("v")
_EVIDENCE = f"""count(*) AS "rows", count(v) AS non_null, count({_NUM}) AS numeric_ok, count({_DATE}) AS date_ok"""
_KIND = """CASE WHEN non_null = 0 THEN 'Unknown' WHEN numeric_ok / non_null >= 0.8 THEN 'Numeric'
  WHEN date_ok / non_null >= 0.8 THEN 'Date' ELSE 'Categorical' END AS detected_type"""


def _sequence(table_name: str, key: str, c: str) -> str:
    return f"""(SELECT count(*) FILTER (v < u) = 0 OR count(*) FILTER (v > u) = 0 FROM
      (SELECT v, lag(v) OVER (ORDER BY k) AS u FROM (SELECT {key} AS k, CAST({c} AS DOUBLE) AS v FROM {table_name}
       WHERE {c} IS NOT NULL)))"""


def _ids(table_name: str, key: str, numbers, texts, source=None) -> str:
    """Identifier facts of one table; only whole-number columns can be sequences."""
    source = source or table_name
    parts = []
    for c in (*numbers, *texts):
        seq = "false"
        if c in numbers:
            seq = (
                f"(count(DISTINCT {c}) / count({c}) >= 0.98 AND count({c}) >= 5 AND "
                f"count(*) FILTER (CAST({c} AS DOUBLE) % 1 <> 0) = 0 AND {_sequence(source, key, c)})"
            )
        name = c.lower()
        named = str(name in ("id", "index") or name.endswith(("_id", " id", "_index"))).lower()
        parts.append(
            f"SELECT '{table_name}' AS table_name, '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", "
            f"({named} AND count(DISTINCT {c}) / count({c}) >= 0.8) AS id_by_name, {seq} AS id_by_sequence FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _distinct(table_name: str, names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table_name}' AS table_name, '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", "
        f"count({c}) AS n, count(*) AS total, {str(text).lower()} AS is_text FROM {table_name}"
        for c, text in names.items()
    )


_TABLES = {
    "customer": {"c_custkey": 0, "c_name": 1, "c_nationkey": 0, "c_acctbal": 0, "c_mktsegment": 1},
    "part": {"p_partkey": 0, "p_name": 1, "p_brand": 1, "p_type": 1, "p_size": 0, "p_retailprice": 0},
    "lineitem": {
        "l_orderkey": 0, "l_partkey": 0, "l_suppkey": 0, "l_linenumber": 0, "l_quantity": 0, "l_extendedprice": 0,
        "l_discount": 0, "l_tax": 0, "l_returnflag": 1, "l_linestatus": 1, "l_shipdate": 0,
    },
    "events": {"event_id": 0, "ts": 0, "user_id": 0, "event_type": 1, "value": 0, "props": 1},
    "documents": {"doc_id": 0, "text": 1, "lang": 1, "source": 1, "n_chars": 0},
    "orders": {"o_orderkey": 0, "o_custkey": 0, "o_orderstatus": 1, "o_totalprice": 0, "o_orderdate": 0,
               "o_orderpriority": 1},
    "nation": {"n_nationkey": 0, "n_name": 1, "n_regionkey": 0},
    "supplier": {"s_suppkey": 0, "s_name": 1, "s_nationkey": 0, "s_acctbal": 0},
}


def _tables(*names: str) -> str:
    return " UNION ALL ".join(_distinct(t, {c: bool(x) for c, x in _TABLES[t].items()}) for t in names)


_METRICS = f"""SELECT count(*) AS "rows",
    CAST(sum(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END + CASE WHEN priority IS NULL THEN 1 ELSE 0 END
      + CASE WHEN amount IS NULL THEN 1 ELSE 0 END + CASE WHEN order_date IS NULL THEN 1 ELSE 0 END
      + CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lower(order_id), lower(order_date) FROM norm)) AS BIGINT)
      AS duplicates,
    (SELECT count(DISTINCT amount) FROM norm WHERE {sql_number('amount')} IS NULL) AS invalid_numeric,
    (SELECT count(DISTINCT order_date) FROM norm WHERE {sql_date('order_date')} IS NULL) AS invalid_dates,
    5 AS "columns" FROM norm"""

ORACLES = {
    "column_types": f"""{sql_with()}, cells AS ({sql_long('norm')}),
        e AS (SELECT col AS "column", {_EVIDENCE} FROM cells GROUP BY col) SELECT *, {_KIND} FROM e""",
    "column_types_by_status": f"""{sql_with()}, cells AS ({sql_long('norm', TEXTS[:4])}),
        e AS (SELECT s.status, col AS "column", {_EVIDENCE} FROM cells JOIN raw s USING (_row_id)
        GROUP BY s.status, col) SELECT status, "column", "rows", {_KIND} FROM e""",
    "missing_counts": f"""{sql_with(REPLAYED)}, cells AS ({sql_long('norm')})
        SELECT col AS "column", count(*) AS missing FROM cells WHERE v IS NULL GROUP BY col""",
    "invalid_numeric": f"""{sql_with()}, cells AS ({sql_long('norm', ('order_id', 'amount'))})
        SELECT col AS "column", v AS value, count(*) AS n, min(_row_id) AS first_row FROM cells
        WHERE v IS NOT NULL AND {_NUM} IS NULL GROUP BY col, v""",
    "invalid_dates": f"""{sql_with()}, cells AS ({sql_long('norm', ('order_date',))})
        SELECT col AS "column", v AS value, count(*) AS n, min(_row_id) AS first_row FROM cells
        WHERE v IS NOT NULL AND {_DATE} IS NULL GROUP BY col, v""",
    "invalid_counts": f"""{sql_with()} SELECT
        (SELECT count(DISTINCT amount) FROM norm WHERE {sql_number('amount')} IS NULL) AS invalid_numeric_count,
        (SELECT count(DISTINCT order_date) FROM norm WHERE {sql_date('order_date')} IS NULL) AS invalid_date_count""",
    "issue_table": f"""{sql_with()}, cells AS ({sql_long('norm', ('order_id', 'amount', 'order_date'))}),
        bad AS (SELECT col, v, min(_row_id) AS first_row FROM cells WHERE v IS NOT NULL AND
          CASE WHEN col = 'amount' THEN {_NUM} IS NULL ELSE {_DATE} IS NULL END GROUP BY col, v),
        r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY first_row, v) AS k,
          count(*) OVER (PARTITION BY col) AS n FROM bad)
        SELECT col AS "column", string_agg(v, ', ' ORDER BY k) || CASE WHEN any_value(n) > 5 THEN ', ...' ELSE '' END
          AS preview, any_value(n) AS n FROM r WHERE k <= 5 GROUP BY col""",
    "value_frequencies": f"""{sql_with()}, cells AS ({sql_long('raw', ('priority', 'status'))})
        SELECT col AS "column", v AS value, count(*) AS n, min(_row_id) AS first_row FROM cells GROUP BY col, v""",
    "id_columns": f"""{sql_with()}, ids AS (
        {_ids('customer', 'c_custkey', ('c_custkey', 'c_nationkey', 'c_acctbal'), ('c_name', 'c_mktsegment'))}
        UNION ALL {_ids('orders', 'o_orderkey', ('o_orderkey', 'o_custkey', 'o_totalprice'),
                        ('o_orderstatus', 'o_orderdate', 'o_orderpriority'))}
        UNION ALL {_ids('part', 'p_partkey', ('p_partkey', 'p_size', 'p_retailprice'), ('p_name', 'p_brand', 'p_type'))}
        UNION ALL {_ids('dirty_orders', '_row_id', ('order_id',), ('priority', 'amount', 'order_date', 'status'), 'norm')})
        SELECT *, id_by_name OR id_by_sequence AS is_id FROM ids""",
    "high_cardinality": f"""SELECT table_name, "column", round("distinct" / n, 6) AS unique_ratio
        FROM ({_tables('customer', 'part', 'documents', 'orders')})
        WHERE is_text AND n >= 4 AND "distinct" / n >= 0.8""",
    "column_classes": f"""WITH ids AS (
        {_ids('customer', 'c_custkey', ('c_custkey', 'c_nationkey', 'c_acctbal'), ('c_name', 'c_mktsegment'))})
        SELECT "column", kind AS detected_type, id AS is_id, kind = 'Numeric' AND NOT id AS is_measure FROM
        (SELECT "column", CASE WHEN "column" IN ('c_name', 'c_mktsegment') THEN 'Categorical' ELSE 'Numeric' END AS kind,
         id_by_name OR id_by_sequence AS id FROM ids)""",
    "filterable_columns": f"""SELECT table_name, "column", "distinct"
        FROM ({_tables('customer', 'part', 'lineitem', 'events')}) WHERE is_text AND "distinct" BETWEEN 2 AND 25""",
    "groupable_columns": f"""SELECT table_name, "column", "distinct"
        FROM ({_tables('customer', 'part', 'lineitem', 'nation', 'supplier')})
        WHERE "distinct" BETWEEN 2 AND least(30, greatest(8, floor(total * 0.6))) OR (is_text AND n > 0)""",
    "column_rules_decided": f"""WITH ids AS (
        {_ids('customer', 'c_custkey', ('c_custkey', 'c_nationkey', 'c_acctbal'), ('c_name', 'c_mktsegment'))}
        UNION ALL {_ids('part', 'p_partkey', ('p_partkey', 'p_size', 'p_retailprice'), ('p_name', 'p_brand', 'p_type'))}
        UNION ALL {_ids('orders', 'o_orderkey', ('o_orderkey', 'o_custkey', 'o_totalprice'),
                        ('o_orderstatus', 'o_orderdate', 'o_orderpriority'))}
        UNION ALL {_ids('nation', 'n_nationkey', ('n_nationkey', 'n_regionkey'), ('n_name',))})
        SELECT table_name, "column", n AS non_null, is_text AND d."distinct" BETWEEN 2 AND 25 AS filterable,
          n > 0 AND (d."distinct" BETWEEN 2 AND least(30, greatest(8, floor(total * 0.6))) OR is_text) AS groupable,
          is_text AND n >= 4 AND d."distinct" / n >= 0.8 AS high_cardinality, id_by_name, id_by_sequence
        FROM ({_tables('customer', 'part', 'orders', 'nation')}) AS d JOIN ids USING (table_name, "column")""",
    "dataset_shape": """SELECT 'orders' AS table_name, count(*) AS "rows", 6 AS "columns" FROM orders
        UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'customer', count(*), 5 FROM customer""",
    "validation_snapshot": f"{sql_with(REPLAYED)} {_METRICS}",
    "cleaning_impact": f"""{sql_with(REPLAYED)}, before AS ({_METRICS}),
        first_rows AS (SELECT min(_row_id) AS r FROM typed GROUP BY order_id, order_date),
        kept AS (SELECT * FROM typed WHERE _row_id IN (SELECT r FROM first_rows)),
        after AS (SELECT count(*) FILTER (order_date IS NULL) AS missing FROM kept)
        SELECT 1 AS ord, 'missing cells' AS metric, b.missing AS before, a.missing AS after FROM before b, after a
        UNION ALL SELECT 2, 'duplicate rows', duplicates, 0 FROM before
        UNION ALL SELECT 3, 'invalid numeric values', invalid_numeric, 0 FROM before
        UNION ALL SELECT 4, 'invalid date values', invalid_dates, 0 FROM before""",
}
