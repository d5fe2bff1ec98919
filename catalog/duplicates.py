"""Repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import duplicates as d
from tablewright.operators.profile import profile_table

from .inputs import DIRTY_TYPES, REPLAYED, TEXTS, replayed, rounded, sql_with, stacked, table

KEY = ["order_id", "priority"]


def dup_compare(spark, sf):
    return d.compare_columns(replayed(spark, sf)).withColumnRenamed("_row_id", "row_id")


def dup_count(spark, sf):
    """Whole rows, a two-column key, and one whose single values each fill a fifth of the table."""
    df = replayed(spark, sf)
    return stacked([
        d.duplicate_count(df, subset).select(F.lit(name).alias("rule"), "duplicate_count")
        for name, subset in (("rows", None), ("key", KEY), ("priority", ["priority"]))
    ])


def dup_count_by_status(spark, sf):
    return d.duplicate_count(replayed(spark, sf), ["priority", "order_date"], by=["status"])


def dup_rows(spark, sf):
    return d.duplicate_rows(replayed(spark, sf)).withColumnRenamed("_row_id", "row_id")


def dup_rows_hot_key(spark, sf):
    """Members of a coarse key, spread by salt: every one of its values is hot."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return d.duplicate_rows(df, ["o_orderstatus", "o_orderpriority"], hot_rows=2)


def dedup_first(spark, sf):
    return d.drop_repeats(replayed(spark, sf)).withColumnRenamed("_row_id", "row_id")


def dup_key_scores(spark, sf):
    scores = d.key_scores(profile_table(replayed(spark, sf), DIRTY_TYPES))
    return rounded(scores, {"unique_ratio": 6, "score": 6})


def dup_key_suggest(spark, sf):
    profile = profile_table(replayed(spark, sf), DIRTY_TYPES)
    names = d.suggest_key(profile) or []
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(names)], "ord int, column string")


def dup_rule(spark, sf):
    df = replayed(spark, sf)
    rules = {
        "rows": None, "weak": ["status"], "usable": KEY, "coarse": ["status", "priority"],
        "unknown": ["no_such_column"], "sparse": ["order_id", "priority", "_row_id"],
    }
    out = stacked([d.key_diagnostics(df, s).withColumn("rule", F.lit(n)) for n, s in rules.items()])
    return rounded(out.drop("detail", "assumptions"), {"completeness_ratio": 6, "unique_record_ratio": 6})


def dup_documents(spark, sf):
    """Copies of whole texts: how many documents share each repeated text."""
    members = d.duplicate_rows(table(spark, sf, "documents"), ["text"])
    return members.select("doc_id", "lang", "n_chars")


def dedup_documents(spark, sf):
    return d.drop_repeats(table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id", "lang", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        dup_compare, dup_count, dup_count_by_status, dup_rows, dup_rows_hot_key, dedup_first, dup_key_scores,
        dup_key_suggest, dup_rule, dup_documents, dedup_documents,
    )
}

_CMP = "cmp AS (SELECT _row_id, " + ", ".join(f"lower({c}) AS {c}" for c in TEXTS) + " FROM norm)"
_ALL = ", ".join(TEXTS)
_TEXT_KEY = (
    "CASE WHEN lower(trim(text)) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan', 'nat', 'missing') "
    "THEN lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END"
)


def _rule(name: str, mode: str, cols: str | None, status: str) -> str:
    where = "TRUE" if not cols else " AND ".join(f"{c.strip()} IS NOT NULL" for c in cols.split(","))
    keys = cols or _ALL
    return f"""SELECT '{name}' AS rule, '{mode}' AS mode, (SELECT count(*) FROM cmp) AS total_rows,
      CAST(sum(n) AS BIGINT) AS complete_rows,
      CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_row_count,
      count(*) FILTER (n > 1) AS duplicate_group_count,
      round(sum(n) / (SELECT count(*) FROM cmp), 6) AS completeness_ratio,
      round(count(*) / sum(n), 6) AS unique_record_ratio, {status} AS status
      FROM (SELECT count(*) AS n FROM cmp WHERE {where} GROUP BY {keys})"""


_SUBSET_STATUS = """CASE WHEN sum(n) / (SELECT count(*) FROM cmp) < 0.65 THEN 'Weak'
  WHEN count(*) / sum(n) < 0.2 THEN 'Weak' WHEN count(*) FILTER (n > 1) = 0 THEN 'Sparse' ELSE 'Usable' END"""

_SCORES = f"""scores AS (
  SELECT col AS "column", kind AS detected_type, u AS unique_ratio,
    u + CASE kind WHEN 'Date' THEN 0.3::DOUBLE WHEN 'Numeric' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END
      - CASE WHEN u < 0.2 THEN 0.4::DOUBLE WHEN u < 0.4 THEN 0.2::DOUBLE ELSE 0 END AS score
  FROM (SELECT col, kind, count(DISTINCT lower(v)) / count(v) AS u, count(DISTINCT v) / count(v) AS cased,
          count(v) AS n, count(DISTINCT lower(v)) AS dv FROM (
    SELECT 'priority' AS col, 'Categorical' AS kind, priority AS v FROM norm
    UNION ALL SELECT 'amount', 'Numeric', amount FROM norm
    UNION ALL SELECT 'order_date', 'Date', order_date FROM norm
    UNION ALL SELECT 'status', 'Categorical', status FROM norm) GROUP BY col, kind)
  WHERE dv < n)"""

ORACLES = {
    "dup_compare": f"{sql_with(REPLAYED)}, {_CMP} SELECT _row_id AS row_id, * EXCLUDE (_row_id) FROM cmp",
    "dup_count": f"""{sql_with(REPLAYED)}, {_CMP}
        SELECT 'rows' AS rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count
          FROM (SELECT count(*) AS n FROM cmp GROUP BY {_ALL})
        UNION ALL SELECT 'key', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM cmp GROUP BY order_id, priority)
        UNION ALL SELECT 'priority', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM cmp GROUP BY priority)""",
    "dup_count_by_status": f"""{sql_with(REPLAYED)}, {_CMP}
        SELECT upper(status) AS status, CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM
        (SELECT status, count(*) AS n FROM cmp GROUP BY status, priority, order_date) GROUP BY status""",
    "dup_rows": f"""{sql_with(REPLAYED)}, {_CMP}, m AS (
        SELECT _row_id, count(*) OVER (PARTITION BY {_ALL}) AS n FROM cmp)
        SELECT raw._row_id AS row_id, raw.* EXCLUDE (_row_id) FROM raw JOIN m USING (_row_id) WHERE n > 1""",
    "dup_rows_hot_key": """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *,
        count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders) WHERE n > 1""",
    "dedup_first": f"""{sql_with(REPLAYED)}, {_CMP}, f AS (SELECT min(_row_id) AS r FROM cmp GROUP BY {_ALL})
        SELECT _row_id AS row_id, raw.* EXCLUDE (_row_id) FROM raw WHERE _row_id IN (SELECT r FROM f)""",
    "dup_key_scores": f"""{sql_with(REPLAYED)}, {_SCORES}
        SELECT "column", detected_type, round(unique_ratio, 6) AS unique_ratio, round(score, 6) AS score FROM scores""",
    "dup_key_suggest": f"""{sql_with(REPLAYED)}, {_SCORES}
        SELECT CAST(row_number() OVER (ORDER BY score DESC, "column" DESC) AS INTEGER) AS ord, "column" FROM
        (SELECT *, count(*) OVER () AS total FROM (SELECT * FROM scores WHERE score > 0
          ORDER BY score DESC, "column" DESC LIMIT 4)) WHERE total >= 2""",
    "dup_rule": f"""{sql_with(REPLAYED)}, {_CMP}
        {_rule('rows', 'exact', None, "'Conservative'")}
        UNION ALL {_rule('weak', 'column_subset', 'status', "'Weak'")}
        UNION ALL {_rule('usable', 'column_subset', 'order_id, priority', _SUBSET_STATUS)}
        UNION ALL {_rule('coarse', 'column_subset', 'status, priority', _SUBSET_STATUS)}
        UNION ALL SELECT 'unknown', 'column_subset', 0, 0, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE, 'Unavailable'
        UNION ALL {_rule('sparse', 'column_subset', 'order_id, priority, _row_id', _SUBSET_STATUS)}""",
    "dup_documents": f"""SELECT doc_id, lang, n_chars FROM (SELECT *,
        count(*) OVER (PARTITION BY {_TEXT_KEY}) AS n FROM documents) WHERE n > 1""",
    "dedup_documents": f"""SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN
        (SELECT min(doc_id) FROM documents GROUP BY {_TEXT_KEY})""",
}
