"""Column choice, segment gaps and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import selection as sel
from tablewright.operators import signals as sg
from tablewright.operators.profile import collect_profile, profile_table
from tablewright.operators.statistics import numeric_summary, outlier_summary, strongest_correlation, correlation_pairs

from .inputs import rounded, stacked, table
from .statistics import MEASURES

_GAP = {"top_value": 4, "bottom_value": 4, "effect_size": 6}
_TREND = {"first_value": 4, "last_value": 4, "coverage": 6}


def segment_gap(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(sg.segment_gap(df, "l_returnflag", "l_extendedprice").drop("reason"), _GAP)


def segment_gap_small(spark, sf):
    """Few rows per group: suppliers by nation, where labels depend on group sizes."""
    df = table(spark, sf, "supplier").withColumn("nation", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    return rounded(sg.segment_gap(df, "nation", "s_acctbal").drop("reason"), _GAP)


def segment_gap_by_status(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(sg.segment_gap(df, "o_orderpriority", "o_totalprice", ["o_orderstatus"]).drop("reason"), _GAP)


def time_series(spark, sf):
    days = table(spark, sf, "events").withColumn("day", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
    return rounded(sg.time_series(days, "day", "value"), {"value": 4})


def time_series_columns(spark, sf):
    """The time and value columns a trend would use."""
    df = table(spark, sf, "orders").withColumn("_row_id", F.col("o_orderkey"))
    profile = profile_table(df)
    value = sel.choose_value(df, profile, collect_profile(profile))
    time, axis = sel.choose_time(df, profile, exclude={value})
    return rounded(sg.trend(df, time, value, axis).drop("reason"), _TREND)


def trend(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(sg.trend(df, "o_orderdate", "o_totalprice").drop("reason"), _TREND)


def trend_by_status(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(sg.trend(df, "o_orderdate", "o_totalprice", by=["o_orderstatus"]).drop("reason"), _TREND)


def trend_numeric_axis(spark, sf):
    """Years as numbers, with gaps in time and value."""
    df = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate")).alias("year"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
    )
    return rounded(sg.trend(df, "year", "price", sg.NUMERIC_AXIS).drop("reason"), _TREND)


def time_axis(spark, sf):
    df = table(spark, sf, "orders").withColumn("day_text", F.date_format("o_orderdate", "M/d/yyyy"))
    out = sg.time_axis_evidence(df, ["o_orderdate", "day_text", "o_orderpriority", "o_custkey"])
    return rounded(out, {"coverage": 6})


def _numbered(lines):
    return lines.withColumn("_row_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


def time_axis_choice(spark, sf):
    df = _numbered(table(spark, sf, "lineitem"))
    return rounded(sel.time_axis_ranking(df, profile_table(df), {"l_quantity"}), {"coverage": 6})


def category_choice(spark, sf):
    return sel.category_ranking(profile_table(_numbered(table(spark, sf, "lineitem"))))


def numeric_choice(spark, sf):
    df = table(spark, sf, "customer").withColumn("_row_id", F.col("c_custkey"))
    return rounded(sel.numeric_ranking(df, profile_table(df)).select("column", "is_id", "count", "std"), {"std": 4})


def scatter_choice(spark, sf):
    df = _numbered(table(spark, sf, "lineitem"))
    pair = sel.choose_pair(df.select(*MEASURES), collect_profile(profile_table(df.select("_row_id", *MEASURES))))
    return stacked([
        df.agg(F.lit(i + 1).alias("ord"), F.lit(c).alias("column"), F.count(c).alias("n")) for i, c in enumerate(pair)
    ])


def analysis_report(spark, sf):
    """The parts of a report in one long table: shape, summary, correlation, outliers, segment, trend."""
    df = table(spark, sf, "orders")
    measures = ["o_totalprice", "o_custkey"]

    def long(part, frame, name, value):
        return frame.select(F.lit(part).alias("part"), name.alias("name"), F.round(value.cast("double"), 4).alias("value"))

    gap = sg.segment_gap(df, "o_orderpriority", "o_totalprice")
    moved = sg.trend(df, "o_orderdate", "o_totalprice")
    best = strongest_correlation(correlation_pairs(df, measures))
    summary = numeric_summary(df, measures)
    return stacked([
        long("mean", summary, F.col("column"), F.col("mean")),
        long("median", summary, F.col("column"), F.col("p50")),
        long("outliers", outlier_summary(df, measures), F.col("column"), F.col("outliers")),
        long("correlation", best, F.concat_ws("/", "column_a", "column_b"), F.col("r")),
        long("segment", gap, F.concat_ws("/", "top_label", "bottom_label"), F.col("top_value") - F.col("bottom_value")),
        long("trend", moved, F.col("direction"), F.col("last_value") - F.col("first_value")),
    ])


QUERIES = {
    f.__name__: f
    for f in (
        segment_gap, segment_gap_small, segment_gap_by_status, time_series, time_series_columns, trend,
        trend_by_status, trend_numeric_axis, time_axis, time_axis_choice, category_choice, numeric_choice,
        scatter_choice, analysis_report,
    )
}


def sql_gap(source: str, category: str, value: str, by: str = "", digits: bool = True) -> str:
    pick = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    r = (lambda x, d: f"round({x}, {d})") if digits else (lambda x, d: x)
    return f"""(WITH g AS (SELECT {pick}{category} AS l, count(*) AS n, avg({value}) AS m, stddev_samp({value}) AS sd
        FROM {source} WHERE {category} IS NOT NULL AND {value} IS NOT NULL GROUP BY {pick}{category} HAVING count(*) >= 2),
      o AS (SELECT *, row_number() OVER ({part} ORDER BY m DESC, l) AS k,
        row_number() OVER ({part} ORDER BY m, l DESC) AS kb FROM g),
      e AS (SELECT {pick}count(*) AS group_count, max(l) FILTER (k = 1) AS tl, max(m) FILTER (k = 1) AS tm,
        max(sd) FILTER (k = 1) AS ts, max(n) FILTER (k = 1) AS tn, max(l) FILTER (kb = 1) AS bl,
        max(m) FILTER (kb = 1) AS bm, max(sd) FILTER (kb = 1) AS bs, max(n) FILTER (kb = 1) AS bn FROM o {group}),
      d AS (SELECT *, least(tn, bn) AS small, CASE WHEN coalesce(ts, 0) = 0 AND coalesce(bs, 0) = 0 THEN 0
        ELSE (tm - bm) / sqrt((ts * ts + bs * bs) / 2) END AS d FROM e WHERE group_count >= 2)
      SELECT {pick}'{category}' AS category_column, '{value}' AS numeric_column, tl AS top_label,
        {r('tm', 4)} AS top_value, bl AS bottom_label, {r('bm', 4)} AS bottom_value, group_count,
        small AS min_group_size, {r('d', 6)} AS effect_size, CASE WHEN small < 2 THEN 'Insufficient'
        WHEN small < 5 OR abs(d) < 0.6 THEN 'Directional' ELSE 'Supported' END AS support FROM d)"""


def sql_trend(source: str, t: str, v: str, axis: str = "datetime", by: str = "", digits: bool = True) -> str:
    pick = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    label = f"strftime({{}}, '%Y-%m-%d')" if axis == "datetime" else "CAST(CAST({} AS BIGINT) AS VARCHAR)"
    r = (lambda x, d: f"round({x}, {d})") if digits else (lambda x, d: x)
    return f"""(WITH p AS (SELECT {pick}CASE WHEN {v} IS NOT NULL THEN {t} END AS t, avg({v}) AS m, count(*) AS n
        FROM {source} GROUP BY {pick}CASE WHEN {v} IS NOT NULL THEN {t} END),
      e AS (SELECT {pick}min_by(m, t) AS f, max_by(m, t) AS l, min(t) AS a, max(t) AS b, count(t) AS periods,
        CAST(coalesce(sum(n) FILTER (t IS NOT NULL), 0) AS BIGINT) AS sample, sum(n) AS total FROM p {group})
      SELECT {pick}'{t}' AS time_column, '{v}' AS value_column, '{axis}' AS axis_kind, {r('f', 4)} AS first_value,
        {r('l', 4)} AS last_value, CASE WHEN l > f THEN 'upward' WHEN l < f THEN 'downward' ELSE 'flat' END AS direction,
        {label.format('a')} AS start_label, {label.format('b')} AS end_label, sample AS sample_size,
        periods AS distinct_periods, {r('sample / total', 6)} AS coverage,
        CASE WHEN sample < 4 OR periods < 3 THEN 'Insufficient' WHEN periods < 7 OR sample / total < 0.65
        THEN 'Directional' ELSE 'Supported' END AS support FROM e WHERE periods > 0)"""


def _axis(c: str, expr: str, axis: str) -> str:
    span = "epoch(max(t) - min(t))" if axis == "datetime" else "CAST(max(t) - min(t) AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", '{axis}' AS axis, count(*) AS "rows", count(t) AS valid,
      count(DISTINCT t) AS periods, CAST({span} AS DOUBLE) AS span, round(count(t) / count(*), 6) AS coverage
      FROM (SELECT {expr} AS t FROM orders)"""


ORACLES = {
    "segment_gap": f"SELECT * FROM {sql_gap('lineitem', 'l_returnflag', 'l_extendedprice')}",
    "segment_gap_small": f"""WITH s AS (SELECT *, 'N' || s_nationkey AS nation FROM supplier)
        SELECT * FROM {sql_gap('s', 'nation', 's_acctbal')}""",
    "segment_gap_by_status": f"SELECT * FROM {sql_gap('orders', 'o_orderpriority', 'o_totalprice', 'o_orderstatus')}",
    "time_series": """SELECT date_trunc('day', ts)::TIMESTAMP AS t, round(avg(value), 4) AS value, count(*) AS n
        FROM events GROUP BY 1""",
    "time_series_columns": f"SELECT * FROM {sql_trend('orders', 'o_orderdate', 'o_totalprice')}",
    "trend": f"SELECT * FROM {sql_trend('orders', 'o_orderdate', 'o_totalprice')}",
    "trend_by_status": f"SELECT * FROM {sql_trend('orders', 'o_orderdate', 'o_totalprice', by='o_orderstatus')}",
    "trend_numeric_axis": f"""WITH y AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END AS year,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)
        SELECT * FROM {sql_trend('y', 'year', 'price', 'numeric')}""",
    "time_axis": f"""{_axis('o_orderdate', 'o_orderdate', 'datetime')}
        UNION ALL {_axis('day_text', 'o_orderdate', 'datetime')} UNION ALL {_axis('o_custkey', 'o_custkey', 'numeric')}""",
    "time_axis_choice": """WITH c AS (
        SELECT 'l_shipdate' AS "column", 'datetime' AS axis, count(DISTINCT l_shipdate) AS periods,
          CAST(epoch(max(l_shipdate) - min(l_shipdate)) AS DOUBLE) AS span FROM lineitem
        UNION ALL SELECT 'l_linenumber', 'numeric', count(DISTINCT l_linenumber),
          CAST(max(l_linenumber) - min(l_linenumber) AS DOUBLE) FROM lineitem
        UNION ALL SELECT 'l_discount', 'numeric', count(DISTINCT l_discount + 0.0::DOUBLE),
          max(l_discount) - min(l_discount) FROM lineitem
        UNION ALL SELECT 'l_tax', 'numeric', count(DISTINCT l_tax + 0.0::DOUBLE), max(l_tax) - min(l_tax) FROM lineitem)
        SELECT "column", axis, periods, 1.0::DOUBLE AS coverage, span FROM c""",
    "category_choice": """SELECT 'l_returnflag' AS "column", count(*) - count(DISTINCT l_returnflag) AS score FROM lineitem
        UNION ALL SELECT 'l_linestatus', count(*) - count(DISTINCT l_linestatus) FROM lineitem""",
    "numeric_choice": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS is_id, count({c}) AS "count", round(stddev_samp({c}), 4) AS std FROM customer"""
        for c, i in (("c_custkey", "true"), ("c_nationkey", "false"), ("c_acctbal", "false"))
    ),
    "scatter_choice": f"""WITH p AS ({' UNION ALL '.join(
        f"SELECT {i} AS k, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM lineitem"
        for i, (a, b) in enumerate(
            (x, y) for j, x in enumerate(MEASURES) for y in MEASURES[j + 1:]))}),
        best AS (SELECT * FROM p ORDER BY r DESC, k LIMIT 1)
        SELECT 1 AS ord, a AS "column", (SELECT count(*) FROM lineitem) AS n FROM best
        UNION ALL SELECT 2, b, (SELECT count(*) FROM lineitem) FROM best""",
    "analysis_report": f"""WITH g AS (SELECT * FROM {sql_gap('orders', 'o_orderpriority', 'o_totalprice', digits=False)}),
        t AS (SELECT * FROM {sql_trend('orders', 'o_orderdate', 'o_totalprice', digits=False)}),
        b AS (SELECT c, v FROM (SELECT 'o_totalprice' AS c, o_totalprice AS v FROM orders
              UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders)),
        f AS (SELECT c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY c)
        SELECT 'mean' AS part, c AS name, round(avg(v), 4) AS value FROM b GROUP BY c
        UNION ALL SELECT 'median', c, round(median(v), 4) FROM b GROUP BY c
        UNION ALL SELECT 'outliers', c, CAST(count(*) AS DOUBLE) FROM b JOIN f USING (c)
          WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY c
        UNION ALL SELECT 'correlation', 'o_totalprice/o_custkey', round(corr(o_totalprice, o_custkey), 4) FROM orders
        UNION ALL SELECT 'segment', top_label || '/' || bottom_label, round(top_value - bottom_value, 4) FROM g
        UNION ALL SELECT 'trend', direction, round(last_value - first_value, 4) FROM t""",
}
