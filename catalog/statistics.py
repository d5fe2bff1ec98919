"""Summaries, correlation, outliers, grouped metrics and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import statistics as st
from tablewright.operators.base import normalise
from tablewright.operators.quantiles import bracketed_quantiles, number_columns
from tablewright.plans.answers import chart_data, display_histogram

from .inputs import dirty, rounded, sql_norm, sql_with, stacked, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Prices with a tail, derived from every order: the spread differs by status.
TAILED = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 10 ELSE o_totalprice END"


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _tailed(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                                             F.expr(TAILED).alias("price"))


_SUMMARY = {"mean": 4, "std": 4, "p25": 6, "p50": 6, "p75": 6}


def numeric_summary(spark, sf):
    return rounded(st.numeric_summary(_lines(spark, sf), MEASURES), _SUMMARY)


def numeric_summary_by_flag(spark, sf):
    return rounded(st.numeric_summary(_lines(spark, sf), MEASURES, by=["l_returnflag"]), _SUMMARY)


def quantiles_narrowed(spark, sf):
    """Quartiles by repeated narrowing, the way taken when a column has too many distinct values."""
    numbers = number_columns(_lines(spark, sf), MEASURES, ["l_returnflag"])
    out = bracketed_quantiles(numbers, MEASURES, (0.25, 0.5, 0.75), ["l_returnflag"])
    parts = [F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return out.select("l_returnflag", "column", "n", *parts)


def top_values(spark, sf):
    return st.top_values(normalise(dirty(spark, sf)), ["priority", "status", "amount"], 5)


def correlation_matrix(spark, sf):
    return rounded(st.correlation_matrix(_lines(spark, sf), MEASURES), {"r": 6})


def correlation_pairs(spark, sf):
    """Pairs with gaps: only rows with both cells count, and a constant column has no correlation."""
    df = _lines(spark, sf).select(
        F.expr("CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END").alias("a"),
        F.expr("CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice END").alias("b"),
        F.expr("l_discount").alias("c"), F.lit(1.0).alias("d"),
    )
    return rounded(st.correlation_pairs(df), {"r": 6})


# Thirty columns made of all lines, with gaps in different rows: 435 pairs.
WIDE = {
    f"w{k}": f"CASE WHEN (l_orderkey * 31 + l_linenumber * 17 + {13 * k}) % 5 <> 0 "
    f"THEN l_quantity * {k % 4 + 1} + l_extendedprice / 1000 * {k % 3} + (l_partkey * {k + 1}) % 97 + {10 ** (k % 9)} END"
    for k in range(29)
} | {"same": "CASE WHEN l_linenumber > 1 THEN 3.5 END"}


def correlation_wide(spark, sf):
    """All pairs of a wide table from one scan; the pairs with the constant column have no correlation."""
    df = table(spark, sf, "lineitem").select(*[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in WIDE.items()])
    return rounded(st.correlation_pairs(df), {"r": 6})


def strongest_correlation(spark, sf):
    pairs = st.correlation_pairs(_lines(spark, sf), MEASURES)
    return rounded(st.strongest_correlation(pairs).drop("reason"), {"r": 6})


def strongest_by_status(spark, sf):
    df = _tailed(spark, sf).withColumn("half", F.col("o_totalprice") / 2 + F.col("o_orderkey") % 1000)
    pairs = st.correlation_pairs(df, ["o_totalprice", "price", "half"], ["o_orderstatus"])
    return rounded(st.strongest_correlation(pairs, ["o_orderstatus"]).drop("reason"), {"r": 6})


_OUTLIERS = {"share": 6, "lower_bound": 6, "upper_bound": 6, "median": 6, "max": 6}


def outliers(spark, sf):
    return rounded(st.outlier_summary(_tailed(spark, sf), ["o_totalprice", "price"]), _OUTLIERS)


def outliers_by_status(spark, sf):
    return rounded(st.outlier_summary(_tailed(spark, sf), ["price"], ["o_orderstatus"]), _OUTLIERS)


def outlier_table(spark, sf):
    return st.outlier_table(st.outlier_summary(_tailed(spark, sf), ["o_totalprice", "price"]))


def heaviest_outlier(spark, sf):
    found = st.outlier_summary(_tailed(spark, sf), ["o_totalprice", "price"])
    return rounded(st.heaviest_outlier(found), {"share": 6})


def group_count(spark, sf):
    return st.grouped_metric(normalise(dirty(spark, sf)), "priority", sort="descending", top_n=8)


def _metric(agg, sort, digits=4):
    def query(spark, sf):
        out = st.grouped_metric(_lines(spark, sf), "l_returnflag", "l_extendedprice", agg, sort=sort)
        return rounded(out, {"value": digits})

    return query


def group_natural(spark, sf):
    """Sizes in numeric order, although they are shown as text."""
    out = st.grouped_metric(table(spark, sf, "part"), "p_size", "p_retailprice", "mean", 20, "natural")
    return rounded(out, {"value": 4})


def group_by_date(spark, sf):
    out = st.grouped_metric(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", 30, "natural")
    return rounded(out, {"value": 2})


def top_categories(spark, sf):
    return st.category_frequency(normalise(dirty(spark, sf)), "priority", 10, include_null=True)


def histogram(spark, sf):
    return rounded(st.histogram(_lines(spark, sf), "l_extendedprice"), {"low": 4, "high": 4, "median": 4})


def histogram_display(spark, sf):
    """A column with outliers is clipped to its first and last percentile for display."""
    return rounded(display_histogram(_tailed(spark, sf), "price"), {"low": 4, "high": 4, "median": 4})


def box_stats(spark, sf):
    df = _tailed(spark, sf)
    return rounded(st.box_stats(df, ["price"]), {"q1": 4, "median": 4, "q3": 4, "whisker_low": 4, "whisker_high": 4})


def box_by_group(spark, sf):
    out = st.box_by_group(_tailed(spark, sf), "o_orderpriority", "price", 4)
    return rounded(out, {"q1": 4, "median": 4, "q3": 4, "whisker_low": 4, "whisker_high": 4})


def scatter_points(spark, sf):
    df = dirty(spark, sf)
    return st.pair_points(df, "order_id", "amount")


def completeness(spark, sf):
    return rounded(st.completeness(normalise(dirty(spark, sf))), {"completeness": 6})


def completeness_by_status(spark, sf):
    out = st.completeness(normalise(dirty(spark, sf)), ["status"])
    return rounded(out, {"completeness": 6})


def leading_share(spark, sf):
    top = st.top_values(normalise(dirty(spark, sf)), ["priority", "status"], 5)
    return rounded(st.leading_share(top), {"share": 6})


def widest_columns(spark, sf):
    """The column with the largest deviation and the one with the largest range."""
    summary = st.moments(_lines(spark, sf), MEASURES)
    spread, width = st.widest_spread(summary), st.widest_range(summary)
    return stacked([
        spread.select(F.lit("spread").alias("kind"), "column", F.round("std", 4).alias("size")),
        width.select(F.lit("range").alias("kind"), "column", F.round("range", 4).alias("size")),
    ])


def chart_bar(spark, sf):
    df = _lines(spark, sf)
    return rounded(chart_data("bar", df, group="l_shipdate", value="l_quantity", agg="sum", top_n=12), {"value": 2})


def chart_line(spark, sf):
    return rounded(chart_data("line", _lines(spark, sf), x="l_quantity", value="l_extendedprice"), {"value": 4})


QUERIES = {
    f.__name__: f
    for f in (
        numeric_summary, numeric_summary_by_flag, quantiles_narrowed, top_values, correlation_matrix,
        correlation_pairs, correlation_wide, strongest_correlation, strongest_by_status, outliers, outliers_by_status, outlier_table,
        heaviest_outlier, group_count, group_natural, group_by_date, top_categories, histogram, histogram_display,
        box_stats, box_by_group, scatter_points, completeness, completeness_by_status, leading_share, widest_columns,
        chart_bar, chart_line,
    )
} | {
    "group_sum": _metric("sum", "descending", 2), "group_mean": _metric("mean", "ascending"),
    "group_median": _metric("median", "natural"), "group_min": _metric("min", "descending"),
    "group_max": _metric("max", "ascending"),
}


def _summary(source: str, by: str = "") -> str:
    pick = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"""SELECT {pick}'{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c}) + 0.0::DOUBLE AS "min", round(quantile_cont({c}, 0.25), 6) AS p25,
        round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS "max"
        FROM {source}{group}"""
        for c in MEASURES
    )


def _pairs(names, source: str) -> str:
    from itertools import combinations

    return " UNION ALL ".join(
        f"SELECT {i} AS pair_ord, '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"
        for i, (a, b) in enumerate(combinations(names, 2))
    )


_SUPPORT = """CASE WHEN n < 5 THEN 'Insufficient' WHEN n < 8 THEN 'Directional' WHEN abs(r) < 0.2 THEN 'Weak'
  WHEN n < 15 OR abs(r) < 0.35 THEN 'Directional' ELSE 'Supported' END AS support,
  CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
  WHEN abs(r) >= 0.2 THEN 'light' ELSE 'weak' END AS strength"""
_TAIL = f"tailed AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, {TAILED} AS price FROM orders)"


def _outliers(c: str, by: str = "") -> str:
    pick, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    join = f"JOIN b USING ({by})" if by else ", b"
    return f"""SELECT {pick}'{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outliers,
      count(*) FILTER ({c} < lo OR {c} > hi) / count({c}) AS share, any_value(lo) AS lower_bound,
      any_value(hi) AS upper_bound, median({c}) AS median, max({c}) AS "max", count({c}) AS n
      FROM tailed {join.replace('b', f'''(SELECT {pick}q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT {pick}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM tailed{group}))''', 1)
      if not by else f'''JOIN (SELECT {pick}q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT {pick}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM tailed{group})) USING ({by})'''}
      {group} HAVING count(*) FILTER ({c} < lo OR {c} > hi) > 0"""


_ROUND_OUT = """round(share, 6) AS share, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
  round(median, 6) AS median, round("max", 6) AS "max", n"""
_BOTH = f"both_cols AS ({_outliers('o_totalprice')} UNION ALL {_outliers('price')})"


def _top(source: str, names, k: int) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM {source}" for c in names)
    return f"""SELECT col AS "column", v AS value, n, CAST(rk AS INTEGER) AS rank FROM (SELECT *,
      row_number() OVER (PARTITION BY col ORDER BY n DESC, v ASC NULLS LAST) AS rk FROM
      (SELECT col, v, count(*) AS n FROM ({cells}) GROUP BY col, v)) WHERE rk <= {k}"""


def _group(agg: str, digits: int) -> str:
    return f"SELECT l_returnflag, round({agg}(l_extendedprice), {digits}) AS value FROM lineitem GROUP BY 1"


def _hist(source: str, c: str, clip: bool) -> str:
    ends = "quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi" if clip else "min(v) AS lo, max(v) AS hi"
    return f"""vals AS (SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL),
      ends AS (SELECT {ends}, median(v) AS med FROM vals),
      binned AS (SELECT least(CAST(floor((greatest(lo, least(hi, v)) - lo) / (hi - lo) * 12) AS INTEGER) + 1, 12) AS bin
        FROM vals, ends)
      SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * (hi - lo) / 12, 4) AS low,
        round(lo + b * (hi - lo) / 12, 4) AS high, (SELECT count(*) FROM binned WHERE bin = b) AS n,
        round(med, 4) AS median FROM range(1, 13) t(b), ends"""


_BOX = """count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  round(min(price) FILTER (price >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(price) FILTER (price <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS fliers"""
_QUARTILES = "quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3"
_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("order_id", "priority", "amount", "order_date", "status"))

ORACLES = {
    "numeric_summary": _summary("lineitem"),
    "numeric_summary_by_flag": _summary("lineitem", "l_returnflag"),
    "quantiles_narrowed": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, round(quantile_cont({c}, 0.25), 6) AS p25,
        round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem GROUP BY 1"""
        for c in MEASURES
    ),
    "top_values": f"{sql_with()} {_top('norm', ('priority', 'status', 'amount'), 5)}",
    "correlation_matrix": f"""WITH p AS ({_pairs(MEASURES, 'lineitem')})
        SELECT column_a AS "row", column_b AS "column", round(r, 6) AS r FROM p
        UNION SELECT column_b, column_a, round(r, 6) FROM p UNION SELECT column_a, column_a, 1.0::DOUBLE FROM p
        UNION SELECT column_b, column_b, 1.0::DOUBLE FROM p""",
    "correlation_pairs": f"""WITH t AS (SELECT CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS a,
          CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice END AS b, l_discount AS c, 1.0::DOUBLE AS d FROM lineitem)
        SELECT pair_ord, column_a, column_b, CASE WHEN column_b <> 'd' THEN round(r, 6) END AS r, n
        FROM ({_pairs(('a', 'b', 'c', 'd'), 't')})""",
    "correlation_wide": f"""WITH t AS (SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in WIDE.items())} FROM lineitem)
        SELECT pair_ord, column_a, column_b, CASE WHEN column_b <> 'same' THEN round(r, 6) END AS r, n FROM ({_pairs(WIDE, 't')})""",
    "strongest_correlation": f"""SELECT column_a, column_b, round(r, 6) AS r, n, {_SUPPORT}
        FROM ({_pairs(MEASURES, 'lineitem')}) ORDER BY abs(r) DESC, n DESC, pair_ord LIMIT 1""",
    "strongest_by_status": f"""WITH {_TAIL}, h AS (SELECT *, o_totalprice / 2 + o_orderkey % 1000 AS half FROM tailed),
        p AS ({' UNION ALL '.join(
            f"SELECT o_orderstatus, {i} AS pair_ord, '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r, "
            f"count(*) AS n FROM h GROUP BY 1"
            for i, (a, b) in enumerate((('o_totalprice', 'price'), ('o_totalprice', 'half'), ('price', 'half'))))})
        SELECT o_orderstatus, column_a, column_b, round(r, 6) AS r, n, {_SUPPORT} FROM p
        QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(r) DESC, n DESC, pair_ord) = 1""",
    "outliers": f'WITH {_TAIL}, {_BOTH} SELECT "column", outliers, {_ROUND_OUT} FROM both_cols',
    "outliers_by_status": f"""WITH {_TAIL}, o AS ({_outliers('price', 'o_orderstatus')})
        SELECT o_orderstatus, "column", outliers, {_ROUND_OUT} FROM o""",
    "outlier_table": f"""WITH {_TAIL}, {_BOTH} SELECT "column", outliers, CAST(round_even(share * 100, 0) AS INTEGER)
        AS share_pct, round_even(lower_bound, 2) AS lower_bound, round_even(upper_bound, 2) AS upper_bound FROM both_cols""",
    "heaviest_outlier": f"""WITH {_TAIL}, {_BOTH} SELECT "column", round(share, 6) AS share FROM both_cols
        ORDER BY both_cols.share DESC, "column" LIMIT 1""",
    "group_count": f"""{sql_with()} SELECT coalesce(priority, 'Missing') AS priority, count(*) AS value FROM norm
        GROUP BY 1 ORDER BY value DESC, 1 LIMIT 8""",
    "group_sum": _group("sum", 2), "group_mean": _group("avg", 4), "group_median": _group("median", 4),
    "group_min": _group("min", 4), "group_max": _group("max", 4),
    "group_natural": """SELECT CAST(p_size AS VARCHAR) AS p_size, round(avg(p_retailprice), 4) AS value FROM part
        GROUP BY part.p_size ORDER BY part.p_size LIMIT 20""",
    "group_by_date": """SELECT o_orderdate, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 1
        LIMIT 30""",
    "top_categories": f"{sql_with()} {_top('norm', ('priority',), 10)}",
    "histogram": f"WITH {_hist('lineitem', 'l_extendedprice', False)}",
    "histogram_display": f"WITH {_TAIL}, {_hist('tailed', 'price', True)}",
    "box_stats": f"""WITH {_TAIL} SELECT 'price' AS "column", {_BOX} FROM tailed, (SELECT {_QUARTILES} FROM tailed)""",
    "box_by_group": f"""WITH {_TAIL}, top AS (SELECT o_orderpriority FROM tailed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)
        SELECT o_orderpriority AS "group", {_BOX} FROM tailed JOIN
        (SELECT o_orderpriority, {_QUARTILES} FROM tailed GROUP BY 1) USING (o_orderpriority)
        WHERE o_orderpriority IN (SELECT o_orderpriority FROM top) GROUP BY 1""",
    "scatter_points": f"""{sql_with()} SELECT order_id AS x, amount AS y FROM typed
        WHERE order_id IS NOT NULL AND amount IS NOT NULL""",
    "completeness": f"""{sql_with()} SELECT count(*) AS "rows", {_NULLS} AS missing, 5 AS "columns",
        round(1 - ({_NULLS}) / (count(*) * 5), 6) AS completeness FROM norm""",
    "completeness_by_status": f"""{sql_with()} SELECT status, count(*) AS "rows", {_NULLS} AS missing, 4 AS "columns",
        round(1 - ({_NULLS}) / (count(*) * 4), 6) AS completeness FROM norm GROUP BY status""",
    "leading_share": f"""{sql_with()}, t AS ({_top('norm', ('priority', 'status'), 5)})
        SELECT "column", min(value) FILTER (rank = 1) AS value, max(n) AS n, round(max(n) / sum(n), 6) AS share
        FROM t GROUP BY "column\"""",
    "widest_columns": f"""WITH s AS ({' UNION ALL '.join(
        f"SELECT '{c}' AS col, stddev_samp({c}) AS sd, max({c}) - min({c}) AS w FROM lineitem" for c in MEASURES)})
        (SELECT 'spread' AS kind, col AS "column", round(sd, 4) AS size FROM s ORDER BY sd DESC, col LIMIT 1)
        UNION ALL (SELECT 'range', col, round(w, 4) FROM s ORDER BY w DESC, col LIMIT 1)""",
    "chart_bar": """SELECT l_shipdate, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1
        ORDER BY sum(l_quantity) DESC, l_shipdate LIMIT 12""",
    "chart_line": """SELECT CAST(l_quantity AS VARCHAR) AS l_quantity, round(avg(l_extendedprice), 4) AS value
        FROM lineitem GROUP BY lineitem.l_quantity""",
}
