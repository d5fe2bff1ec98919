"""Scores, recommendations, routing, narratives, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import scoring as sc
from tablewright.operators.base import normalise
from tablewright.operators.cleaning import standardize
from tablewright.operators.duplicates import key_diagnostics
from tablewright.operators.profile import invalid_values, missing_counts, profile_table, collect_profile
from tablewright.operators.selection import ColumnChoice, choose_columns
from tablewright.operators.statistics import completeness, numeric_summary, outlier_summary, top_values
from tablewright.plans import documents, narrative
from tablewright.plans.answers import AnswerSource, guided_answer
from tablewright.plans.findings import slice_findings
from tablewright.session import keep
from tablewright.sources import events as ev
from tablewright.sources.sinks import json_preview

from .inputs import (
    DIRTY_TYPES, REPLAYED, REQUESTS, derived, dirty, duck, replayed, rounded, sql_date, sql_number, sql_with, table,
)
from .signals import sql_gap, sql_trend

KEY = ["order_id", "order_date"]
CHOICE = ColumnChoice(category="priority", value="amount", pair=None, time="order_date", axis="datetime")
_PENALTIES = {"missing_penalty": 6, "duplicate_penalty": 6, "invalid_penalty": 6}


def quality_score(spark, sf):
    return rounded(sc.quality_score(sc.quality_metrics(replayed(spark, sf), DIRTY_TYPES, KEY)), _PENALTIES)


def quality_score_by_status(spark, sf):
    """A score per slice, all in one job."""
    types = {c: t for c, t in DIRTY_TYPES.items() if c != "status"}
    metrics = sc.quality_metrics(replayed(spark, sf), types, KEY, by=["status"])
    return rounded(sc.quality_score(metrics), _PENALTIES)


def quality_score_by_nation(spark, sf):
    """Slices of few rows, so that penalties reach their caps and labels differ."""
    df = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("nation"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("odd")).otherwise(F.col("s_acctbal").cast("string")).alias("balance"),
    )
    types = {"name": "Categorical", "balance": "Numeric"}
    return rounded(sc.quality_score(sc.quality_metrics(df, types, ["balance"], by=["nation"])), _PENALTIES)


def quality_breakdown(spark, sf):
    scored = sc.quality_score(sc.quality_metrics(replayed(spark, sf), DIRTY_TYPES, KEY))
    return sc.quality_breakdown(scored).select("ord", "label", "penalty")


def confidence_score(spark, sf):
    """Confidence per nation: small slices, gaps and outliers in balances."""
    df = table(spark, sf, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(F.col("c_custkey") % 8 != 0, F.col("c_acctbal")).alias("balance"), "c_mktsegment",
    )
    filled = completeness(df, ["nation"]).select(
        "nation", "rows", (F.lit(1.0) - F.col("completeness")).alias("missing_ratio")
    )
    worst = outlier_summary(df, ["balance"], ["nation"]).groupBy("nation").agg(F.max("share").alias("max_outlier_share"))
    raw = sc.quality_metrics(df, {"balance": "Numeric", "c_mktsegment": "Categorical"}, None, by=["nation"])
    facts = filled.join(worst, "nation", "left").join(raw.select("nation", "duplicates"), "nation").select(
        "nation", "rows", "missing_ratio", F.coalesce("max_outlier_share", F.lit(0.0)).alias("max_outlier_share"),
        "duplicates", F.lit(0).cast("bigint").alias("invalid_values"),
    )
    out = sc.confidence_score(facts).withColumn("reasons", F.array_join("confidence_reasons", ", "))
    return rounded(out.drop("confidence_reasons"), {"missing_ratio": 6, "max_outlier_share": 6})


def chart_recommendations(spark, sf):
    df = table(spark, sf, "orders").withColumn("_row_id", F.col("o_orderkey"))
    profile = profile_table(df)
    choice = choose_columns(df, profile, collect_profile(profile))
    found = sc.recommendation_table(spark, sc.chart_recommendations(choice))
    return found.select("ord", "key", F.array_join("columns", ", ").alias("columns"))


def suggested_analyses(spark, sf):
    types = {c: t for c, t in DIRTY_TYPES.items() if c != "status"}
    metrics = sc.quality_metrics(replayed(spark, sf), types, ["order_id", "priority"], by=["status"])
    keys = F.array(*[F.lit(k) for _, k, _ in sc.chart_recommendations(CHOICE)])
    return sc.suggested_analyses(metrics.withColumn("chart_keys", keys), ["status"])


OFFERED = [k for k in sc.REQUEST_KEYWORDS if k != "scatter_relationship"] + ["quality_overview"]
REQUEST_COLUMNS = {"o_orderstatus": "Categorical", "o_totalprice": "Numeric", "o_orderdate": "Date"}


def route_requests(spark, sf):
    out = sc.route_requests(derived(spark, sf, REQUESTS), "request", OFFERED, REQUEST_COLUMNS)
    return out.select("request_id", "primary_key", F.array_join("matched_keys", ",").alias("matched"),
                      F.array_join("focus_columns", ",").alias("focus"))


def route_conversations(spark, sf):
    out = sc.route_requests(table(spark, sf, "conversations"), "text", OFFERED)
    return out.select("conv_id", "turn", "primary_key", F.array_join("matched_keys", ",").alias("matched"))


def _raw_and_typed(spark, sf):
    """The table and its typed view, each made once: every part of the findings reads one of them."""
    raw = keep(normalise(replayed(spark, sf)))
    return raw, keep(standardize(raw, DIRTY_TYPES))


def _findings(raw, typed, by=None):
    return slice_findings(raw, typed, DIRTY_TYPES, CHOICE, by, ["amount"], KEY)


def _status_findings(spark, sf):
    return _findings(*_raw_and_typed(spark, sf), "status")


def insight_sections(spark, sf):
    """Which lines are told about each status, in reading order."""
    return narrative.insight_sections(_status_findings(spark, sf)).select("slice", "section", "ord", "rule")


def insight_texts(spark, sf):
    return narrative.insight_sections(_findings(*_raw_and_typed(spark, sf)), "analyst").select("section", "ord", "rule", "text")


def next_questions(spark, sf):
    return narrative.next_questions(_status_findings(spark, sf)).select("slice", "ord", "rule")


def chart_notes(spark, sf):
    raw, typed = _raw_and_typed(spark, sf)
    notes = narrative.chart_notes(numeric_summary(typed, ["amount"]), _findings(raw, typed))
    return notes.select("slice", "key", F.array_join("columns", ", ").alias("columns"), "note")


def confidence_breakdown(spark, sf):
    return narrative.confidence_breakdown(_status_findings(spark, sf))


def run_report(spark, sf):
    findings, raw = _status_findings(spark, sf), replayed(spark, sf)
    static = {
        "file_name": '"orders"', "applied_filters": "[]",
        "duplicate_diagnostics": documents.row_as_json(key_diagnostics(raw, KEY, ["order_id"])),
    }
    return documents.run_report(findings, narrative.insight_sections(findings), static)


def decision_brief(spark, sf):
    return documents.sections_and_brief(_status_findings(spark, sf), "orders", "raw dataset", "operator")[1]


def context_document(spark, sf):
    raw, typed = _raw_and_typed(spark, sf)
    bad = invalid_values(raw, DIRTY_TYPES, "Numeric").unionByName(invalid_values(raw, DIRTY_TYPES, "Date"))
    n = typed.count()
    found = documents.context_document(
        DIRTY_TYPES, {"raw": (n, 5), "active": (n, 5)}, missing_counts(raw), bad, numeric_summary(typed, ["amount"]),
        top_values(typed, ["priority", "status"]), outlier_summary(typed, ["amount"]), documents.preview(typed, "_row_id"),
        _findings(raw, typed), "raw dataset",
    )
    return documents.document_key(found, "document", prefix="overview", view="raw dataset")


def json_rows(spark, sf):
    return json_preview(table(spark, sf, "orders"), "o_orderkey")


def guided_statistics(spark, sf):
    raw = dirty(spark, sf)
    source = AnswerSource(raw, standardize(raw, DIRTY_TYPES), DIRTY_TYPES, CHOICE, ["amount"])
    out = guided_answer("summary_statistics", source)
    return rounded(out, {"mean": 4, "std": 4, "p25": 4, "p50": 4, "p75": 4})


def guided_categories(spark, sf):
    raw = dirty(spark, sf)
    source = AnswerSource(raw, standardize(raw, DIRTY_TYPES), DIRTY_TYPES, CHOICE, ["amount"])
    return guided_answer("top_categories", source, ["status"])


def _log(spark, sf):
    """The events table in the shape of the event log."""
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "event_type",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("status"),
        F.col("event_id").cast("string").alias("run_id"),
    )


def event_status_counts(spark, sf):
    return ev.status_counts(_log(spark, sf))


def event_snapshot(spark, sf):
    return ev.event_snapshot(_log(spark, sf), 20)


def latest_events(spark, sf):
    return ev.newest(_log(spark, sf), "timestamp", 20, "run_id")


def latest_event(spark, sf):
    return ev.latest_event(_log(spark, sf), "timestamp", "run_id")


QUERIES = {
    f.__name__: f
    for f in (
        quality_score, quality_score_by_status, quality_score_by_nation, quality_breakdown, confidence_score,
        chart_recommendations, suggested_analyses, route_requests, route_conversations, insight_sections,
        insight_texts, next_questions, chart_notes, confidence_breakdown, run_report, decision_brief,
        context_document, json_rows, guided_statistics, guided_categories, event_status_counts, event_snapshot,
        latest_events, latest_event,
    )
}


def _metrics(names, key: str, by: str = "", source: str = "norm") -> str:
    pick, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in names)
    return f"""SELECT {pick}count(*) AS "rows", {nulls} AS missing,
      count(*) - count(DISTINCT {key}) AS duplicates,
      count(DISTINCT CASE WHEN {sql_number('amount')} IS NULL THEN amount END) AS invalid_numeric,
      count(DISTINCT CASE WHEN {sql_date('order_date')} IS NULL THEN order_date END) AS invalid_dates,
      {len(names)} AS "columns" FROM {source} {group}"""


_KEY = "(coalesce(lower(order_id), '~'), coalesce(lower(order_date), '~'))"
_ALL = ("order_id", "priority", "amount", "order_date", "status")


def _score(metrics: str) -> str:
    return f"""m AS ({metrics}), pen AS (SELECT *,
      least(35.0::DOUBLE, missing / greatest("rows" * "columns", 1) * 200) AS missing_penalty,
      least(25.0::DOUBLE, duplicates / greatest("rows", 1) * 120) AS duplicate_penalty,
      least(20.0::DOUBLE, (invalid_numeric + invalid_dates) / greatest("rows" * "columns", 1) * 250) AS invalid_penalty FROM m),
    scored AS (SELECT *, CAST(greatest(0, round_even(100.0::DOUBLE - missing_penalty - duplicate_penalty - invalid_penalty, 0))
      AS INTEGER) AS quality_score FROM pen)"""


_SCORED = """round(missing_penalty, 6) AS missing_penalty, round(duplicate_penalty, 6) AS duplicate_penalty,
  round(invalid_penalty, 6) AS invalid_penalty, quality_score, CASE WHEN quality_score >= 90 THEN 'Excellent'
  WHEN quality_score >= 75 THEN 'Good' WHEN quality_score >= 60 THEN 'Fair' ELSE 'Needs attention' END AS quality_label
  FROM scored"""
_PLAIN = '"rows", missing, duplicates, invalid_numeric, invalid_dates, "columns"'

_HITS = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(w, '{t}')" for t in terms) + f" THEN '{key}' END"
    for key, terms in sc.REQUEST_KEYWORDS.items()
)

# What the lines of a slice ask, in reading order: the section, the rule and the fact that it needs.
_LINES = {
    "executive_summary": "size:yes quality:yes audience:yes segment:segment trend:trend leading_value:no_trend",
    "dataset_profile": "columns:yes completeness:yes charts:yes",
    "quality_highlights": "missing:missing blank_share:missing duplicates:duplicates invalid_numeric:numbers invalid_dates:dates none:good",
    "key_drivers": "segment:segment trend:trend leading_value:yes spread:yes charts:yes",
    "analysis_highlights": "outliers:outliers range:yes segment:segment trend:trend charts:yes",
    "risk_flags": "missing:missing duplicates:duplicates outliers:outliers parsing:parsing trend:weak_trend segment:weak_segment "
    "audience:risk none:no_risk",
    "next_steps": "audience:yes chart:yes missing:missing duplicates:duplicates outliers:outliers segment:segment trend:trend",
    "next_questions": "segment:segment trend:trend outliers:outliers missing:missing",
    "assumption_badges": "readiness:yes confidence:yes duplicate_rule:yes time:trend metric:trend trend:trend segment:segment",
    "signal_guardrails": "trend:trend segment:segment",
}
_LINE_VALUES = ", ".join(
    f"({i}, '{section}', '{rule.split(':')[0]}', '{rule.split(':')[1]}')"
    for i, (section, rule) in enumerate((k, r) for k, v in _LINES.items() for r in v.split())
)
_OFFERED = ", ".join(f"'{k}'" for k in OFFERED)
_FOCUS = ", ".join(f"CASE WHEN contains(w, '{c}') THEN '{c}' END" for c in REQUEST_COLUMNS)


def _route(source: str, focus: str, by_column: str) -> str:
    return f"""r AS ({source}), h AS (SELECT *, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS hits,
      list_filter([{focus}], lambda x: x IS NOT NULL) AS f FROM r),
    c AS (SELECT *, list_filter(CASE WHEN len(hits) > 0 THEN hits ELSE [coalesce({by_column}, 'quality_overview')] END,
      lambda x: x IN ({_OFFERED})) AS m FROM h)"""


_EVENTS = """ev AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS status, CAST(event_id AS VARCHAR) AS run_id FROM events)"""

ORACLES = {
    "quality_score": f"{sql_with(REPLAYED)}, {_score(_metrics(_ALL, _KEY))} SELECT {_PLAIN}, {_SCORED}",
    "quality_score_by_status": f"""{sql_with(REPLAYED)}, {_score(_metrics(_ALL[:4], _KEY, 'status'))}
        SELECT status, {_PLAIN}, {_SCORED}""",
    "quality_score_by_nation": f"""WITH norm AS (SELECT CAST(s_nationkey AS VARCHAR) AS nation,
          CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, s_suppkey % 5 = 0 AS odd,
          CASE WHEN s_suppkey % 5 = 0 THEN 'odd' ELSE CAST(s_acctbal AS VARCHAR) END AS balance FROM supplier),
        {_score('''SELECT nation, count(*) AS "rows", count(*) FILTER (name IS NULL) AS missing,
          count(*) - count(DISTINCT balance) AS duplicates, count(DISTINCT CASE WHEN odd THEN balance END)
          AS invalid_numeric, CAST(0 AS BIGINT) AS invalid_dates, 2 AS "columns" FROM norm GROUP BY nation''')}
        SELECT nation, {_PLAIN}, {_SCORED}""",
    "quality_breakdown": f"""{sql_with(REPLAYED)}, {_score(_metrics(_ALL, _KEY))}
        SELECT 1 AS ord, 'Missing-value penalty' AS label, CAST(round_even(missing_penalty, 0) AS INTEGER) AS penalty FROM scored
        UNION ALL SELECT 2, 'Duplicate penalty', CAST(round_even(duplicate_penalty, 0) AS INTEGER) FROM scored
        UNION ALL SELECT 3, 'Invalid-value penalty', CAST(round_even(invalid_penalty, 0) AS INTEGER) FROM scored
        UNION ALL SELECT 4, 'Heuristic readiness model', 0""",
    "confidence_score": """WITH d AS (SELECT 'N' || c_nationkey AS nation,
          CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal END AS balance, c_mktsegment FROM customer),
        q AS (SELECT nation, quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3 FROM d GROUP BY 1),
        f AS (SELECT nation, count(*) AS "rows", count(*) FILTER (balance IS NULL) / (count(*) * 2) AS missing_ratio,
          count(*) FILTER (balance < q1 - 1.5 * (q3 - q1) OR balance > q3 + 1.5 * (q3 - q1)) / count(balance)
            AS max_outlier_share,
          count(*) - count(DISTINCT (coalesce(CAST(balance AS VARCHAR), '~'), c_mktsegment)) AS duplicates
          FROM d JOIN q USING (nation) GROUP BY 1),
        p AS (SELECT *, [CASE WHEN "rows" = 0 THEN ['empty view', '100'] END,
          CASE WHEN "rows" BETWEEN 1 AND 7 THEN ['small sample', '30'] END,
          CASE WHEN "rows" BETWEEN 8 AND 19 THEN ['limited sample', '15'] END,
          CASE WHEN missing_ratio >= 0.1 THEN ['missing-value pressure', '20'] END,
          CASE WHEN missing_ratio >= 0.03 AND missing_ratio < 0.1 THEN ['residual missing values', '10'] END,
          CASE WHEN duplicates > 0 THEN ['duplicate risk', '10'] END,
          CASE WHEN max_outlier_share >= 0.15 THEN ['high outlier pressure', '12'] END,
          CASE WHEN max_outlier_share > 0 AND max_outlier_share < 0.15 THEN ['moderate outlier pressure', '6'] END] AS pens
          FROM f),
        s AS (SELECT *, list_filter(pens, lambda x: x IS NOT NULL) AS hit FROM p),
        t AS (SELECT *, CAST(greatest(0, 100 - coalesce(list_sum(list_transform(hit, lambda x: CAST(x[2] AS INTEGER))), 0))
          AS INTEGER) AS confidence_score FROM s)
        SELECT nation, "rows", round(missing_ratio, 6) AS missing_ratio, round(max_outlier_share, 6) AS max_outlier_share,
          duplicates, CAST(0 AS BIGINT) AS invalid_values, confidence_score,
          CASE WHEN confidence_score >= 80 THEN 'High' WHEN confidence_score >= 55 THEN 'Medium' ELSE 'Low' END
            AS confidence_label,
          CASE WHEN len(hit) = 0 THEN 'stable evidence' ELSE array_to_string(list_transform(hit, lambda x: x[1]), ', ') END
            AS reasons FROM t""",
    "confidence_breakdown": f"""{sql_with(REPLAYED)}, m AS ({_metrics(_ALL[:4], _KEY, 'status')}),
        read AS (SELECT status, order_id, priority, {sql_number('amount')} AS amount, {sql_date('order_date')} AS order_date FROM norm),
        q AS (SELECT status, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM read GROUP BY 1),
        f AS (SELECT status, count(*) AS n, (count(*) FILTER (order_id IS NULL) + count(*) FILTER (priority IS NULL)
            + count(*) FILTER (amount IS NULL) + count(*) FILTER (order_date IS NULL)) / (count(*) * 5) AS gaps,
          count(*) FILTER (amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)) / count(amount) AS share
          FROM read JOIN q USING (status) GROUP BY 1)
        SELECT status AS slice, label, penalty FROM f JOIN m USING (status), (VALUES ('small sample', 30), ('limited sample', 15),
          ('missing-value pressure', 20), ('residual missing values', 10), ('duplicate risk', 10), ('parsing issues', 15),
          ('high outlier pressure', 12), ('moderate outlier pressure', 6)) v(label, penalty)
        WHERE CASE label WHEN 'small sample' THEN n < 8 WHEN 'limited sample' THEN n BETWEEN 8 AND 19
          WHEN 'missing-value pressure' THEN gaps >= 0.1 WHEN 'residual missing values' THEN gaps >= 0.03 AND gaps < 0.1
          WHEN 'duplicate risk' THEN duplicates > 0 WHEN 'parsing issues' THEN invalid_numeric + invalid_dates > 0
          WHEN 'high outlier pressure' THEN share >= 0.15 ELSE share > 0 AND share < 0.15 END""",
    "next_questions": f"""{sql_with(REPLAYED)},
        read AS (SELECT status, lower(trim(priority)) AS priority, {sql_number('amount')} AS amount, {sql_date('order_date')} AS order_date,
          order_id FROM norm),
        q AS (SELECT status, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM read GROUP BY 1),
        f AS (SELECT status, count(*) FILTER (amount IS NOT NULL AND order_date IS NOT NULL) AS points,
          count(*) FILTER (amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)) AS outside,
          count(*) FILTER (order_id IS NULL OR priority IS NULL OR amount IS NULL OR order_date IS NULL) AS gaps
          FROM read JOIN q USING (status) GROUP BY 1),
        g AS (SELECT status, count(*) FILTER (n >= 2) AS groups FROM (SELECT status, priority, count(*) AS n FROM read
          WHERE priority IS NOT NULL AND amount IS NOT NULL GROUP BY ALL) GROUP BY 1),
        hits AS (SELECT status, unnest(list_filter([CASE WHEN groups >= 2 THEN 'segment' END, CASE WHEN points > 0 THEN 'trend' END,
          CASE WHEN outside > 0 THEN 'outliers' END, CASE WHEN gaps > 0 THEN 'missing' END], lambda x: x IS NOT NULL)[:4]) AS rule
          FROM f LEFT JOIN g USING (status))
        SELECT status AS slice, CAST(row_number() OVER (PARTITION BY status ORDER BY
          list_position(['segment', 'trend', 'outliers', 'missing'], rule)) AS INTEGER) AS ord, rule FROM hits""",
    "insight_sections": f"""{sql_with(REPLAYED)}, m AS ({_metrics(_ALL[:4], _KEY, 'status')}),
        q AS (SELECT status, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM typed GROUP BY status),
        o AS (SELECT status, count(*) FILTER (amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)) AS outside
          FROM typed JOIN q USING (status) GROUP BY status),
        g AS (SELECT status, support AS gap FROM {sql_gap('typed', 'priority', 'amount', 'status')}),
        t AS (SELECT status, support AS run FROM {sql_trend('typed', 'order_date', 'amount', by='status')}),
        f AS (SELECT *, coalesce(gap <> 'Supported', false) AS weak_gap, coalesce(run <> 'Supported', false) AS weak_run,
          invalid_numeric + invalid_dates > 0 AS bad FROM m LEFT JOIN o USING (status) LEFT JOIN g USING (status) LEFT JOIN t USING (status)),
        h AS (SELECT status, ['yes', CASE WHEN gap IS NOT NULL THEN 'segment' END, CASE WHEN run IS NULL THEN 'no_trend' ELSE 'trend' END,
          CASE WHEN missing > 0 THEN 'missing' END, CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN invalid_numeric > 0 THEN 'numbers' END,
          CASE WHEN invalid_dates > 0 THEN 'dates' END, CASE WHEN missing + duplicates = 0 AND NOT bad THEN 'good' END,
          CASE WHEN outside > 0 THEN 'outliers' END, CASE WHEN bad THEN 'parsing' END, CASE WHEN weak_run THEN 'weak_trend' END,
          CASE WHEN weak_gap THEN 'weak_segment' END,
          CASE WHEN missing + duplicates + outside > 0 OR bad OR weak_run OR weak_gap THEN 'risk' ELSE 'no_risk' END] AS facts FROM f)
        SELECT status AS slice, section, CAST(row_number() OVER (PARTITION BY status, section ORDER BY k) AS INTEGER) AS ord, rule
        FROM h, (VALUES {_LINE_VALUES}) v(k, section, rule, fact) WHERE list_contains(facts, fact)""",
    # o_orderkey is an identifier: it rises with the row number.
    "chart_recommendations": """WITH m AS (SELECT 'o_custkey' AS c, stddev_samp(o_custkey) AS s FROM orders
          UNION ALL SELECT 'o_totalprice', stddev_samp(o_totalprice) FROM orders),
        v AS (SELECT c FROM m ORDER BY s DESC, c LIMIT 1),
        k AS (SELECT c FROM (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS d FROM orders
          UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders) ORDER BY d, c LIMIT 1),
        p AS (SELECT string_agg(c, ', ' ORDER BY c) AS pair FROM m)
        SELECT 1 AS ord, 'category_bar' AS key, c AS columns FROM k UNION ALL SELECT 2, 'numeric_hist', c FROM v
        UNION ALL SELECT 3, 'scatter_relationship', pair FROM p UNION ALL SELECT 4, 'correlation_heatmap', pair FROM p
        UNION ALL SELECT 5, 'trend_analysis', 'o_orderdate, ' || c FROM v""",
    "suggested_analyses": f"""{sql_with(REPLAYED)}, m AS ({_metrics(_ALL[:4],
            "(coalesce(lower(order_id), '~'), coalesce(lower(priority), '~'))", 'status')})
        SELECT status, ord, key FROM m, (VALUES (1, 'quality_overview'), (2, 'summary_statistics'),
          (3, 'missing_breakdown'), (4, 'duplicate_review'), (5, 'top_categories'), (6, 'numeric_distribution'),
          (7, 'outlier_check'), (10, 'trend_analysis'), (11, 'recommended_charts')) v(ord, key)
        WHERE (ord <> 3 OR missing > 0) AND (ord <> 4 OR duplicates > 0)""",
    "route_requests": f"""WITH {_route(f"SELECT *, lower(trim(request)) AS w FROM ({duck(REQUESTS)})", _FOCUS,
            "CASE f[1] WHEN 'o_orderstatus' THEN 'top_categories' WHEN 'o_totalprice' THEN 'numeric_distribution' "
            "WHEN 'o_orderdate' THEN 'trend_analysis' END")}
        SELECT request_id, coalesce(m[1], 'missing_breakdown') AS primary_key, array_to_string(m, ',') AS matched,
          array_to_string(f, ',') AS focus FROM c""",
    "route_conversations": f"""WITH {_route('SELECT *, lower(trim(text)) AS w FROM conversations', "NULL", "NULL")}
        SELECT conv_id, turn, coalesce(m[1], 'missing_breakdown') AS primary_key, array_to_string(m, ',') AS matched FROM c""",
    "json_rows": """SELECT o_orderkey AS row_id, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
        ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) ||
        ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderpriority":"' || o_orderpriority ||
        '"}' AS json FROM orders ORDER BY o_orderkey LIMIT 25""",
    "guided_statistics": f"""{sql_with()} SELECT 'amount' AS "column", count(amount) AS "count", round(avg(amount), 4) AS mean,
        round(stddev_samp(amount), 4) AS std, min(amount) AS "min", round(quantile_cont(amount, 0.25), 4) AS p25,
        round(quantile_cont(amount, 0.5), 4) AS p50, round(quantile_cont(amount, 0.75), 4) AS p75, max(amount) AS "max"
        FROM typed""",
    "guided_categories": f"""{sql_with()} SELECT 'status' AS "column", status AS value, count(*) AS n,
        CAST(row_number() OVER (ORDER BY count(*) DESC, status) AS INTEGER) AS rank FROM norm GROUP BY status""",
    "event_status_counts": f"WITH {_EVENTS} SELECT status, count(*) AS n FROM ev GROUP BY status",
    "event_snapshot": f"""WITH {_EVENTS}, l AS (SELECT * FROM ev ORDER BY timestamp DESC, run_id DESC LIMIT 20)
        SELECT status, count(*) AS n, max(timestamp) AS last_seen, max_by(event_type, (timestamp, run_id)) AS last_event_type
        FROM l GROUP BY status""",
    "latest_events": f"WITH {_EVENTS} SELECT * FROM ev ORDER BY timestamp DESC, run_id DESC LIMIT 20",
    "latest_event": f"WITH {_EVENTS} SELECT * FROM ev ORDER BY timestamp DESC, run_id DESC LIMIT 1",
}
