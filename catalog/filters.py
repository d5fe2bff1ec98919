"""Row filters and what they can offer."""

from __future__ import annotations

from tablewright.operators import filters as f

from .inputs import table

IN = {"l_returnflag": ["A", "R"]}
RANGE = {"l_quantity": (10, 20)}
DATES = {"l_shipdate": ("1997-01-01", "1998-12-31")}


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _shown(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")


def filter_in(spark, sf):
    return _shown(f.apply_filters(_lines(spark, sf), categorical=IN)[0])


def filter_range(spark, sf):
    return _shown(f.apply_filters(_lines(spark, sf), numeric=RANGE)[0])


def filter_dates(spark, sf):
    return _shown(f.apply_filters(_lines(spark, sf), dates=DATES)[0])


def filter_all(spark, sf):
    return _shown(f.apply_filters(_lines(spark, sf), IN, RANGE, DATES)[0])


def filter_end_of_day(spark, sf):
    """Events up to the end of the last day; without the option the range ends at its midnight."""
    events = table(spark, sf, "events")
    kept, _ = f.apply_filters(events, dates={"ts": ("2024-01-03", "2024-01-10")}, end_of_day=True)
    return kept.select("event_id", "ts", "event_type")


def filter_audit(spark, sf):
    return f.filter_audit(_lines(spark, sf), {**IN, "no_such_column": ["x"], "l_linestatus": []}, RANGE, DATES)


def filter_values(spark, sf):
    return f.category_domain(_lines(spark, sf), ["l_returnflag", "l_linestatus"])


def filter_ranges(spark, sf):
    return f.range_domain(_lines(spark, sf), ["l_quantity", "l_discount", "l_shipdate", "l_linenumber"])


QUERIES = {
    q.__name__: q
    for q in (
        filter_in, filter_range, filter_dates, filter_all, filter_end_of_day, filter_audit, filter_values,
        filter_ranges,
    )
}

_COLS = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_shipdate FROM lineitem WHERE"
_IN, _RANGE = "l_returnflag IN ('A', 'R')", "l_quantity BETWEEN 10 AND 20"
_DATES = "l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'"

ORACLES = {
    "filter_in": f"{_COLS} {_IN}",
    "filter_range": f"{_COLS} {_RANGE}",
    "filter_dates": f"{_COLS} {_DATES}",
    "filter_all": f"{_COLS} {_IN} AND {_RANGE} AND {_DATES}",
    "filter_end_of_day": """SELECT event_id, ts, event_type FROM events
        WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-11'""",
    "filter_audit": f"""SELECT 0 AS ord, 'l_returnflag' AS "column", 'values' AS kind,
          'l_returnflag: 2 selected value(s)' AS description, count(*) FILTER ({_IN}) AS rows_kept FROM lineitem
        UNION ALL SELECT 1, 'l_quantity', 'range', 'l_quantity: between 10.00 and 20.00', count(*) FILTER ({_RANGE})
          FROM lineitem
        UNION ALL SELECT 2, 'l_shipdate', 'dates', 'l_shipdate: 1997-01-01 to 1998-12-31', count(*) FILTER ({_DATES})
          FROM lineitem""",
    "filter_values": """SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem GROUP BY 2
        UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem GROUP BY 2""",
    "filter_ranges": """SELECT 'l_quantity' AS "column", 'Numeric' AS kind, min(l_quantity) + 0.0::DOUBLE AS low, max(l_quantity) AS high,
          CAST(NULL AS VARCHAR) AS first_day, CAST(NULL AS VARCHAR) AS last_day FROM lineitem
        UNION ALL SELECT 'l_discount', 'Numeric', min(l_discount) + 0.0::DOUBLE, max(l_discount), NULL, NULL FROM lineitem
        UNION ALL SELECT 'l_linenumber', 'Numeric', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE),
          NULL, NULL FROM lineitem
        UNION ALL SELECT 'l_shipdate', 'Date', NULL, NULL, strftime(min(l_shipdate), '%Y-%m-%d'),
          strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem""",
}
