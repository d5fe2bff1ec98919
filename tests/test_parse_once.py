"""Tables that many parts read are made once, and plain cells are neither parsed nor shuffled."""

import os

import pytest
from pyspark.sql import functions as F

from catalog import rules
from tablewright.functions.dates import plain_date, to_date_time
from tablewright.functions.numbers import plain_number, to_number
from tablewright.operators.slices import clean_slices
from tablewright.plans import narrative

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["context_document", "next_questions", "confidence_breakdown", "chart_notes"])
def test_findings_read_kept_tables(spark, monkeypatch, name):
    seen = []

    class Seen(Exception):
        pass

    def spy(raw, active, *more):
        seen.extend([raw, active])
        raise Seen

    monkeypatch.setattr(rules, "slice_findings", spy)
    with pytest.raises(Seen):
        rules.QUERIES[name](spark, FOLDER)
    assert [t.storageLevel.useMemory for t in seen] == [True, True]


def test_only_the_wanted_section_is_built(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(narrative, "insight_sections", lambda findings, **more: asked.append(more) or spark.range(0).selectExpr(
        "id AS section_ord", "'next_questions' AS section", "id AS ord"))
    narrative.next_questions(spark.range(1))
    assert asked == [{"only": ("next_questions",)}]


def test_slices_are_parsed_once(spark):
    df = spark.createDataFrame([(1, "a", "5"), (2, "a", None), (3, "b", "x")], "_row_id long, s string, n string")
    assert clean_slices(df, {"s": "Categorical", "n": "Numeric"}, ["s"]).standardized.storageLevel.useMemory


@pytest.mark.parametrize("plain, parse, sure, unsure", [
    (plain_number, to_number, ["0", "-12", "3.25", "9" * 15], ["", "1e5", "(3)", "$1", "1,000", "x", "1.", "5\n", "--1"]),
    (plain_date, to_date_time, ["1999-12-28", "2024-02-28"], ["", "2024-02-31", "2024-13-01", "1/2/2024", "2024-01-01\n", "2024-1-1"]),
])
def test_plain_cells_always_parse(texts, plain, parse, sure, unsure):
    s = F.col("s")
    assert [tuple(r) for r in texts(sure).select(plain(s), parse(s, trimmed=True).isNotNull()).collect()] == [(True, True)] * len(sure)
    assert not texts(unsure).filter(plain(s)).count()
