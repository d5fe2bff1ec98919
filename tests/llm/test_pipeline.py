import collections
import re

import pyspark.sql.functions as F
import pytest

import __spark_entry__ as spec
import corpus_pipeline
from tablewright.llm.common import Workspace, table
from tablewright.llm.queries import ORACLES, QUERIES

from .test_decontaminate import expected as contamination
from .test_minhash_dedup import expected as components
from .test_mixing import size, targets

FOLDER = "/root/testdata/sf0.001"


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(ORACLES) <= set(QUERIES) <= set(spec.queries()) and "pipeline" in spec.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "minhash near-dedup", "benchmark decontamination", "source mixing", "token output",
    ]


def test_stages_against_brute_force(spark):
    docs, work, results = table(spark, FOLDER, "documents"), Workspace(spark, "test"), []
    first = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = work.write(stage(spark, docs, FOLDER), f"s{i}")
        results.append(docs)
    good, single, clean, mixed, tokens = results
    assert all(r.columns == first.columns for r in results[:-1])
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]

    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.9 * len(right)

    comp = components(rows(good), 5)
    assert {i for i, *_ in rows(single)} == set(comp.values()) and single.count() == len(set(comp.values()))

    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    bad = {i for i, _, _, _, c in contamination(rows(single), items) if c}
    assert sorted(i for i, *_ in rows(clean)) == sorted(i for i, *_ in rows(single) if i not in bad)

    sizes, taken = collections.Counter(), collections.Counter()
    for _, text, _, source in rows(clean):
        sizes[source] += size(text)
    for _, text, _, source in rows(mixed):
        taken[source] += size(text)
    longest = max(size(t) for _, t, _, _ in rows(clean))
    assert all(abs(taken[s] - want) <= max(0.05 * want, longest / 2) for s, want in targets(sizes).items())
    assert max(collections.Counter(i for i, *_ in rows(mixed)).values()) <= 2

    assert tokens.count() == mixed.count()
    assert tokens.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == tokens.agg(F.sum("n_tokens")).first()[0]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    docs = table(spark, FOLDER, "documents").limit(0)
    assert stage(spark, docs, FOLDER).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, _rows

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_no_operator_swallows_import_errors():
    import pathlib

    for f in (pathlib.Path(corpus_pipeline.__file__), *pathlib.Path(corpus_pipeline.__file__).parent.glob("tablewright/llm/*.py")):
        assert not re.search(r"except.*(ImportError|ModuleNotFoundError)", f.read_text())
