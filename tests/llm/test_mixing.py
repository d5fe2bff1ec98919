import collections
import re

import numpy as np
import pytest

from tablewright.llm import mixing
from tablewright.llm.common import Workspace
from tablewright.llm.mixing import blocked, mix, mix_report, plan_mix, source_targets, split_quotas, with_blocks

from .conftest import prose


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water-filling in rounds: sources above their stop are fixed there, the others share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[n] for n in free)
        over = [n for n in free if w[n] * level > most * sizes[n]]
        if not over:
            return out | {n: w[n] * level for n in free}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 30, None: 5}, {"a": 1}, {"b": 1000, "a": 1, "c": 1, "d": 1, "e": 900}, {"a": 0, "b": 0}, {"x": 0, "y": 7},
    {f"s{i}": (i * 37) % 11 + 1 for i in range(25)},
])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, _size long")
    got = {r._source: r.target for r in source_targets(rows).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_splitting_tree_is_exact():
    quotas = np.array([5, 0, 17, 1, 400])
    runs, sizes = collections.defaultdict(list), collections.Counter()
    for shard, some, first, last in split_quotas(quotas, 7, 3):
        assert (last > first).all()
        sizes[shard] += int((last - first).sum())
        for k, a, b in zip(some.tolist(), first.tolist(), last.tolist()):
            runs[k] += range(a, b)
    assert {k: sorted(v) for k, v in runs.items()} == {k: list(range(n)) for k, n in enumerate(quotas.tolist()) if n}
    assert max(sizes.values()) - min(sizes.values()) <= 3


def test_many_sources_in_several_trees(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 3_000)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    docs = spark.range(10_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 4 AS INT)) AS text", "CONCAT('s', id) AS source")
    report = mix_report(docs)
    r = report.selectExpr("count(*) n", "sum(taken) t", "sum(target) w", "max(taken / size) m", "count(DISTINCT source) s").first()
    assert r.n == r.s == 10_000 and r.m <= 2 and abs(r.t - r.w) < 0.35 * r.w  # a source is one document here


@pytest.mark.parametrize("ids", ["same", "own"])
def test_documents_shared_by_sources(documents, ids):
    """The same 60 documents in three sources, some rows twice: each source comes near its target, none above 2 times."""
    rows = []
    for k, source in enumerate("abc"):
        rows += [(i if ids == "same" else 1000 * k + i, prose(i, 20 + i), "en", source) for i in range(60)]
    rows += [(5, prose(5, 25), "en", "a"), (6, prose(6, 26), "en", "a")]
    report, taken = mix_report(documents(rows)).collect(), collections.Counter()
    assert len(report) == len(rows)
    for r in report:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    want = {r.source: r.target for r in report}
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)
    words = collections.Counter()
    for r in mix(documents(rows)).collect():
        words[r.source] += size(r.text)
    assert words == taken


def corpus():
    return [(i, prose(i, 5 + i * 7 % 90), "en", "abcdefg"[i % 7]) for i in range(300)] + [(900 + i, prose(900 + i, 60), "en", None) for i in range(20)]


def test_report_and_mix_agree(documents, odd_rows):
    rows = corpus() + [r for r in odd_rows if r[0] != 7]
    docs = documents(rows)
    report = mix_report(docs).collect()
    per_source = collections.Counter()
    for _, text, _, source in rows:
        per_source[source] += size(text)
    want, taken = targets(per_source), collections.Counter()
    assert len(report) == len(rows)
    for r in report:
        assert r.source_size == per_source[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for source, n in per_source.items():
        assert abs(taken[source] - want[source]) <= max(5, 0.02 * want[source])
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += size(r.text)
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


@pytest.mark.parametrize("seed", range(3))
def test_a_long_document_at_the_boundary(spark, monkeypatch, seed):
    """Small documents of later blocks fill what a block with a very long one cannot, whichever block that is."""
    monkeypatch.setattr(mixing, "SMALL_GAP", 10)
    sizes, rows = {"a": [20_000] * 6 + [40] * 3_000, "b": [40] * 4_000, "c": [30_000] * 3 + [7] * 9_000}, []
    for s, all_sizes in sizes.items():
        rows += [(1_000_000 * ord(s) + i, i, s, n) for i, n in enumerate(all_sizes)]
    table = spark.createDataFrame(rows, "_id long, _row long, _source string, _size long")
    want = source_targets(table, weights=(2, 1, 1), share=0.5)
    work = Workspace(spark, "test-mix")
    fixed = work.write(with_blocks(want, block_words=4_000), "targets")
    blocks, picked = plan_mix(table, fixed, work, seed=seed, shards=3)
    placed = blocked(table, fixed, seed)
    whole = placed.join(blocks.select("_source", "_block", "_copy"), ["_source", "_block"]).select("_source", "_id", "_copy", "_size")
    single = picked.join(table, ["_id", "_row"]).select("_source", "_id", "_copy", "_size")
    got, seen = collections.Counter(), collections.Counter()
    for r in whole.unionByName(single).collect():
        got[r._source] += r._size
        seen[r._id, r._copy] += 1
    assert max(seen.values()) == 1  # no document twice in one pass
    for r in fixed.collect():
        assert abs(got[r._source] - r.target) <= 40, (r, got)


def test_reruns_agree(documents):
    a = mix_report(documents(corpus())).select("doc_id", "taken")
    b = mix_report(documents(corpus()[::-1]).repartition(5)).select("doc_id", "taken")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_empty_table(documents):
    assert mix_report(documents([])).collect() == [] and mix(documents([])).collect() == []
