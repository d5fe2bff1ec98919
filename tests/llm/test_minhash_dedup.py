import math
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from tablewright.llm import wordcodes
from tablewright.llm.common import Workspace
from tablewright.llm.minhash_dedup import BATCH, _N, _sign, connect, drop_near_duplicates, least_matches, near_duplicates
from tablewright.llm.quality_classifier import features

from .conftest import prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def expected(rows, k, percent=80):
    """component per id, from all pairs of different texts."""
    parent = {i: i for i, *_ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), n):
        w[at] = f"edit{seed}x{at}"
    return " ".join(w)


@pytest.mark.parametrize("k", [2, 5])
def test_equals_all_pairs(documents, odd_rows, k):
    base, hub = prose(70, 150), prose(71, 200)
    rows = odd_rows + [(100 + i, edited(base, i, i % 9), "en", "a") for i in range(40)]
    # Around one text: each is close to it, many are not close to each other.
    rows += [(200 + i, edited(hub, 500 + i, (10 if k == 2 else 4)), "en", "a") for i in range(30)] + [(250, hub, "en", "a")]
    # A chain: neighbours are close, its ends are not.
    chain = prose(72, 120)
    for i in range(8):
        rows.append((300 + i, chain, "en", "a"))
        chain = edited(chain, 900 + i, 3 if k == 2 else 2)
    rows += [(400, "Two words", "en", "a"), (401, "two WORDS", "en", "a"), (402, "two", "en", "a"), (403, "two words more", "en", "a")]
    got = near_duplicates(documents(rows), shingle=k).collect()
    want = expected(rows, k)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((i, want[i]) for i, *_ in rows if i is not None)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, k)) for _, t, *_ in rows)


def test_dropping_leaves_one_of_each_group(documents, odd_rows):
    rows = odd_rows + [(500 + i, prose(1, 80) + f" more{i}", "en", "a") for i in range(5)]
    docs = documents(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = expected(rows, 5)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(want.values()))
    assert ids.count(None) == sum(i is None for i, *_ in rows)


def test_connect(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 200)]
    labels = connect(spark.createDataFrame(links, "hub long, node long"), Workspace(spark, "test"), "x")
    got = {r.node: r.comp for r in labels.collect()}
    assert got == {i: 0 for i in [*range(41), 200]} | {100: 100, 101: 100, 102: 100}


def test_pruning_bound():
    for i, m in enumerate(least_matches(0.8, 1e-6)):
        n = (i + 1) * BATCH
        tail = lambda m: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))  # noqa: E731, B023
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)
    assert n == _N


def test_empty_table(documents):
    assert near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("step", ["signatures", "features"])
def test_a_worker_holds_little_beside_its_batch(monkeypatch, step):
    texts = [prose(i % 40, 300 + i % 7) if i % 50 else None for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts, pa.string())], names=["_id", "_text"])
    assert batch.nbytes > 4 << 20
    monkeypatch.setattr(wordcodes, "_powers", [p[:2] for p in wordcodes._powers])
    tracemalloc.start()
    try:
        most = max((b.num_rows for b in _sign(5)(iter([batch])))) if step == "signatures" else sum(1 for _ in features(batch["_text"])) - 3000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most <= 512 and peak < 40 << 20


def test_pieces_change_no_row():
    texts = [None if i % 9 == 0 else prose(i % 30, 4 + i % 60) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts, pa.string())], names=["_id", "_text"])
    cut = [r for b in _sign(5)(iter([batch.slice(0, 0), batch])) for r in b.to_pylist()]
    alone = [r for i in range(1500) for b in _sign(5)(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
    assert cut == alone
