import collections
import re

import pytest

from tablewright.llm import decontaminate
from tablewright.llm.decontaminate import drop_contaminated, find_contamination

from .conftest import prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i: i + 13])].add(item)
    out = []
    for i, text, *_ in rows:
        w, hit, found = cut(text), set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if (x := tuple(w[at: at + size])) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[x]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), names, bool(hit) and 20 * len(hit) >= len(w)))
    return collections.Counter(out)


def found(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect())


ITEMS = [
    (1, prose(50, 40)), (2, prose(51, 13)), (10, prose(52, 14) + "\n" + prose(50, 40)), (3, None), (4, ""), (None, prose(53, 20)),
    (5, "the the the the the the the the the the the the the the the"),
]
SHORT = [(6, "Seven words make up this short item"), (7, "three little words"), (8, "X"), (9, prose(54, 11))]


def planted():
    w = prose(50, 40).split()
    return [
        (40, prose(60, 30) + " " + " ".join(w[5:18]) + " " + prose(61, 30), "en", "a"),
        (41, prose(60, 30) + " " + " ".join(w[5:17]) + " " + prose(61, 30), "en", "a"),
        (42, prose(50, 40).upper() + "! " + prose(62, 900), "en", "a"),
        (43, "the " * 40, "en", "a"), (44, prose(51, 13) + "," + prose(51, 13), "en", "a"), (45, prose(53, 20), "en", "a"),
        (46, "Before: seven words; make up THIS short item. after", "en", "a"), (47, "x " + prose(54, 11), "en", "a"),
        (48, " ".join(w[:13]) + " " + " ".join(w[1:14]), "en", "a"),
    ]


@pytest.mark.parametrize("items", [ITEMS, ITEMS + SHORT, SHORT[:1]])
def test_equals_brute_force(spark, documents, odd_rows, items):
    rows = odd_rows + planted()
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, _words string")
    assert found(find_contamination(documents(rows), bench)) == expected(rows, items)


def test_dropping_keeps_clean_rows_whole(spark, documents, odd_rows):
    rows = odd_rows + planted()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(rows)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = collections.Counter(i for (i, _, _, _, c), n in expected(rows, ITEMS).items() for _ in range(n) if c)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(i for i, *_ in rows) - bad


def test_empty_tables(spark, documents, odd_rows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_contamination(documents([]), bench).collect() == []
    out = find_contamination(documents(odd_rows), bench.limit(0)).collect()
    assert len(out) == len(odd_rows) and not any(r.contaminated for r in out)


def test_a_short_item_leaves_the_fingerprints_of_long_ones_sparse(spark, monkeypatch):
    seen = {}
    marks = decontaminate._marks
    monkeypatch.setattr(decontaminate, "_marks", lambda items, k, w: seen.update({(k, w): marks(items, k, w).distinct().count()}) or marks(items, k, w))
    bench = spark.createDataFrame([(1, prose(1, 400)), (2, prose(2, 5))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1, 30))], "doc_id long, text string")
    assert find_contamination(docs, bench).collect()[0].n_hit == 30
    assert set(seen) == {(5, 9), (5, 1)} and seen[5, 1] == 1 and seen[5, 9] < 200
