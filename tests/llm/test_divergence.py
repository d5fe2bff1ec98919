import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm.divergence import pointer_sort, source_divergence, term_places
from tablewright.llm.wordcodes import text_blocks

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        all_counts = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def p(n, total):
            return 1 + 10**9 * (n + 5) // (total + 5 * len(kept))

        for s in sources:
            pairs = [(sum(abs(p(counts[lang, s][t], total[s]) - p(counts[lang, o][t], total[o])) for t in kept), o) for o in sources - {s}]
            terms = [(p(counts[lang, s][t], total[s]) - p(all_counts[t], sum(all_counts.values())), t) for t in kept if counts[lang, s][t]]
            for part, found, most in (("pair", pairs, None), ("term", [x for x in terms if x[0] > 0], top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("tile,block", [(128, 2048), (2, 3)])
def test_equals_brute_force(documents, odd_rows, tile, block):
    r = random.Random(4)
    words = ["aa", "Ab", "extraordinarily", "extraordinaries", "extraord", "extraordi", "é", "中文", "x" * 40, "x" * 41, "q1z"]
    rows = [
        (i, " ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "d", "e", "É", None]))
        for i in range(300)
    ] + [(1000, "only one", "xx", "a"), (1001, "nothing kept", "yy", "a"), (1002, None, "yy", "b"), (1003, "", "yy", None)]
    rows += [(i, t[:2000] if t else t, *rest) for i, t, *rest in odd_rows]
    got = result(source_divergence(documents(rows), least=5, top=7, tile_sources=tile, block_terms=block))
    assert got == brute(rows, 5, 7)
    assert {x[2] for x in got} == {"pair", "term"}


def test_pointers_are_sorted_in_runs():
    r = random.Random(1)
    texts = ["".join(r.choice("aAbcé -") for _ in range(r.randint(0, 400))) for _ in range(200)] + ["", None, "a" * 1000, "a" * 1001]
    for _, _, data, offsets in text_blocks(pa.array(texts), 5000):
        starts, ends = term_places(data, offsets)
        shard = (starts % 3).astype(np.int64)
        order, head = pointer_sort(data, starts, ends - starts, shard)
        words = [(int(shard[i]), bytes(data[starts[i]: ends[i]])) for i in order]
        assert words == sorted(words) and sorted(order.tolist()) == list(range(len(starts)))
        assert head.tolist() == [k == 0 or words[k] != words[k - 1] for k in range(len(words))]
        assert all(a < b or h for a, b, h in zip(order[:-1], order[1:], head[1:]))


def test_terms_of_texts(documents):
    rows = [(i, "Wort wort", "de", "a") for i in range(30)] + [(99, "anderes", "de", "b")]
    got = result(source_divergence(documents(rows)))
    p = 1 + 10**9 * 65 // 65
    assert got == [("de", "a", "pair", "b", abs(p - (1 + 10**9 * 5 // 5)), 1), ("de", "b", "pair", "a", 0, 1)]


def test_empty_table(documents):
    assert source_divergence(documents([])).collect() == []
