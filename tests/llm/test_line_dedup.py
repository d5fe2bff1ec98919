import collections

import pytest

from tablewright.llm.line_dedup import drop_repeated_lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, min_docs, min_chars=1, keep_first=False):
    cut = [((i is not None, i or 0), n, (t or "").split("\n")) for n, (i, t, *_) in enumerate(rows)]
    key = lambda line: line.strip(SPACE).translate(LOWER)
    docs = collections.Counter(k for _, _, lines in cut for k in {key(x) for x in lines} if len(k) >= min_chars)
    out = []
    for _, n, lines in cut:
        kept = [x for x in lines if not (len(key(x)) >= min_chars and docs[key(x)] >= min_docs)]
        out.append((rows[n][0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def found(df):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_equals_brute_force(documents, odd_rows, min_docs):
    rows = odd_rows + [(20 + i, f" Shared Line\t\nown {i}\nshared line\n", "en", "a") for i in range(4)]
    assert found(drop_repeated_lines(documents(rows), min_docs=min_docs)) == expected(rows, min_docs)


def test_first_occurrence_stays(documents):
    rows = [(3, "x\ny\nx", "en", "a"), (1, "b\nx\nx\nc", "en", "a"), (2, "X \nz", "en", "a")]
    got = {r.doc_id: r.kept_text for r in drop_repeated_lines(documents(rows), min_docs=2, keep_first=True).collect()}
    assert got == {1: "b\nx\nc", 2: "z", 3: "y"}


def test_keep_runs(documents):
    rows = [(i, "head\nbody\nfoot\nhead", "en", "a") if i else (0, "head\nown\nfoot\nhead", "en", "a") for i in range(3)]
    got = {r.doc_id: [tuple(x) for x in r.kept_runs] for r in drop_repeated_lines(documents(rows), min_docs=3).collect()}
    assert got == {0: [(1, 1)], 1: [(1, 1)], 2: [(1, 1)]}


def test_empty_table(documents):
    assert drop_repeated_lines(documents([]), min_docs=1).collect() == []
