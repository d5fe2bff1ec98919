import collections
import re

from tablewright.llm.quality_rules import RULES, fit_label_model, judge_quality

from .conftest import prose


def figures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i: i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_figures_equal_brute_force(documents, odd_rows):
    rows = odd_rows + [
        (30, "a b c a b c a b", "en", "a"), (31, "x x x x x", "en", "a"), (32, "l one\nl one\n\n l one\nl one", "en", "a"),
        (33, "#a |b| <c> $%&*", "en", "a"), (34, "a b c d a b c e", "en", "a"), (35, "q w", "en", "a"),
    ]
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judge_quality(documents(rows)).collect()
    )
    assert got == collections.Counter((i, *figures(t)) for i, t, *_ in rows)


def test_junk_fails_and_prose_passes(documents):
    good = [(i, prose(i, 120), "en", "a") for i in range(40)]
    bad = [
        *[(100 + i, " ".join(w + "###" for w in prose(i, 90).split()), "en", "a") for i in range(3)],
        *[(110 + i, " ".join(w.upper() + "!!" for w in prose(i, 90).split()), "en", "a") for i in range(3)],
        *[(120 + i, "\n".join([prose(i, 12)] * 9), "en", "a") for i in range(3)],
    ]
    got = {r.doc_id: r.passed for r in judge_quality(documents(good + bad)).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i, *_ in bad}


def test_label_model_learns_a_useless_rule():
    # Rule 1 rejects at random; rule 0 and 2 agree on the junk.
    counts = {(2, 2, 2): 800, (2, 0, 2): 90, (0, 2, 0): 80, (0, 0, 0): 8}
    share, tables = fit_label_model(counts, 3)
    assert abs(sum(2.718281828 ** s for s in share) - 1) < 1e-6
    assert tables[0][0][0] < -3  # good documents are hardly ever rejected by rule 0


def test_empty_table(documents):
    assert judge_quality(documents([])).collect() == []
    assert len({r.name for r in RULES}) == len(RULES)
