import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import token_alignment
from tablewright.llm.subwords import byte_letters, default_pieces, default_tokenizer
from tablewright.llm.token_alignment import align_tokens, highest, merge, pair_up

from .test_token_output import ALPHABET

public_tokenizers = pytest.importorskip("public_tokenizers")


def brute(rows, first):
    """Every text whole through both libraries, every link in a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=default_pieces())
    a_side.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    names = {i: t for t, i in a_side.get_vocab().items()}

    def spelt_a(i):
        return bytes(letters[c] for c in names[i]) if all(c in letters for c in names[i]) else names[i].encode()

    def spelt_b(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for i, text, *_ in rows:
        groups = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            if b"".join(map(spelt_a, a)) == b"".join(map(spelt_b, b)) == (" " + text).encode():
                a_ends, b_ends = np.cumsum([len(spelt_a(x)) for x in a]), np.cumsum([len(spelt_b(x)) for x in b])
                last = 0
                for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
                    groups.append(([x for x, e in zip(a, a_ends) if last < e <= end], [x for x, e in zip(b, b_ends) if last < e <= end]))
                    last = end
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        counts.update(links.keys())
        docs.append((i, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def random_rows(n):
    r = random.Random(3)
    signs = [*ALPHABET, "▁", "<s>", "antidisestablishment", "Überraschung", " the", " of"]
    return [(i, "".join(r.choice(signs[:-8] if i % 3 else signs[-7:] + [" "]) for _ in range(r.randint(0, 12))), "en", "a") for i in range(n)]


@pytest.mark.parametrize("fan,spill,radix", [(512, 8 << 20, 2_000_000), (2, 300, 100)])
def test_equals_brute_force(spark, documents, odd_rows, monkeypatch, fan, spill, radix):
    monkeypatch.setattr(token_alignment, "SPILL_BYTES", spill)
    monkeypatch.setattr(token_alignment, "RADIX_ENTRIES", radix)
    rows = [(i, t[:4000] if t else t, *rest) for i, t, *rest in odd_rows] + random_rows(400)
    got = align_tokens(documents(rows), first=default_tokenizer(), second=default_pieces(), fan=fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, default_tokenizer())


def test_tokenizers_that_cannot_be_cut(documents):
    first = public_tokenizers.path("word_bpe_49k.json")
    rows = random_rows(60)
    got = align_tokens(documents(rows), first=first, second=default_pieces())
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, first)


def test_wide_groups_count_the_same_links(monkeypatch):
    r = np.random.default_rng(1)
    m, n = r.integers(1, 9, 50), r.integers(1, 9, 50)
    a, b = r.integers(0, 4, m.sum()), r.integers(0, 4, n.sum())
    group = np.arange(50) // 3

    def count():
        c = Counter()
        for owner, pair, links in zip(*(x.tolist() for x in pair_up(group, m, n, a, b))):
            c[owner, pair] += links
        return c

    plain = count()
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", 6)
    assert count() == plain and sum(plain.values()) == int((m * n).sum())


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_merge_of_runs(monkeypatch, step):
    monkeypatch.setattr(token_alignment, "MERGE_STEP", step)
    r = np.random.default_rng(2)
    runs, expected = [], Counter()
    for k in range(9):
        pairs = np.unique(r.integers(0, 300, 40 * k))
        n = r.integers(1, 5, len(pairs))
        runs.append([pairs, n])
        expected.update(dict(zip(pairs.tolist(), n.tolist())))
    blocks = list(merge(runs))
    pairs, n = (np.concatenate(x).tolist() for x in zip(*blocks))
    assert list(zip(pairs, n)) == sorted(expected.items())


def test_highest_counts_with_ties():
    pairs = np.array([1 << 20 | 1, 1 << 20 | 2, 1 << 20 | 7, 5 << 20 | 1])
    assert highest(pairs, np.array([3, 4, 4, 1])).tolist() == [False, True, True, True]


def test_empty_table(documents):
    assert align_tokens(documents([]), first=default_tokenizer(), second=default_pieces()).collect() == []
