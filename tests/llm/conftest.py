import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text int, _row string, hub int, score string"


@pytest.fixture
def documents(spark):
    """A table like `documents`, with further columns whose names clash with those the operators use inside."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, lang, source, None, "x", 1, "y", 2, "z") for i, t, lang, source in rows], COLUMNS,
        )

    return make


def prose(seed, n):
    """n made-up words in sentences, the same for the same seed."""
    r = random.Random(seed)
    parts = ["ta", "lo", "mi", "re", "su", "ken", "var", "dol", "pi", "an"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + "." if i % 11 == 10 else w for i, w in enumerate(out))


@pytest.fixture
def odd_rows():
    """NULLs in any column, empty and blank texts, repeated rows, ties, and one very long text."""
    same = prose(1, 80)
    return [
        (1, same, "en", "a"), (1, same, "en", "a"), (2, same, "fr", None), (3, None, None, "b"), (4, "", "en", "b"),
        (None, prose(2, 30), "en", "a"), (None, None, None, None), (5, " \t\n ", "en", "c"), (6, "ÀÉ É x", "fr", "c"),
        (7, prose(3, 60_000), "en", "c"), (8, "one", "en", "d"), (9, "a\n\nb\n\na\n", "de", "d"), (10, "12 34 !!", "de", ""),
    ]
