import pytest
import pyspark.sql.functions as F

from tablewright.llm.common import Workspace
from tablewright.llm.subwords import default_pieces, default_tokenizer
from tablewright.llm.token_counts import CountCache, count_tokens, tokenizer_digest

public_tokenizers = pytest.importorskip("public_tokenizers")


def cache(spark):
    return CountCache(spark, Workspace(spark, "test-cache").path("counts"))


def expected(path, text):
    text = text or ""
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=str)


@pytest.mark.parametrize("path", [default_tokenizer(), public_tokenizers.path("word_bpe_49k.json"), default_pieces()])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_equals_the_library(spark, documents, odd_rows, path, broadcast_rows):
    rows = [(i, t[:20_000] if t else t, *rest) for i, t, *rest in odd_rows] + [(11, "<|endoftext|> x <s>", "en", "a")]
    got = result(count_tokens(documents(rows), cache(spark), tokenizer_path=path, broadcast_rows=broadcast_rows))
    want = [(i, len((t or "").encode()), expected(path, t), expected(path, t) > 1024) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert any(r[3] for r in got)


def test_only_distinct_misses_are_encoded(spark, documents):
    own = cache(spark)
    base = [(i, f"text {i % 7}", "en", "a") for i in range(100)]
    first = result(count_tokens(documents(base), own, tokenizer_path=default_tokenizer()))
    stored = spark.read.parquet(own.path)
    assert stored.count() == 7
    assert result(count_tokens(documents(base), own, tokenizer_path=default_tokenizer())) == first
    assert spark.read.parquet(own.path).count() == 7
    more = base + [(200, "text 8", "en", "a"), (201, "text 8", "en", "a"), (202, None, "en", "a")]
    result(count_tokens(documents(more), own, tokenizer_path=default_tokenizer()))
    assert spark.read.parquet(own.path).count() == 9
    result(count_tokens(documents(base), own, tokenizer_path=default_pieces()))
    assert spark.read.parquet(own.path).count() == 16
    assert tokenizer_digest(default_tokenizer()) != tokenizer_digest(default_pieces())


def test_stored_counts_are_used(spark, documents):
    """A count put into the cache by hand comes back: the text is not encoded again."""
    own = cache(spark)
    made = spark.createDataFrame([("a b", 3, 77)], "t string, n_bytes long, n_tokens long")
    row = made.select(F.unhex(F.sha2("t", 256)).alias("digest"), "n_bytes", "n_tokens")
    own.append(row, tokenizer_digest(default_tokenizer()))
    own.append(row, tokenizer_digest(default_tokenizer()))
    got = result(count_tokens(documents([(1, "a b", "en", "a"), (2, "a b c", "en", "a")]), own, tokenizer_path=default_tokenizer()))
    assert got == [(1, 3, 77, False), (2, 5, 3, False)]


def test_empty_table(spark, documents):
    assert count_tokens(documents([]), cache(spark), tokenizer_path=default_tokenizer()).collect() == []
