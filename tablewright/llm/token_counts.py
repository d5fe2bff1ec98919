"""Token counts from a cache of digests.

A text is known by the digest of its content, a tokenizer by the digest of its file, its kind and the library's version.
The cache is a Parquet table (tokenizer, digest, n_bytes, n_tokens) that only grows. Counting joins the digests of all
rows to it, encodes one row of every distinct text that it lacks, and appends those counts.

Only digests are shuffled to find the texts to encode. Their text is fetched by the number of one row each, which no two
rows share, so that a text that a third of all rows hold is encoded once and never gathered.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..session import pin_file_splits
from .common import Workspace, table
from .subwords import default_tokenizer, give_back, text_encoder

CACHE = "tokenizer string, digest binary, n_bytes long, n_tokens long"

#: Parameters: tokens beyond which a document is over the limit; missing texts (16 bytes each) that are broadcast at most.
TOKEN_LIMIT = 1024
BROADCAST_ROWS = 20_000


def tokenizer_digest(path: str) -> str:
    """A tokenizer's version: its file, kind and the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library

    made = hashlib.sha256(f"{path.rpartition('.')[2]} {library.__version__} ".encode())
    with open(path, "rb") as f:
        made.update(f.read())
    return made.hexdigest()


def normalised(text: Column) -> Column:
    """The content that is digested: NULL is empty. Every byte counts for a tokenizer, so nothing else is alike."""
    return F.coalesce(text.cast("string"), F.lit(""))


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_column(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text without begin, end or added special tokens."""
    if path.endswith(".model"):
        made = _pieces(path)
        return np.array([len(made.encode(t or "")) for t in texts.to_pylist()], np.int64)
    return text_encoder(path).counts(texts)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count_column(path, batch.column(2)), pa.int64())],
                names=["digest", "n_bytes", "n_tokens"],
            )
        give_back()

    return run


class CountCache:
    """The stored counts in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame:
        """(digest, n_bytes, n_tokens) of one tokenizer. Two writers may have stored a text twice; it comes out once."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], CACHE).drop("tokenizer")
        kept = self.spark.read.schema(CACHE).parquet(self.path).where(F.col("tokenizer") == version)
        return kept.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        rows = counts.select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens")
        rows.write.mode("append").option("compression", "zstd").partitionBy("tokenizer").parquet(self.path)


def count_tokens(
    docs: DataFrame, cache: CountCache, *, tokenizer_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row; distinct texts that the cache lacks are added to it.

    NULL and empty texts have 0 bytes and 0 tokens. Repeated rows, equal and NULL ids each keep their row; an empty table
    gives an empty result and leaves the cache alone. Other columns are not looked at. docs must give the same rows in
    the same order each time it is read, as tables in files do; should it not, the count of a text would be missing, and
    the result raises instead of leaving it out.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    pin_file_splits(spark)
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    digest = F.unhex(F.sha2(F.col("_text"), 256))
    work = Workspace(spark, "token-counts")
    keyed = work.write(rows.select("_id", "_row", digest.alias("digest"), F.octet_length("_text").cast("long").alias("n_bytes")), "keys")
    distinct = work.write(keyed.groupBy("digest").agg(F.min("_row").alias("_row")), "distinct")
    missing = work.write(distinct.join(cache.read(version).select("digest"), "digest", "left_anti"), "missing")
    n = missing.count()
    if n:
        wanted = missing.select("_row", F.col("digest").alias("_digest"))
        if n <= broadcast_rows:
            wanted = F.broadcast(wanted)
        chosen = rows.select("_row", "_text").join(wanted, "_row").where(digest == F.col("_digest"))
        new = chosen.select(F.col("_digest").alias("digest"), F.octet_length("_text").cast("long").alias("n_bytes"), "_text")
        cache.append(new.mapInArrow(_count(tokenizer_path), "digest binary, n_bytes long, n_tokens long"), version)
    # Written, so that both sides of the last join are plain shuffles, of which Spark splits a digest with many rows.
    counts = work.write(distinct.join(cache.read(version), "digest").select("digest", "n_tokens"), "counts")
    counted = keyed.join(counts, "digest", "left")
    sure = F.coalesce(F.col("n_tokens"), F.raise_error(F.lit("a text changed between two reads of the table")).cast("long"))
    return counted.select(F.col("_id").alias(id_col), "n_bytes", sure.alias("n_tokens"), (sure > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of the run's own, so that every distinct text is counted in every run."""
    cache = CountCache(spark, Workspace(spark, "token-count-cache").path("counts"))
    return count_tokens(table(spark, sf_dir, "documents"), cache, tokenizer_path=default_tokenizer())
