"""Benchmark passages in documents, by winnowing.

Of every k words in a row a hash is made, and of every w hashes in a row the smallest is kept: two texts that share
t = k + w - 1 words keep a common one. Fingerprints of documents meet those of the benchmark first in a bit map of
fixed size, then in a join; each hit is extended to the windows around it, which are compared word by word. Only column
expressions touch the texts; a document leaves its row only with what lies around its hits.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import ANY_CASE_NOT_WORD_RUN, NOT_WORD_RUN, Workspace, ascii_lower, let, row_key, table, words

WINDOW = 13
#: A sieve in front of the joins: what it lets through wrongly is only compared in vain. 2 ** 22 bits are 512 KB.
SIEVE_BITS = 22
#: Contaminated rows up to which their counted list is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000
GRAM = 5


def _grams(w: Column, k: int) -> Column:
    """The hash of each k words in a row; none if there are fewer."""
    made = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))
    return F.when(F.size(w) >= k, made).otherwise(F.array().cast("array<bigint>"))


def _chosen(g: Column, i: Column, w: int) -> Column:
    """Whether winnowing keeps position i: its hash is the smallest of some w hashes in a row (all that tie are kept)."""
    if w == 1:
        return F.lit(True)
    starts = F.sequence(F.greatest(i - (w - 1), F.lit(0)), F.least(i, F.size(g) - w))
    return F.when(
        F.size(g) >= w, F.exists(starts, lambda s: F.array_min(F.slice(g, s + 1, F.lit(w))) == g[i]),
    ).otherwise(F.lit(False))


def _positions(g: Column) -> Column:
    return F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))


def _sieve(df: DataFrame, value: str) -> np.ndarray:
    """The bit map of a column of hashes; at most 2 ** (SIEVE_BITS - 6) rows reach the driver."""
    h = F.shiftrightunsigned(F.col(value), 64 - SIEVE_BITS)
    bits = df.groupBy(F.shiftright(h, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({value}, {64 - SIEVE_BITS}) & 63 AS INT))")).alias("bits"),
    ).collect()
    out = np.zeros(1 << (SIEVE_BITS - 6), dtype=np.int64)
    for r in bits:
        out[r["at"]] = r["bits"]
    return out


def _passes(sieve: Column, h: Column) -> Column:
    place = F.shiftrightunsigned(h, 64 - SIEVE_BITS)
    bit = F.call_function("shiftrightunsigned", sieve[F.shiftright(place, 6).cast("int")], place.bitwiseAND(F.lit(63)).cast("int"))
    return bit.bitwiseAND(F.lit(1)) == 1


def _plan(length: int) -> tuple[int, int]:
    """(k, w): which fingerprints find windows of this length for certain. Every length has its own, so that a short item
    makes the fingerprints of longer ones no denser."""
    return (length, 1) if length < GRAM else (GRAM, length - GRAM + 1)


def _windows_of(item_words: str) -> Column:
    n = F.size(item_words)
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(F.col(item_words), i, F.lit(WINDOW)), " "))


def _extension(w: Column, g: Column, length: int, sieve: Column, window_sieve: Column) -> Column:
    """From the words and hashes of a text: the windows around its fingerprints that the benchmark may hold."""
    k, width = _plan(length)

    def around(at: Column) -> Column:
        return F.transform(F.array_distinct(F.flatten(F.transform(at, _starts(F.size(w), k, length)))), _window(w, length))

    at = F.filter(_positions(g), lambda i: _passes(sieve, g[i]) & _chosen(g, i, width))
    return F.filter(let(at, around), lambda x: _passes(window_sieve, F.xxhash64(x["window"])))


def _starts(n: Column, k: int, size: int):
    return lambda i: F.when(
        n >= size, F.sequence(F.greatest(i - (size - k), F.lit(0)), F.least(i, n - size)),
    ).otherwise(F.array().cast("array<int>"))


def _window(w: Column, size: int):
    return lambda s: F.struct(
        s.alias("start"), (s + size).alias("end"), F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("window"),
    )


def _marks(items: DataFrame, k: int, width: int) -> DataFrame:
    """The fingerprints of the benchmark."""
    kept = let(_grams(F.col("_words"), k), lambda g: F.transform(
        F.filter(_positions(g), lambda i: _chosen(g, i, width)), lambda i: g[i],
    ))
    return items.select(F.explode(kept).alias("h"))


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
) -> DataFrame:
    """Rows _id, _row, spans, items for the documents with occurrences: start and end (in words) of each occurrence of a
    window, sorted, and the distinct ids of the items they stem from."""
    items = benchmark.select(
        F.col(item_col).alias("_item"), words(ascii_lower(F.col(item_text_col)), NOT_WORD_RUN).alias("_words"),
    ).where(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.select(length).distinct().collect())  # 13 at most
    sieves = {n: F.lit(_sieve(_marks(items.where(length == n), *_plan(n)), "h")) for n in lengths}
    windows = items.select("_item", F.explode(F.array_distinct(_windows_of("_words"))).alias("_window"))
    window_sieve = F.lit(_sieve(windows.select(F.xxhash64("_window").alias("h")), "h"))

    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def hits(w: Column) -> Column:
        found = [F.array().cast("array<struct<start:int,end:int,window:string>>")]
        for k in sorted({_plan(n)[0] for n in lengths}):
            own = [n for n in lengths if _plan(n)[0] == k]
            found.append(let(_grams(w, k), lambda g: F.concat(*[_extension(w, g, n, sieves[n], window_sieve) for n in own])))
        return F.concat(*found)

    spread = text.select(
        "_id", row_key("_text").alias("_row"),
        F.explode(let(words(ascii_lower(F.col("_text")), NOT_WORD_RUN), hits)).alias("_hit"),
    ).select("_id", "_row", "_hit.*")
    return spread.join(windows, spread["window"] == windows["_window"]).groupBy("_id", "_row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("_item").alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words that lie in any of the spans, which are sorted."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ), lambda acc: acc["n"],
    )


def _judged(docs: DataFrame, benchmark: DataFrame, least_share: int, id_col, text_col, item_col, item_text_col) -> DataFrame:
    """Per row: _id, _row and what find_contamination gives."""
    spans = benchmark_spans(
        docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col,
    ).select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "spans", "items")
    counted = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select(
        "_id", row_key("_text").alias("_row"), F.size(words(F.col("_text"), ANY_CASE_NOT_WORD_RUN)).cast("long").alias("n_words"),
    )
    no_span, no_item = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    out = counted.join(
        spans, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), "left",
    ).select(
        "_id", "_row", "n_words", F.coalesce("spans", no_span).alias("spans"),
        F.coalesce(F.sort_array(F.transform("items", lambda x: x.cast("string"))), no_item).alias("items"),
    ).withColumn("n_hit", _covered(F.col("spans")).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, least_share: int = 20, id_col="doc_id", text_col="text", item_col="item_id",
    item_text_col="text",
) -> DataFrame:
    """Per row: the id, n_words, n_hit (words inside occurrences), spans, items (sorted as strings) and contaminated.

    A window is 13 words of an item in a row, or the whole of a shorter item. A row is contaminated if some word is hit
    and least_share times n_hit reaches n_words. NULL and empty texts have no words and are clean, NULL and empty items
    have no windows, a NULL item id is left out of items, repeated rows each get a row, an empty table on either side
    leaves nothing hit. Other columns of the input are not looked at.
    """
    out = _judged(docs, benchmark, least_share, id_col, text_col, item_col, item_text_col)
    return out.withColumnRenamed("_id", id_col).drop("_row")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, least_share: int = 20, id_col="doc_id", text_col="text", item_col="item_id",
    item_text_col="text",
) -> DataFrame:
    """The rows of docs, all columns as they are, that find_contamination calls clean."""
    judged = _judged(docs, benchmark, least_share, id_col, text_col, item_col, item_text_col).where("contaminated")
    work = Workspace(docs.sparkSession, "contaminated-documents")
    bad = work.write(judged.select(F.col("_id").alias("_i"), F.col("_row").alias("_r")).distinct(), "bad")
    few = bad.count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).select(
        "_doc", F.col("_doc").getField(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col("_doc").getField(text_col), F.lit(""))).alias("_row"),
    )
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r"))
    return rows.join(F.broadcast(bad) if few else bad, same, "left_anti").select("_doc.*")


def op6_benchmark_decontamination(spark, sf_dir):
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, i, s.size FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM d)
  JOIN (SELECT DISTINCT size FROM items) s ON i + s.size - 1 <= len(w)
), hits AS (
  SELECT p.doc_id, p.i, p.size, items.item_id
  FROM (SELECT doc_id, i, size, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS win FROM places) p
  JOIN items ON items.win = p.win AND items.size = p.size
), covered AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS word FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
