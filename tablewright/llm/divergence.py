"""How far the sources of a language differ in their words: distances of all pairs, and the words that stand out.

Terms are counted by sorting pointers. In each shard (a block of texts inside a task) the starts of all terms are
pointers into the Arrow buffer; they are ordered by language and source, then by the bytes they point at, eight bytes at
a time (multikey sorting with slices of eight bytes as characters: equal runs are refined by their next slice until the
terms end). A run of equal pointers is a term: its length is the count, the documents it points into the frequency.
Spark sums the runs of all shards. Distances are added up over blocks of terms and tiles of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import Workspace, table
from .subwords import ragged
from .wordcodes import text_blocks

#: Fixed values of the contract: documents of a language that hold a kept term, and what smooths its share.
LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50

#: Parameters: bytes of texts in a shard; terms and sources in a block of the distances.
SHARD_BYTES = 8 << 20
BLOCK_TERMS = 2048
TILE_SOURCES = 128

#: Signs of terms: everything but ASCII, and in ASCII the letters.
_inside = np.zeros(256, bool)
_inside[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: What keeps the first n bytes of a slice.
_mask = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9))], np.uint64)


def term_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every term; a term ends with its text."""
    inside = _inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): pointers ordered by shard and then by the bytes they point at, and which begin a run of equal ones.
    Equal pointers keep their order."""
    order = np.argsort(shard, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = shard[order][1:] != shard[order][:-1]
    slices = np.ndarray((len(data),), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at, level = np.arange(len(order)), 0
    while len(at):
        pointers = order[at]
        left = np.minimum(lengths[pointers] - 8 * level, 8)
        key = slices[np.minimum(starts[pointers] + 8 * level, len(data) - 1)].astype(np.uint64) & _mask[left]
        run = np.cumsum(head)[at]
        if level:
            by = np.lexsort((key, run))
        else:
            bounds = np.append(np.flatnonzero(head), len(order))
            by = np.concatenate([a + np.argsort(key[a:b], kind="stable") for a, b in zip(bounds[:-1], bounds[1:])])
        order[at], key, left = pointers[by], key[by], left[by]
        head[at[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
        # Runs whose slice is full may go on; a term that ends there has an empty next slice and comes first.
        at, level = at[left == 8], level + 1
    return order, head


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, documents) of each shard; every group also has a row for the empty term."""
    for batch in batches:
        langs, sources = (batch.column(i).fill_null("").dictionary_encode() for i in (1, 2))
        pair = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
        groups, group = np.unique(pair, return_inverse=True)
        names = [
            langs.dictionary.take(pa.array(groups // max(len(sources.dictionary), 1))),
            sources.dictionary.take(pa.array(groups % max(len(sources.dictionary), 1))),
        ]
        n = len(groups)
        yield _batch([*names, pa.array([b""] * n, pa.binary()), np.zeros(n, np.int64), np.zeros(n, np.int64)])
        for first, _, data, offsets in text_blocks(batch.column(0), SHARD_BYTES):
            starts, ends = term_places(data, offsets)
            if not len(starts):
                continue
            data = _lower[data]
            lengths, row = ends - starts, np.searchsorted(offsets, starts, "right") - 1
            # Several empty texts share an offset; the last of them is the text that begins there.
            order, head = pointer_sort(data, starts, lengths, group[first + row])
            at, docs = np.flatnonzero(head), row[order]
            new = head.copy()
            new[1:] |= docs[1:] != docs[:-1]
            one = order[at]
            terms = data[ragged(starts[one], lengths[one])]
            bounds = np.concatenate([[0], np.cumsum(lengths[one])]).astype(np.int32)
            shard = pa.array(group[first + row[one]])
            yield _batch([
                names[0].take(shard), names[1].take(shard),
                pa.BinaryArray.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(bounds), pa.py_buffer(terms)]),
                np.diff(np.append(at, len(order))), np.add.reduceat(new.astype(np.int64), at),
            ])


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[0].cast(pa.string()), columns[1].cast(pa.string()), columns[2], *(pa.array(c, pa.int64()) for c in columns[3:])],
        names=["lang", "source", "term", "n", "documents"],
    )


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, documents) over all texts; every (lang, source) has a row for the empty term."""
    some = docs.select(*[F.col(c).cast("string").alias(a) for c, a in ((text_col, "_text"), (lang_col, "_lang"), (source_col, "_source"))])
    runs = some.mapInArrow(_runs, "lang string, source string, term binary, n long, documents long")
    summed = runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return summed.withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) without rounding, also where the product exceeds 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    below = (total + SMOOTH * kept).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, below)


def _distances(key: tuple, rows: pa.Table) -> pa.Table:
    """Distances of the sources of two tiles over one block of terms; key: lang, tile, other tile, block.

    Rows without a term name the sources: base is the share of a term that a source lacks. Terms that no source here has
    are in no row; block 0 counts them all, and every block takes off those that it has seen.
    """
    _, tile, other, block = (k.as_py() for k in key)
    named = rows.filter(pc.is_null(rows["term"]))
    base, kept = named["base"].to_numpy(), int(named["kept"][0].as_py())
    tiles, index = named["tile"].to_numpy(), {s: i for i, s in enumerate(named["source"].to_pylist())}
    used = rows.filter(pc.is_valid(rows["term"]))
    terms = used["term"].combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    shares = np.repeat(base[None, :], len(terms.dictionary), axis=0)
    shares[terms.indices.to_numpy(), [index[s] for s in used["source"].to_pylist()]] = used["p"].to_numpy()
    a, b = np.flatnonzero(tiles == tile), np.flatnonzero(tiles == other)
    names, found = named["source"].combine_chunks(), [[], [], []]
    times = (kept if block == 0 else 0) - len(terms.dictionary)
    for i in a:
        far = b[b != i]
        value = np.abs(shares[:, far] - shares[:, i: i + 1]).sum(axis=0) + times * np.abs(base[far] - base[i])
        for to, x in zip(found, (np.full(len(far), i), far, value)):
            to.append(x)
    i, j, value = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in found)
    if tile != other:
        i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
    n = len(i)
    return pa.table({
        "lang": pa.array([key[0].as_py()] * n, pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": value,
    })


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS, tile_sources: int = TILE_SOURCES, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language (part `pair`) and the terms
    more frequent than in the language (part `term`, ranks to top).

    NULL texts, languages and sources are ''. Every (lang, source) has its pairs, also without terms; one alone in its
    language has none. Repeated rows are documents of their own; ties are ordered by the item's bytes. An empty table
    gives an empty result. Other columns are not looked at.
    """
    work = Workspace(docs.sparkSession, "divergence")
    counts = work.write(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "counts")
    in_lang = counts.where(F.col("term") != "").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("documents").alias("_documents"))
    kept = in_lang.where(F.col("_documents") >= least).drop("_documents")
    used = work.write(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "used")
    per_lang = used.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"),
    )
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = counts.where(F.col("term") == "").select("lang", "source").join(per_lang, "lang", "left").join(totals, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    sources = sources.select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("kept", "lang_total", "total")],
        F.count("*").over(Window.partitionBy("lang")).alias("n_sources"),
    )
    base = F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).otherwise(zero)
    tiles = F.ceil(F.col("n_sources") / tile_sources).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)).cast("long")
    sources = work.write(sources.select(
        "*", base.alias("base"), tiles.alias("tiles"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), tiles).alias("tile"),
    ), "sources")

    of_source = sources.select("lang", "source", "kept", "total", "lang_total", "base", "tiles", "blocks", "tile")
    shares = used.join(of_source, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    rows = shares.select("lang", "source", "term", "p", "base", "kept", "tile", "tiles", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    names = of_source.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "base", "kept", "tile", "tiles",
        F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"),
    )
    # A tile meets every tile: as the first of the two where its number is not above, else as the second.
    met = rows.union(names).withColumn("_with", F.explode(F.sequence(zero, F.col("tiles") - 1))).withColumns({
        "_a": F.least("tile", "_with"), "_b": F.greatest("tile", "_with"),
    })
    parts = met.select("lang", "_a", "_b", "block", "source", "term", "p", "base", "kept", "tile").groupBy("lang", "_a", "_b", "block").applyInArrow(
        _distances, "lang string, source string, item string, value long",
    )
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    terms = shares.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where(F.col("value") > 0)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
), k AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (in_lang + 5)) // (total + 5 * v) AS q
  FROM (SELECT dense.*, v.v, v.n AS total FROM dense JOIN v USING (lang))
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 50
"""
