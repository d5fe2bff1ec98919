"""A mix of sources at target weights, as exact block quotas split over output shards.

Documents fall into blocks of their source by hash, so a source of any size is dealt out evenly. A source's target
says how many of its blocks the mix takes: all of them once or twice, the first ones of the permuted order once more,
and a part of one block; what that block cannot fill comes from the blocks after it, document by document. A splitting
tree shares these quotas out: at every node the blocks of all sources that go to the left half of the shards are one
multivariate hypergeometric draw. Each shard takes its run of every source's permuted blocks and shuffles locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import Workspace, table

#: Parameters: words a block aims at, blocks of the whole corpus at most (they grow instead; each source has one at
#: least), and words an output shard aims at, with the most shards.
BLOCK_WORDS = 100_000
MOST_BLOCKS = 200_000
SHARD_WORDS = 2_000_000
MOST_SHARDS = 65_536
#: Sources up to which their figures are broadcast; beyond, joins shuffle and AQE splits hot sources.
BROADCAST_SOURCES = 100_000
#: Blocks, or documents taken one by one, up to which their list is broadcast (about 50 bytes each).
BROADCAST_ROWS = 300_000
#: Sources in one splitting tree.
GROUP_SOURCES = 50_000
#: Tasks that an output shard is shuffled in, each a slice of its order.
SLICES = 16
#: Words that a source with further blocks may miss before documents of these are looked at.
SMALL_GAP = 100
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 7


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (_source, _size): one row per source with source_size, target and weight.

    Sources by code point, NULL last, weigh `weights` in turn and share `share` times all words. A target stops at
    `most` times its source; what is above goes to the others by weight. With sources sorted by most * size / weight,
    a common level x gives each min(weight * x, most * size): the sources below the level are those that stop.
    """
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    # One row per source from here on.
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    weighed = sources.withColumn("_place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")),
    ).withColumn("_stop", most * F.col("source_size")).withColumn("_level", F.col("_stop") / F.col("weight"))
    order = Window.orderBy("_level", "_place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))
    level = weighed.withColumn("_x", left / F.sum("weight").over(rest))
    # The first source that its level does not reach sets the level of all that follow; later ones give less.
    level = level.withColumn("_x", F.max(F.when(F.col("_x") < F.col("_level"), F.col("_x"))).over(everything))
    return level.select(
        "_source", "source_size", "weight",
        F.least(F.col("_stop"), F.coalesce(F.col("weight") * F.col("_x"), F.col("_stop"))).alias("target"),
    )


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, first, last): which run of each source's permuted blocks every shard takes.

    The splitting tree is walked once, from all shards down to each; a node looks only at the sources that still have
    blocks there, and draws with its own seed. Quotas are exact at every node.
    """
    some = np.flatnonzero(quotas)
    nodes = [(0, shards, 1, some, quotas[some].astype(np.int64), np.zeros(len(some), np.int64))]
    while nodes:
        low, high, node, some, here, before = nodes.pop()
        if not len(some):
            continue
        if high - low == 1:
            yield low, some, before, before + here
            continue
        middle, total = (low + high) // 2, int(here.sum())
        rng = np.random.default_rng([seed, node])
        left = rng.multivariate_hypergeometric(here, total * (middle - low) // (high - low), method="marginals")
        for x, y, k, part, start in ((middle, high, 2 * node + 1, here - left, before + left), (low, middle, 2 * node, left, before)):
            kept = part > 0
            nodes.append((x, y, k, some[kept], part[kept], start[kept]))


def plan_mix(
    sizes: DataFrame, targets: DataFrame, work: Workspace, *, seed: int = SEED, shards: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The blocks taken, (_source, _block, _copy, _shard), and the documents taken one by one,
    (_id, _row, _copy, _shard). Targets have _blocks (see `with_blocks`)."""
    if shards is None:
        taken_words = targets.agg(F.sum("target")).first()[0] or 0
        shards = int(min(MOST_SHARDS, max(1, -(-taken_words // SHARD_WORDS))))
    docs = blocked(sizes, targets, seed)
    per_block = docs.groupBy("_source", "_block").agg(F.sum("_size").alias("_words"))
    same = targets.select(F.col("_source").alias("_s"), "source_size", "target", "_blocks")
    joined = per_block.join(_small(same), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    order = Window.partitionBy("_source").orderBy("_block")
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    rest = F.col("target") - whole * F.col("source_size")
    upto = F.sum("_words").over(order)
    marked = joined.select(
        "_source", "_block", "_words", whole.alias("_whole"), rest.alias("_rest"), upto.alias("_upto"),
        F.row_number().over(order).alias("_number"), F.count(F.lit(1)).over(Window.partitionBy("_source")).alias("_count"),
    ).withColumn("_full", F.col("_upto") <= F.col("_rest")).withColumn(
        "_part", ~F.col("_full") & (F.col("_upto") - F.col("_words") < F.col("_rest")),
    )
    marked = work.write(marked, "blocks")
    # A taken block is one place in its source's permuted order: the copies of whole passes first, then the last pass.
    taken = marked.withColumn("_copies", F.col("_whole") + (F.col("_full") | F.col("_part")).cast("int")).where("_copies > 0")
    taken = taken.select("_source", "_block", "_whole", "_part", "_rest", "_upto", "_words", "_number", "_count", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    taken = taken.withColumn("_at", (F.col("_copy") - 1) * F.col("_count") + F.col("_number") - 1)
    # Sources are dealt to groups by hash; each group has a splitting tree of its own, and a row per source.
    groups = max(1, -(-targets.count() // GROUP_SOURCES))
    quotas = marked.groupBy("_source").agg(
        F.sum(F.col("_whole") + (F.col("_full") | F.col("_part")).cast("int")).alias("_quota"),
    ).withColumn("_group", F.pmod(F.xxhash64("_source"), F.lit(groups)).cast("int"))

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        # By code point, NULL first: the same order in every run.
        rows = rows.sort_values("_source", na_position="first", ignore_index=True)
        parts = [pd.DataFrame({"_s": [], "_from": [], "_to": [], "_shard": []})]
        for shard, some, first, last in split_quotas(rows["_quota"].to_numpy(), shards, seed + int(rows["_group"].iloc[0])):
            parts.append(pd.DataFrame({"_s": rows["_source"].to_numpy()[some], "_from": first, "_to": last, "_shard": shard}))
        return pd.concat(parts)

    ranges = quotas.groupBy("_group").applyInPandas(runs, "_s string, _from long, _to long, _shard int")
    places = ranges.select("_s", "_shard", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_a"))
    dealt = taken.join(places, taken["_source"].eqNullSafe(places["_s"]) & (taken["_at"] == places["_a"])).drop("_s", "_a")
    dealt = work.write(dealt, "dealt")
    partly = dealt.where(F.col("_part") & (F.col("_copy") == F.col("_whole") + 1))
    edge = partly.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_copy", "_shard", (F.col("_rest") - F.col("_upto") + F.col("_words")).alias("_want"))
    return (
        dealt.where(~F.col("_part") | (F.col("_copy") <= F.col("_whole"))).select("_source", "_block", "_copy", "_shard"),
        _fill_up(docs, edge, work),
    )


def _fill_up(docs: DataFrame, edge: DataFrame, work: Workspace) -> DataFrame:
    """The documents, (_id, _row, _copy, _shard), that fill what is wanted of each source's last pass beyond whole blocks.

    The part block comes first. While a source misses more than a small document, the blocks after it give documents of
    at most half the gap, as many blocks as hold half of it; so every round halves the gap or has seen all blocks, and
    what it passes over is too long for what is left. At last the one unused document that comes nearest is added, if
    it comes nearer than none.
    """
    few = docs.join(_small(edge), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") >= F.col("_b"))).where("_size > 0")
    unused = work.write(few.groupBy("_source", "_block", "_id", "_row").agg(
        F.sum("_size").alias("_size"), *[F.first(c).alias(c) for c in ("_order", "_copy", "_shard", "_b", "_want")],
    ), "edge")
    id_type = dict(unused.dtypes)["_id"]
    schema = f"_source string, _id {id_type}, _row long, _copy int, _shard int, _size long"
    first = unused.where(F.col("_block") == F.col("_b")).drop("_b")
    picked = work.write(first.groupBy("_source").applyInPandas(_fill, schema), "picked-0")
    gaps = edge.select(F.col("_s").alias("_source"), F.col("_want").cast("double").alias("_gap"), F.col("_b").cast("long").alias("_seen"))
    rounds, new = [picked], picked
    while True:
        filled = new.groupBy(F.col("_source").alias("_f")).agg(F.sum("_size").alias("_filled"))
        gaps = gaps.join(filled, F.col("_source").eqNullSafe(F.col("_f")), "left")
        gaps = work.write(gaps.select("_source", (F.col("_gap") - F.coalesce("_filled", F.lit(0))).alias("_gap"), "_seen"), f"gaps-{len(rounds)}")
        active = gaps.where((F.col("_gap") > SMALL_GAP) & F.col("_seen").isNotNull()).withColumnRenamed("_source", "_s")
        if active.isEmpty():
            break
        open_ = unused.drop("_b", "_want").join(
            _small(active), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") > F.col("_seen")) & (2 * F.col("_size") <= F.col("_gap")),
        )
        # One row per block.
        order = Window.partitionBy("_s").orderBy("_e")
        ends = open_.groupBy("_s", F.col("_block").alias("_e"), "_gap").agg(F.sum("_size").alias("_words"))
        ends = ends.withColumn("_upto", F.sum("_words").over(order)).where(2 * (F.col("_upto") - F.col("_words")) < F.col("_gap"))
        # All blocks are seen where those left hold less than half the gap: _last is NULL then.
        ends = work.write(ends.groupBy("_s").agg(
            F.max("_e").alias("_end"), F.max(F.when(2 * F.col("_upto") >= F.col("_gap"), F.col("_e"))).alias("_last"),
        ), f"ends-{len(rounds)}")
        taken = open_.drop("_s").join(_small(ends), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") <= F.col("_end")))
        taken = taken.select("_source", "_id", "_row", "_copy", "_shard", "_block", "_order", "_size", F.col("_gap").alias("_want"))
        new = work.write(taken.groupBy("_source").applyInPandas(_fill, schema), f"picked-{len(rounds)}")
        rounds.append(new)
        seen = gaps.join(_small(ends), F.col("_source").eqNullSafe(F.col("_s")), "left")
        gaps = seen.select("_source", "_gap", F.col("_last").alias("_seen"))
    for more in rounds[1:]:
        picked = picked.unionByName(more)
    used = picked.select(F.col("_source").alias("_s"), F.col("_id").alias("_i"), F.col("_row").alias("_r"))
    same = F.col("_source").eqNullSafe(F.col("_s")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r"))
    short = gaps.where("_gap > 0").select(F.col("_source").alias("_g"), "_gap")
    near = unused.join(_small(short), F.col("_source").eqNullSafe(F.col("_g"))).where(F.col("_size") < 2 * F.col("_gap"))
    near = near.join(used, same, "left_anti").groupBy("_source").agg(F.min_by(
        F.struct("_id", "_row", "_copy", "_shard"), F.struct(F.abs(F.col("_size") - F.col("_gap")), "_block", "_order", "_id", "_row"),
    ).alias("_one"))
    columns = ["_id", "_row", "_copy", "_shard"]
    return work.write(picked.select(*columns).unionByName(near.select("_one.*")), "picked")


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    """Of one source's documents, in permuted order, those that still fit into the words wanted."""
    docs = docs.sort_values(["_block", "_order", "_id", "_row"])
    left, chosen = docs["_want"].iloc[0], []
    for size in docs["_size"]:
        chosen.append(bool(size <= left))
        left -= size if chosen[-1] else 0
    return docs[chosen][["_source", "_id", "_row", "_copy", "_shard", "_size"]]


def _small(rows: DataFrame, most: int = BROADCAST_SOURCES) -> DataFrame:
    """A table, broadcast if it is counted to be small (most are a row per source); beyond, the join shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


def with_blocks(targets: DataFrame, *, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Adds _blocks, how many blocks a source has; their sum is at most most_blocks and one per source."""
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    words = max(block_words, total / most_blocks)
    return targets.withColumn("_blocks", F.greatest(F.ceil(F.col("source_size") / words), F.lit(1)).cast("long"))


def blocked(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Adds each document's _block in its source and its place _order in the block; both by hash."""
    counts = targets.select(F.col("_source").alias("_s"), "_blocks")
    joined = sizes.join(_small(counts), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    order = F.xxhash64(F.lit(seed), "_id", "_row")
    return joined.withColumn("_order", order).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_blocks")))


def _row(text: Column, source: Column) -> Column:
    """What tells rows of one id apart: text and source. Rows equal in all three are taken together."""
    source = source.cast("string")
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull(), F.coalesce(source, F.lit("")), source.isNull()).alias("_row")


def document_sizes(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """_id, _row, _source and _size, the number of words of the whole text (NULL: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"), _row(F.col(text_col), F.col(source_col)), F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_size"),
    )


def _prepared(docs: DataFrame, name: str, id_col: str, text_col: str, source_col: str, weights, share: float, most: float, seed: int):
    work = Workspace(docs.sparkSession, name)
    sizes = work.write(document_sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col), "sizes")
    targets = work.write(with_blocks(source_targets(sizes, weights=weights, share=share, most=most)), "targets")
    return sizes, targets, *plan_mix(sizes, targets, work, seed=seed)


def mix_report(
    docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED, id_col="doc_id", text_col="text",
    source_col="source",
) -> DataFrame:
    """Per row: the id, size, source_size, target (its source's) and taken (words the mix takes, repeats counted).

    A NULL source is a source of its own, after all others. NULL and empty texts have size 0. Rows that repeat an id,
    a text and a source are taken together; one document in several sources is a document of each. Other columns are not looked at; an empty table gives an empty result.
    """
    sizes, targets, blocks, picked = _prepared(docs, "mix", id_col, text_col, source_col, weights, share, most, seed)
    placed = blocked(sizes, targets, seed)
    per_block = blocks.groupBy(F.col("_source").alias("_s"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    per_doc = picked.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.count(F.lit(1)).alias("_m"))
    figures = targets.select(F.col("_source").alias("_t"), "source_size", "target")
    out = placed.join(_small(per_block, BROADCAST_ROWS), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    out = out.join(_small(per_doc, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    out = out.join(_small(figures), F.col("_source").eqNullSafe(F.col("_t")))
    copies = F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken"),
        F.col("_source").alias(source_col),
    )


def mix(
    docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED, id_col="doc_id", text_col="text",
    source_col="source",
) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, dealt to the shards and shuffled in each.

    All columns stay as they are. The cases of `mix_report` hold; a rerun gives the same rows.
    """
    _, targets, blocks, picked = _prepared(docs, "mix", id_col, text_col, source_col, weights, share, most, seed)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")).select(
        "_doc", F.col(f"_doc.{id_col}").alias("_id"), _row(F.col(f"_doc.{text_col}"), F.col(f"_doc.{source_col}")),
        F.col(f"_doc.{source_col}").cast("string").alias("_source"),
    )
    placed = blocked(rows, targets, seed)
    whole = blocks.groupBy(F.col("_source").alias("_s"), F.col("_block").alias("_b")).agg(F.collect_list(F.struct("_copy", "_shard")).alias("_w"))
    single = picked.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_list(F.struct("_copy", "_shard")).alias("_p"))
    out = placed.join(_small(whole, BROADCAST_ROWS), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    out = out.join(_small(single, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    none = F.array().cast("array<struct<_copy:int,_shard:int>>")
    taken = out.select("_doc", "_order", F.explode(F.concat(F.coalesce("_w", none), F.coalesce("_p", none))).alias("_take"))
    shuffled = taken.select("_doc", F.col("_take._shard").alias("_shard"), F.xxhash64("_order", "_take._copy").alias("_at"))
    # A shard's order is cut into slices, so that it is not one task; slice after slice is the whole order.
    sliced = shuffled.withColumn("_slice", F.floor((F.col("_at") / 2.0**63 + 1) / 2 * SLICES).cast("int"))
    return sliced.repartition("_shard", "_slice").sortWithinPartitions("_shard", "_slice", "_at").select("_doc.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
