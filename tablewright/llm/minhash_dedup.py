"""Near-duplicate documents: MinHash bands find candidates, Bayesian pruning drops most, full sets confirm the rest.

Rows with one shingle set are one node (its smallest id). In every band bucket all nodes are compared with one hub, not
with each other; links found so are joined into components. A bucket whose nodes are in one component is done, in the
others the best-linked node is the next hub. What is still apart then is compared block by block across components,
inside the tasks, so that only links leave them. Pairs are pruned by batches of signature positions: once the posterior chance that the similarity reaches
the threshold falls below `miss`, the pair is dropped. What survives is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import Workspace, table
from .wordcodes import gram_codes, mix, pieces, text_blocks, word_codes, word_places

#: Signature: bands x rows positions. A pair of similarity 0.8 shares no band once in 300,000 times.
BANDS, ROWS = 32, 5
BATCH = 32
HUB_ROUNDS = 2
#: Nodes a hub meets in one group, and nodes in a block of a bucket that is compared pair by pair.
SPREAD = 256
#: Ids up to which a counted list is broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000

_N = BANDS * ROWS
_A = mix(np.arange(1, _N + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, _N + 1001, dtype=np.uint64))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct k-word shingles of each text, as sorted 64-bit codes; all words as one where there are fewer."""
    for _, _, data, offsets in text_blocks(texts):
        starts, ends, at = word_places(data, offsets)
        codes = word_codes(data, starts, ends)
        grams = gram_codes(codes, k)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= k:
                yield np.unique(grams[a: b - k + 1])
            elif b > a:
                yield gram_codes(codes[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        some = shingles[at: at + 4096]
        for i in range(0, _N, 16):
            hashed = (some[:, None] * _A[i: i + 16] + _B[i: i + 16]) >> np.uint64(32)
            out[i: i + 16] = np.minimum(out[i: i + 16], hashed.min(axis=0).astype(np.uint32))
    return out


SIGNED = "_id long, n_shingles long, digest binary, sig binary"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, digests, sigs = [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                names=["_id", "n_shingles", "digest", "sig"],
            )
    return run


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch of positions compared: the fewest matches at which the similarity may still reach the threshold.

    The prior is uniform, so after m of n matches the similarity is Beta(m + 1, n - m + 1); its chance to be at least t
    is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, _N + 1, BATCH):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append(m)
    return out


def _by_signature(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def alike(a: bytes, b: bytes) -> bool:
        return bool(_likely(np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)[None, :], least)[0])

    return alike


def _likely(equal: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of equal signature positions stay after every batch."""
    alive, matches = np.ones(len(equal), bool), np.zeros(len(equal), np.int64)
    for i, need in enumerate(least):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        matches[at] += equal[at, i * BATCH: (i + 1) * BATCH].sum(axis=1)
        alive[at] = matches[at] >= need
    return alive


def _by_sets(percent: int):
    def alike(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        common = len(x) + len(y) - len(np.union1d(x, y))
        return 100 * common >= percent * (len(x) + len(y) - common)

    return alike


def _compare(pairs: DataFrame, payload: DataFrame, alike) -> DataFrame:
    """The pairs (hub, node) whose payloads are alike.

    A hub's row goes once to each group of at most about SPREAD of its nodes, and the groups are streamed one node at a
    time, so neither a hub with many nodes nor large payloads gather in one task.
    """
    groups = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("_groups"))
    hubs = groups.select("hub", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group")).select(
        "hub", "_group", F.col("hub").alias("_id"), F.lit(0).alias("_role"),
    )
    nodes = pairs.join(groups, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), F.col("_groups")).cast("int").alias("_group"), F.col("node").alias("_id"), F.lit(1).alias("_role"),
    )
    rows = hubs.unionByName(nodes).join(payload, "_id").repartition("hub", "_group").sortWithinPartitions("hub", "_group", "_role")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in pieces(batches):
            hubs, nodes = [], []
            for hub, g, role, node, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (hub, g) != group:
                    group, own = (hub, g), []
                if role == 0:
                    own.append(data)
                elif any(alike(x, data) for x in own):
                    hubs.append(hub)
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64())], names=["hub", "node"])

    return rows.select("hub", "_group", "_role", "_id", "data").mapInArrow(stream, "hub long, node long").distinct()


def connect(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Rows node, comp: the smallest node reachable over the links (hub, node), for all nodes that have one.

    Every round each node takes the smallest label around it and then the label of its label, until none changes; each
    round's table is written to the shared folder.
    """
    edges = work.write(
        links.select(F.col("hub").alias("a"), F.col("node").alias("b")).union(links.select("node", "hub")).distinct(), f"{name}-edges",
    )
    labels = work.write(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), f"{name}-0")
    turn = 0
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"),
        )
        over = least.select(F.col("node").alias("_of"), F.col("comp").alias("_further"))
        new = least.join(over, least["comp"] == over["_of"], "left").select(
            "node", "old", F.least("comp", F.coalesce("_further", "comp")).alias("comp"),
        )
        turn += 1
        new = work.write(new, f"{name}-{turn}")
        changed = new.where(F.col("comp") != F.col("old")).limit(1).count()
        labels = new.select("node", "comp")
        work.drop(f"{name}-{turn - 1}")
        if not changed:
            return labels


def _listed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose _id is in ids: by broadcast if the counted list is small, else by a shuffled join."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "_id", "left_semi")


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id reachable over links) and kept (id = component_id).

    A row's set are its distinct shingles of that many words (A-Z lower-cased, split at white space); a shorter text is
    one shingle, a NULL or empty one has none and links with nothing. Rows are linked if the sets' overlap is at least
    percent of their union. Rows with equal sets are one node, so repeated rows get one component; rows that repeat an
    id are one vertex with the links of each of its texts. A row with a NULL id is linked with nothing, has no
    component and is kept. Other columns are not looked at; an empty table gives an empty result.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "near-duplicates")
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = work.write(source.mapInArrow(_sign(shingle), SIGNED), "signed")
    usable = signed.where(F.col("_id").isNotNull() & F.col("digest").isNotNull())
    first = usable.groupBy("digest").agg(F.min("_id").alias("_id"))
    # One row for each different set: the row of its smallest id.
    nodes = work.write(usable.join(first, ["digest", "_id"]).select("_id", "sig").distinct(), "nodes")

    width = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(BANDS)])
    members = nodes.select(F.col("_id").alias("node"), F.posexplode(bands).alias("at", "band"))
    shared = members.groupBy("band").agg(F.count_distinct("node").alias("_n")).where("_n > 1").select("band")
    members = work.write(members.join(shared, "band"), "members")
    payload = _listed(nodes, members.select(F.col("node").alias("_id")).distinct()).select("_id", F.col("sig").alias("data"))

    def sets(ids: DataFrame) -> DataFrame:
        def run(batches):
            for batch in pieces(batches):
                data = [s.tobytes() for s in shingle_sets(batch.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["_id", "data"])
        return _listed(source, ids).mapInArrow(run, "_id long, data binary")

    alike, same = _by_signature(percent / 100, miss), _by_sets(percent)
    tested, links, labels, degrees = None, None, None, None
    for turn in range(HUB_ROUNDS + 1):
        placed = members.withColumn("comp", F.col("node")).withColumn("degree", F.lit(0))
        if labels is not None:
            placed = members.join(labels, "node", "left").join(degrees, "node", "left").select(
                "band", "at", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree"),
            )
        buckets = placed.groupBy("band").agg(
            F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_size"),
            F.max_by(F.struct("node", "comp"), F.struct("degree", -F.col("node"))).alias("_hub"),
        ).where("_low < _high")
        if turn == HUB_ROUNDS:
            apart = work.write(placed.join(buckets.select("band", "_size"), "band").where("_size > 2"), "apart")
            wanted = apart.select(F.col("node").alias("_id")).distinct()
            data = nodes.join(sets(wanted), "_id").select(F.col("_id").alias("node"), "sig", "data")
            found = _across(apart.join(data, "node"), least_matches(percent / 100, miss), same)
        else:
            pairs = placed.join(buckets, "band").where(F.col("comp") != F.col("_hub.comp")).select(F.col("_hub.node").alias("hub"), "node")
            pairs = pairs.select(F.least("hub", "node").alias("_x"), F.greatest("hub", "node").alias("_y"), "hub", "node")
            pairs = pairs.groupBy("_x", "_y").agg(F.min_by(F.struct("hub", "node"), "hub").alias("_p")).select("_x", "_y", "_p.*")
            if turn:
                pairs = pairs.join(tested, ["_x", "_y"], "left_anti")
            pairs = work.write(pairs.select("hub", "node", "_x", "_y"), f"pairs-{turn}")
            tested = pairs.select("_x", "_y") if turn == 0 else tested.union(pairs.select("_x", "_y"))
            likely = work.write(_compare(pairs.select("hub", "node"), payload, alike), f"likely-{turn}")
            wanted = likely.select(F.col("hub").alias("_id")).union(likely.select("node")).distinct()
            found = _compare(likely, sets(wanted), same)
        found = work.write(found, f"links-{turn}")
        if turn and found.limit(1).count() == 0:
            continue
        links = found if turn == 0 else links.union(found)
        labels = connect(links, work, f"labels-{turn}")
        ends = links.select("hub").union(links.select("node")).toDF("node")
        degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))

    # Members of one set take their node's component; an id that stands for several sets joins them all.
    owned = usable.select("_id", "digest").join(first.withColumnRenamed("_id", "node"), "digest")
    owned = owned.join(labels, "node", "left").select("_id", F.coalesce("comp", "node").alias("comp"))
    owned = owned.groupBy("_id").agg(F.min("comp").alias("comp"))
    component = F.coalesce("comp", "_id")
    return signed.select("_id", "n_shingles").join(owned, "_id", "left").select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without near duplicates: of each component the smallest id stays, and
    of rows that repeat an id one. Rows with a NULL id all stay."""
    judged = near_duplicates(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col)
    per_id = judged.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"),
    )
    work = Workspace(docs.sparkSession, "kept-documents")
    odd = work.write(per_id.where(~F.col("_kept") | (F.col("_n") > 1)), "odd")
    few = odd.count() <= BROADCAST_IDS
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_doc"), F.col(id_col).cast("long").alias("_id"))
    marked = rows.join(F.broadcast(odd) if few else odd, "_id", "left")
    single = marked.where(F.col("_n").isNull())
    repeated = marked.where(F.col("_kept") & (F.col("_n") > 1)).groupBy("_id").agg(F.min("_doc").alias("_doc"))
    return single.select("_doc").union(repeated.select("_doc")).select("_doc.*")


def _across(placed: DataFrame, least: list[int], same) -> DataFrame:
    """Links between nodes of one bucket that are in different components, enough of them to join all that belong together.

    Large buckets are cut into blocks, and every two blocks meet in one group. A pair is looked at in the first band it
    shares, pruned by its signature positions and confirmed on the sets; pairs that links of the group have joined
    already are passed over.
    """
    blocks = F.ceil(F.col("_size") / SPREAD).cast("int")
    rows = placed.withColumn("_block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "band", F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"), "_block", "at", "node", "comp", "sig", "data",
    ).repartition("band", "_x", "_y").sortWithinPartitions("band", "_x", "_y", "node")

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        parent = {r[6]: r[6] for r in rows}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(parent) < 2:
            return []
        sigs = np.frombuffer(b"".join(r[7] for r in rows), np.uint32).reshape(len(rows), _N)
        comps, block = np.array([r[6] for r in rows]), np.array([r[3] for r in rows])
        out = []
        for i, (_, x, y, own, at, node, comp, _, data) in enumerate(rows[:-1]):
            later = np.arange(i + 1, len(rows))
            later = later[(comps[later] != comp) & ((x == y) | (block[later] != own))]
            if not len(later):
                continue
            equal = sigs[later] == sigs[i]
            first = equal.reshape(len(later), BANDS, ROWS).all(axis=2).argmax(axis=1) == at
            later, equal = later[first], equal[first]
            for j in later[_likely(equal, least)]:
                if root(comp) != root(rows[j][6]) and same(data, rows[j][8]):
                    parent[root(comp)] = root(rows[j][6])
                    out.append((node, rows[j][5]))
        return out

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["hub", "node"])

        group = []
        for batch in pieces(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if group and row[:3] != group[0][:3]:
                    yield made(links(group))
                    group = []
                group.append(row)
        if group:
            yield made(links(group))

    return rows.mapInArrow(stream, "hub long, node long").distinct()


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
