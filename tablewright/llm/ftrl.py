"""Follow-the-regularised-leader for sparse logistic regression, trained in shards whose weights are averaged.

Each shard of the training sample is one group of bounded size; its task runs the updates of McMahan et al. (2013) with
an elastic-net penalty over the rows in a fixed order. The average over shards is taken by Spark; at most one row per
feature and class reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

Features = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: learning rate; l1, l2: elastic-net penalties; epochs: passes over a shard; shard_rows: rows of one."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    epochs: int = 3
    shard_rows: int = 2500


def fit_rows(rows: list[tuple[Features, int]], n_features: int, n_classes: int, set_up: Ftrl) -> np.ndarray:
    """Weights (features x classes); two classes have one column, for class 1."""
    width = 1 if n_classes == 2 else n_classes
    z, n = np.zeros((n_features, width)), np.zeros((n_features, width))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - set_up.l1, 0)
        return -shrunk / ((set_up.beta + np.sqrt(n)) / set_up.alpha + set_up.l2)

    for _ in range(set_up.epochs):
        for (at, values), label in rows:
            w = weights(z[at], n[at])
            error = chances(values @ w)
            if width == 1:
                error = error - label
            else:
                error[label] -= 1
            g = values[:, None] * error[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / set_up.alpha * w
            n[at] = grown
    return weights(z, n)


def chances(scores: np.ndarray) -> np.ndarray:
    """Class probabilities from scores: the logistic function for one column, else softmax over the last axis."""
    if scores.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def sample(keyed: DataFrame, texts: DataFrame, share: Column) -> DataFrame:
    """A part of the rows keyed (_id, _hash, _label), the hash being the text's: share of them, and not more by chance than
    a few; with their text from texts (_id, _text), and _copy.

    A row is chosen by the hash of its id and text, so rows that share an id, or have none, are chosen each for itself.
    Of m rows equal in all three, share * m are in the sample, told apart by _copy. Texts are not shuffled before they
    are chosen.
    """
    key = ["_id", "_hash", "_label"]
    luck = F.pmod(F.xxhash64("_id", "_hash", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.max(share).alias("_share")).select(
        F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_label", F.floor(F.col("_m") * F.col("_share") + luck).cast("int").alias("_times"),
    ).where("_times > 0")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))
    # About as many rows as the sample's bound; copies meet on both sides of the shuffle before one task has them.
    hashed = texts.select("_id", "_text", text_hash(F.col("_text")).alias("_hash"))
    found = hashed.join(F.broadcast(chosen), same).groupBy(key).agg(F.first("_text").alias("_text"), F.first("_times").alias("_times"))
    return found.select("_id", "_text", "_label", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))


def fit(
    sample: DataFrame, n_rows: int, features: Callable[[pa.Array], Iterable[Features]], n_features: int, n_classes: int, set_up: Ftrl,
) -> np.ndarray:
    """Train on the rows (_id, _text, _label, _copy) of a bounded sample of about n_rows: the mean of the shards' weights,
    each counted by its rows."""
    shards = max(1, -(-n_rows // set_up.shard_rows))
    dealt = sample.withColumn("_shard", F.pmod(F.xxhash64("_id", "_text", "_copy", F.lit("shard")), F.lit(shards)).cast("int"))

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort((rows["_order"].to_numpy(),)))).combine_chunks()
        texts = pa.concat_arrays(rows["_text"].chunks) if rows.num_rows else pa.array([], pa.string())
        w = fit_rows(list(zip(features(texts), rows["_label"].to_pylist())), n_features, n_classes, set_up)
        at, k = np.nonzero(w)
        # Feature -1 counts the rows.
        return pa.table({
            "feature": pa.array(np.append(at, -1), pa.int32()), "k": pa.array(np.append(k, 0), pa.int32()),
            "w": np.append(w[at, k] * rows.num_rows, rows.num_rows),
        })

    ordered = dealt.withColumn("_order", F.xxhash64("_id", F.lit("order"), "_text", "_copy"))
    found = ordered.groupBy("_shard").applyInArrow(shard, "feature int, k int, w double")
    out, seen = np.zeros((n_features, 1 if n_classes == 2 else n_classes)), 0.0
    for r in found.groupBy("feature", "k").agg(F.sum("w").alias("w")).collect():
        if r["feature"] < 0:
            seen = r["w"]
        else:
            out[r["feature"], r["k"]] = r["w"]
    return out / max(seen, 1.0)
