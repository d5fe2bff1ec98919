"""Text quality by logistic regression on hashed word n-grams.

Words give features in two spellings: as they are (lower-cased), and as their shape (case, digits, signs at the end,
repeats of the words before). Single words and pairs of both are hashed into one table of weights; a text's score is
the sparse dot product of its damped counts with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ftrl import Ftrl, chances, fit, sample, text_hash
from .wordcodes import gram_codes, mix, pieces, text_blocks, word_codes, word_places

#: Parameters: hashed features, and labelled rows that training looks at (chosen by hash of id and text).
BITS = 18
SAMPLE_ROWS = 20_000

_UPPER, _LOWER, _DIGIT, _SIGN = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def word_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for the look of each word; first: the number of each word's text's first word."""
    after_c3 = np.concatenate([[False], data[:-1] == 0xC3])
    latin = after_c3 & (data >= 0x80)
    upper = _UPPER[data] + (latin & (data < 0x9F))
    lower = _LOWER[data] + (latin & (data >= 0x9F))

    def count(per_byte: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(per_byte)])
        return sums[ends] - sums[starts]

    n_upper, n_lower, n_digit, n_sign = count(upper), count(lower), count(_DIGIT[data]), count(_SIGN[data])
    case = np.select(
        [n_upper + n_lower == 0, n_upper == 0, (n_lower == 0) & (n_upper > 1), n_upper == 1], [0, 1, 3, 2], default=4,
    )
    last = data[ends - 1]
    sign = np.where(_SIGN[last] > 0, last, 0)
    repeat = np.zeros(len(codes), np.int64)
    order = np.arange(len(codes))
    for lag in (3, 2, 1):
        same = np.zeros(len(codes), bool)
        same[lag:] = (codes[lag:] == codes[:-lag]) & (order[lag:] - lag >= first[lag:])
        repeat[same] = lag
    digits = np.minimum(n_digit, 3)
    return ((case * 4 + digits) * 4 + np.minimum(n_sign, 3)) * 1024 + sign * 4 + repeat


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: the numbers of its features and their values, of length 1 together. Feature 0 is in all texts."""
    shift = np.uint64(64 - BITS)
    for _, _, data, offsets in text_blocks(texts):
        starts, ends, at = word_places(data, offsets)
        codes = word_codes(data, starts, ends)
        first = np.repeat(at[:-1], np.diff(at))
        shapes = mix(word_shapes(data, starts, ends, codes, first).astype(np.uint64) + np.uint64(1 << 40))
        code_pairs, shape_pairs = gram_codes(codes, 2), gram_codes(shapes, 2)
        for a, b in zip(at[:-1], at[1:]):
            n = int(b - a)
            pairs = code_pairs[a: max(a, b - 1)]
            share = int(10 * len(np.unique(pairs)) / len(pairs)) if len(pairs) else 11
            extra = mix(np.array([(1 << 41) + share, (1 << 42) + min(n.bit_length(), 16)], np.uint64))
            hashed = np.concatenate([codes[a:b], pairs, shapes[a:b], shape_pairs[a: max(a, b - 1)], extra]) >> shift
            number, count = np.unique(hashed, return_counts=True)
            value = np.log1p(count)
            value /= np.sqrt((value * value).sum())
            yield np.concatenate([[0], number]).astype(np.int64), np.concatenate([[1.0], value])


def train(
    rows: DataFrame, texts: DataFrame | None = None, *, set_up: Ftrl = Ftrl(), sample_rows: int = SAMPLE_ROWS,
) -> np.ndarray | None:
    """Weights from rows (_id, _text, _label 0 or 1); None without rows. Of more than sample_rows rows about that
    many are used, chosen by hash of id and text; repeated and NULL ids make no difference.

    Rows may have _hash, the hash of their text, and texts (_id, _text) then name where the chosen ones are read.
    """
    n = rows.count()
    if not n:
        return None
    keyed = rows if "_hash" in rows.columns else rows.withColumn("_hash", text_hash(F.col("_text")))
    chosen = sample(keyed.select("_id", "_hash", "_label"), texts if texts is not None else rows, F.lit(min(1.0, sample_rows / n)))
    return fit(chosen, min(n, sample_rows), features, 1 << BITS, 2, set_up)


def train_on(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights from the labelled documents that are not held out."""
    texts = docs.where(~held_out()).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    return train(labelled(docs, labels), texts)


def score_quality(
    docs: DataFrame, weights: np.ndarray | None, *, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: the id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= least).

    NULL and empty texts get the score of a text without words; without a model every score is 0.5. Repeated rows each
    get a row; other columns are not looked at; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if weights is None:
                scores = [0.5] * batch.num_rows
            else:
                scores = [float(chances(np.array([v @ weights[at, 0]]))[0]) for at, v in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    id_type = docs.select(id_col).dtypes[0][1]
    scored = docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(docs: DataFrame, weights: np.ndarray | None, *, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score is at least `least`; all rows without a model."""
    if weights is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            good = [chances(np.array([v @ weights[i, 0]]))[0] >= least for i, v in features(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: labelled documents that are not held out; labels that are neither 0 nor 1 are left out."""
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("_label"))
    marks = marks.where(~held_out())
    # The hash is made before the join, so that where only it is wanted no text is shuffled.
    texts = docs.where(~held_out()).select("doc_id", F.col("text").alias("_text"), text_hash(F.col("text")).alias("_hash"))
    return texts.join(marks, "doc_id").select(F.col("doc_id").alias("_id"), "_text", "_hash", "_label")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train_on(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")
