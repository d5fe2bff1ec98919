"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams, calibrated by temperature.

Document frequencies are counted over every text that may be learnt from. The regression is trained by
follow-the-regularised-leader with an elastic net on a bounded sample per language, and one temperature, fitted on a
part of the sample kept out of training, turns its scores into probabilities.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .ftrl import Ftrl, chances, fit, sample, text_hash
from .wordcodes import mix

#: Parameters: hashed n-grams, their longest length, and texts per language that training looks at.
BITS = 16
LONGEST = 3
SAMPLE_PER_LANGUAGE = 4_000
#: One in so many sampled texts is for the temperature.
CALIBRATION = 5
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}").search


@functools.cache
def _folded() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] in "LM":
            out[i] = i
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams (1 to LONGEST characters) of a lower-cased text and their counts; signs count as blanks."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letters = _folded()[points].astype(np.uint64)
    hashed, code = [], letters
    for n in range(1, LONGEST + 1):
        if n > 1:
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[n - 1:]
        hashed.append(mix(code + np.uint64(n << 56)) >> np.uint64(64 - BITS))
    counts = np.bincount(np.concatenate(hashed).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram is, over all rows, and the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[grams(text)[0]] += 1
                n += 1
        found[1 << BITS] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], names=["gram", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in texts.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out[:-1], int(out[-1])


class LanguageModel:
    """languages, the inverse document frequencies, weights per n-gram and language, and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray | None, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def features(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for text in texts.to_pylist():
            at, count = grams(text or "")
            value = (1 + np.log(count)) * self.idf[at]
            yield at, value / (np.sqrt((value * value).sum()) or 1.0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores per text and language, before the temperature; two languages have one column of weights."""
        rows = [v @ self.weights[at] for at, v in self.features(texts)]
        s = np.array(rows).reshape(len(rows), self.weights.shape[1])
        return np.concatenate([np.zeros_like(s), s], axis=1) if len(self.languages) == 2 else s


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which the labels are likeliest, between 1/50 and 50, by golden section on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(x: float) -> float:
        p = chances(scores / math.exp(x))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, part = -math.log(50), math.log(50), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(rows: DataFrame, *, set_up: Ftrl = Ftrl(alpha=2.0, l1=0.001, l2=0.01), per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """A model from rows (_id, _text, _lang); rows with a NULL language are left out; None if no row is left.

    Of languages with more than per_language rows, about that many are used, chosen by hash of id and text;
    repeated and NULL ids make no difference.
    """
    rows = rows.where(F.col("_lang").isNotNull())
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # one row per language
    if not counts:
        return None
    languages = sorted(counts)
    df, n = document_frequencies(rows.select(F.coalesce("_text", F.lit("")).alias("_text")))
    model = LanguageModel(languages, np.log((1 + n) / (1 + df)) + 1, None)
    if len(languages) == 1:
        return model
    spark = rows.sparkSession
    shares = spark.createDataFrame(
        [(x, i, min(1.0, per_language / counts[x])) for i, x in enumerate(languages)], "_lang string, _label int, _share double",
    )
    keyed = rows.join(F.broadcast(shares), "_lang").select("_id", text_hash(F.col("_text")).alias("_hash"), "_label", "_share")
    chosen = sample(keyed, rows, F.col("_share"))
    apart = F.pmod(F.xxhash64("_id", "_text", "_copy", F.lit("temperature")), F.lit(CALIBRATION)) == 0
    n_rows = sum(min(per_language, c) for c in counts.values())
    model.weights = fit(chosen.where(~apart), n_rows, model.features, 1 << BITS, len(languages), set_up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(model.scores(batch.column(0)))), batch.column(1)], names=["scores", "label"])

    # At most per_language / CALIBRATION rows per language, one number per language each.
    seen = chosen.where(apart).select("_text", "_label").mapInArrow(run, "scores array<double>, label int").collect()
    scores = np.array([r["scores"] for r in seen]).reshape(len(seen), len(languages))
    model.temperature = fit_temperature(scores, np.array([r["label"] for r in seen], int))
    return model


def predict_language(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred and score (calibrated probability of that language).

    A NULL text, or one without a letter, is `und` with score 0, and so is every text without a model. Repeated rows
    each get a row; other columns are not looked at; an empty table gives an empty result. Equal scores go to the
    language that is first by name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, best = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            usable = [i for i, t in enumerate(batch.column(1).to_pylist()) if model and t is not None and _letter(t)]
            if usable and model.weights is None:
                for i in usable:
                    langs[i], best[i] = model.languages[0], 1.0
            elif usable:
                p = chances(model.scores(batch.column(1).take(pa.array(usable))) / model.temperature)
                for i, k, x in zip(usable, p.argmax(axis=1), p.max(axis=1)):
                    langs[i], best[i] = model.languages[k], float(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(best, pa.float64())], names=[id_col, "lang_pred", "score"])

    id_type = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = docs.where(~held_out()).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    return predict_language(docs, train(seen)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
