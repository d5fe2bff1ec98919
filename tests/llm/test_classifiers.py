import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
import zlib

from tablewright.llm import language_id, quality_classifier
from tablewright.llm.ftrl import Ftrl, chances, fit_rows, sample, text_hash
from tablewright.llm.queries import QUERIES

from .conftest import prose

FOLDER = "/root/testdata/sf0.001"


def test_ftrl_learns_and_shrinks():
    r = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        y = int(r.integers(0, 2))
        rows.append(((np.array([0, 1 + y, 3 + int(r.integers(0, 50))]), np.ones(3)), y))
    w = fit_rows(rows, 60, 2, Ftrl(l1=5.0))
    assert w[2, 0] > 0.5 > -0.5 > w[1, 0]
    assert (w[3:] == 0).mean() > 0.8  # the penalty keeps noise out
    many = fit_rows([((np.array([k]), np.ones(1)), k) for k in (0, 1, 2) for _ in range(50)], 3, 3, Ftrl())
    assert chances(many).argmax(axis=1).tolist() == [0, 1, 2]


def labelled(documents):
    good = [(i, prose(i, 40), "en", "a") for i in range(120)]
    bad = [(1000 + i, " | ".join(prose(300 + i, 30).split()), "en", "a") for i in range(60)]
    docs = documents(good + bad)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), (F.col("doc_id") < 1000).cast("int").alias("_label"))
    return docs, rows


def test_quality_separates(documents):
    docs, rows = labelled(documents)
    weights = quality_classifier.train(rows.where("_id % 3 > 0"))
    got = quality_classifier.score_quality(docs, weights).where("doc_id % 3 = 0").collect()
    assert all((r.predicted == 1) == (r.doc_id < 1000) and 0 <= r.score <= 1 for r in got)
    kept = quality_classifier.keep_good(docs, weights)
    assert kept.columns == docs.columns and all(r.doc_id < 1000 for r in kept.where("doc_id % 3 = 0").collect())


def test_quality_is_the_same_again_and_on_a_sample(documents):
    _, rows = labelled(documents)
    one, two = quality_classifier.train(rows), quality_classifier.train(rows.repartition(7))
    assert np.array_equal(one, two)
    assert quality_classifier.train(rows, sample_rows=50) is not None


def scores(documents, weights, texts):
    rows = quality_classifier.score_quality(documents([(i, t, "en", "a") for i, t in enumerate(texts)]), weights).collect()
    return np.array([r.score for r in sorted(rows, key=lambda r: r.doc_id)])


@pytest.mark.parametrize("ids", ["_id % 2", "IF(_id % 3 = 0, _id, NULL)", "1"])
def test_repeated_and_null_ids_train_the_same_model(documents, ids):
    """Rows that share an id are dealt to shards, and chosen for the sample, each for itself."""
    _, rows = labelled(documents)
    rows = rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.lit(10)))).select(F.expr("_id * 10 + _copies AS _id"), "_text", "_label")
    texts = [prose(i, 40) for i in range(900, 910)] + [" | ".join(prose(i, 30).split()) for i in range(910, 920)]
    set_up = Ftrl(shard_rows=250)
    own = scores(documents, quality_classifier.train(rows, set_up=set_up), texts)
    shared = scores(documents, quality_classifier.train(rows.withColumn("_id", F.expr(ids)), set_up=set_up), texts)
    assert np.abs(own - shared).max() < 0.01 and (own[:10] > 0.9).all() and (own[10:] < 0.1).all()


@pytest.mark.parametrize("ids", ["_id", "_id % 2", "CAST(NULL AS LONG)"])
def test_the_sample_keeps_its_bound(spark, ids):
    rows = spark.range(6000).selectExpr("id AS _id", "IF(id < 2000, 'same', CONCAT('t', id)) AS _text", "CAST(id % 2 AS int) AS _label")
    def some(df, share):
        return sample(df.withColumn("_hash", text_hash(F.col("_text"))), df, F.lit(share))

    got = some(rows.withColumn("_id", F.expr(ids)), 0.1)
    assert 500 <= got.count() <= 700 and got.dropDuplicates(["_id", "_text", "_label", "_copy"]).count() == got.count()
    assert 170 <= got.where("_text = 'same'").count() <= 230 or ids == "_id"
    assert some(rows, 1.0).count() == 6000


def test_quality_odd_rows(documents, odd_rows):
    _, rows = labelled(documents)
    got = quality_classifier.score_quality(documents(odd_rows), quality_classifier.train(rows)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1  # no words, whatever the text
    assert quality_classifier.train(rows.limit(0)) is None
    assert {r.score for r in quality_classifier.score_quality(documents(odd_rows), None).collect()} == {0.5}
    assert quality_classifier.score_quality(documents([]), None).collect() == []


def test_quality_features_ignore_neighbours():
    both = list(quality_classifier.features(pa.array(["b b a", "b b a", None, "", "A  b"])))
    assert all(np.array_equal(x, y) for x, y in zip(both[0], both[1]))
    alone = next(quality_classifier.features(pa.array(["A  b"])))
    assert all(np.array_equal(x, y) for x, y in zip(both[4], alone))


TEXTS = {"aa": "der die und nicht ein haus", "bb": "the of and that is house", "cc": "le la et que dans maison"}


def spoken(documents, n=40):
    rows = [(100 * k + i, " ".join(np.random.default_rng(1000 * k + i).permutation(t.split() * 3)), lang, "s")
            for k, (lang, t) in enumerate(TEXTS.items()) for i in range(n)]
    return documents(rows).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))


def test_language(documents, odd_rows):
    model = language_id.train(spoken(documents))
    docs = documents([(1, "und die maus nicht der", None, "s"), (2, "THE OF THAT", None, "s"), (3, "dans la maison et", "aa", "s")])
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(docs, model).collect()}
    assert got == {1: "aa", 2: "bb", 3: "cc"}
    odd = language_id.predict_language(documents(odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    assert {r.lang_pred for r in odd if r.doc_id in (3, 4, 5, 10)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    assert language_id.predict_language(documents([]), model).collect() == []


def test_language_of_repeated_ids(documents):
    rows = spoken(documents)
    docs = documents([(1, "und die maus nicht der", None, "s"), (2, "THE OF THAT", None, "s"), (3, "dans la maison et", "aa", "s")])
    own = {r.doc_id: r for r in language_id.predict_language(docs, language_id.train(rows)).collect()}
    for ids in ("1", "CAST(NULL AS LONG)"):
        shared = language_id.predict_language(docs, language_id.train(rows.withColumn("_id", F.expr(ids)))).collect()
        assert all(r.lang_pred == own[r.doc_id].lang_pred and abs(r.score - own[r.doc_id].score) < 0.1 for r in shared)


@pytest.mark.parametrize("langs", [[], ["aa"], ["aa", "bb"]])
def test_few_languages(documents, langs):
    rows = spoken(documents).where(F.col("_lang").isin(langs)) if langs else spoken(documents).limit(0)
    model = language_id.train(rows)
    docs = documents([(1, TEXTS["aa"], "aa", "s"), (2, TEXTS["bb"], "bb", "s"), (3, None, None, None)])
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(docs, model).collect()}
    assert got[3] == "und" and got[1] == (langs[0] if langs else "und") and got[2] == (langs[-1] if langs else "und")


def test_temperature_calibrates():
    r = np.random.default_rng(2)
    true = r.normal(size=(4000, 3))
    labels = np.array([r.choice(3, p=p) for p in chances(true)])
    assert abs(language_id.fit_temperature(true * 4, labels) - 4) < 0.6
    assert language_id.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_rows_of_the_queries(spark):
    def crc(i):
        return zlib.crc32(str(i).encode())

    quality = QUERIES["op2_quality_classifier"](spark, FOLDER).collect()
    assert quality and all(r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in quality)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = [r.predicted == labels[r.doc_id] for r in quality if r.held_out and r.doc_id in labels]
    assert sum(right) >= 0.8 * len(right)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op8_language_id"](spark, FOLDER).collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in found)
    assert sum(r.lang_pred == langs[r.doc_id] for r in found if r.held_out) >= 0.95 * sum(r.held_out for r in found)
