"""From raw documents to shards of token ids: the training-data operators as stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.common import Workspace, table
from tablewright.llm.decontaminate import drop_contaminated
from tablewright.llm.minhash_dedup import drop_near_duplicates
from tablewright.llm.mixing import mix
from tablewright.llm.quality_classifier import keep_good, train_on
from tablewright.llm.token_output import default_tokenizer, token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier, trained on the labelled documents among these, scores 0.7 or more."""
    return keep_good(docs, train_on(docs, table(spark, sf_dir, "labels")), least=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more are benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; documents of sources with a high weight are in it twice."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as shards and read back, a row per document."""
    return token_output(docs, tokenizer_path=default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixing),
    ("token output", tokens),
]

#: No SQL can train the classifier or run the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
