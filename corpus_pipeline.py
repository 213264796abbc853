"""From raw documents to token files: five stages, each calling one operator of tablediff.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablediff.llm import decontaminate, minhash, mixing, quality, tokens
from tablediff.llm.common import new_folder, table
from tablediff.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go. It learns from the labels of the documents given."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id: five words and similarity 0.8, and op1's links."""
    return minhash.near_dedup(docs, shingle=5, similarity=0.8, seed=42)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.6, overlap=0.6)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources weigh 5, 2, 1 in turn, no source above three epochs."""
    return mixing.repeated(docs, weights=mixing.repeating_weights(docs, (5, 2, 1)), max_epochs=3, seed=42)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what the mix takes, and what they hold: a row for each document in them."""
    return tokens.token_table(docs, vocabulary("word_bpe_49k.json"), end=2, by_word=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token files", as_tokens),
]

#: SQL cannot express the classifier, the fingerprints, the search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
