"""The operators of this subpackage bound to the tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, html, lines, mixing, pii, quality, ranked, simhash, sketch, substrings, tokens, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2, seed=42)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"), least=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sizes(docs, mixing.repeating_weights(docs, (5, 2, 1)), max_epochs=3, seed=42)
    names = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_taken": "taken"}
    return mixed.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.6, overlap=0.6)


def vocabulary(name: str) -> str:
    """A file of the public tokenizers; TOKENIZERS_FOLDER names another folder."""
    if folder := os.environ.get("TOKENIZERS_FOLDER"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2, by_word=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints_with_edits(table(spark, sf_dir, "documents"), fraction=1 / 8, shingle=5)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.audit(conversations.damaged(rows), rows)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_decontaminate": op5_decontaminate,
    "op6_tokens": op6_tokens,
    "op7_quality": op7_quality,
    "op8_lines": op8_lines,
    "op9_warc": op9_warc,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversations": op11_conversations,
    "op12_ranked": op12_ranked,
    "op13_pii": op13_pii,
}

#: DuckDB SQL for those of QUERIES that it can express.
ORACLE_SQL: dict[str, str] = {
    "op3_substrings": substrings.SQL,
    "op4_mixing": mixing.SQL,
    "op8_lines": lines.SQL,
    "op9_warc": warc.SQL,
    "op11_conversations": conversations.SQL,
    "op12_ranked": ranked.SQL,
}
