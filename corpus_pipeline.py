"""A training-data pipeline over the documents table, of stages that each call one corpus operator.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents, whatever other columns docs has. Its tables: documents, labels and benchmark. Rows are judged each by
its own text, also where rows share a doc_id or have none; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlab.llm import bpe_automaton, common, decontaminate, language_id, order_minhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay."""
    return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too) go, and all texts where no training row has text and language."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language_id.with_language(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one doc_id and the same words one stays. Rows without words or without doc_id stay."""
    return order_minhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay; items without words are in no document."""
    return decontaminate.without_items(docs, common.table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row each; null and empty texts have no tokens."""
    # workers that have served the other stages have less memory to spare
    return bpe_automaton.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"), kept=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]

#: The trained stages and the tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.save(spark, docs, f"stage-{name}")
    return docs
