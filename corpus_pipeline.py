"""A corpus cleaned and packed: toxicity, exact copies, near copies, repeated passages, sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vialytics.llm import exact_dedup, ngram_join, packing, span_dedup, toxicity
from vialytics.llm.common import materialize, table

PASSAGE_WORDS = 25


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier scores as toxic go; it learns from the labels beside the documents."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at a Jaccard similarity of 0.8 or more stays."""
    return ngram_join.keep_one(docs, 5, "0.8")


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each passage that repeats, the first occurrence stays; the rest is cut out of its documents.

    A passage is several sentences of PASSAGE_WORDS words together or one of 50: a pair of short common sentences is none.
    """
    return span_dedup.clean(docs, PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_join", remove_near_copies),
    ("span_dedup", remove_passages),
    ("packing", pack),
]

#: SQL expresses neither tokenizers nor classifiers; tests/llm/test_pipeline.py holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written as Parquet and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
