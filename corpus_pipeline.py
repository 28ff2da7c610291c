"""Five stages from raw documents to token ids; each stage's result is written as Parquet and read again as the next one's input.

All but the last return the columns of documents. Each stage works on every row that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, near_dedup, personal_data, quality_rules, sentencepiece
from quern.llm.common import Scratch
from quern.llm.queries import PIECES, table, vocabulary_file
from quern.session import importable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.keep_first(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets."""
    return personal_data.redact(docs, length_col="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return sentencepiece.encode(docs, sentencepiece.load(vocabulary_file(PIECES)))


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("personal_data", privacy), ("mixing", mixture), ("sentencepiece", tokens)]

#: SQL can't express near-dedup by signatures, expectation-maximisation or Viterbi.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's input goes when its successor has been written."""
    docs, scratch = table(importable(spark), sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
