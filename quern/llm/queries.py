"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.session import importable

#: Names of the vocabulary files; their folder is a parameter and they are never copied here.
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_file(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.near_dedup import Settings, link

    return link(table(spark, sf_dir, "documents"), s=Settings(shingle=2))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality_rules import rate

    return rate(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.personal_data import find

    return find(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.sentencepiece import encode, load

    return encode(table(spark, sf_dir, "documents"), load(vocabulary_file(PIECES)), check=True)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.fingerprints import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.common import Scratch
    from quern.llm.token_files import digest, read_token_files, write_token_files

    path = Scratch(spark, "token-files").path("tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_file(TOKENIZER))
    return digest(read_token_files(spark, path))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
