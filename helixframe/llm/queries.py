"""One query for each operator of this subpackage, over its whole table, with production parameters.

Each gets its rows through its operator; what the contracts ask for is derived
from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import ORACLES


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language

    return language(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_file

    return token_file(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance

    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_mixture, op3_contamination, op4_near_duplicates, op5_licenses, op6_language, op7_token_file, op8_neighbours, op9_quality, op10_substrings, op11_importance, op12_suffixes, op13_divergence)
}

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]
