"""A corpus through quality, near-dedup, decontamination, mixing and token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import discard, materialize, table
from helixframe.llm.contamination import clean
from helixframe.llm.mixture import mixed
from helixframe.llm.neardup import deduplicated
from helixframe.llm.quality import good
from helixframe.llm.queries import tokenizer_path
from helixframe.llm.tokens import token_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior chance of being good is under one half go."""
    return good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them."""
    return token_file(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Trained models, sampling and encoding are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again; what a stage has read goes once its successor stands."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
        # the last stage has written its token files and reads nothing else
        if k:
            discard(before)
    return docs
