"""A corpus pipeline of five operators: each stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ocellus.llm import bpe, mixing, neardup, rules, toxicity
from ocellus.runtime import scratch_path, ship, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. A null text is judged as an empty one; ids don't matter."""
    ship(spark)
    return toxicity.clean_rows(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def rules_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null text has no words and goes; ids don't matter."""
    ship(spark)
    return rules.kept_rows(docs)


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, and all without an id or without words."""
    ship(spark)
    return neardup.kept_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents that the mix takes twice come twice. A null source is one of its own."""
    ship(spark)
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every text; a null text has none."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("quality_rules", rules_out),
    ("near_duplicates", duplicates_out),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Two stages are learned or counted models, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet in the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
