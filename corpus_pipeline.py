"""A corpus pipeline: reject toxic documents, keep one of each group of near copies, remove benchmark leaks, mix the
sources to their target weights, and shard the result. Every stage reads all that the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import table
from episodica.llm.op2_toxicity import score_toxicity
from episodica.llm.op3_mix import mixed
from episodica.llm.op5_join import keep_first
from episodica.llm.op7_shard import shard
from episodica.llm.op10_decontaminate import decontaminate
from episodica.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_toxicity(docs, table(spark, sf_dir, "labels")).filter(F.col("toxic_score") < 0.5).drop("toxic_score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, n=5, percent=80)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", one_of_each_group),
    ("decontamination", remove_leaks),
    ("mix", mix_sources),
    ("shards", into_shards),
]

#: SQL has no words for the language models of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
