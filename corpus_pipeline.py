"""A pipeline of corpus operators over ``documents``: what one stage keeps is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import cut_lineage, read_table
from lectern.llm.decontamination import decontaminate
from lectern.llm.mixing import mixed
from lectern.llm.sharding import interleave
from lectern.llm.simhash import keep_one
from lectern.llm.toxicity import below, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit."""
    return below(docs, learn(docs, read_table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; those that consist mostly of such go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of each document of the mix."""
    return interleave(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the first stage, a model's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
