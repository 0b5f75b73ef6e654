"""Batch jobs that can be taken up again: results of a wave count once its commit is written, and a wave that broke off is done anew.

A job has a folder: ``results/wave=n`` and ``commits/wave=n``, the latter with the wave's batches and the signature of what they were made from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "wave long, batch_id long, signature string"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(wave, batch_id, signature) of all waves that were finished."""
    try:
        return spark.read.parquet(f"{folder}/commits").select(F.col("wave").cast("long").alias("wave"), "batch_id", "signature")
    except AnalysisException:  # none yet
        return spark.createDataFrame([], COMMITS)


def run_waves(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, signature: str, *, at_once: int = 64, most_waves: int | None = None) -> int:
    """Works off the batches of ``tasks`` (batch_id, ...) that no commit has for this signature, ``at_once`` of the smallest numbers in a wave; how many waves it took.

    ``work`` gives rows with batch_id. A wave first writes its results, over what an unfinished one may have left there, then its commit, so a run that is killed at any point
    and started again gives each batch's rows once. A new signature starts anew. Null batches are not worked off.
    """
    spark, waves = tasks.sparkSession, 0
    while most_waves is None or waves < most_waves:
        done = commits(spark, folder)
        mine = done.filter(F.col("signature") == signature)
        batches = tasks.filter("batch_id IS NOT NULL").select(F.col("batch_id").cast("long").alias("batch_id")).distinct().join(mine.select("batch_id"), "batch_id", "left_anti").orderBy("batch_id").limit(at_once)
        number = (done.agg(F.max("wave")).first()[0] or 0) + 1
        wave = [r.batch_id for r in batches.collect()]  # ``at_once`` numbers
        if not wave:
            break
        work(tasks.filter(F.col("batch_id").isin(wave))).write.mode("overwrite").parquet(f"{folder}/results/wave={number}")
        spark.createDataFrame([(b, signature) for b in wave], "batch_id long, signature string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/wave={number}")
        waves += 1
    return waves


def results(spark: SparkSession, folder: str, signature: str) -> DataFrame | None:
    """Rows of the committed batches of a signature; None before the first."""
    done = commits(spark, folder).filter(F.col("signature") == signature)
    if done.isEmpty():
        return None
    rows = spark.read.parquet(f"{folder}/results")
    return rows.join(done.select("wave", "batch_id"), ["wave", "batch_id"], "left_semi").drop("wave")


def job_state(tasks: DataFrame, folder: str, signature: str) -> DataFrame:
    """One row (status, batches, committed): ``complete`` if all batches are committed, ``partial`` if some are, else ``processing``. A job without batches is complete."""
    mine = commits(tasks.sparkSession, folder).filter(F.col("signature") == signature).select("batch_id").distinct().withColumn("done", F.lit(1))
    met = tasks.filter("batch_id IS NOT NULL").select(F.col("batch_id").cast("long").alias("batch_id")).distinct().join(mine, "batch_id", "left")
    counted = met.agg(F.count("*").alias("batches"), F.count("done").alias("committed"))
    return counted.select(F.when(F.col("batches") == F.col("committed"), "complete").when(F.col("committed") > 0, "partial").otherwise("processing").alias("status"), "batches", "committed")
