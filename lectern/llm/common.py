"""Helpers that the corpus operators share: reading, cutting lineage, splitting texts into words."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: the one in ``spark.checkpoint.dir``, or that of the context. A session of one machine that names
    none gets a new one; on a cluster that is an error, as executors would not share it."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*columns: Column) -> Column:
    """A digest that tells rows apart by these columns; null differs from any value."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def one_of_each(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, row): one row of ``columns``, as a struct, for each value of ``key``: of several, the one whose hash is smallest.

    Columns that hold maps, which have no hash, are kept but don't decide.
    """
    packed = F.struct(*(F.col(f"`{c}`") for c in columns))
    hashed = [F.col(f"`{c}`") for c in columns if "map<" not in rows.schema[c].dataType.simpleString()]
    return rows.groupBy(F.col(key).alias("key")).agg(F.min_by(packed, F.xxhash64(*hashed)).alias("row"))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null text gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def seeded_bits(seed: int, *columns: Column) -> Column:
    """52 pseudo-random bits, as a long, that depend on the seed and the columns only."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")
