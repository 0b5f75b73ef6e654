"""Sharding by proportional stratified interleaving, on DataFrame operations alone.

Rows are shuffled by a seeded hash and ranked within their source. A row's place is its rank as a fraction of its
source, so in the order of places every stretch holds the sources in their overall proportions. Cutting that order
into runs whose lengths differ by one at most gives shards that all match the mixture.

No window ever covers a whole source or the whole table. Ranks come in two levels: rows are counted by slice of the
hash (later: of the place), the counts are summed up in order, and rows are numbered within their slice only. A source
that holds a third of all rows is therefore dealt over all slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table, seeded_bits

SHARDS = 40
SEED = 20_117
SLICE_BITS = 12


def interleave(docs: DataFrame, shards: int = SHARDS, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, slice_bits: int = SLICE_BITS) -> DataFrame:
    """One row (doc_id, source, size, text_crc32, shard, slot) for each row of ``docs``.

    size is the text's UTF-8 bytes plus 16; a null text counts no bytes and has the CRC-32 of no bytes, 0. Null is a
    source of its own. Rows that agree in id and text are placed one after the other in either order: the result is
    the same. An empty table gives an empty result. Further columns of ``docs`` are ignored, whatever their names.
    shard runs from 0; row counts of shards differ by one at most; slot is gapless from 0 within a shard.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = cut_lineage(
        docs.select(
            docs[doc_id].alias("doc_id"),
            docs[source].alias("source"),
            (F.octet_length(body).cast("long") + 16).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ).withColumns({"bits": seeded_bits(seed, F.col("doc_id"), F.col("text_crc32")), "phase": seeded_bits(seed, F.col("source")) / F.lit(float(1 << 52))})
    )
    slice_of = {"slice": F.shiftright("bits", 52 - slice_bits)}
    sliced = rows.withColumns(slice_of)
    ordered = Window.partitionBy("source").orderBy("slice")
    starts = (
        sliced.groupBy("source", "slice").agg(F.count("*").alias("n"))
        .withColumns({"before": F.sum("n").over(ordered) - F.col("n"), "of_source": F.sum("n").over(Window.partitionBy("source"))})
        .select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "before", "of_source")
    )
    within = Window.partitionBy("source", "slice").orderBy("bits", "doc_id", "text_crc32", "size")
    ranked = (
        sliced.withColumn("rank", F.row_number().over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
        .withColumn("place", (F.col("before") + F.col("rank") - F.col("phase")) / F.col("of_source"))
        .select("doc_id", "source", "size", "text_crc32", "bits", "phase", "place", F.floor(F.col("place") * (1 << slice_bits)).alias("stretch"))
    )
    ranked = cut_lineage(ranked)
    all_rows = Window.orderBy("stretch")  # over one row for each stretch: 2 ** slice_bits + 1 at most
    stretches = (
        ranked.groupBy("stretch").agg(F.count("*").alias("n"))
        .withColumns({"first": F.sum("n").over(all_rows) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})
        .select(F.col("stretch").alias("s_stretch"), "first", "total")
    )
    along = Window.partitionBy("stretch").orderBy("place", "phase", "source", "bits", "doc_id", "text_crc32", "size")
    return (
        ranked.withColumn("within", F.row_number().over(along))
        .join(stretches, F.col("stretch") == F.col("s_stretch"))
        .withColumn("global", F.col("first") + F.col("within") - 1)
        .withColumn("shard", F.expr(f"global * {shards} div total"))
        .withColumn("slot", F.expr(f"global - (shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    out = interleave(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
