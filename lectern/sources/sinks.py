"""Writers: course packs, the interaction log and its views, transcripts, packages for outside analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.maintenance import latest

QUESTION, RESPONSE = 500, 1000


def public_pack(packs: DataFrame) -> DataFrame:
    """Packs as anyone may read them: documents without the place of their originals."""
    fields = packs.schema["documents"].dataType.elementType.names
    return packs.withColumn("documents", F.transform("documents", lambda d: d.dropFields("originalPdf"))) if "originalPdf" in fields else packs


def write_packs(packs: DataFrame, path: str) -> None:
    """One JSON object for each course."""
    packs.drop("path").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def log_rows(events: DataFrame) -> DataFrame:
    """Events as the log keeps them: texts cut, sessions by their first eight capitals or digits."""
    return events.withColumns({"question": F.left("question", F.lit(QUESTION)), "response": F.left("response", F.lit(RESPONSE)), "sid": F.left(F.upper("sid"), F.lit(8))})


def append_log(events: DataFrame, path: str, checkpoint: str, refresh: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends a stream to the log's table, each micro-batch once: its number names its folder, which a rerun overwrites.

    ``refresh`` gets the whole log after each batch, for views that are kept up by full rewriting.
    """

    def write(batch: DataFrame, number: int) -> None:
        log_rows(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if refresh:
            refresh(batch.sparkSession.read.option("basePath", path).parquet(path))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_records(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed store after an upsert: the newest record of each key."""
    return latest(stored.unionByName(incoming), key, order)


def transcripts(messages: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, transcript): a conversation as text, a line for each message."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.concat_ws(": ", "role", "text").alias("line"))))
    return messages.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))


def package(passages: DataFrame, signatures: DataFrame, group: str, order: str) -> DataFrame:
    """(group, package): the passages of each group as one JSON text, with its signature and total."""
    rows = passages.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in passages.columns if c not in (group, order))))).alias("passages"))
    met = rows.join(signatures, group)
    return met.select(group, F.to_json(F.struct(F.lit(1).alias("version"), F.col(group), "signature", F.size("passages").alias("total"), "passages")).alias("package"))


def report(results: DataFrame, path: str) -> None:
    """Results of a comparison as JSON lines, without previews."""
    results.drop("preview").write.mode("overwrite").json(path)


def append_once(stream: DataFrame, path: str, mark: str, key: str, trigger: dict | None = None) -> StreamingQuery:
    """A log to which each value of ``key`` is written once, however often it is sent and wherever a run broke off.

    Each micro-batch has a folder of its own, which a repeated batch writes over; what other batches have written already is left out.
    """

    def put(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates([key])
        try:
            written = spark.read.parquet(path).filter(F.col("batch") != batch_id).select(key)
        except AnalysisException:
            written = None  # nothing yet
        (fresh.join(written, key, "left_anti") if written is not None else fresh).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", mark).trigger(**(trigger or {"availableNow": True})).start()
