"""Results of outside analysis, read file by file: a file with any fault is left out as a whole, the others are merged.

Faults are rows (file, fault, detail), so that all of them are seen at once, and one file's never touch another's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import normalize

# What the files say of themselves.
OUTPUT_FORMAT, OUTPUT_VERSION = "knowledge-output", 3
LEAST_QUOTE = 15
CONTENT = "format string, version int, sourceSignature string, totalPassages long, processedPassageIds array<string>, entries array<struct<term: string, aliases: array<string>, definition: string, evidence: array<struct<passageId: string, quote: string>>>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of whole text files. A file without a byte has no row, as Spark's readers pass it over."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("body"))


def json_text(body: Column | str) -> Column:
    """A JSON text without a byte order mark, and without the fence that models put around it."""
    bare = F.trim(F.regexp_replace(F.col(body) if isinstance(body, str) else body, "^﻿", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^`{3}(json)?\s*", ""), r"\s*`{3}$", ""))


def parsed(files: DataFrame) -> DataFrame:
    """(file, content, corrupt): content by the fixed schema, and the text where it isn't such JSON. A null body, as of a file that is no UTF-8, is an empty text."""
    schema = f"{CONTENT}, _corrupt string"
    read = F.from_json(json_text(F.coalesce("body", F.lit(""))), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return files.select("file", read.alias("content")).select("file", "content", (F.col("content").isNull() | F.col("content._corrupt").isNotNull()).alias("corrupt"))


def faults(read: DataFrame, passages: DataFrame, signature: str) -> DataFrame:
    """(file, fault, detail) of ``read`` (file, content, corrupt) against ``passages`` (passage_id, position, text).

    ``json``, ``format``, ``version``, ``signature``, ``total``; ``processed``: none named; ``repeated``, ``unknown`` ids; ``gap``: those named don't follow each other;
    ``term``, ``evidence``: an entry without; ``foreign``: evidence of a passage that the file doesn't name; ``quote``: not in the passage, or under 15 characters. A file that is no JSON has no other fault.
    """
    total = passages.agg(F.countDistinct("passage_id").alias("n"))
    sound, c = read.filter("NOT corrupt"), lambda name: F.col(f"content.{name}")
    told = lambda rows, fault, detail="": rows.select("file", F.lit(fault).alias("fault"), (F.lit(detail) if isinstance(detail, str) else detail.cast("string")).alias("detail"))
    unlike = lambda a, b: ~a.eqNullSafe(b)
    places = passages.select(F.col("passage_id").alias("id"), "position", "text")
    ids = sound.select("file", F.explode("content.processedPassageIds").alias("id")).withColumn("id", F.trim("id")).filter("id <> ''")
    counted = ids.groupBy("file", "id").agg(F.count("*").alias("times"))
    placed = counted.join(places.select("id", "position"), "id", "left")
    spans = placed.filter("position IS NOT NULL").groupBy("file").agg((F.max("position") - F.min("position") + 1).alias("span"), F.count("*").alias("n"))
    entries = sound.select("file", F.posexplode("content.entries").alias("nth", "e")).select("file", "nth", F.trim(F.coalesce("e.term", F.lit(""))).alias("term"), F.col("e.evidence").alias("evidence"))
    proofs = entries.select("file", "term", F.inline("evidence")).select("file", "term", F.trim(F.coalesce("passageId", F.lit(""))).alias("id"), F.coalesce("quote", F.lit("")).alias("quote"))
    named = proofs.join(counted.select("file", "id").withColumn("named", F.lit(True)), ["file", "id"], "left").join(places.select("id", "text"), "id", "left")
    quote = normalize("quote")
    checks = [
        told(read.filter("corrupt"), "json"), told(sound.filter(unlike(c("format"), F.lit(OUTPUT_FORMAT))), "format", c("format")), told(sound.filter(unlike(c("version"), F.lit(OUTPUT_VERSION))), "version", c("version")),
        told(sound.filter(unlike(c("sourceSignature"), F.lit(signature))), "signature"), told(sound.join(F.broadcast(total)).filter(unlike(c("totalPassages"), F.col("n"))), "total", c("totalPassages")),
        told(sound.join(ids, "file", "left_anti"), "processed"), told(counted.filter("times > 1"), "repeated", F.col("id")), told(placed.filter("position IS NULL"), "unknown", F.col("id")), told(spans.filter("span <> n"), "gap"),
        told(entries.filter("term = ''"), "term", F.col("nth")), told(entries.filter(F.coalesce(F.size("evidence"), F.lit(0)) < 1), "evidence", F.col("term")),
        told(named.filter("named IS NULL"), "foreign", F.col("id")), told(named.filter(F.col("named") & ~((F.length(quote) >= LEAST_QUOTE) & F.contains(normalize(F.coalesce("text", F.lit(""))), quote))), "quote", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, checks).distinct()


def imported(read: DataFrame, found: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, state): entries (file, nth, term, aliases, definition, evidence) of the files without a fault in ``found``; and one row (files, failed, processed, total, status).

    ``status`` is complete if the sound files name all passages, partial if some, empty if none.
    """
    sound = read.join(found.select("file").distinct(), "file", "left_anti")
    entries = sound.select("file", F.posexplode("content.entries").alias("nth", "e")).select("file", "nth", "e.*")
    ids = sound.select(F.explode("content.processedPassageIds").alias("passage_id")).select(F.trim("passage_id").alias("passage_id")).distinct()
    counts = [read.agg(F.countDistinct("file").alias("files")), found.agg(F.countDistinct("file").alias("failed")), passages.select("passage_id").distinct().join(ids, "passage_id", "left_semi").agg(F.count("*").alias("processed")), passages.agg(F.countDistinct("passage_id").alias("total"))]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), counts)  # a row each
    return entries, one.withColumn("status", F.when(F.col("processed") == 0, "empty").when(F.col("processed") == F.col("total"), "complete").otherwise("partial"))
