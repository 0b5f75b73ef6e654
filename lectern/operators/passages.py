"""Cutting texts into passages. Cutters walk a text from cut to cut, so they are small Python generators inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_cuts(text: str, size: int = 1100, overlap: int = 170) -> Iterator[str]:
    """Overlapping windows that end at a line, sentence or word end in their last third; short texts stay as they are."""
    if len(text) <= size:
        yield text
        return
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            least = start + size * 68 // 100
            # An end mark may begin at the window's end itself.
            natural = max(text.rfind(mark, 0, end + len(mark)) for mark in ("\n", ". ", "? ", "! ", "; "))
            if natural >= least:
                end = natural + 1
            elif (blank := text.rfind(" ", 0, end + 1)) > least:
                end = blank
        if piece := text[start:end].strip():
            yield piece
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


def index_cuts(text: str, size: int = 1700, overlap: int = 150) -> Iterator[str]:
    """Windows for the index: cut at the last line or sentence end in the final 32 per cent, else at the size."""
    text = text.strip()
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            least = start + size * 68 // 100
            found = max((text.rfind(mark, least, end) for mark in ("\n", ". ", "? ", "! ", "; ")), default=-1)
            if found >= least:
                end = found + 1
        yield text[start:end].strip()
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


def cut(df: DataFrame, key: str, text: str, cuts: Callable[[str], Iterator[str]]) -> DataFrame:
    """(key, part, passage): the pieces of each text, numbered from 0."""
    narrow = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column("key").to_pylist(), batch.column("text")):
                pieces = [(n, p) for n, p in enumerate(cuts(value.as_py())) if p]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces), batch.schema.field("key").type), pa.array([n for n, _ in pieces], pa.int32()), pa.array([p for _, p in pieces], pa.string())], names=["key", "part", "passage"])

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, part int, passage string").withColumnRenamed("key", key)


def pieces(text: Column, cuts: Callable[[str], Iterator[str]]) -> Column:
    """The pieces of a text, in order, beside whatever else its row has."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(cuts(x)) for x in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(F.coalesce(text, F.lit("")))


def pack_units(parts: Column, size: int = 5200, gap: int = 2) -> Column:
    """Paragraphs packed greedily, in order, into units of at most ``size`` characters, a longer one alone."""
    joined = lambda a, b: F.concat(a, F.lit("\n" * gap), b)
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when((F.size(done) > 0) & (F.length(F.element_at(done, -1)) + gap + F.length(p) <= size), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(F.element_at(done, -1), p)))).otherwise(F.array_append(done, p)),
    )


def with_overlap(units: Column, tail: int = 320) -> Column:
    """Each unit after the first begins with the end of the one before."""
    return F.transform(units, lambda u, i: F.when(i == 0, u).otherwise(F.concat(F.right(F.get(units, i - 1), F.lit(tail)), F.lit("\n\n"), u)))


def paragraphs(text: Column | str) -> Column:
    body = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x)), lambda p: p != "")


def batches(sizes: Column, most_rows: int, most_size: int) -> Column:
    """Number of the batch of each element: a new one starts when the rows or the size would be exceeded."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= most_rows) | (acc["s"] + size > most_size))
        b = F.when(full, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(F.array_append(acc["out"], b).alias("out"), b.alias("b"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, size).otherwise(acc["s"] + size).alias("s"))

    return F.aggregate(sizes, start, step)["out"]
