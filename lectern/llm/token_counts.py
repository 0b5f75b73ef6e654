"""Token counts by a separator scan of flat token files.

A flat token file is a run of fixed-width token ids without any index; documents end where the end-of-document id stands.
Files are cut in blocks of a fixed size, which know nothing of documents. Each block is searched for separators with numpy at
once and told by three numbers and the gaps between its own separators. A prefix scan over the blocks of a file then says
how many separators stand before each block and where the last of them is, which numbers the documents and completes the
one that a block boundary cuts. The scan has two levels, so that a file of any length is no single task's burden.

``write_flat`` makes such files from texts, one for each partition, with any tokenizer of ranks; texts are encoded in pieces
cut at places where the tokenizer's own pre-splitting never joins, so that memory doesn't follow the text.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table, shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-splitting of the tokenizer family above, and its end-of-document id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50_256
BLOCK_BYTES = 4 << 20
PIECE = 1 << 16
SUPERBLOCK = 1024
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}

# A single space between two characters that are no white space: no token spans the place before it.
JOINT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut where tokens never join. Where there is no such place a piece is longer, as its tokens
    depend on all of it; the tokenizer's time grows little faster than its length, its memory with it."""
    start = 0
    while len(text) - start > size:
        joint = JOINT.search(text, start + size)
        if joint is None:
            break
        yield text[start : joint.start()]
        start = joint.start()
    yield text[start:]


def write_flat(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Writes a flat file for each partition of ``docs`` into ``folder``, a path that all machines reach.

    Returns (file, first, ids): the doc_ids of a file's documents in their order, in chunks, the first of which has number ``first``.
    A null text is a document without tokens. Files get their name when they are complete, so a task that runs twice leaves one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    out_schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("ids", pa.list_(pa.int64() if kind == "bigint" else pa.string()))])
    if kind != "bigint":
        narrow, kind = narrow.withColumn("doc_id", F.col("doc_id").cast("string")), "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        dtype = WIDTHS[width]
        end = np.array([separator], dtype).tobytes()
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"tokens-{context.partitionId():06d}.bin"
        draft = f"{base}/.{name}.{context.taskAttemptId()}"
        store.create_dir(base, recursive=True)
        number = 0
        with store.open_output_stream(draft, buffer_size=1 << 20) as sink:
            for batch in batches:
                for value in batch.column("text"):
                    body = value.as_py() or ""
                    for piece in pieces(body):
                        sink.write(np.array(encode(piece), dtype).tobytes())
                    sink.write(end)
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number]), pa.array([ids], out_schema.field("ids").type)], schema=out_schema)
                number += len(ids)
        store.move(draft, f"{base}/{name}")

    return narrow.mapInArrow(run, f"file string, first long, ids array<{kind}>")


def flat_blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES, glob: str = "tokens-*.bin") -> DataFrame:
    """(path, file, block, at, size): one row for each block of each flat file in ``folder``. Spark lists the files; none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    blocks = files.filter("length > 0").select("path", "length", F.explode(starts).alias("block"))
    return blocks.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), "block", (F.col("block") * block_bytes).alias("at"), F.least(F.lit(block_bytes), F.col("length") - F.col("block") * block_bytes).alias("size"))


def scan_block(data: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """Number of separators, places of the first and the last one (-1: none), gaps between neighbours."""
    places = np.flatnonzero(data == separator)
    if not len(places):
        return 0, -1, -1, places
    return len(places), int(places[0]), int(places[-1]), np.diff(places) - 1


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(file, block, tokens, base, n, first, last, gaps) for each block; places count from the start of the file."""
    dtype = WIDTHS[width]
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("base", pa.int64()), ("tokens", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("gaps", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as source:
                    data = np.frombuffer(source.read_at(row["size"], row["at"]), dtype)
                n, first, last, gaps = scan_block(data, separator)
                base = row["at"] // width
                out = [row["file"], row["block"], base, len(data), n, base + first if n else None, base + last if n else None, gaps]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)

    return blocks.mapInArrow(run, "file string, block long, base long, tokens long, n long, first long, last long, gaps array<long>")


def stitch(scanned: DataFrame, superblock: int = SUPERBLOCK) -> DataFrame:
    """(file, ordinal, n_tokens): documents of each file in order. What stands behind a file's last separator is a document if
    it has tokens."""
    grouped = cut_lineage(scanned.withColumn("super", F.floor(F.col("block") / superblock)))
    totals = grouped.groupBy("file", "super").agg(F.sum("n").alias("s_n"), F.max("last").alias("s_last"), F.max(F.col("base") + F.col("tokens")).alias("s_end"))
    before = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "super", F.coalesce(F.sum("s_n").over(before), F.lit(0)).alias("n_before"), F.max("s_last").over(before).alias("last_before"))
    within = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumns({"n_in": F.coalesce(F.sum("n").over(within), F.lit(0)), "last_in": F.max("last").over(within)}).join(totals, ["file", "super"])
    started = F.coalesce("last_in", "last_before", F.lit(-1))
    lengths = F.concat(F.array(F.col("first") - started - 1), F.col("gaps"))
    ended = placed.filter("n > 0").select("file", (F.col("n_before") + F.col("n_in")).alias("ordinal0"), F.posexplode(lengths).alias("nth", "n_tokens"))
    ended = ended.select("file", (F.col("ordinal0") + F.col("nth")).alias("ordinal"), "n_tokens")
    files = grouped.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.max(F.col("base") + F.col("tokens")) - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens"))
    return ended.unionByName(files.filter("n_tokens > 0"))


def count_tokens(spark: SparkSession, folder: str, *, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES, superblock: int = SUPERBLOCK, glob: str = "tokens-*.bin") -> DataFrame:
    """(file, ordinal, n_tokens) of all flat files in ``folder``; separators count for no document's tokens.

    Neighbouring separators enclose a document of no tokens; a file without separators is one document, an empty file none.
    ``block_bytes`` is a multiple of the width, and a file's bytes too; a rest is an error.
    """
    if block_bytes % width:
        raise ValueError("a block holds whole tokens")
    return stitch(scan_blocks(flat_blocks(spark, folder, block_bytes, glob).repartition(F.col("path"), F.col("block")), separator, width), superblock)


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES, folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) for each row of ``docs``, through flat files and their scan.

    Null and empty texts have no tokens. Repeated rows are counted each. Empty tables give an empty result; further columns are
    ignored, whatever their names. Files are written to ``folder``, or to a new folder in the cluster's
    shared one, which is gone when the counts are there.
    """
    spark = docs.sparkSession
    own = folder is None
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    try:
        out = _counted(docs, folder, doc_id, text, vocabulary, block_bytes)
        return cut_lineage(out) if own else out
    finally:
        if own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _counted(docs: DataFrame, folder: str, doc_id: str, text: str, vocabulary: str, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    listed = cut_lineage(write_flat(docs, folder, doc_id=doc_id, text=text, vocabulary=vocabulary))
    if listed.isEmpty():
        return listed.select(F.explode("ids").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), "file", F.col("first").alias("ordinal"))
    counted = count_tokens(spark, folder, block_bytes=block_bytes)
    names = listed.select("file", "first", F.posexplode("ids").alias("nth", "doc_id")).select("file", (F.col("first") + F.col("nth")).alias("ordinal"), "doc_id")
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens, counted in flat files."""
    return token_counts(read_table(spark, sf_dir, "documents"))
