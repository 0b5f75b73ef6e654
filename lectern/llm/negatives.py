"""Hard negatives by distributed radix selection.

For each anchor, positives are the best rows of its label; for each anchor and positive, hard negatives are the best rows of other labels whose
score lies in a window below the positive's. Both are selections of the first k rows of a window, in the order of score and id, and both are made
without sorting: every task scores its rows against a block of anchors and tells, for each window, how many scores fall in which of 512 equal
buckets; the sums say which bucket holds the kth row; that bucket is divided again, down to single scores and then by ids, until few enough rows
are left beside the settled ones. Only rows that qualify are then gathered.

Scores are matrix products of whole numbers, exact, and are made anew in each round rather than kept, as there are far more of them than rows.
Anchors are taken in blocks of a bounded number and size; a block's vectors and windows are all that is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table, shared_folder

EVERY = 100
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
#: Anchors of a block, and bytes of their vectors as doubles.
ANCHORS = 8_192
ANCHOR_BYTES = 32 << 20
BITS = 9
#: A window is settled when the bucket with its kth row has so many rows at most.
FEW = 48
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4_096, 512
NO_ID = (1 << 63) - 1
WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}


def pack(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, width, most, vector): rows that take part, vectors as whole numbers of ``width`` bytes, none above ``most``, in the shared
    checkpoint folder.

    Rows with a null label or vector, or with a component that is null or not finite, are left out. Labels of ids divisible by seven are moved on by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values = column.flatten().to_numpy(zero_copy_only=False)  # nulls as not-a-number
            ends = np.cumsum(column.value_lengths().to_numpy())
            kept, widths, reach, vectors = [], [], [], []
            for i, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                x = values[start:end]
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * x)
                most = float(np.abs(x).max(initial=0))
                if most >= 1 << 62:
                    raise ValueError("components beyond 2^54 have no score that a long can hold")
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                kept.append(i)
                widths.append(width)
                reach.append(int(most))
                vectors.append(x.astype(WIDTHS[width]).tobytes())
            rest = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("row", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(widths, pa.int32()), pa.array(reach, pa.int64()), pa.array(vectors, pa.binary())], names=["row", "vec_id", "label", "width", "most", "vector"])

    parts = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[label].cast("long").alias("label"), rows[embedding].cast("array<double>").alias("embedding")).filter("label IS NOT NULL AND embedding IS NOT NULL")
    moved = parts.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).withColumn("row", F.monotonically_increasing_id())
    return cut_lineage(moved.select("row", "vec_id", "label", "embedding").mapInArrow(run, "row long, vec_id long, label long, width int, most long, vector binary"))


def _matrix(vectors: list[bytes], widths: list[int], dim: int) -> np.ndarray:
    """Vectors as rows of longs, the shorter ones with zeros after their last component."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, (vector, width) in enumerate(zip(vectors, widths)):
        x = np.frombuffer(vector, WIDTHS[width])[:dim]
        out[i, : len(x)] = x
    return out


def _batch_matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """As ``_matrix``, in one view where all vectors of a batch are alike."""
    column, widths = batch.column("vector"), batch.column("width").to_numpy()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(set(widths.tolist())) == 1 and len(set(np.diff(offsets).tolist())) == 1:
        width = int(widths[0])
        x = np.frombuffer(column.buffers()[2], WIDTHS[width], (int(offsets[-1]) - int(offsets[0])) // width, int(offsets[0])).reshape(len(column), -1)
        out = np.zeros((len(column), dim), np.int64)
        out[:, : min(dim, x.shape[1])] = x[:, :dim]
        return out
    return _matrix(column.to_pylist(), widths.tolist(), dim)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, exact: of doubles where these hold every sum, else of longs; an error where longs don't."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return (rows.astype(np.float64) @ anchors.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("these vectors can have scores that a long can't hold")
    return rows @ anchors.T


@dataclass
class Block:
    """Anchors of a block (row, id, label, vector) and the windows asked of them: each has an anchor, a highest and a lowest score, and what a
    round knows of its kth row: the distances below the highest score, or the ids, among which it is, and how many rows precede those. ``ids``:
    the least and the greatest of all.

    Windows of an anchor stand side by side. ``same`` asks for rows of the anchor's label other than itself, else for rows of other labels.
    """

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    same: bool
    k: int
    of: np.ndarray
    high: np.ndarray
    low: np.ndarray
    ids: tuple[int, int]

    def __post_init__(self):
        n = len(self.of)
        self.start, self.end = np.zeros(n, np.int64), self.high - self.low + 1  # distances [start, end) that are looked at
        self.by_id = np.zeros(n, bool)  # one distance is left, ``start``; ids are looked at
        self.id_start, self.id_end = (np.full(n, x + (1 << 63), np.uint64) for x in self.ids)
        self.before = np.zeros(n, np.int64)
        self.open = self.end > 0
        self.first = np.searchsorted(self.of, np.arange(len(self.row) + 1))  # windows of anchor i: first[i] to first[i + 1]

    def shift(self) -> np.ndarray:
        """Bits of a bucket's width, for each window."""
        span = np.where(self.by_id, self.id_end - self.id_start, (self.end - self.start).astype(np.uint64))
        return np.maximum(0, np.ceil(np.log2(np.maximum(1, span.astype(np.float64)))).astype(np.int64) + 1 - BITS)

    def matches(self, batch: pa.RecordBatch, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, place in the batch, distance, score) of a batch's rows that lie in a window, for windows with scores from least to most."""
        rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
        matrix = _batch_matrix(batch, self.vector.shape[1])
        used = np.flatnonzero(np.diff(self.first))
        lowest, highest = np.minimum.reduceat(least, self.first[used]), np.maximum.reduceat(most, self.first[used])
        some = lowest <= highest
        used, lowest, highest = used[some], lowest[some], highest[some]
        for i in range(0, len(used), ANCHORS_AT_ONCE):
            a = used[i : i + ANCHORS_AT_ONCE]
            for j in range(0, len(rows), ROWS_AT_ONCE):
                scores = products(matrix[j : j + ROWS_AT_ONCE], self.vector[a])
                near = (scores >= lowest[i : i + len(a)]) & (scores <= highest[i : i + len(a)])
                near &= (labels[j : j + ROWS_AT_ONCE, None] == self.label[a]) == self.same
                r, c = np.nonzero(near)
                score, place = scores[r, c], r + j
                if self.same:
                    other = rows[place] != self.row[a[c]]
                    c, score, place = c[other], score[other], place[other]
                at = self.first[a[c]]
                last = self.first[a[c] + 1]
                for step in range(int((last - at).max(initial=0))):
                    w = at + step
                    in_it = w < last
                    w = np.where(in_it, w, 0)
                    in_it &= (score >= least[w]) & (score <= most[w])
                    w = w[in_it]
                    yield w, place[in_it], self.high[w] - score[in_it], score[in_it]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids as unsigned numbers in the same order, null last."""
    ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
    return ids.astype(np.uint64) ^ np.uint64(1 << 63)


def _histograms(packed: DataFrame, block: Block) -> DataFrame:
    """(window, need, bucket, n) of the open windows, ``need`` being the rank of the row looked for, summed over all rows. A task leaves out buckets beyond its own kth row: the kth of all isn't later."""
    shared, k = packed.sparkSession.sparkContext.broadcast(block), block.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        shift, need = block.shift(), k - block.before
        nothing = np.iinfo(np.int64)
        least = np.where(block.open, block.high - block.end + 1, nothing.max)
        most = np.where(block.open, block.high - block.start, nothing.min)
        held = np.zeros((0, 2), np.int64)  # window * 2^(BITS + 1) + bucket, n
        for batch in batches:
            ids = _ids(batch)
            new = [held]
            for w, place, distance, _ in block.matches(batch, least, most):
                by_id = block.by_id[w]
                key = np.where(by_id, ids[place], (distance - block.start[w]).astype(np.uint64))
                low, high = np.where(by_id, block.id_start[w], np.uint64(0)), np.where(by_id, block.id_end[w], np.iinfo(np.uint64).max)
                in_it = (key >= low) & (key <= high)
                w = w[in_it]
                bucket = ((key[in_it] - low[in_it]) >> shift[w].astype(np.uint64)).astype(np.int64)
                code, n = np.unique((w << (BITS + 1)) + bucket, return_counts=True)
                new.append(np.stack([code, n], axis=1))
            code, back = np.unique(np.concatenate([x[:, 0] for x in new]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x[:, 1] for x in new]), len(code)).astype(np.int64)
            w, heads = np.unique(code >> (BITS + 1), return_index=True)
            upto = np.cumsum(n) - n
            upto -= np.repeat(upto[heads], np.diff(np.append(heads, len(code))))
            kept = upto < need[code >> (BITS + 1)]
            held = np.stack([code[kept], n[kept]], axis=1)
            # What lies beyond the bucket of a window's own kth row can't matter any more.
            full = (upto + n >= need[code >> (BITS + 1)]) & kept
            w, bucket = code[full] >> (BITS + 1), code[full] & ((1 << (BITS + 1)) - 1)
            by_distance = ~block.by_id[w]
            w, bucket = w[by_distance], bucket[by_distance]
            least[w] = np.maximum(least[w], block.high[w] - block.start[w] - ((bucket + 1) << shift[w]) + 1)
        w = held[:, 0] >> (BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(need[w]), pa.array(held[:, 0] & ((1 << (BITS + 1)) - 1)), pa.array(held[:, 1])], names=["window", "need", "bucket", "n"])

    return packed.mapInArrow(run, "window long, need long, bucket long, n long").groupBy("window", "need", "bucket").agg(F.sum("n").alias("n"))


def _refine(packed: DataFrame, block: Block) -> None:
    """Rounds until each window knows a few rows among which its kth is, or that it has no k rows."""
    running = Window.partitionBy("window").orderBy("bucket")
    while block.open.any():
        sums = _histograms(packed, block).withColumn("through", F.sum("n").over(running))
        found = sums.filter((F.col("through") >= F.col("need")) & (F.col("through") - F.col("n") < F.col("need"))).toArrow()
        w, bucket, n, through = (found[c].to_numpy() for c in ("window", "bucket", "n", "through"))
        shift = block.shift()
        block.open &= np.isin(np.arange(len(block.open)), w)  # fewer rows than k: all that are looked at qualify
        block.before[w] += through - n
        ids = block.by_id[w]
        at = w[~ids]
        block.start[at], block.end[at] = block.start[at] + (bucket[~ids] << shift[at]), np.minimum(block.end[at], block.start[at] + ((bucket[~ids] + 1) << shift[at]))
        at = w[ids]
        first = block.id_start[at] + (bucket[ids].astype(np.uint64) << shift[at].astype(np.uint64))
        block.id_start[at], block.id_end[at] = first, np.minimum(block.id_end[at], first + ((np.uint64(1) << shift[at].astype(np.uint64)) - np.uint64(1)))
        one_id = block.by_id[w] & (block.id_start[w] == block.id_end[w])
        done = (n <= FEW) | one_id
        block.open[w[done]] = False
        block.by_id[w] |= ~done & (block.end[w] - block.start[w] == 1)


def _gather(packed: DataFrame, block: Block) -> DataFrame:
    """(window, anchor_row, vec_id, row, score, rank): the first k rows of each window."""
    shared, k = packed.sparkSession.sparkContext.broadcast(block), block.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        least, most = block.high - block.end + 1, block.high.copy()
        for batch in batches:
            ids = _ids(batch)
            for w, place, distance, score in block.matches(batch, least, most):
                kept = ~(block.by_id[w] & (distance == block.start[w]) & (ids[place] > block.id_end[w]))
                place = pa.array(place[kept], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(w[kept], pa.int64()), batch.column("vec_id").take(place), batch.column("row").take(place), pa.array(score[kept], pa.int64())], names=["window", "vec_id", "row", "score"])

    found = packed.mapInArrow(run, "window long, vec_id long, row long, score long")
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(anchors: DataFrame, most: int, most_bytes: int) -> Iterator[list]:
    """Rows of ``anchors`` in lists of bounded number and size; a row larger than the bound is a list of its own."""
    held, size = [], 0
    for row in anchors.toLocalIterator():
        own = 8 * len(row.vector) // row.width
        if held and (len(held) == most or size + own > most_bytes):
            yield held
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield held


def hard_negatives(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, most_anchors: int = ANCHORS, most_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, each of its positives and their negatives.

    Rows with a null label or vector, or a component that is null or not finite, take no part. A row without an id can't be an anchor; as a
    positive or negative it comes after all ids of its score. Repeated rows are rows of their own: each is an anchor, and each other's positives. Of vectors
    of different lengths the shorter is filled up with zeros; an empty vector scores 0. Anchors without positives and positives without
    negatives have no rows. Scores that a long can't hold are an error. An empty table gives an empty result; further columns are ignored.
    """
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    packed = pack(rows, vec_id=vec_id, embedding=embedding, label=label)
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    some = False
    most, *ids = packed.agg(F.max("most"), F.min(F.coalesce("vec_id", F.lit(NO_ID))), F.max(F.coalesce("vec_id", F.lit(NO_ID)))).first()
    for n, group in enumerate(blocks(packed.filter(F.col("vec_id") % every == 0), most_anchors, most_bytes)):
        dim = max(len(r.vector) // r.width for r in group)
        of = [np.array([getattr(r, c) for r in group], np.int64) for c in ("row", "vec_id", "label")]
        vectors = _matrix([r.vector for r in group], [r.width for r in group], dim)
        # All scores of the block lie within what its anchors' and the rows' sums of magnitudes allow.
        reach = int(np.abs(vectors).sum(axis=1).max(initial=0)) * most
        if reach >= 1 << 61:
            raise ValueError("these vectors can have scores that a long can't hold")
        all_of = np.arange(len(group))
        best = Block(*of, vectors, True, positives, all_of, np.full(len(group), reach), np.full(len(group), -reach), ids)
        _refine(packed, best)
        found = _gather(packed, best).select("window", "rank", "vec_id", "score").toArrow().sort_by([("window", "ascending"), ("rank", "ascending")])
        anchor, score = found["window"].to_numpy(), found["score"].to_pylist()
        # Scores from low to high hundredths of the positive's: the least is rounded up, the highest down.
        near = Block(*of, vectors, False, negatives, anchor, np.array([high * s // 100 for s in score], np.int64), np.array([-(-low * s // 100) for s in score], np.int64), ids)
        _refine(packed, near)
        told = [(i, a, p, s) for i, (a, p, s) in enumerate(zip(of[1][anchor].tolist(), found["vec_id"].to_pylist(), score))]
        told = spark.createDataFrame(told, "window long, anchor_id long, positive_id long, positive_score long")
        out = _gather(packed, near).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(told), "window")
        out.select(*(c.split()[0] for c in schema.split(", "))).write.parquet(f"{folder}/block={n}")
        some = True
    return spark.read.schema(schema).parquet(f"{folder}/block=*") if some else spark.createDataFrame([], schema)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hard negatives of each anchor and each of its first five positives."""
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


#: All scores of all anchors, sorted.
OP13_SQL = """
WITH parts AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS b, b.vec_id AS id, coalesce(list_sum(list_transform(generate_series(1, least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM parts a JOIN parts b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) AS place FROM scores WHERE same),
near AS (
  SELECT p.a, p.b, p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST, n.b)::INTEGER AS rank
  FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM near WHERE rank <= 5
"""
