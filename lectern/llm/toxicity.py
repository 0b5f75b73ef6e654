"""Toxicity scores from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A text is the bag of its words' character n-grams, with word ends marked, and of the words themselves. Each is hashed to a row
of an embedding matrix; the mean of the rows goes through a linear layer and a softmax over two classes. Both layers are
trained together. As misspelt words share most n-grams with the words that they stand for, they score alike.

Training takes a bounded sample of labelled rows (the rows whose hash is smallest, ``TRAIN_ROWS`` of them, and no more than ``TRAIN_BYTES`` of
their bags) to the driver. Scoring is
distributed: the mean and the layers are linear, so each n-gram has one number, the broadcast table has a fixed size, and
a text of any length is scored whole, word by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, free_name, read_table, seeded_bits

TRAIN_ROWS = 8_000
#: Bytes of bags that the driver takes, four for each n-gram of a row: rows are drawn while they fit.
TRAIN_BYTES = 96 << 20
BUCKETS = 1 << 17
WIDTH = 8
GRAMS = (3, 4, 5, 6)
STEPS = 1_000
BATCH = 64
RATE = 0.5
DECAY = 2e-7
DROPPED = 0.5
SEED = 3_301
LIMIT = 0.7
CACHED_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Buckets of a lower-case word's n-grams and of the word."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1) if n < len(marked)]
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in [*grams, marked]]


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _bag(words: Iterable[str], known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    buckets: list[int] = []
    times: list[int] = []
    for word, n in Counter(words).items():
        if word not in known:
            known[word] = subwords(word)
        buckets += known[word]
        times += [n] * len(known[word])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, place = np.unique(np.array(buckets, np.int32), return_inverse=True)
    share = np.bincount(place, weights=times)
    return found, (share / share.sum()).astype(np.float32)


class Bags:
    """Bags in two long buffers, so that the driver gives their memory back: of buckets, which are sorted, the low 16 bits and how many are below 2^16; shares as halves."""

    def __init__(self):
        self.found, self.share, self.places = bytearray(), bytearray(), []

    def add(self, key: tuple[int, int], found: bytes, share: bytes, below: int) -> None:
        self.places.append((key, len(self.found) // 2, len(found) // 2, below))
        self.found += found
        self.share += share

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        _, at, n, below = self.places[i]
        found = np.frombuffer(self.found, np.uint16, n, 2 * at).astype(np.int32)
        found[below:] += 1 << 16
        return found, np.frombuffer(self.share, np.float16, n, 2 * at).astype(np.float32)


class SubwordSoftmax:
    """Embeddings ``rows`` (buckets x width), layer ``out`` (width x 2), ``bias`` (2)."""

    def __init__(self, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.rows = self.rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.out = self.rng.uniform(-0.5, 0.5, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: Bags | list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS) -> "SubwordSoftmax":
        """Adagrad steps on the cross-entropy of both layers, each on a mini-batch; however many rows there are, so many steps
        are taken, in whole passes. Texts without words are left out; without any others all texts score alike."""
        full = [i for i, (found, _) in enumerate(bags) if len(found)]
        if not full:
            self.rows[:] = 0
        squares = [np.full(x.shape, 1e-6, np.float32) for x in (self.rows, self.out, self.bias)]
        for _ in range(-(-steps * BATCH // len(full)) if full else 0):
            order = self.rng.permutation(full)
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                kept = [self._thinned(*bags[i]) for i in some]
                found, shares = (np.concatenate(x) for x in zip(*kept))
                sizes = [len(x) for x, _ in kept]
                heads = np.cumsum([0, *sizes[:-1]])
                # Coordinate by coordinate, so that memory follows the n-grams of a batch, not their vectors.
                mean = np.stack([np.add.reduceat(self.rows[found, w] * shares, heads) for w in range(WIDTH)], axis=1)
                wrong = self._softmax(mean @ self.out + self.bias)
                wrong[np.arange(len(some)), labels[some]] -= 1
                wrong /= len(some)
                back = wrong @ self.out.T
                touched = np.flatnonzero(np.bincount(found, minlength=BUCKETS))
                slope = np.stack([np.bincount(found, np.repeat(back[:, w], sizes) * shares, BUCKETS)[touched] for w in range(WIDTH)], axis=1).astype(np.float32)
                slope += DECAY * self.rows[touched]
                squares[0][touched] += slope**2
                self.rows[touched] -= RATE * slope / np.sqrt(squares[0][touched])
                for x, grad, square in ((self.out, mean.T @ wrong, squares[1]), (self.bias, wrong.sum(axis=0), squares[2])):
                    square += grad**2
                    x -= RATE * grad / np.sqrt(square)
        return self

    def _thinned(self, found: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bag without some n-grams, so that no single one has to carry a word."""
        keep = self.rng.random(len(found)) >= DROPPED
        keep[self.rng.integers(len(found))] = True
        return found[keep], shares[keep] / shares[keep].sum()

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def folded(self) -> tuple[np.ndarray, float]:
        """One number for each bucket, and one for the text, whose sum is the log-odds of class 1."""
        return (self.rows @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


class Scorer:
    """Log-odds of texts; words seen before are looked up."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __call__(self, text: str | None) -> float:
        total, n, known = 0.0, 0, self.known
        for word in words_in(text):
            pair = known.get(word)
            if pair is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                found = subwords(word)
                pair = known[word] = (float(self.weights[found].sum()), len(found))
            total += pair[0]
            n += pair[1]
        return 1.0 / (1.0 + np.exp(-(total / n if n else 0.0) - self.bias))


def _fit(rows: DataFrame, most_bytes: int = TRAIN_BYTES) -> SubwordSoftmax:
    """A model of the rows (draw, toxic, text), of which there is a bounded number; rows alike in draw and label count once.

    Bags are made where the texts are; the driver gets their numbers only, and those in the order of the draws, up to ``most_bytes``.
    """

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            bags = [_bag(words_in(t.as_py()), known) for t in batch.column("text")]
            if len(known) > CACHED_WORDS:
                known.clear()
            columns = [
                batch.column("draw"), batch.column("toxic"), pa.array([found.astype(np.uint16).tobytes() for found, _ in bags], pa.binary()),
                pa.array([share.astype(np.float16).tobytes() for _, share in bags], pa.binary()), pa.array([int(np.searchsorted(found, 1 << 16)) for found, _ in bags], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["draw", "toxic", "found", "share", "below"])

    told = rows.select("draw", "toxic", "text").mapInArrow(bag, "draw long, toxic int, found binary, share binary, below int")
    told = cut_lineage(told.groupBy("draw", "toxic").agg(F.min(F.struct("found", "share", "below")).alias("bag")).select("draw", "toxic", "bag.found", "bag.share", "bag.below"))
    # One window over all rows, which are bounded, and over their sizes only; the draws that fit are as many at most.
    sized = told.select("draw", "toxic", (2 * F.octet_length("found")).cast("long").alias("size"))
    fits = sized.withColumn("through", F.sum("size").over(Window.orderBy("draw", "toxic"))).filter(F.col("through") <= most_bytes).select("draw", "toxic")
    bags = Bags()
    for row in told.join(F.broadcast(fits), ["draw", "toxic"], "left_semi").toLocalIterator():
        bags.add((row.draw, row.toxic), row.found, row.share, row.below)
    bags.places.sort()
    return SubwordSoftmax().fit(bags, np.array([key[1] for key, *_ in bags.places], np.int64))


def train(labelled: DataFrame, most_rows: int = TRAIN_ROWS) -> SubwordSoftmax:
    """A model of (text, toxic), from at most ``most_rows`` rows with a label of 0 or 1. Without such rows all texts score alike."""
    marks = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    drawn = marks.withColumn("draw", seeded_bits(SEED, F.xxhash64("text"), F.col("toxic")))
    return _fit(drawn.orderBy("draw", "text", "toxic").limit(most_rows).repartition(16, "draw"))


def score(docs: DataFrame, model: SubwordSoftmax, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of class 1, as the last column. Texts without words, null ones too, have the bias alone.

    Where ``docs`` has a column of that name, whatever its case, that one stays as it is and the new one has underscores before its name.
    """
    columns, name = docs.columns, free_name(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, name])

    return docs.mapInArrow(run, schema)


def below(docs: DataFrame, model: SubwordSoftmax, limit: float = LIMIT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < limit for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> SubwordSoftmax:
    """A model from the labelled documents that aren't held out. Labels join by doc_id; rows without a partner don't count.

    The sample is drawn from ids, before any text is read; its ids, of which there are ``most_rows`` at most, go to the texts.
    Of several labels of an id the highest counts, of several texts of an id the one whose bag is least. Null ids join nothing; null and empty
    texts and labels other than 0 and 1 are passed over. Without rows to learn from all texts score alike, a half.
    """
    texts = docs.select(docs["doc_id"], docs["text"]).filter(~held_out())
    marks = labels.select(labels["doc_id"], labels["toxic"].cast("int").alias("toxic")).filter(~held_out() & F.col("toxic").isin(0, 1))
    there = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = cut_lineage(there.withColumn("draw", seeded_bits(SEED, F.col("doc_id"))).orderBy("draw", "doc_id").limit(most_rows))
    return _fit(texts.join(F.broadcast(chosen), "doc_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; predicted is 1 from 0.7."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, model).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
