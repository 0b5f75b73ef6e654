"""Language identification by string kernels.

Two texts are as alike as the share of character n-grams, of one to four characters, that both have: the blended-spectrum presence kernel,
normalised. A text is read as its words of letters in lower case with a blank on either side; n-grams don't go beyond a word's blanks. The kernel
is approximated from landmarks (Nyström): a text's features are its kernels with a few hundred landmark texts, whitened by the landmarks' own
kernel matrix. A ridge regression for each language against the rest is fitted on those features.

Landmarks and the texts learnt from are a bounded sample of the labelled rows. Their kernels are made where the texts are; the driver gets the
landmarks' n-grams and a row of kernels for each sampled text. As a kernel with a landmark is a product of presences, the landmarks fold
into one number for each n-gram and language, so that a batch of texts is scored by one product of its presence matrix, kept sparse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, free_name, read_table, seeded_bits

GRAMS = (1, 2, 3, 4)
#: Rows learnt from: so many of each language, and so many together, languages in turn.
ROWS_OF_A_LANG = 1_000
TRAIN_ROWS = 6_000
SLICE_BITS = 16
LANDMARKS = 240
#: Bytes of the landmarks' n-grams.
LANDMARK_BYTES = 16 << 20
RIDGE = 1e-2
LEAST_EIGENVALUE = 1e-6
SEED = 11_003
BATCH = 128
CACHED_WORDS = 200_000
CACHED_LETTERS = 40
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of_letters(text: str | None) -> set[str]:
    """Distinct words in lower case; none if the text has no letter. Numerals that aren't digits count only beside letters."""
    if not text:
        return set()
    words = {m[0] for m in WORD.finditer(text.lower())}
    return words if any(not w.isascii() and any(map(str.isalpha, w)) or w.isascii() for w in words) else set()


def grams(word: str) -> Iterator[str]:
    marked = f" {word} "
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


class Presence:
    """Which n-grams of ``places`` (n-gram -> place) a text has, by way of its words; short words are looked up once."""

    def __init__(self, places: dict[str, int]):
        self.places, self.known = places, {}

    def of_word(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            places = self.places
            found = np.array(list({places[g] for g in grams(word) if g in places}), np.int64)
            if len(word) <= CACHED_LETTERS:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def of_texts(self, texts: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The presence matrix of a batch: (row, place) of its ones, sorted."""
        width, codes = max(1, len(self.places)), [np.zeros(0, np.int64)]
        for i, words in enumerate(texts):
            if words:
                codes.append(np.unique(np.concatenate([self.of_word(w) for w in words])) + i * width)
        code = np.concatenate(codes)
        return code // width, code % width


def times(row: np.ndarray, place: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """Product of a presence matrix of ``n`` rows with a dense one."""
    out = np.zeros((n, matrix.shape[1]))
    there, heads = np.unique(row, return_index=True)
    if len(there):
        out[there] = np.add.reduceat(matrix[place], heads, axis=0)
    return out


class KernelRidge:
    """``langs``, sorted; ``places`` of n-grams; ``weights`` (n-grams x langs) that a text's n-grams add up, before its norm; ``bias``."""

    def __init__(self, langs: list[str], places: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.places, self.weights, self.bias = langs, places, weights, bias

    def scores(self, presence: Presence, texts: list[set[str]]) -> np.ndarray:
        """A row of the languages' regressions for each text."""
        row, place = presence.of_texts(texts)
        norm = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(texts))))
        return times(row, place, self.weights, len(texts)) / norm[:, None] + self.bias


def landmark_matrix(landmarks: list[list[str]]) -> tuple[dict[str, int], np.ndarray]:
    """Places of all n-grams of the landmarks, and landmarks as columns of norm one."""
    places = {g: i for i, g in enumerate(sorted({g for x in landmarks for g in x}))}
    out = np.zeros((len(places), len(landmarks)))
    for j, x in enumerate(landmarks):
        out[[places[g] for g in x], j] = 1 / np.sqrt(max(1, len(x)))
    return places, out


def ridge(kernels: np.ndarray, own: np.ndarray, marks: np.ndarray, penalty: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of kernels with landmarks, bias) of one ridge regression for each column of ``marks``, on Nyström features.

    Features are kernels times the inverse root of ``own``, the landmarks' kernels with each other; what has eigenvalues near zero adds nothing.
    Languages weigh the same, however many rows they have.
    """
    values, sides = np.linalg.eigh(own)
    kept = values > LEAST_EIGENVALUE * max(1.0, values.max(initial=0))
    root = sides[:, kept] / np.sqrt(values[kept])
    features = np.hstack([kernels @ root, np.ones((len(kernels), 1))])
    weigh = (1 / np.maximum(1, (marks > 0).sum(axis=0)))[marks.argmax(axis=1)]
    inner = (features * weigh[:, None]).T @ features / weigh.sum() + penalty * np.diag([*[1.0] * int(kept.sum()), 1e-6])
    found = np.linalg.solve(inner, (features * weigh[:, None]).T @ marks / weigh.sum())
    return root @ found[:-1], found[-1]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose language is never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(docs: DataFrame, most_rows: int, most_of_a_lang: int) -> DataFrame:
    """(doc_id, lang, place): ids to learn from, those of the smallest hash, languages in turn; ids come before texts are read.

    Counts by slices of the hash tell how far each language's smallest ones reach, so that only those are ranked, however frequent it is.
    """
    ids = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out()).select("doc_id", "lang").distinct().withColumn("draw", seeded_bits(SEED, F.col("doc_id"))).withColumn("slice", F.shiftright("draw", 52 - SLICE_BITS))
    through = F.sum("n").over(Window.partitionBy("lang").orderBy("slice"))
    slices = ids.groupBy("lang", "slice").agg(F.count("*").alias("n")).withColumn("before", through - F.col("n")).filter(F.col("before") < most_of_a_lang)
    ranked = ids.join(slices.select("lang", "slice"), ["lang", "slice"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).filter(F.col("place") <= most_of_a_lang)
    return cut_lineage(ranked.orderBy("place", "draw", "doc_id", "lang").limit(most_rows).select("doc_id", "lang", "place"))


def learn(docs: DataFrame, *, most_rows: int = TRAIN_ROWS, most_of_a_lang: int = ROWS_OF_A_LANG, landmarks: int = LANDMARKS, landmark_bytes: int = LANDMARK_BYTES) -> KernelRidge | None:
    """A model of (doc_id, text, lang) rows that aren't held out; None if no such row has a letter.

    Null ids, texts and languages are passed over. Of several texts of an id and language the one with the smallest hash counts. Landmarks are the
    first rows drawn, languages in turn, as many as have ``landmark_bytes`` of n-grams together.
    """
    rows = docs.select(docs["doc_id"], docs["text"], docs["lang"].cast("string").alias("lang"))
    chosen = drawn(rows, most_rows, most_of_a_lang)
    least = rows.filter("text IS NOT NULL").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("place", "doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = cut_lineage(least)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({g for w in words_of_letters(t.as_py()) for g in grams(w)}) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(x) for x in found]), pa.array([sum(map(len, x)) for x in found], pa.int64())], names=["grams", "size"])

    # A window over the landmarks, of which there is a bounded number.
    first = texts.orderBy("place", "lang", "doc_id").limit(landmarks).repartition(8, "doc_id").mapInArrow(spelt, "grams string, size long").filter("size > 0")
    fits = cut_lineage(first).withColumn("through", F.sum("size").over(Window.orderBy("size", "grams"))).filter(F.col("through") <= landmark_bytes)
    found = sorted(r["grams"] for r in fits.select("grams").toLocalIterator())
    if not found:
        return None
    places, matrix = landmark_matrix([x.split("\n") for x in found])
    shared = docs.sparkSession.sparkContext.broadcast((places, matrix))

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, matrix = shared.value
        presence = Presence(places)
        for batch in batches:
            words = [words_of_letters(t.as_py()) for t in batch.column("text")]
            out = []
            for at in range(0, len(words), 8):
                row, place = presence.of_texts(some := words[at : at + 8])
                out.append(times(row, place, matrix, len(some)) / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(some))))[:, None])
            told = pa.array([x.tobytes() if words[i] else None for i, x in enumerate(np.concatenate(out))] if out else [], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), told], names=["lang", "kernels"])

    rows = sorted((r.lang, bytes(r.kernels)) for r in texts.repartition(16, "doc_id").select("lang", "text").mapInArrow(kernels, "lang string, kernels binary").filter("kernels IS NOT NULL").toLocalIterator())
    langs = sorted({lang for lang, _ in rows})
    marks = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in rows])
    coefficients, bias = ridge(np.array([np.frombuffer(x) for _, x in rows]), matrix.T @ matrix, marks)
    return KernelRidge(langs, places, matrix @ coefficients, bias)


def identify(docs: DataFrame, model: KernelRidge | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` as the last columns: the language whose regression is highest, and where that lies from -1 to 1 as
    a number from 0 to 1.

    Null texts and such without a letter are ``und``, 0; so is every text when there is no model. Of languages alike in score the first counts.
    Where ``docs`` has columns of these names, those stay and the new ones have underscores before their names.
    """
    columns, names = docs.columns, [free_name(docs, "lang_pred"), free_name(docs, "score")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        presence = Presence(model.places) if model else None
        for batch in batches:
            langs, scores = [], []
            column = batch.column(text)
            for at in range(0, len(column), BATCH):
                words = [words_of_letters(t.as_py()) for t in column.slice(at, BATCH)]
                if model is None:
                    langs += [UNKNOWN] * len(words)
                    scores += [0.0] * len(words)
                    continue
                found = model.scores(presence, words)
                best = found.argmax(axis=1)
                langs += [model.langs[b] if w else UNKNOWN for b, w in zip(best, words)]
                scores += [float(min(1.0, max(0.0, (f[b] + 1) / 2))) if w else 0.0 for f, b, w in zip(found, best, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, *names])

    return docs.mapInArrow(run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language that its text alone tells."""
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs)).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
