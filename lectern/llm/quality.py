"""Quality rules: fixed limits, and robust multivariate outliers, on DataFrame operations alone.

For each language and source, texts become vectors of transformed statistics. Their centre and covariance are estimated by
the minimum covariance determinant: start from the rows closest to the coordinates' medians, then repeat the
concentration step (estimate from the half of the rows that is closest, measure all rows again). What is further from the
centre than a quantile of the chi-squared distribution, in Mahalanobis distance, is rejected.

A group of too few rows for an estimate of its own is judged by that of all rows of its language, and where the language has too
few as well, by that of the whole corpus: every row that passes the fixed limits has a distance. These are the row's pool.

The halves are found without sorting a group: distances are counted in fine bins, and the bins that hold the closest half are
taken whole. Counts, means and covariances combine before they are shuffled, so a group of any size is no one's burden.
Covariances are inverted by a fold of sweeps over an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, cut_lineage, read_table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Coordinates of the vectors, with the least standard deviation that they are taken to have.
COORDINATES = {"log_words": 0.5, "word_length": 0.15, "symbols": 0.15, "dup_lines": 0.15, "repeats": 0.25}
STEPS = 4
BINS = 64  # for each unit of the logarithm of a squared distance
SALTS = 32
FEWEST = 40  # rows of a group or language, below which the next wider pool judges
#: A chi-squared quantile for five degrees of freedom: a row of a normal sample in seventy million is beyond.
LIMIT_5 = 45.08
#: The mean of the closest half of a five-dimensional normal sample is short of the whole's variance by this factor.
SHORT_5 = 0.5226


def _shifted(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits)


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(words[i], words[i + 1], words[i + 2])


def _window_counts(words: Column) -> tuple[Column, Column]:
    """An array with a key for each 3-word window, sorted, its position in the low bits; and the number of those bits."""
    n = F.size(words)
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int")
    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: _shifted("left", _shifted("right", _window_hash(words, i), bits), bits).bitwiseOR(i.cast("long")))
    return F.when(n >= 3, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>")), bits


def statistics(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text.

    A null text has no words and counts nothing. Lines equal to an earlier line are counted if they hold a word. Windows
    are sorted by a hash; those with a neighbour of the same one are compared by their words.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    base = docs.select(*(docs[c].alias(f"_k{i}") for i, c in enumerate(keep)), docs[text].alias("_text"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    split = base.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": lines,
        "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    }).drop("_text")
    keys, bits = _window_counts(F.col("_words"))
    keyed = split.withColumns({
        "n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_keys": keys, "_bits": bits,
    }).drop("_lines")
    sorted_keys, low = F.col("_keys"), F.col("_bits")
    same = lambda a, b: _shifted("right", a, low) == _shifted("right", b, low)
    beside = lambda array, equal: F.filter(array, lambda x, i: F.coalesce(equal(F.get(array, i - 1), x), F.lit(False)) | F.coalesce(equal(F.get(array, i + 1), x), F.lit(False)))
    at = F.transform(beside(sorted_keys, same), lambda key: key.bitwiseAND(_shifted("left", F.lit(1).cast("long"), low) - 1).cast("int"))
    words = F.col("_words")
    tied = F.sort_array(F.transform(at, lambda i: F.struct(_window_hash(words, i).alias("hash"), F.struct(words[i], words[i + 1], words[i + 2]).alias("words"), i.cast("long").alias("at"))))
    compared = keyed.withColumn("_tied", tied).drop("_keys", "_bits", "_words")
    alike = beside(F.col("_tied"), lambda a, b: (a["hash"] == b["hash"]) & (a["words"] == b["words"]))
    placed = compared.withColumn("_starts", F.sort_array(F.transform(alike, lambda x: x["at"]))).drop("_tied")
    covered = F.aggregate("_starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda acc, at: F.struct((acc["n"] + at + 3 - F.greatest(at, acc["end"])).alias("n"), (at + 3).alias("end")))
    return placed.withColumn("n_repeat_words", covered["n"]).select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "log_words": F.log(words.cast("double")),
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "symbols": F.log1p(F.col("n_symbols") / words * 10),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / words, F.lit(1.0)))),
    }


def _by_group(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns that ``right`` has for its language and source."""
    named = right.select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), *(c for c in right.columns if c not in ("lang", "source")))
    return left.join(named, F.col("lang").eqNullSafe(F.col("e_lang")) & F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_lang", "e_source")


def _levels(sound: DataFrame, fewest: int) -> DataFrame:
    """(lang, source, group_rows, level, in_lang): who judges a group, 0 itself, 1 its language, 2 the corpus; and whether the language judges any."""
    groups = cut_lineage(sound.groupBy("lang", "source").agg(F.count("*").alias("group_rows")))
    langs = groups.groupBy(F.col("lang").alias("e_lang")).agg(F.sum("group_rows").alias("lang_rows"), F.min("group_rows").alias("least"))
    level = F.when(F.col("group_rows") >= fewest, 0).when(F.col("lang_rows") >= fewest, 1).otherwise(2)
    in_lang = (F.col("lang_rows") >= fewest) & (F.col("least") < fewest)
    return cut_lineage(groups.join(langs, F.col("lang").eqNullSafe(F.col("e_lang"))).select("lang", "source", "group_rows", level.alias("level"), in_lang.alias("in_lang")))


def _pool(level: Column) -> Column:
    """The key of the pool of a row at a level; null languages and sources are values of their own."""
    return F.when(level.isNotNull(), F.struct(level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level == 0, F.col("source")).alias("source")))


def _same_pool(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the estimates of its pools; one row for each pool on the right, repeated so that a pool of any size is dealt to ``SALTS`` tasks."""
    salt = F.pmod(F.xxhash64(*COORDINATES), F.lit(SALTS)).cast("int")
    spread = right.withColumnRenamed("pool", "e_pool").withColumn("e_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(spread, (F.col("pool") == F.col("e_pool")) & (salt == F.col("e_salt")), "left").drop("e_pool", "e_salt")


def _closest_half(measured: DataFrame) -> DataFrame:
    """The rows of each pool in the bins of distance that hold its closest half. ``measured`` has d2."""
    binned = measured.withColumn("bin", F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS).cast("int"))
    upto = Window.partitionBy("pool").orderBy("bin")
    counts = binned.groupBy("pool", "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"through": F.sum("n").over(upto), "all_rows": F.sum("n").over(Window.partitionBy("pool"))})
    ends = counts.filter(F.col("through") - F.col("n") < F.col("all_rows") / 2).groupBy("pool").agg(F.max("bin").alias("last_bin"))
    return _same_pool(binned, ends).filter(F.col("bin") <= F.col("last_bin"))


def _medians(vectors: DataFrame) -> DataFrame:
    """Pool, and a median for each coordinate, from counts in bins of 1/256."""
    names = list(COORDINATES)
    tall = vectors.select("pool", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.floor(F.col(c) * 256).alias("bin")) for i, c in enumerate(names)))).alias("x")).select("pool", "x.*")
    counts = tall.groupBy("pool", "k", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("pool", "k")
    middle = counts.withColumns({"through": F.sum("n").over(by.orderBy("bin")), "all_rows": F.sum("n").over(by)}).filter(F.col("through") * 2 >= F.col("all_rows"))
    found = middle.groupBy("pool", "k").agg(((F.min("bin") + 0.5) / 256).alias("m"))
    return found.groupBy("pool").agg(*(F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"m_{c}") for i, c in enumerate(names)))


def _swept(matrix: Column, pivot: Column) -> Column:
    """One sweep of a symmetric matrix, row after row in an array; when all pivots are through, it is the inverse with its sign turned."""
    k = len(COORDINATES)
    corner = F.get(matrix, pivot * (k + 1))

    def entry(x: Column, place: Column) -> Column:
        row, column = (place / k).cast("int"), place % k
        rest = x - F.get(matrix, row * k + pivot) * F.get(matrix, pivot * k + column) / corner
        return F.when((row == pivot) & (column == pivot), -1 / corner).when((row == pivot) | (column == pivot), x / corner).otherwise(rest)

    return F.transform(matrix, entry)


def _estimates(rows: DataFrame) -> DataFrame:
    """(pool, centre, minus_inverse): the means, and the covariance with the least variances on its diagonal, inverted."""
    names = list(COORDINATES)
    k = len(names)
    found = rows.groupBy("pool").agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i in range(k) for j in range(i + 1)))
    whole = [F.col(f"c{max(i, j)}{min(i, j)}") / SHORT_5 + (COORDINATES[names[i]] ** 2 if i == j else 0.0) for i in range(k) for j in range(k)]
    return found.select("pool", F.array(*(f"m{i}" for i in range(k))).alias("centre"), F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array(*whole), _swept).alias("minus_inverse"))


def _measured(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """``vectors`` with d2, the squared Mahalanobis distance from their pools' centres."""
    k = len(COORDINATES)
    off = [F.col(c) - F.col("centre")[i] for i, c in enumerate(COORDINATES)]
    terms = [off[i] * off[j] * F.col("minus_inverse")[i * k + j] * (-1 if i == j else -2) for i in range(k) for j in range(i + 1)]
    return _same_pool(vectors, estimates).select(*vectors.columns, sum(terms[1:], terms[0]).alias("d2"))


def robust_distances(rows: DataFrame, steps: int = STEPS, fewest: int = FEWEST) -> DataFrame:
    """``rows``, which have statistics, lang and source, with d2 and group_rows. Null languages and sources are groups of their own.

    Estimates come from the rows that pass the fixed limits; all rows are measured. A group of under ``fewest`` such rows is measured by
    its language's estimate, which all rows of the language make, and a language of under ``fewest`` by that of all rows, however
    few they are. A group without such rows has null d2.
    """
    vectors = cut_lineage(rows.withColumns(_vector()))
    levels = _levels(vectors.filter(~base_failed()), fewest)
    corpus_judges = levels.filter("level = 2").limit(1).count() > 0
    placed = _by_group(vectors, levels)
    taken = F.array_compact(F.array(
        F.when(F.col("level") == 0, F.lit(0)), F.when(F.col("in_lang"), F.lit(1)), F.lit(2 if corpus_judges else None).cast("int"),
    ))
    sound = cut_lineage(placed.filter(~base_failed()).withColumn("at", F.explode(taken)).select(_pool(F.col("at")).alias("pool"), *COORDINATES))
    medians = _medians(sound)
    around = sum((((F.col(c) - F.col(f"m_{c}")) / sd) ** 2 for c, sd in COORDINATES.items()), F.lit(0.0))
    estimates = cut_lineage(_estimates(_closest_half(_same_pool(sound, medians).withColumn("d2", around).select(*sound.columns, "d2"))))
    for _ in range(steps - 1):
        estimates = cut_lineage(_estimates(_closest_half(_measured(sound, estimates))))
    return _measured(placed.withColumn("pool", _pool(F.col("level"))).drop("level", "in_lang"), estimates).drop("pool", *COORDINATES)


def judge(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", limit: float = LIMIT_5, fewest: int = FEWEST) -> DataFrame:
    """(doc_id, statistics, d2, base_failed, kept) for each row of ``docs``.

    A row is kept if it passes the fixed limits and its distance is within ``limit``; groups of under ``fewest`` sound rows are
    judged by their language's estimate or the corpus's. Null and blank texts fail the limits. Empty tables give an empty result; further columns are ignored.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), docs[source].alias("source"), docs[text].alias("text"))
    measured = robust_distances(statistics(narrow), fewest=fewest)
    far = F.coalesce(F.col("d2") > limit, F.lit(False))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics and whether it is kept."""
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
