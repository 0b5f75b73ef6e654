"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's budget is met by complete epochs first. What is left of the budget, less than one epoch, is filled by a
weighted sample without replacement: every document draws an exponential key divided by its quality weight, documents
are taken in the order of their keys, and a running sum of sizes says where the budget ends.

The running sum has two levels (slices of the key, then rows within a slice), so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, count_words, cut_lineage, free_name, one_of_each, read_table, row_key, seeded_bits

SEED = 7_003
MOST_EPOCHS = 3
SLICES = 4096


def text_quality(text: Column) -> Column:
    """Quality weight of a text, 0.25 to 1: the share of its non-blank characters that are letters, scaled."""
    dense = F.length(F.translate(text, BLANKS, ""))
    marks = dense - F.length(F.translate(text, BLANKS + "0123456789#*$%&|<>[]{}()=+_/\\@^~", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * marks / F.when(dense > 0, dense), F.lit(0.25))


def targets(sizes: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also n_source, weight, target.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... They share the sum of all sizes; a target stops
    at ``most_epochs`` times its source's size and its excess is shared by the others by weight. That is the level L at
    which sum(min(most * size, L * weight)) is the total: with sources sorted by most * size / weight, the sources
    below the level are a prefix of that order, so running sums find it without iteration. The windows see one row for
    each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    weighed = weighed.withColumns({"cap": F.lit(most_epochs) * F.col("source_size"), "total": F.sum("source_size").over(everything)})
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    so_far = weighed.withColumns({"place": F.row_number().over(by_cap), "capped": F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), "open": F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    level = (F.col("total") - F.coalesce(F.col("capped"), F.lit(0))) / F.col("open")
    # The first source, in the order of caps, whose cap is at or above the level has the level of all that follow.
    tried = so_far.withColumn("first", F.when(F.col("cap") >= level * F.col("weight"), F.struct("place", level.alias("level"))))
    tried = tried.withColumn("level", F.min("first").over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return tried.select("source", "source_size", "weight", F.coalesce(F.round(target, 6), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, seed: int = SEED, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, text_md5, size, source_size, target, copies) for each row of ``docs``.

    size counts words, 0 for a null text. copies is the number of times that the mix takes the row: the source's complete
    epochs, and one more for sampled rows. The sample takes rows in key order as long as they fit the budget, and last,
    if that brings it nearer, the one row of the others whose size is closest to what is left. Null is a source of its own; a source without words has target 0 and no copies. Rows that agree in id and
    text draw the same key and follow each other. Empty tables give an empty result; further columns are ignored.
    ``quality`` is a positive weight, by default ``text_quality``.
    """
    body = docs[text]
    drawn = docs.select(
        docs[doc_id].alias("doc_id"), docs[source].alias("source"), F.md5(F.coalesce(body, F.lit("")).cast("binary")).alias("text_md5"),
        count_words(body).alias("size"), (text_quality(body) if quality is None else quality).cast("double").alias("quality"),
    )
    uniform = (seeded_bits(seed, F.col("doc_id"), F.col("text_md5")) + F.lit(1)) / F.lit(float((1 << 52) + 1))
    drawn = drawn.withColumn("key", -F.log(uniform) / F.greatest(F.col("quality"), F.lit(1e-9)))
    drawn = drawn.withColumn("slice", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * SLICES))
    drawn = cut_lineage(drawn.select("doc_id", "source", "text_md5", "size", "key", "slice"))

    slices = drawn.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    wanted = targets(slices.groupBy("source").agg(F.sum("in_slice").alias("source_size")), most_epochs)
    up_to = Window.partitionBy("source").orderBy("slice")
    plan = (
        slices.withColumn("before", F.sum("in_slice").over(up_to) - F.col("in_slice"))
        .join(wanted.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.when(F.col("epochs") < most_epochs, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
        .select(F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), "before", "source_size", "target", "epochs", "rest")
    )
    in_order = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_md5", "size")
    ends = drawn.withColumns({"nth": F.row_number().over(in_order), "upto": F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ends = ends.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    ends = cut_lineage(ends.withColumn("through", F.col("before") + F.col("upto")).withColumn("fits", (F.col("size") > 0) & (F.col("through") <= F.col("rest"))))

    gaps = ends.groupBy("source").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))), F.lit(0))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    last = (
        ends.filter((F.col("size") > 0) & ~F.col("fits")).join(gaps.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
        .filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "slice", "nth")).alias("last"))
        .select(F.col("source").alias("l_source"), "last")
    )
    is_last = F.coalesce((F.col("slice") == F.col("last.slice")) & (F.col("nth") == F.col("last.nth")), F.lit(False))
    out = ends.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    return out.withColumn("copies", (F.col("epochs") + F.when(F.col("fits") | is_last, 1).otherwise(0)).cast("long")).select("doc_id", "source", "text_md5", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it, with all columns.

    Rows that agree in id, source and text are copies of one row; what their copies take together, the one of them with the
    smallest hash gives.
    """
    taken = mix(docs, doc_id=doc_id, text=text, source=source, seed=seed, most_epochs=most_epochs).filter("copies > 0")
    # The digest of a text, not the text, is what ``mix`` hands on.
    body = F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))
    key = free_name(docs, "row_key")
    wanted = taken.groupBy(row_key(F.col("doc_id"), F.col("source"), F.col("text_md5")).alias("key")).agg(F.sum("copies").cast("int").alias("times"))
    keyed = docs.withColumn(key, row_key(docs[doc_id], docs[source], body)).join(wanted.select(F.col("key").alias(key)), key, "left_semi")
    rows = one_of_each(keyed, key, docs.columns).join(wanted, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


#: DuckDB's form of the same mix, plainly: one running sum for each source.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body, text,
         md5(coalesce(text, '')) AS text_md5,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::DOUBLE AS dense,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '0123456789#*$%&|<>[]{}()=+_/\@^~', ''))::DOUBLE AS letters
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws(chr(31), '7003', coalesce(doc_id::VARCHAR, chr(0)), text_md5)), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE)
            / coalesce(1 - 0.75::DOUBLE * (dense - letters) / nullif(dense, 0), 0.25) AS key
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, round(coalesce(least(cap::DOUBLE, weight * (SELECT arg_min(level, place) FROM levels WHERE cap >= level * weight)), 0), 6) AS target
  FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT k.*, p.source_size, p.target, p.epochs, CASE WHEN p.epochs < 3 THEN p.target - p.epochs * p.source_size ELSE 0 END AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, text_md5 ROWS UNBOUNDED PRECEDING) AS through,
         row_number() OVER (PARTITION BY k.source ORDER BY key, doc_id, text_md5) AS nth
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
gaps AS (SELECT *, size > 0 AND through <= rest AS fits, rest - coalesce(max(through) FILTER (through <= rest) OVER (PARTITION BY source), 0) AS gap FROM run),
lasts AS (
  SELECT source, nth, row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), nth) AS pick
  FROM gaps WHERE size > 0 AND NOT fits AND abs(size - gap) < gap),
taken AS (
  SELECT g.*, epochs + CASE WHEN fits OR l.nth IS NOT NULL THEN 1 ELSE 0 END AS copies
  FROM gaps g LEFT JOIN lasts l ON g.source IS NOT DISTINCT FROM l.source AND g.nth = l.nth AND l.pick = 1)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies::BIGINT AS copies FROM taken
"""
