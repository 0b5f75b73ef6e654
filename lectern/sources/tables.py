"""Stand-ins for course tables over the driver's tables, so that each operator can be run and checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus chunks: toxic ones are excluded, those of src0 are reference material; quality gives the priority."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    title = F.array_join(F.slice(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), " "), 1, 6), " ")
    scope = F.when(F.col("toxic") == 1, "excluded").when(F.col("source") == "src0", "reference").otherwise("included")
    priority = F.when(F.col("quality") == 1, "central").when(F.col("quality") == 0, "context").otherwise("normal")
    joined = docs.join(labels, "doc_id", "left").withColumn("title", title)
    return joined.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "title", F.array(F.split(normalize("title"), " ")[0]).alias("aliases"), F.col("text").alias("content"), "source", scope.alias("scope"), priority.alias("priority"))


CORPUS_SQL = r"""
base AS (SELECT d.*, array_to_string(string_split(regexp_replace(coalesce(d.text, ''), '\s+', ' ', 'g'), ' ')[1:6], ' ') AS title, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
corpus AS (
  SELECT doc_id AS id, doc_id AS pos, title, [split_part(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')), ' ', 1)] AS aliases, coalesce(text, '') AS content, coalesce(source, '') AS source,
         CASE WHEN toxic = 1 THEN 'excluded' WHEN source = 'src0' THEN 'reference' ELSE 'included' END AS scope,
         CASE WHEN quality = 1 THEN 'central' WHEN quality = 0 THEN 'context' ELSE 'normal' END AS priority
  FROM base)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


QUESTIONS_SQL = "questions AS (SELECT item_id AS q_id, text AS question FROM benchmark)"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of interactions."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    level = F.when((F.col("event_type") == "error") & (F.col("value") >= 200), 2).when(F.col("event_type") == "error", 1).otherwise(0)
    rows = events.select(
        "event_id", "ts", F.col("user_id").alias("dni"), F.date_format("ts", "yyyy-MM-dd").alias("sid"), F.col("event_type").alias("mode"),
        F.filter(F.array_distinct(F.array(k, F.floor(k / 2))), lambda x: x.isNotNull()).alias("concept_ids"), level.alias("level"),
    )
    return rows.join(roster(spark, sf_dir).select("dni", "commission"), "dni", "left").withColumn("commission", F.coalesce("commission", F.lit("")))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as students; their nation, in two spellings, is their commission."""
    nations = table(spark, sf_dir, "nation")
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Comisión "), "n_name")).otherwise(F.lower("n_name"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("dni"), F.col("c_name").alias("name"), text.alias("commission"))


def commissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten nations are declared commissions."""
    return table(spark, sf_dir, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("commission_id"), F.col("n_name").alias("code"), F.concat("n_name", F.lit(" group")).alias("title"), F.substring("n_name", 1, 4).alias("day"), F.col("n_nationkey").alias("nth"))


ACTIVITY_SQL = r"""
roster AS (SELECT c_custkey AS dni, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Comisión ' || n_name ELSE lower(n_name) END AS commission FROM customer JOIN nation ON c_nationkey = n_nationkey),
log AS (
  SELECT event_id, ts, user_id AS dni, strftime(ts, '%Y-%m-%d') AS sid, event_type AS mode, CASE WHEN event_type = 'error' AND value >= 200 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS level,
         list_filter(list_distinct([(props->>'$.k')::BIGINT, (props->>'$.k')::BIGINT // 2]), lambda x: x IS NOT NULL) AS concept_ids, coalesce(r.commission, '') AS commission
  FROM events LEFT JOIN roster r ON user_id = r.dni),
commissions AS (SELECT n_nationkey::VARCHAR AS commission_id, n_name AS code, n_name || ' group' AS title, substr(n_name, 1, 4) AS day, n_nationkey AS nth FROM nation WHERE n_nationkey < 10)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("title"))


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as references."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref_id"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("author"))


def concept_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers, as the lines of orders have them."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept_id"), F.col("l_suppkey").alias("ref_id")).distinct()
