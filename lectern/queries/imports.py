"""Queries of jobs, imports by file, files from their parts, metadata and publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import documents
from lectern.operators.knowledge import cut
from lectern.queries import Catalogue
from lectern.sources import imports, jobs
from lectern.sources.tables import table

IMPORTS = Catalogue()


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    cut(spark.range(1))  # names the folder where a session of one machine has none
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/job-{uuid.uuid4().hex}"


@IMPORTS.add("resumed_job", "doc_id bigint, n_chars bigint, batch_id bigint, status string", "SELECT doc_id, length(coalesce(text, '')) AS n_chars, doc_id % 7 AS batch_id, 'complete' AS status FROM documents")
def _(spark, sf):
    """A run that stops after two waves, and one that goes on from there."""
    tasks, folder = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 7).alias("batch_id")), _folder(spark)
    work = lambda rows: rows.select("batch_id", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    jobs.run_waves(tasks, work, folder, "v1", at_once=2, most_waves=2)
    jobs.run_waves(tasks, work, folder, "v1", at_once=2)
    return jobs.results(spark, folder, "v1").join(F.broadcast(jobs.job_state(tasks, folder, "v1").select("status")))


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A file of results for each source, some with a fault; and the passages: documents, source by source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).filter("source IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = docs.withColumns({"nth": nth, "s": F.substring("source", 4, 9).cast("long"), "id": F.concat(F.lit("p"), F.col("doc_id").cast("string"))})
    passages = rows.select(F.col("id").alias("passage_id"), (F.col("s") * 100_000_000 + F.col("nth")).alias("position"), "text")
    is_one, is_two = F.col("nth") == 1, F.col("nth") == 2
    named = F.when((F.col("s") == 3) & is_two, F.array().cast("array<string>")).when((F.col("s") == 4) & is_one, F.array("id", "id")).when((F.col("s") == 5) & is_one, F.array("id", F.lit("zz"))).otherwise(F.array("id"))
    proof = F.struct(F.when(F.col("s") == 7, F.lit("zz")).otherwise(F.col("id")).alias("passageId"), F.left("text", F.lit(60)).alias("quote"))
    entry = F.when(is_one, F.array(F.struct(F.lit("term").alias("term"), F.when(F.col("s") == 6, F.array().cast("array<struct<passageId: string, quote: string>>")).otherwise(F.array(proof)).alias("evidence")))).otherwise(F.array().cast("array<struct<term: string, evidence: array<struct<passageId: string, quote: string>>>>"))
    each = rows.select("source", "s", "nth", named.alias("ids"), entry.alias("entries"))
    whole = each.groupBy("source", "s").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "ids"))), lambda x: x["ids"])).alias("processedPassageIds"), F.flatten(F.collect_list("entries")).alias("entries"))
    total = passages.agg(F.count("*").alias("totalPassages"))
    body = F.to_json(F.struct(F.lit(imports.OUTPUT_FORMAT).alias("format"), F.when(F.col("s") == 2, 2).otherwise(3).alias("version"), F.lit("sig").alias("sourceSignature"), "totalPassages", "processedPassageIds", "entries"))
    files = whole.join(F.broadcast(total)).select(F.col("source").alias("file"), F.when(F.col("s") == 1, F.substr(body, F.lit(1), F.length(body) - 5)).when(F.col("s") == 8, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("body"))
    return files, passages


FAULTS_SQL = r"""
d AS (SELECT doc_id, source, coalesce(text, '') AS body, substr(source, 4)::BIGINT AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
f AS (
  SELECT DISTINCT source AS file, 'json' AS fault FROM d WHERE s = 1 UNION SELECT source, 'version' FROM d WHERE s = 2 UNION SELECT source, 'gap' FROM d WHERE s = 3 AND n > 2 UNION SELECT source, 'repeated' FROM d WHERE s = 4 UNION SELECT source, 'unknown' FROM d WHERE s = 5
  UNION SELECT source, 'evidence' FROM d WHERE s = 6 UNION SELECT source, 'foreign' FROM d WHERE s = 7
  UNION SELECT source, 'quote' FROM d WHERE nth = 1 AND s NOT IN (1, 6, 7) AND length(trim(regexp_replace(strip_accents(lower(left(body, 60))), '[^a-z0-9]+', ' ', 'g'))) < 15)"""


@IMPORTS.add("import_faults", "file string, fault string", f"WITH {FAULTS_SQL} SELECT file, fault FROM f")
def _(spark, sf):
    files, passages = _files(spark, sf)
    return imports.faults(imports.parsed(files), passages, "sig").select("file", "fault").distinct()


@IMPORTS.add("import_state", "files bigint, failed bigint, processed bigint, total bigint, status string", f"WITH {FAULTS_SQL} SELECT count(DISTINCT source) AS files, count(DISTINCT source) FILTER (source IN (SELECT file FROM f)) AS failed, count(*) FILTER (source NOT IN (SELECT file FROM f)) AS processed, count(*) AS total, CASE WHEN count(*) FILTER (source NOT IN (SELECT file FROM f)) = 0 THEN 'empty' WHEN count(*) FILTER (source NOT IN (SELECT file FROM f)) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM d")
def _(spark, sf):
    files, passages = _files(spark, sf)
    read = cut(imports.parsed(files))
    return imports.imported(read, imports.faults(read, passages, "sig"), passages)[1]


@IMPORTS.add("assembled_files", "upload_id string, verdict string, sha256 string", """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents), v AS (
  SELECT *, CASE WHEN octet_length(body) = 0 THEN 'empty' WHEN octet_length(body) > 20000 THEN 'too_large' WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'size' WHEN doc_id % 10 = 3 THEN 'doubled' WHEN doc_id % 10 = 4 THEN 'digest' ELSE 'stored' END AS verdict FROM d)
SELECT doc_id::VARCHAR AS upload_id, verdict, CASE WHEN verdict = 'stored' THEN sha256(body) END AS sha256 FROM v""")
def _(spark, sf):
    """Texts sent in parts of 700 bytes; a part is missing, too long, sent twice with other bytes, or the digest is another's."""
    k = F.col("doc_id") % 10
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"), k.alias("k"))
    size = F.octet_length("body")
    upload = F.col("doc_id").cast("string").alias("upload_id")
    manifests = docs.select(upload, size.alias("file_size"), F.ceil(size / 700).alias("chunk_count"), F.when(F.col("k") == 4, "0").otherwise(F.sha2("body", 256)).alias("sha256"))
    parts = docs.select(upload, "body", "k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / 700) - 1, F.lit(0)))).alias("part_no")).select("upload_id", "k", "part_no", F.substring("body", F.col("part_no").cast("int") * 700 + 1, F.lit(700)).alias("content"))
    longer = F.when((F.col("k") == 2) & (F.col("part_no") == 0), F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))
    sent = parts.filter("NOT (k = 1 AND part_no = 0)").select("upload_id", "part_no", longer.alias("content"))
    again = parts.filter("k = 3 AND part_no = 0").select("upload_id", "part_no", F.reverse(F.hex("content")).cast("binary").alias("content"))
    out = documents.assembled(manifests, sent.unionByName(again), most_bytes=20_000, chunk_bytes=700)
    return out.select("upload_id", "verdict", F.sha2("content", 256).alias("sha256"))


@IMPORTS.add("document_metadata", "document_id string, part bigint, title string, priority string, section_count bigint, low_confidence bigint, ids string", """
WITH s AS (SELECT o_custkey AS d, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE (o_orderkey % 10)::DOUBLE / 10 END AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) - 1 AS nth FROM orders),
p AS (SELECT d, nth // 4 AS part, string_agg(k::VARCHAR, ',' ORDER BY nth) AS ids FROM s GROUP BY ALL), n AS (SELECT d, count(*) AS section_count, count(*) FILTER (c < 0.62) AS low FROM s GROUP BY d)
SELECT c_custkey::VARCHAR AS document_id, coalesce(part, 0) AS part, regexp_replace(c_name, '[.][^.]+$', '') AS title, 'normal' AS priority, coalesce(section_count, 0) AS section_count, coalesce(low, 0) AS low_confidence, coalesce(ids, '') AS ids
FROM customer LEFT JOIN n ON n.d = c_custkey LEFT JOIN p ON p.d = c_custkey""")
def _(spark, sf):
    doc = lambda c: F.col(c).cast("string").alias("document_id")
    none = F.lit(None)
    heads = table(spark, sf, "customer").select(doc("c_custkey"), F.col("c_name").alias("source_name"), F.lit("pdf").alias("format"), F.lit("odd").alias("document_type"), none.cast("string").alias("priority"), F.lit(9).alias("pages"))
    k = F.col("o_orderkey")
    sections = table(spark, sf, "orders").select(doc("o_custkey"), F.col("o_orderdate").alias("position"), k.cast("string").alias("id"), F.lit("t").alias("title"), none.cast("array<string>").alias("path"), F.lit(1).alias("level"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit("contenido").alias("role"), none.cast("string").alias("scope"), none.cast("string").alias("priority"), F.when(k % 4 > 0, (k % 10) / 10).alias("confidence"))
    meta = documents.documents_meta(heads, sections, at_once=4)
    return meta.withColumn("ids", F.array_join(F.transform("sections", lambda s: s["id"]), ","))


@IMPORTS.add("publish_requests", "request_id bigint, outcome string", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 3 AS v FROM customer WHERE c_custkey % 10 > 0), r AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 AS e, o_orderdate AS t FROM orders),
f AS (SELECT r.*, v, row_number() OVER (PARTITION BY r.c, e = v ORDER BY t, r.id) AS n FROM r LEFT JOIN c ON c.id = r.c)
SELECT id AS request_id, CASE WHEN v IS NULL THEN 'unknown' WHEN e <> v THEN 'conflict' WHEN c % 7 = 0 THEN 'invalid' WHEN n = 1 THEN 'published' ELSE 'conflict' END AS outcome FROM f""")
def _(spark, sf):
    courses = table(spark, sf, "customer").filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("course_id"), F.lit("draft").alias("status"), (F.col("c_custkey") % 3).alias("version"))
    requests = table(spark, sf, "orders").select(F.col("o_custkey").alias("course_id"), (F.col("o_orderkey") % 3).alias("expected"), F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("at"))
    return documents.published(courses, requests, courses.filter("course_id % 7 = 0"))[1]
