"""Queries of compilations, ids, kinds of documents, lines on sides, and the contract for publishing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.fixed import DOCUMENT_TYPES, NO_AUTHOR
from lectern.operators import contracts, works
from lectern.queries import Catalogue
from lectern.queries.texts import fold_sql
from lectern.sources.tables import table

WORKS = Catalogue()

SLUG_SQL = "coalesce(nullif(left(regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), {1}), ''), '{2}')"
TYPES_SQL = "CASE " + " ".join(f"WHEN regexp_matches({fold_sql('x')}, '\\b({words})\\b') THEN '{name}'" for name, words in DOCUMENT_TYPES) + " ELSE 'apunte' END"
SAID_SQL = "CASE doc_id % 6 WHEN 0 THEN 'Selected Papers ' WHEN 1 THEN 'Artículo ' WHEN 2 THEN 'Monografía ' WHEN 3 THEN 'bookish ' ELSE '' END || coalesce(text, '')"


@WORKS.add("document_types", "doc_id bigint, kind string", f"SELECT doc_id, {TYPES_SQL} AS kind FROM (SELECT doc_id, {SAID_SQL} AS x FROM documents)")
def _(spark, sf):
    n = F.col("doc_id") % 6
    said = F.when(n == 0, "Selected Papers ").when(n == 1, "Artículo ").when(n == 2, "Monografía ").when(n == 3, "bookish ").otherwise("")
    return table(spark, sf, "documents").select("doc_id", text.document_type(F.concat(said, F.coalesce("text", F.lit("")))).alias("kind"))


@WORKS.add("material_ids", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, document string, section string", f"""
SELECT l_orderkey, l_linenumber, l_partkey, 'doc-' || {SLUG_SQL.format(fold_sql("n"), 56, "fragmento")} AS document,
       {SLUG_SQL.format(fold_sql("n || '-seccion-' || l_linenumber || '-Ruta ' || l_returnflag || '-' || CASE WHEN l_linenumber % 3 = 0 THEN 'material' ELSE 'Título largo ' || l_shipdate END"), 56, "fragmento")} AS section
FROM (SELECT *, 'Orden nº ' || l_orderkey || '.pdf' AS n FROM lineitem)""")
def _(spark, sf):
    name = F.concat(F.lit("Orden nº "), F.col("l_orderkey").cast("string"), F.lit(".pdf"))
    title = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("Título largo "), F.col("l_shipdate").cast("string")))
    section = text.section_id(name, F.col("l_linenumber") - 1, F.array(F.concat(F.lit("Ruta "), "l_returnflag")), title)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.document_id(name).alias("document"), section.alias("section"))


@WORKS.add("page_lists", "o_orderkey bigint, pages string", "SELECT o_orderkey, coalesce(array_to_string(list_sort(list_distinct([x::INT FOR x IN [o_custkey % 40, 3, o_orderkey % 30, 3, -1, 25] IF x >= 1 AND x <= 20])), ','), '') AS pages FROM orders")
def _(spark, sf):
    raw = F.concat_ws(",", (F.col("o_custkey") % 40).cast("string"), F.lit(" 3 "), (F.col("o_orderkey") % 30).cast("string"), F.lit("3,x,2.5,-1,25,"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(text.page_list(raw, F.lit(20)), ",").alias("pages"))


@WORKS.add("marked_pages", "item_id bigint, nth bigint, page bigint, body string", "SELECT item_id, unnest([0, 1]) AS nth, unnest([item_id % 9, 12]) AS page, unnest([trim(text), 'end']) AS body FROM benchmark")
def _(spark, sf):
    raw = F.concat(F.lit("before\n=== "), (F.col("item_id") % 9).cast("string"), F.lit(" ===\n\n"), F.trim("text"), F.lit("\n===12===\nend\n"))
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(text.marked_pages(raw)).alias("nth", "x")).select("item_id", "nth", F.col("x.page").alias("page"), F.col("x.text").alias("body"))


@WORKS.add("author_guesses", "doc_id bigint, author string", f"SELECT doc_id, coalesce([x FOR x IN ls IF length(x) <= 120 AND regexp_matches(x, '[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+') AND NOT regexp_matches(lower(x), '{NO_AUTHOR}') AND NOT regexp_matches(x, '[.!?]$')][1], '') AS author FROM (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['Universidad ' || doc_id] ELSE [] END, string_split(coalesce(text, ''), chr(10))) AS ls FROM documents)")
def _(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("Universidad "), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", text.author_guess(F.concat(head, F.split(F.coalesce("text", F.lit("")), "\n"))).alias("author"))


@WORKS.add("side_lines", "l_orderkey bigint, line_no bigint, text string, side string", """
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nth, l_partkey AS p FROM lineitem),
m AS (SELECT *, CASE WHEN p % 5 = 0 THEN 'left' WHEN p % 5 = 1 THEN 'right' END AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY nth ROWS UNBOUNDED PRECEDING), '') AS side FROM m)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY nth) AS line_no, 'line ' || p AS text, side FROM s WHERE mark IS NULL AND p % 5 <> 2""")
def _(spark, sf):
    p = F.col("l_partkey")
    shown = F.when(p % 5 == 0, " [left]").when(p % 5 == 1, "[RIGHT]").when(p % 5 == 2, "  ").otherwise(F.concat(F.lit("line  "), p.cast("string")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("nth"), shown.alias("text"))
    return works.side_lines(rows, "l_orderkey", "nth")


#: Orders of a customer are pages of a compilation, each tenth page begins a work; lines of orders are its chunks.
PAGES_SQL = """
pages AS (SELECT o_custkey AS material, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Texto ' || o_orderkey END AS text FROM orders),
counts AS (SELECT material, max(page) AS n FROM pages GROUP BY material),
works AS (SELECT material, page AS start_page, least(page + 3, n) AS end_page, 'Obra ' || page % 3 AS title FROM pages JOIN counts USING (material) WHERE page % 4 = 1),
chunks AS (SELECT c.material, range AS chunk_id, range * 2 + 1 AS s, range * 2 + 3 AS e, 1 AS level, CASE WHEN range % 3 = 0 THEN '' ELSE 'Parte ' || range % 3 END AS title, CASE WHEN range % 2 = 0 THEN 'contenido' ELSE 'referencias' END AS role FROM counts c, range(1000) WHERE range * 2 + 1 <= n AND range % 5 <> 4)"""


def _compilations(spark, sf):
    orders = table(spark, sf, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    pages = orders.select(F.col("o_custkey").alias("material"), n.alias("page"), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.concat(F.lit("Texto "), F.col("o_orderkey").cast("string"))).alias("text"))
    counts = pages.groupBy("material").agg(F.max("page").alias("n"))
    starts = pages.filter("page % 4 = 1").join(counts, "material")
    made = starts.select("material", F.col("page").alias("work_id"), F.concat(F.lit("Obra "), (F.col("page") % 3).cast("string")).alias("title"), F.lit(" A. B. ").alias("author"), F.lit("1999").alias("year"), F.col("page").alias("start_page"), F.least(F.col("page") + 3, F.col("n")).alias("end_page"))
    k = F.col("k")
    chunks = counts.select("material", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 2))).alias("k")).filter(k % 5 != 4)
    chunks = chunks.select("material", k.alias("chunk_id"), (k * 2 + 1).alias("start"), (k * 2 + 3).alias("end"), F.lit(1).alias("level"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Parte "), (k % 3).cast("string"))).alias("title"), F.array().cast("array<string>").alias("path"), F.when(k % 2 == 0, "contenido").otherwise("referencias").alias("role"))
    return made, pages, chunks


@WORKS.add("compilation_sections", "document_id string, bibliography_id string, nth bigint, title string, role string, page_start bigint, page_end bigint, content string", f"""
WITH {PAGES_SQL},
p AS (SELECT w.material, w.start_page, w.title AS work, p.page, p.text FROM works w JOIN pages p ON p.material = w.material AND p.page BETWEEN w.start_page AND w.end_page WHERE p.text <> ''),
m AS (SELECT * FROM (SELECT p.*, c.chunk_id, c.title AS ct, c.role AS cr, row_number() OVER (PARTITION BY p.material, p.page ORDER BY c.s DESC NULLS LAST, c.chunk_id) AS r FROM p LEFT JOIN chunks c ON c.material = p.material AND p.page BETWEEN c.s AND c.e) WHERE r = 1),
d AS (SELECT material, start_page, work, page, text, coalesce(chunk_id, -1) AS chunk, coalesce(cr, 'contenido') AS role, coalesce(nullif(ct, ''), CASE WHEN cr = 'referencias' THEN 'Referencias' ELSE work END) AS title FROM m),
g AS (SELECT *, CASE WHEN chunk = lag(chunk) OVER w AND title = lag(title) OVER w AND role = lag(role) OVER w AND page = lag(page) OVER w + 1 THEN 0 ELSE 1 END AS opens FROM d WINDOW w AS (PARTITION BY material, start_page ORDER BY page)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY material, start_page ORDER BY page) AS nth FROM g)
SELECT material || '-obra-' || lower(replace(work, ' ', '-')) || '-' || start_page AS document_id, 'bibliografia-' || lower(replace(work, ' ', '-')) || '-' || start_page AS bibliography_id, nth, any_value(title) AS title, any_value(role) AS role, min(page) AS page_start, max(page) AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY page) AS content
FROM n GROUP BY material, start_page, work, nth""")
def _(spark, sf):
    return works.split_compilation(*_compilations(spark, sf))[1]


@WORKS.add("compilation_documents", "document_id string, bibliography_id string, title string, author string, page_start bigint, page_end bigint, pages bigint", f"WITH {PAGES_SQL} SELECT material || '-obra-' || lower(replace(title, ' ', '-')) || '-' || start_page AS document_id, 'bibliografia-' || lower(replace(title, ' ', '-')) || '-' || start_page AS bibliography_id, title, 'A. B.' AS author, start_page AS page_start, end_page AS page_end, end_page - start_page + 1 AS pages FROM works")
def _(spark, sf):
    return works.split_compilation(*_compilations(spark, sf))[0]


@WORKS.add("work_errors", "rule string, entity string, id string, detail string", """
WITH w AS (SELECT l_orderkey AS material, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_linenumber * 5 - 4 AS a, l_linenumber * 5 - 4 + l_suppkey % 7 - CASE WHEN l_partkey % 10 = 0 THEN 6 ELSE 0 END AS b FROM lineitem GROUP BY ALL),
o AS (SELECT *, max(b) OVER (PARTITION BY material ORDER BY a, id, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT 'range' AS rule, 'work' AS entity, id::VARCHAR AS id, a || '-' || b AS detail FROM w WHERE b < a OR b > 30 UNION ALL SELECT 'overlap', 'work', id::VARCHAR, before::VARCHAR FROM o WHERE a <= before""")
def _(spark, sf):
    first = F.col("l_linenumber") * 5 - 4
    made = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("material"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("work_id"), first.alias("start_page"), (first + F.col("l_suppkey") % 7 - F.when(F.col("l_partkey") % 10 == 0, 6).otherwise(0)).alias("end_page")).distinct()
    counts = made.select("material", F.lit(30).alias("page_count")).distinct()
    return works.work_errors(made, counts)


@WORKS.add("reviewed_works", "material bigint, title string, start_page bigint, end_page bigint", f"""
WITH {PAGES_SQL}, m AS (SELECT c_custkey AS material, c_custkey % 12 AS declared, c_name AS title FROM customer),
c AS (SELECT m.*, greatest(declared, coalesce(n, 0)) AS n_pages FROM m LEFT JOIN counts USING (material)),
f AS (SELECT material, 'Obra ' || page AS title, page AS start_page, lead(page) OVER (PARTITION BY material ORDER BY page) AS nxt FROM pages WHERE page % 5 = 2)
SELECT f.material, f.title, start_page, coalesce(nxt - 1, n_pages) AS end_page FROM f JOIN c USING (material) UNION ALL SELECT material, title, 1, n_pages FROM c WHERE material NOT IN (SELECT material FROM f)""")
def _(spark, sf):
    _, pages, _ = _compilations(spark, sf)
    materials = table(spark, sf, "customer").select(F.col("c_custkey").alias("material"), (F.col("c_custkey") % 12).alias("declared"), F.col("c_name").alias("title"))
    detected = pages.filter("page % 5 = 2").select("material", F.concat(F.lit("Obra "), F.col("page").cast("string")).alias("title"), F.col("page").alias("start_page"))
    return works.reviewed_works(materials, pages, detected)


@WORKS.add("publish_errors", "rule string, entity string, id string, detail string", """
WITH u AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_name END AS title, CASE WHEN p_partkey % 40 = 0 THEN 'pending' ELSE 'approved' END AS st FROM part),
s AS (SELECT s_suppkey AS position, s_suppkey * 3 AS unit FROM supplier UNION ALL SELECT s_suppkey, s_suppkey FROM supplier), q AS (SELECT DISTINCT l_partkey AS unit, l_suppkey AS needs FROM lineitem WHERE l_linenumber = 1)
SELECT 'identity' AS rule, 'course' AS entity, 'c' AS id, 'other' AS detail UNION ALL SELECT 'required', 'course', 'c', 'author' UNION ALL SELECT 'required', 'course', 'c', 'models' UNION ALL SELECT 'pending', 'curriculum', 'c', ''
UNION ALL SELECT 'required', 'mode', r_name, 'goal' FROM region WHERE r_regionkey = 2
UNION ALL SELECT 'required', 'unit', id::VARCHAR, 'title' FROM u WHERE trim(title) = '' UNION ALL SELECT 'pending', 'unit', id::VARCHAR, '' FROM u WHERE st = 'pending'
UNION ALL SELECT 'unique', 'sequence', unit::VARCHAR, count(*)::VARCHAR FROM s GROUP BY unit HAVING count(*) > 1 UNION ALL SELECT 'reference:unit_id', 'sequence', position::VARCHAR, unit::VARCHAR FROM s WHERE unit NOT IN (SELECT id FROM u)
UNION ALL SELECT 'sequence', 'unit', id::VARCHAR, 'missing' FROM u WHERE id NOT IN (SELECT unit FROM s) UNION ALL SELECT 'reference:needs', 'unit', unit::VARCHAR, needs::VARCHAR FROM q WHERE needs NOT IN (SELECT id FROM u) UNION ALL SELECT 'itself', 'unit', unit::VARCHAR, '' FROM q WHERE unit = needs
UNION ALL SELECT 'reference:mode_id', 'activity', n_name, 'mode ' || n_regionkey FROM nation WHERE n_regionkey > 3 UNION ALL SELECT 'reference:concept_id', 'example', c_custkey::VARCHAR, (c_custkey * 7)::VARCHAR FROM customer WHERE c_custkey * 7 NOT IN (SELECT id FROM u)
UNION ALL SELECT 'required', 'chunk', doc_id::VARCHAR, 'content' FROM documents WHERE trim(coalesce(text, ''), ' ') = '' UNION ALL SELECT 'stale', 'index', 'corpus', ''""")
def _(spark, sf):
    course = spark.range(1).select(F.lit("c").alias("id"), F.lit("other").alias("pack_id"), F.lit("T").alias("title"), F.lit(" ").alias("author"), F.lit("e").alias("endpoint"), F.lit(0).alias("n_models"), F.lit("pending").alias("map_review"))
    region = table(spark, sf, "region")
    modes = region.select(F.col("r_name").alias("id"), F.lit("s").alias("strategy"), F.when(F.col("r_regionkey") != 2, "g").alias("goal")).unionByName(region.filter("r_regionkey < 4").select(F.concat(F.lit("mode "), F.col("r_regionkey").cast("string")).alias("id"), F.lit("s").alias("strategy"), F.lit("g").alias("goal")))
    units = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 40 == 0, "pending").otherwise("approved").alias("review_status"))
    k = F.col("s_suppkey")
    sequence = table(spark, sf, "supplier").select(F.explode(F.array(F.struct(k.alias("position"), (k * 3).alias("unit_id")), F.struct(k.alias("position"), k.alias("unit_id")))).alias("x")).select("x.*")
    needs = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("unit_id"), F.col("l_suppkey").alias("needs")).distinct()
    activities = table(spark, sf, "nation").select(F.col("n_name").alias("id"), F.concat(F.lit("mode "), F.col("n_regionkey").cast("string")).alias("mode_id"))
    examples = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7).alias("concept_id"))
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("included").alias("scope"), F.col("text").alias("content"))
    return contracts.publish_errors(course, modes, units, sequence, needs, units, activities, examples, chunks, spark.range(1).select(F.lit(False).alias("current")))
