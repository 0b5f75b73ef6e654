"""Queries of patches and of sections between boundaries, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import knowledge, patches, retrieval, segments
from lectern.queries import Catalogue
from lectern.sources.tables import table

SEGMENTS = Catalogue()

PATCH_SQL = """
r AS (SELECT l_orderkey * 100 + l_linenumber * 10 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS row_id, CASE WHEN l_linenumber % 3 > 0 THEN 's' || (l_orderkey * 10 + l_linenumber) END AS section_id, l_orderkey::VARCHAR AS did, 't' || l_linenumber % 2 AS title,
             [l_linestatus, l_returnflag, l_linenumber::VARCHAR][1 : 1 + l_partkey % 3] AS path, l_linenumber * 2 AS a, l_linenumber * 2 + l_suppkey % 4 AS b FROM lineitem),
p AS (SELECT o_orderkey AS patch_id, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_orderkey * 10 + 1) ELSE 'old' END AS section_id, o_orderkey::VARCHAR AS pdid, 't' || o_orderkey % 2 AS title, ['O', 'N'][1 : 1 + o_custkey % 2] AS path, o_orderkey % 9 AS a, o_orderkey % 9 + 3 AS b,
             CASE WHEN o_custkey % 3 > 0 THEN 'reference' END AS scope, NULL AS priority FROM orders),
m AS (
  SELECT row_id, patch_id, 1 AS how FROM r JOIN p USING (section_id)
  UNION ALL SELECT row_id, patch_id, 2 FROM r JOIN p ON did = pdid AND scope IS NOT NULL AND len(r.path) > len(p.path) AND r.path[1 : len(p.path)] = p.path
  UNION ALL SELECT row_id, patch_id, 3 FROM r JOIN p ON did = pdid AND r.title = p.title AND (r.path = p.path OR (r.a > 0 AND p.a > 0 AND r.a <= p.b AND p.a <= r.b)) WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.section_id = p.section_id AND x.did = p.pdid))"""


def _sections(spark, sf):
    line = F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").withColumns({"document_id": F.col("l_orderkey").cast("string"), "place": F.col("l_orderkey") * 10 + line}).repartition("document_id")
    nth = F.row_number().over(Window.partitionBy("document_id", "place").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    rows = lines.withColumn("nth", nth).select(
        (F.col("place") * 10 + F.col("nth")).alias("row"), F.when(line % 3 > 0, F.concat(F.lit("s"), F.col("place").cast("string"))).alias("section_id"), "document_id", F.concat(F.lit("t"), (line % 2).cast("string")).alias("title"),
        F.slice(F.array("l_linestatus", "l_returnflag", line.cast("string")), F.lit(1), (F.col("l_partkey") % 3 + 1).cast("int")).alias("path"), (line * 2).alias("page_start"), (line * 2 + F.col("l_suppkey") % 4).alias("page_end"), F.lit("included").alias("scope"))
    k = F.col("o_orderkey")
    told = table(spark, sf, "orders").select(
        k.alias("patch_id"), F.when(k % 2 == 0, F.concat(F.lit("s"), (k * 10 + 1).cast("string"))).otherwise("old").alias("section_id"), k.cast("string").alias("document_id"), F.concat(F.lit("t"), (k % 2).cast("string")).alias("title"),
        F.slice(F.array(F.lit("O"), F.lit("N")), F.lit(1), (F.col("o_custkey") % 2 + 1).cast("int")).alias("path"), (k % 9).alias("page_start"), (k % 9 + 3).alias("page_end"),
        F.when(F.col("o_custkey") % 3 > 0, "reference").alias("scope"), F.lit(None).cast("string").alias("priority"))
    return rows, told


@SEGMENTS.add("patch_matches", "row_id bigint, patch_id bigint, how string", f"WITH {PATCH_SQL} SELECT row_id, patch_id, ['direct', 'below', 'legacy'][min(how)] AS how FROM m GROUP BY row_id, patch_id")
def _(spark, sf):
    return patches.patch_matches(*_sections(spark, sf)).withColumnRenamed("row", "row_id")


@SEGMENTS.add("patched_sections", "row_id bigint, section_id string, scope string", f"WITH {PATCH_SQL}, g AS (SELECT row_id, arg_min(p.section_id, patch_id) AS id, arg_max(scope, patch_id) FILTER (scope IS NOT NULL) AS s FROM m JOIN p USING (patch_id) GROUP BY row_id) SELECT row_id, coalesce(section_id, id) AS section_id, coalesce(s, 'included') AS scope FROM r LEFT JOIN g USING (row_id)")
def _(spark, sf):
    return patches.patched(*_sections(spark, sf), ["scope"]).withColumnRenamed("row", "row_id")


@SEGMENTS.add("boundary_sections", "doc_id bigint, nth bigint, title string, level bigint, path string, content string, page_start bigint, page_end bigint, confidence double, children bigint, structural_only boolean, needs_review boolean", r"""
WITH RECURSIVE l AS (SELECT doc_id, i // 20 AS page, i % 20 AS line, i, word AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS i FROM documents) WHERE word <> ''),
b AS (SELECT l.*, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth, 'T' || i % 5 AS title, least(4, 1 + (i * 7 + doc_id) % 5) AS raw, CASE i % 3 WHEN 0 THEN 0.65::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM l WHERE (i * i + doc_id) % 11 = 0),
w AS (SELECT doc_id, nth, 1::BIGINT AS level, ['T' || i % 5] AS path, [nth] AS over FROM b WHERE nth = 1
  UNION ALL SELECT b.doc_id, b.nth, least(raw, w.level + 1), list_append(w.path[1 : least(raw, w.level + 1) - 1], b.title), list_append(w.over[1 : least(raw, w.level + 1) - 1], b.nth) FROM w JOIN b ON b.doc_id = w.doc_id AND b.nth = w.nth + 1),
kids AS (SELECT doc_id, over[level - 1] AS nth, count(*) AS children FROM w WHERE level > 1 GROUP BY ALL),
d AS (SELECT l.doc_id, l.page, l.i, l.text, b.nth AS own, count(b.nth) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS nth FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.i = l.i),
s AS (SELECT doc_id, nth, min(page) AS page_start, max(page) AS page_end, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (own IS NULL), '') AS raw, max(nth) OVER (PARTITION BY doc_id) AS most FROM d GROUP BY doc_id, nth),
t AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS content FROM s)
SELECT doc_id, nth, title, level, array_to_string(path, '>') AS path, content, page_start, page_end, confidence, coalesce(children, 0) AS children, length(content) < 24 AS structural_only, confidence < 0.62 AS needs_review
FROM t JOIN w USING (doc_id, nth) JOIN (SELECT doc_id, nth, title, confidence FROM b) USING (doc_id, nth) LEFT JOIN kids USING (doc_id, nth)
UNION ALL SELECT doc_id, 0, n, 1, n, CASE WHEN most > 0 THEN content ELSE raw END, page_start, page_end, CASE WHEN most > 0 THEN 0.48 ELSE 0.35 END, 0, false, true
FROM (SELECT *, CASE WHEN most > 0 THEN 'Material introductorio / sin encabezado detectado' ELSE 'Material general' END AS n FROM t WHERE nth = 0 AND (most = 0 OR length(content) >= 90))""")
def _(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("i", "text")).withColumn("i", F.col("i").cast("long") + 1)
    i = F.col("i")
    lines = words.withColumns({"page": F.floor(i / 20), "line": i % 20})
    marked = lines.filter((i * i + F.col("doc_id")) % 11 == 0).filter("text <> ''")
    confidence = F.when(i % 3 == 1, 0.5).when(i % 3 == 2, 0.7).otherwise(0.0)
    told = marked.select("doc_id", "page", "line", F.concat(F.lit("T"), (i % 5).cast("string")).alias("title"), (1 + (i * 7 + F.col("doc_id")) % 5).alias("level"), confidence.alias("confidence"))
    return segments.boundary_sections(lines, told, "doc_id").withColumn("path", F.array_join("path", ">"))


ASSIGNED_SQL = """
c AS (SELECT l_orderkey AS doc, 'g' || l_linenumber AS segment_id, l_linenumber AS pos, repeat('ab ' || l_partkey || ' ', l_suppkey % 30) || repeat('z', 60) AS content, l_linenumber * 2 AS a, l_linenumber * 2 + l_partkey % 3 AS b, CASE WHEN l_suppkey % 5 = 0 THEN 'reference' ELSE 'included' END AS scope, CASE WHEN l_suppkey % 2 = 0 THEN 'teacher' END AS src FROM lineitem),
x AS (SELECT l_orderkey AS doc, 'g' || (l_linenumber + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS segment_id, 'T' || l_returnflag AS title, CASE l_linestatus WHEN 'O' THEN 'anexo' ELSE 'contenido' END AS role, l_discount * 10 AS confidence, CASE WHEN l_tax > 0.04 THEN l_linestatus ELSE '' END AS why FROM lineitem),
n AS (SELECT doc, segment_id, count(*) AS held FROM c GROUP BY ALL), t AS (SELECT doc, segment_id, count(*) AS told FROM x GROUP BY ALL),
m AS (SELECT doc, segment_id, coalesce(held, 0) AS held, coalesce(told, 0) AS told FROM n FULL JOIN t USING (doc, segment_id)),
faults AS (SELECT doc, segment_id, 'unassigned' AS fault FROM m WHERE told = 0 UNION ALL SELECT doc, segment_id, 'unknown' FROM m WHERE held = 0 UNION ALL SELECT doc, segment_id, 'repeated' FROM m WHERE held > 1 UNION ALL SELECT doc, segment_id, 'contested' FROM m WHERE told > 1)"""


def _assigned(spark, sf):
    lines, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    filler = F.concat(F.lit("ab "), F.col("l_partkey").cast("string"), F.lit(" "))
    chunks = lines.select(
        F.col("l_orderkey").alias("doc"), F.concat(F.lit("g"), n.cast("string")).alias("segment_id"), n.alias("pos"), F.concat(F.repeat(filler, (F.col("l_suppkey") % 30).cast("int")), F.lit("z" * 60)).alias("content"), (n * 2).alias("page_start"), (n * 2 + F.col("l_partkey") % 3).alias("page_end"),
        F.when(F.col("l_suppkey") % 5 == 0, "reference").otherwise("included").alias("scope"), F.when(F.col("l_suppkey") % 2 == 0, "teacher").alias("scope_source"), F.lit("normal").alias("priority"), F.lit(None).cast("string").alias("priority_source"), F.lit("central").alias("document_priority"))
    moved = F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)
    told = lines.select(
        F.col("l_orderkey").alias("doc"), F.concat(F.lit("g"), (n + moved).cast("string")).alias("segment_id"), F.concat(F.lit("T"), "l_returnflag").alias("title"), F.array("l_returnflag", "l_linestatus").alias("path"), F.lit(1).alias("level"),
        F.when(F.col("l_linestatus") == "O", "anexo").otherwise("contenido").alias("role"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).otherwise("").alias("rationale"))
    return chunks, told


@SEGMENTS.add("assignment_faults", "doc bigint, segment_id string, fault string", f"WITH {ASSIGNED_SQL} SELECT * FROM faults")
def _(spark, sf):
    return segments.assignment_faults(*_assigned(spark, sf), "doc")


@SEGMENTS.add("assigned_sections", "doc bigint, nth bigint, section_id string, title string, role string, confidence double, page_start bigint, page_end bigint, fragments bigint, evidence string, content string, scope string, scope_source string, priority string, needs_review boolean", f"""
WITH RECURSIVE {ASSIGNED_SQL}, j AS (SELECT c.*, x.title, x.role, x.confidence, x.why, CASE WHEN src = 'teacher' THEN scope ELSE '' END AS own FROM c JOIN x USING (doc, segment_id) WHERE doc NOT IN (SELECT doc FROM faults)),
s AS (SELECT *, CASE WHEN title = lag(title) OVER w AND role = lag(role) OVER w AND own = lag(own) OVER w THEN 0 ELSE 1 END AS start FROM j WINDOW w AS (PARTITION BY doc ORDER BY pos)),
i AS (SELECT *, sum(start) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth, trim(content) AS body FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, nth ORDER BY pos) AS r FROM i),
walk AS (SELECT doc, nth, r, body AS done FROM k WHERE r = 1
  UNION ALL SELECT doc, nth, r, CASE WHEN rest = '' THEN done ELSE done || chr(10) || chr(10) || rest END FROM (
    SELECT k.doc, k.nth, k.r, done, ltrim(substr(body, 1 + coalesce(list_filter(range(320, 39, -1), lambda z: z <= length(done) AND z <= length(body) AND right(done, z) = left(body, z))[1], 0))) AS rest FROM walk w JOIN k ON k.doc = w.doc AND k.nth = w.nth AND k.r = w.r + 1)),
g AS (SELECT doc, nth, any_value(title) AS title, any_value(role) AS role, min(confidence) AS confidence, min(a) AS page_start, max(b) AS page_end, count(*) AS fragments, arg_min(own, pos) AS own, coalesce(string_agg(why, '|' ORDER BY pos) FILTER (why <> '' ), '') AS whys, count(DISTINCT why) FILTER (why <> '') AS kinds FROM i GROUP BY doc, nth)
SELECT doc, nth, doc || '-externa-seccion-' || nth AS section_id, title, role, confidence, page_start, page_end, fragments, CASE WHEN kinds > 0 THEN left(whys, 1) ELSE '' END AS evidence, done AS content,
       CASE WHEN own <> '' THEN own WHEN role = 'anexo' THEN 'reference' ELSE 'included' END AS scope, CASE WHEN own <> '' THEN 'teacher' ELSE 'role-default' END AS scope_source, 'central' AS priority, confidence < 0.7 AS needs_review
FROM g JOIN (SELECT doc, nth, arg_max(done, r) AS done FROM walk GROUP BY doc, nth) USING (doc, nth)""")
def _(spark, sf):
    return segments.assigned_sections(*_assigned(spark, sf), "doc")[0].withColumn("evidence", F.array_join("evidence", "|"))


@SEGMENTS.add("section_fragments", "section bigint, document_id bigint, page_start bigint, page_end bigint, fragments bigint, preview string, text string", """
WITH s AS (SELECT o_orderkey AS section, o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 's1' END AS sid, 'Título ' || o_orderkey % 2 AS title, o_orderstatus AS path, CASE WHEN o_orderkey % 4 > 0 THEN 5 END AS a, CASE WHEN o_orderkey % 4 = 1 THEN 6 END AS b FROM orders),
c AS (SELECT l_orderkey AS doc, l_linenumber * 100000000 + l_partkey * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_extendedprice) + l_orderkey * 100000000000 AS chunk, 's' || l_linenumber % 3 AS sid, l_linestatus AS path, l_linenumber % 2 AS t, l_suppkey % 4 AS a, l_suppkey % 4 + l_partkey % 2 AS b, 'c' || l_partkey AS content FROM lineitem),
m AS (SELECT section, s.doc, s.a, s.b, chunk, c.a AS ca, nullif(c.b, 0) AS cb, content FROM s LEFT JOIN c ON c.doc = s.doc AND (c.sid = s.sid OR (c.path = s.path AND c.t = s.section % 2))),
g AS (SELECT section, doc, any_value(a) AS a, any_value(b) AS b, count(chunk) AS n, list({'ca': ca, 'chunk': chunk, 'cb': cb} ORDER BY ca, chunk)[1] AS f, coalesce(string_agg(content, ' ' ORDER BY ca, chunk), '') AS text FROM m GROUP BY section, doc)
SELECT section, doc AS document_id, coalesce(a, nullif(f.ca, 0)) AS page_start, coalesce(b, f.cb, nullif(f.ca, 0)) AS page_end, n AS fragments, left(text, 180) AS preview, text FROM g""")
def _(spark, sf):
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    sections = table(spark, sf, "orders").select(
        k.alias("section"), k.alias("document_id"), F.when(k % 3 == 0, "s1").alias("section_id"), F.concat(F.lit("Título "), (k % 2).cast("string")).alias("title"), F.array("o_orderstatus").alias("path"), F.when(k % 4 > 0, 5).alias("page_start"), F.when(k % 4 == 1, 6).alias("page_end"))
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "document_id").withColumn("place", F.col("document_id") * 100_000_000_000 + n * 100_000_000 + F.col("l_partkey") * 1000).repartition("document_id")
    nth = F.row_number().over(Window.partitionBy("document_id", "place").orderBy("l_suppkey", "l_extendedprice"))
    chunks = lines.withColumn("nth", nth).select(
        (F.col("place") + F.col("nth")).alias("chunk"), "document_id", F.concat(F.lit("s"), (n % 3).cast("string")).alias("section_id"), F.array("l_linestatus").alias("path"), F.concat(F.lit("TITULO "), (n % 2).cast("string"), F.lit(" · parte "), n.cast("string")).alias("title"),
        (F.col("l_suppkey") % 4).alias("page_start"), (F.col("l_suppkey") % 4 + F.col("l_partkey") % 2).alias("page_end"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("content"))
    return segments.section_fragments(sections, chunks)


@SEGMENTS.add("document_forms", "doc_id bigint, pages bigint, long_lines bigint, short_share double, form string", rf"""
WITH l AS (SELECT doc_id, i // 2 AS page, line AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), 'e ')) AS line, generate_subscripts(string_split(coalesce(text, ''), 'e '), 1) AS i FROM documents)),
p AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM (SELECT DISTINCT doc_id, page FROM l)),
t AS (SELECT doc_id, count(*) FILTER (length(text) > 90) AS long_lines, avg((length(text) <= 70)::INT) AS short_share, max(page) - min(page) + 1 AS pages, bool_or(nth <= 8 AND regexp_matches(text, '(?i)\b({segments.OF_THESES})\b')) AS thesis, bool_or(nth <= 8 AND regexp_matches(text, '(?i)\b({segments.OF_ARTICLES})\b')) AS article FROM l JOIN p USING (doc_id, page) GROUP BY doc_id)
SELECT doc_id, pages, long_lines, short_share, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN thesis THEN '{segments.THESIS}' WHEN pages >= 25 THEN '{segments.MONOGRAPH}' ELSE '{segments.STRUCTURED}' END
       WHEN article AND long_lines > 5 THEN '{segments.ARTICLE}' WHEN short_share > 0.62::DOUBLE AND pages <= 40 THEN '{segments.NOTES}' ELSE '{segments.PLAIN}' END AS form FROM t""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "e ")).alias("i", "text")).withColumn("page", F.floor((F.col("i") + 1) / 2))
    return segments.document_forms(lines.select("doc_id", "page").distinct(), lines, docs.filter("doc_id % 3 = 0"), "doc_id")


@SEGMENTS.add("retrieved_ids", "q_id bigint, ids string", """
WITH h AS (SELECT l_orderkey AS q_id, l_linenumber AS place, l_suppkey % 3 AS kind, l_partkey AS id FROM lineitem),
x AS (SELECT q_id, place, kind, id, 1 AS i, id::VARCHAR AS v FROM h WHERE kind > 0 UNION ALL SELECT q_id, place, kind, id, i, [p_brand, p_type][i] FROM h JOIN part ON p_partkey = id, (SELECT unnest([1, 2]) AS i) WHERE kind = 0),
f AS (SELECT q_id, v, min({'p': place, 'k': kind, 'id': id, 'i': i}) AS a FROM x GROUP BY q_id, v)
SELECT q_id, string_agg(v, '|' ORDER BY a) AS ids FROM f GROUP BY q_id""")
def _(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("place"), (F.col("l_suppkey") % 3).alias("kind"), F.col("l_partkey").alias("id"))
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", F.lit(None), F.lit(""), "p_type").alias("sources"))
    return retrieval.retrieved_ids(hits, entries).withColumn("ids", F.array_join("ids", "|"))


@SEGMENTS.add("index_summary", "p_brand string, entries bigint, evidence bigint, processed bigint, total bigint, status string", """
WITH e AS (SELECT p_brand, count(*) AS entries, sum(CASE WHEN p_size % 4 = 0 THEN 0 ELSE 2 END) AS evidence FROM part GROUP BY p_brand), d AS (SELECT p_brand, count(DISTINCT l_orderkey) AS processed FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand),
i AS (SELECT 'Brand#' || s_suppkey AS p_brand, s_suppkey * 3 AS total, s_name AS status FROM supplier)
SELECT p_brand, coalesce(entries, 0) AS entries, coalesce(evidence, 0) AS evidence, coalesce(processed, 0) AS processed, coalesce(total, 0) AS total, coalesce(status, 'empty') AS status FROM e FULL JOIN d USING (p_brand) FULL JOIN i USING (p_brand)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    entries = part.select("p_brand", F.when(F.col("p_size") % 4 > 0, F.array("p_name", "p_type")).alias("evidence"))
    done = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("p_brand", F.col("l_orderkey").alias("passage_id"))
    index = table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("p_brand"), (F.col("s_suppkey") * 3).alias("total_passages"), F.col("s_name").alias("status"))
    return knowledge.index_summary(entries, done, index, "p_brand")
