"""Queries of page layout and of assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import assembly, layout
from lectern.queries import Catalogue
from lectern.queries.texts import fold_sql, key_sql, norm_sql
from lectern.sources.tables import table

PAGES = Catalogue()

ENTRY_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 9) || '.' || (o_orderkey % 4) || ' ' || o_orderpriority || ' ..... ' || (o_orderkey % 400) WHEN 1 THEN 'Capítulo ' || o_orderpriority || '   ' || (o_orderkey % 300) WHEN 2 THEN 'It ends here. ' || o_orderkey % 7 WHEN 3 THEN o_orderpriority ELSE 'ab 3' END"
SECTION_SQL = layout.SECTION_WORD.replace("'", "''")
ENTRIES_SQL = rf"""
raw AS (SELECT o_orderkey, o_custkey, {ENTRY_TEXT} AS txt FROM orders),
clean AS (SELECT *, trim(regexp_replace(txt, '\s+', ' ', 'g')) AS line FROM raw),
cut AS (SELECT *, try_cast(regexp_extract(line, '{layout.ENTRY}', 3) AS INT) AS page, regexp_matches(line, '(\.{{2,}})\s*[0-9]{{1,4}}$') AS dotted, trim(regexp_replace(regexp_extract(line, '{layout.ENTRY}', 1), '[.]{{2,}}\s*$', '')) AS title FROM clean),
num AS (SELECT *, nullif(regexp_extract(title, '^([0-9]+(?:\.[0-9]+){{0,8}})[.)]?\s+\S', 1), '') AS number FROM cut),
fine AS (SELECT *, page IS NOT NULL AND length(title) >= 3 AND page BETWEEN 1 AND 5000 AND NOT (regexp_matches(title, '[.!?;:]$') AND number IS NULL) AS ok FROM num)"""


def _entries(spark, sf):
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    txt = F.when(k % 5 == 0, F.concat(s(k % 9), F.lit("."), s(k % 4), F.lit(" "), "o_orderpriority", F.lit(" ..... "), s(k % 400))).when(k % 5 == 1, F.concat(F.lit("Capítulo "), "o_orderpriority", F.lit("   "), s(k % 300))).when(k % 5 == 2, F.concat(F.lit("It ends here. "), s(k % 7))).when(k % 5 == 3, F.col("o_orderpriority")).otherwise("ab 3")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", txt.alias("text"))


@PAGES.add("contents_entries", "o_orderkey bigint, title string, page bigint, number string, level bigint", f"WITH {ENTRIES_SQL} SELECT o_orderkey, title, page, coalesce(number, '') AS number, coalesce(len(string_split(number, '.')), CASE WHEN regexp_matches(title, '{SECTION_SQL}') THEN 1 ELSE 2 END) AS level FROM fine WHERE ok")
def _(spark, sf):
    return _entries(spark, sf).select("o_orderkey", layout.contents_entry("text").alias("e")).filter("e IS NOT NULL").select("o_orderkey", "e.*")


@PAGES.add("contents_scores", "o_custkey bigint, entries bigint, score double", f"WITH {ENTRIES_SQL}, t AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (ok) AS e, count(*) FILTER (ok AND dotted) AS d, count(*) FILTER (ok AND number IS NOT NULL) AS m FROM fine GROUP BY o_custkey) SELECT o_custkey, e AS entries, 2 * e + 10 * e::DOUBLE / n + 1.5::DOUBLE * d + m AS score FROM t")
def _(spark, sf):
    return layout.contents_scores(_entries(spark, sf), ["o_custkey"])


@PAGES.add("contents_window", "doc bigint, first_page bigint, last_page bigint", """
WITH RECURSIVE s AS (SELECT o_custkey % 100 AS doc, o_custkey // 100 AS page, count(*)::DOUBLE AS score FROM orders GROUP BY ALL), f AS (SELECT doc, min(page) AS start FROM s WHERE page % 3 = 1 GROUP BY doc),
near AS (SELECT s.*, start FROM s JOIN f USING (doc) WHERE page >= start AND page < start + 50), b AS (SELECT doc, page AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS r FROM near) WHERE r = 1 AND score >= 10),
t AS (SELECT n.*, row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM near n JOIN b USING (doc) WHERE page >= best),
walk AS (SELECT doc, i, start, page AS last_page, 0 AS quiet FROM t WHERE i = 1 UNION ALL SELECT t.doc, t.i, t.start, CASE WHEN t.score >= 6 THEN t.page ELSE w.last_page END, CASE WHEN t.score >= 6 THEN 0 ELSE w.quiet + 1 END FROM walk w JOIN t ON t.doc = w.doc AND t.i = w.i + 1 WHERE w.quiet < 2)
SELECT doc, min(start) AS first_page, max(last_page) AS last_page FROM walk GROUP BY doc""")
def _(spark, sf):
    scores = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("doc"), F.floor(F.col("o_custkey") / 100).alias("page")).agg(F.count("*").cast("double").alias("score"))
    return layout.contents_window(scores, scores.filter("page % 3 = 1"), "doc", "page").withColumnsRenamed({"start": "first_page", "end": "last_page"})


ITEMS_SQL = "items AS (SELECT l_suppkey AS page, l_partkey % 7 || CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS txt, (l_partkey % 560)::DOUBLE AS x, (l_orderkey % 160 * 5)::DOUBLE AS y, 9.0::DOUBLE AS width, 10.0::DOUBLE AS font_size FROM lineitem)"


@PAGES.add("lines_from_items", "page bigint, line_no bigint, txt string, items bigint", f"""
WITH {ITEMS_SQL}, g AS (SELECT *, lag(x + width) OVER (PARTITION BY page, y ORDER BY x, txt) AS before FROM items), c AS (SELECT *, CASE WHEN before IS NULL OR x - before > 72 THEN 1 ELSE 0 END AS cut FROM g),
p AS (SELECT *, sum(cut) OVER (PARTITION BY page, y ORDER BY x, txt ROWS UNBOUNDED PRECEDING) AS part FROM c),
l AS (SELECT page, y, part, string_agg(CASE WHEN cut = 0 AND x - before > 1.5 THEN ' ' ELSE '' END || txt, '' ORDER BY x, CASE WHEN cut = 0 AND x - before > 1.5 THEN ' ' ELSE '' END || txt) AS txt, count(*) AS items FROM p GROUP BY page, y, part)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY y DESC, part) AS line_no, txt, items FROM l""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.concat((F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b")).alias("text"), (F.col("l_partkey") % 560).cast("double").alias("x"), (F.col("l_orderkey") % 160 * 5).cast("double").alias("y"), F.lit(9.0).alias("width"), F.lit(10.0).alias("font_size"))
    return layout.lines_from_items(rows, ["page"]).withColumnRenamed("text", "txt")


@PAGES.add("heading_scores", "doc bigint, page bigint, line_no bigint, score bigint, confidence double", """
WITH l AS (SELECT l_suppkey % 50 AS doc, l_orderkey AS page, l_linenumber AS line_no, (790 - 30 * l_linenumber)::DOUBLE AS y, (9 + l_partkey % 6)::DOUBLE AS fs, l_quantity > 30 AS bold FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
m AS (SELECT *, fs / median(fs) OVER (PARTITION BY doc, page) AS ratio, coalesce(lag(y) OVER w - y, 0) AS above, coalesce(y - lead(y) OVER w, 0) AS below FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY line_no)),
s AS (
  SELECT *, 4 + CASE WHEN bold THEN 2 ELSE 0 END + CASE WHEN ratio >= 1.22 THEN 2 ELSE 0 END + CASE WHEN ratio >= 1.38 THEN 2 ELSE 0 END + CASE WHEN 1 - y / 800 <= 0.22 THEN 2 ELSE 0 END + CASE WHEN above >= greatest(1.4 * fs, 10) THEN 2 ELSE 0 END
         + CASE WHEN below >= greatest(0.9 * fs, 7) THEN 1 ELSE 0 END + 2 AS score FROM m),
f AS (SELECT *, count(*) OVER (PARTITION BY doc, fs, bold) >= 3 AS many FROM s WHERE score >= 7)
SELECT doc, page, line_no, score + CASE WHEN many THEN 2 ELSE 0 END AS score, least(0.99::DOUBLE, 0.42::DOUBLE + score * 0.045::DOUBLE + CASE WHEN many THEN 0.08::DOUBLE ELSE 0 END) AS confidence FROM f""")
def _(spark, sf):
    """Lines of orders set as a page: large and bold now and then."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity")).select((F.col("l_suppkey") % 50).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), F.concat((F.col("l_linenumber") % 4).cast("string"), F.lit(". Título "), F.col("l_partkey").cast("string")).alias("text"), (790 - 30.0 * F.col("l_linenumber")).alias("y"), (9 + F.col("l_partkey") % 6).cast("double").alias("font_size"), (F.col("l_quantity") > 30).alias("bold"))
    return layout.heading_scores(rows, "doc", "page", "line_no")


@PAGES.add("keep_best_neighbour", "l_orderkey bigint, l_linenumber bigint", "WITH c AS (SELECT l_orderkey, n AS l_linenumber, max(l_quantity) AS s FROM (SELECT l_orderkey, l_linenumber * 2 - CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS n, l_quantity FROM lineitem) GROUP BY ALL), n AS (SELECT *, CASE WHEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 1 THEN 0 ELSE 1 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, run ORDER BY s DESC, l_linenumber) AS k FROM r) WHERE k = 1")
def _(spark, sf):
    place = F.col("l_linenumber") * 2 - F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", place.alias("l_linenumber")).agg(F.max("l_quantity").alias("score"))
    return layout.keep_best_neighbour(rows, ["l_orderkey"], "l_linenumber")


@PAGES.add("match_headings", "doc bigint, entry_id bigint, page bigint, similarity double, score double", rf"""
WITH e AS (SELECT p_size AS doc, p_partkey AS entry_id, p_name AS t, p_partkey % 3 AS num, p_partkey % 50 AS target, {key_sql('p_name')} AS k FROM part WHERE p_partkey % 2 = 0),
h AS (SELECT p_size AS doc, p_partkey % 60 AS page, p_name AS t, p_partkey % 3 AS num, (p_partkey % 10) / 10.0::DOUBLE AS c, {key_sql('p_name')} AS k FROM part WHERE p_partkey % 2 = 1),
p AS (SELECT DISTINCT e.doc, e.entry_id, h.page, h.c, e.num AS en, h.num AS hn, target, e.k AS ka, h.k AS kb, list_distinct([x for x in string_split(e.k, ' ') if length(x) >= 3]) AS wa, list_distinct([x for x in string_split(h.k, ' ') if length(x) >= 3]) AS wb FROM e JOIN h USING (doc)),
s AS (SELECT *, len(list_intersect(wa, wb))::DOUBLE AS b, CASE WHEN ka = '' OR kb = '' THEN 0 WHEN ka = kb THEN 1 WHEN (contains(ka, kb) OR contains(kb, ka)) AND least(len(wa), len(wb)) >= 2 THEN 0.93 WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE greatest(len(list_intersect(wa, wb))::DOUBLE / len(wb) * 0.62 + len(list_intersect(wa, wb))::DOUBLE / len(wa) * 0.18, len(list_intersect(wa, wb))::DOUBLE / least(len(wa), len(wb)) * 0.84) END AS sim FROM p),
q AS (SELECT *, round(0.62::DOUBLE * sim + CASE WHEN en = hn THEN 0.22 ELSE 0 END + greatest(0.0::DOUBLE, 0.18::DOUBLE - 0.004::DOUBLE * abs(page - target)) + 0.16::DOUBLE * c, 9) AS score FROM s WHERE sim >= 0.84::DOUBLE)
SELECT doc, entry_id, page, sim AS similarity, score FROM (SELECT *, row_number() OVER (PARTITION BY doc, entry_id ORDER BY score DESC, page, sim DESC) AS r FROM q) WHERE r = 1""")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("doc"), "p_partkey", F.col("p_name").alias("title"), (F.col("p_partkey") % 3).cast("string").alias("number"))
    entries = part.filter("p_partkey % 2 = 0").select("doc", F.col("p_partkey").alias("entry_id"), "title", "number", (F.col("p_partkey") % 50).alias("target"))
    headings = part.filter("p_partkey % 2 = 1").select("doc", (F.col("p_partkey") % 60).alias("page"), "title", "number", ((F.col("p_partkey") % 10) / 10.0).alias("confidence"))
    return layout.match_headings(entries, headings, "doc")


@PAGES.add("logical_units", "source string, parts bigint, excerpt string", """
WITH u AS (SELECT source, list(coalesce(text, '') ORDER BY doc_id) AS t FROM documents GROUP BY ALL), m AS (SELECT *, t[1] AS head, CASE WHEN len(t) > 2 THEN t[len(t) // 2 + 1] ELSE t[1] END AS mid, t[-1] AS tail FROM u),
s AS (SELECT *, greatest(0, floor((length(mid) - 150) / 2.0))::INT AS st FROM m)
SELECT source, len(t) AS parts, CASE WHEN length(head) > 520 THEN left(head, 220) || ' … ' || substr(mid, st + 1, floor((length(mid) + 150) / 2.0)::INT - st) || ' … ' || right(tail, 180) ELSE head END AS excerpt FROM s""")
def _(spark, sf):
    chunks = table(spark, sf, "documents").select("source", "doc_id", F.col("text").alias("content"))
    return assembly.logical_units(chunks, "source", "doc_id", run=64)


@PAGES.add("better_text", "doc_id bigint, n_chars bigint, transcribed boolean", "WITH j AS (SELECT d.doc_id, trim(coalesce(d.text, ''), ' ') AS o, trim(t.text, ' ') AS t FROM documents d LEFT JOIN (SELECT doc_id - 1 AS doc_id, text FROM documents WHERE doc_id % 3 > 0) t USING (doc_id)), u AS (SELECT *, coalesce(length(t) > 0 AND (length(o) < 100 OR length(t) > 1.35 * length(o)), false) AS w FROM j) SELECT doc_id, length(CASE WHEN w THEN t ELSE o END) AS n_chars, w AS transcribed FROM u")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    other = docs.filter("doc_id % 3 > 0").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("transcription"))
    return assembly.better_text(docs, other, "doc_id").select("doc_id", F.length("text").alias("n_chars"), "transcribed")


@PAGES.add("anchored_boundaries", "doc_id bigint, line_no bigint, title string", f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS txt, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents), b AS (SELECT doc_id, line_no, array_to_string(string_split(txt, ' ')[1:3], ' ') AS title FROM l UNION ALL SELECT doc_id, line_no + 1, array_to_string(string_split(txt, ' ')[1:2], ' ') FROM l) SELECT doc_id, line_no, min(b.title) AS title FROM b JOIN l USING (doc_id, line_no) WHERE {norm_sql('b.title')} <> '' AND ((contains({norm_sql('b.title')}, {norm_sql('l.txt')}) AND {norm_sql('l.txt')} <> '') OR contains({norm_sql('l.txt')}, {norm_sql('b.title')})) GROUP BY doc_id, line_no")
def _(spark, sf):
    from lectern.operators.structure import lines_of

    lines = lines_of(table(spark, sf, "documents")).withColumnRenamed("line", "text")
    first = lambda n: F.array_join(F.slice(F.split("text", " "), 1, n), " ").alias("title")
    titles = lines.select("doc_id", "line_no", first(3)).unionByName(lines.select("doc_id", (F.col("line_no") + 1).alias("line_no"), first(2)))
    return assembly.anchored(titles, lines, ["doc_id", "line_no"])


@PAGES.add("proposed_concepts", "slug string, title string", f"WITH c AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS title FROM documents), s AS (SELECT *, left(regexp_replace(regexp_replace({fold_sql('title')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 56) AS slug FROM c), f AS (SELECT slug, arg_min(title, doc_id) AS title FROM s WHERE slug <> '' GROUP BY slug) SELECT slug, title FROM f WHERE slug NOT IN (SELECT slug FROM s WHERE doc_id % 6 = 0)")
def _(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return assembly.proposed_concepts(chunks, chunks.filter("doc_id % 6 = 0"), "doc_id").select("slug", "title")


@PAGES.add("ordered_union", "key bigint, list bigint, pos bigint", "SELECT key, min(list * 1000000 + pos) // 1000000 AS list, min(list * 1000000 + pos) % 1000000 AS pos FROM (SELECT l_partkey AS key, 0 AS list, l_linenumber AS pos FROM lineitem WHERE l_orderkey % 3 = 0 UNION ALL SELECT p_partkey, 1, p_size FROM part) GROUP BY key")
def _(spark, sf):
    first = table(spark, sf, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("pos"))
    return assembly.ordered_union([first, table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("pos"))], "key")


@PAGES.add("appended_range", "o_custkey bigint, first_page bigint, last_page bigint", "SELECT c_custkey AS o_custkey, coalesce(max(o_orderkey % 50), 0) + 1 AS first_page, 45 AS last_page FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING coalesce(max(o_orderkey % 50), 0) + 1 <= 45")
def _(spark, sf):
    ranges = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 50).alias("end"))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(45).alias("page_count"))
    return assembly.appended_range(ranges, pages, "o_custkey").withColumnsRenamed({"start": "first_page", "end": "last_page"})


@PAGES.add("ids_of_titles", "p_partkey bigint, class_id bigint, others bigint", f"WITH s AS (SELECT p_partkey, left(regexp_replace(regexp_replace({fold_sql('p_name')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 72) AS s FROM part), g AS (SELECT s, min(p_partkey) AS class_id, count(*) AS n FROM s GROUP BY s) SELECT p_partkey, class_id, n - 1 AS others FROM s JOIN g USING (s) WHERE n > 1")
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.array(F.upper("p_name")).alias("asked"))
    return assembly.ids_of_titles(rows, "p_partkey", "asked")


@PAGES.add("reading_sequence", "course_id bigint, n_nationkey bigint, place bigint", "WITH f AS (SELECT c_nationkey, min(c_custkey % 40) AS p FROM customer GROUP BY c_nationkey) SELECT n_regionkey AS course_id, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY p NULLS LAST, n_name, n_nationkey) AS place FROM nation LEFT JOIN f ON c_nationkey = n_nationkey")
def _(spark, sf):
    units = table(spark, sf, "nation").select(F.col("n_regionkey").alias("course_id"), "n_nationkey", F.col("n_name").alias("title"))
    sources = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 40).alias("page"))
    return assembly.reading_sequence(units, sources, "n_nationkey")
