"""Queries that structure texts, lines and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import CONTENT_TITLE, ROLE_TITLES
from lectern.operators import passages, structure
from lectern.plans import course
from lectern.queries import Catalogue
from lectern.queries.texts import fold_sql, key_sql, squeeze_sql
from lectern.sources.tables import table

DOCUMENTS = Catalogue()

CLEAN_SQL = r"trim(regexp_replace(replace(line, chr(173), ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
PAGE_NUMBER_SQL = r"(regexp_matches({x}, '(?i)^(page|p[aá]gina)[ ]+[0-9]+$') OR regexp_matches({x}, '^[-–—]?[ ]*[0-9]+[ ]*[-–—]?$'))"
LINES_SQL = "lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)"
FURNITURE_SQL = rf"""
edges AS (SELECT source, doc_id, unnest(CASE WHEN len(l) <= 6 THEN l ELSE list_concat(l[1:3], l[-3:]) END) AS line FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT source, {key_sql('line')} AS key FROM edges WHERE {CLEAN_SQL} <> '' AND length({CLEAN_SQL}) <= 120 AND NOT {PAGE_NUMBER_SQL.format(x=CLEAN_SQL)}),
furniture AS (SELECT source, key, n FROM (SELECT source, key, count(*) AS n FROM keyed WHERE key <> '' GROUP BY source, key) JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) USING (source) WHERE n >= greatest(2, ceil(0.02 * pages)))"""


def _furniture(spark, sf):
    docs = table(spark, sf, "documents")
    return structure.repeated_furniture(structure.edge_lines(docs, "source", "doc_id"), docs, "source", share=0.02)


@DOCUMENTS.add("repeated_furniture", "source string, key string, n bigint", f"WITH {FURNITURE_SQL} SELECT * FROM furniture")
def _(spark, sf):
    return _furniture(spark, sf)


@DOCUMENTS.add("noise_filtered_lines", "doc_id bigint, line_no bigint, line string", f"WITH {FURNITURE_SQL}, {LINES_SQL} SELECT doc_id, line_no, line FROM lines l WHERE {CLEAN_SQL} <> '' AND NOT {PAGE_NUMBER_SQL.format(x=CLEAN_SQL)} AND NOT EXISTS (SELECT 1 FROM furniture f WHERE f.source = l.source AND f.key = {key_sql('l.line')})")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    lines = structure.lines_of(docs).join(docs.select("doc_id", "source"), "doc_id")
    return structure.without_noise(lines, _furniture(spark, sf), "source")


@DOCUMENTS.add("heading_lines", "doc_id bigint, line_no bigint", rf"WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, {CLEAN_SQL} AS x FROM lines) SELECT doc_id, line_no FROM c WHERE length(x) BETWEEN 1 AND 150 AND len(string_split(x, ' ')) <= 20 AND regexp_matches(x, '^([0-9]+(\.[0-9]+)*[.)]?\s+)?[A-ZÀ-Þ]') AND NOT regexp_matches(x, '[.!?;:,]$')")
def _(spark, sf):
    return structure.lines_of(table(spark, sf, "documents")).filter(structure.heading_like("line")).select("doc_id", "line_no")


REF_SQL = r"(regexp_matches({x}, '(?i)\([0-9]{{4}}[a-z]?\)|\bpp?\.\s*[0-9]+|\bdoi\b|10\.[0-9]{{4,9}}/') OR (length({x}) > 35 AND regexp_matches({x}, '^[A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ''’\-]+,\s*([A-ZÁÉÍÓÚÜÑ]\.?\s*){{1,4}}')))"
TOC_SQL = r"regexp_matches({x}, '(\.{{2,}}|·{{2,}}|…{{2,}})\s*[0-9]{{1,4}}$|\s{{2,}}[0-9]{{1,4}}$')"


@DOCUMENTS.add("citation_lines", "o_orderkey bigint, citation boolean, toc boolean", f"SELECT o_orderkey, {REF_SQL.format(x='trim(line)')} AS citation, {TOC_SQL.format(x='rtrim(line)')} AS toc FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Garcia, A. B. (' || (1990 + o_orderkey % 30) || ')' WHEN 1 THEN o_orderpriority || ' ..... ' || (o_orderkey % 300) WHEN 2 THEN 'See pp. ' || o_orderkey ELSE o_orderpriority END AS line FROM orders)")
def _(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("Garcia, A. B. ("), (1990 + k % 30).cast("string"), F.lit(")"))).when(k % 4 == 1, F.concat("o_orderpriority", F.lit(" ..... "), (k % 300).cast("string"))).when(k % 4 == 2, F.concat(F.lit("See pp. "), k.cast("string"))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").withColumn("line", line).select("o_orderkey", structure.is_reference("line").alias("citation"), structure.is_toc_line("line").alias("toc"))


BARE_SQL = r"trim(regexp_replace({x}, '^(([0-9]+(\.[0-9]+)*[.)]?)|([ivxlcdm]+[.)]))\s+', ''))"
RULES_SQL = f"CASE WHEN regexp_matches(t, '{CONTENT_TITLE}') THEN 'contenido' " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{r}'" for r, p in ROLE_TITLES)
ROLES_SQL = rf"""
heads AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Índice general' WHEN 1 THEN '3. Bibliografía' WHEN 2 THEN 'Introduction' WHEN 3 THEN 'IV) Anexo' WHEN 4 THEN 'Ejercicios' WHEN 5 THEN 'Portada' ELSE array_to_string(string_split(text, ' ')[1:4], ' ') END AS title, coalesce(text, '') AS body, doc_id % 40 + 1 AS page FROM documents),
told AS (SELECT *, {BARE_SQL.format(x=squeeze_sql('title'))} AS t, [trim(l, ' ' || chr(9) || chr(13)) for l in string_split(body, chr(10)) if trim(l, ' ' || chr(9) || chr(13)) <> ''] AS ls FROM heads),
counted AS (SELECT *, len([l for l in ls if {TOC_SQL.format(x='l')}])::DOUBLE AS toc, len([l for l in ls if {REF_SQL.format(x='l')}])::DOUBLE AS refs, greatest(1, len(ls))::DOUBLE AS n, length(trim(body, ' ' || chr(10))) BETWEEN 1 AND 140 AND len(ls) <= 5 AS little FROM told),
by_title AS (SELECT *, {RULES_SQL} END AS ruled FROM counted),
roles AS (
  SELECT doc_id, title, coalesce(ruled, CASE WHEN toc >= 2 AND toc / n >= 0.25 THEN 'indice' WHEN refs >= 3 AND refs / n >= 0.3::DOUBLE THEN 'referencias' WHEN little AND page <= 2 THEN 'preliminares' WHEN little AND page >= 39 THEN 'preliminares' ELSE 'contenido' END) AS role,
         CASE WHEN ruled IS NOT NULL THEN 0.98 WHEN toc >= 2 AND toc / n >= 0.25 THEN least(0.97, 0.78 + 0.18 * toc / n) WHEN refs >= 3 AND refs / n >= 0.3::DOUBLE THEN least(0.96, 0.76 + 0.2 * refs / n) WHEN little AND page <= 2 THEN 0.76 WHEN little AND page >= 39 THEN 0.71 ELSE 0.62 END AS confidence
  FROM by_title)"""


def _roles(spark, sf):
    names = {0: "Índice general", 1: "3. Bibliografía", 2: "Introduction", 3: "IV) Anexo", 4: "Ejercicios", 5: "Portada"}
    title = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    for k, name in names.items():
        title = F.when(F.col("doc_id") % 9 == k, name).otherwise(title)
    page = F.col("doc_id") % 40 + 1
    docs = table(spark, sf, "documents").withColumn("title", title)
    return docs.select("doc_id", "title", structure.section_role("title", "text", first_page=page, last_page=page, pages=F.lit(40)).alias("r")).select("doc_id", "title", "r.*")


@DOCUMENTS.add("section_roles", "doc_id bigint, role string, confidence double", f"WITH {ROLES_SQL} SELECT doc_id, role, confidence FROM roles")
def _(spark, sf):
    return _roles(spark, sf)


DEFAULT_SQL = "CASE role WHEN 'contenido' THEN 'included' WHEN 'anexo' THEN 'reference' WHEN 'actividades' THEN 'reference' ELSE 'excluded' END"


@DOCUMENTS.add("role_defaults", "doc_id bigint, scope string, scope_source string, priority string, priority_source string, needs_review boolean", f"""
WITH {ROLES_SQL}, known AS (SELECT doc_id, role, confidence, {DEFAULT_SQL} AS d, CASE WHEN doc_id % 5 = 0 THEN 'included' END AS scope, CASE WHEN doc_id % 10 = 0 THEN 'teacher' END AS scope_source, CASE WHEN doc_id % 4 = 0 THEN 'central' END AS priority, CASE WHEN doc_id % 8 = 0 THEN 'teacher' END AS priority_source FROM roles),
m AS (SELECT *, scope IS NOT NULL AND (coalesce(scope_source = 'teacher', false) OR (scope_source IS NULL AND scope <> d)) AS own FROM known)
SELECT doc_id, CASE WHEN own THEN scope ELSE d END AS scope, CASE WHEN own THEN 'teacher' ELSE 'role-default' END AS scope_source, CASE WHEN priority_source = 'teacher' AND priority IS NOT NULL THEN priority ELSE 'normal' END AS priority,
       CASE WHEN priority_source = 'teacher' AND priority IS NOT NULL THEN 'teacher' ELSE 'document' END AS priority_source, confidence < 0.7::DOUBLE AS needs_review FROM m""")
def _(spark, sf):
    k = F.col("doc_id")
    known = _roles(spark, sf).withColumns({"scope": F.when(k % 5 == 0, "included"), "scope_source": F.when(k % 10 == 0, "teacher"), "priority": F.when(k % 4 == 0, "central"), "priority_source": F.when(k % 8 == 0, "teacher")})
    return structure.with_defaults(known)


@DOCUMENTS.add("scope_counts", "role string, scope string, n bigint", f"WITH {ROLES_SQL} SELECT role, {DEFAULT_SQL} AS scope, count(*) AS n FROM roles GROUP BY 1, 2")
def _(spark, sf):
    return _roles(spark, sf).groupBy("role", structure.role_scope(F.col("role")).alias("scope")).agg(F.count("*").alias("n"))


@DOCUMENTS.add("boundary_roles", "doc_id bigint, role string, confidence double, source string", f"""
WITH {ROLES_SQL}, p AS (SELECT *, ['contenido', 'anexo', 'capitulo', NULL][1 + doc_id % 4] AS proposed, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0 END AS c, doc_id % 7 = 0 AS toc FROM roles)
SELECT doc_id, CASE WHEN confidence >= 0.7::DOUBLE THEN role WHEN proposed IN ('contenido', 'anexo') AND NOT toc THEN proposed ELSE 'contenido' END AS role,
       CASE WHEN confidence >= 0.7::DOUBLE THEN confidence WHEN proposed IN ('contenido', 'anexo') AND NOT toc THEN coalesce(c, 0.5) ELSE 0.5 END AS confidence,
       CASE WHEN confidence >= 0.7::DOUBLE THEN 'rules' WHEN proposed IN ('contenido', 'anexo') AND NOT toc THEN 'ai' ELSE 'rules' END AS source FROM p""")
def _(spark, sf):
    k = F.col("doc_id")
    proposed = F.element_at(F.array(F.lit("contenido"), F.lit("anexo"), F.lit("capitulo"), F.lit(None)), (k % 4 + 1).cast("int"))
    told = structure.boundary_role(F.col("role"), F.col("confidence"), proposed, F.when(k % 3 > 0, (k % 10) / 10.0), k % 7 == 0)
    return _roles(spark, sf).select("doc_id", told.alias("b")).select("doc_id", "b.*")


@DOCUMENTS.add("contents_pages", "doc_id bigint, contents boolean", rf"SELECT doc_id, regexp_matches({fold_sql('x')}, '^\s*(indice|contenido|sumario|contents|table of contents)\b') AND (len(regexp_extract_all({fold_sql('x')}, '\b[0-9]{{1,3}}\b')) >= 5 OR len(regexp_extract_all({fold_sql('x')}, '\.{{2,}}|…{{2,}}|·{{2,}}')) >= 3) AS contents FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Índice ' || (doc_id % 9) || ' ... 1 ... 2 ... 3' ELSE '' END || coalesce(text, '') AS x FROM documents)")
def _(spark, sf):
    x = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Índice "), (F.col("doc_id") % 9).cast("string"), F.lit(" ... 1 ... 2 ... 3"))).otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", structure.is_contents_page(x).alias("contents"))


BLOCKS_SQL = r"""
raw AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(h[1-6]|p|li)>', 1) AS tags, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(h[1-6]|p|li)>', 2) AS texts FROM pages),
blocks AS (SELECT * FROM (SELECT page_id, unnest(range(1, len(tags) + 1)) AS nth, lower(unnest(tags)) AS tag, trim(regexp_replace(regexp_replace(unnest(texts), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM raw) WHERE text <> ''),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY nth) AS section FROM blocks),
sections AS (
  SELECT page_id, section, coalesce(max(text) FILTER (regexp_matches(tag, '^h')), 'Material general') AS title, coalesce(max(try_cast(substr(tag, 2, 1) AS INT)) FILTER (regexp_matches(tag, '^h')), 1) AS level,
         coalesce(string_agg(text, chr(10) ORDER BY nth) FILTER (NOT regexp_matches(tag, '^h')), '') AS body
  FROM marked GROUP BY page_id, section)"""


@DOCUMENTS.add("html_sections", "page_id bigint, section bigint, title string, level bigint, body string", f"WITH {BLOCKS_SQL} SELECT * FROM sections")
def _(spark, sf):
    return structure.sections_of(structure.html_blocks(table(spark, sf, "pages")), "page_id")


#: Headings of several levels: lines of orders, whose quantity gives the level.
HEADS_SQL = "heads AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, 1 + l_quantity::BIGINT % 4 AS level, 'T' || l_partkey AS title, 100 AS last_line FROM lineitem)"


def _heads(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", nth.cast("long").alias("nth"), (1 + F.col("l_quantity").cast("long") % 4).alias("level"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("title"), F.lit(100).cast("long").alias("last_line"))


@DOCUMENTS.add("heading_paths", "l_orderkey bigint, nth bigint, path string", f"""
WITH {HEADS_SQL}, a AS (
  SELECT h.l_orderkey, h.nth, h.title, k.k, (SELECT arg_max({{'level': p.level, 'title': p.title}}, p.nth) FROM heads p WHERE p.l_orderkey = h.l_orderkey AND p.nth < h.nth AND p.level <= k.k) AS near
  FROM heads h, (SELECT unnest([1, 2, 3]) AS k) k WHERE k.k < h.level)
SELECT h.l_orderkey, h.nth, concat_ws('>', string_agg(near.title, '>' ORDER BY k) FILTER (near.level = k), any_value(h.title)) AS path FROM heads h LEFT JOIN a ON a.l_orderkey = h.l_orderkey AND a.nth = h.nth GROUP BY h.l_orderkey, h.nth""")
def _(spark, sf):
    return structure.heading_paths(_heads(spark, sf), "l_orderkey", "nth", deepest=4).withColumn("path", F.array_join("path", ">"))


ENDS_SQL = "ends AS (SELECT h.*, coalesce((SELECT min(n.nth) FROM heads n WHERE n.l_orderkey = h.l_orderkey AND n.nth > h.nth AND n.level <= h.level) - 1, last_line) AS section_end FROM heads h)"


@DOCUMENTS.add("section_extents", "l_orderkey bigint, nth bigint, section_end bigint, own_end bigint", f"WITH {HEADS_SQL}, {ENDS_SQL} SELECT l_orderkey, nth, section_end, coalesce(lead(nth) OVER (PARTITION BY l_orderkey ORDER BY nth) - 1, last_line) AS own_end FROM ends")
def _(spark, sf):
    nested = structure.section_ends(_heads(spark, sf), "l_orderkey", "nth", "last_line").withColumnRenamed("section_end", "nested_end")
    return structure.section_ends(nested, "l_orderkey", "nth", "last_line", nested=False).select("l_orderkey", "nth", F.col("nested_end").alias("section_end"), F.col("section_end").alias("own_end"))


@DOCUMENTS.add("direct_children", "l_orderkey bigint, nth bigint, children bigint", f"WITH {HEADS_SQL}, {ENDS_SQL} SELECT e.l_orderkey, e.nth, count(c.nth) AS children FROM ends e LEFT JOIN heads c ON c.l_orderkey = e.l_orderkey AND c.nth > e.nth AND c.nth <= e.section_end AND c.level = e.level + 1 GROUP BY e.l_orderkey, e.nth")
def _(spark, sf):
    return structure.direct_children(structure.section_ends(_heads(spark, sf), "l_orderkey", "nth", "last_line"), "l_orderkey", "nth")


@DOCUMENTS.add("smooth_levels", "l_orderkey bigint, levels string", f"""
WITH RECURSIVE {HEADS_SQL}, walk AS (SELECT l_orderkey, nth, 1::BIGINT AS level FROM heads WHERE nth = 1 UNION ALL SELECT h.l_orderkey, h.nth, greatest(1, least(h.level, w.level + 1)) FROM walk w JOIN heads h ON h.l_orderkey = w.l_orderkey AND h.nth = w.nth + 1)
SELECT l_orderkey, string_agg(level::VARCHAR, ',' ORDER BY nth) AS levels FROM walk GROUP BY l_orderkey""")
def _(spark, sf):
    rows = _heads(spark, sf).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("level").cast("int").alias("level")))), lambda x: x["level"]).alias("levels"))
    return rows.select("l_orderkey", F.array_join(F.transform(structure.smooth_levels(F.col("levels")), lambda x: x.cast("string")), ",").alias("levels"))


@DOCUMENTS.add("islands", "l_orderkey bigint, nth bigint, island bigint", f"WITH {HEADS_SQL}, m AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY l_orderkey ORDER BY nth) THEN 0 ELSE 1 END AS s FROM heads) SELECT l_orderkey, nth, sum(s) OVER (PARTITION BY l_orderkey ORDER BY nth ROWS UNBOUNDED PRECEDING) AS island FROM m")
def _(spark, sf):
    return structure.islands(_heads(spark, sf), ["l_orderkey"], "nth", "level")


@DOCUMENTS.add("monotone_filter", "l_orderkey bigint, nth bigint", f"WITH {HEADS_SQL}, m AS (SELECT *, max(level) OVER (PARTITION BY l_orderkey ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM heads) SELECT l_orderkey, nth FROM m WHERE most IS NULL OR level >= most")
def _(spark, sf):
    return structure.monotone(_heads(spark, sf), "l_orderkey", "nth", "level")


RANGES_SQL = "ranges AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS range_id, l_partkey % 40 AS start, l_partkey % 40 + l_quantity::BIGINT % 9 AS \"end\", l_suppkey % 3 AS level FROM lineitem)"


def _ranges(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), nth.alias("range_id"), (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + F.col("l_quantity").cast("long") % 9).alias("end"), (F.col("l_suppkey") % 3).alias("level"))


@DOCUMENTS.add("range_end_lead", "doc_id bigint, start bigint, end_page bigint", f"WITH {RANGES_SQL}, s AS (SELECT DISTINCT doc_id, start FROM ranges) SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, 60) AS end_page FROM s")
def _(spark, sf):
    starts = _ranges(spark, sf).select("doc_id", "start").distinct().withColumn("pages", F.lit(60))
    return structure.range_ends(starts, "doc_id", "start", "pages").withColumnRenamed("end", "end_page")


@DOCUMENTS.add("range_overlaps", "doc_id bigint, start bigint, end_page bigint", f"WITH {RANGES_SQL}, m AS (SELECT doc_id, start, \"end\" AS end_page, lag(\"end\") OVER (PARTITION BY doc_id ORDER BY start, \"end\") AS before FROM ranges) SELECT doc_id, start, end_page FROM m WHERE start <= before")
def _(spark, sf):
    return structure.overlaps(_ranges(spark, sf), "doc_id", "start", "end").withColumnRenamed("end", "end_page")


@DOCUMENTS.add("consecutive_batches", "l_suppkey bigint, consecutive boolean", "SELECT l_suppkey, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND count(DISTINCT l_linenumber) = count(*) AS consecutive FROM (SELECT l_orderkey AS l_suppkey, l_linenumber + CASE WHEN l_quantity <= 5 THEN 1 ELSE 0 END AS l_linenumber FROM lineitem) GROUP BY l_suppkey")
def _(spark, sf):
    return structure.gaps_in_sequence(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("l_suppkey"), (F.col("l_linenumber") + F.when(F.col("l_quantity") <= 5, 1).otherwise(0)).alias("l_linenumber")), "l_suppkey", "l_linenumber")


@DOCUMENTS.add("page_containment", "doc_id bigint, page bigint, range_id bigint, start bigint", f"WITH {RANGES_SQL}, p AS (SELECT DISTINCT doc_id, page FROM (SELECT doc_id FROM ranges), (SELECT unnest([5, 15, 25, 35]) AS page)), m AS (SELECT p.doc_id, p.page, r.range_id, r.start, row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY r.start DESC, r.level DESC, r.range_id) AS k FROM p JOIN ranges r ON r.doc_id = p.doc_id AND p.page BETWEEN r.start AND r.\"end\") SELECT doc_id, page, range_id, start FROM m WHERE k = 1")
def _(spark, sf):
    ranges = _ranges(spark, sf)
    pages = ranges.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (5, 15, 25, 35)))).alias("page"))
    return structure.page_containment(pages, ranges, "doc_id", "page")


#: Lines on a page of 600 by 800 points: lines of orders.
GEOMETRY_SQL = "geometry AS (SELECT l_suppkey AS page, CASE WHEN l_linenumber % 2 = 0 OR l_suppkey % 3 = 0 THEN 40 + l_partkey % 5 ELSE 320 + l_partkey % 4 END::DOUBLE AS x, (l_orderkey % 800)::DOUBLE AS y, CASE WHEN l_quantity > 45 THEN 500 ELSE 200 END::DOUBLE AS width, l_orderkey, l_linenumber FROM lineitem)"


def _geometry(spark, sf):
    x = F.when((F.col("l_linenumber") % 2 == 0) | (F.col("l_suppkey") % 3 == 0), 40 + F.col("l_partkey") % 5).otherwise(320 + F.col("l_partkey") % 4).cast("double")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), x.alias("x"), (F.col("l_orderkey") % 800).cast("double").alias("y"), F.when(F.col("l_quantity") > 45, 500.0).otherwise(200.0).alias("width"), "l_orderkey", "l_linenumber")


COLUMNS_SQL = """
e AS (SELECT page, x, count(*) AS n FROM geometry GROUP BY page, x),
s AS (SELECT *, lead(x) OVER w - x AS gap, sum(n) OVER w AS before, sum(n) OVER (PARTITION BY page) AS all_lines FROM e WINDOW w AS (PARTITION BY page ORDER BY x)),
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC NULLS LAST, x) AS k FROM s),
columns AS (SELECT page, CASE WHEN gap >= 0.14 * 600 AND before >= 4 AND all_lines - before >= 4 THEN 2 ELSE 1 END AS columns, CASE WHEN gap >= 0.14 * 600 AND before >= 4 AND all_lines - before >= 4 THEN x + gap / 2 END AS split FROM b WHERE k = 1)"""


@DOCUMENTS.add("column_split_gap", "page bigint, columns bigint, split double", f"WITH {GEOMETRY_SQL}, {COLUMNS_SQL} SELECT * FROM columns")
def _(spark, sf):
    return structure.widest_gap(_geometry(spark, sf), "page", "x", 600.0)


@DOCUMENTS.add("reading_order", "page bigint, l_orderkey bigint, l_linenumber bigint, place bigint", f"WITH {GEOMETRY_SQL}, {COLUMNS_SQL} SELECT page, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN split IS NULL OR width >= 360 THEN 0 WHEN x < split THEN 1 ELSE 2 END, yy DESC, x) AS place FROM (SELECT *, y + l_linenumber / 100.0::DOUBLE + l_orderkey / 1e9::DOUBLE AS yy FROM geometry) JOIN columns USING (page)")
def _(spark, sf):
    lines = _geometry(spark, sf).withColumn("y", F.col("y") + F.col("l_linenumber") / 100.0 + F.col("l_orderkey") / 1e9)
    # A page's columns are one row, met by hash: lines are then sorted once, for their places.
    return structure.reading_order(lines.join(structure.widest_gap(lines, "page", "x", 600.0).hint("shuffle_hash"), "page"), "page", "split")


@DOCUMENTS.add("indent_levels", "l_orderkey bigint, levels string", """
WITH RECURSIVE x AS (SELECT l_orderkey, l_linenumber, (l_partkey % 90)::DOUBLE AS v, row_number() OVER () AS id FROM lineitem), d AS (SELECT l_orderkey, v, row_number() OVER (PARTITION BY l_orderkey ORDER BY v) AS i FROM (SELECT DISTINCT l_orderkey, v FROM x)),
walk AS (SELECT l_orderkey, i, [v] AS a FROM d WHERE i = 1 UNION ALL SELECT d.l_orderkey, d.i, CASE WHEN d.v - w.a[-1] > 14 THEN list_append(w.a, d.v) ELSE w.a END FROM walk w JOIN d ON d.l_orderkey = w.l_orderkey AND d.i = w.i + 1),
anchors AS (SELECT l_orderkey, arg_max(a, i) AS a FROM walk GROUP BY l_orderkey),
near AS (SELECT l_orderkey, l_linenumber, v, k, row_number() OVER (PARTITION BY id ORDER BY abs(a[k] - v), k) AS r FROM (SELECT x.*, a, unnest(range(1, len(a) + 1)) AS k FROM x JOIN anchors USING (l_orderkey)))
SELECT l_orderkey, string_agg(k::VARCHAR, ',' ORDER BY l_linenumber, v) AS levels FROM near WHERE r = 1 GROUP BY l_orderkey""")
def _(spark, sf):
    xs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 90).cast("double").alias("v")))), lambda r: r["v"]).alias("xs"))
    return xs.select("l_orderkey", F.array_join(F.transform(structure.indent_levels(F.col("xs")), lambda k: k.cast("string")), ",").alias("levels"))


@DOCUMENTS.add("median_offset", "l_suppkey bigint, offset_pages double", "SELECT l_suppkey, coalesce(median(l_partkey % 300 - l_linenumber), 0) AS offset_pages FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    mapped = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 300).alias("physical"), F.col("l_linenumber").alias("printed"))
    return structure.page_offset(mapped, "l_suppkey", "physical", "printed").withColumnRenamed("offset", "offset_pages")


@DOCUMENTS.add("work_starts", "source string, doc_id bigint, title string, year string", rf"""
WITH p AS (SELECT source, doc_id, [x for x in string_split(CASE WHEN doc_id % 6 = 0 THEN 'Work ' || doc_id || chr(10) || 'Resumen ' || (1950 + doc_id % 70) || chr(10) ELSE '' END || coalesce(text, ''), chr(10)) if trim(x) <> ''] AS l FROM documents),
m AS (SELECT *, list_position([regexp_matches({squeeze_sql('x')}, '^(resumen|abstract)\b') for x in l[1:14]], true) AS found FROM p)
SELECT source, doc_id, trim(l[1]) AS title, regexp_extract(array_to_string(l[1:14], ' '), '\b((?:19|20)[0-9]{{2}})\b', 1) AS year FROM m WHERE found > 1 AND length(trim(l[1])) BETWEEN 4 AND 200""")
def _(spark, sf):
    head = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Work "), F.col("doc_id").cast("string"), F.lit("\nResumen "), (1950 + F.col("doc_id") % 70).cast("string"), F.lit("\n"))).otherwise("")
    lines = F.filter(F.split(F.concat(head, F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x) != "")
    return structure.work_starts(table(spark, sf, "documents").select("source", "doc_id", lines.alias("lines")), "source", "doc_id")


@DOCUMENTS.add("units_natural", "doc_id bigint, part bigint, unit string", r"""
WITH RECURSIVE p AS (SELECT doc_id, [trim(x, ' ') for x in string_split(coalesce(text, ''), chr(10)) if trim(x, ' ') <> ''] AS ps FROM documents),
walk AS (
  SELECT doc_id, ps, 1 AS i, 0 AS part, ps[1] AS unit FROM p WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN length(unit) + 2 + length(ps[i + 1]) <= 5200 THEN part ELSE part + 1 END, CASE WHEN length(unit) + 2 + length(ps[i + 1]) <= 5200 THEN unit || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END FROM walk WHERE i < len(ps)),
u AS (SELECT doc_id, part, arg_max(unit, i) AS unit FROM walk GROUP BY doc_id, part)
SELECT doc_id, part, CASE WHEN part = 0 THEN unit ELSE right(lag(unit) OVER (PARTITION BY doc_id ORDER BY part), 320) || chr(10) || chr(10) || unit END AS unit FROM u""")
def _(spark, sf):
    packed = passages.with_overlap(passages.pack_units(passages.paragraphs("text")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(packed).alias("part", "unit"))


@DOCUMENTS.add("page_sections_with_roles", "page_id bigint, section bigint, title string, path string, role string, scope string, needs_review boolean")
def _(spark, sf):
    """From pages to sections with path, role and scope."""
    out = course.sections_with_roles(structure.html_blocks(table(spark, sf, "pages")), "page_id")
    return out.withColumn("path", F.array_join("path", " > "))


@DOCUMENTS.add("style_frequency", "l_suppkey bigint, style string, n bigint", "SELECT l_suppkey, style, count(*) AS n FROM (SELECT l_suppkey, l_returnflag || '|' || floor(l_quantity / 5 * 2 + 0.5) / 2 || '|' || CASE WHEN l_linestatus = 'F' THEN 'b' ELSE 'n' END AS style FROM lineitem) GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf):
    style = F.concat_ws("|", "l_returnflag", (F.floor(F.col("l_quantity") / 5 * 2 + 0.5) / 2).cast("string"), F.when(F.col("l_linestatus") == "F", "b").otherwise("n"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey", style.alias("style")).agg(F.count("*").alias("n")).filter("n >= 3")


@DOCUMENTS.add("vertical_gaps", "page bigint, l_orderkey bigint, l_linenumber bigint, gap_before double, gap_after double", f"WITH {GEOMETRY_SQL} SELECT page, l_orderkey, l_linenumber, lag(yy) OVER w - yy AS gap_before, yy - lead(yy) OVER w AS gap_after FROM (SELECT *, y + l_linenumber / 100.0::DOUBLE + l_orderkey / 1e7::DOUBLE AS yy FROM geometry) WINDOW w AS (PARTITION BY page ORDER BY yy DESC)")
def _(spark, sf):
    from pyspark.sql import Window

    lines = _geometry(spark, sf).withColumn("y", F.col("y") + F.col("l_linenumber") / 100.0 + F.col("l_orderkey") / 1e7)
    # Lines at one height follow each other by order and line, so that the result doesn't hang on how rows arrive.
    down = Window.partitionBy("page").orderBy(F.desc("y"), "l_orderkey", "l_linenumber")
    return lines.withColumns({"gap_before": F.lag("y").over(down) - F.col("y"), "gap_after": F.col("y") - F.lead("y").over(down)})
