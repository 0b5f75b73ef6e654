"""Queries of boundaries, of documents analysed from their lines, and of headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import boundaries
from lectern.operators.structure import lines_of
from lectern.plans import pages
from lectern.queries import Catalogue
from lectern.sources.tables import table

BOUNDARIES = Catalogue()

CHOICE_SQL = """
o AS (SELECT o_custkey // 10 AS doc, o_orderkey AS k, 'asunto ' || translate((1000 + o_orderkey * o_orderkey % 23)::VARCHAR, '0123456789', 'qwrtpsdfgh') AS title FROM orders), documents AS (SELECT DISTINCT doc, 200 AS pages FROM o),
contents AS (SELECT doc, CASE doc % 4 WHEN 0 THEN 2 ELSE 180 END AS fp, CASE doc % 4 WHEN 0 THEN 3 ELSE 181 END AS lp, 0.8::DOUBLE AS conf FROM documents WHERE doc % 4 < 2),
entries AS (SELECT doc, min(k) AS nth, title, printed FROM (SELECT *, k % 190 + 4 AS printed FROM o WHERE k % 3 = 0) GROUP BY doc, title, printed),
outline AS (SELECT doc, k AS nth, title, k * 3 % 230 AS page FROM o WHERE k % 3 = 1 AND doc % 5 = 2),
headings AS (SELECT doc, k * 7 % 190 + 1 AS page, k % 7 + 1 AS line, title, (k % 10)::DOUBLE / 10 AS confidence, CASE WHEN doc % 7 = 3 THEN 1 ELSE k % 16 END AS score, CASE WHEN k % 3 = 0 THEN '1' ELSE '' END AS number FROM o WHERE k % 5 > 0),
lists AS (SELECT c.*, pages, fp - 1 >= 0.55 * pages AS behind FROM contents c JOIN documents USING (doc)),
body AS (SELECT h.* FROM headings h JOIN lists USING (doc) WHERE CASE WHEN behind THEN page < fp ELSE page > lp END),
known AS (
  SELECT l.*, lo, hi, n_entries, p_lo, p_hi FROM lists l JOIN (SELECT doc, count(*) AS n_body, min(page) AS lo, max(page) AS hi FROM body GROUP BY doc) USING (doc)
  JOIN (SELECT doc, count(*) AS n_entries, min(printed) AS p_lo, max(printed) AS p_hi FROM entries GROUP BY doc) USING (doc) WHERE n_body >= 3 AND n_entries >= 3),
aims AS (
  SELECT e.*, CASE WHEN behind AND p_hi > p_lo THEN lo + (printed - p_lo)::DOUBLE / (p_hi - p_lo) * (hi - lo) ELSE greatest(CASE WHEN behind THEN lo ELSE lp + 1 END, least(CASE WHEN behind THEN hi ELSE pages END, printed))::DOUBLE END AS aim
  FROM entries e JOIN known USING (doc)),
there AS (SELECT o.* FROM outline o WHERE page BETWEEN 1 AND 200),
pairs AS (
  SELECT 'contents' AS strategy, doc, nth, page * 100000 + line AS pos, max(0.62::DOUBLE + greatest(0::DOUBLE, 0.18::DOUBLE - 0.004::DOUBLE * abs(page - aim)) + 0.16::DOUBLE * confidence) AS score FROM aims JOIN body USING (doc, title) GROUP BY ALL
  UNION ALL SELECT 'outline', t.doc, nth, h.page * 100000 + line, max(0.62::DOUBLE + greatest(0::DOUBLE, 0.18::DOUBLE - 0.004::DOUBLE * abs(h.page - t.page)) + 0.16::DOUBLE * confidence) FROM there t JOIN headings h ON t.doc = h.doc AND t.title = h.title GROUP BY ALL
  UNION ALL SELECT 'outline', doc, nth, page * 100000, 0.5::DOUBLE FROM there),
p AS (SELECT *, round(score * 1000000)::BIGINT AS weight, row_number() OVER (PARTITION BY strategy, doc ORDER BY nth, pos, round(score * 1000000), score) AS i FROM pairs),
walk AS (
  SELECT strategy, doc, 0::BIGINT AS i, []::STRUCT(nth BIGINT, pos BIGINT, total BIGINT, before BIGINT, score DOUBLE)[] AS done FROM (SELECT DISTINCT strategy, doc FROM p)
  UNION ALL
  SELECT strategy, doc, i, list_append(done, {'nth': nth, 'pos': pos, 'total': weight + coalesce(b // 100000, 0), 'before': CASE WHEN b IS NULL THEN -1 ELSE 99999 - b % 100000 END, 'score': score})
  FROM (SELECT p.*, done, list_max(list_transform(done, lambda d, j: CASE WHEN d.nth < p.nth AND d.pos <= p.pos THEN d.total * 100000 + 100000 - j END)) AS b FROM walk w JOIN p ON p.strategy = w.strategy AND p.doc = w.doc AND p.i = w.i + 1)),
full_walk AS (SELECT strategy, doc, done FROM walk JOIN (SELECT strategy, doc, max(i) AS i FROM p GROUP BY ALL) USING (strategy, doc, i)),
trace AS (
  SELECT strategy, doc, 99999 - list_max(list_transform(done, lambda d, j: d.total * 100000 + 100000 - j)) % 100000 AS at_i FROM full_walk
  UNION ALL SELECT t.strategy, t.doc, done[at_i + 1].before FROM trace t JOIN full_walk f ON t.strategy = f.strategy AND t.doc = f.doc WHERE done[at_i + 1].before >= 0),
chain AS (SELECT strategy, doc, done[at_i + 1].nth AS nth, done[at_i + 1].pos AS pos, done[at_i + 1].score AS score FROM trace JOIN full_walk USING (strategy, doc)),
strong AS (SELECT *, count(*) FILTER (number <> '') OVER (PARTITION BY doc) AS numbered FROM headings WHERE score >= 9),
picked AS (SELECT doc, page, line, score, confidence FROM strong WHERE numbered < 2 OR number <> '' OR score >= 12),
stepped AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc, page ORDER BY line) <= 1 THEN 0 ELSE 1 END AS opens FROM picked),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc, page ORDER BY line) AS run FROM stepped),
looks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, run ORDER BY score DESC, line) AS r FROM runs) WHERE r = 1),
rows AS (
  SELECT strategy, doc, pos, CASE WHEN strategy = 'contents' THEN greatest(0.72::DOUBLE, least(0.995::DOUBLE, score)) WHEN score > 0.5 THEN greatest(0.76::DOUBLE, least(0.99::DOUBLE, score)) ELSE 0.72::DOUBLE END AS confidence FROM chain
  UNION ALL SELECT 'looks', doc, page * 100000 + line, confidence FROM looks UNION ALL SELECT 'whole', doc, 100000, 0.34::DOUBLE FROM documents),
sums AS (SELECT strategy, doc, count(*) AS n, median(confidence) AS middle FROM rows GROUP BY ALL),
met AS (SELECT doc, count(DISTINCT nth) AS confirmed FROM pairs WHERE strategy = 'contents' GROUP BY doc),
verdicts AS (
  SELECT k.doc, 1 AS r, 'contents' AS strategy, n_entries AS entries, confirmed, greatest(0.65::DOUBLE, least(0.99::DOUBLE, (conf + middle) / 2)) AS confidence FROM known k JOIN met USING (doc) JOIN sums s ON s.doc = k.doc AND s.strategy = 'contents'
  WHERE confirmed >= greatest(3, ceil(n_entries * CASE WHEN behind THEN 0.20::DOUBLE ELSE 0.55::DOUBLE END)) AND n >= 3
  UNION ALL SELECT s.doc, 2, 'outline', (SELECT count(*) FROM there t WHERE t.doc = s.doc), (SELECT count(*) FROM chain c WHERE c.doc = s.doc AND c.strategy = 'outline' AND score > 0.5), middle FROM sums s WHERE strategy = 'outline' AND n >= 2
  UNION ALL SELECT doc, 3, 'looks', n, n, greatest(0.58::DOUBLE, least(0.92::DOUBLE, (SELECT median(confidence) FROM looks l WHERE l.doc = s.doc))) FROM sums s WHERE strategy = 'looks' AND n >= 2
  UNION ALL SELECT doc, 4, 'whole', 0, 0, 0.34::DOUBLE FROM documents),
choice AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY r) AS first_r FROM verdicts) WHERE first_r = 1)"""


def _choice(spark, sf):
    """Orders as contents entries, outline entries and headings of a document for each ten customers; titles repeat."""
    k, doc = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 10).alias("doc")
    o, title = table(spark, sf, "orders"), F.concat(F.lit("asunto "), F.translate((1000 + k * k % 23).cast("string"), "0123456789", "qwrtpsdfgh")).alias("title")
    documents = o.select(doc).distinct().withColumn("pages", F.lit(200))
    front = F.col("doc") % 4 == 0
    contents = documents.filter("doc % 4 < 2").select("doc", F.when(front, 2).otherwise(180).alias("first_page"), F.when(front, 3).otherwise(181).alias("last_page"), F.lit(0.8).alias("confidence"))
    entries = o.filter("o_orderkey % 3 = 0").select(doc, k.alias("nth"), title, F.lit("").alias("number"), F.lit(1).alias("level"), (k % 190 + 4).alias("printed"))
    outline = o.filter("o_orderkey % 3 = 1").select(doc, k.alias("nth"), title, F.lit(1).alias("level"), (k * 3 % 230).alias("page")).filter("doc % 5 = 2")
    headings = o.filter("o_orderkey % 5 > 0").select(doc, (k * 7 % 190 + 1).alias("page"), (k % 7 + 1).alias("line"), title, F.when(k % 3 == 0, "1").otherwise("").alias("number"), F.lit(1).alias("level"), (k % 16).alias("score"), ((k % 10) / 10.0).alias("confidence"))
    headings = headings.withColumn("score", F.when(F.col("doc") % 7 == 3, 1).otherwise(F.col("score")))
    return boundaries.choose_boundaries(documents, contents, entries, outline, headings)


@BOUNDARIES.add("boundary_strategies", "doc bigint, strategy string, entries bigint, confirmed bigint, confirmed_share double, boundaries bigint, confidence double", f"WITH RECURSIVE {CHOICE_SQL} SELECT c.doc, c.strategy, entries, confirmed, CASE WHEN entries > 0 THEN confirmed::DOUBLE / entries ELSE 0 END AS confirmed_share, n AS boundaries, confidence FROM choice c JOIN sums s ON c.doc = s.doc AND c.strategy = s.strategy")
def _(spark, sf):
    return _choice(spark, sf)[1]


@BOUNDARIES.add("chosen_boundaries", "doc bigint, strategy string, page bigint, line bigint, confidence double", f"WITH RECURSIVE {CHOICE_SQL} SELECT r.doc, r.strategy, pos // 100000 AS page, pos % 100000 AS line, CASE WHEN r.strategy = 'looks' THEN greatest(0.55::DOUBLE, least(0.92::DOUBLE, r.confidence)) ELSE r.confidence END AS confidence FROM rows r JOIN choice c ON c.doc = r.doc AND c.strategy = r.strategy")
def _(spark, sf):
    return _choice(spark, sf)[0]


BLOCKS_SQL = """
l AS (SELECT l_orderkey % 50 AS doc, l_orderkey AS page, l_linenumber AS line_no, 'Título ' || l_partkey AS t, (790 - 14 * l_linenumber)::DOUBLE AS y, (CASE WHEN l_partkey % 3 = 0 THEN 20 ELSE 16 END)::DOUBLE AS fs, l_quantity > 10 AS bold FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
m AS (SELECT *, fs / median(fs) OVER (PARTITION BY doc, page) AS ratio, row_number() OVER w AS nth, lag(y) OVER w - y AS above, lag(fs) OVER w AS fs_0, lag(bold) OVER w AS bold_0 FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY line_no)),
s AS (SELECT *, bold OR ratio >= 1.18 AS strong FROM m),
j AS (SELECT *, CASE WHEN strong AND lag(strong) OVER (PARTITION BY doc, page ORDER BY line_no) AND above <= greatest(16, 0.95 * fs) AND fs = fs_0 AND bold = bold_0 THEN 0 ELSE 1 END AS opens FROM s),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc, page ORDER BY line_no) AS run FROM j),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc, page, run ORDER BY line_no) - 1) // 4 AS part FROM r WHERE strong),
b AS (SELECT doc, page, run, part, count(*) AS n, min(line_no) AS line_no, max(line_no) AS last_line, string_agg(t, ' ' ORDER BY line_no) AS title, any_value(bold) AS bold, arg_min(ratio, line_no) AS ratio, max(y) AS y FROM k GROUP BY ALL)"""


@BOUNDARIES.add("block_headings", "doc bigint, page bigint, line_no bigint, last_line bigint, title string, score bigint, confidence double", f"""
WITH {BLOCKS_SQL}, z AS (SELECT *, 8 + least(4, 2 * (n - 1)) + CASE WHEN bold THEN 2 ELSE 0 END + CASE WHEN ratio >= 1.22 THEN 2 ELSE 0 END + CASE WHEN ratio >= 1.38 THEN 2 ELSE 0 END + CASE WHEN 1 - y / 800 <= 0.22 THEN 2 ELSE 0 END + 1 + CASE WHEN length(title) <= 85 THEN 1 ELSE 0 END AS score FROM b WHERE n > 1)
SELECT doc, page, line_no, last_line, title, score, greatest(0.62::DOUBLE, least(0.995::DOUBLE, 0.50::DOUBLE + score * 0.04::DOUBLE)) AS confidence FROM z""")
def _(spark, sf):
    """Lines of orders set as pages, close together, in two sizes."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity")).select((F.col("l_orderkey") % 50).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), F.concat(F.lit("Título "), F.col("l_partkey").cast("string")).alias("text"), F.lit(40.0).alias("x"), (790 - 14 * F.col("l_linenumber")).cast("double").alias("y"), F.when(F.col("l_partkey") % 3 == 0, 20.0).otherwise(16.0).alias("font_size"), (F.col("l_quantity") > 10).alias("bold"))
    return pages.block_headings(rows)


@BOUNDARIES.add("analysed_documents", "doc bigint, strategy string, n_headings bigint, n_sections bigint, n_unsure bigint, confidence double")
def _(spark, sf):
    """Texts set as pages of 30 lines, of every fifth of which the first words are set large and bold."""
    at, head = F.col("line_no") - 1, F.regexp_replace(F.array_join(F.slice(F.split("line", " "), 1, 5), " "), r"[.!?;:,]+$", "")
    lines = lines_of(table(spark, sf, "documents")).withColumns({"doc": F.col("doc_id"), "page": (F.floor(at / 30) + 1).cast("long"), "large": at % 5 == 0})
    placed = lines.select("doc", "page", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("large"), head).otherwise(F.col("line")).alias("text"), F.lit(40.0).alias("x"), (790 - 25 * (at % 30)).cast("double").alias("y"), F.when(F.col("large"), 20.0).otherwise(11.0).alias("font_size"), F.col("large").alias("bold"))
    documents = placed.groupBy("doc").agg(F.max("page").alias("pages"))
    outline = placed.filter("doc % 10 = 3 AND large").select("doc", F.col("line_no").alias("nth"), F.col("text").alias("title"), F.lit(1).alias("level"), "page")
    return pages.analyse(placed, documents, outline)[1]
