"""Queries of index upkeep, contracts and changes to stored data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import contracts, knowledge, maintenance, passages, ranks
from lectern.queries import Catalogue
from lectern.queries.texts import fold_sql, key_sql, norm_sql
from lectern.sources.tables import CORPUS_SQL, bibliography, concepts, corpus, table

UPKEEP = Catalogue()

PIECES_SQL = "pieces AS (SELECT l_orderkey AS doc_id, l_linenumber AS part, l_partkey AS pid, (l_quantity * 40)::BIGINT AS size FROM lineitem)"


@UPKEEP.add("batch_pack", "l_orderkey bigint, batches string", f"""
WITH RECURSIVE {PIECES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, size) AS i FROM pieces),
walk AS (SELECT doc_id, i, 0 AS b, 1 AS n, size AS s FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.n >= 2 OR w.s + p.size > 1800 THEN w.b + 1 ELSE w.b END, CASE WHEN w.n >= 2 OR w.s + p.size > 1800 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 2 OR w.s + p.size > 1800 THEN p.size ELSE w.s + p.size END FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id AS l_orderkey, string_agg(b::VARCHAR, ',' ORDER BY i) AS batches FROM walk GROUP BY doc_id""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") * 40).cast("long").alias("size")))), lambda x: x["size"]).alias("sizes"))
    return rows.select("l_orderkey", F.array_join(F.transform(passages.batches(F.col("sizes"), 2, 1800), lambda b: b.cast("string")), ",").alias("batches"))


@UPKEEP.add("round_robin_sample", "doc_id bigint, source string, turn bigint", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, f LIMIT 50")
def _(spark, sf):
    return knowledge.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@UPKEEP.add("even_sample", "source string, doc_id bigint", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE list_contains([floor(j * (n - 1)::DOUBLE / greatest(least(10, n) - 1, 1) + 0.5)::BIGINT for j in range(0, least(10, n))], i)")
def _(spark, sf):
    return ranks.even_sample(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@UPKEEP.add("budget_prefix", "conv_id bigint, turn bigint, kept string", "WITH s AS (SELECT conv_id, turn, text, least(length(text), 450) AS size FROM conversations), r AS (SELECT *, 1350 - coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s) SELECT conv_id, turn, left(text, least(size, rest)::INT) AS kept FROM r WHERE rest >= 80")
def _(spark, sf):
    return knowledge.within_budget(table(spark, sf, "conversations"), "conv_id", "turn", "text", 1350, 450)


@UPKEEP.add("coverage", "l_orderkey bigint, missing bigint, unexpected bigint, exact boolean", """
WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber AS k FROM lineitem), r AS (SELECT DISTINCT l_orderkey, l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 100 ELSE 0 END AS k FROM lineitem WHERE l_suppkey % 7 > 0)
SELECT l_orderkey, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS unexpected, count(*) FILTER (b IS NULL OR a IS NULL) = 0 AS exact FROM (SELECT l_orderkey, k, 1 AS a FROM e) FULL JOIN (SELECT l_orderkey, k, 1 AS b FROM r) USING (l_orderkey, k) GROUP BY l_orderkey""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    expected = lines.select("l_orderkey", F.col("l_linenumber").alias("k"))
    reviewed = lines.filter("l_suppkey % 7 > 0").select("l_orderkey", (F.col("l_linenumber") + F.when(F.col("l_partkey") % 10 == 0, 100).otherwise(0)).alias("k"))
    return knowledge.coverage(expected, reviewed, "l_orderkey", "k")


@UPKEEP.add("remaining_passages", "doc_id bigint", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return knowledge.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@UPKEEP.add("evidence_supported", "doc_id bigint, supported boolean", f"SELECT d.doc_id, length({norm_sql('q')}) >= 15 AND contains({norm_sql('d.text')}, {norm_sql('q')}) AS supported FROM documents d JOIN (SELECT doc_id + doc_id % 2 AS doc_id, left(text, 10 + (doc_id % 4 * 20)::INT) AS q FROM documents) s ON s.doc_id = d.doc_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    quotes = docs.select((F.col("doc_id") + F.col("doc_id") % 2).alias("doc_id"), F.left("text", (10 + F.col("doc_id") % 4 * 20).cast("int")).alias("q"))
    return docs.join(quotes, "doc_id").select("doc_id", knowledge.is_supported(F.col("text"), F.col("q")).alias("supported"))


@UPKEEP.add("verified_excerpt", "doc_id bigint, excerpt string", r"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, CASE WHEN doc_id % 3 = 0 THEN substr(coalesce(text, ''), 20, 60) ELSE 'nothing of the kind' END AS q, ['the', 'und der', 'avec', 'de la'] AS names FROM documents),
m AS (SELECT *, list_reverse(list_sort([{'n': length(x), 'x': x} for x in names if contains(low, x)]))[1].x AS longest FROM p)
SELECT doc_id, CASE WHEN length(q) >= 32 AND contains(low, lower(q)) THEN left(q, 180) WHEN longest IS NOT NULL THEN substr(t, greatest(1, instr(low, longest) - 85), 180) ELSE left(t, 180) END AS excerpt FROM m""")
def _(spark, sf):
    names = F.array(*(F.lit(x) for x in ("the", "und der", "avec", "de la")))
    text = F.coalesce("text", F.lit(""))
    quote = F.when(F.col("doc_id") % 3 == 0, F.substring(text, 20, 60)).otherwise("nothing of the kind")
    return table(spark, sf, "documents").select("doc_id", knowledge.verified_excerpt(text, quote, names).alias("excerpt"))


@UPKEEP.add("distinct_names", "conv_id bigint, names string", f"WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations), k AS (SELECT *, {norm_sql('w')} AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pl FROM w WHERE {norm_sql('w')} <> ''), f AS (SELECT conv_id, k, min(pl) AS pl, arg_min(trim(w), pl) AS w FROM k GROUP BY conv_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pl) AS n FROM f) SELECT conv_id, string_agg(w, '|' ORDER BY pl) AS names FROM r WHERE n <= 12 GROUP BY conv_id")
def _(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("place", F.struct("turn", "i"))
    return knowledge.distinct_by_key(words, "conv_id", "place", "w", 12).select("conv_id", F.array_join("values", "|").alias("names"))


@UPKEEP.add("rejoined_chunks", "doc_id bigint, whole string", """
WITH c AS (SELECT doc_id, left(t, h + 100) AS a, substr(t, greatest(1, h - 99)) AS b FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 2 AS h FROM documents)),
n AS (SELECT *, coalesce(list_filter(range(320, 39, -1), lambda k: k <= length(a) AND k <= length(b) AND right(a, k) = left(b, k))[1], 0) AS n FROM c)
SELECT doc_id, CASE WHEN a = '' THEN b WHEN substr(b, n + 1) = '' THEN a ELSE a || CASE WHEN n > 0 THEN '' ELSE chr(10) || chr(10) END || substr(b, n + 1) END AS whole FROM n""")
def _(spark, sf):
    """Whole texts cut in two halves that overlap, and joined again; texts that repeat themselves may come out otherwise."""
    t, h = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    return table(spark, sf, "documents").select("doc_id", knowledge.join_overlapping(F.array(F.left(t, h + 100), F.substr(t, F.greatest(F.lit(1), h - 99)))).alias("whole"))


def _entries(spark, sf):
    """Parts as entries: three neighbours share a term, those 999 apart an alias."""
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit("Term "), F.floor(F.col("p_partkey") / 3).cast("string")).alias("term"), F.array(F.concat(F.lit("alias "), (F.col("p_partkey") % 999).cast("string"))).alias("aliases"), F.col("p_name").alias("definition"), F.array("p_partkey", F.col("p_partkey") % 50).alias("evidence"))


ENTRIES_SQL = "entries AS (SELECT p_partkey AS entry_id, 'term ' || p_partkey // 3 AS t, 'alias ' || p_partkey % 999 AS a, p_name AS definition, p_partkey FROM part)"


@UPKEEP.add("entity_groups", "entry_id bigint, root bigint", f"""
WITH RECURSIVE {ENTRIES_SQL}, n AS (SELECT entry_id, t AS name FROM entries UNION SELECT entry_id, a FROM entries), e AS (SELECT DISTINCT x.entry_id AS u, y.entry_id AS v FROM n x JOIN n y USING (name)),
reach AS (SELECT entry_id AS u, entry_id AS v FROM entries UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v)
SELECT u AS entry_id, min(v) AS root FROM reach GROUP BY u""")
def _(spark, sf):
    return knowledge.merge_groups(_entries(spark, sf))


@UPKEEP.add("entity_merge", "root bigint, term string, definition string, merged bigint, n_aliases bigint, evidence string", f"""
WITH RECURSIVE {ENTRIES_SQL}, n AS (SELECT entry_id, t AS name FROM entries UNION SELECT entry_id, a FROM entries), e AS (SELECT DISTINCT x.entry_id AS u, y.entry_id AS v FROM n x JOIN n y USING (name)),
reach AS (SELECT entry_id AS u, entry_id AS v FROM entries UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v), g AS (SELECT u AS entry_id, min(v) AS root FROM reach GROUP BY u),
p AS (SELECT root, pid, min(entry_id * 10 + k) AS f FROM (SELECT root, entry_id, unnest([p_partkey, p_partkey % 50]) AS pid, unnest([0, 1]) AS k FROM entries JOIN g USING (entry_id)) GROUP BY root, pid),
held AS (SELECT root, string_agg(pid::VARCHAR, ',' ORDER BY pid) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY f) AS k FROM p) WHERE k <= 10 GROUP BY root),
al AS (SELECT g.root, least(12, count(DISTINCT name) - 1) AS n_aliases FROM n JOIN g USING (entry_id) GROUP BY g.root)
SELECT g.root, 'Term ' || substr(arg_min(t, entry_id), 6) AS term, arg_max(definition, length(definition) * 100000 - entry_id) AS definition, count(*) AS merged, any_value(n_aliases) AS n_aliases, any_value(evidence) AS evidence
FROM entries JOIN g USING (entry_id) JOIN al USING (root) JOIN held USING (root) GROUP BY g.root""")
def _(spark, sf):
    entries = _entries(spark, sf)
    out = knowledge.merged_entries(entries, knowledge.merge_groups(entries))
    return out.select("root", "term", "definition", "merged", F.size("aliases").alias("n_aliases"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


FNV_SQL = "lpad(lower(to_hex(list_reduce([unicode(c)::BIGINT for c in string_split({0}, '')], lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261))), 8, '0')"


@UPKEEP.add("corpus_signature", "source string, n bigint, signature string", f"""
WITH {CORPUS_SQL}, r AS (SELECT source, pos AS pl, 1 AS n, {FNV_SQL.format("'{\"id\":' || id || ',\"content\":\"' || sha256(content) || '\",\"scope\":\"' || scope || '\"}'")} AS h FROM corpus),
a AS (SELECT source, pl // 16 AS pl, sum(n) AS n, sha256(string_agg(h, '|' ORDER BY pl, h)) AS h FROM r GROUP BY source, pl // 16),
b AS (SELECT source, pl // 16 AS pl, sum(n) AS n, sha256(string_agg(h, '|' ORDER BY pl, h)) AS h FROM a GROUP BY source, pl // 16),
c AS (SELECT source, pl // 16 AS pl, sum(n) AS n, sha256(string_agg(h, '|' ORDER BY pl, h)) AS h FROM b GROUP BY source, pl // 16)
SELECT source, sum(n) AS n, sha256(string_agg(h, '|' ORDER BY pl, h)) AS signature FROM c GROUP BY source""")
def _(spark, sf):
    return knowledge.signature(corpus(spark, sf).withColumn("content", F.sha2("content", 256)), "source", "pos", ["id", "content", "scope"], run=16)


@UPKEEP.add("index_freshness", "source string, current boolean", "SELECT source, ascii(right(source, 1)) % 2 = 0 AS current FROM documents GROUP BY source")
def _(spark, sf):
    now = knowledge.signature(corpus(spark, sf).withColumn("content", F.length("content")), "source", "pos", ["id", "title", "content", "scope"])
    even = F.ascii(F.right("source", F.lit(1))) % 2 == 0
    index = now.select("source", F.lit(3).alias("version"), F.lit("complete").alias("status"), F.when(even, F.col("signature")).otherwise("old").alias("signature"), F.col("n").alias("total_passages"), F.col("n").alias("processed"))
    return knowledge.is_current(index, now, "source")


@UPKEEP.add("dirty_fixpoint", "passage_id bigint", """
WITH RECURSIVE passages AS (SELECT l_orderkey * 10 + l_linenumber AS passage_id, 'b' || l_orderkey AS batch, 'e' || l_partkey || '/' || strftime(l_shipdate, '%Y-%m-%d') AS entry, l_quantity FROM lineitem),
links AS (SELECT batch AS via, passage_id FROM passages UNION SELECT entry, passage_id FROM passages), gone AS (SELECT DISTINCT passage_id FROM passages WHERE l_quantity >= 50), dirty AS (SELECT passage_id FROM gone UNION SELECT b.passage_id FROM dirty d JOIN links a ON a.passage_id = d.passage_id JOIN links b ON b.via = a.via)
SELECT DISTINCT passage_id FROM dirty WHERE passage_id NOT IN (SELECT passage_id FROM gone)""")
def _(spark, sf):
    passages = table(spark, sf, "lineitem").withColumn("passage_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    entries = passages.select(F.concat_ws("/", F.col("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("entry_id"), "passage_id")
    return knowledge.dirty_closure(passages.select(F.col("l_orderkey").alias("batch_id"), "passage_id"), entries, passages.filter("l_quantity >= 50").select("passage_id"))


# Contracts.

@UPKEEP.add("contract_violations", "rule string, entity string, id string, detail string", """
WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_name END AS title, CASE p_size % 10 WHEN 0 THEN 'wrong' WHEN 1 THEN NULL ELSE 'central' END AS priority, p_size AS size FROM part)
SELECT 'required' AS rule, 'concept' AS entity, id::VARCHAR AS id, 'title' AS detail FROM c WHERE trim(title) = '' UNION ALL SELECT 'enum:priority', 'concept', id::VARCHAR, priority FROM c WHERE priority NOT IN ('central', 'normal', 'context') UNION ALL SELECT 'range:size', 'concept', id::VARCHAR, size::VARCHAR FROM c WHERE size < 2 OR size > 48""")
def _(spark, sf):
    size = F.col("p_size") % 10
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(size == 0, "wrong").when(size == 1, None).otherwise("central").alias("priority"), F.col("p_size").alias("size"))
    return contracts.all_of(contracts.required(rows, "concept", "id", "title"), contracts.one_of(rows, "concept", "id", "priority", contracts.ENUMS["priority"]), contracts.within(rows, "concept", "id", "size", 2, 48))


@UPKEEP.add("fk_violations", "rule string, entity string, id string, detail string", "SELECT 'reference:ref_id' AS rule, 'link' AS entity, (l_partkey + 7)::VARCHAR AS id, (l_suppkey + 3)::VARCHAR AS detail FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_suppkey + 3 NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'reference:concept_id', 'link', (l_partkey + 7)::VARCHAR, (l_partkey + 7)::VARCHAR FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_partkey + 7 NOT IN (SELECT p_partkey FROM part)")
def _(spark, sf):
    links = table(spark, sf, "lineitem").select((F.col("l_partkey") + 7).alias("concept_id"), (F.col("l_suppkey") + 3).alias("ref_id")).distinct()
    return contracts.all_of(contracts.refers(links, "link", "concept_id", "ref_id", bibliography(spark, sf), "ref_id"), contracts.refers(links, "link", "concept_id", "concept_id", concepts(spark, sf), "concept_id"))


@UPKEEP.add("duplicate_ids", "rule string, entity string, id string, detail string", "SELECT 'unique' AS rule, 'line' AS entity, l_partkey::VARCHAR AS id, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def _(spark, sf):
    return contracts.unique(table(spark, sf, "lineitem"), "line", "l_partkey")


@UPKEEP.add("sequence_errors", "rule string, entity string, id string, detail string", "WITH p AS (SELECT l_orderkey AS k, l_linenumber + CASE WHEN l_quantity <= 3 THEN 1 ELSE 0 END AS n FROM lineitem) SELECT 'sequence' AS rule, 'unit' AS entity, k::VARCHAR AS id, max(n) || '/' || count(*) AS detail FROM p GROUP BY k HAVING min(n) <> 1 OR max(n) <> count(*) OR count(DISTINCT n) <> count(*)")
def _(spark, sf):
    place = F.col("l_linenumber") + F.when(F.col("l_quantity") <= 3, 1).otherwise(0)
    return contracts.sequence_errors(table(spark, sf, "lineitem").withColumn("place", place), "unit", "l_orderkey", "place")


@UPKEEP.add("cycle_members", "node bigint", "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation WHERE n_nationkey <> 11), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT DISTINCT src AS node FROM r WHERE src = dst")
def _(spark, sf):
    edges = table(spark, sf, "nation").filter("n_nationkey <> 11").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return contracts.cycle_members(edges)


@UPKEEP.add("batch_errors", "rule string, entity string, id string, detail string", """
WITH s AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT l_orderkey + CASE WHEN l_partkey % 3 = 0 THEN 10000000 ELSE 0 END AS k, l_linenumber AS level, l_discount * 12 AS c FROM lineitem)
SELECT 'unique' AS rule, 'assignment' AS entity, k::VARCHAR AS id, count(*)::VARCHAR AS detail FROM a GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'reference:segment_id', 'assignment', k::VARCHAR, k::VARCHAR FROM a WHERE k NOT IN (SELECT k FROM s)
UNION ALL SELECT 'unassigned', 'segment', k::VARCHAR, '' FROM s WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT 'range:level', 'assignment', k::VARCHAR, level::VARCHAR FROM a WHERE level > 6 UNION ALL SELECT 'range:confidence', 'assignment', k::VARCHAR, 'high' FROM a WHERE c > 1""")
def _(spark, sf):
    segments = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"))
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_partkey") % 3 == 0, 10_000_000).otherwise(0)).alias("segment_id"), F.col("l_linenumber").alias("level"), (F.col("l_discount") * 12).alias("confidence"))
    return contracts.batch_errors(segments, rows).withColumn("detail", F.when(F.col("rule") == "range:confidence", "high").otherwise(F.col("detail")))


# Changes.

@UPKEEP.add("best_role", "course_id bigint, email string, role string", """
WITH p AS (SELECT o_orderkey % 100 AS course_id, 'u' || o_custkey % 40 AS email, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS r FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT n_nationkey, 'u' || n_regionkey, 3 FROM nation)
SELECT course_id, email, ['viewer', 'editor', 'owner'][max(r)] AS role FROM p WHERE r > 0 AND course_id IN (SELECT n_nationkey FROM nation) GROUP BY course_id, email""")
def _(spark, sf):
    courses = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("course_id"), F.concat(F.lit("u"), F.col("n_regionkey").cast("string")).alias("owner"))
    role = F.when(F.col("o_orderstatus") == "F", "viewer").when(F.col("o_orderstatus") == "O", "editor").otherwise("none")
    grants = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("course_id"), F.concat(F.lit("u"), (F.col("o_custkey") % 40).cast("string")).alias("email"), role.alias("role"), (F.col("o_orderkey") % 3 > 0).alias("active"))
    return maintenance.best_role(courses, grants)


@UPKEEP.add("pending_flag", "doc_id bigint, prepared boolean", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS prepared FROM documents")
def _(spark, sf):
    return maintenance.flag_present(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "prepared")


@UPKEEP.add("unique_slug", "p_partkey bigint, slug string", f"""
WITH RECURSIVE t AS (SELECT p_partkey, split_part(p_name, ' ', 1) || CASE p_partkey % 7 WHEN 0 THEN ' 2' WHEN 1 THEN ' 3' WHEN 2 THEN ' 2 2' ELSE '' END AS title FROM part),
b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, coalesce(nullif(left(regexp_replace(regexp_replace({fold_sql('title')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 64), ''), 'curso') AS s FROM t),
w AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS p_partkey, ''::VARCHAR AS slug, []::VARCHAR[] AS used
  UNION ALL
  SELECT i, p_partkey, name, list_append(used, name) FROM (
    SELECT b.i, b.p_partkey, w.used, CASE WHEN NOT list_contains(w.used, b.s) THEN b.s ELSE b.s || '-' || list_filter(range(2, 4 + len(list_filter(w.used, lambda u: starts_with(u, b.s)))), lambda n: NOT list_contains(w.used, b.s || '-' || n))[1] END AS name
    FROM w JOIN b ON b.i = w.i + 1))
SELECT p_partkey, slug FROM w WHERE i > 0""")
def _(spark, sf):
    tail = F.when(F.col("p_partkey") % 7 == 0, " 2").when(F.col("p_partkey") % 7 == 1, " 3").when(F.col("p_partkey") % 7 == 2, " 2 2").otherwise("")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.split("p_name", " ")[0], tail).alias("title"))
    return maintenance.unique_slugs(rows, "title", "p_partkey")


@UPKEEP.add("upsert_documents", "doc_id bigint, lang string, source string", "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang, coalesce(n.source, o.source) AS source FROM (SELECT * FROM documents WHERE doc_id % 3 > 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'xx' END AS lang, 'new' AS source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) n USING (doc_id)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    new = docs.filter("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 != 0, "xx").alias("lang"), F.lit("new").alias("source"))
    return maintenance.upsert(docs.filter("doc_id % 3 > 0"), new, "doc_id")


@UPKEEP.add("replace_by_document", "doc_id bigint, source string, lang string", "WITH n AS (SELECT doc_id, source, 'new' AS lang FROM documents WHERE doc_id % 10 = 3) SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return maintenance.replace_where(docs, docs.filter("doc_id % 10 = 3").withColumn("lang", F.lit("new")), "doc_id")


@UPKEEP.add("bibliography_merge", "key string, n bigint", "WITH o AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS key FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS key FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 3 = 0) SELECT key, count(*) AS n FROM (SELECT lower(p_name || ' ' || p_brand) AS key FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT key FROM n WHERE key NOT IN (SELECT key FROM o)) GROUP BY key")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    key = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return maintenance.add_missing(part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1 OR p_partkey % 3 = 0"), key).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@UPKEEP.add("priority_cascade", "section_id bigint, priority string", "SELECT l_orderkey * 10 + l_linenumber AS section_id, CASE WHEN l_returnflag = 'A' THEN 'normal' ELSE coalesce(u.priority, 'normal') END AS priority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'central' ELSE 'context' END AS priority FROM customer) u ON u.c_custkey = o_custkey")
def _(spark, sf):
    documents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("unit_id"))
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.when(F.col("c_nationkey") % 2 == 0, "central").otherwise("context").alias("priority"))
    sections = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section_id"), F.lit("normal").alias("priority"), F.when(F.col("l_returnflag") == "A", "teacher").alias("priority_source"))
    return maintenance.cascade_priority(documents, sections, units)


@UPKEEP.add("cascading_delete", "c_custkey bigint, orders bigint", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 5 > 0 GROUP BY c_custkey")
def _(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders").withColumn("c_custkey", F.col("o_custkey"))
    parents, children = maintenance.delete_cascade(customers, orders, customers.filter("c_custkey % 5 = 0"), "c_custkey")
    return parents.join(children, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@UPKEEP.add("reference_removal", "l_orderkey bigint, left_ids string, review string", "SELECT l_orderkey, coalesce(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) FILTER (l_partkey % 9 > 0), '') AS left_ids, CASE WHEN bool_or(l_partkey % 9 = 0) THEN 'pending' ELSE 'approved' END AS review FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids")).withColumn("review_status", F.lit("approved"))
    out = maintenance.without_reference(rows, "ids", F.filter("ids", lambda x: x % 9 == 0))
    return out.select("l_orderkey", F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",").alias("left_ids"), F.col("review_status").alias("review"))


OVERLAP_SQL = "CASE WHEN a > 0 AND oa > 0 AND least(b, ob) >= greatest(a, oa) THEN {base} + floor({share}::DOUBLE * (least(b, ob) - greatest(a, oa) + 1) / least(b - a + 1, ob - oa + 1) + 0.5) ELSE 0 END"


@UPKEEP.add("best_prior_match", "document_id bigint, prior_id bigint, score bigint", f"""
WITH d AS (SELECT doc_id AS k, array_to_string(string_split(text, ' ')[1:2], ' ') AS title, source FROM documents),
n AS (SELECT CASE WHEN k % 4 = 0 THEN k ELSE k + 10000000 END AS id, {key_sql("title")} AS t, lower(trim(CASE WHEN k % 10 = 1 THEN 'ONLY' || k || ' ' ELSE source END)) AS s, CASE WHEN k % 3 = 0 THEN 0 ELSE k * 7 % 400 + 1 END AS a, CASE WHEN k % 3 = 0 THEN 0 ELSE k * 7 % 400 + 1 + k % 9 END AS b FROM d),
o AS (SELECT k AS pid, {key_sql("title")} AS ot, lower(trim(CASE WHEN k % 10 = 1 THEN 'only' || k ELSE source END)) AS os, CASE WHEN k % 5 = 0 THEN 0 ELSE k * 11 % 400 + 1 END AS oa, CASE WHEN k % 5 = 0 THEN 0 ELSE k * 11 % 400 + 1 + k % 6 END AS ob FROM d),
p AS (SELECT id, pid, CASE WHEN id = pid THEN 1000 ELSE CASE WHEN s <> '' AND s = os THEN 12 ELSE 0 END + CASE WHEN t <> '' AND t = ot THEN 45 ELSE 0 END + {OVERLAP_SQL.format(base=45, share=20)} END AS score FROM n, o),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pid) AS r FROM p) WHERE r = 1),
single AS (SELECT os, min(pid) AS pid FROM o WHERE os <> '' GROUP BY os HAVING count(*) = 1)
SELECT id AS document_id, best.pid AS prior_id, score FROM best WHERE score >= 20
UNION ALL SELECT n.id, single.pid, 12 FROM n JOIN single ON os = s JOIN best ON best.id = n.id WHERE best.score < 20""")
def _(spark, sf):
    k = F.col("k")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("title"), "source")
    new = docs.select(F.when(k % 4 == 0, k).otherwise(k + 10_000_000).alias("document_id"), "title", F.when(k % 10 == 1, F.concat(F.lit("ONLY"), k.cast("string"), F.lit(" "))).otherwise(F.col("source")).alias("source_name"), F.when(k % 3 > 0, k * 7 % 400 + 1).alias("page_start"), F.when(k % 3 > 0, k * 7 % 400 + 1 + k % 9).alias("page_end"))
    old = docs.select(k.alias("document_id"), "title", F.when(k % 10 == 1, F.concat(F.lit("only"), k.cast("string"))).otherwise(F.col("source")).alias("source_name"), F.when(k % 5 > 0, k * 11 % 400 + 1).alias("page_start"), F.when(k % 5 > 0, k * 11 % 400 + 1 + k % 6).alias("page_end"))
    return maintenance.prior_document(new, old)


def _sections(spark, sf):
    """Lines of orders as sections of a document, as they are now and as they were. Lines move once, to their order."""
    lines = table(spark, sf, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")))
    key, n = F.col("l_orderkey") * 100 + F.col("l_linenumber"), F.col("l_linenumber")
    size = F.col("l_quantity").cast("long")
    name = F.element_at(F.array(F.lit("Alfa"), F.lit("Beta"), F.lit("Gama")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    place = F.element_at(F.array(F.lit("norte"), F.lit("sur")), (F.col("l_partkey") % 2 + 1).cast("int"))
    new = lines.select(
        F.col("l_orderkey").alias("document"), key.alias("section_id"), F.concat(name, F.when(n % 2 == 0, F.concat(F.lit(" · Parte "), n.cast("string"))).otherwise("")).alias("title"), F.array(place).alias("path"), size.alias("page_start"), (size + n).alias("page_end"),
        F.lit("contenido").alias("role"), F.lit("rules").alias("role_source"), F.lit(0.62).alias("confidence"), F.lit("included").alias("scope"), F.lit("role-default").alias("scope_source"), F.lit("normal").alias("priority"), F.lit("document").alias("priority_source"), F.lit("normal").alias("document_priority"),
        F.lit("").alias("topic"), F.lit(None).cast("string").alias("teacher_limit"), F.array(F.lit("own")).alias("concepts"), F.lit(False).alias("needs_review"), F.when(n == 1, "mine").alias("review_notes"),
    )
    first = size + n % 3
    chosen = F.col("l_linestatus") == "F"
    old = lines.select(
        F.col("l_orderkey").alias("document"), (key + F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(50)).alias("section_id"), name.alias("title"), F.when(F.col("l_returnflag") == "A", F.array(place, F.lit("x"))).otherwise(F.array(place)).alias("path"), first.alias("page_start"), (first + 2).alias("page_end"), chosen.alias("by_teacher"),
        F.when(n % 2 == 0, "anexo").otherwise("contenido").alias("role"), F.when(chosen, "teacher").otherwise("rules").alias("role_source"), F.when(n > 2, 0.9).alias("confidence"),
        F.when(F.col("l_tax") > 0.04, "excluded").otherwise("included").alias("scope"), F.when(chosen, "teacher").otherwise("").alias("scope_source"), F.when(n % 3 == 0, "central").otherwise("normal").alias("priority"), F.lit(None).cast("string").alias("priority_source"),
        name.alias("topic"), F.lit(" ").alias("teacher_limit"), F.when(n % 4 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("concepts"), (n == 5).alias("needs_review"), F.lit("old").alias("review_notes"),
    )
    return new, old


SECTIONS_SQL = f"""
lines AS (SELECT *, ['Alfa', 'Beta', 'Gama'][l_suppkey % 3 + 1] AS name, ['norte', 'sur'][l_partkey % 2 + 1] AS place FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)),
n AS (SELECT l_orderkey AS doc, l_orderkey * 100 + l_linenumber AS id, {key_sql("name")} AS t, {key_sql("place")} AS p, l_quantity::BIGINT AS a, l_quantity::BIGINT + l_linenumber AS b, l_linenumber AS ln FROM lines),
o AS (SELECT l_orderkey AS doc, l_orderkey * 100 + l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE 50 END AS pid, {key_sql("name")} AS ot, {key_sql("place")} || CASE WHEN l_returnflag = 'A' THEN '>x' ELSE '' END AS op, l_quantity::BIGINT + l_linenumber % 3 AS oa, l_quantity::BIGINT + l_linenumber % 3 + 2 AS ob, l_linestatus = 'F' AS chosen, l_linenumber AS oln, l_tax, name FROM lines),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pid) AS r FROM (
  SELECT n.id, n.ln, o.*, CASE WHEN id = pid THEN 120 ELSE 0 END + CASE WHEN t = ot AND t <> '' THEN 30 ELSE 0 END + CASE WHEN p = op AND p <> '' THEN 22 ELSE 0 END + {OVERLAP_SQL.format(base=8, share=10)} + CASE WHEN chosen THEN 6 ELSE 0 END AS score FROM n JOIN o ON n.doc = o.doc)) WHERE r = 1 AND score >= 20)"""


@UPKEEP.add("prior_sections", "section_id bigint, prior_id bigint, score bigint", f"WITH {SECTIONS_SQL} SELECT id AS section_id, pid AS prior_id, score FROM m")
def _(spark, sf):
    return maintenance.prior_section(*_sections(spark, sf))


@UPKEEP.add("teacher_choices", "section_id bigint, role string, role_source string, confidence double, scope string, scope_source string, priority string, topic string, concepts string, needs_review boolean, review_notes string", f"""
WITH {SECTIONS_SQL}, c AS (SELECT n.id AS section_id, n.ln, m.pid, coalesce(m.chosen, false) AS chosen, m.oln, m.l_tax > 0.04 AS out, m.name FROM n LEFT JOIN m ON m.id = n.id),
d AS (SELECT *, CASE WHEN oln % 2 = 0 THEN 'anexo' ELSE 'contenido' END AS orole, coalesce(chosen OR (out AND 'excluded' <> CASE WHEN oln % 2 = 0 THEN 'reference' ELSE 'included' END), false) AS rescoped FROM c)
SELECT section_id, CASE WHEN chosen THEN orole ELSE 'contenido' END AS role, CASE WHEN chosen THEN 'teacher' ELSE 'rules' END AS role_source, CASE WHEN chosen AND oln > 2 THEN 0.9 ELSE 0.62 END AS confidence,
       CASE WHEN rescoped AND out THEN 'excluded' ELSE 'included' END AS scope, CASE WHEN rescoped THEN 'teacher' ELSE 'role-default' END AS scope_source, CASE WHEN oln % 3 = 0 THEN 'central' ELSE 'normal' END AS priority,
       coalesce(name, '') AS topic, CASE WHEN oln % 4 = 0 THEN 'old' ELSE 'own' END AS concepts, coalesce(oln = 5, false) AS needs_review, CASE WHEN ln = 1 THEN 'mine' WHEN pid IS NOT NULL THEN 'old' END AS review_notes FROM d""")
def _(spark, sf):
    new, old = _sections(spark, sf)
    out = maintenance.keep_teacher_choices(new.drop("title", "path", "page_start", "page_end"), old, maintenance.prior_section(new, old, by_document=True), "document")
    return out.withColumn("concepts", F.array_join("concepts", ","))


@UPKEEP.add("path_descendants", "k bigint, class_id bigint, ancestors string, n_ancestors bigint, n_descendants bigint", """
WITH p AS (SELECT c_custkey AS k, [c_nationkey::VARCHAR, c_mktsegment, (c_custkey % 3)::VARCHAR][1 : 1 + c_custkey % 3] AS path FROM customer), c AS (SELECT path, min(k) AS class_id, count(*) AS n FROM p GROUP BY path),
l AS (SELECT d.class_id AS down, a.class_id AS up, d.n AS below, a.n AS above, len(a.path) AS depth FROM c a JOIN c d ON len(d.path) > len(a.path) AND d.path[1 : len(a.path)] = a.path),
u AS (SELECT down AS class_id, string_agg(up::VARCHAR, ',' ORDER BY depth) AS ancestors, sum(above) AS n FROM l GROUP BY down), b AS (SELECT up AS class_id, sum(below) AS n FROM l GROUP BY up)
SELECT k, class_id, coalesce(ancestors, '') AS ancestors, coalesce(u.n, 0) AS n_ancestors, coalesce(b.n, 0) AS n_descendants FROM p JOIN c USING (path) LEFT JOIN u USING (class_id) LEFT JOIN b USING (class_id)""")
def _(spark, sf):
    rows = table(spark, sf, "customer")
    path = F.slice(F.array(F.col("c_nationkey").cast("string"), "c_mktsegment", (F.col("c_custkey") % 3).cast("string")), F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int"))
    found = maintenance.descendants(rows.select(F.col("c_custkey").alias("k"), path.alias("path")), "k", "path")
    return found.withColumn("ancestors", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ","))


@UPKEEP.add("versioned_save", "o_orderkey bigint, outcome string", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'created' WHEN o_orderkey % 5 > 0 THEN 'saved' ELSE 'conflict' END AS outcome FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    stored = orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", (F.col("o_orderkey") % 5).alias("version"))
    return maintenance.versioned_save(stored, orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5).otherwise(9).alias("expected")), "o_orderkey", "version", "expected")


@UPKEEP.add("upload_state", "o_orderkey bigint, received bigint, complete boolean", """
WITH m AS (SELECT o_orderkey, (o_orderkey % 5 + 1) * 1500000 AS total FROM orders), p AS (SELECT o_orderkey, total, unnest(range(0, ceil(total / 2097152.0)::BIGINT)) AS no FROM m), s AS (SELECT *, least(2097152, total - no * 2097152) - CASE WHEN o_orderkey % 11 = 0 AND no = 0 THEN 1 ELSE 0 END AS size FROM p WHERE NOT (o_orderkey % 6 = 0 AND no = 1))
SELECT o_orderkey, coalesce(sum(size), 0) AS received, coalesce(sum(size) = any_value(m.total) AND count(*) = any_value(ceil(m.total / 2097152.0)), false) AS complete FROM m LEFT JOIN s USING (o_orderkey) GROUP BY o_orderkey""")
def _(spark, sf):
    manifest = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 5 + 1) * 1_500_000).alias("total"))
    parts = manifest.select("o_orderkey", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / 2097152.0) - 1)).alias("part_no")).filter("NOT (o_orderkey % 6 = 0 AND part_no = 1)")
    size = F.least(F.lit(2097152), F.col("total") - F.col("part_no") * 2097152) - F.when((F.col("o_orderkey") % 11 == 0) & (F.col("part_no") == 0), 1).otherwise(0)
    return maintenance.upload_state(manifest, parts.select("o_orderkey", "part_no", size.alias("size")), "o_orderkey")
