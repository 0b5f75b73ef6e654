"""Queries of the text functions and of a text's quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions.fixed import FUNCTION_WORDS, STOP_WORDS, USAGE_LEVELS
from lectern.operators import analytics, assembly, maintenance, retrieval, structure
from lectern.queries import Catalogue
from lectern.sources.tables import table

TEXTS = Catalogue()


def fold_sql(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({fold_sql(x)}, '[^a-z0-9]+', ' ', 'g'))"


def squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace({fold_sql(x)}, '\s+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({fold_sql(x)}, '[0-9]+', '#', 'g'), '[^a-z0-9#]+', ' ', 'g'))"


def stem_sql(x: str) -> str:
    return f"CASE WHEN length({x}) > 6 AND suffix({x}, 'es') THEN substr({x}, 1, length({x}) - 2) WHEN length({x}) > 5 AND suffix({x}, 's') THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def terms_sql(x: str) -> str:
    return f"list_distinct([{stem_sql('w')} for w in string_split({norm_sql(x)}, ' ') if length(w) >= 3])"


def query_terms_sql(x: str) -> str:
    return f"list_distinct([{stem_sql('w')} for w in string_split({norm_sql(x)}, ' ') if length(w) >= 3 AND NOT list_contains({STOPS_SQL}, w)])"


@TEXTS.add("normalize_text", "doc_id bigint, normal string", f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.normalize("text").alias("normal"))


@TEXTS.add("query_tokens", "item_id bigint, terms string, n bigint", f"SELECT item_id, array_to_string(list_sort({query_terms_sql('text')}), ' ') AS terms, len({query_terms_sql('text')}) AS n FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", t.query_terms("text").alias("q")).select("item_id", F.array_join(F.array_sort("q"), " ").alias("terms"), F.size("q").alias("n"))


@TEXTS.add("furniture_key", "doc_id bigint, key string", f"SELECT doc_id, {key_sql('text')} AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.furniture_key("text").alias("key"))


@TEXTS.add("slugify", "item_id bigint, slug string", f"SELECT item_id, coalesce(nullif(left(regexp_replace(regexp_replace({fold_sql('text')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 56), ''), 'seccion') AS slug FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", t.slug("text", 56, "seccion").alias("slug"))


@TEXTS.add("numbering_parse", "o_orderkey bigint, number string, level bigint", r"""
SELECT o_orderkey, nullif(regexp_extract(h, '^([0-9]+(?:\.[0-9]+){0,8})[.)]?\s+\S', 1), '') AS number, CASE WHEN regexp_matches(h, '^([0-9]+(?:\.[0-9]+){0,8})[.)]?\s+\S') THEN least(len(string_split(regexp_extract(h, '^([0-9]+(?:\.[0-9]+){0,8})[.)]?\s+\S', 1), '.')), 8) END AS level
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE (o_orderkey % 7) || '.' || (o_orderkey % 3) || CASE WHEN o_orderkey % 2 = 0 THEN '.4) ' ELSE ' ' END || o_orderpriority END AS h FROM orders)""")
def _(spark, sf):
    heading = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_orderkey") % 3).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".4) ").otherwise(" "), "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", t.numbering(heading).alias("n")).select("o_orderkey", "n.number", "n.level")


@TEXTS.add("fnv1a_hash", "item_id bigint, hash string", "SELECT item_id, lpad(lower(to_hex(list_reduce([unicode(c)::BIGINT for c in string_split(text, '')], lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261))), 8, '0') AS hash FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", t.fnv1a("text").alias("hash"))


@TEXTS.add("sha256_key", "doc_id bigint, key string", "SELECT doc_id, sha256(doc_id || ':' || coalesce(text, '')) AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("key"))


@TEXTS.add("title_similarity", "doc_id bigint, similarity double", rf"""
WITH t AS (SELECT doc_id, {key_sql("array_to_string(string_split(text, ' ')[1:5], ' ')")} AS k FROM documents),
w AS (SELECT doc_id, k, list_distinct([x for x in string_split(k, ' ') if length(x) >= 3]) AS ws FROM t),
p AS (SELECT a.doc_id, a.k AS ka, b.k AS kb, len(list_intersect(a.ws, b.ws))::DOUBLE AS c, len(a.ws) AS na, len(b.ws) AS nb FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN ka = '' OR kb = '' THEN 0 WHEN ka = kb THEN 1 WHEN (contains(ka, kb) OR contains(kb, ka)) AND least(na, nb) >= 2 THEN 0.93 WHEN na = 0 OR nb = 0 THEN 0
       ELSE greatest(c / na * 0.62 + c / nb * 0.18, c / least(na, nb) * 0.84) END AS similarity FROM p""")
def _(spark, sf):
    titles = table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"))
    later = titles.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    return titles.join(later, "doc_id").select("doc_id", t.title_similarity("title", "other").alias("similarity"))


@TEXTS.add("safe_names", "page_id bigint, name string, digits string", f"SELECT page_id, left(regexp_replace({fold_sql('url')}, '[^a-z0-9._-]+', '_', 'g'), 120) AS name, regexp_replace(url, '[^0-9]', '', 'g') AS digits FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.safe_name("url").alias("name"), t.digits_only("url").alias("digits"))


@TEXTS.add("duration_parse", "event_id bigint, ms bigint", r"""
SELECT event_id, CASE WHEN len(v) > 0 THEN ceil(list_sum([x::DOUBLE * CASE u WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END for x, u in list_zip(v, us)])) END AS ms
FROM (SELECT event_id, regexp_extract_all(d, '([0-9]+(?:\.[0-9]+)?)(ms|d|h|m|s)', 1) AS v, regexp_extract_all(d, '([0-9]+(?:\.[0-9]+)?)(ms|d|h|m|s)', 2) AS us
      FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50) || 'm' || (event_id % 7) || '.5s' WHEN 1 THEN (event_id % 9) || 'H2m' WHEN 2 THEN 'soon' ELSE event_id || 'ms' END AS raw, lower(raw) AS d FROM events))""".replace("[x::DOUBLE * CASE u WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END for x, u in list_zip(v, us)]", "[v[i]::DOUBLE * CASE us[i] WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END for i in range(1, len(v) + 1)]"))
def _(spark, sf):
    e, s = F.col("event_id"), lambda c: c.cast("string")
    raw = F.when(e % 4 == 0, F.concat(s(e % 50), F.lit("m"), s(e % 7), F.lit(".5s"))).when(e % 4 == 1, F.concat(s(e % 9), F.lit("H2m"))).when(e % 4 == 2, "soon").otherwise(F.concat(s(e), F.lit("ms")))
    return table(spark, sf, "events").select("event_id", t.duration_ms(raw).alias("ms"))


@TEXTS.add("split_list", "page_id bigint, parts string, n bigint", "SELECT page_id, array_to_string(p, '+') AS parts, len(p) AS n FROM (SELECT page_id, [trim(x) for x in string_split(url, '/') if trim(x) <> ''] AS p FROM pages)")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.split_list("url", "/").alias("p")).select("page_id", F.array_join("p", "+").alias("parts"), F.size("p").alias("n"))


@TEXTS.add("clean_text", "doc_id bigint, clean string, short string", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(173) || chr(13), ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS clean,
       CASE WHEN length(f) > 120 THEN rtrim(left(f, 119), ' ') || '…' ELSE f END AS short
FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS f FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.clean_text("text").alias("clean"), t.shorten("text", 120).alias("short"))


@TEXTS.add("token_estimate", "conv_id bigint, turn bigint, tokens bigint", "SELECT conv_id, turn, ceil(length(text) / 3.0::DOUBLE) + 200 + 800 AS tokens FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.token_estimate("text", 800).alias("tokens"))


@TEXTS.add("first_sentence", "doc_id bigint, sentence string", r"""
SELECT doc_id, left(coalesce(nullif(regexp_extract(f, '^(.*?[.!?])( |$)', 1), ''), f), 240) AS sentence
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS f FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.first_sentence("text").alias("sentence"))


@TEXTS.add("char_error_rate", "item_id bigint, distance bigint, rate double", "SELECT a.item_id, levenshtein(a.x, b.x) AS distance, levenshtein(a.x, b.x)::DOUBLE / greatest(1, length(a.x)) AS rate FROM (SELECT item_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') AS x FROM benchmark) a JOIN (SELECT item_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') AS x FROM benchmark) b ON b.item_id = a.item_id + 1")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.regexp_replace(t.fold("text"), "[^a-z0-9]", "").alias("x"))
    later = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return rows.join(later, "item_id").select("item_id", F.levenshtein("x", "y").alias("distance"), (F.levenshtein("x", "y") / F.greatest(F.lit(1), F.length("x"))).alias("rate"))


@TEXTS.add("word_error_rate", "item_id bigint, distance bigint, rate double", r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS x FROM benchmark),
m AS (SELECT a.item_id, a.x, b.x AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1),
d AS (SELECT item_id, len(x) AS n, list_reduce([[i] FOR i IN range(1, len(x) + 1)], lambda done, e: list_reduce([[j] FOR j IN range(1, len(y) + 1)], lambda acc, f: list_append(acc, least(acc[-1] + 1, done[f[1] + 1] + 1, done[f[1]] + CASE WHEN x[e[1]] = y[f[1]] THEN 0 ELSE 1 END)), [e[1]]), range(0, len(y) + 1))[-1] AS distance FROM m)
SELECT item_id, distance, distance::DOUBLE / greatest(1, n) AS rate FROM d""")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", t.error_words("text").alias("x"))
    later = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    met = rows.join(later, "item_id").withColumn("distance", t.token_distance(F.col("x"), F.col("y")))
    return met.select("item_id", "distance", (F.col("distance") / F.greatest(F.lit(1), F.size("x"))).alias("rate"))


WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + "]"
QUALITY_SQL = rf"""
q0 AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
q1 AS (
  SELECT *, len(regexp_extract_all(body, '\p{{L}}'))::DOUBLE AS letters, length(regexp_replace(body, '[ \t\n\x0B\f\r]', '', 'g')) AS visible,
         [length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) for w in regexp_extract_all(body, '[\p{{L}}\p{{N}}]+')] AS sizes,
         array_to_string([array_to_string([CASE WHEN length(w) <= 4 AND NOT list_contains({WORDS_SQL}, w) THEN 's' ELSE 'l' END for w in regexp_extract_all(line, '[a-z]+')], '') for line in string_split({fold_sql('body')}, chr(10))], '|') AS drawn
  FROM q0),
q2 AS (
  SELECT *, greatest(1, len(sizes))::DOUBLE AS n, len(list_filter(sizes, lambda k: k >= 2)) AS words, len(list_filter(sizes, lambda k: k = 1)) AS single,
         regexp_extract_all(drawn, 's{{2,}}') AS runs, length(replace(drawn, '|', '')) AS n_folded, length(regexp_replace(drawn, '[|l]', '', 'g')) / greatest(1, length(replace(drawn, '|', '')))::DOUBLE AS fragments
  FROM q1),
q3 AS (SELECT *, length(body) >= 200 AND letters >= 150 AND n_folded >= 35 AND fragments >= 0.34::DOUBLE AND len(runs) >= 4 AND length(array_to_string(runs, '')) >= 10 AS broken FROM q2),
quality AS (
  SELECT *, letters / greatest(1, visible) AS alpha, single / n AS single_ratio, greatest(0, least(100, 25 * letters / greatest(1, visible) + 25 * words / n + 20 * least(1.0::DOUBLE, letters / 180) + 0.3::DOUBLE * 55 - 18 * single / n - CASE WHEN broken THEN 18 ELSE 0 END)) AS score
  FROM q3)"""


@TEXTS.add("text_quality", "doc_id bigint, letters bigint, words bigint, fragment_runs bigint, broken_spacing boolean, score double", f"WITH {QUALITY_SQL} SELECT doc_id, letters, words, len(runs) AS fragment_runs, broken AS broken_spacing, score FROM quality")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", structure.text_quality("text").alias("q")).select("doc_id", "q.*")


@TEXTS.add("poor_texts", "doc_id bigint, score double", f"WITH {QUALITY_SQL} SELECT doc_id, score FROM quality WHERE length(body) < 90 OR letters < 45 OR score < 54 OR single_ratio > 0.28::DOUBLE OR broken")
def _(spark, sf):
    # As a row of its own, so that the filter doesn't measure a text once for each of its conditions.
    rows = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(structure.text_quality("text"))).alias("q"))
    return rows.filter(structure.is_poor("q", "text")).select("doc_id", "q.score")


@TEXTS.add("rejoined_hyphens", "doc_id bigint, whole string", r"""
SELECT doc_id, regexp_replace(x, '([A-Za-zÀ-ÿ])-[ \t\n\x0B\f\r]+([a-zà-ÿ])', '\1\2', 'g') AS whole FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '([a-z]{3}) ', '\1-' || chr(10), 'g') AS x FROM documents)""")
def _(spark, sf):
    cut = F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z]{3}) ", "$1-\n")
    return table(spark, sf, "documents").select("doc_id", t.rejoin_hyphens(cut).alias("whole"))


@TEXTS.add("mode_labels", "event_id bigint, label string", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Consulta' WHEN 1 THEN 'Análisis' WHEN 2 THEN 'Socrático' WHEN 3 THEN 'Paso a paso' ELSE 'Consulta' END AS label FROM events")
def _(spark, sf):
    modes = F.array(*(F.lit(m) for m in ("consulta", "analisis", "socratico", "ocultadores", "otro", None)))
    return table(spark, sf, "events").select("event_id", analytics.mode_label(F.get(modes, (F.col("event_id") % 6).cast("int"))).alias("label"))


@TEXTS.add("usage_order", "doc_id bigint, place bigint", "SELECT doc_id, [0, 1, 2, 3, 4, 5][doc_id % 6 + 1] AS place FROM documents")
def _(spark, sf):
    levels = F.array(*(F.lit(x) for x in (*USAGE_LEVELS, "unknown")))
    return table(spark, sf, "documents").select("doc_id", analytics.usage_rank(F.get(levels, (F.col("doc_id") % 6).cast("int"))).alias("place"))


@TEXTS.add("mode_settings", "p_partkey bigint, temperature double, max_tokens bigint", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 ELSE 0.5 END AS temperature, CASE p_partkey % 3 WHEN 0 THEN 800 ELSE 300 END AS max_tokens FROM part")
def _(spark, sf):
    setting = lambda temperature, tokens: F.struct(F.lit(temperature).cast("double").alias("temperature"), F.lit(tokens).cast("int").alias("max_tokens"))
    own = F.create_map(F.lit("a"), setting(0.2, 5000), F.lit("b"), setting(0.7, None))
    mode = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("p_partkey") % 3).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", assembly.with_overrides({"temperature": 0.5, "max_tokens": 300}, own, mode).alias("s"))
    return rows.select("p_partkey", "s.temperature", "s.max_tokens")


@TEXTS.add("range_overlap", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, shared bigint", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a > 0 AND c > 0 THEN greatest(0, least(b, d) - greatest(a, c) + 1) ELSE 0 END AS shared FROM (SELECT *, l_partkey % 20 AS a, l_partkey % 20 + l_linenumber AS b, l_suppkey % 20 AS c, l_suppkey % 20 + 4 AS d FROM lineitem)")
def _(spark, sf):
    a, c = F.col("l_partkey") % 20, F.col("l_suppkey") % 20
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", maintenance.range_overlap(a, a + F.col("l_linenumber"), c, c + 4).alias("shared"))


@TEXTS.add("assigned_segments", "o_orderkey bigint, l_linenumber bigint, section_title string", "SELECT o_orderkey, l_linenumber, 'S' || l_partkey AS section_title FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(spark, sf):
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"))
    told = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("section_title"), F.col("l_linenumber").alias("level"), F.lit("contenido").alias("role"), F.lit(1.0).alias("confidence"))
    return assembly.with_assignments(chunks, told).select(F.col("segment_id").alias("o_orderkey"), F.col("level").alias("l_linenumber"), "section_title")


@TEXTS.add("hits_of_kinds", "q_id bigint, place bigint, key string", """
WITH h AS (SELECT l_orderkey AS q_id, l_suppkey % 3 AS kind, l_linenumber AS rank, 'k' || l_partkey % 40 AS key FROM lineitem),
f AS (SELECT q_id, key, min({'kind': kind, 'rank': rank}) AS pl FROM h GROUP BY q_id, key)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY pl, key) AS place, key FROM f""")
def _(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q_id"), (F.col("l_suppkey") % 3).alias("kind"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("k"), (F.col("l_partkey") % 40).cast("string")).alias("key"))
    return retrieval.first_of_kinds(hits).select("q_id", "place", "key")
