"""Queries of ranked retrieval, passages, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import CONFUSION, CONFUSION_PARTS, FOLLOW_UP
from lectern.functions.text import needs_context
from lectern.operators import analytics, passages, retrieval
from lectern.operators.knowledge import recent_messages
from lectern.plans import course
from lectern.queries import Catalogue
from lectern.queries.texts import fold_sql, norm_sql, query_terms_sql, squeeze_sql, terms_sql
from lectern.sources.sinks import transcripts
from lectern.sources.tables import CORPUS_SQL, QUESTIONS_SQL, corpus, questions, table

RETRIEVAL = Catalogue()


def score_sql(items: str, asked: str, name: str) -> str:
    """CTEs that end in ``name`` (q_id, pos, score), for items (pos, title, aliases, content, source) and questions (q_id, question)."""
    p = name
    return f"""
{p}_f AS (SELECT pos, {norm_sql("title")} AS heads, {norm_sql("array_to_string(aliases, ' ')")} AS keys, {norm_sql("content")} AS body, aliases, {terms_sql("title")} AS tt, {terms_sql("array_to_string(aliases, ' ')")} AS kt, {terms_sql("content")} AS ct, {terms_sql("source")} AS st FROM {items}),
{p}_t AS (
  SELECT pos, term, max(w) AS w, bool_or(inside) AS inside FROM (
    SELECT pos, unnest(tt) AS term, 5.2::DOUBLE AS w, true AS inside FROM {p}_f UNION ALL SELECT pos, unnest(kt), 4.6::DOUBLE, true FROM {p}_f
    UNION ALL SELECT pos, unnest(ct), 1.15::DOUBLE, true FROM {p}_f UNION ALL SELECT pos, unnest(st), 0.45::DOUBLE, false FROM {p}_f) GROUP BY pos, term),
{p}_q AS (SELECT q_id, {norm_sql("question")} AS phrase, {query_terms_sql("question")} AS terms FROM {asked}),
{p}_qt AS (SELECT q_id, len(terms) AS n, unnest(terms) AS term FROM {p}_q),
{p}_n AS (SELECT greatest(1, count(*))::DOUBLE AS n_items FROM {items}),
{p}_idf AS (SELECT term, ln(1 + (n_items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(DISTINCT pos)::DOUBLE AS df FROM {p}_t WHERE inside AND term IN (SELECT term FROM {p}_qt) GROUP BY term), {p}_n),
{p}_s AS (
  SELECT q_id, pos, sum(w * coalesce(idf, 1)) + count(*)::DOUBLE / max(n) * 5 AS s FROM {p}_qt JOIN {p}_t USING (term) LEFT JOIN {p}_idf USING (term) GROUP BY q_id, pos
  UNION ALL
  SELECT q_id, pos, s FROM (
    SELECT q_id, pos, CASE WHEN contains(heads || ' ' || keys, phrase) THEN 10 ELSE 0 END + CASE WHEN contains(body, phrase) THEN 4 ELSE 0 END
           + 6 * len([a for a in aliases if length({norm_sql("a")}) >= 3 AND contains(phrase, {norm_sql("a")})]) AS s
    FROM {p}_q, {p}_f WHERE len(terms) > 0) WHERE s > 0),
{name} AS (SELECT q_id, pos, sum(s) AS score FROM {p}_s GROUP BY q_id, pos)"""


LIFT_SQL = "CASE priority WHEN 'central' THEN 1.5 WHEN 'context' THEN -1.5 ELSE 0 END"
SHOWN_SQL = "items AS (SELECT * FROM corpus WHERE scope = 'included')"


def top_sql(k: int, source: str = "total") -> str:
    return f"SELECT q_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 6) DESC, pos) AS rank FROM {source}) WHERE rank <= {k}"


TOTAL_SQL = f"total AS (SELECT s.q_id, s.pos, i.id, s.score + {LIFT_SQL} AS score FROM s JOIN items i USING (pos))"
TOP = "q_id bigint, rank bigint, id bigint, score double"


@RETRIEVAL.add("idf_table", "term string, df bigint, idf double", f"""
WITH d AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents), q AS (SELECT DISTINCT unnest({query_terms_sql('text')}) AS term FROM benchmark), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM d JOIN q USING (term) GROUP BY term), n""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    asked = retrieval.question_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question")))
    return retrieval.idf_table(retrieval.item_terms(retrieval.normalized(retrieval.as_items(docs)), asked), docs.count())


@RETRIEVAL.add("retrieve_topk", TOP, f"WITH {CORPUS_SQL}, {QUESTIONS_SQL}, {SHOWN_SQL}, {score_sql('items', 'questions', 's')}, {TOTAL_SQL} {top_sql(4)}")
def retrieve_topk(spark, sf):
    return retrieval.top(retrieval.rank(corpus(spark, sf), questions(spark, sf)), 4)


@RETRIEVAL.add("retrieve_with_reference", TOP, f"WITH {CORPUS_SQL}, {QUESTIONS_SQL}, items AS (SELECT * FROM corpus WHERE scope <> 'excluded'), {score_sql('items', 'questions', 's')}, {TOTAL_SQL} {top_sql(4)}")
def _(spark, sf):
    return retrieval.top(retrieval.rank(corpus(spark, sf), questions(spark, sf), include_reference=True), 4)


def _contexts(spark, sf):
    return course.context_questions(table(spark, sf, "conversations").withColumn("q_id", F.col("conv_id")), "q_id", "turn")


CONTEXT_SQL = r"""
said AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
sized AS (SELECT *, least(length(t), 360) AS size, 1100 - coalesce(sum(least(length(t), 360)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM said WHERE n <= 4),
contexts AS (SELECT conv_id AS q_id, string_agg(right(t, least(size, rest)::INT), ' ' ORDER BY turn) AS question FROM sized WHERE rest > 0 GROUP BY conv_id)"""


@RETRIEVAL.add("context_window", "q_id bigint, question string", f"WITH {CONTEXT_SQL} SELECT * FROM contexts")
def _(spark, sf):
    return _contexts(spark, sf)


@RETRIEVAL.add("retrieve_follow_up", TOP, f"""
WITH {CORPUS_SQL}, {QUESTIONS_SQL}, {SHOWN_SQL}, {CONTEXT_SQL}, asked AS (SELECT * FROM contexts WHERE q_id IN (SELECT q_id FROM questions)),
{score_sql('items', 'questions', 's')}, {score_sql('items', 'asked', 'c')},
total AS (SELECT q_id, pos, i.id, coalesce(s.score, 0) + 0.22::DOUBLE * coalesce(c.score, 0) + {LIFT_SQL} AS score FROM s FULL JOIN c USING (q_id, pos) JOIN items i USING (pos)) {top_sql(4)}""")
def _(spark, sf):
    asked = questions(spark, sf)
    return retrieval.top(retrieval.rank(corpus(spark, sf), asked, contexts=_contexts(spark, sf).join(asked.select("q_id"), "q_id", "left_semi")), 4)


def _entries(spark, sf):
    """Parts as index entries: their words are aliases, their brand and type related terms."""
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("term"), F.split("p_name", " ").alias("aliases"), F.array("p_brand", "p_type").alias("related"))


@RETRIEVAL.add("query_alternatives", "q_id bigint, alt bigint, question string, weight double", f"""
WITH e AS (SELECT p_partkey // 10 AS q_id, p_partkey % 10 AS rank, p_name AS term, string_split(p_name, ' ') AS aliases, [p_brand, p_type] AS related FROM part),
q AS (SELECT item_id AS q_id, text AS question FROM benchmark),
w AS (SELECT q_id, rank, 0 AS nth, term AS question, 0.48 AS weight FROM e UNION ALL SELECT q_id, rank, unnest(range(1, len(aliases[1:4]) + 1)), unnest(aliases[1:4]), 0.56 FROM e UNION ALL SELECT q_id, rank, len(aliases[1:4]) + unnest(range(1, 3)), unnest(related), 0.22 FROM e),
k AS (SELECT w.*, {norm_sql('w.question')} AS key FROM w JOIN q ON q.q_id = w.q_id WHERE len({query_terms_sql('w.question')}) > 0 AND {norm_sql('w.question')} <> {norm_sql('q.question')}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, key ORDER BY rank, nth) AS again FROM k) WHERE again = 1)
SELECT q_id, alt, trim(question) AS question, weight FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank, nth) AS alt FROM f) WHERE alt <= 12""")
def _(spark, sf):
    entries = _entries(spark, sf).withColumns({"q_id": F.floor(F.col("id") / 10), "rank": F.col("id") % 10})
    return retrieval.alternatives(entries, table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question")))


SPLIT_SQL = r"""
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
walk AS (
  SELECT doc_id, t, 0 AS start, {first} AS stop, 0 AS part FROM texts WHERE length(t) > 1100
  UNION ALL
  SELECT doc_id, t, greatest(start + 1, stop - 170) AS start, {later} AS stop, part + 1 FROM walk WHERE stop < length(t)),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS part, p AS passage
  FROM (SELECT doc_id, part, trim(substr(t, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM walk) WHERE p <> ''
  UNION ALL SELECT doc_id, 0, t FROM texts WHERE length(t) <= 1100 AND t <> '')"""


def _last(mark: str, start: str, extra: int) -> str:
    """0-based place of the last ``mark`` that begins at or before start + 1100; -1 without one."""
    head = f"substr(t, 1, {start} + 1100 + {extra})"
    return f"CASE WHEN contains({head}, '{mark}') THEN length({head}) - instr(reverse({head}), reverse('{mark}')) - length('{mark}') + 1 ELSE -1 END".replace("'\n'", "chr(10)")


def _stop(start: str) -> str:
    natural = "greatest(" + ", ".join(_last(m, start, len(m)) for m in ("\n", ". ", "? ", "! ", "; ")) + ")"
    blank = _last(" ", start, 1)
    return f"CASE WHEN {start} + 1100 >= length(t) THEN length(t) WHEN {natural} >= {start} + 748 THEN {natural} + 1 WHEN {blank} > {start} + 748 THEN {blank} ELSE {start} + 1100 END"


PASSAGES_SQL = SPLIT_SQL.format(first=_stop("0"), later=_stop("greatest(start + 1, stop - 170)"))


@RETRIEVAL.add("passages_retrieval", "doc_id bigint, part bigint, passage string", f"WITH RECURSIVE {PASSAGES_SQL} SELECT doc_id, part, passage FROM pieces")
def _(spark, sf):
    return passages.cut(table(spark, sf, "documents"), "doc_id", "text", passages.retrieval_cuts)


@RETRIEVAL.add("retrieve_passages", TOP, f"""
WITH RECURSIVE {CORPUS_SQL}, {QUESTIONS_SQL}, {PASSAGES_SQL},
items AS (SELECT c.id, c.pos * 100000 + p.part AS pos, c.title, c.aliases, p.passage AS content, c.source, c.priority FROM corpus c JOIN pieces p ON p.doc_id = c.id WHERE c.scope = 'included' AND trim(c.content) <> ''),
{score_sql('items', 'questions', 's')}, {TOTAL_SQL},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, id ORDER BY round(score, 6) DESC, pos) AS nth FROM total) WHERE nth = 1) {top_sql(4, 'best')}""")
def _(spark, sf):
    return retrieval.best(course.passages_of(corpus(spark, sf)), questions(spark, sf), 4, per_item=True)


@RETRIEVAL.add("retrieve_all_kinds", "q_id bigint, place bigint, kind bigint, id string, score double")
def _(spark, sf):
    """Index, concepts and passages together: the whole path from a question to its evidence."""
    entries = _entries(spark, sf).withColumns({"title": F.col("term"), "id": F.concat(F.lit("e"), F.col("id").cast("string"))})
    concepts = entries.select(F.concat(F.lit("c"), F.col("pos").cast("string")).alias("id"), "pos", "title", "aliases")
    chunks = corpus(spark, sf).withColumn("id", F.col("id").cast("string"))
    return course.retrieve(questions(spark, sf), chunks, concepts, entries)


@RETRIEVAL.add("live_evidence", "entry_id bigint, scope string, priority string, n_sources bigint, n_evidence bigint, source string", f"""
WITH {CORPUS_SQL}, ev AS (SELECT l_orderkey AS entry_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 1500) AS nth, l_partkey % 1500 AS source_id FROM lineitem),
m AS (SELECT e.entry_id, e.nth, c.* FROM ev e JOIN corpus c ON c.id = e.source_id WHERE c.scope <> 'excluded')
SELECT entry_id, CASE WHEN bool_and(scope = 'reference') THEN 'reference' ELSE 'included' END AS scope,
       CASE min(CASE priority WHEN 'central' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END) WHEN 0 THEN 'central' WHEN 1 THEN 'normal' ELSE 'context' END AS priority, count(DISTINCT id) AS n_sources, count(*) AS n_evidence, arg_min(source, nth) AS source
FROM m GROUP BY entry_id""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), "l_linenumber", F.struct((F.col("l_partkey") % 1500).alias("source_id")).alias("e"))
    entries = lines.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "e"))), lambda x: x["e"]).alias("evidence"))
    return retrieval.live_evidence(entries, corpus(spark, sf), include_reference=True)


INDEX_CUTS_SQL = r"""
texts AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
walk AS (
  SELECT doc_id, t, 0 AS start, {first} AS stop, 0 AS part FROM texts WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, greatest(start + 1, stop - 150), {later}, part + 1 FROM walk WHERE stop < length(t))
SELECT doc_id, part, trim(substr(t, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS passage FROM walk WHERE trim(substr(t, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"""


def _index_stop(start: str) -> str:
    def last(mark: str) -> str:
        inside = f"substr(t, {start} + 1156 + 1, 544)"
        return f"CASE WHEN contains({inside}, '{mark}') THEN {start} + 1156 + length({inside}) - instr(reverse({inside}), reverse('{mark}')) - length('{mark}') + 1 ELSE -1 END".replace("'\n'", "chr(10)")

    natural = "greatest(" + ", ".join(last(m) for m in ("\n", ". ", "? ", "! ", "; ")) + ")"
    return f"CASE WHEN {start} + 1700 >= length(t) THEN length(t) WHEN {natural} >= 0 THEN {natural} + 1 ELSE {start} + 1700 END"


@RETRIEVAL.add("passages_index", "doc_id bigint, part bigint, passage string", "WITH RECURSIVE " + INDEX_CUTS_SQL.format(first=_index_stop("0"), later=_index_stop("greatest(start + 1, stop - 150)")))
def _(spark, sf):
    return passages.cut(table(spark, sf, "documents"), "doc_id", "text", passages.index_cuts)


@RETRIEVAL.add("conversation_compact", "conv_id bigint, turn bigint, kept string", r"""
WITH said AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
sized AS (SELECT *, least(length(t), CASE n WHEN 1 THEN 1800 ELSE 650 END) AS size FROM said WHERE n <= 6),
left_over AS (SELECT *, 3600 - coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM sized)
SELECT conv_id, turn, right(t, least(size, rest)::INT) AS kept FROM left_over WHERE rest > 0""")
def _(spark, sf):
    return recent_messages(table(spark, sf, "conversations"), "conv_id", "turn", n=6, latest=1800, each=650, total=3600)


@RETRIEVAL.add("follow_up_flag", "conv_id bigint, turn bigint, follow_up boolean", f"SELECT conv_id, turn, len({query_terms_sql('text')}) = 0 OR regexp_matches({norm_sql('text')}, '{FOLLOW_UP}') AS follow_up FROM conversations WHERE role = 'user'")
def _(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", needs_context("text").alias("follow_up"))


BROAD_SQL = " OR ".join(f"contains({fold_sql('x')}, '{p}')" for p in CONFUSION_PARTS)


@RETRIEVAL.add("confusion_flags", "conv_id bigint, turn bigint, shared boolean, broad boolean", f"SELECT conv_id, turn, regexp_matches(trim({fold_sql('x')}), '{CONFUSION}') AS shared, {BROAD_SQL} AS broad FROM (SELECT *, CASE (conv_id + turn) % 5 WHEN 0 THEN 'No entiendo ' || text WHEN 1 THEN text || ' ¿Qué significa?' WHEN 2 THEN 'Me perdí. ' || text ELSE text END AS x FROM conversations)")
def _(spark, sf):
    n = (F.col("conv_id") + F.col("turn")) % 5
    x = F.when(n == 0, F.concat(F.lit("No entiendo "), "text")).when(n == 1, F.concat("text", F.lit(" ¿Qué significa?"))).when(n == 2, F.concat(F.lit("Me perdí. "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", analytics.shows_confusion(x).alias("shared"), analytics.shows_confusion_broad(x).alias("broad"))


@RETRIEVAL.add("concept_detect", "key bigint, concept string", f"WITH n AS (SELECT DISTINCT {squeeze_sql('w')} AS name FROM (SELECT unnest(string_split(text, ' ')[1:2]) AS w FROM benchmark) WHERE {squeeze_sql('w')} <> '') SELECT doc_id AS key, name AS concept FROM documents, n WHERE contains({squeeze_sql('text')}, name)")
def _(spark, sf):
    names = table(spark, sf, "benchmark").select(F.explode(F.slice(F.split("text", " "), 1, 2)).alias("name"))
    return analytics.named_concepts(table(spark, sf, "documents").withColumnRenamed("doc_id", "key"), names)


@RETRIEVAL.add("transcripts", "conv_id bigint, transcript string", "SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return transcripts(table(spark, sf, "conversations"))
