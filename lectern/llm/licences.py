"""Licence scans by sparse TF-IDF cosine and inheritance along paths, on DataFrame operations alone.

Passages that speak of licensing are cut out of whole texts: sentences that hold a cue such as "licensed" or "copyright", with their
neighbours as far as those are made mostly of words which licence templates use; blank lines don't part them. Document frequencies of words are counted over
all passages; passages and templates become sparse vectors of term frequency times inverse document frequency, and each
passage gets the template with the largest cosine. Equal passages are scored once, however many files repeat them.

A file without a licence of its own takes that of the nearest directory above it that has a licence file. Directories, not
files, are exploded to their ancestors, so a directory with a third of all files costs as much as any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table
from lectern.llm.licence_texts import TEMPLATES

#: A passage whose cosine to its best template is below this has no known licence.
LEAST_COSINE = 0.5
#: The share of a sentence's words that templates use, from which it belongs to its neighbours' passage.
LEAST_SHARE = 0.6
#: A file is a licence file by its name, or if passages make up this share of its characters.
FILE_SHARE = 0.25

CUE = r"licen[cs]|copyright|spdx|all rights reserved|public domain|permission is hereby granted|permission to use|redistribution and use|provided 'as-is'|cc by|cc0"
FILE_NAME = r"^(licen[cs]es?|copying|unlicense|notice)([.-][a-z0-9.-]*)?$"


def _terms(text: Column) -> Column:
    """Words of letters, digits and dots, lower-cased, without dots at their ends."""
    spaced = F.regexp_replace(F.lower(text), r"[^a-z0-9.]+|\.(?![a-z0-9])", " ")
    return F.filter(F.split(F.trim(spaced), " +"), lambda w: w != "")


def _sentences(text: Column) -> Column:
    """Lines, cut after the marks that end a sentence."""
    return F.split(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), "\n")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(template, licence, terms) of a fixed list; the list is a parameter and stays on the driver."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)))
    return spark.range(1).select(F.inline(rows)).select("template", "licence", _terms(F.col("text")).alias("terms"))


def vocabulary(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    """Distinct template words, as ``_terms`` makes them."""
    return sorted({w for _, text in templates for w in re.sub(r"[^a-z0-9.]+|\.(?![a-z0-9])", " ", text.lower()).split()})


def passages(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, n_chars, passage) with a row for each licensing passage of the rows (key, text); texts are taken whole."""
    known = F.array(*(F.lit(w) for w in vocabulary(templates)))

    def belongs(sentence: Column) -> Column:
        words = F.array_distinct(_terms(sentence))
        return F.lower(sentence).rlike(CUE) | (F.size(F.array_intersect(words, known)) >= least_share * F.size(words))

    speaking = files.filter(F.lower("text").rlike(CUE)).select("key", F.length("text").alias("n_chars"), _sentences(F.col("text")).alias("lines"))
    marked = F.transform("lines", lambda line: F.when(belongs(line), F.translate(line, "\x00", " ")).otherwise(F.lit("\x00")))
    runs = F.split(F.array_join(marked, "\n"), "\x00")
    trimmed = F.transform(F.filter(runs, lambda run: F.lower(run).rlike(CUE)), lambda run: F.regexp_replace(run, r"^\s+|\s+$", ""))
    return speaking.select("key", "n_chars", F.explode(trimmed).alias("passage"))


def _vectors(rows: DataFrame, idf: DataFrame, n: int, key: str) -> DataFrame:
    """(key, term, weight, norm2) of rows (key, terms): raw frequencies times idf; unseen terms have a frequency of 0."""
    counted = rows.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(idf, "term", "left").select(key, "term", (F.col("tf") * (F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0)).alias("weight"))
    norms = weighed.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"))
    return weighed.join(norms, key)


def match(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(passage, licence, score): the best template of each distinct passage, ties by licence name.

    Document frequencies count all passages with their repeats. The table of templates has a fixed size.
    """
    distinct = cut_lineage(found.groupBy("passage").agg(F.count("*").alias("times")).withColumns({"pid": F.sha2("passage", 256), "terms": _terms(F.col("passage"))}))
    n = distinct.agg(F.sum("times")).first()[0] or 0
    idf = distinct.select("times", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("times").alias("df"))
    idf = cut_lineage(idf)
    ours = _vectors(distinct.select("pid", "terms"), idf, n, "pid")
    theirs = _vectors(templates.select("template", "terms"), idf, n, "template").select("template", "term", F.col("weight").alias("t_weight"), F.col("norm2").alias("t_norm2"))
    # The templates' vectors hold a few hundred rows, a bound that the fixed list sets.
    dots = ours.join(F.broadcast(theirs), "term").groupBy("pid", "template").agg((F.sum(F.col("weight") * F.col("t_weight")) / F.sqrt(F.max("norm2") * F.max("t_norm2"))).alias("cosine"))
    named = dots.join(F.broadcast(templates.select("template", "licence")), "template").select("pid", "licence", F.round("cosine", 6).alias("score"))
    best = named.groupBy("pid").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best"))
    return distinct.join(best, "pid").select("passage", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"))


def _directory(path: Column) -> Column:
    """What stands before the last slash; an empty string, the root, if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, *, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least_cosine: float = LEAST_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """(path, n_passages, licence, score, via, licence_path) for each row of ``files``.

    via is "own" if a passage of the text has a licence (the one with the largest cosine, ties by name), "inherited" if
    the nearest directory upwards has a licence file (of several there, the one whose path is smallest), else "none" with a null
    licence. Null and empty texts have no passages. A null path stands in no directory and neither gives nor inherits. Rows
    that agree in path and text are alike and each has its row; paths that repeat with several texts are judged each by its own text.
    Empty tables give an empty result; further columns are ignored, whatever their names.
    """
    spark = files.sparkSession
    body = F.coalesce(files[text], F.lit(""))
    rows = files.select(files[path].alias("path"), body.alias("text")).withColumn("key", F.sha2(F.concat_ws("\x1f", F.coalesce("path", F.lit("\x00")), "text"), 256))
    found = cut_lineage(passages(rows.select("key", "text"), templates))
    matched = match(found.select("passage"), template_table(spark, templates)).filter(F.col("score") >= least_cosine)
    # A row that is there several times has its passages several times: the largest and the mean are the row's own.
    own = (
        found.join(matched, "passage", "left")
        .groupBy("key").agg(
            F.min(F.when(F.col("licence").isNotNull(), F.struct((-F.col("score")).alias("less"), "licence"))).alias("best"),
            F.count("*").alias("in_all"), F.sum(F.when(F.col("licence").isNotNull(), F.length("passage")).otherwise(0)).alias("licensed_chars"), F.max("n_chars").alias("n_chars"),
        )
    )
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("path").alias("path"))
    each = cut_lineage(
        copies.join(own, "key", "left").select(
            "path", "copies", F.coalesce((F.col("in_all") / F.col("copies")).cast("long"), F.lit(0)).alias("n_passages"),
            F.col("best.licence").alias("own"), (-F.col("best.less")).alias("score"), _directory(F.col("path")).alias("dir"),
            F.coalesce(F.col("licensed_chars") / F.col("copies") >= file_share * F.col("n_chars"), F.lit(False)).alias("mostly"),
        )
    )
    named = F.regexp_extract(F.lower("path"), "[^/]*$", 0).rlike(FILE_NAME)
    granted = (
        each.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("mostly") | named))
        .groupBy("dir").agg(F.min(F.struct("path", "own", "score")).alias("by")).select(F.col("dir").alias("above"), "by")
    )
    dirs = each.filter(F.col("path").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    upward = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    nearest = (
        dirs.select("dir", F.posexplode(upward).alias("depth", "above")).join(granted, "above")
        .groupBy("dir").agg(F.max_by("by", "depth").alias("by"))
    )
    joined = each.filter(F.col("path").isNotNull()).join(nearest, "dir", "left").unionByName(each.filter(F.col("path").isNull()), allowMissingColumns=True)
    has_own = F.col("own").isNotNull()
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "path", "n_passages", F.coalesce("own", "by.own").alias("licence"), F.when(has_own, F.col("score")).otherwise(F.col("by.score")).alias("score"),
        F.when(has_own, "own").when(F.col("by").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(has_own, F.col("path")).otherwise(F.col("by.path")).alias("licence_path"),
    )


def document_path(doc_id: str = "doc_id", source: str = "source") -> Column:
    """A tree for a table that has no paths: a directory for each source, below it one for each thousand and each ten ids."""
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), F.format_string("%05d", F.expr(f"{doc_id} div 1000")), F.format_string("%03d", F.expr(f"{doc_id} div 10 % 100")), F.concat(F.col(doc_id).cast("string"), F.lit(".txt")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, as a file in a tree of sources and ids, with its own or inherited licence."""
    docs = read_table(spark, sf_dir, "documents")
    out = scan(docs.select(document_path().alias("path"), "text"))
    return out.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "n_passages", "licence", "score", "via", "licence_path")


def _sql_terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9.]+', ' ', 'g') || ' ', '\\.+( |$)', ' ', 'g')), ' +'), lambda w: w <> '')"


def op8_sql() -> str:
    """DuckDB's form, file by file and without the detour over distinct passages and directories."""
    quote = lambda text: text.replace("'", "''")
    quoted = ", ".join(f"({i}, '{name}', '{quote(text)}')" for i, (name, text) in enumerate(TEMPLATES))
    known = "[" + ", ".join(f"'{w}'" for w in vocabulary()) + "]"
    cue = quote(CUE)
    return rf"""
WITH templates AS (SELECT t.template, t.licence, {_sql_terms("t.body")} AS terms FROM (VALUES {quoted}) t(template, licence, body)),
files AS (
  SELECT doc_id, coalesce(text, '') AS body,
         coalesce(source, 'none') || '/' || lpad((doc_id // 1000)::VARCHAR, 5, '0') || '/' || lpad((doc_id // 10 % 100)::VARCHAR, 3, '0') AS dir, doc_id::VARCHAR || '.txt' AS name
  FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(regexp_replace(body, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS line,
         generate_subscripts(string_split(regexp_replace(body, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10)), 1) AS nth
  FROM files WHERE regexp_matches(lower(body), '{cue}')),
flagged AS (
  SELECT *, regexp_matches(lower(line), '{cue}') OR len(list_filter(words, lambda w: list_contains({known}, w))) >= {LEAST_SHARE}::DOUBLE * len(words) AS belongs
  FROM (SELECT *, list_distinct({_sql_terms("line")}) AS words FROM lines)),
runs AS (
  SELECT doc_id, grp, regexp_replace(string_agg(line, chr(10) ORDER BY nth), '^\s+|\s+$', '', 'g') AS passage
  FROM (SELECT *, sum(CASE WHEN belongs THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY nth) AS grp FROM flagged) WHERE belongs GROUP BY doc_id, grp),
found AS (SELECT doc_id, grp, passage, {_sql_terms("passage")} AS terms FROM runs WHERE regexp_matches(lower(passage), '{cue}')),
counts AS (SELECT count(*)::DOUBLE AS n FROM found),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, grp, unnest(terms) AS term FROM found) GROUP BY term),
ours AS (
  SELECT doc_id, grp, term, tf * (ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM (SELECT doc_id, grp, term, count(*) AS tf FROM (SELECT doc_id, grp, unnest(terms) AS term FROM found) GROUP BY ALL) LEFT JOIN df USING (term), counts),
theirs AS (
  SELECT template, licence, term, tf * (ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w
  FROM (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(terms) AS term FROM templates) GROUP BY ALL) LEFT JOIN df USING (term), counts),
ours_norm AS (SELECT doc_id, grp, sum(w * w) AS s FROM ours GROUP BY ALL),
theirs_norm AS (SELECT template, sum(w * w) AS s FROM theirs GROUP BY ALL),
cosines AS (
  SELECT o.doc_id, o.grp, t.licence, round(sum(o.w * t.w) / sqrt(max(a.s) * max(b.s)), 6) AS score
  FROM ours o JOIN theirs t USING (term) JOIN ours_norm a ON a.doc_id = o.doc_id AND a.grp = o.grp JOIN theirs_norm b ON b.template = t.template
  GROUP BY o.doc_id, o.grp, t.template, t.licence),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY score DESC, licence) AS r FROM cosines) WHERE r = 1 AND score >= {LEAST_COSINE}),
per_file AS (
  SELECT f.doc_id, count(*) AS n_passages, coalesce(sum(CASE WHEN b.licence IS NOT NULL THEN length(f.passage) END), 0) AS licensed_chars,
         arg_min(b.licence, {{'less': -b.score, 'name': b.licence}}) AS own, max(b.score) AS score
  FROM found f LEFT JOIN best b ON f.doc_id = b.doc_id AND f.grp = b.grp GROUP BY f.doc_id),
each AS (
  SELECT f.doc_id, f.dir, f.dir || '/' || f.name AS path, coalesce(p.n_passages, 0) AS n_passages, p.own, p.score,
         coalesce(p.licensed_chars >= {FILE_SHARE}::DOUBLE * length(f.body), false) AS mostly
  FROM files f LEFT JOIN per_file p USING (doc_id)),
granted AS (SELECT dir, min(path) AS path, arg_min(own, path) AS own, arg_min(score, path) AS score FROM each WHERE own IS NOT NULL AND mostly GROUP BY dir),
inherited AS (
  SELECT e.doc_id, arg_max(g.path, length(g.dir)) AS path, arg_max(g.own, length(g.dir)) AS own, arg_max(g.score, length(g.dir)) AS score
  FROM each e JOIN granted g ON e.dir = g.dir OR starts_with(e.dir, g.dir || '/') GROUP BY e.doc_id)
SELECT e.doc_id, e.path, e.n_passages::BIGINT AS n_passages, coalesce(e.own, i.own) AS licence, CASE WHEN e.own IS NOT NULL THEN e.score ELSE i.score END AS score,
       CASE WHEN e.own IS NOT NULL THEN 'own' WHEN i.own IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
       CASE WHEN e.own IS NOT NULL THEN e.path ELSE i.path END AS licence_path
FROM each e LEFT JOIN inherited i USING (doc_id)
"""
