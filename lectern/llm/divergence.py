"""Source divergence audit from joint count histograms.

Each language keeps the terms that enough of its documents have. A source's smoothed share of a term depends on the term's count alone, so a
divergence between two sources is a sum over the distinct pairs of counts, each times the number of terms that have it. Those joint histograms
are tallied from terms that both sources have; cells in which one or both counts are zero are implied by the sources' own histograms and by the
number of kept terms.

Counting reads each text once and combines its terms before they are shuffled, by source first, so that a frequent term or a large source is
never one task's. Arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: What a task counts before it hands its tallies on: entries and bytes of terms.
ENTRIES = 400_000
TERM_BYTES = 48 << 20
ROWS = 20_000

#: Every byte of UTF-8 that isn't an ASCII letter or part of a longer character becomes a blank; A to Z become lower-case.
AS_TERMS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each term in the group's documents, and documents that have it; nulls are ''."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        entries = held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (in_lang, of), terms in counts.items():
                items = list(terms.items())
                for at in range(0, len(items), ROWS):
                    part = items[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([in_lang] * len(part)), pa.array([of] * len(part)), pa.array([t for t, _ in part], pa.binary()), pa.array([n for _, (n, _) in part], pa.int64()), pa.array([d for _, (_, d) in part], pa.int64())],
                        names=["lang", "source", "term", "n", "n_docs"],
                    )

        for batch in batches:
            for body, in_lang, of in zip(batch.column("body"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                known = counts[in_lang, of]
                for term, n in Counter(body.as_py().translate(AS_TERMS).split()).items():
                    seen = known.get(term)
                    if seen is None:
                        known[term] = [n, 1]
                        entries += 1
                        held += len(term)
                    else:
                        seen[0] += n
                        seen[1] += 1
                if entries >= ENTRIES or held >= TERM_BYTES:
                    yield from told()
                    counts.clear()
                    known = {}
                    entries = held = 0
        yield from told()

    blank = lambda name: F.coalesce(docs[name].cast("string"), F.lit(""))
    parts = docs.select(blank(text).cast("binary").alias("body"), blank(lang).alias("lang"), blank(source).alias("source"))
    counted = parts.mapInArrow(tally, "lang string, source string, term binary, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def joint_counts(kept: DataFrame) -> DataFrame:
    """(lang, cells) of kept terms -> (lang, g, h, a, b, times): of how many terms the sources g < h have the counts a and b, both above zero.

    ``cells`` is sorted by source. Terms with the same counts are tallied as one.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        joint: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            names, items = list(codes), list(joint.items())
            for at in range(0, len(items), ROWS):
                part = items[at : at + ROWS]
                columns = list(zip(*(key for key, _ in part)))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([names[c] for c in columns[i]]) for i in range(3)), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array([n for _, n in part], pa.int64())],
                    names=["lang", "g", "h", "a", "b", "times"],
                )
            joint.clear()

        for batch in batches:
            for lang, cells, times in zip(batch.column("lang").to_pylist(), batch.column("cells").to_pylist(), batch.column("times").to_pylist()):
                in_lang = codes.setdefault(lang, len(codes))
                coded = [(codes.setdefault(c["source"], len(codes)), c["n"]) for c in cells]
                for (g, a), (h, b) in combinations(coded, 2):
                    joint[in_lang, g, h, a, b] += times
                    if len(joint) >= ENTRIES:
                        yield from told()
        yield from told()

    alike = kept.groupBy("lang", "cells").agg(F.count("*").alias("times"))
    told = alike.mapInArrow(tally, "lang string, g string, h string, a long, b long, times long")
    return told.groupBy("lang", "g", "h", "a", "b").agg(F.sum("times").alias("times"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)); null where nothing is kept. Decimals hold what longs can't."""
    return F.expr(f"1L + ({SCALE}BD * ({n} + 2)) div nullif({total} + 2 * {terms}, 0)")


def spread(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)): at most 10^18 before it is divided."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language with the divergence from it, part ``term`` the
    ``top`` terms that tell the source from its language.

    Null texts, languages and sources are ''. A group without terms, or one of empty texts, has zero counts and takes part; where a language keeps
    no term, pairs have the value 0. A language with one source has no pairs. Repeated rows count each. Equal values rank by item. An empty table gives an empty
    result; further columns are ignored.
    """
    cells = count_terms(docs, text, lang, source)
    by_term = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    kept = cut_lineage(by_term.filter(F.col("n_docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "lang_n", "cells"))

    each = kept.select("lang", "term", "lang_n", F.inline("cells"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    there = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = there.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(F.col(c), zero).alias(c) for c in ("total", "terms", "lang_total")))
    groups = cut_lineage(groups)

    # Joint histograms, with what each source's own histogram implies: (a, 0), (0, b) and (0, 0).
    right = groups.select("lang", F.col("source").alias("h"), F.col("total").alias("h_total"))
    pairs = groups.select("lang", F.col("source").alias("g"), F.col("total").alias("g_total"), "terms").join(right, "lang").filter("g < h")
    own = each.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    cell = lambda a, b, times: F.struct(F.expr(a).cast("long").alias("a"), F.expr(b).cast("long").alias("b"), F.expr(times).cast("long").alias("times"))
    implied = lambda rows, *told: rows.select("lang", "g", "h", F.inline(F.array(*told)))
    found = [
        pairs.select("lang", "g", "h", zero.alias("a"), zero.alias("b"), F.col("terms").alias("times")),
        implied(pairs.join(own.withColumnRenamed("source", "g"), ["lang", "g"]), cell("n", "0", "times"), cell("0", "0", "-times")),
        implied(pairs.join(own.withColumnRenamed("source", "h"), ["lang", "h"]), cell("0", "n", "times"), cell("0", "0", "-times")),
        implied(joint_counts(kept), cell("a", "b", "times"), cell("a", "0", "-times"), cell("0", "b", "-times"), cell("0", "0", "times")),
    ]
    joint = found[0]
    for more in found[1:]:
        joint = joint.unionByName(more)
    joint = joint.groupBy("lang", "g", "h", "a", "b").agg(F.sum("times").alias("times"))
    once = joint.join(pairs, ["lang", "g", "h"]).withColumn("p", share("a", "g_total", "terms")).withColumn("q", share("b", "h_total", "terms"))
    values = once.groupBy("lang", "g", "h").agg(F.coalesce(F.sum(F.col("times") * spread("p", "q")), zero).alias("value"))
    both = values.select("lang", "value", F.inline(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item")), F.struct(F.col("h").alias("source"), F.col("g").alias("item")))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    between = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    shares = each.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms")).withColumn("q", share("lang_n", "lang_total", "terms"))
    telling = shares.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), spread("p", "q").alias("value"))
    first = telling.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return between.unionByName(first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and the terms that tell it from its language."""
    return divergence(read_table(spark, sf_dir, "documents"))


#: The same sums, over all kept terms of each pair.
OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS body, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
cells AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS terms, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY lang, source),
grps AS (
  SELECT d.lang, d.source, coalesce(t.total, 0)::HUGEINT AS total, coalesce(l.terms, 0)::HUGEINT AS terms, coalesce(l.lang_total, 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN totals t ON d.lang = t.lang AND d.source = t.source LEFT JOIN langs l ON d.lang = l.lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.terms) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (g.lang_total + 2 * g.terms) AS q
  FROM grps g JOIN kept k ON g.lang = k.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
