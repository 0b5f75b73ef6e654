"""Where the sections of a document begin: by its contents list, its outline, the looks of its headings, or not at all.

The four strategies are worked out side by side as rows; each has its quota of confirmations, and a document takes the first that meets its
own. Listed titles are aligned with headings so that places never go back: of all such alignments the one whose scores add up to most.

documents: doc, pages. contents: doc, first_page, last_page, confidence. entries: doc, nth, title, number, level, printed. outline: doc, nth, title,
level, page. headings: doc, page, line, title, number, level, score, confidence. A place is a page and a line on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import core_title
from lectern.operators.knowledge import cut
from lectern.operators.layout import keep_best_neighbour, similar_titles

STRATEGIES = ("contents", "outline", "looks", "whole")
WHOLE_TITLE = "Material general"
LEAST_SIMILAR = 0.84
#: The score of an outline's own page, below that of any heading.
OWN_PAGE = 0.5
LINES = 100_000


def place(page: Column | str, line: Column | str) -> Column:
    """A page and a line as one number."""
    return (F.col(page) if isinstance(page, str) else page).cast("long") * LINES + (F.col(line) if isinstance(line, str) else line).cast("long")


def scored_pairs(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc, nth, at, score): headings that each entry (title, number, target) may mean, with their places. Titles are compared once for each document."""
    e = entries.select("doc", "nth", F.col("title").alias("e_title"), F.col("number").alias("e_number"), "target")
    h = headings.select("doc", F.col("title").alias("h_title"), F.col("number").alias("h_number"), "page", place("page", "line").alias("at"), "confidence")
    pairs = e.join(similar_titles(entries, headings, "doc", LEAST_SIMILAR), ["doc", "e_title"]).join(h, ["doc", "h_title"])
    numbered = F.when((F.col("e_number") != "") & (F.col("e_number") == F.col("h_number")), 0.22).otherwise(0.0)
    near = F.greatest(F.lit(0.0), 0.18 - 0.004 * F.abs(F.col("page") - F.col("target")))
    return pairs.groupBy("doc", "nth", "at").agg(F.max(0.62 * F.col("similarity") + numbered + near + 0.16 * F.col("confidence")).alias("score"))


def aligned(pairs: DataFrame) -> DataFrame:
    """(doc, nth, at, score) of ``pairs`` in which every entry has one place at most, no place is before that of an earlier entry, and the
    scores (to six digits) add up to most; of equal sums the one whose last, and so on backwards, comes first among the pairs.

    A walk over a document's pairs in order, in n log n steps: each takes the best sum that may precede it, and remembers which that was.
    """
    def chain(nth: list[int | None], at: list[int | None], weight: list[int]) -> list[int]:
        """Which of a document's sorted pairs make the heaviest chain. ``most`` is a Fenwick tree over the places: the best chain that ends at one of
        them or before, with the pair that ends it; pairs of one entry go in together, when the next begins."""
        ranks = {x: i + 1 for i, x in enumerate(sorted({x for x in at if x is not None}))}
        most: list[tuple[int, int] | None] = [None] * (len(ranks) + 1)
        before, totals, waiting = [], [], []
        for i, (n, a, w) in enumerate(zip(nth, at, weight)):
            if waiting and nth[waiting[0]] != n:
                for j in waiting:
                    k = ranks[at[j]]
                    while k < len(most):
                        most[k] = max(most[k] or (totals[j], -j), (totals[j], -j))
                        k += k & -k
                waiting = []
            best, k = None, 0 if n is None or a is None else ranks[a]
            while k:
                if most[k] and (best is None or most[k] > best):
                    best = most[k]
                k -= k & -k
            totals.append(w + (best[0] if best else 0))
            before.append(-best[1] if best else -1)
            if n is not None and a is not None:
                waiting.append(i)
        i, taken = max(range(len(totals)), key=lambda j: (totals[j], -j)), []
        while i >= 0:
            taken.append(i)
            i = before[i]
        return taken

    listed = pairs.select("doc", F.col("nth").cast("long").alias("nth"), "at", F.round(F.col("score") * 1_000_000).cast("long").alias("weight"), "score")
    rows = listed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nth", "at", "weight", "score"))).alias("p"))
    each = lambda c: F.transform("p", lambda x: x[c])
    taken = rows.select("doc", "p", F.explode(F.udf(chain, "array<int>")(each("nth"), each("at"), each("weight"))).alias("i"))
    return taken.select("doc", F.get("p", F.col("i"))["nth"].alias("nth"), F.get("p", F.col("i"))["at"].alias("at"), F.get("p", F.col("i"))["score"].alias("score"))


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _told(boundaries: DataFrame, strategy: str) -> DataFrame:
    at = F.col("at")
    return boundaries.select("doc", F.lit(strategy).alias("strategy"), F.floor(at / LINES).cast("long").alias("page"), (at % LINES).alias("line"), "title", "level", "confidence")


def contents_strategy(documents: DataFrame, contents: DataFrame, entries: DataFrame, headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundaries, verdicts). A list in the last 45 per cent of a document stands behind its body and needs a fifth of its entries confirmed by
    headings, any other 55 per cent; three at least, as there must be of entries and of headings in the body. Entries that repeat title and page count once."""
    once = entries.groupBy("doc", core_title("title").alias("_key"), "printed").agg(F.min_by(F.struct("nth", "title", "number", "level"), "nth").alias("e")).select("doc", "printed", "e.*")
    lists = contents.join(documents, "doc").withColumn("behind", F.col("first_page") - 1 >= 0.55 * F.col("pages"))
    body = headings.join(lists.select("doc", "first_page", "last_page", "behind"), "doc").filter(F.when(F.col("behind"), F.col("page") < F.col("first_page")).otherwise(F.col("page") > F.col("last_page")))
    ranges = body.groupBy("doc").agg(F.count("*").alias("in_body"), F.min("page").alias("least"), F.max("page").alias("most"))
    counted = once.groupBy("doc").agg(F.count("*").alias("entries"), F.min("printed").alias("p_least"), F.max("printed").alias("p_most"))
    known = lists.join(ranges, "doc").join(counted, "doc").filter("in_body >= 3 AND entries >= 3")
    low, high = F.when(F.col("behind"), F.col("least")).otherwise(F.col("last_page") + 1), F.when(F.col("behind"), F.col("most")).otherwise(F.col("pages"))
    scaled = low + (F.col("printed") - F.col("p_least")) / (F.col("p_most") - F.col("p_least")) * (high - low)
    target = F.when(F.col("behind") & (F.col("p_most") > F.col("p_least")), scaled).otherwise(F.greatest(low, F.least(high, F.col("printed"))))
    pairs = cut(scored_pairs(once.join(known, "doc").withColumn("target", target).select("doc", "nth", "title", "number", "target"), body))
    confirmed = pairs.groupBy("doc").agg(F.countDistinct("nth").alias("confirmed"))
    rows = cut(aligned(pairs).join(once, ["doc", "nth"]).withColumn("confidence", _clamped(F.col("score"), 0.72, 0.995)))
    chains = rows.groupBy("doc").agg(F.count("*").alias("n"), F.median("confidence").alias("middle"))
    quota = F.greatest(F.lit(3), F.ceil(F.col("entries") * F.when(F.col("behind"), 0.20).otherwise(0.55)))
    verdicts = known.join(confirmed, "doc", "left").join(chains, "doc", "left").select(
        "doc", F.lit("contents").alias("strategy"), "entries", F.coalesce("confirmed", F.lit(0)).alias("confirmed"),
        ((F.coalesce("confirmed", F.lit(0)) >= quota) & (F.coalesce("n", F.lit(0)) >= 3)).alias("holds"), _clamped((F.col("confidence") + F.col("middle")) / 2, 0.65, 0.99).alias("confidence"),
    )
    return _told(rows, "contents"), verdicts


def outline_strategy(documents: DataFrame, outline: DataFrame, headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundaries, verdicts). An entry stands at a heading that it means or at the top of its own page; two at least must keep the order."""
    there = outline.join(documents, "doc").filter("page BETWEEN 1 AND pages").select("doc", "nth", "title", F.lit("").alias("number"), "level", "page")
    found = scored_pairs(there.withColumn("target", F.col("page")), headings)
    own = there.select("doc", "nth", place("page", F.lit(0)).alias("at"), F.lit(OWN_PAGE).alias("score"))
    rows = aligned(found.unionByName(own)).join(there.select("doc", "nth", "title", "level"), ["doc", "nth"])
    rows = cut(rows).withColumn("confirmed", F.col("score") > OWN_PAGE).withColumn("confidence", F.when(F.col("confirmed"), _clamped(F.col("score"), 0.76, 0.99)).otherwise(0.72))
    counted = there.groupBy("doc").agg(F.count("*").alias("entries"))
    verdicts = rows.groupBy("doc").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"), F.median("confidence").alias("confidence")).join(counted, "doc")
    return _told(rows, "outline"), verdicts.select("doc", F.lit("outline").alias("strategy"), "entries", "confirmed", (F.col("n") >= 2).alias("holds"), "confidence")


def looks_strategy(headings: DataFrame, least: float = 9, least_plain: float = 12) -> tuple[DataFrame, DataFrame]:
    """(boundaries, verdicts). Headings that score ``least``; where two of them have numbers, only those with one and such that score
    ``least_plain``; of neighbouring lines the best. Two at least."""
    strong = headings.filter(F.col("score") >= least)
    numbers = strong.groupBy("doc").agg(F.count_if(F.col("number") != "").alias("numbered"))
    chosen = strong.join(numbers, "doc").filter((F.col("numbered") < 2) | (F.col("number") != "") | (F.col("score") >= least_plain)).drop("numbered")
    rows = keep_best_neighbour(chosen, ["doc", "page"], "line").withColumn("at", place("page", "line"))
    verdicts = rows.groupBy("doc").agg(F.count("*").alias("entries"), F.median("confidence").alias("middle"))
    return (
        _told(rows.withColumn("confidence", _clamped(F.col("confidence"), 0.55, 0.92)), "looks"),
        verdicts.select("doc", F.lit("looks").alias("strategy"), "entries", F.col("entries").alias("confirmed"), (F.col("entries") >= 2).alias("holds"), _clamped(F.col("middle"), 0.58, 0.92).alias("confidence")),
    )


def whole_strategy(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundaries, verdicts): the document is one section, which always holds."""
    rows = documents.select("doc", place(F.lit(1), F.lit(0)).alias("at"), F.lit(WHOLE_TITLE).alias("title"), F.lit(1).alias("level"), F.lit(0.34).alias("confidence"))
    return _told(rows, "whole"), documents.select("doc", F.lit("whole").alias("strategy"), F.lit(0).alias("entries"), F.lit(0).alias("confirmed"), F.lit(True).alias("holds"), F.lit(0.34).alias("confidence"))


def choose_boundaries(documents: DataFrame, contents: DataFrame, entries: DataFrame, outline: DataFrame, headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundaries, documents): those of the first strategy, in the order of ``STRATEGIES``, that holds for the document; and a row for each
    document with strategy, entries, confirmed, confirmed_share, boundaries, confidence.

    Rows without a doc, and entries or headings without a title or a place, count for nothing. Repeated rows of ``documents`` count once.
    """
    documents = documents.filter("doc IS NOT NULL AND pages IS NOT NULL").groupBy("doc").agg(F.max("pages").alias("pages"))
    contents = contents.groupBy("doc").agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.max("confidence").alias("confidence"))
    entries = entries.filter("title IS NOT NULL AND printed IS NOT NULL").withColumn("number", F.coalesce("number", F.lit("")))
    headings = headings.filter("title IS NOT NULL AND page IS NOT NULL AND line IS NOT NULL").withColumn("number", F.coalesce("number", F.lit("")))
    tried = [contents_strategy(documents, contents, entries, headings), outline_strategy(documents, outline.filter("title IS NOT NULL"), headings), looks_strategy(headings), whole_strategy(documents)]
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    verdicts = reduce(DataFrame.unionByName, (v for _, v in tried)).filter("holds").join(documents.select("doc"), "doc", "left_semi")
    chosen = verdicts.groupBy("doc").agg(F.min_by(F.struct("strategy", "entries", "confirmed", "confidence"), rank).alias("c")).select("doc", "c.*")
    boundaries = reduce(DataFrame.unionByName, (b for b, _ in tried)).join(chosen.select("doc", "strategy"), ["doc", "strategy"], "left_semi")
    counts = boundaries.groupBy("doc").agg(F.count("*").alias("boundaries"))
    share = F.when(F.col("entries") > 0, F.col("confirmed") / F.col("entries")).otherwise(0.0)
    return boundaries, chosen.join(counts, "doc", "left").select("doc", "strategy", "entries", "confirmed", share.alias("confirmed_share"), F.coalesce("boundaries", F.lit(0)).alias("boundaries"), "confidence")
