"""Page layout: items to lines, contents lists, headings by their looks, and where listed titles stand in the body.

Lines have: doc, page, line_no (reading order), text, x, y, width, font_size, bold. Pages are 600 by 800 points unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_line, core_title, key_similarity, numbering, once

# Words that open a heading.
SECTION_WORD = r"(?i)^(parte|part|cap[íi]tulo|chapter|unidad|unit|módulo|module|sección|section|tema|lección|leccion|introducción|introduccion|conclusión|conclusion|prefacio|prólogo|prologo|apéndice|apendice)\b"
ENTRY = r"^(.+?)(\.{2,}|·{2,}|…{2,}|\s)\s*([0-9]{1,4})$"


def lines_from_items(items: DataFrame, by: list[str], *, tolerance: float = 3.2, page_width: float = 600.0) -> DataFrame:
    """Lines of text from placed pieces (text, x, y, width, font_size): (by, line_no, text, x, y, width, font_size, items).

    Sorted from the top, a piece that is further than ``tolerance`` below the one before it opens a new band; within a band a gap of
    over 12 per cent of the width (42 points at least) opens a new line. A blank is put where a gap is over 15 per cent of the font size, 1.15 to
    2.8 points. Bands grow from neighbour to neighbour, not around a moving mean.
    """
    down = Window.partitionBy(*by).orderBy(F.desc("y"), "x")
    banded = items.withColumn("_new", F.when(F.lag("y").over(down) - F.col("y") <= tolerance, 0).otherwise(1)).withColumn("_band", F.sum("_new").over(down))
    along = Window.partitionBy(*by, "_band").orderBy("x", "text")
    gap = F.col("x") - (F.lag("x").over(along) + F.lag("width").over(along))
    placed = banded.withColumn("_gap", gap).withColumn("_cut", F.when(F.col("_gap").isNull() | (F.col("_gap") > max(42.0, 0.12 * page_width)), 1).otherwise(0))
    placed = placed.withColumn("_part", F.sum("_cut").over(along))
    joint = F.when(F.col("_cut") == 1, "").when(F.col("_gap") > F.greatest(F.lit(1.15), F.least(F.lit(2.8), 0.15 * F.col("font_size"))), " ").otherwise("")
    pieces = F.array_sort(F.collect_list(F.struct("x", F.concat(joint, F.col("text")).alias("t"))))
    lines = placed.groupBy(*by, "_band", "_part").agg(
        F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"), F.min("x").alias("x"), F.avg("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.max("font_size").alias("font_size"), F.count("*").alias("items"),
    )
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(*by).orderBy("_band", "_part"))).drop("_band", "_part")


def contents_entry(text: Column | str, page_count: Column | int = 5000, right: Column | None = None) -> Column:
    """(title, page, dotted, number, level) of a line of a contents list, or null: a title, leaders or a page number at the right, the number."""
    def told(line: Column) -> Column:
        page = F.regexp_extract(line, ENTRY, 3).try_cast("int")
        dotted = line.rlike(r"(\.{2,}|·{2,}|…{2,})\s*[0-9]{1,4}$")
        title = F.trim(F.regexp_replace(F.regexp_extract(line, ENTRY, 1), r"[.·…]{2,}\s*$", ""))
        at_right = F.lit(True) if right is None else F.coalesce(right, F.lit(False))
        number = numbering(title)
        sentence = title.rlike(r"[.!?;:]$") & number.isNull()
        pages = F.lit(page_count) if isinstance(page_count, int) else page_count
        fine = page.isNotNull() & (F.length(title) >= 3) & (page >= 1) & (page <= F.greatest(pages, F.lit(5000))) & (dotted | at_right) & ~sentence
        level = F.coalesce(number["level"], F.when(title.rlike(SECTION_WORD), 1).otherwise(2))
        return F.when(fine, F.struct(title.alias("title"), page.alias("page"), dotted.alias("dotted"), F.coalesce(number["number"], F.lit("")).alias("number"), level.alias("level")))

    # Most lines are too long or don't end in a number, which is seen before they are taken apart.
    return once(clean_line(text), lambda line: F.when((F.length(line) <= 180) & line.rlike(r"[0-9]$"), told(line)))


def contents_scores(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, entries, score): how much each page looks like a contents list."""
    told = lines.withColumn("_e", contents_entry("text"))
    found = told.groupBy(*by).agg(F.count("*").alias("rows"), F.count("_e").alias("entries"), F.count_if(F.col("_e.dotted")).alias("dotted"), F.count_if(F.col("_e.number") != "").alias("numbered"))
    return found.select(*by, "entries", (F.col("entries") * 2 + F.col("entries") / F.greatest(F.lit(1), F.col("rows")) * 10 + F.col("dotted") * 1.5 + F.col("numbered")).alias("score"))


def contents_window(scores: DataFrame, headings: DataFrame, doc: str, page: str, reach: int = 50) -> DataFrame:
    """(doc, start, end): from the first page with a contents heading to the last page, around the best score of 10 or more within
    ``reach`` pages, before two quiet ones (a score under 6) in a row."""
    first = headings.groupBy(doc).agg(F.min(page).alias("start"))
    near = scores.join(first, doc).filter((F.col(page) >= F.col("start")) & (F.col(page) < F.col("start") + reach))
    best = near.groupBy(doc).agg(F.max(F.struct("score", (-F.col(page)).alias("early"))).alias("b")).filter("b.score >= 10").select(doc, (-F.col("b.early")).alias("best"))
    tail = near.join(best, doc).filter(F.col(page) >= F.col("best"))
    along = Window.partitionBy(doc).orderBy(page)
    quiet = F.col("score") < 6
    stops = tail.withColumn("_stop", F.when(quiet & (F.lag("score").over(along) < 6), 1).otherwise(0)).withColumn("_after", F.sum("_stop").over(along))
    return stops.filter((F.col("_after") == 0) & ~quiet).groupBy(doc).agg(F.max("start").alias("start"), F.max(page).alias("end"))


def heading_scores(lines: DataFrame, doc: str, page: str, order: str, *, height: float = 800.0) -> DataFrame:
    """Lines that look like headings: ``lines`` with score (7 or more), level and confidence.

    Numbers and section words count 4; bold type, larger type (twice if much larger), a place at the top and space above 2 each; space below,
    no full stop, shortness and capitals at the top 1 each. A style that several candidates of a document share adds 2.
    """
    one = lambda condition, n: F.when(condition, n).otherwise(0)

    def looks(text: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
        capitals = F.when(letters >= 5, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)
        return F.struct(
            numbering(text)["level"].alias("level"), text.rlike(SECTION_WORD).alias("word"), text.rlike(r"[.!?;:]$").alias("stop"), F.length(text).alias("size"), (capitals >= 0.82).alias("capitals"),
            text.rlike(r"(?i)©|\b(issn|isbn|doi|www\.|http)").alias("imprint"), F.size(F.split(text, " ")).alias("words"),
        )

    # What a line's text says is worked out before the windows, which keep it, so that no condition reads the text again.
    # A line without text or of over 150 characters is no heading, however it looks.
    told = lines.withColumn("_looks", once(clean_line("text"), lambda text: F.when(F.length(text).between(1, 150), looks(text))))
    by_page = Window.partitionBy(doc, page)
    down = by_page.orderBy(order)
    body = F.coalesce(F.median("font_size").over(by_page), F.lit(10.0))
    above, below = F.greatest(F.lit(0.0), F.coalesce(F.lag("y").over(down) - F.col("y"), F.lit(0.0))), F.greatest(F.lit(0.0), F.coalesce(F.col("y") - F.lead("y").over(down), F.lit(0.0)))
    measured = told.withColumns({"_size": F.col("font_size") / body, "_above": above, "_below": below, "_top": 1 - F.col("y") / height})
    text, numbered = F.col("_looks"), F.col("_looks.level").isNotNull()
    word, short = text["word"], text["size"] <= 85
    spaced = F.col("_above") >= F.greatest(F.col("font_size") * 1.4, F.lit(10.0))
    score = (
        one(numbered, 4) + one(word, 4) + one(F.col("bold"), 2) + one(F.col("_size") >= 1.22, 2) + one(F.col("_size") >= 1.38, 2) + one(F.col("_top") <= 0.22, 2) + one(spaced, 2)
        + one(F.col("_below") >= F.greatest(F.col("font_size") * 0.9, F.lit(7.0)), 1) + one(~text["stop"], 1) + one(short, 1)
        + one(text["capitals"] & short & (F.col("_top") <= 0.32), 1) - one(text["imprint"], 5)
    )
    signal = numbered | word | ((F.col("_size") >= 1.22) & (F.col("bold") | spaced)) | ((F.col("_top") <= 0.22) & (F.col("bold") | (F.col("_size") >= 1.18)))
    prose = text.isNull() | text["stop"] | (text["words"] > 20)
    found = measured.withColumns({"score": score, "level": F.coalesce(text["level"], one(word, 1) + one(~word, 2))}).filter((F.col("score") >= 7) & signal & ~prose)
    style = F.concat_ws("|", (F.floor(F.col("font_size") * 2 + 0.5) / 2).cast("string"), F.when(F.col("bold"), "b").otherwise("n"))
    shared = F.count("*").over(Window.partitionBy(doc, "_style"))
    styled = found.withColumn("_style", style).withColumn("_many", shared >= 3)
    lifted = styled.withColumn("score", F.col("score") + one(F.col("_many"), 2))
    confidence = F.least(F.lit(0.99), 0.42 + (F.col("score") - one(F.col("_many"), 2)) * 0.045 + F.when(F.col("_many"), 0.08).otherwise(0.0))
    return lifted.withColumn("confidence", confidence).select(*lines.columns, "score", "level", "confidence")


def keep_best_neighbour(candidates: DataFrame, by: list[str], order: str, score: str = "score") -> DataFrame:
    """Of candidates on neighbouring lines the one that scores most. Runs of neighbours are taken as one group, whatever came first."""
    along = Window.partitionBy(*by).orderBy(order)
    runs = candidates.withColumn("_new", F.when(F.col(order) - F.lag(order).over(along) <= 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along))
    best = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(F.desc(score), order))
    return runs.withColumn("_n", best).filter("_n = 1").drop("_new", "_run", "_n")


def similar_titles(entries: DataFrame, headings: DataFrame, doc: str, least: float) -> DataFrame:
    """(doc, e_title, h_title, similarity): distinct titles of a document's entries and headings (title) that are as similar as ``least``, above zero.

    Such titles share a word of three letters or are equal, so candidates come from a join on words; a title that many rows have is compared once.
    """
    def named(rows: DataFrame, title: str, key: str) -> DataFrame:
        words = F.array_distinct(F.concat(F.array(key), F.filter(F.split(key, " "), lambda w: F.length(w) >= 3)))
        return rows.select(doc, F.col("title").alias(title)).distinct().withColumn(key, core_title(title)).select(doc, title, key, F.explode(words).alias("_w"))

    pairs = named(entries, "e_title", "_e").join(named(headings, "h_title", "_h"), [doc, "_w"]).drop("_w").distinct()
    return pairs.withColumn("similarity", key_similarity(F.col("_h"), F.col("_e"))).filter(F.col("similarity") >= least).drop("_e", "_h")


def match_headings(entries: DataFrame, headings: DataFrame, doc: str, least: float = 0.84) -> DataFrame:
    """(doc, entry_id, page, similarity, score): the heading that each contents entry most likely means.

    ``entries``: entry_id, title, number, target; ``headings``: page, title, number, confidence. Entries of one title, number and target mean one heading,
    and of headings of one title, number and page the surest counts, so that repeated rows make no pairs.
    """
    asked = entries.select(doc, F.col("title").alias("e_title"), F.col("number").alias("e_number"), "target")
    h = headings.groupBy(doc, F.col("title").alias("h_title"), F.col("number").alias("h_number"), "page").agg(F.max("confidence").alias("confidence"))
    similar = asked.distinct().join(similar_titles(entries, headings, doc, least), [doc, "e_title"]).join(h, [doc, "h_title"])
    near = F.greatest(F.lit(0.0), 0.18 - 0.004 * F.abs(F.col("page") - F.col("target")))
    same = F.when((F.col("e_number") != "") & (F.col("e_number") == F.col("h_number")), 0.22).otherwise(0.0)
    scored = similar.withColumn("score", 0.62 * F.col("similarity") + same + near + 0.16 * F.col("confidence"))
    best = scored.groupBy(doc, "e_title", F.col("e_number").alias("_number"), F.col("target").alias("_target")).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("page")).alias("early"), "similarity")).alias("b"))
    met = entries.select(doc, "entry_id", F.col("title").alias("e_title"), F.col("number").alias("e_number"), "target")
    told = met.join(best.withColumnRenamed(doc, "_doc").withColumnRenamed("e_title", "_title"), (F.col(doc) == F.col("_doc")) & (F.col("e_title") == F.col("_title")) & F.col("e_number").eqNullSafe(F.col("_number")) & F.col("target").eqNullSafe(F.col("_target")))
    return told.groupBy(doc, "entry_id").agg(F.max("b").alias("b")).select(doc, "entry_id", (-F.col("b.early")).alias("page"), F.col("b.similarity").alias("similarity"), F.col("b.score").alias("score"))
