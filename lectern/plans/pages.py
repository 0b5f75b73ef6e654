"""From placed lines to sections: contents lists, headings of one line and of several, boundaries by strategy, roles, texts and warnings.

lines: doc, page, line_no (reading order), text, x, y, font_size, bold. documents: doc, pages. outline: doc, nth, title, level, page. All documents, whatever
their strategy, go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_line, furniture_key, numbering
from lectern.operators.boundaries import LINES, WHOLE_TITLE, choose_boundaries, place
from lectern.operators.knowledge import cut
from lectern.operators.layout import SECTION_WORD, contents_entry, contents_scores, contents_window, heading_scores
from lectern.operators.structure import heading_paths, repeated_furniture, says_something, section_role, title_role

# Roles that bound a section wherever they stand, and the least confidence of a role, a section and a page's cover.
STRUCTURAL = ("preliminares", "indice", "referencias", "apendice", "glosario")
LEAST_ROLE, LEAST_SURE = 0.7, 0.62
MOST_LINES, LEFT, LONGEST_LINE, LONGEST_TITLE = 4, 18.0, 90, 150


def block_headings(lines: DataFrame, *, height: float = 800.0) -> DataFrame:
    """(doc, page, line_no, last_line, title, score, confidence): headings of two to four lines.

    A line that is strong (numbered, a section word, bold or larger) opens a block; the lines below join it as long as they are strong, of its type and left edge, close to the one above
    and 90 characters at most. Blocks are taken from the top of the page, each as long as it goes, and don't overlap. The first line gives looks and place.
    """
    by_page = Window.partitionBy("doc", "page")
    down = by_page.orderBy("line_no")
    body = F.coalesce(F.median("font_size").over(by_page), F.lit(10.0))
    text = clean_line("text")
    told = lines.withColumns({"_text": text, "_ratio": F.col("font_size") / body, "_nth": F.row_number().over(down)})
    strong = numbering("_text").isNotNull() | F.col("_text").rlike(SECTION_WORD) | F.coalesce("bold", F.lit(False)) | (F.col("_ratio") >= 1.18)
    prose = (F.length("_text") == 0) | (F.length("_text") > 150) | F.col("_text").rlike(r"[.!?;:]$") | (F.size(F.split("_text", " ")) > 20)
    told = told.withColumn("_opens", F.when(prose, False).otherwise(strong))

    def joins(k: int) -> Column:
        """Whether the kth line below goes on with the block that this line opens, if those between do."""
        at = lambda c, n: F.lead(c, n).over(down) if n else F.col(c)
        near = F.abs(at("y", k - 1) - at("y", k)) <= F.greatest(F.lit(16.0), F.greatest(F.col("font_size"), at("font_size", k)) * 0.95)
        alike = (F.abs(F.col("x") - at("x", k)) <= LEFT) & (F.floor(F.col("font_size") * 2 + 0.5) == F.floor(at("font_size", k) * 2 + 0.5)) & F.col("bold").eqNullSafe(at("bold", k))
        return F.coalesce(near & alike & at("_opens", k) & (F.length(at("_text", k)) <= LONGEST_LINE), F.lit(False))

    size, goes_on = F.lit(1), F.lit(True)
    for k in range(1, MOST_LINES):
        goes_on = goes_on & joins(k)
        size = size + F.when(goes_on, 1).otherwise(0)
    sized = told.withColumn("_n", F.when(F.col("_opens"), size).otherwise(1))
    # From the top: a block is taken unless its first line is in one taken before.
    listed = F.array_sort(F.collect_list(F.struct("_nth", "_n")))
    none = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("taken"))
    take = lambda acc, x: F.when((x["_n"] > 1) & (x["_nth"] > acc["upto"]), F.struct((x["_nth"] + x["_n"] - 1).alias("upto"), F.array_append(acc["taken"], x["_nth"]).alias("taken"))).otherwise(acc)
    starts = sized.filter("_n > 1").groupBy("doc", "page").agg(F.explode(F.aggregate(listed, none, take)["taken"]).alias("_nth"))
    first = sized.join(starts, ["doc", "page", "_nth"]).select("doc", "page", F.col("_nth").alias("_start"), "_n", "line_no", "font_size", "bold", "y", "_ratio")
    members = first.select("doc", "page", "_start", F.explode(F.sequence("_start", F.col("_start") + F.col("_n") - 1)).alias("_nth")).join(sized.select("doc", "page", "_nth", "line_no", "_text"), ["doc", "page", "_nth"])
    titles = members.groupBy("doc", "page", "_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_text"))), lambda m: m["_text"]), " ").alias("title"), F.max("line_no").alias("last_line"))
    one = lambda condition, n: F.when(condition, n).otherwise(0)
    score = 8 + F.least(F.lit(4), (F.col("_n") - 1) * 2) + one(F.col("bold"), 2) + one(F.col("_ratio") >= 1.22, 2) + one(F.col("_ratio") >= 1.38, 2) + one(1 - F.col("y") / height <= 0.22, 2) + one(~F.col("title").rlike(r"[.!?;:]$"), 1) + one(F.length("title") <= 85, 1)
    found = first.join(titles, ["doc", "page", "_start"]).filter(F.length("title").between(1, LONGEST_TITLE)).withColumn("score", score)
    return found.select("doc", "page", "line_no", "last_line", "title", "score", F.greatest(F.lit(0.62), F.least(F.lit(0.995), 0.50 + F.col("score") * 0.04)).alias("confidence"))


def headings_of(lines: DataFrame, *, height: float = 800.0) -> DataFrame:
    """(doc, page, line, last_line, title, number, level, score, confidence): blocks, and single lines that are in none."""
    blocks = cut(block_headings(lines, height=height))
    number = numbering("title")
    rows = blocks.select("doc", "page", F.col("line_no").alias("line"), "last_line", "title", F.coalesce(number["number"], F.lit("")).alias("number"), F.coalesce(number["level"], F.lit(1)).alias("level"), "score", "confidence")
    inside = blocks.select("doc", "page", F.explode(F.sequence("line_no", "last_line")).alias("line"))
    single = heading_scores(lines, "doc", "page", "line_no", height=height).select("doc", "page", F.col("line_no").alias("line"), F.col("line_no").alias("last_line"), clean_line("text").alias("title"), "score", "level", "confidence")
    single = single.withColumn("number", F.coalesce(numbering("title")["number"], F.lit(""))).join(inside, ["doc", "page", "line"], "left_anti")
    return rows.unionByName(single)


def analyse(lines: DataFrame, documents: DataFrame, outline: DataFrame, *, height: float = 800.0) -> tuple[DataFrame, DataFrame]:
    """(sections, documents). sections: doc, at, page, title, level, path, role, content, last_page, confidence; documents: doc, strategy, confidence, n_headings, n_sections, n_unsure, warnings.

    Lines that repeat on a document's pages, page numbers and blank ones are left out. A page that begins like a contents list opens the list; its entries are no headings. Headings, and a sparse first page,
    whose role bounds a section are boundaries at level 1 beside those of the document's strategy. A section's content has that of the sections below it. Lines before the first boundary are in no section unless the
    document is one section. A document without lines is one empty section.
    """
    # Lines move once, to their document, where pages, furniture and places are told; what a document's pages repeat is a few keys, which its lines see beside them.
    lines = lines.repartition("doc")
    near, far = Window.partitionBy("doc", "page").orderBy("line_no"), Window.partitionBy("doc", "page").orderBy(F.desc("line_no"))
    edges = lines.select("doc", "page", "line_no", F.col("text").alias("line")).withColumns({"_a": F.row_number().over(near), "_z": F.row_number().over(far)}).filter("_a <= 3 OR _z <= 3").select("doc", "page", "line")
    furniture = repeated_furniture(edges, edges.select("doc", "page").distinct(), "doc").groupBy("doc").agg(F.collect_set("key").alias("_keys"))
    # A key only grows with its text, so a long text whose beginning already has a longer key than any that repeats is none of them.
    longer = (F.length("text") > 300) & (F.length(furniture_key(F.left("text", F.lit(300)))) > F.array_max(F.transform("_keys", F.length)))
    repeats = F.when(F.col("_keys").isNull() | longer, False).otherwise(F.array_contains("_keys", furniture_key("text")))
    kept = cut(lines.filter(says_something("text")).join(furniture, "doc", "left").filter(~repeats).drop("_keys"))
    openings = kept.filter(title_role("text") == "indice").select("doc", "page").distinct()
    scores = contents_scores(kept, ["doc", "page"])
    window = contents_window(scores, openings, "doc", "page")
    lists = cut(scores.join(window, "doc").filter("page BETWEEN start AND end").groupBy("doc").agg(F.min("start").alias("first_page"), F.max("end").alias("last_page"), F.least(F.lit(0.99), 0.55 + F.max("score") / 80).alias("confidence")))
    listed = kept.join(lists.select("doc", "first_page", "last_page"), "doc").filter("page BETWEEN first_page AND last_page").withColumn("e", contents_entry("text")).filter("e IS NOT NULL")
    entries = cut(listed.select("doc", "page", "line_no", place("page", "line_no").alias("nth"), F.col("e.title").alias("title"), F.col("e.number").alias("number"), F.col("e.level").alias("level"), F.col("e.page").cast("long").alias("printed")))
    headings = cut(headings_of(kept, height=height).join(entries.select("doc", "page", F.col("line_no").alias("line")), ["doc", "page", "line"], "left_anti"))
    boundaries, chosen = choose_boundaries(documents, lists, entries, outline, headings)
    boundaries, chosen = cut(boundaries), cut(chosen)

    # Roles that bound a section: of headings by their titles, of a sparse first page by its text.
    said = headings.withColumn("r", section_role("title", "title")).filter(F.col("r.role").isin(*STRUCTURAL) & (F.col("r.confidence") >= LEAST_ROLE))
    cover = kept.filter("page = 1").groupBy("doc").agg(F.min(F.struct("line_no", clean_line("text").alias("title"))).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("content"))
    cover = cover.withColumn("r", section_role("first.title", "content", first_page=F.lit(1))).filter("r.role = 'preliminares'")
    roles = said.select("doc", place("page", "line").alias("at"), "title", "confidence", "r").unionByName(cover.select("doc", place(F.lit(1), "first.line_no").alias("at"), "first.title", F.col("r.confidence").alias("confidence"), "r"))
    roles = roles.groupBy("doc", "at").agg(F.max_by(F.struct("title", "confidence", "r"), "confidence").alias("x")).select("doc", "at", F.col("x.title").alias("r_title"), F.col("x.confidence").alias("r_confidence"), F.col("x.r.role").alias("role"))
    # Documents of one section keep the first place; others drop it where a role stands.
    placed = boundaries.select("doc", place("page", "line").alias("at"), "title", "level", "confidence")
    ends = headings.select("doc", place("page", "line").alias("at"), place("page", "last_line").alias("text_from"))
    bounds = placed.join(roles, ["doc", "at"], "full_outer").join(ends, ["doc", "at"], "left").select(
        "doc", "at", F.coalesce("title", "r_title").alias("title"), F.when(F.col("role").isNotNull(), 1).otherwise(F.coalesce("level", F.lit(1))).alias("level"), F.greatest(F.coalesce("confidence", "r_confidence"), "r_confidence").alias("confidence"),
        F.coalesce("role", F.lit("contenido")).alias("role"), F.coalesce("text_from", "at").alias("text_from"),
    ).join(documents.select("doc").distinct(), "doc", "left_semi")
    bounds = cut(heading_paths(bounds, "doc", "at", 8))
    above = heading_paths(bounds.select("doc", "at", "text_from", "level", F.col("at").cast("string").alias("title")), "doc", "at", 8).select("doc", "at", "text_from", "path")

    # Each line goes to the last boundary before it and to those above that.
    marks = above.select("doc", "at", F.lit(0).alias("kind"), F.struct("text_from", "path").alias("mark"), F.lit(None).cast("string").alias("text"))
    rows = marks.unionByName(kept.select("doc", place("page", "line_no").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), clean_line("text").alias("text")))
    owned = rows.withColumn("mark", F.last("mark", ignorenulls=True).over(Window.partitionBy("doc").orderBy("at", "kind"))).filter((F.col("kind") == 1) & (F.col("at") > F.col("mark.text_from")))
    texts = owned.select("doc", F.col("at").alias("line_at"), "text", F.explode("mark.path").alias("at")).groupBy("doc", F.col("at").cast("long").alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_at", "text"))), lambda x: x["text"]), " ").alias("content"), F.max("line_at").alias("last_at"))
    sections = bounds.join(texts, ["doc", "at"], "left").withColumn("content", F.coalesce("content", F.lit(""))).filter((F.col("content") != "") | (F.col("title") == WHOLE_TITLE) | (F.col("role") != "contenido"))
    page = lambda c: F.floor(F.col(c) / LINES).cast("long")
    sections = cut(sections.select("doc", "at", page("at").alias("page"), "title", "level", "path", "role", "content", F.coalesce(page("last_at"), page("at")).alias("last_page"), "confidence"))

    counts = sections.groupBy("doc").agg(F.count("*").alias("n_sections"), F.count_if(F.col("confidence") < LEAST_SURE).alias("n_unsure"))
    n_headings = headings.groupBy("doc").agg(F.count("*").alias("n_headings"))
    met = chosen.join(counts, "doc", "left").join(n_headings, "doc", "left").na.fill(0, ["n_sections", "n_unsure", "n_headings"])
    sure = 0.72 * F.col("confidence") + F.when(F.col("strategy") == "contents", 0.15).when(F.col("strategy") == "outline", 0.10).otherwise(0.0) + F.when(F.col("n_headings") >= 4, 0.05).otherwise(0.0)
    warn = F.array_compact(F.array(F.when((F.col("strategy") == "looks") & (F.col("n_sections") > 1), F.lit("looks_only")), F.when((F.col("strategy") == "contents") & (F.col("confirmed") < F.col("entries")), F.lit("entries_dropped")), F.when(F.col("n_unsure") > 0, F.lit("unsure_sections"))))
    return sections, met.select("doc", "strategy", F.greatest(F.lit(0.34), F.least(F.lit(0.99), sure)).alias("confidence"), "n_headings", "n_sections", "n_unsure", warn.alias("warnings"))
