"""Compilations cut into the works that they hold, lines on the sides of a spread, and material as it is reviewed before it is imported.

Tables: ``works`` (material, work_id, title, author, year, start_page, end_page), ``pages`` (material, page, text), ``chunks`` (material, chunk_id, start,
end, level, title, path, role) with page ranges. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_line, slug
from lectern.operators import contracts, structure
from lectern.operators.structure import islands


def side_lines(lines: DataFrame, by: str, order: str, text: str = "text", left: str = "[LEFT]", right: str = "[RIGHT]") -> DataFrame:
    """(by, line_no, text, side): the lines that aren't blank, numbered from 1, with the side that the last mark before them named.

    Marks are lines of their own, whatever their case, and go; before the first one the side is empty.
    """
    mark = F.upper(F.trim(F.coalesce(F.col(text), F.lit(""))))
    side = F.when(mark == left, "left").when(mark == right, "right")
    before = Window.partitionBy(by).orderBy(order)
    told = lines.withColumn("side", F.coalesce(F.last(side, ignorenulls=True).over(before), F.lit(""))).withColumn("_mark", side.isNotNull())
    kept = told.withColumn(text, F.left(clean_line(text), F.lit(1800))).filter(~F.col("_mark") & (F.col(text) != ""))
    return kept.withColumn("line_no", F.row_number().over(before)).select(by, "line_no", text, "side")


def page_counts(materials: DataFrame, pages: DataFrame) -> DataFrame:
    """(material, page_count): the declared number of pages, or the largest page number if that is more."""
    most = pages.groupBy("material").agg(F.max("page").alias("most"))
    return materials.join(most, "material", "left").select("material", F.greatest(F.coalesce("declared", F.lit(0)), F.coalesce("most", F.lit(0))).cast("long").alias("page_count"))


def reviewed_works(materials: DataFrame, pages: DataFrame, detected: DataFrame) -> DataFrame:
    """(material, title, start_page, end_page): the works that were detected, each up to the next one's start, or one of all pages where none was.

    ``materials`` has material, declared, title; ``detected`` (material, title, start_page), of which one for each start page counts.
    """
    counts = page_counts(materials, pages)
    firsts = detected.groupBy("material", "start_page").agg(F.min("title").alias("title"))
    along = Window.partitionBy("material").orderBy("start_page")
    found = firsts.withColumn("next", F.lead("start_page").over(along)).join(counts, "material").select("material", "title", F.col("start_page").cast("long").alias("start_page"), F.coalesce(F.col("next") - 1, "page_count").cast("long").alias("end_page"))
    alone = materials.join(counts, "material").join(found.select("material").distinct(), "material", "left_anti").select("material", "title", F.lit(1).cast("long").alias("start_page"), F.col("page_count").alias("end_page"))
    return found.unionByName(alone)


def work_errors(works: DataFrame, counts: DataFrame) -> DataFrame:
    """Violations: ranges outside the material's pages, and works that begin before the one before them ends."""
    placed = works.join(counts, "material", "left")
    start, end = F.col("start_page"), F.col("end_page")
    outside = placed.filter(start.isNull() | end.isNull() | (start < 1) | (end < start) | (end > F.coalesce("page_count", F.lit(0)))).select(F.lit("range").alias("rule"), F.lit("work").alias("entity"), F.col("work_id").cast("string").alias("id"), F.concat_ws("-", start.cast("string"), end.cast("string")).alias("detail"))
    before = F.max("end_page").over(Window.partitionBy("material").orderBy("start_page", "work_id", "end_page").rowsBetween(Window.unboundedPreceding, -1))
    overlaps = works.withColumn("before", before).filter(start <= F.col("before")).select(F.lit("overlap").alias("rule"), F.lit("work").alias("entity"), F.col("work_id").cast("string").alias("id"), F.col("before").cast("string").alias("detail"))
    return contracts.all_of(outside, overlaps)


def work_document_id(material: Column, title: Column, start: Column) -> Column:
    return F.concat_ws("-", material, F.lit("obra"), slug(clean_line(title), 64, "obra"), start.cast("string"))


def split_compilation(works: DataFrame, pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, sections and bibliography of the works of a compilation, whose ranges hold no violations.

    documents: (material, document_id, bibliography_id, title, author, year, page_start, page_end, pages). sections: (document_id, bibliography_id, nth, section_id,
    title, path, role, page_start, page_end, content): neighbouring pages whose chunk, title, role and path are the same, in order. A page has the chunk
    that starts last, then the deepest; without one it has the work's title and the role that its text shows. Pages without text are left out, and end a section.
    """
    start, title = F.col("start_page"), clean_line("title")
    documents = works.select(
        "material", "work_id", work_document_id(F.col("material").cast("string"), F.col("title"), start).alias("document_id"),
        F.concat_ws("-", F.lit("bibliografia"), slug(title, 64, "obra"), start.cast("string")).alias("bibliography_id"),
        title.alias("title"), clean_line("author").alias("author"), clean_line("year").alias("year"), start.alias("page_start"), F.col("end_page").alias("page_end"), (F.col("end_page") - start + 1).alias("pages"),
    )
    written = pages.select("material", "page", F.coalesce("text", F.lit("")).alias("text")).filter(F.trim("text") != "")
    ranges = documents.select("material", F.col("page_start").alias("start"), F.col("page_end").alias("end"), "document_id", "bibliography_id", F.col("title").alias("work_title"))
    placed = written.join(ranges, "material").filter((F.col("page") >= F.col("start")) & (F.col("page") <= F.col("end"))).drop("start", "end")
    held = structure.page_containment(written.select("material", "page"), chunks.select("material", F.col("chunk_id").alias("range_id"), "start", "end", "level"), "material", "page").select("material", "page", F.col("range_id").alias("chunk_id"))
    told = chunks.select("material", "chunk_id", F.nullif("title", F.lit("")).alias("c_title"), "path", F.nullif("role", F.lit("")).alias("c_role"))
    met = placed.join(held.join(told, ["material", "chunk_id"]), ["material", "page"], "left")
    shown = F.coalesce("c_title", "work_title")
    role = F.coalesce("c_role", structure.section_role(shown, "text")["role"])
    named = F.coalesce("c_title", F.when(role == "referencias", "Referencias").otherwise(F.col("work_title")))
    dressed = met.select("document_id", "bibliography_id", "page", "text", F.coalesce(F.col("chunk_id").cast("string"), F.lit("")).alias("chunk"), named.alias("title"), role.alias("role"), F.when(F.size("path") > 0, F.col("path")).otherwise(F.array(named)).alias("path"))
    along = Window.partitionBy("document_id").orderBy("page")
    gaps = dressed.withColumn("gap", F.col("page") - F.row_number().over(along)).withColumn("shown", F.array_join("path", " › "))
    runs = islands(gaps, ["document_id"], "page", "chunk", "title", "role", "shown", "gap")
    texts = F.array_sort(F.collect_list(F.struct("page", "text")))
    sections = runs.groupBy("document_id", "bibliography_id", F.col("island").alias("nth")).agg(
        F.min("title").alias("title"), F.min("path").alias("path"), F.min("role").alias("role"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("content"),
    ).withColumn("section_id", F.concat_ws("-", "document_id", F.lit("section"), F.col("nth").cast("string")))
    bibliography = documents.select("bibliography_id", "title", "author", "year", F.col("material").alias("source_document"), "page_start", "page_end")
    return documents, sections, bibliography
