"""Changes of sections that reach what hangs from them: the section itself, those below it, and rows of older courses that have no ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fold
from lectern.operators.maintenance import range_overlap

CASCADING = ("scope", "priority")


def _words(title: str, parts: bool) -> Column:
    """A title's key: folded words joined by dashes; of chunks without the number of their part."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i) · parte [0-9]+$", "") if parts else F.col(title)
    return F.regexp_replace(F.regexp_replace(fold(bare), "[^a-z0-9]+", "-"), "^-|-$", "")


def patch_matches(rows: DataFrame, patches: DataFrame, *, chunks: bool = False) -> DataFrame:
    """(row, patch_id, how): the rows that each patch reaches; of several ways the first of direct, below and legacy.

    ``rows``: row (a key), section_id, document_id, title, path, page_start, page_end, as sections or, with ``chunks``, as pieces of their texts.
    ``patches``: patch_id, section_id, document_id (null: any), title, path, page_start, page_end, scope, priority. Direct: the same section_id, in whatever document. Below, if
    the patch has a scope or a priority: rows of the document whose path goes on from the patch's (an empty path: all rows with a path). Legacy, if no row has
    the section_id (of sections: in the patch's document): rows of the document with the title and either the path or a page in common. Empty and null ids match nothing, null parts of a path
    are empty, a null path has nothing below or beside it. Paths meet by equality, prefix by prefix; pages only within a title of a document.
    Whether any patch has no document is looked up first, so that rows aren't sent by path and title alone for none.
    """
    plain = lambda p: F.transform(p, lambda x: F.coalesce(x, F.lit("")))
    held = rows.select("row", F.nullif("section_id", F.lit("")).alias("section_id"), F.col("document_id").alias("at"), F.col("title").alias("named"), "path", F.col("page_start").alias("first"), F.coalesce(F.nullif("page_end", F.lit(0)), "page_start").alias("last"))
    asked = patches.select(
        "patch_id", F.nullif("section_id", F.lit("")).alias("section_id"), F.nullif("document_id", F.lit("")).alias("of"), _words("title", False).alias("words"), plain("path").alias("path"),
        F.col("page_start").alias("a"), F.coalesce(F.nullif("page_end", F.lit(0)), "page_start").alias("b"), F.coalesce(*CASCADING).isNotNull().alias("cascades"),
    )
    # Where a patch's section is: the documents that direct ones reach, and the patches that are no legacy.
    places = held.filter("section_id IS NOT NULL").select("section_id", "at").distinct()
    direct = asked.select("patch_id", "section_id", "of").join(places, "section_id")
    there = direct if chunks else direct.filter(F.col("of").isNull() | (F.col("of") == F.col("at")))
    old = asked.drop("section_id", "cascades").join(there.select("patch_id").distinct(), "patch_id", "left_anti")

    # Rows and patches move once, to their document, before they are told by their keys there; a row then sees the patches of its key.
    none = F.array().cast("array<string>")
    mark = lambda way, key, path: F.struct(F.lit(way).alias("way"), key.alias("key"), path.alias("path"))
    prefixes = lambda path: F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: mark("2 below", F.lit(""), F.slice(path, 1, n)))).otherwise(F.array().cast("array<struct<way:string,key:string,path:array<string>>>"))
    path = plain("path")
    marks = F.concat(F.array(mark("1 direct", F.col("section_id"), none), mark("3 legacy", _words("named", chunks), none)), F.coalesce(prefixes(path), F.array().cast("array<struct<way:string,key:string,path:array<string>>>")))
    keyed = held.filter("at IS NOT NULL").repartition("at").select("row", "at", path.alias("own"), "first", "last", F.explode(marks).alias("k")).select("at", "k.*", "row", "own", "first", "last")
    told = lambda df, way, key, path, *more: df.select("at", F.lit(way).alias("way"), key.alias("key"), path.alias("path"), F.struct("patch_id", *(more or (none.alias("p"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")))).alias("patch"))
    sent = told(direct, "1 direct", F.col("section_id"), none)
    sent = sent.unionByName(told(asked.filter("cascades").withColumnRenamed("of", "at"), "2 below", F.lit(""), F.col("path")))
    sent = sent.unionByName(told(old.withColumnRenamed("of", "at"), "3 legacy", F.col("words"), none, F.col("path").alias("p"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    both = keyed.unionByName(sent.filter("at IS NOT NULL").repartition("at"), allowMissingColumns=True).filter("key IS NOT NULL")
    met = both.withColumn("asked", F.collect_list("patch").over(Window.partitionBy("at", "way", "key", "path"))).filter("patch IS NULL").select("at", "row", "way", "own", "first", "last", F.explode("asked").alias("q")).select("*", "q.*")
    near = F.coalesce(F.col("own") == F.col("p"), F.lit(False)) | (range_overlap(F.col("first"), F.col("last"), F.col("a"), F.col("b")) > 0)
    met = met.filter((F.col("way") != "3 legacy") | near)
    out = met.groupBy("at", "row", "patch_id").agg(F.min("way").alias("how"))

    # Rows without a document are reached by their ids only, and patches without one may reach any row.
    lost = held.filter("at IS NULL").select("row", "section_id").join(asked.select("patch_id", "section_id"), "section_id").select("row", "patch_id", F.lit("1 direct").alias("how"))
    out = out.select("row", "patch_id", "how").unionByName(lost)
    if not asked.filter("of IS NULL").isEmpty():
        everywhere = held.select("row", _words("named", chunks).alias("words"), path.alias("own"), "first", "last")
        below = everywhere.filter(F.size("own") > 0).select("row", F.explode(F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda n: F.slice("own", 1, n))).alias("path"))
        below = below.join(asked.filter("cascades AND of IS NULL").select("patch_id", "path"), "path")
        legacy = everywhere.join(old.filter("of IS NULL").withColumnRenamed("path", "p"), "words").filter(near)
        for found, how in ((below, "2 below"), (legacy, "3 legacy")):
            out = out.unionByName(found.select("row", "patch_id", F.lit(how).alias("how")))
        out = out.groupBy("row", "patch_id").agg(F.min("how").alias("how"))
    return out.select("row", "patch_id", F.substring("how", 3, 9).alias("how"))


def patched(rows: DataFrame, patches: DataFrame, fields: list[str], order: str = "patch_id", *, chunks: bool = False) -> DataFrame:
    """``rows`` after all patches: each of ``fields`` has the last value, by ``order``, that a patch which reaches the row gives; a null gives nothing.

    A row without a section_id takes that of the first patch with one that reaches it.
    """
    told = patch_matches(rows, patches, chunks=chunks).join(patches.select("patch_id", F.col(order).alias("_o"), F.nullif("section_id", F.lit("")).alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields)), "patch_id")
    given = told.groupBy("row").agg(F.min_by("_id", F.when(F.col("_id").isNotNull(), F.col("_o"))).alias("_id"), *(F.max_by(f"_{f}", F.when(F.col(f"_{f}").isNotNull(), F.col("_o"))).alias(f"_{f}") for f in fields))
    new = {"section_id": F.coalesce(F.nullif("section_id", F.lit("")), "_id")} | {f: F.coalesce(f"_{f}", f) for f in fields}
    return rows.join(given, "row", "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))
