"""Upkeep of an index of concepts with evidence: batches, coverage, evidence checks, merging of entries, signatures, migration.

An entry has a term, aliases and other lists, and evidence: passages that it was read from. The index is kept up incrementally: what is
processed is left out by anti-joins, and a signature of the corpus says when it is out of date.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fnv1a, normalize, once


def cut(df: DataFrame) -> DataFrame:
    """``df`` kept in the cluster's shared checkpoint folder. A session of one machine that names none gets a new one; on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def remaining(passages: DataFrame, processed: DataFrame, key: str = "passage_id") -> DataFrame:
    """Passages that no batch has processed yet."""
    return passages.join(processed.select(key).distinct(), key, "left_anti")


def coverage(expected: DataFrame, reviewed: DataFrame, group: str, key: str) -> DataFrame:
    """(group, missing, unexpected, exact): how far the reviewed ids of each group are those expected."""
    e, r = (df.select(group, key, F.lit(mark).alias("e"), F.lit(not mark).alias("r")) for df, mark in ((expected, True), (reviewed, False)))
    both = e.unionByName(r).groupBy(group, key).agg(F.max("e").alias("e"), F.max("r").alias("r"))
    # Null ids meet nothing.
    alone = F.col(group).isNull() | F.col(key).isNull()
    counted = both.groupBy(group).agg(F.count_if(F.col("e") & (alone | ~F.col("r"))).alias("missing"), F.count_if(F.col("r") & (alone | ~F.col("e"))).alias("unexpected"))
    return counted.withColumn("exact", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def index_summary(entries: DataFrame, processed: DataFrame, index: DataFrame, group: str) -> DataFrame:
    """(group, entries, evidence, processed, total, status): how far each course's index has come. ``index``: group, total_passages, status, a row each.

    A course without a row has no total and is empty; null evidence is none; a passage that is processed twice counts once.
    """
    held = entries.groupBy(group).agg(F.count("*").alias("entries"), F.sum(F.coalesce(F.array_size("evidence"), F.lit(0))).cast("long").alias("evidence"))
    done = processed.groupBy(group).agg(F.countDistinct("passage_id").alias("processed"))
    told = held.join(done, group, "full_outer").join(index.select(group, F.col("total_passages").cast("long").alias("total"), "status"), group, "full_outer")
    return told.fillna(0, ["entries", "evidence", "processed", "total"]).fillna("empty", ["status"]).select(group, "entries", "evidence", "processed", "total", "status")


def is_supported(passage: Column, quote: Column, least: int = 15) -> Column:
    """A quote of some length that stands in the passage, compared normalised."""
    q = normalize(quote)
    return (F.length(q) >= least) & F.contains(normalize(passage), q)


def verified_excerpt(passage: Column, quote: Column, names: Column, size: int = 180, before: int = 85) -> Column:
    """The quote if it stands in the passage, else what surrounds the longest name found there, else the passage's beginning."""
    low = F.lower(passage)
    held = (F.length(quote) >= 32) & F.contains(low, F.lower(quote))
    longest = F.array_max(F.transform(F.filter(names, lambda n: (n != "") & F.contains(low, F.lower(n))), lambda n: F.struct(F.length(n).alias("n"), n.alias("name"))))["name"]
    at = F.position(F.lower(longest), low)
    return F.when(held, F.left(quote, F.lit(size))).when(longest.isNotNull(), F.substr(passage, F.greatest(F.lit(1), at - before), F.lit(size))).otherwise(F.left(passage, F.lit(size)))


def distinct_by_key(rows: DataFrame, by: str, order: str, value: str, most: int, longest: int = 400) -> DataFrame:
    """(by, values): the first value of each normalised key, in order, at most ``most`` for each group; blank keys don't count."""
    keyed = rows.withColumn("_k", normalize(value)).filter("_k <> ''")
    firsts = keyed.groupBy(by, "_k").agg(F.min(F.struct(order, F.left(F.trim(value), F.lit(longest)).alias("v"))).alias("f"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("f"))
    kept = firsts.withColumn("_n", nth).filter(F.col("_n") <= most)
    return kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["v"]).alias("values"))


def join_overlapping(chunks: Column, least: int = 40, most: int = 320, seam: str = "") -> Column:
    """Chunks joined by a blank line, each without the beginning that repeats the end of what stands before it, where ``seam`` joins them.

    With a seam, what is left of a chunk loses its leading white space; a chunk of which nothing is left adds nothing.
    """

    def overlap(ends: Column) -> Column:
        """The most letters that the end of one text and the beginning of the other share. Only the ends are looked at."""
        sizes = F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda n: (n <= ends["size"]) & F.endswith(ends["tail"], F.left(ends["head"], n)))
        return F.when(F.contains(ends["tail"], F.left(ends["head"], F.lit(least))), F.coalesce(F.get(sizes, F.lit(0)), F.lit(0))).otherwise(0)

    def join(done: Column, x: Column, n: Column) -> Column:
        rest = F.when(n > 0, F.substr(x, n + 1)).otherwise(x)
        rest = F.regexp_replace(rest, r"^\s+", "") if seam else rest
        return once(rest, lambda r: F.when(done == "", x).when(r == "", done).otherwise(F.concat(done, F.when(n > 0, F.lit(seam)).otherwise(F.lit("\n\n")), r)))

    def add(done: Column, x: Column) -> Column:
        head = F.left(x, F.lit(most))
        ends = F.struct(F.right(done, F.lit(most)).alias("tail"), head.alias("head"), F.length(head).alias("size"))
        return once(once(ends, overlap), lambda n: join(done, x, n))

    return F.aggregate(chunks, F.lit(""), add)


def _lowest(names: DataFrame) -> DataFrame:
    """(entry_id, root): the smallest id linked to each entry of ``names`` (entry_id, name).

    Labels go from entries to names and back, and then to the label's own label, until none changes: rounds grow with the logarithm
    of the longest chain. Names with many entries are summed up before they are shuffled.
    """
    labels = names.select("entry_id").distinct().withColumn("root", F.col("entry_id"))
    while True:
        least = names.join(labels, "entry_id").groupBy("name").agg(F.min("root").alias("root"))
        told = names.join(least, "name").groupBy("entry_id").agg(F.min("root").alias("new"))
        # An entry's old root learns of the new one too, and everything follows its root's root.
        lower = labels.join(told, "entry_id", "left").select("entry_id", "root", F.coalesce(F.least("root", "new"), "root").alias("new"))
        hooks = lower.groupBy(F.col("root").alias("entry_id")).agg(F.min("new").alias("hook"))
        hooked = cut(lower.join(hooks, "entry_id", "left").select("entry_id", F.col("root").alias("old"), F.least("new", F.coalesce("hook", "new")).alias("root")))
        roots = hooked.select(F.col("entry_id").alias("root"), F.col("root").alias("top"))
        moved = cut(hooked.join(roots, "root").select("entry_id", "old", F.col("top").alias("root")))
        labels = moved.select("entry_id", "root")
        if moved.filter("old <> root").isEmpty():
            return labels


def linked(names: DataFrame) -> DataFrame:
    """(entry_id, root) for each entry of ``names`` (entry_id, name) that shares a name with another: the smallest id linked to it by common names, directly or through others.

    A name that one entry has links nothing. An entry first takes the least of its names' smallest ids; only where these differ, which are links between such ids, are they followed round by round.
    """
    least = names.groupBy("name").agg(F.min("entry_id").alias("least"), F.max("entry_id").alias("most")).filter("least < most").select("name", "least")
    firsts = F.collect_set("least")
    held = cut(names.join(least, "name").groupBy("entry_id").agg(F.min("least").alias("root"), F.when(F.size(firsts) > 1, firsts).alias("firsts")))
    apart = held.filter("firsts IS NOT NULL").select("root", F.explode("firsts").alias("name"))
    links = cut(apart.select("name", F.explode(F.array("root", "name")).alias("entry_id")).distinct())
    if links.isEmpty():
        return held.select("entry_id", "root")
    further = _lowest(links).select(F.col("entry_id").alias("root"), F.col("root").alias("top"))
    return held.join(further, "root", "left").select("entry_id", F.coalesce("top", "root").alias("root"))


def least_linked(ids: DataFrame, names: DataFrame) -> DataFrame:
    """(entry_id, root) for each of ``ids``: the smallest id linked to it by common names in ``names`` (entry_id, name), directly or through others; its own, if nothing is."""
    return ids.join(linked(names), "entry_id", "left").select("entry_id", F.coalesce("root", "entry_id").alias("root"))


def merge_groups(entries: DataFrame) -> DataFrame:
    """(entry_id, root): entries that share a normalised term or alias, directly or through others; root is the smallest id.

    ``entries`` has entry_id, term, aliases.
    """
    names = cut(entries.select("entry_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("term"), "aliases"), normalize))).alias("name")).filter("name <> ''"))
    return least_linked(entries, names)


def arrival_groups(entries: DataFrame, existing: DataFrame | None = None, run: int = 4096) -> DataFrame:
    """(entry_id, root): what each entry is merged into when entries arrive in the order of their ids, whole numbers.

    An entry's names are its term and its aliases, normalised, in that order. It joins the entry that has the first of them that anyone has, and is one of
    its own if none is known; its names then belong to what it joined. So an entry that knows two others joins one and leaves them apart.
    ``existing`` entries stay as they are; of those with a name the smallest id has it. Blank names and null ids don't count; rows that repeat an id count as one entry.

    Whom a name belongs to is told by the last earlier entry that has it, which is found within runs of ids and then between runs, so that a
    frequent name is not one task's. Each entry thus points at one earlier entry, and pointers are followed in doubling steps.
    """
    named = lambda df: df.filter("entry_id IS NOT NULL").select(F.col("entry_id").cast("long").alias("entry_id"), F.posexplode(F.transform(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))), normalize)).alias("nth", "name")).filter("name <> ''")
    new = named(entries).groupBy("entry_id", "name").agg(F.min("nth").alias("nth")).withColumn("old", F.lit(False))
    rows = new
    if existing is not None:
        held = named(existing).groupBy("name").agg(F.min("entry_id").alias("entry_id"))
        rows = new.unionByName(held.select("entry_id", "name", F.lit(0).alias("nth"), F.lit(True).alias("old")))
    # Existing holders come before all that arrive.
    rows = cut(rows.withColumn("slice", F.when(F.col("old"), -1).otherwise(F.floor(F.col("entry_id") / run))))
    inner, outer = Window.partitionBy("name", "slice").orderBy("entry_id"), Window.partitionBy("name").orderBy("slice")
    slices = rows.groupBy("name", "slice").agg(F.max("entry_id").alias("last")).withColumn("earlier", F.lag("last").over(outer)).select("name", "slice", "earlier")
    told = rows.withColumn("nearest", F.lag("entry_id").over(inner)).join(slices, ["name", "slice"]).withColumn("before", F.coalesce("nearest", "earlier"))
    points = told.filter("NOT old AND before IS NOT NULL").groupBy("entry_id").agg(F.min_by("before", "nth").alias("root"))
    ids = entries.filter("entry_id IS NOT NULL").select(F.col("entry_id").cast("long").alias("entry_id")).distinct()
    pointers = cut(ids.join(points, "entry_id", "left").withColumn("root", F.coalesce("root", "entry_id")))
    while True:
        ahead = pointers.filter("entry_id <> root").select(F.col("entry_id").alias("root"), F.col("root").alias("further"))
        moved = cut(pointers.join(ahead, "root", "left").select("entry_id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        pointers = moved.select("entry_id", "root")
        if moved.filter("moved").isEmpty():
            return pointers


def merged_entries(entries: DataFrame, groups: DataFrame, most_aliases: int = 12, most_evidence: int = 10) -> DataFrame:
    """One entry for each root: the first term, the longest definition, distinct aliases and evidence by source and passage, capped."""
    rows = entries.join(groups, "entry_id")
    names = rows.select("root", "entry_id", F.posexplode(F.concat(F.array("term"), "aliases")).alias("nth", "name")).withColumn("key", normalize("name")).filter("key <> ''")
    firsts = names.groupBy("root", "key").agg(F.min(F.struct("entry_id", "nth", "name")).alias("f"))
    listed = firsts.groupBy("root").agg(F.array_sort(F.collect_list("f")).alias("names"))
    proofs = rows.select("root", "entry_id", F.posexplode("evidence").alias("nth", "passage_id")).groupBy("root", "passage_id").agg(F.min(F.struct("entry_id", "nth")).alias("f"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("f"))
    held = proofs.withColumn("place", place).filter(F.col("place") <= most_evidence).groupBy("root").agg(F.array_sort(F.collect_list("passage_id")).alias("evidence"))
    base = rows.groupBy("root").agg(F.min_by("term", "entry_id").alias("term"), F.max_by("definition", F.struct(F.length("definition"), -F.col("entry_id"))).alias("definition"), F.count("*").alias("merged"))
    aliases = F.slice(F.filter(F.transform("names", lambda x: x["name"]), lambda n: normalize(n) != normalize("term")), 1, most_aliases)
    return base.join(listed, "root").join(held, "root", "left").select("root", "term", "definition", "merged", aliases.alias("aliases"), F.coalesce("evidence", F.array().cast(held.schema["evidence"].dataType)).alias("evidence"))


def signature(corpus: DataFrame, group: str, order: str, columns: list[str], run: int = 4096) -> DataFrame:
    """(group, n, signature): a hash over the hashes of a group's rows, in order. Any change of a row, or of their order, changes it.

    ``order`` is a whole number. Rows are hashed by runs of ``run`` of its values, runs by runs of runs, so that no group is held in one place.
    """
    rows = corpus.select(group, F.col(order).cast("long").alias("at"), fnv1a(F.to_json(F.struct(*columns))).alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(3):
        listed = F.array_sort(F.collect_list(F.struct("at", "h")))
        rows = rows.groupBy(group, F.floor(F.col("at") / run).alias("part")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), "|"), 256).alias("h")).withColumnRenamed("part", "at")
    listed = F.array_sort(F.collect_list(F.struct("at", "h")))
    return rows.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), "|"), 256).alias("signature"))


def is_current(index: DataFrame, signatures: DataFrame, group: str, version: int = 3) -> DataFrame:
    """(group, current): whether a complete index of this version has the corpus's signature and has processed all of it."""
    met = signatures.select(group, F.col("signature").alias("_now")).join(index, group, "left")
    fine = (F.col("version") == version) & (F.col("status") == "complete") & (F.col("signature") == F.col("_now")) & (F.col("total_passages") == F.col("processed"))
    return met.select(group, F.coalesce(fine, F.lit(False)).alias("current"))


def dirty_closure(batches: DataFrame, entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """Passages that must be processed again: those of batches that hold an excluded passage, those that share an entry with one, and so on.

    ``batches`` (batch_id, passage_id), ``entries`` (entry_id, passage_id), ``excluded`` (passage_id). Passages that batches and entries link,
    through any number of others, have one label; all of a label that an excluded passage has are returned.
    """
    links = batches.select(F.concat(F.lit("b"), F.col("batch_id").cast("string")).alias("name"), F.col("passage_id").alias("entry_id")).unionByName(entries.select(F.concat(F.lit("e"), F.col("entry_id").cast("string")).alias("name"), F.col("passage_id").alias("entry_id"))).dropna()
    labels = linked(links).withColumnRenamed("entry_id", "passage_id")
    gone = excluded.select("passage_id").distinct()
    dirty = labels.join(labels.join(gone, "passage_id", "left_semi").select("root").distinct(), "root", "left_semi")
    return dirty.select("passage_id").join(gone, "passage_id", "left_anti")


def round_robin_turns(units: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Units with ``turn``, their place among those of the same ``by``, up to ``k``, and ``_first``, where the first of them stands."""
    of = Window.partitionBy(*by)
    return units.withColumn("turn", F.row_number().over(of.orderBy(order))).filter(F.col("turn") <= k).withColumn("_first", F.min(order).over(of))


def round_robin(units: DataFrame, source: str, order: str, k: int) -> DataFrame:
    """The first unit of each source, then the second of each, and so on, up to ``k``. Only ``k`` units of a source can count. A null source is one."""
    return round_robin_turns(units, [source], order, k).orderBy("turn", "_first").limit(k).drop("_first")


def within_budget(blocks: DataFrame, by: str, order: str, text: str, most: int, longest: int, least: int = 80) -> DataFrame:
    """Blocks in order up to ``most`` characters, each cut at ``longest``, the last cut to the rest; nothing under ``least`` is begun.

    Adds ``kept``, the text that goes in. A block that doesn't fit ends the list, and a cut one too.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sized = blocks.withColumn("_size", F.least(F.length(text), F.lit(longest)))
    sized = sized.withColumn("_left", most - F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return sized.filter(F.col("_left") >= least).withColumn("kept", F.left(F.col(text), F.least(F.col("_size"), F.col("_left")).cast("int"))).drop("_size", "_left")


def recent_messages(messages: DataFrame, by: str, order: str, *, n: int, latest: int, each: int, total: int) -> DataFrame:
    """The last ``n`` messages of each conversation in (by, order, kept): the newest first takes its share of ``total``, then the older ones.

    The newest keeps its last ``latest`` characters, older ones their last ``each``; blank ones don't count.
    """
    flat = messages.withColumn("_t", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("_t <> ''")
    back = Window.partitionBy(by).orderBy(F.col(order).desc())
    told = flat.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n)
    told = told.withColumn("_size", F.least(F.length("_t"), F.when(F.col("_n") == 1, latest).otherwise(each)))
    told = told.withColumn("_left", total - F.coalesce(F.sum("_size").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return told.filter("_left > 0").select(by, order, F.right("_t", F.least("_size", "_left").cast("int")).alias("kept"))
