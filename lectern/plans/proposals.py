"""A proposal of outside analysis merged into a course: what is new is added under ids of its own, what is there is only completed.

Titles are compared as slugs. Of the course: ``units`` (id, title, prerequisites), ``concepts`` (id, title, source_ids, reference_ids, criteria), ``examples`` and
``activities`` (id, title), ``modes`` (place, id, strategy), ``corpus`` and ``bibliography`` (id), ``sequence`` (pos, unit_id). Of the proposal, all with place, the order in
which it came: ``units`` (title, priority, step, prerequisite_titles, concept_titles, source_ids), ``concepts`` (title, source_ids, reference_ids, criteria), ``examples`` (title, concept_titles,
source_ids), ``activities`` (title, strategy). Lists are arrays; null ones are empty. Blank titles are passed over, and of several alike the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import slug
from lectern.operators.assembly import ordered_union
from lectern.operators.maintenance import unique_slugs

KEY = 64
NONE = "array<string>"


def key_of(title: Column | str) -> Column:
    return slug(title, KEY, "")


def filled(column: str) -> Column:
    """A list without null and blank entries."""
    return F.filter(F.coalesce(column, F.array().cast(NONE)), lambda x: F.coalesce(x, F.lit("")) != "")


def known_only(rows: DataFrame, key: str, column: str, known: DataFrame, value: str, name: str = "") -> DataFrame:
    """``rows`` with the entries of ``column``, in their order, that ``known`` has as ``value``, or with the ids in ``name`` that these stand for."""
    told = known.select(F.col(value).alias("_v"), F.col(name or value).alias("_id")).filter("_v <> ''").groupBy("_v").agg(F.min("_id").alias("_id"))
    spread = rows.select(key, F.posexplode(filled(column)).alias("_nth", "_v"))
    spread = (spread.withColumn("_v", key_of("_v")) if name else spread).join(told, "_v")
    kept = spread.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_id"))), lambda x: x["_id"]).alias("_kept"))
    return rows.drop(column).join(kept, key, "left").withColumn(column, F.coalesce("_kept", F.array().cast(NONE))).drop("_kept")


def fresh(existing: DataFrame, proposed: DataFrame, prefix: str, default: str) -> DataFrame:
    """The proposed rows whose title no existing row has, one for each title, with an id of the prefix and the title that is not taken."""
    keyed = proposed.withColumn("_key", key_of("title")).filter(F.trim(F.coalesce("title", F.lit(""))) != "")
    firsts = keyed.groupBy("_key").agg(F.min("place").alias("place"))
    new = keyed.join(firsts, ["_key", "place"]).join(existing.select(key_of("title").alias("_key")).distinct(), "_key", "left_anti")
    named = new.withColumn("_name", F.concat(F.lit(prefix), F.when(F.col("_key") == "", default).otherwise(F.col("_key"))))
    used = existing.select(F.col("id").alias("slug"))
    return unique_slugs(named, "_name", "place", size=KEY + len(prefix), used=used).withColumnRenamed("slug", "id").drop("_name", "_key")


def merge_proposal(course: dict[str, DataFrame], proposal: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The course's units, concepts, examples, activities and sequence (place, unit_id) with the proposal's. New rows are suggested; new units wait for review."""
    given, told = course, proposal
    lists = {"source_ids": ("corpus", 1 << 30), "reference_ids": ("bibliography", 8)}

    offers = told["concepts"].withColumn("criteria", F.slice(filled("criteria"), 1, 5))
    for column, (table, most) in lists.items():
        offers = known_only(offers, "place", column, given[table], "id").withColumn(column, F.slice(column, 1, most))
    new_concepts = fresh(given["concepts"], offers, "", "concepto").select("id", "title", *lists, "criteria", F.lit(True).alias("suggested"))
    # An existing concept is completed, list by list, by the first proposal that has something for it.
    keyed = offers.withColumn("_key", key_of("title"))
    firsts = keyed.groupBy("_key").agg(*(F.min_by(F.when(F.size(c) > 0, F.col(c)), F.when(F.size(c) > 0, F.col("place"))).alias(f"_{c}") for c in (*lists, "criteria")))
    old = given["concepts"].withColumn("_key", key_of("title")).join(firsts, "_key", "left")
    concepts = old.select("id", "title", *(F.when(F.size(filled(c)) > 0, F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.array().cast(NONE))).alias(c) for c in (*lists, "criteria")), F.lit(False).alias("suggested")).unionByName(new_concepts)
    by_title = concepts.select(key_of("title").alias("_t"), "id")

    new_units = fresh(given["units"], told["units"], "unidad-", "item")
    new_units = known_only(new_units, "id", "source_ids", given["corpus"], "id").withColumns({
        "priority": F.when(F.col("priority").isin("central", "normal", "context"), F.col("priority")).otherwise("normal"), "step": F.coalesce("step", F.lit(999)),
        "prerequisite_titles": F.slice(filled("prerequisite_titles"), 1, 5), "concept_titles": F.slice(filled("concept_titles"), 1, 8),
    })
    all_units = given["units"].select("id", "title").unionByName(new_units.select("id", "title"))
    needs = known_only(new_units.select("id", F.col("prerequisite_titles").alias("prerequisites")), "id", "prerequisites", all_units.select(key_of("title").alias("_t"), "id"), "_t", "id")
    units = given["units"].select("id", "title", filled("prerequisites").alias("prerequisites"), F.lit(None).cast("string").alias("priority"), F.array().cast(NONE).alias("source_ids"), F.array().cast(NONE).alias("concept_titles"), F.lit(False).alias("suggested"))
    units = units.unionByName(new_units.drop("prerequisites").join(needs, "id").select("id", "title", "prerequisites", "priority", "source_ids", "concept_titles", F.lit(True).alias("suggested")))
    units = known_only(units, "id", "prerequisites", all_units, "id").withColumn("prerequisites", F.array_distinct(F.filter("prerequisites", lambda x: x != F.col("id"))))
    units = known_only(units.withColumnRenamed("concept_titles", "concept_ids"), "id", "concept_ids", by_title, "_t", "id").withColumn("concept_ids", F.array_distinct("concept_ids"))
    units = units.withColumn("review_status", F.when(F.col("suggested"), "pending"))

    examples = known_only(fresh(given["examples"], told["examples"], "ejemplo-", "item").withColumnRenamed("concept_titles", "concept_ids"), "id", "concept_ids", by_title, "_t", "id")
    examples = known_only(examples, "id", "source_ids", given["corpus"], "id").select("id", "title", "concept_ids", "source_ids", F.lit(True).alias("suggested"))
    none = F.array().cast(NONE)
    examples = given["examples"].select("id", "title", none.alias("concept_ids"), none.alias("source_ids"), F.lit(False).alias("suggested")).unionByName(examples)

    by_strategy = given["modes"].groupBy("strategy").agg(F.min_by("id", "place").alias("mode_id"))
    default = given["modes"].agg(F.min_by("id", "place").alias("_first"))
    activities = fresh(given["activities"], told["activities"], "actividad-", "item").withColumn("strategy", F.coalesce("strategy", F.lit("retrieve"))).join(by_strategy, "strategy", "left").join(F.broadcast(default))
    activities = activities.select("id", "title", F.coalesce("mode_id", "_first", F.lit("")).alias("mode_id"), F.lit(True).alias("suggested"))
    activities = given["activities"].select("id", "title", F.lit(None).cast("string").alias("mode_id"), F.lit(False).alias("suggested")).unionByName(activities)

    known = given["sequence"].join(given["units"].select(F.col("id").alias("unit_id")).distinct(), "unit_id", "left_semi")
    steps = new_units.select(F.col("id").alias("unit_id"), (F.col("step").cast("long") * (1 << 32) + F.col("place")).alias("pos"))
    rest = given["units"].select(F.col("id").alias("unit_id"), F.lit(0).alias("pos"))
    order = ordered_union([known.select("unit_id", "pos"), steps, rest], "unit_id").select("unit_id", F.struct("list", "pos", "unit_id").alias("place"))
    return {"units": units, "concepts": concepts, "examples": examples, "activities": activities, "sequence": order}
