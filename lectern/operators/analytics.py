"""Views of learner activity: by student, concept, commission and mode, and the summary of a course.

Interactions have: dni, ts, sid, mode, concept_ids (array), level (0 to 2), commission. Rosters have: dni, name, commission. The clock is
a parameter wherever one is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import CONFUSION, CONFUSION_LABELS, CONFUSION_PARTS, MODE_LABELS, USAGE_LEVELS
from lectern.functions.text import fold, squeeze
from lectern.operators.retrieval import longest_word, texts_with, words_around


def clamp_level(value: Column) -> Column:
    """A confusion level of 0 to 2; what is no number counts as 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), F.floor(number + 0.5).cast("int"))))


def confusion_label(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in CONFUSION_LABELS)), level + 1)


def shows_confusion(text: Column | str) -> Column:
    return F.trim(fold(text)).rlike(CONFUSION)


def shows_confusion_broad(text: Column | str) -> Column:
    """The wider test: any of a list of parts."""
    body = fold(text)
    found = F.lit(False)
    for part in CONFUSION_PARTS:
        found = found | F.contains(body, F.lit(part))
    return found


def mode_label(mode: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in MODE_LABELS.items() for x in pair))[mode], F.lit("Consulta"))


def written_level(level: Column, question: Column, concept_ids: Column) -> Column:
    """The level as it is logged: 0 becomes 1 if the question shows confusion and names a known concept."""
    clamped = clamp_level(level)
    return F.when((clamped == 0) & shows_confusion(question) & (F.size(concept_ids) > 0), 1).otherwise(clamped)


def student_stats(interactions: DataFrame) -> DataFrame:
    """Counts, distinct sessions, modes and concepts, and first and last times of each student."""
    concepts = interactions.select("dni", F.explode("concept_ids").alias("c")).groupBy("dni").agg(F.countDistinct("c").alias("concepts"))
    stats = interactions.groupBy("dni").agg(
        F.count("*").alias("interactions"), F.countDistinct(F.nullif("sid", F.lit(""))).alias("sessions"), F.countDistinct(F.nullif("mode", F.lit(""))).alias("modes"),
        F.count_if(F.col("level") >= 1).alias("possible_confusion"), F.count_if(F.col("level") >= 2).alias("repeated_confusion"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return stats.join(concepts, "dni", "left").withColumn("concepts", F.coalesce("concepts", F.lit(0)))


def student_status(roster: DataFrame, stats: DataFrame) -> DataFrame:
    """Every student of the roster or of the log, with zeros for those without events and a name for those not enrolled."""
    joined = roster.select("dni", "name", "commission", F.lit(True).alias("enrolled")).join(stats, "dni", "full_outer")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("interactions", "sessions", "modes", "concepts", "possible_confusion", "repeated_confusion")}
    return joined.withColumns(counts).select(
        "dni", F.coalesce("name", F.col("dni").cast("string")).alias("name"), F.coalesce("commission", F.lit("")).alias("commission"), F.coalesce("enrolled", F.lit(False)).alias("enrolled"),
        *counts, F.when(F.col("interactions") > 0, "Activo").otherwise("Sin actividad").alias("status"), "last_ts",
    )


def concept_stats(concepts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Every concept (concept_id, title) with its use; unknown ids in the log count for nothing."""
    told = interactions.select("dni", "level", "ts", F.explode("concept_ids").alias("concept_id"))
    used = told.groupBy("concept_id").agg(
        F.count("*").alias("interactions"), F.countDistinct("dni").alias("students"),
        F.count_if(F.col("level") >= 1).alias("possible_confusion"), F.count_if(F.col("level") >= 2).alias("repeated_confusion"), F.max("ts").alias("last_ts"),
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("interactions", "students", "possible_confusion", "repeated_confusion")}
    joined = concepts.join(used, "concept_id", "left").withColumns(counts)
    return joined.withColumn("confusion_ratio", F.when(F.col("interactions") > 0, F.col("possible_confusion") / F.col("interactions")).otherwise(0.0))


def concept_sources(links: DataFrame, bibliography: DataFrame) -> DataFrame:
    """(concept_id, n_sources, sources): the references of each concept as one text, by reference id. ``links``: concept_id, ref_id."""
    shown = bibliography.select("ref_id", F.concat_ws(" · ", F.nullif("title", F.lit("")), F.nullif("author", F.lit(""))).alias("shown"))
    rows = links.select("concept_id", "ref_id").distinct().join(shown, "ref_id")
    return rows.groupBy("concept_id").agg(F.count("*").alias("n_sources"), F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "shown"))), lambda s: s["shown"])).alias("sources"))


def commission_match(value: Column, code: Column, title: Column) -> Column:
    """Whether a free commission text means a declared commission."""
    text, c, t = F.trim(fold(value)), F.trim(fold(code)), F.trim(fold(title))
    full = F.concat(F.lit("comision "), F.when(c != "", c).otherwise(t))
    return (text != "") & ((text == c) | (text == t) | (text == full) | ((c != "") & F.contains(text, c) & F.contains(text, F.lit("comision"))) | ((t != "") & F.contains(text, t)))


def _held(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(value, name): the distinct ``names`` (name) that stand in the ``text`` of a value, by the words around their longest word; blank names stand nowhere."""
    named = names.filter(F.trim("name") != "").select("name").distinct().withColumn("part", longest_word("name"))
    words = texts.select("value", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    around = words_around(words.select("word").distinct(), named.select("part"))
    return words.join(around, "word").join(named, "part").filter(F.contains("text", F.col("name"))).select("value", "name").distinct()


def commission_groups(values: DataFrame, commissions: DataFrame) -> DataFrame:
    """(value, commission_id): what each distinct free text stands for; several commissions, or itself if none matches. Blank texts stand for nothing.

    A text that means a commission holds its code or its title, so these are looked for first.
    """
    distinct = values.select("value").filter(F.trim("value") != "").distinct().withColumn("text", F.trim(fold("value")))
    named = commissions.select("commission_id", "code", "title", F.explode(F.array(F.trim(fold("code")), F.trim(fold("title")))).alias("name"))
    met = _held(distinct, named).join(named, "name").select("value", "commission_id", "code", "title").distinct()
    declared = met.filter(commission_match(F.col("value"), F.col("code"), F.col("title"))).select("value", "commission_id").distinct()
    extra = distinct.select("value").join(declared.select("value").distinct(), "value", "left_anti").select("value", F.concat(F.lit("extra:"), "value").alias("commission_id"))
    return declared.unionByName(extra)


def commission_stats(groups: DataFrame, commissions: DataFrame, roster: DataFrame, interactions: DataFrame) -> DataFrame:
    """Students, active students, interactions and confusion of each commission, undeclared ones too.

    Rows are counted by commission text before texts are matched, so the match multiplies counts, not rows.
    """
    active = interactions.select("dni").distinct().withColumn("active", F.lit(1))
    enrolled = roster.join(active, "dni", "left").groupBy(F.col("commission").alias("value")).agg(F.count("*").alias("students"), F.count("active").alias("active_students"))
    logged = interactions.groupBy(F.col("commission").alias("value")).agg(F.count("*").alias("interactions"), F.count_if(F.col("level") >= 1).alias("confusion"))
    by_text = groups.join(enrolled, "value", "left").join(logged, "value", "left")
    names = ("students", "active_students", "interactions", "confusion")
    found = by_text.groupBy("commission_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    keys = commissions.select("commission_id").unionByName(groups.select("commission_id")).distinct()
    return keys.join(found, "commission_id", "left").select("commission_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def first_commission(values: DataFrame, commissions: DataFrame) -> DataFrame:
    """(value, commission_id): the exact commission, else the first declared one whose day the text holds. ``commissions``: day, nth. A blank day names nothing."""
    distinct = values.select("value").distinct()
    exact = distinct.join(commissions.select(F.col("title").alias("value"), "commission_id", "nth"), "value").withColumn("other", F.lit(False))
    days = commissions.select("commission_id", "nth", fold("day").alias("name"))
    by_day = _held(distinct.withColumn("text", fold("value")), days).join(days, "name").select("value", "commission_id", "nth", F.lit(True).alias("other"))
    best = exact.select("value", "commission_id", "nth", "other").unionByName(by_day).groupBy("value").agg(F.min_by("commission_id", F.struct("other", "nth")).alias("commission_id"))
    return distinct.join(best, "value", "left")


def mode_share(interactions: DataFrame) -> DataFrame:
    """Interactions by mode and their share; a blank mode is named."""
    counted = interactions.groupBy(F.coalesce(F.nullif("mode", F.lit("")), F.lit("Sin modo")).alias("mode")).agg(F.count("*").alias("interactions"))
    return counted.withColumn("share", F.col("interactions") / F.sum("interactions").over(Window.partitionBy(F.lit(0))))  # one row for each mode


def summary(roster: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row for the course: enrolled, active and inactive students, interactions, their mean, confusions, last time."""
    told = interactions.agg(F.count("*").alias("interactions"), F.countDistinct("dni").alias("active"), F.count_if(F.col("level") >= 1).alias("confusions"), F.max("ts").alias("last_ts"))
    students = roster.agg(F.count("*").alias("students"))
    return students.join(told).select("students", "active", F.greatest(F.lit(0), F.col("students") - F.col("active")).alias("inactive"), "interactions", F.when(F.col("active") > 0, F.col("interactions") / F.col("active")).otherwise(0.0).alias("mean_interactions"), "confusions", "last_ts")


def top_concepts(stats: DataFrame, k: int = 12, by: str = "interactions") -> DataFrame:
    """The ``k`` most used concepts, or the ``k`` that confuse most (of those that confuse at all)."""
    keys = ["interactions", "possible_confusion"] if by == "interactions" else ["possible_confusion", "interactions"]
    kept = stats if by == "interactions" else stats.filter("possible_confusion > 0")
    return kept.orderBy(*(F.desc(c) for c in keys), "concept_id").limit(k)


def last_hours(interactions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return interactions.filter(F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def usage_level(total: Column, confusions: Column) -> Column:
    none, first, trouble, active, far = (F.lit(x) for x in USAGE_LEVELS)
    return F.when(total == 0, none).when(total < 3, first).when(confusions / total > 0.35, trouble).when(total < 8, active).otherwise(far)


def usage_note(total: Column, confusions: Column, concepts: Column) -> Column:
    ratio = confusions / total
    notes = F.array(
        F.when(ratio > 0.5, "⚠ Confusión frecuente — intervención recomendada").when(ratio > 0.35, "Señales de dificultad conceptual"),
        F.when(concepts >= 8, F.concat(F.lit("Amplia exploración: "), concepts.cast("string"), F.lit(" conceptos distintos"))),
        F.when((concepts <= 2) & (total >= 5), "Consultas repetitivas — poca variedad conceptual"),
        F.when(total >= 15, "Alta participación"),
        F.when(total == 1, "Una sola consulta"),
    )
    listed = F.array_join(F.filter(notes, lambda n: n.isNotNull()), " · ")
    return F.when(total == 0, "No ha usado el bot aún.").when(listed == "", "Uso normal").otherwise(listed)


def usage_rank(level: Column) -> Column:
    """Order of usage levels; unknown ones come last."""
    place = F.array_position(F.array(*(F.lit(x) for x in USAGE_LEVELS)), level)
    return F.when(place > 0, place - 1).otherwise(5)


def named_concepts(texts: DataFrame, names: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, concept): the names that stand in each text, compared folded; blank names and null texts give nothing.

    Repeated names count once, rows of ``texts`` each for itself. Texts stay where they are; names are sent to them.
    """
    named = names.select(squeeze("name").alias("phrase")).filter("phrase <> ''").distinct().withColumn("key", F.lit(0))
    bodies = texts.select(key, squeeze(text).alias("body"))
    return texts_with(bodies, [key], named, F.split("body", " "), lambda p: F.contains("body", p)).select(key, F.col("phrase").alias("concept"))
