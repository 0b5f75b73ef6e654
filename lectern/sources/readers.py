"""Readers of course material and of logs, with explicit schemas, into the tables that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import digits_only, fold, split_list
from lectern.operators.analytics import clamp_level

VERSIONS = ("1.0", "1.1")
TEXTS = "array<string>"
CHUNK = f"id string, title string, chapter string, sectionPath {TEXTS}, content string, summary string, explanation string, source string, scope string, priority string, role string, aliases {TEXTS}, keywords {TEXTS}, bibliographyId string"
COURSE = (
    "id string, title string, author string",
    "id string, title string, author string, publisher string, year string, role string",
    "id string, title string, sourceName string, pages int, priority string, documentType string",
    f"id string, title string, aliases {TEXTS}, keywords {TEXTS}, summary string, sourceCorpusIds {TEXTS}, sourceBibliographyIds {TEXTS}",
    "id string, title string, strategy string, pedagogicalGoal string",
    "id string, title string, mode string, conceptIds array<string>",
    "id string, title string, conceptId string",
)
PACK = "format string, version string, course struct<{}>, bibliography array<struct<{}>>, documents array<struct<{}>>, concepts array<struct<{}>>, modes array<struct<{}>>, activities array<struct<{}>>, examples array<struct<{}>>".format(*COURSE) + f", corpus array<struct<{CHUNK}>>"
COLLECTIONS = ("bibliography", "documents", "concepts", "modes", "activities", "examples", "corpus")
REQUIRED_FILES = ("course", "bibliography", "concepts", "modes", "activities", "examples", "corpus")


def resolve(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by the first of several header names that is there, without regard to case, accents and blanks at the ends; null if none is."""
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.strip().lower()) if not unicodedata.combining(c))
    found = {plain(c): c for c in reversed(df.columns)}
    picked = {name: next((found[plain(x)] for x in choices if plain(x) in found), None) for name, choices in names.items()}
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in picked.items()))


def read_packs(spark: SparkSession, path: str, packs_format: str) -> DataFrame:
    """Course packs, one for each JSON file, with ``path``: those of the right format and a known version; missing collections are empty."""
    packs = spark.read.schema(PACK).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    kept = packs.filter((F.col("format") == packs_format) & F.col("version").isin(*VERSIONS))
    return kept.withColumns({c: F.coalesce(c, F.array().cast(packs.schema[c].dataType)) for c in COLLECTIONS})


def pack_table(packs: DataFrame, collection: str) -> DataFrame:
    """(course_id, pos, ...) of one collection."""
    rows = packs.select(F.col("course.id").alias("course_id"), F.posexplode(collection).alias("pos", "x"))
    return rows.select("course_id", "pos", *(F.col(f"x.{f.name}").alias(f.name) for f in rows.schema["x"].dataType.fields))


def complete_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders below ``path`` that hold a file of each required kind and don't begin with an underscore, by their files' names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path).select("path")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.json$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("file"))
    have = named.filter(~F.startswith("folder", F.lit("_"))).groupBy("folder").agg(F.collect_set("file").alias("files"))
    return have.filter(F.size(F.array_except(F.array(*(F.lit(x) for x in REQUIRED_FILES)), F.col("files"))) == 0).select("folder")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text) of text, Markdown, HTML and JSON files, whole; other kinds are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).withColumn("path", F.input_file_name())
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = {"txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "json": "json"}
    return files.select("path", F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[kind].alias("kind"), F.col("value").alias("text")).filter("kind IS NOT NULL")


def json_material(texts: DataFrame) -> DataFrame:
    """(path, pos, id, title, content) from JSON texts of several shapes: an array of chunks, one with a corpus, or one chunk.

    Items without content are dropped; missing ids and titles are made from the position.
    """
    chunk = f"struct<id: string, title: string, content: string, text: string, source: string>"
    body = F.trim(F.regexp_replace("text", r"^﻿|^\s*```(json)?|```\s*$", ""))
    listed = F.from_json(body, f"array<{chunk}>")
    single = F.from_json(body, f"struct<corpus: array<{chunk}>, id: string, title: string, content: string, text: string, source: string>")
    items = F.when(F.startswith(body, F.lit("[")), listed).when(single["corpus"].isNotNull(), single["corpus"]).otherwise(F.array(F.struct(*(single[c].alias(c) for c in ("id", "title", "content", "text", "source")))))
    rows = texts.select("path", F.posexplode(items).alias("pos", "x"))
    content = F.coalesce(F.nullif(F.trim("x.content"), F.lit("")), F.trim("x.text"))
    named = F.concat(F.lit("fragmento-"), (F.col("pos") + 1).cast("string"))
    return rows.select("path", "pos", F.coalesce(F.nullif("x.id", F.lit("")), named).alias("id"), F.coalesce(F.nullif("x.title", F.lit("")), F.concat(F.lit("Fragmento "), (F.col("pos") + 1).cast("string"))).alias("title"), content.alias("content"), "x.source").filter("content <> ''")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words, from rows (page, level, block, par, line, word, left, top, width, height, conf, text).

    Words are at level 5; a line has their text in order, their box, and the mean of the confidences that aren't negative.
    """
    kept = words.filter((F.col("level") == 5) & (F.trim("text") != "") & F.col("left").isNotNull() & F.col("top").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
    return kept.groupBy("page", "block", "par", "line").agg(
        text.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("confidence"),
    )


def is_yes(value: Column | str) -> Column:
    return F.trim(fold(value)).isin("si", "1", "true", "yes")


def roster(sheet: DataFrame) -> DataFrame:
    """(dni, name, commission, active) of a sheet with headers; rows without digits in the id are left out, active is the default."""
    rows = resolve(sheet, {"dni": ("DNI", "ID/DNI", "ID"), "last": ("Apellido",), "first": ("Nombre", "Nombres"), "commission": ("Comisión", "Comision"), "active": ("Activo",)})
    dni = digits_only("dni")
    name = F.concat_ws(", ", F.nullif(F.trim("last"), F.lit("")), F.nullif(F.trim("first"), F.lit("")))
    return rows.select(dni.alias("dni"), F.coalesce(F.nullif(name, F.lit("")), dni).alias("name"), F.coalesce(F.trim("commission"), F.lit("")).alias("commission"), F.when(F.coalesce(F.trim("active"), F.lit("")) == "", True).otherwise(is_yes("active")).alias("active")).filter("dni <> ''")


def interactions(sheet: DataFrame) -> DataFrame:
    """The log's rows as a table: lists split, levels clamped, times read from day and hour; rows without an id are left out."""
    names = {
        "fecha": ("Fecha",), "hora": ("Hora",), "sid": ("SID",), "dni": ("DNI", "ID/DNI"), "name": ("Nombre y Apellido",), "commission": ("Comisión",), "mode": ("Modo",),
        "concept_ids": ("Concepto IDs",), "concepts": ("Conceptos",), "sources": ("Fuentes",), "level": ("Nivel confusión",), "question": ("Pregunta",), "response": ("Respuesta",), "model": ("Modelo",),
    }
    rows = resolve(sheet, names)
    ts = F.try_to_timestamp(F.concat_ws(" ", F.trim("fecha"), F.coalesce(F.nullif(F.trim("hora"), F.lit("")), F.lit("00:00"))), F.lit("dd/MM/yyyy HH:mm"))
    return rows.select(
        digits_only("dni").alias("dni"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("commission", F.lit("")).alias("commission"), ts.alias("ts"), F.coalesce("sid", F.lit("")).alias("sid"), F.coalesce("mode", F.lit("")).alias("mode"),
        split_list("concept_ids", "|").alias("concept_ids"), split_list("concepts", ";").alias("concepts"), split_list("sources", ";").alias("sources"),
        clamp_level(F.col("level")).alias("level"), "question", "response", "model",
    ).filter("dni <> ''")


def model_json(raw: Column | str) -> Column:
    """The JSON text within a model's answer: without fences, from the first to the last brace; null if that isn't JSON."""
    body = F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, r"```(json)?", "")
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)


def published(courses: DataFrame, reference: str) -> DataFrame:
    """The published course that an id or a public name means."""
    return courses.filter(((F.col("id") == reference) | (F.col("slug") == reference)) & (F.col("status") == "published")).orderBy("pos").limit(1)
