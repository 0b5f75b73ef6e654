"""Documents as a whole: files put together from their parts, metadata with nested sections, publishing as a change of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 35 << 20
CHUNK_BYTES = 2 << 20
SECTIONS_AT_ONCE = 10_000

#: The nested shape of a document's metadata, which the JSON reader and the pack sink share.
SECTION = "id: string, title: string, path: array<string>, level: int, page_start: long, page_end: long, role: string, scope: string, priority: string, confidence: double"
DOCUMENT_META = f"document_id string, part int, title string, source_name string, format string, document_type string, priority string, pages long, section_count long, low_confidence long, sections array<struct<{SECTION}>>"


def assembled(manifests: DataFrame, parts: DataFrame, *, most_bytes: int = MOST_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(upload_id, verdict, content): files of ``parts`` (upload_id, part_no, content) put together in order, as ``manifests`` (upload_id, file_size, chunk_count, sha256) say.

    ``empty`` and ``too_large`` files, and such whose ``count`` of parts doesn't go with their size, are refused before a part is read, so no more than ``most_bytes`` of a file meet. Then
    parts that are ``missing`` or of the wrong ``size``, that came twice with other bytes (``doubled``) or don't belong to the file (``extra``), and a ``digest`` that differs. A refused
    file has no content. A part that came twice alike counts once; a null digest is not compared. Of several manifests of an upload the one with the least size counts.
    """
    listed = manifests.filter("upload_id IS NOT NULL").groupBy("upload_id").agg(F.min(F.struct("file_size", "chunk_count", "sha256")).alias("m")).select("upload_id", "m.*")
    size = F.coalesce("file_size", F.lit(0))
    first = F.when(size <= 0, "empty").when(size > most_bytes, "too_large").when(~F.coalesce(F.col("chunk_count") == F.ceil(size / chunk_bytes), F.lit(False)), "count")
    judged = listed.withColumn("refused", first)
    open_files = judged.filter("refused IS NULL").select("upload_id", "file_size", "chunk_count")
    met = parts.filter("content IS NOT NULL").join(open_files, "upload_id")
    wanted = F.least(F.lit(chunk_bytes), F.col("file_size") - F.col("part_no") * chunk_bytes)
    belongs = F.coalesce(F.col("part_no").between(0, F.col("chunk_count") - 1), F.lit(False))
    fits = F.octet_length("content") == wanted
    # Parts are judged by their digests first; bytes meet only where all is well, which bounds them.
    each = met.select("upload_id", "part_no", belongs.alias("belongs"), fits.alias("fits"), F.sha2("content", 256).alias("hash"))
    by_part = each.groupBy("upload_id", "part_no").agg(F.min("belongs").alias("belongs"), F.min("fits").alias("fits"), F.countDistinct("hash").alias("kinds"))
    sums = by_part.groupBy("upload_id").agg(F.count_if("belongs").alias("there"), F.bool_and("belongs").alias("own"), F.bool_and(F.col("fits") | ~F.col("belongs")).alias("fit"), F.max("kinds").alias("kinds"))
    known = judged.join(sums, "upload_id", "left")
    second = F.when(~F.coalesce("own", F.lit(True)), "extra").when(F.col("kinds") > 1, "doubled").when(F.coalesce("there", F.lit(0)) < F.col("chunk_count"), "missing").when(~F.col("fit"), "size")
    known = known.withColumn("refused", F.coalesce("refused", second))
    whole = met.join(known.filter("refused IS NULL").select("upload_id"), "upload_id", "left_semi").groupBy("upload_id", "part_no").agg(F.first("content").alias("content"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part_no", F.hex("content").alias("bytes")))), lambda p: p["bytes"])
    files = whole.groupBy("upload_id").agg(F.unhex(F.array_join(pieces, "")).alias("content"))
    done = known.join(files, "upload_id", "left")
    verdict = F.coalesce("refused", F.when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.sha2("content", 256)), "digest"), F.lit("stored"))
    return done.select("upload_id", verdict.alias("verdict"), F.when(verdict == "stored", F.col("content")).alias("content"))


def documents_meta(documents: DataFrame, sections: DataFrame, *, at_once: int = SECTIONS_AT_ONCE) -> DataFrame:
    """Metadata of documents in the shape of ``DOCUMENT_META``: sections in order, ``at_once`` of them in a row, further ones in rows of the same document with the next ``part``.

    ``documents``: document_id, source_name, format, document_type, priority, pages. ``sections``: document_id, position, and those of a section. The title is the source's name without
    its ending, "Material" if there is none; kinds and priorities that aren't known become apunte and normal, levels under 1 or null 1, a null confidence 0.5, a null scope included. Documents without sections
    have one part with none; sections of no document have no row. Repeated documents count once, the least row of them.
    """
    once = documents.groupBy("document_id").agg(F.min(F.struct("source_name", "format", "document_type", "priority", "pages")).alias("d")).select("document_id", "d.*")
    known = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(other)
    name = F.coalesce("source_name", F.lit(""))
    heads = once.select(
        "document_id", F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("")), F.lit("Material")).alias("title"), name.alias("source_name"), F.coalesce("format", F.lit("")).alias("format"),
        known("document_type", ("libro", "articulo", "compilacion", "apunte"), "apunte").alias("document_type"), known("priority", ("central", "normal", "context"), "normal").alias("priority"), F.col("pages").cast("long").alias("pages"),
    )
    confidence = F.coalesce("confidence", F.lit(0.5)).cast("double")
    section = F.struct(
        F.col("id").cast("string").alias("id"), F.coalesce("title", F.lit("Material")).alias("title"), F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.greatest(F.lit(1), F.coalesce("level", F.lit(1))).cast("int").alias("level"),
        F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), F.col("role"), F.coalesce("scope", F.lit("included")).alias("scope"), known("priority", ("central", "normal", "context"), "normal").alias("priority"), confidence.alias("confidence"),
    )
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("position", "id")) - 1
    placed = sections.select("document_id", nth.alias("nth"), section.alias("section"), (confidence < 0.62).alias("low"))
    rows = placed.groupBy("document_id", F.floor(F.col("nth") / at_once).cast("int").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "section"))), lambda x: x["section"]).alias("sections"))
    counts = placed.groupBy("document_id").agg(F.count("*").alias("section_count"), F.count_if("low").alias("low_confidence"))
    met = heads.join(counts, "document_id", "left").join(rows, "document_id", "left")
    zero = F.lit(0)
    none = F.array().cast(rows.schema["sections"].dataType)
    return met.select("document_id", F.coalesce("part", zero).cast("int").alias("part"), "title", "source_name", "format", "document_type", "priority", "pages", F.coalesce("section_count", zero.cast("long")).alias("section_count"), F.coalesce("low_confidence", zero.cast("long")).alias("low_confidence"), F.coalesce("sections", none).alias("sections"))


def published(courses: DataFrame, requests: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(courses, outcomes): ``courses`` (course_id, status, version, ...) after the requests to publish (course_id, expected, request_id, at), and (request_id, outcome) of each.

    A request is ``published`` if it is the first of its course, by time and id, that knows the stored version and the course has no row in ``errors``; the version then goes up by one
    and the status is published. Others are ``unknown``, ``conflict`` or ``invalid``; later ones that knew the version before are conflicts, as it has moved.
    """
    bad = errors.select("course_id").distinct().withColumn("bad", F.lit(True))
    met = requests.join(courses.select("course_id", "version").groupBy("course_id").agg(F.max("version").alias("version")), "course_id", "left").join(bad, "course_id", "left")
    fits = F.coalesce(F.col("expected") == F.col("version"), F.lit(False)) & F.col("bad").isNull()
    # Of those that fit only the first can go through, so the least is enough and no course's requests are sorted.
    first = met.filter(fits).groupBy("course_id").agg(F.min(F.struct("at", "request_id")).alias("first"))
    told = met.join(first, "course_id", "left")
    went = fits & (F.struct("at", "request_id") == F.col("first"))
    after = F.when(F.col("version").isNull(), "unknown").when(F.coalesce(went, F.lit(False)), "published").when(~F.coalesce(F.col("expected") == F.col("version"), F.lit(False)), "conflict").when(F.col("bad"), "invalid").otherwise("conflict")
    moved = courses.join(first.select("course_id").withColumn("_went", F.lit(True)), "course_id", "left")
    went_up = F.coalesce("_went", F.lit(False))
    changed = moved.withColumns({"status": F.when(went_up, "published").otherwise(F.col("status")), "version": F.when(went_up, F.col("version") + 1).otherwise(F.col("version"))})
    return changed.select(*courses.columns), told.select("request_id", after.alias("outcome"))
