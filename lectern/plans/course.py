"""Whole paths through the operators: retrieval for questions, texts to sections, the log's views, a course's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, section_id, shorten
from lectern.operators import contracts, passages, retrieval, structure
from lectern.operators.knowledge import cut, recent_messages, within_budget

LIMITS = {"knowledge": 4, "concepts": 3, "corpus": 4}
SOCRATIC = {"concepts": 2, "corpus": 3}
BUDGETS = {"knowledge": (3800, 950), "concepts": (1350, 450), "corpus": (3000, 850)}


def passages_of(corpus: DataFrame) -> DataFrame:
    """Items of which long ones became several, which keep their id; ``pos`` orders items, then parts."""
    items = retrieval.as_items(corpus).withColumn("content", retrieval.body_of()).filter(F.trim("content") != "")
    # Cut in its row, so that neither a text nor its pieces are moved.
    rest = [c for c in items.columns if c not in ("content", "pos")]
    parted = items.withColumn("_pieces", passages.pieces(F.col("content"), passages.retrieval_cuts))
    return parted.select(*rest, "pos", F.posexplode("_pieces").alias("part", "content")).filter("content <> ''").withColumn("pos", F.struct("pos", "part")).drop("part")


def context_questions(messages: DataFrame, by: str, order: str) -> DataFrame:
    """(by, question): what the last four messages of users and assistants said, as one text."""
    told = recent_messages(messages.filter(F.col("role").isin("user", "assistant")), by, order, n=4, latest=360, each=360, total=1100)
    rows = F.array_sort(F.collect_list(F.struct(order, "kept")))
    return told.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["kept"]), " ").alias("question"))


def retrieve(questions: DataFrame, corpus: DataFrame, concepts: DataFrame | None = None, entries: DataFrame | None = None, *, include_reference: bool = False, contexts: DataFrame | None = None, socratic: bool = False) -> DataFrame:
    """(q_id, place, kind, id, score): evidence for each question from the index, the concepts and the passages, each id once.

    ``entries`` are index entries as items, with term, related and aliases; what a question finds there also words it anew for the others.
    """
    limits = LIMITS | (SOCRATIC if socratic else {})
    found, other = [], None
    if entries is not None:
        # What was found is kept: other wordings are made of it, and asked more than once.
        ranked = cut(retrieval.best(entries, questions, limits["knowledge"], include_reference=include_reference, contexts=contexts))
        found.append(ranked.select("q_id", F.lit(0).alias("kind"), "rank", F.col("id").alias("key"), "score"))
        worded = ranked.select("q_id", "rank", "pos").join(entries.select("pos", "term", "aliases", "related").hint("merge"), "pos")
        other = cut(retrieval.alternatives(worded, questions))
    if concepts is not None:
        ranked = retrieval.best(concepts, questions, limits["concepts"], include_reference=include_reference, contexts=contexts, alternatives=other)
        found.append(ranked.select("q_id", F.lit(1).alias("kind"), "rank", F.col("id").alias("key"), "score"))
    ranked = retrieval.best(passages_of(corpus), questions, limits["corpus"], include_reference=include_reference, contexts=contexts, alternatives=other, per_item=True)
    found.append(ranked.select("q_id", F.lit(2).alias("kind"), "rank", F.col("id").alias("key"), "score"))
    return retrieval.first_of_kinds(contracts.all_of(*found)).select("q_id", "place", "kind", F.col("key").alias("id"), "score")


def prompt_context(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(q_id, kind, context): the texts of the hits, block by block, within each kind's budget. ``texts``: kind, id, text."""
    parts = []
    for kind, (name, (most, longest)) in enumerate(BUDGETS.items()):
        blocks = hits.filter(F.col("kind") == kind).join(texts.filter(F.col("kind") == kind).drop("kind"), "id").withColumn("block", shorten("text", longest))
        kept = within_budget(blocks, "q_id", "place", "block", most, longest)
        rows = F.array_sort(F.collect_list(F.struct("place", "kept")))
        parts.append(kept.groupBy("q_id").agg(F.array_join(F.transform(rows, lambda r: r["kept"]), "\n\n").alias("context")).select("q_id", F.lit(name).alias("kind"), "context"))
    return contracts.all_of(*parts)


def sections_with_roles(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of mark-up to sections with path, role, default scope and whether they need a review."""
    sections = structure.sections_of(blocks, key)
    placed = structure.heading_paths(sections, key, "section")
    told = placed.withColumn("r", structure.section_role("title", "body")).select(key, "section", "title", "level", "path", "body", "r.role", "r.confidence")
    empty = {c: F.lit(None).cast("string") for c in ("scope", "scope_source", "priority", "priority_source")}
    return structure.with_defaults(told.withColumns(empty))


def units_of(sections: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, section, part, text): the corpus units of each section, with the overlap that joins them."""
    packed = passages.with_overlap(passages.pack_units(passages.paragraphs(body)))
    return sections.select(key, "section", F.posexplode(packed).alias("part", "text"))


def apply_segmentation(sections: DataFrame, visual: DataFrame, marker: str = "LECTURA VISUAL ASISTIDA POR IA · PÁGINA ") -> tuple[DataFrame, DataFrame]:
    """Sections and corpus of documents that outside analysis cut anew.

    ``sections`` has document, nth (from 0), title, level, path, content, page_start, page_end, confidence, structural_only; ``visual`` (document, chunk_id, page, content) are the
    readings of pictures and tables that were there, of which what follows ``marker`` stays, with the section whose pages hold theirs (of several the one that
    starts last, then the deepest). Sections: section_id, title, path, level from 1 to 6, confidence from 0.2 to 0.99, role, scope, priority, needs_review and their text. Corpus:
    (document, section_id, chunk_id, part, content, path, role, scope): the units of each section, then the readings; a reading that no section holds has no section_id.
    """
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Sección "), (F.col("nth") + 1).cast("string")))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)).cast("int")))
    path = F.filter(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    told = sections.withColumns({"title": title, "level": level, "path": path, "body": clean_text("content"), "sure": F.greatest(F.lit(0.2), F.least(F.lit(0.99), F.coalesce("confidence", F.lit(0.5))))})
    told = told.withColumn("path", F.when(F.size("path") > 0, F.col("path")).otherwise(F.array("title"))).withColumn("section_id", section_id("document", F.col("nth"), F.col("path"), "title"))
    roled = told.withColumn("r", structure.section_role("title", "body", first_page=F.col("page_start"), last_page=F.col("page_end"))).withColumns({"role": F.col("r.role"), "confidence": F.col("r.confidence")})
    empty = {c: F.lit(None).cast("string") for c in ("scope", "scope_source", "priority", "priority_source")}
    placed = structure.with_defaults(roled.withColumns(empty)).withColumn("confidence", F.col("sure"))
    done = placed.select("document", "nth", "section_id", "title", "path", "level", "page_start", "page_end", "confidence", "role", "scope", "priority", "needs_review", "structural_only", "body")

    units = units_of(done.withColumn("section", F.col("nth")), "document").join(done.select("document", F.col("nth").alias("section"), "section_id", "path", "role", "scope"), ["document", "section"])
    from_text = units.select("document", "section_id", F.concat_ws("-", "section_id", F.lit("unidad"), (F.col("part") + 1).cast("string")).alias("chunk_id"), "part", F.col("text").alias("content"), "path", "role", "scope")
    seen = visual.withColumn("at", F.locate(marker, F.col("content"))).filter("at > 0").withColumn("content", F.trim(F.substr("content", F.col("at"))))
    ranges = done.filter(~F.coalesce("structural_only", F.lit(False)) & F.col("page_start").isNotNull()).select("document", F.col("nth").alias("range_id"), F.col("page_start").alias("start"), F.coalesce("page_end", "page_start").alias("end"), "level")
    held = structure.page_containment(seen.select("document", "page").distinct(), ranges, "document", "page").select("document", "page", F.col("range_id").alias("nth"))
    attached = seen.join(held, ["document", "page"], "left").join(done.select("document", "nth", "section_id", "path", "role", "scope"), ["document", "nth"], "left")
    from_pictures = attached.select("document", "section_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.lit(0).alias("part"), "content", "path", "role", F.coalesce("scope", F.lit("included")).alias("scope"))
    return done, from_text.unionByName(from_pictures)


def course_errors(documents: DataFrame, corpus: DataFrame, concepts: DataFrame, links: DataFrame, bibliography: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """All violations of a course's contract."""
    c = contracts
    return c.all_of(
        c.required(documents, "document", "id", "title"), c.unique(documents, "document", "id"), c.one_of(documents, "document", "id", "priority", c.ENUMS["priority"]),
        c.required(corpus, "chunk", "id", "content"), c.unique(corpus, "chunk", "id"), c.one_of(corpus, "chunk", "id", "scope", c.ENUMS["scope"]),
        c.required(concepts, "concept", "concept_id", "title"), c.unique(concepts, "concept", "concept_id"),
        c.refers(links, "link", "concept_id", "ref_id", bibliography, "ref_id"), c.refers(links, "link", "concept_id", "concept_id", concepts, "concept_id"),
        c.cycle_members(prerequisites).select(F.lit("cycle").alias("rule"), F.lit("unit").alias("entity"), F.col("node").cast("string").alias("id"), F.lit("").alias("detail")),
    )
