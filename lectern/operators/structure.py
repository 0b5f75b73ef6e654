"""From texts, lines and page geometry to sections: repeated furniture, headings, roles, paths, extents, columns.

Lines have a document key and an order; every operator that depends on order takes it as a column. A document is the unit of
work: windows are partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import CONTENT_TITLE, FUNCTION_WORDS, ROLE_SCOPES, ROLE_TITLES
from lectern.functions.text import clean_line, fold, furniture_key, once, squeeze

PAGE_NUMBER = r"(?i)^(page|p[aá]gina)\s+[0-9]+$|^[-–—]?\s*[0-9]+\s*[-–—]?$"
TOC_LINE = r"(\.{2,}|·{2,}|…{2,})\s*[0-9]{1,4}$|\s{2,}[0-9]{1,4}$"


# Lines and what repeats.

def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of all lines, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def edge_lines(pages: DataFrame, group: str, page: str, text: str = "text", n: int = 3) -> DataFrame:
    """(group, page, line) of the first and last ``n`` lines of each page."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    edges = F.when(F.size(lines) <= 2 * n, lines).otherwise(F.concat(F.slice(lines, 1, n), F.slice(lines, -n, n)))
    return pages.select(group, page, F.explode(edges).alias("line"))


def repeated_furniture(edges: DataFrame, pages: DataFrame, group: str, share: float = 0.45, longest: int = 120) -> DataFrame:
    """(group, key, n): keys of edge lines found at least twice and on ``share`` of a group's pages."""
    fine = once(clean_line("line"), lambda x: (x != "") & (F.length(x) <= longest) & ~x.rlike(PAGE_NUMBER))
    keyed = edges.filter(fine).select(group, furniture_key("line").alias("key")).filter("key <> ''")
    counted = keyed.groupBy(group, "key").agg(F.count("*").alias("n"))
    totals = pages.groupBy(group).agg(F.count("*").alias("pages"))
    return counted.join(totals, group).filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(share * F.col("pages")))).select(group, "key", "n")


def says_something(line: Column | str) -> Column:
    """A line that is neither blank nor a page number."""
    return once(clean_line(line), lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))


def without_noise(lines: DataFrame, furniture: DataFrame, group: str) -> DataFrame:
    """Lines that are not blank, no page number and no furniture of their group."""
    kept = lines.filter(says_something("line")).withColumn("key", furniture_key("line"))
    return kept.join(furniture.select(group, "key"), [group, "key"], "left_anti").drop("key")


def heading_like(line: Column | str) -> Column:
    """A short line that doesn't end like a sentence and is numbered, all capitals, or begins with a capital."""
    text = clean_line(line)
    short = (F.length(text) > 0) & (F.length(text) <= 150) & (F.size(F.split(text, " ")) <= 20)
    starts = text.rlike(r"^([0-9]+(\.[0-9]+)*[.)]?\s+)?[A-ZÀ-Þ]")
    return short & starts & ~text.rlike(r"[.!?;:,]$")


def is_reference(line: Column | str) -> Column:
    """A line that cites: a year in brackets, pages, a DOI, or a surname with initials in a long line."""
    text = F.trim(F.col(line) if isinstance(line, str) else line)
    details = text.rlike(r"(?i)\([0-9]{4}[a-z]?\)|\bpp?\.\s*[0-9]+|\bdoi\b|10\.[0-9]{4,9}/")
    surname = text.rlike(r"^[A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'’\-]+,\s*([A-ZÁÉÍÓÚÜÑ]\.?\s*){1,4}")
    return details | (surname & (F.length(text) > 35))


def is_toc_line(line: Column | str) -> Column:
    return F.rtrim(F.col(line) if isinstance(line, str) else line).rlike(TOC_LINE)


# Quality of a text layer.

def text_quality(text: Column | str, confidence: float = 55.0) -> Column:
    """(letters, words, alpha_ratio, single_ratio, fragment_ratio, fragment_runs, broken_spacing, score) of a text.

    Runs are two and more neighbouring fragments of a line: words of four letters at most that aren't function words.
    """
    size, off = lambda c: F.length(c), lambda c, letters: F.translate(c, letters, "")

    def drawn(body: Column) -> Column:
        # A token is a run of letters and digits. Digits off, runs of letters are words; each becomes "2" if it has two letters and more.
        runs = F.regexp_replace(F.regexp_replace(body, r"\p{N}++", ""), r"[^\p{L}]++", " ")
        tokens = F.regexp_replace(F.regexp_replace(body, r"[\p{L}\p{N}]++", "1"), "[^1]++", "")
        # Folded words become one letter each, lines stay apart.
        long_ones = F.regexp_replace(fold(body), r"[a-z]{5,}+|(?<![a-z])(?:" + "|".join(FUNCTION_WORDS) + ")(?![a-z])", "L")
        folded = F.regexp_replace(F.regexp_replace(long_ones, "[a-z]++", "S"), "[^LS\n]++", "")
        bad = (size(body) - size(off(body, "�"))) * 3 + (size(body) - size(F.regexp_replace(body, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))) * 5
        return F.struct(
            size(body).alias("size"), size(off(runs, " ")).cast("double").alias("letters"), F.regexp_replace(runs, r"\p{L}{2,}+", "2").alias("words"), F.greatest(F.lit(1), size(tokens)).cast("double").alias("n_tokens"),
            size(F.regexp_replace(body, r"\s", "")).alias("visible"), folded.alias("folded"), bad.alias("bad"),
        )

    def counted(d: Column) -> Column:
        words, n_folded = d["words"], size(off(d["folded"], "\n"))
        return F.struct(
            d["size"].alias("size"), d["letters"].alias("letters"), d["n_tokens"].alias("n_tokens"), (d["letters"] / F.greatest(F.lit(1), d["visible"])).alias("alpha"), d["bad"].alias("bad"), (size(words) - size(off(words, "2"))).alias("words"), size(off(words, "2 ")).alias("single"), n_folded.alias("n_folded"),
            (size(off(d["folded"], "L\n")) / F.greatest(F.lit(1), n_folded).cast("double")).alias("fragments"), F.regexp_extract_all(d["folded"], F.lit("(S{2,})"), F.lit(1)).alias("runs"),
        )

    def judged(c: Column) -> Column:
        return F.struct(c.alias("c"), ((c["size"] >= 200) & (c["letters"] >= 150) & (c["n_folded"] >= 35) & (c["fragments"] >= 0.34) & (F.size(c["runs"]) >= 4) & (size(F.array_join(c["runs"], "")) >= 10)).alias("broken"))

    def told(j: Column) -> Column:
        c, letters, n = j["c"], j["c"]["letters"], j["c"]["n_tokens"]
        score = 25.0 * c["alpha"] + 25.0 * c["words"] / n + 20.0 * F.least(F.lit(1.0), letters / 180.0) + 0.3 * confidence - 18.0 * c["single"] / n - c["bad"] - F.when(j["broken"], 18).otherwise(0)
        return F.struct(
            letters.cast("long").alias("letters"), c["words"].alias("words"), c["alpha"].alias("alpha_ratio"), (c["single"] / n).alias("single_ratio"), c["fragments"].alias("fragment_ratio"),
            F.size(c["runs"]).alias("fragment_runs"), j["broken"].alias("broken_spacing"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"),
        )

    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return once(once(once(once(body, drawn), counted), judged), told)


def is_poor(quality: str, text: Column | str) -> Column:
    q, body = F.col(quality), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.length(body) < 90) | (q["letters"] < 45) | (q["score"] < 54) | (q["single_ratio"] > 0.28) | q["broken_spacing"] | body.rlike(r"[�\x00-\x08\x0B\x0C\x0E-\x1F]")


def is_contents_page(text: Column | str) -> Column:
    """A page that begins with a contents heading and has five page numbers or three leaders."""
    body = fold(text)
    return body.rlike(r"^\s*(indice|contenido|sumario|contents|table of contents)\b") & ((F.regexp_count(body, F.lit(r"\b[0-9]{1,3}\b")) >= 5) | (F.regexp_count(body, F.lit(r"\.{2,}|…{2,}|·{2,}")) >= 3))


# Roles.

def bare_title(title: Column | str) -> Column:
    """Folded title without its number."""
    return F.trim(F.regexp_replace(squeeze(title), r"^(([0-9]+(\.[0-9]+)*[.)]?)|([ivxlcdm]+[.)]))\s+", ""))


def title_role(title: Column | str) -> Column:
    """The role that a title names, or null."""
    def named(bare: Column) -> Column:
        rule = F.when(bare.rlike(CONTENT_TITLE), "contenido")
        for role, pattern in ROLE_TITLES:
            rule = rule.when(bare.rlike(pattern), role)
        return rule

    return once(bare_title(title), named)


def section_role(title: Column | str, content: Column | str, *, first_page: Column | None = None, last_page: Column | None = None, pages: Column | None = None, contents_page: Column | None = None) -> Column:
    """(role, confidence) by rules in order: title, contents lines, citations, short texts at either end, else contents of the work."""
    body = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.greatest(F.size(lines), F.lit(1)).cast("double")
    toc, refs = F.size(F.filter(lines, is_toc_line)), F.size(F.filter(lines, is_reference))
    first, last, total = (F.coalesce(x, F.lit(0)) if x is not None else F.lit(0) for x in (first_page, last_page, pages))
    little = (F.length(F.trim(body)) > 0) & (F.length(F.trim(body)) <= 140) & (F.size(lines) <= 5)
    says = lambda role, confidence: F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), confidence.cast("double").alias("confidence"))
    told = title_role(title)
    rule = F.when(told.isNotNull(), says(told, F.lit(0.98)))
    rule = rule.when((toc >= 2) & (toc / n >= 0.25), says("indice", F.least(F.lit(0.97), 0.78 + 0.18 * toc / n)))
    if contents_page is not None:
        rule = rule.when(contents_page, says("indice", F.lit(0.82)))
    rule = rule.when((refs >= 3) & (refs / n >= 0.3), says("referencias", F.least(F.lit(0.96), 0.76 + 0.2 * refs / n)))
    rule = rule.when(little & (first > 0) & (first <= 2), says("preliminares", F.lit(0.76)))
    rule = rule.when(little & (total > 0) & (last >= total - 1), says("preliminares", F.lit(0.71)))
    return rule.otherwise(says("contenido", F.lit(0.62)))


def role_scope(role: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ROLE_SCOPES.items() for x in pair))[role], F.lit("included"))


def with_defaults(sections: DataFrame, document_priority: str = "normal") -> DataFrame:
    """Sections with scope and priority and where these come from: a teacher's choice wins, then the role's and the document's default.

    ``sections`` has role, confidence and, as far as known, scope, scope_source, priority, priority_source. A scope that isn't the role's and
    has no source counts as a teacher's choice. What is below a confidence of 0.7 needs a review.
    """
    default = role_scope(F.col("role"))
    chosen = (F.col("scope_source") == "teacher") | (F.col("scope_source").isNull() & F.col("scope").isNotNull() & (F.col("scope") != default))
    teacher = F.coalesce(chosen & F.col("scope").isNotNull(), F.lit(False))
    own = F.coalesce((F.col("priority_source") == "teacher") & F.col("priority").isin("central", "normal", "context"), F.lit(False))
    return sections.withColumns({
        "scope": F.when(teacher, F.col("scope")).otherwise(default), "scope_source": F.when(teacher, "teacher").otherwise("role-default"),
        "priority": F.when(own, F.col("priority")).otherwise(F.lit(document_priority)), "priority_source": F.when(own, "teacher").otherwise("document"),
        "needs_review": F.coalesce(F.col("confidence") < 0.7, F.lit(True)),
    })


def boundary_role(rule_role: Column, rule_confidence: Column, proposed: Column, proposed_confidence: Column, contents_line: Column) -> Column:
    """Rules win from a confidence of 0.7; a valid proposal counts unless the line is part of a contents list; else the body."""
    valid = F.coalesce(proposed.isin(*ROLE_SCOPES), F.lit(False)) & ~contents_line
    says = lambda role, c, source: F.struct(role.alias("role"), c.cast("double").alias("confidence"), F.lit(source).alias("source"))
    return F.when(F.coalesce(rule_confidence >= 0.7, F.lit(False)), says(rule_role, rule_confidence, "rules")).when(valid, says(proposed, F.coalesce(proposed_confidence, F.lit(0.5)), "ai")).otherwise(says(F.lit("contenido"), F.lit(0.5), "rules"))


# Sequences.

def islands(rows: DataFrame, by: list[str], order: str, *keys: str) -> DataFrame:
    """``rows`` with ``island``, the number of the run of equal keys within ``by``, from 1."""
    along = Window.partitionBy(*by).orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(along))
    start = F.when((F.row_number().over(along) > 1) & same, 0).otherwise(1)
    return rows.withColumn("_start", start).withColumn("island", F.sum("_start").over(along)).drop("_start")


def heading_paths(headings: DataFrame, by: str, order: str, deepest: int = 6) -> DataFrame:
    """``headings`` (level, title) with ``path``: the titles above, nearest level by level, and the heading's own.

    At each level the last earlier heading of that level or above decides: if it is of that very level it is an ancestor, else the slot is empty.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    slots = []
    for k in range(1, deepest):
        nearest = F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(before)
        slots.append(F.when((F.col("level") > k) & (nearest["level"] == k), nearest["title"]))
    above = F.filter(F.array(*slots), lambda t: t.isNotNull())
    return headings.withColumn("path", F.concat(above, F.array("title")))


def section_ends(headings: DataFrame, by: str, order: str, end: str, nested: bool = True) -> DataFrame:
    """``headings`` with ``section_end``: the place before the next heading (of the same level or above, if ``nested``), else ``end``."""
    if not nested:
        along = Window.partitionBy(by).orderBy(order)
        return headings.withColumn("section_end", F.coalesce(F.lead(order).over(along) - 1, F.col(end)))
    # For each level the nearest later heading of that level or above; the row's own level picks.
    after = Window.partitionBy(by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    nearest = F.lit(None).cast("long")
    for k in range(8, 0, -1):
        nearest = F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col(order))).over(after)).otherwise(nearest)
    return headings.withColumn("section_end", F.coalesce(nearest - 1, F.col(end)))


def direct_children(headings: DataFrame, by: str, order: str) -> DataFrame:
    """``headings`` with ``children``: headings one level below it, up to its end. ``headings`` has section_end, nested."""
    below = headings.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.col("level").alias("_level"))
    met = headings.join(below, (F.col(by) == F.col("_by")) & (F.col("_order") > F.col(order)) & (F.col("_order") <= F.col("section_end")) & (F.col("_level") == F.col("level") + 1), "left")
    return met.groupBy(*headings.columns).agg(F.count("_order").alias("children"))


def smooth_levels(levels: Column) -> Column:
    """Levels that go down one step at a time, the first of which is 1."""
    return F.aggregate(levels, F.array().cast("array<int>"), lambda done, x: F.array_append(done, F.when(F.size(done) == 0, 1).otherwise(F.greatest(F.lit(1), F.least(x, F.element_at(done, -1) + 1)))))


def monotone(entries: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Entries whose key isn't below that of an entry kept before; a refused key is below the running maximum, so that decides."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("_most", F.max(key).over(before)).filter(F.col("_most").isNull() | (F.col(key) >= F.col("_most"))).drop("_most")


def range_ends(starts: DataFrame, by: str, start: str, last: str) -> DataFrame:
    """Ranges from starts: each ends before the next one, the last at ``last``."""
    return starts.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(by).orderBy(start)) - 1, F.col(last)))


def overlaps(ranges: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Ranges that begin before the one before them has ended."""
    along = Window.partitionBy(by).orderBy(start, end)
    return ranges.withColumn("_before", F.lag(end).over(along)).filter(F.col(start) <= F.col("_before")).drop("_before")


def gaps_in_sequence(rows: DataFrame, by: str, position: str) -> DataFrame:
    """(by, consecutive): whether a group's positions follow each other without a gap or repeat, in any order."""
    return rows.groupBy(by).agg((F.max(position) - F.min(position) + 1 == F.count("*")).alias("spans"), (F.countDistinct(position) == F.count("*")).alias("unique")).select(by, (F.col("spans") & F.col("unique")).alias("consecutive"))


# Geometry.

def widest_gap(lines: DataFrame, by: str, x: str, width: float, least_gap: float = 0.14, least_lines: int = 4) -> DataFrame:
    """(by, columns, split): two columns if the widest gap between neighbouring left edges is wide enough and both sides have lines.

    Distinct edges with counts are enough, so a page's lines are counted before they are ordered.
    """
    edges = lines.groupBy(by, x).agg(F.count("*").alias("n"))
    along = Window.partitionBy(by).orderBy(x)
    stepped = edges.withColumns({"gap": F.lead(x).over(along) - F.col(x), "left": F.sum("n").over(along), "all_lines": F.sum("n").over(Window.partitionBy(by))})
    best = stepped.groupBy(by).agg(F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col(x)).alias("nearer"), "left"))).alias("b"), F.max("all_lines").alias("all_lines"))
    wide = F.coalesce((F.col("b.gap") >= least_gap * width) & (F.col("b.left") >= least_lines) & (F.col("all_lines") - F.col("b.left") >= least_lines), F.lit(False))
    return best.select(by, F.when(wide, 2).otherwise(1).alias("columns"), F.when(wide, -F.col("b.nearer") + F.col("b.gap") / 2).alias("split"))


def reading_order(lines: DataFrame, by: str, split: str, *, x: str = "x", y: str = "y", width: str = "width", page_width: float = 600.0) -> DataFrame:
    """Lines with ``place``: full-width lines above first, then the left column, then the right one; without columns top to bottom."""
    zone = F.when(F.col(split).isNull(), 0).when(F.col(width) >= 0.6 * page_width, 0).when(F.col(x) < F.col(split), 1).otherwise(2)
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(zone, F.col(y).desc(), x)))


def indent_levels(xs: Column, tolerance: float = 14.0) -> Column:
    """The level of each indent: a new anchor opens where an edge is over ``tolerance`` from the last anchor; nearest anchors give levels."""
    anchors = F.aggregate(F.array_sort(F.array_distinct(xs)), F.array().cast("array<double>"), lambda done, v: F.when((F.size(done) == 0) | (v - F.element_at(done, -1) > tolerance), F.array_append(done, v)).otherwise(done))
    nearest = lambda v: F.array_min(F.transform(anchors, lambda a, i: F.struct(F.abs(a - v).alias("d"), (i + 1).alias("level"))))["level"]
    return F.transform(xs, nearest)


def page_offset(mapped: DataFrame, by: str, physical: str, printed: str) -> DataFrame:
    """(by, offset): the median of physical less printed page numbers, 0 without any."""
    return mapped.groupBy(by).agg(F.coalesce(F.median(F.col(physical) - F.col(printed)), F.lit(0.0)).alias("offset"))


# Mark-up.

HTML_BLOCK = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>"


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, nth, tag, text) of headings, paragraphs and list items, in order."""
    body = F.coalesce(F.col(html), F.lit(""))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(h[1-6]|p|li)>"), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(h[1-6]|p|li)>"), F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("p", "b"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.col("b")["text"], r"<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, (F.col("p") + 1).alias("nth"), F.lower(F.col("b")["tag"]).alias("tag"), plain.alias("text")).filter("text <> ''")


def sections_of(blocks: DataFrame, key: str = "page_id", order: str = "nth") -> DataFrame:
    """(key, section, title, level, body): a heading opens a section; what comes before the first one is section 0."""
    along = Window.partitionBy(key).orderBy(order)
    heading = F.col("tag").rlike("^h[1-6]$")
    marked = blocks.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(along))
    rows = F.array_sort(F.collect_list(F.when(~heading, F.struct(order, "text"))))
    return marked.groupBy(key, "section").agg(
        F.coalesce(F.max(F.when(heading, F.col("text"))), F.lit("Material general")).alias("title"),
        F.coalesce(F.max(F.when(heading, F.substring("tag", 2, 1).cast("int"))), F.lit(1)).alias("level"),
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("body"), F.min(order).alias("first"),
    )


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, nth, tag, text) of a text's lines: lines that begin with one to six # and a blank are headings, all others paragraphs."""
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    tag = F.when(marks > 0, F.concat(F.lit("h"), marks.cast("string"))).otherwise("p")
    return lines_of(docs, key, text).select(key, F.col("line_no").alias("nth"), tag.alias("tag"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("text")).filter("text <> ''")


# Compilations.

def work_starts(pages: DataFrame, doc: str, page: str, lines: str = "lines", head: int = 14) -> DataFrame:
    """Pages on which a work of a compilation begins: an abstract within the first lines, not on the first, and a title before it."""
    top = F.transform(F.slice(lines, 1, head), lambda x: squeeze(x))
    at = F.array_position(F.transform(top, lambda x: x.rlike(r"^(resumen|abstract)\b")), F.lit(True))
    # A page may have no lines, and its title is read whatever ``at`` is.
    title = F.trim(F.get(lines, F.lit(0)))
    found = pages.filter((at > 1) & (F.length(title) >= 4) & (F.length(title) <= 200))
    return found.select(doc, page, title.alias("title"), F.regexp_extract(F.array_join(F.slice(lines, 1, head), " "), r"\b((?:19|20)[0-9]{2})\b", 1).alias("year"))


def page_containment(pages: DataFrame, ranges: DataFrame, doc: str, page: str) -> DataFrame:
    """Each page with the range it lies in: of several, the one that starts last, then the deepest. ``ranges``: start, end, level, range_id."""
    named = ranges.select(F.col(doc).alias("_doc"), "range_id", "start", "end", "level")
    met = pages.join(named, (F.col(doc) == F.col("_doc")) & (F.col(page) >= F.col("start")) & (F.col(page) <= F.col("end")))
    return met.groupBy(doc, page).agg(F.max(F.struct("start", "level", (-F.col("range_id")).alias("nearer"))).alias("b")).select(doc, page, (-F.col("b.nearer")).alias("range_id"), F.col("b.start").alias("start"))
