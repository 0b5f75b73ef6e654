"""Patches and sections between boundaries, against plain loops."""

import random
import re
import unicodedata

from lectern.operators import knowledge, patches, retrieval, segments

ROWS = "row long, section_id string, document_id string, title string, path array<string>, page_start int, page_end int, scope string, note string"
PATCHES = "patch_id long, section_id string, document_id string, title string, path array<string>, page_start int, page_end int, scope string, priority string, note string"


def words(title):
    flat = "".join(c for c in unicodedata.normalize("NFD", title or "") if not unicodedata.combining(c)).lower()
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", flat))


def plain_matches(rows, asked, chunks):
    out = {}
    for pid, sid, doc, title, path, a, b, scope, priority, _ in asked:
        same = lambda d: not doc or d == doc
        exact = any(sid and r[1] == sid and (chunks or same(r[2])) for r in rows)
        for row, rid, rdoc, rtitle, rpath, c, d, _, _ in rows:
            key = words(re.sub(r"(?i) · parte [0-9]+$", "", rtitle or "") if chunks else rtitle)
            under = rpath is not None and path is not None and len(rpath) > len(path) and rpath[: len(path)] == path
            pages = bool(a and c and a <= (d or c) and c <= (b or a))
            if sid and rid == sid:
                out[row, pid] = "direct"
            elif (scope or priority) and same(rdoc) and under:
                out[row, pid] = "below"
            elif not exact and same(rdoc) and key == words(title) and ((path is not None and rpath == path) or pages):
                out[row, pid] = "legacy"
    return out


def test_patches_as_matched_one_by_one(spark):
    rng = random.Random(2)
    pick = rng.choice
    path = lambda: pick((None, [], ["a"], ["a", "b"], ["a", "b", "c"], ["b"]))
    title = lambda: pick((None, "", "Título", "titulo ", "Otro · parte 2", "Otro"))
    place = lambda: (title(), path(), pick((None, 0, 1, 4)), pick((None, 0, 5, 9)))
    rows = [(i, pick((None, "", "s1", "s2", "s3")), pick((None, "d", "e")), *place(), "included", None) for i in range(60)]
    asked = [(i, pick((None, "", "s1", "s3", "gone")), pick((None, "", "d", "e")), *place(), pick((None, "excluded", f"x{i}")), pick((None, "central")), pick((None, f"n{i}"))) for i in range(40)]
    held, told = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, PATCHES)
    for chunks in (False, True):
        wanted = plain_matches(rows, asked, chunks)
        assert {(r.row, r.patch_id): r.how for r in patches.patch_matches(held, told, chunks=chunks).collect()} == wanted
        for r in patches.patched(held, told, ["scope", "note"], chunks=chunks).collect():
            reach = [a for a in asked if (r.row, a[0]) in wanted]
            assert r.scope == ([a[7] for a in reach if a[7]] or ["included"])[-1] and r.note == ([a[9] for a in reach if a[9]] or [None])[-1]
            assert r.section_id == (rows[r.row][1] or next((a[1] for a in reach if a[1]), None))
    assert patches.patched(held, told.limit(0), ["scope"]).count() == 60 and patches.patch_matches(held.limit(0), told).count() == 0


def exchanges(spark, make):
    """The shuffles of a plan without broadcasts, as text."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", make()._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_patches_move_rows_to_their_document_only(spark):
    held = spark.createDataFrame([(1, "s1", "d", "T", ["a"], 1, 2, "included", None)], ROWS)
    told = spark.createDataFrame([(1, "s1", "d", "T", ["a"], 1, 2, "excluded", None, None)], PATCHES)
    moved = exchanges(spark, lambda: patches.patch_matches(held, told))
    assert moved and not [m for m in moved if re.search("path|words|key", m)]


def plain_sections(lines, marks):
    """One document's sections, boundary by boundary."""
    lines = sorted(x for x in lines if x[2])
    places = {x[:2]: i for i, x in enumerate(lines)}
    found = {}
    for page, line, title, level, confidence in sorted(marks, key=lambda m: (m[2] or "")):
        if (page, line) in places:
            found.setdefault(places[page, line], (title or "", max(1, min(4, 1 if level is None else level)), confidence or 0.65))
    starts, out, path, before = sorted(found), [], [], None
    text = lambda part: "\n".join(x[2] for x in part)
    if not starts:
        return [(0, "Material general", 1, ["Material general"], text(lines), lines[0][0], lines[-1][0], 0.35, 0, False, True)] if lines else []
    intro = text(lines[: starts[0]]).strip()
    if len(intro) >= 90:
        name = "Material introductorio / sin encabezado detectado"
        out.append((0, name, 1, [name], intro, lines[0][0], lines[starts[0] - 1][0], 0.48, 0, False, True))
    levels = []
    for i, at in enumerate(starts):
        levels.append(1 if i == 0 else min(found[at][1], levels[-1] + 1))
    for i, at in enumerate(starts):
        title, _, sure = found[at]
        part = lines[at + 1: starts[i + 1] if i + 1 < len(starts) else len(lines)]
        path = [*path[: levels[i] - 1], title]
        below = 0
        for level in levels[i + 1:]:
            if level <= levels[i]:
                break
            below += level == levels[i] + 1
        out.append((i + 1, title, levels[i], [p for p in path if p], text(part).strip(), lines[at][0], (part or [lines[at]])[-1][0], sure, below, len(text(part).strip()) < 24, sure < 0.62))
    return out


def test_sections_as_cut_one_by_one(spark):
    rng = random.Random(4)
    documents = {}
    for d in range(40):
        lines = [(p, n, rng.choice(("", None, " x ", "palabra " * rng.randrange(1, 9)))) for p in range(rng.randrange(5)) for n in range(6)]
        marks = [(rng.randrange(5), rng.randrange(7), rng.choice(("A", "B", "C", "", None)), rng.choice((None, -1, 1, 2, 3, 4, 7)), rng.choice((None, 0.0, 0.5, 0.9))) for _ in range(rng.choice((0, 0, 1, 9)))]
        documents[d] = (lines, list({m[:2]: m for m in marks}.values()))
    lines = spark.createDataFrame([(d, *x, 0) for d, (ls, _) in documents.items() for x in ls], "doc long, page int, line int, text string, nth int")
    marks = spark.createDataFrame([(d, *m) for d, (_, ms) in documents.items() for m in ms], "doc long, page int, line int, title string, level int, confidence double")
    found = {(r.doc, r.nth): tuple(r)[1:] for r in segments.boundary_sections(lines, marks, "doc").collect()}
    assert found == {(d, s[0]): s for d, (ls, ms) in documents.items() for s in plain_sections(ls, ms)}
    assert segments.boundary_sections(lines.limit(0), marks, "doc").count() == 0


def test_of_two_boundaries_at_a_line_one_stays(spark):
    lines = spark.createDataFrame([(1, 1, 1, "uno"), (1, 1, 2, "dos")], "doc long, page int, line int, text string")
    marks = spark.createDataFrame([(1, 1, 1, "B", 2, 0.9), (1, 1, 1, "A", 3, 0.7), (1, 9, 9, "C", 1, 0.9)], "doc long, page int, line int, title string, level int, confidence double")
    assert [(r.title, r.level, r.content, r.structural_only) for r in segments.boundary_sections(lines, marks, "doc").collect()] == [("A", 1, "dos", True)]


CHUNKS = "doc string, segment_id string, pos int, content string, page_start int, page_end int, scope string, scope_source string, priority string, priority_source string, document_priority string"
ASSIGNED = "doc string, segment_id string, title string, path array<string>, level int, role string, confidence double, rationale string"


def test_assignments_one_to_one_or_not_at_all(spark):
    tail = "final que se repite al comienzo del que sigue, letra por letra"
    chunks = [("Doc Á", "a", 1, "uno " + tail, 3, None, "included", None, "normal", None, "central"), ("Doc Á", "b", 2, tail + " dos", 0, 4, "reference", None, "central", "teacher", "central"),
              ("Doc Á", "c", 3, " ", None, None, "excluded", "teacher", None, None, "odd"), ("Doc Á", "d", 4, None, 9, 9, "excluded", "teacher", None, None, "odd"),
              ("bad", "a", 1, "x", 1, 1, None, None, None, None, None), ("twice", "a", 1, "x", 1, 1, None, None, None, None, None), ("none", "q", 1, "x", 1, 1, None, None, None, None, None)]
    chunks[1] = (*chunks[1][:8], "normal", None, "central")
    told = [("Doc Á", s, "T", ["T"], 1, "contenido", c, w) for s, c, w in (("a", 0.9, "por eso"), ("b", 0.6, "por eso"), ("c", 0.8, None), ("d", 0.8, ""))]
    told += [("bad", "b", "T", ["T"], 1, "contenido", 0.9, ""), ("twice", "a", "T", ["T"], 1, "contenido", 0.9, ""), ("twice", "a", "U", ["U"], 1, "contenido", 0.9, "")]
    held, given = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(told, ASSIGNED)
    assert {tuple(r) for r in segments.assignment_faults(held, given, "doc").collect()} == {("bad", "a", "unassigned"), ("bad", "b", "unknown"), ("twice", "a", "contested"), ("none", "q", "unassigned")}
    sections, kept = segments.assigned_sections(held, given, "doc")
    first, second = sections.orderBy("nth").collect()
    assert (first.section_id, first.page_start, first.page_end, first.confidence, first.evidence, first.needs_review) == ("doc-a-externa-seccion-1", 3, 4, 0.6, ["por eso"], True)
    assert first.content == "uno " + tail + "\n\ndos" and (first.scope, first.priority) == ("included", "central")
    assert (second.content, second.scope, second.scope_source, second.priority, second.evidence, second.fragments) == ("", "excluded", "teacher", "normal", [], 2)
    assert {(r.segment_id, r.section_id[-1], r.scope) for r in kept.collect()} == {("a", "1", "included"), ("b", "1", "included"), ("c", "2", "excluded"), ("d", "2", "excluded")}
    assert segments.assigned_sections(held.limit(0), given, "doc")[0].count() == 0


def test_fragments_of_sections(spark):
    sections = spark.createDataFrame([(1, "d", "s", "Título", ["I", "a"], None, 9), (2, "d", None, "Título", ["I"], 3, None), (3, "e", "s", "", None, None, None), (4, "d", "", "Solo", None, None, None)], "section long, document_id string, section_id string, title string, path array<string>, page_start int, page_end int")
    chunks = spark.createDataFrame([(10, "d", "s", "otro", ["x"], 7, 8, "siete"), (11, "d", None, "titulo · parte 12", ["I", "a"], 2, 2, "dos"), (12, "d", "s", "Título", ["I", "a"], 2, None, None), (13, "d", None, "TÍTULO", ["I"], 0, 0, "x" * 500), (14, None, "s", "", None, 1, 1, "no")],
                                   "chunk long, document_id string, section_id string, title string, path array<string>, page_start int, page_end int, content string")
    found = {r.section: tuple(r)[1:] for r in segments.section_fragments(sections, chunks).collect()}
    assert found == {1: ("d", 2, 9, 3, "dos  siete", "dos  siete"), 2: ("d", 3, None, 1, "x" * 180, "x" * 500), 3: ("e", None, None, 0, "", ""), 4: ("d", None, None, 0, "", "")}


def test_forms_of_documents(spark):
    long, short = "l" * 91, "s" * 70
    made = {"thesis": (3, [(1, "Tesis doctoral")]), "book": (25, []), "guide": (24, [(9, "tesis")]), "paper": (3, [(2, "ABSTRACT"), *[(3, long)] * 6]), "late": (9, [(9, "doi"), *[(1, long)] * 6]), "few": (3, [(1, "doi"), *[(1, long)] * 5]),
            "notes": (40, [(1, short)] * 2 + [(2, long)]), "many": (41, [(1, short)]), "within": (3, [(1, "xdoi doix"), *[(1, long)] * 6]), "empty": (1, []), "null": (1, [(1, None)])}
    pages = spark.createDataFrame([(d, p) for d, (n, _) in made.items() for p in range(1, n + 1)], "doc string, page int")
    lines = spark.createDataFrame([(d, *x) for d, (_, ls) in made.items() for x in ls], "doc string, page int, text string")
    found = {r.doc: r.form for r in segments.document_forms(pages, lines, spark.createDataFrame([("thesis",), ("book",), ("guide",), ("book",)], "doc string"), "doc").collect()}
    s = segments
    assert found == {"thesis": s.THESIS, "book": s.MONOGRAPH, "guide": s.STRUCTURED, "paper": s.ARTICLE, "late": s.PLAIN, "few": s.PLAIN, "notes": s.NOTES, "many": s.PLAIN, "within": s.PLAIN, "empty": s.PLAIN, "null": s.PLAIN}


def test_ids_and_summaries(spark):
    hits = spark.createDataFrame([(1, 2, 2, "p"), (1, 1, 0, "e"), (1, 3, 1, "c"), (1, 4, 2, "q"), (2, 1, 0, "f"), (2, 2, 2, None), (3, 1, 0, "none")], "q_id int, place int, kind int, id string")
    entries = spark.createDataFrame([("e", ["q", None, "", "r", "q"]), ("f", None), ("p", ["never"])], "id string, sources array<string>")
    assert {r.q_id: r.ids for r in retrieval.retrieved_ids(hits, entries).collect()} == {1: ["q", "r", "p", "c"]}
    index = spark.createDataFrame([("a", 7, "partial"), ("z", None, None)], "course string, total_passages int, status string")
    made = spark.createDataFrame([("a", ["x", "y"]), ("a", None), ("b", [])], "course string, evidence array<string>")
    done = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "course string, passage_id int")
    assert {tuple(r) for r in knowledge.index_summary(made, done, index, "course").collect()} == {("a", 2, 2, 2, 7, "partial"), ("b", 1, 0, 0, 0, "empty"), ("z", 0, 0, 0, 0, "empty")}


def test_lines_move_once(spark):
    lines = spark.createDataFrame([("d", 1, 1, "uno"), ("d", 1, 2, "dos")], "doc string, page int, line int, text string")
    marks = spark.createDataFrame([("d", 1, 1, "A", 1, 0.7)], "doc string, page int, line int, title string, level int, confidence double")
    assert len(exchanges(spark, lambda: segments.boundary_sections(lines, marks, "doc"))) == 2


def test_chunks_move_once(spark):
    sections = spark.createDataFrame([(1, "d", "s1", ["a"], "T", 1, 2)], "section long, document_id string, section_id string, path array<string>, title string, page_start int, page_end int")
    chunks = spark.createDataFrame([(1, "d", "s1", ["a"], "T", 1, 2, "x")], "chunk long, document_id string, section_id string, path array<string>, title string, page_start int, page_end int, content string")
    assert len(exchanges(spark, lambda: segments.section_fragments(sections, chunks))) == 3
