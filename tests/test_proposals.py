"""A proposal merged into a small course."""

import pytest

from lectern.plans import course as course_plan
from lectern.plans.proposals import merge_proposal

LIST = "array<string>"


@pytest.fixture(scope="module")
def course(spark):
    make = spark.createDataFrame
    return {
        "units": make([("u1", "Montaje", ["u9", "u1"]), ("unidad-sonido", "Otra", None)], f"id string, title string, prerequisites {LIST}"),
        "concepts": make([("c1", "Plano", [], ["b1"], None), ("c2", "Ritmo", ["k1"], [], ["x"])], f"id string, title string, source_ids {LIST}, reference_ids {LIST}, criteria {LIST}"),
        "examples": make([("e1", "Viejo")], "id string, title string"), "activities": make([("a1", "Mirar")], "id string, title string"),
        "modes": make([(0, "m0", "explain"), (1, "m1", "retrieve")], "place int, id string, strategy string"),
        "corpus": make([("k1",), ("k2",)], "id string"), "bibliography": make([("b1",), ("b2",)], "id string"), "sequence": make([(0, "u1"), (1, "gone")], "pos long, unit_id string"),
    }


@pytest.fixture(scope="module")
def proposal(spark):
    make = spark.createDataFrame
    return {
        "units": make([(0, "Sonido", "central", 7, ["Montaje", "Sonido", "nada"], ["Plano", "Voz", "nada"], ["k2", "zz"]), (1, "MONTAJE", "x", 1, None, None, None), (2, "Luz", "x", None, None, None, None), (3, "sonido!", "normal", 1, None, None, None), (4, " ", None, None, None, None, None), (5, "Color", "context", 2, ["Luz"], None, None)], f"place int, title string, priority string, step int, prerequisite_titles {LIST}, concept_titles {LIST}, source_ids {LIST}"),
        "concepts": make([(0, "plano", ["zz"], ["b2"], ["p"]), (1, "Plano", ["k2", "k1"], [], ["q"]), (2, "Voz", ["k1"], ["b1", "qq"], None), (3, "Ritmo", ["k2"], ["b2", "b1"], ["y"])], f"place int, title string, source_ids {LIST}, reference_ids {LIST}, criteria {LIST}"),
        "examples": make([(0, "Nuevo", ["Voz", "Plano", "?"], ["k1"]), (1, "viejo", None, None)], f"place int, title string, concept_titles {LIST}, source_ids {LIST}"),
        "activities": make([(0, "Oír", "retrieve"), (1, "Hablar", "none"), (2, "mirar", "explain")], "place int, title string, strategy string"),
    }


def test_what_is_new_is_added_and_what_is_there_completed(course, proposal):
    out = merge_proposal(course, proposal)
    units = {r.id: r for r in out["units"].collect()}
    assert set(units) == {"u1", "unidad-sonido", "unidad-sonido-2", "unidad-luz", "unidad-color"}
    sound = units["unidad-sonido-2"]
    assert (sound.prerequisites, sound.concept_ids, sound.source_ids, sound.priority, sound.review_status) == (["u1"], ["c1", "voz"], ["k2"], "central", "pending")
    assert units["u1"].prerequisites == [] and units["unidad-color"].prerequisites == ["unidad-luz"] and units["unidad-luz"].priority == "normal"
    concepts = {r.id: (r.source_ids, r.reference_ids, r.criteria, r.suggested) for r in out["concepts"].collect()}
    assert concepts == {"c1": (["k2", "k1"], ["b1"], ["p"], False), "c2": (["k1"], ["b2", "b1"], ["x"], False), "voz": (["k1"], ["b1"], [], True)}
    assert {r.id: (r.concept_ids, r.suggested) for r in out["examples"].collect()} == {"e1": ([], False), "ejemplo-nuevo": (["voz", "c1"], True)}
    assert {r.id: r.mode_id for r in out["activities"].collect()} == {"a1": None, "actividad-oir": "m1", "actividad-hablar": "m0"}
    assert [r.unit_id for r in out["sequence"].orderBy("place").collect()] == ["u1", "unidad-color", "unidad-sonido-2", "unidad-luz", "unidad-sonido"]


def test_empty_proposals_and_courses(course, proposal):
    nothing = merge_proposal(course, {k: v.limit(0) for k, v in proposal.items()})
    assert {k: v.count() for k, v in nothing.items()} == {"units": 2, "concepts": 2, "examples": 1, "activities": 1, "sequence": 2}
    first = merge_proposal({k: v.limit(0) for k, v in course.items()}, proposal)
    assert {k: v.count() for k, v in first.items()} == {"units": 4, "concepts": 3, "examples": 2, "activities": 3, "sequence": 4}


def test_segmentation_is_applied(spark):
    kind = "document string, nth int, title string, level int, path array<string>, content string, page_start int, page_end int, confidence double, structural_only boolean"
    rows = [
        ("doc-a", 0, "Parte uno", 1, ["Parte uno"], "", 1, 9, 0.9, True), ("doc-a", 1, "Capítulo 1", 2, ["Parte uno", "Capítulo 1"], "Texto  del capítulo.\n\n\n\nMás texto.", 1, 4, 7.0, False),
        ("doc-a", 2, None, 11, None, "x " * 4000, 4, 9, None, False), ("doc-a", 3, "Referencias", 1, ["Referencias"], "Gómez, L. (1997).", 10, None, 0.1, False),
    ]
    visual = [("doc-a", "v1", 4, "texto LECTURA VISUAL ASISTIDA POR IA · PÁGINA 4: un gráfico"), ("doc-a", "v2", 2, "LECTURA VISUAL ASISTIDA POR IA · PÁGINA 2: foto "), ("doc-a", "v3", 2, "sin marca"), ("doc-a", "v4", 99, "LECTURA VISUAL ASISTIDA POR IA · PÁGINA 99"), ("doc-a", "v5", 2, None)]
    told, seen = spark.createDataFrame(rows, kind), spark.createDataFrame(visual, "document string, chunk_id string, page int, content string")
    sections, corpus = course_plan.apply_segmentation(told, seen)
    got = {r.nth: r for r in sections.collect()}
    assert [(got[i].title, got[i].level, got[i].confidence) for i in range(4)] == [("Parte uno", 1, 0.9), ("Capítulo 1", 2, 0.99), ("Sección 3", 6, 0.5), ("Referencias", 1, 0.2)]
    assert got[3].role == "referencias" and got[3].scope == "excluded" and got[1].body == "Texto del capítulo.\n\nMás texto." and got[2].path == ["Sección 3"]
    assert got[1].section_id == "doc-a-seccion-2-parte-uno-capitulo-1-capitulo-1"
    rows = corpus.collect()
    assert {r.chunk_id: (r.section_id, r.content) for r in rows if r.chunk_id.startswith("v")} == {
        "v1": (got[2].section_id, "LECTURA VISUAL ASISTIDA POR IA · PÁGINA 4: un gráfico"), "v2": (got[1].section_id, "LECTURA VISUAL ASISTIDA POR IA · PÁGINA 2: foto"), "v4": (None, "LECTURA VISUAL ASISTIDA POR IA · PÁGINA 99")}
    parts = [r for r in rows if r.section_id == got[2].section_id and not r.chunk_id.startswith("v")]
    assert len(parts) >= 1 and len({r.chunk_id for r in rows}) == len(rows)
    assert all(x.count() == 0 for x in course_plan.apply_segmentation(told.limit(0), seen.limit(0)))
