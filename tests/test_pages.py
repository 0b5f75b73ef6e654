"""Documents from their placed lines to sections."""

import pytest

from pyspark.sql import functions as F

from lectern.plans import pages

LINE = "doc long, page long, line_no long, text string, x double, y double, font_size double, bold boolean"
def prose(p):
    w = "abcdefghi"[p] * 6
    return [f"La idea {w} de este apartado se explica con calma.", f"El ejemplo {w} inventado continúa con otras palabras.", f"Sigue el cuerpo {w} del texto hasta el final."]


def book(doc, contents=True, headings=True):
    """Cover, contents list, three chapters, a conclusion and references."""
    out, title = [], lambda p, t: out.append((doc, p, 1, t, 40.0, 750.0, 22.0 if headings else 11.0, headings))
    plain = lambda p, texts, at=2: out.extend((doc, p, at + i, t, 40.0, 700.0 - 40 * i, 11.0, False) for i, t in enumerate(texts))
    out += [(doc, 1, 1, "Tapa del libro", 40.0, 740.0, 24.0, True), (doc, 1, 2, "Material de prueba", 40.0, 680.0, 10.0, False)]
    if contents:
        title(2, "Índice")
        plain(2, ["Capítulo 1 Orígenes ........ 3", "Capítulo 2 Métodos ........ 4", "Capítulo 3 Escucha ........ 5", "Referencias ........ 7"])
    else:
        plain(2, prose(2))
    for p, t in ((3, "Capítulo 1 Orígenes"), (4, "Capítulo 2 Métodos"), (5, "Capítulo 3 Escucha"), (6, "Conclusión")):
        title(p, t) if headings else None
        plain(p, prose(p))
    title(7, "Referencias")
    plain(7, ["Gómez, L. (1997). Escucha y forma. Editorial Sur.", "Smith, J. (2002). Sound and image. pp. 12-18.", "Pérez, A. (2010). DOI 10.1234/ejemplo."])
    return out


@pytest.fixture(scope="module")
def analysed(spark):
    rows = book(1) + book(2, contents=False) + book(3, contents=False) + [(4, p, i + 1, t, 40.0, 700.0 - 40 * i, 11.0, False) for p in range(1, 4) for i, t in enumerate(prose(p))]
    outline = spark.createDataFrame([(2, 0, "Capítulo 1 Orígenes", 1, 3), (2, 1, "Capítulo 2 Métodos", 2, 4), (2, 2, "Conclusión", 1, 6)], "doc long, nth long, title string, level int, page long")
    documents = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 3), (5, 2)], "doc long, pages long")
    sections, docs = pages.analyse(spark.createDataFrame(rows, LINE), documents, outline)
    return {d: sorted((r for r in sections.collect() if r.doc == d), key=lambda r: r["at"]) for d in range(1, 6)}, {r.doc: r for r in docs.collect()}


def test_each_document_has_its_strategy(analysed):
    sections, docs = analysed
    assert {d: r.strategy for d, r in docs.items()} == {1: "contents", 2: "outline", 3: "looks", 4: "whole", 5: "whole"}
    assert docs[1].confidence > docs[2].confidence > docs[3].confidence > docs[4].confidence == 0.34
    assert docs[3].warnings == ["looks_only"] and "unsure_sections" in docs[4].warnings and docs[1].warnings == []


def test_a_book_is_told_apart(analysed):
    mine = analysed[0][1]
    assert [s.title for s in mine] == ["Tapa del libro", "Índice", "Capítulo 1 Orígenes", "Capítulo 2 Métodos", "Capítulo 3 Escucha", "Referencias"]
    by_role = {}
    for s in mine:
        by_role.setdefault(s.role, []).append(s)
    assert len(by_role["indice"]) == 1 and len(by_role["preliminares"]) == 1 and len(by_role["referencias"]) == 1
    assert "Capítulo 1 Orígenes" in by_role["indice"][0].content and not any(s.title == "Capítulo 1 Orígenes" and s.page == 2 for s in mine)
    assert "Gómez, L. (1997)" in by_role["referencias"][0].content and not any("Gómez" in s.content for s in mine if s.role != "referencias")


def test_sections_hold_those_below(analysed):
    mine = {s.title: s for s in analysed[0][2]}
    assert mine["Capítulo 2 Métodos"].path == ["Capítulo 1 Orígenes", "Capítulo 2 Métodos"]
    assert mine["Capítulo 2 Métodos"].content in mine["Capítulo 1 Orígenes"].content and (mine["Capítulo 1 Orígenes"].page, mine["Capítulo 1 Orígenes"].last_page) == (3, 5)
    assert "Gómez" not in mine["Conclusión"].content


def test_a_plain_document_is_one_section(analysed):
    (only,), (empty,) = analysed[0][4], analysed[0][5]
    assert only.title == "Material general" and only.content.startswith("La idea") and only.last_page == 3 and empty.content == ""


def test_headings_of_several_lines(spark):
    row = lambda i, text, y, size=20.0, bold=True, x=40.0, page=1: (1, page, i, text, x, y, size, bold)
    rows = [row(1, "Una historia larga", 750.0), row(2, "de la escucha", 735.0), row(3, "en la escuela", 720.0), row(4, "Otro estilo", 705.0, 16.0)]
    rows += [row(10 + i, f"Línea de cuerpo número {i} con texto.", 600.0 - 14 * i, 10.0, False) for i in range(6)]
    rows += [row(20 + i, f"Título {'abcdef'[i]}", 400.0 - 15 * i, page=2) for i in range(6)] + [row(30, "Lejos", 200.0, page=2), row(31, "a la derecha", 185.0, x=90.0, page=2)]
    found = sorted((r.page, r.line_no, r.last_line, r.title) for r in pages.block_headings(spark.createDataFrame(rows, LINE)).collect())
    assert found == [(1, 1, 3, "Una historia larga de la escucha en la escuela"), (2, 20, 23, "Título a Título b Título c Título d"), (2, 24, 25, "Título e Título f")]
    lines = [(r.line, r.last_line) for r in pages.headings_of(spark.createDataFrame(rows, LINE)).filter("page = 1").collect()]
    assert (1, 3) in lines and not {(1, 1), (2, 2), (3, 3)} & set(lines)


def test_lines_move_to_their_document_before_they_are_read(spark, monkeypatch):
    """However few tasks read them; a long line whose key is that of a running header goes with it."""
    kept = []
    monkeypatch.setattr(pages, "cut", lambda df: kept.append(df) or df)
    header = "Curso de lógica"
    rows = [(d, p, n, text, 40.0, 700.0 - 20 * n, 11.0, False) for d in range(20) for p in range(1, 5) for n, text in enumerate([header if p < 4 else "- " * 200 + header, f"esto dice el texto {chr(97 + d)}{chr(97 + p)} de la hoja", "x" * 400, str(p)])]
    documents = spark.createDataFrame([(d, 4) for d in range(20)], "doc long, pages int")
    outline = spark.createDataFrame([], "doc long, nth long, title string, level int, page long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.analyse(spark.createDataFrame(rows, LINE).coalesce(1), documents, outline)
        got = kept[0].select("doc", "page", "text", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == 20 * 4 * 2 and not any(header in r.text for r in got)
    assert len({(r.doc, r.task) for r in got}) == 20 and len({r.task for r in got}) > 1
