import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import structure
from lectern.plans import course


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fold_covers_what_decomposes():
    for code in range(0xC0, 0x180):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii():
            assert chr(code) in t.ACCENTED


def test_scalars(spark):
    row = one(spark, t.normalize(F.lit(" Ñandú, ¿qué?  ")), t.fnv1a(F.lit("hola ñ")), t.slug(F.lit("¡Hola Mundo!"), 5, "x"), t.slug(F.lit("--"), 5, "x"), t.duration_ms(F.lit("1m2.5s")), t.duration_ms(F.lit("x")), t.rejoin_hyphens(F.lit("mon-\ntaje")))
    assert list(row) == ["nandu que", "72b7ffec", "hola-", "x", 62500, None, "montaje"]


def test_numbering(spark):
    rows = spark.createDataFrame([("2.1 Nombre",), ("3) Otro",), ("sin",), (None,)], "x string").select(t.numbering("x").alias("n")).collect()
    assert [(r.n.number, r.n.level) if r.n else None for r in rows] == [("2.1", 2), ("3", 1), None, None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=7), st.lists(st.sampled_from("abcd"), max_size=7))
def test_token_distance(spark, a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(t.token_distance(F.col("a"), F.col("b"))).first()[0] == row[-1]


def role(spark, title, content="texto " * 60, **more):
    r = one(spark, structure.section_role(F.lit(title), F.lit(content), **{k: F.lit(v) for k, v in more.items()}).alias("r")).r
    return r.role, round(r.confidence, 2)


def test_roles(spark):
    assert role(spark, "1. Introducción") == ("contenido", 0.98)
    assert role(spark, "Índice") == ("indice", 0.98)
    assert role(spark, "IV) Bibliografía") == ("referencias", 0.98)
    assert role(spark, "Cosas", "Uno .... 3\nDos .... 9\nTres") == ("indice", 0.9)
    assert role(spark, "Cosas", "Perez, A. (2001)\nGomez, B. (1999)\nLopez, C. (2010)") == ("referencias", 0.96)
    assert role(spark, "Cosas", "poco", first_page=1, last_page=1, pages=90) == ("preliminares", 0.76)
    assert role(spark, "Cosas", "poco", first_page=89, last_page=90, pages=90) == ("preliminares", 0.71)
    assert role(spark, "Cosas") == ("contenido", 0.62)
    assert role(spark, None, None) == ("contenido", 0.62)


def test_broken_spacing(spark):
    broken = "la an áli sis de ima gen es con fu sa cuan do se par ten pala bras sin mo ti vo al gu no\n" * 6
    clean = "el análisis de imágenes resulta confuso cuando aparecen palabras partidas sin ningún motivo\n" * 6
    got = [one(spark, structure.text_quality(F.lit(x)).alias("q")).q for x in (broken, clean)]
    assert got[0].broken_spacing and not got[1].broken_spacing and got[0].score < got[1].score


def naive_paths(heads):
    stack, out = {}, []
    for level, title in heads:
        out.append([stack[k] for k in sorted(stack) if k < level] + [title])
        stack = {k: v for k, v in stack.items() if k < level} | {level: title}
    return out


def test_paths_extents_and_islands(spark):
    rng = random.Random(3)
    docs = {d: [(rng.randint(1, 5), f"t{i}") for i in range(rng.randint(1, 12))] for d in range(60)}
    rows = [(d, i, level, title, 99) for d, heads in docs.items() for i, (level, title) in enumerate(heads, 1)]
    df = spark.createDataFrame(rows, "d int, i long, level int, title string, last long")
    paths = {(r.d, r.i): list(r.path) for r in structure.heading_paths(df, "d", "i").collect()}
    ends = {(r.d, r.i): r.section_end for r in structure.section_ends(df, "d", "i", "last").collect()}
    runs = {(r.d, r.i): r.island for r in structure.islands(df, ["d"], "i", "level").collect()}
    for d, heads in docs.items():
        island = 0
        for i, path in enumerate(naive_paths(heads), 1):
            assert paths[d, i] == path
            assert ends[d, i] == next((j for j in range(i, len(heads)) if heads[j][0] <= heads[i - 1][0]), 99)
            island += i == 1 or heads[i - 2][0] != heads[i - 1][0]
            assert runs[d, i] == island


def test_sections_units_and_defaults(spark):
    pages = spark.createDataFrame([(1, "<p>antes</p><h1>Uno</h1><p>a <b>b</b></p><h2>Anexo</h2><li>c</li>"), (2, None)], "page_id long, html string")
    out = course.sections_with_roles(structure.html_blocks(pages), "page_id").orderBy("section").collect()
    assert [(r.section, r.title, list(r.path), r.scope) for r in out] == [(0, "Material general", ["Material general"], "included"), (1, "Uno", ["Material general", "Uno"] if False else ["Uno"], "included"), (2, "Anexo", ["Uno", "Anexo"], "reference")]
    blocks = structure.markdown_blocks(spark.createDataFrame([(1, "# A\nuno\n\n## B\ndos")], "doc_id long, text string"))
    sections = structure.sections_of(blocks, "doc_id")
    assert [(r.title, r.body) for r in sections.orderBy("section").collect()] == [("A", "uno"), ("B", "dos")]
    assert course.units_of(sections, "doc_id").count() == 2


def test_furniture_and_overlaps(spark):
    pages = spark.createDataFrame([("b", i, f"Libro {i}\ncuerpo {'x' * i}\n{i}") for i in range(1, 6)], "book string, page int, text string")
    found = structure.repeated_furniture(structure.edge_lines(pages, "book", "page"), pages, "book").collect()
    assert [(r.key, r.n) for r in found] == [("libro #", 5)]
    ranges = spark.createDataFrame([(1, 1, 5), (1, 5, 9), (1, 10, 12)], "d int, a int, b int")
    assert [(r.a, r.b) for r in structure.overlaps(ranges, "d", "a", "b").collect()] == [(5, 9)]


def test_quality_looks_at_a_text_once(spark):
    plan = spark.range(1).select(structure.text_quality(F.col("id").cast("string")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("lower(") == 1


def test_only_the_ends_of_chunks_are_compared(spark):
    import time

    from lectern.operators.knowledge import join_overlapping

    long = spark.range(4).select(F.concat(F.repeat(F.lit("añ b"), 700_000), F.lit("z" * 39 + "q")).alias("a"), F.concat(F.lit("z" * 39 + "q"), F.repeat(F.lit("cdé "), 700_000)).alias("b"))
    start = time.time()
    assert [r.n for r in long.select(F.length(join_overlapping(F.array("a", "b"))).alias("n")).collect()] == [5_600_040] * 4
    assert time.time() - start < 15


def test_heading_conditions_read_a_text_once(spark):
    from lectern.operators.layout import heading_scores

    lines = spark.range(1).select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("text"), F.lit(700.0).alias("y"), F.lit(12.0).alias("font_size"), F.lit(True).alias("bold"))
    plan = heading_scores(lines, "doc", "page", "line_no")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("issn") <= 1 and plan.count("regexp_extract") <= 2


def test_coverage_needs_no_join_and_null_ids_meet_nothing(spark):
    from lectern.operators.knowledge import coverage

    e = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, None), (3, 1)], "g int, k int")
    r = spark.createDataFrame([(1, 2), (1, 5), (2, None), (3, 1), (3, 1), (4, 1)], "g int, k int")
    found = coverage(e, r, "g", "k")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.g, x.missing, x.unexpected, x.exact) for x in found.collect()) == [(1, 1, 1, False), (2, 1, 1, False), (3, 0, 0, True), (4, 0, 1, False)]


def test_pages_without_lines_begin_no_work(spark):
    pages = spark.createDataFrame([("s", 1, []), ("s", 2, None), ("s", 3, ["Título", "Abstract 1999"]), ("s", 4, ["Resumen 1999"])], "source string, page int, lines array<string>")
    assert [tuple(r) for r in structure.work_starts(pages, "source", "page").collect()] == [("s", 3, "Título", "1999")]
