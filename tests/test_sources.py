import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from lectern.operators import contracts, knowledge, maintenance
from lectern.sources import readers, sinks


def folder(files):
    top = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, body in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(body)
    return str(top)


def test_packs(spark):
    pack = {"format": "pack", "version": "1.1", "course": {"id": "c", "title": "T"}, "corpus": [{"id": "a", "content": "x"}, {"id": "b"}]}
    top = folder({"one.json": json.dumps(pack), "two.json": json.dumps(pack | {"version": "9"}), "three.json": json.dumps(pack | {"format": "zip"})})
    packs = readers.read_packs(spark, top, "pack")
    assert packs.count() == 1 and packs.first().concepts == []
    assert [(r.course_id, r.pos, r.id) for r in readers.pack_table(packs, "corpus").orderBy("pos").collect()] == [("c", 0, "a"), ("c", 1, "b")]
    out = tempfile.mkdtemp(prefix="spark-")
    sinks.write_packs(packs, out)
    assert readers.read_packs(spark, out, "pack").drop("path").collect() == packs.drop("path").collect()


def test_folders_and_texts(spark):
    files = {f"full/{n}.json": "{}" for n in readers.REQUIRED_FILES} | {"part/course.json": "{}", "a.md": "# x", "b.bin": "?"}
    top = folder(files | {f"_off/{n}.json": "{}" for n in readers.REQUIRED_FILES})
    assert [r.folder for r in readers.complete_folders(spark, top).collect()] == ["full"]
    assert {r.kind for r in readers.read_texts(spark, top).collect()} == {"json", "markdown"}


def test_json_material(spark):
    shapes = ['[{"content": "uno", "id": "x"}, {"content": " "}]', '{"corpus": [{"text": "dos"}]}', '```json\n{"content": "tres", "title": "T"}\n```', "nada"]
    rows = readers.json_material(spark.createDataFrame([(str(i), s) for i, s in enumerate(shapes)], "path string, text string")).orderBy("path").collect()
    assert [(r.id, r.title, r.content) for r in rows] == [("x", "Fragmento 1", "uno"), ("fragmento-1", "Fragmento 1", "dos"), ("fragmento-1", "T", "tres")]


def test_sheets(spark):
    sheet = spark.createDataFrame([("12.345", "Pérez", "Ana", "A", "Sí"), ("", "x", "y", "", ""), ("9", None, None, None, "no")], "dni string, APELLIDO string, nombre string, comision string, activo string")
    assert [tuple(r) for r in readers.roster(sheet).collect()] == [("12345", "Pérez, Ana", "A", True), ("9", "9", "", False)]
    log = spark.createDataFrame([("01/02/2024", "10:30", "1", "a| b|", "7"), ("bad", "", "2", None, "x")], ["Fecha", "Hora", "DNI", "Concepto IDs", "Nivel confusión"])
    rows = readers.interactions(log).collect()
    assert [(r.dni, str(r.ts), list(r.concept_ids), r.level) for r in rows] == [("1", "2024-02-01 10:30:00", ["a", "b"], 2), ("2", "None", [], 0)]


def test_ocr_and_model_json(spark):
    words = spark.createDataFrame([(1, 5, 1, 1, 1, 2, 30, 10, 20, 9, 90.0, "mundo"), (1, 5, 1, 1, 1, 1, 5, 11, 20, 9, -1.0, "hola"), (1, 4, 1, 1, 1, 0, 0, 0, 0, 0, 0.0, "x")], "page int, level int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string")
    row = readers.ocr_lines(words).first()
    assert (row.text, row.left, row.right, row.top, row.bottom, row.confidence) == ("hola mundo", 5, 50, 10, 20, 90.0)
    raw = spark.createDataFrame([('Claro:\n```json\n{"a": {"b": "}"}}\n```',), ("nada",), (None,)], "x string")
    assert [r[0] for r in raw.select(readers.model_json("x")).collect()] == ['{"a": {"b": "}"}}', None, None]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "s")], "id long, title string, source string")
    new = spark.createDataFrame([(2, None, "t"), (3, "c", "u")], "id long, title string, source string")
    assert sorted(map(tuple, maintenance.upsert(old, new, "id").collect())) == [(1, "a", None), (2, "b", "t"), (3, "c", "u")]
    assert maintenance.add_missing(old, new, F.coalesce("title", F.lit(""))).count() == 4
    assert sinks.put_records(old.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(2)), "id", "v").count() == 3


def test_cycles_and_merging(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "src int, dst int")
    assert sorted(r.node for r in contracts.cycle_members(edges).collect()) == [1, 2, 3]
    assert contracts.cycle_members(edges.filter("src > 2")).count() == 0
    entries = spark.createDataFrame([(i, f"t{i}", [f"t{i + 1}"]) for i in range(40)] + [(90, "solo", [])], "entry_id long, term string, aliases array<string>")
    roots = {r.entry_id: r.root for r in knowledge.merge_groups(entries).collect()}
    assert set(roots.values()) == {0, 90} and roots[39] == 0


def test_freshness(spark):
    corpus = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b")], "g string, pos int, t string")
    first = knowledge.signature(corpus, "g", "pos", ["t"])
    index = first.select("g", F.lit(3).alias("version"), F.lit("complete").alias("status"), "signature", F.lit(2).alias("total_passages"), F.lit(2).alias("processed"))
    assert knowledge.is_current(index, first, "g").first().current
    changed = knowledge.signature(corpus.replace("b", "c"), "g", "pos", ["t"])
    assert not knowledge.is_current(index, changed, "g").first().current
    assert not knowledge.is_current(index.limit(0), first, "g").first().current
