"""Jobs that are taken up again, imports by file, files from parts, metadata, publishing."""

import hashlib
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import documents
from lectern.sources import imports, jobs


def test_a_killed_run_gives_each_row_once(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-") + "/job"
    tasks = spark.createDataFrame([(i // 3, i) for i in range(20)] + [(None, 99)], "batch_id long, item long")
    seen = []

    def work(rows):
        seen.append({r.batch_id for r in rows.collect()})
        return rows.withColumn("twice", F.col("item") * 2)

    assert jobs.job_state(tasks, folder, "s1").first().status == "processing" and jobs.results(spark, folder, "s1") is None
    jobs.run_waves(tasks, work, folder, "s1", at_once=2, most_waves=1)

    # The next wave breaks off after its results are written and before its commit.
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")) if "signature" in str(a[-1]) and "wave" not in str(a[-1]) else real(*a[1:], **k))
    with pytest.raises(RuntimeError):
        jobs.run_waves(tasks, work, folder, "s1", at_once=2)
    monkeypatch.undo()
    assert tuple(jobs.job_state(tasks, folder, "s1").first()) == ("partial", 7, 2)
    assert sorted(r.item for r in jobs.results(spark, folder, "s1").collect()) == list(range(6))
    assert jobs.run_waves(tasks, work, folder, "s1", at_once=3) == 2
    assert tuple(jobs.job_state(tasks, folder, "s1").first()) == ("complete", 7, 7) and jobs.run_waves(tasks, work, folder, "s1") == 0
    rows = jobs.results(spark, folder, "s1").collect()
    assert sorted((r.item, r.twice) for r in rows) == [(i, 2 * i) for i in range(20)]
    jobs.run_waves(tasks, work, folder, "s2")
    assert len(jobs.results(spark, folder, "s2").collect()) == 20 == len(jobs.results(spark, folder, "s1").collect())


PASSAGES = [(f"p{i}", i, f"the passage number {i} speaks of rhythm and of tone") for i in range(8)]


def content(ids, **more):
    entries = [{"term": "Rhythm", "aliases": ["beat"], "definition": "d", "evidence": [{"passageId": ids[0] if ids else "p0", "quote": "speaks of rhythm and"}]}]
    return {"format": imports.OUTPUT_FORMAT, "version": 3, "sourceSignature": "sig", "totalPassages": 8, "processedPassageIds": ids, "entries": entries} | more


def test_one_bad_file_leaves_the_others(spark, tmp_path):
    evidence = lambda **e: [{"term": "T", "evidence": [{"passageId": "p0", "quote": "speaks of rhythm and"} | e]}]
    files = {
        "good1.json": "﻿" + json.dumps(content(["p0", "p1", "p2"])), "good2.json": "```json\n" + json.dumps(content(["p4", "p3"])) + "\n```", "cut.json": json.dumps(content(["p5"]))[:-9], "prose.json": "Here is the result", "empty.json": " \n",
        "list.json": "[1]", "format.json": json.dumps(content(["p5"], format="x", version=2)), "signature.json": json.dumps(content(["p5"], sourceSignature=None, totalPassages=9)), "none.json": json.dumps(content([" "])),
        "twice.json": json.dumps(content(["p5", "p5"])), "unknown.json": json.dumps(content(["p5", "zz"])), "gap.json": json.dumps(content(["p5", "p7"])),
        "term.json": json.dumps(content(["p0"], entries=[{"term": " ", "evidence": []}])), "foreign.json": json.dumps(content(["p0"], entries=evidence(passageId="p1"))), "quote.json": json.dumps(content(["p0"], entries=evidence(quote="not in the passage"))), "short.json": json.dumps(content(["p0"], entries=evidence(quote="speaks of"))),
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    read = imports.parsed(imports.read_files(spark, str(tmp_path))).cache()
    passages = spark.createDataFrame(PASSAGES, "passage_id string, position long, text string")
    found = imports.faults(read, passages, "sig").cache()
    got = {}
    for r in found.collect():
        got.setdefault(r.file, set()).add(r.fault)
    assert got == {
        "cut.json": {"json"}, "prose.json": {"json"}, "empty.json": {"json"}, "list.json": got["list.json"], "format.json": {"format", "version"}, "signature.json": {"signature", "total"}, "none.json": {"processed", "foreign"}, "twice.json": {"repeated"},
        "unknown.json": {"unknown"}, "gap.json": {"gap"}, "term.json": {"term", "evidence"}, "foreign.json": {"foreign"}, "quote.json": {"quote"}, "short.json": {"quote"},
    } and got["list.json"]
    entries, state = imports.imported(read, found, passages)
    assert sorted((r.file, r.term) for r in entries.collect()) == [("good1.json", "Rhythm"), ("good2.json", "Rhythm")]
    assert tuple(state.first()) == (16, 14, 5, 8, "partial")
    assert imports.imported(read.limit(0), found.limit(0), passages)[1].first().status == "empty"


def test_files_come_out_equal_or_not_at_all(spark):
    body = bytes(range(256)) * 3 + b"end"
    cut = [body[i : i + 100] for i in range(0, len(body), 100)]
    whole, n = list(enumerate(cut)), len(cut)
    uploads = {
        "ok": (len(body), n, hashlib.sha256(body).hexdigest(), whole[::-1]), "plain": (len(body), n, None, whole + whole[:2]), "missing": (len(body), n, None, whole[1:]), "size": (len(body), n, None, [(0, b"x"), *whole[1:]]),
        "doubled": (len(body), n, None, [*whole, (0, cut[1])]), "extra": (len(body), n, None, [*whole, (n, b"")]), "count": (len(body), n + 1, None, whole), "empty": (0, 0, None, []), "too_large": (5000, 50, None, []), "digest": (len(body), n, "0" * 64, whole), "alone": (7, 1, None, []),
    }
    manifests = spark.createDataFrame([(k, size, count, sha) for k, (size, count, sha, _) in uploads.items()] + [(None, 1, 1, None)], "upload_id string, file_size long, chunk_count long, sha256 string")
    parts = spark.createDataFrame([(k, i, bytearray(b)) for k, (*_, rows) in uploads.items() for i, b in rows] + [("stray", 0, bytearray(b"x")), ("ok", 1, None)], "upload_id string, part_no long, content binary")
    got = {r.upload_id: (r.verdict, r.content) for r in documents.assembled(manifests, parts, most_bytes=2000, chunk_bytes=100).collect()}
    assert {k: v for k, (v, _) in got.items()} == {k: {"ok": "stored", "plain": "stored", "alone": "missing"}.get(k, k) for k in uploads}
    assert got["ok"][1] == got["plain"][1] == body and all(b is None for k, (_, b) in got.items() if k not in ("ok", "plain"))


def test_metadata_survives_its_sink(spark):
    docs = spark.createDataFrame([("d1", "Libro uno.v2.pdf", "pdf", "libro", "central", 30), ("d1", "Libro uno.v2.pdf", "pdf", "libro", "central", 30), ("d2", None, None, "odd", None, None)], "document_id string, source_name string, format string, document_type string, priority string, pages int")
    sections = spark.createDataFrame([("d1", i, f"s{i}", f"T{i}" if i else None, ["a", "b"] if i % 2 else None, i, 1, 2, "contenido", None, "normal", 0.5 if i % 2 else None) for i in range(5)] + [("gone", 0, "x", "t", None, 1, 1, 1, None, None, None, 0.9)], "document_id string, position int, id string, title string, path array<string>, level int, page_start int, page_end int, role string, scope string, priority string, confidence double")
    meta = documents.documents_meta(docs, sections, at_once=2)
    rows = {(r.document_id, r.part): r for r in meta.collect()}
    assert set(rows) == {("d1", 0), ("d1", 1), ("d1", 2), ("d2", 0)}
    assert [s.id for p in range(3) for s in rows["d1", p].sections] == [f"s{i}" for i in range(5)]
    one = rows["d1", 0]
    assert (one.title, one.section_count, one.low_confidence, one.sections[0].title, one.sections[0].level, one.sections[0].scope) == ("Libro uno.v2", 5, 5, "Material", 1, "included")
    two = rows["d2", 0]
    assert (two.title, two.document_type, two.priority, two.sections, two.section_count) == ("Material", "apunte", "normal", [], 0)
    path = tempfile.mkdtemp(prefix="spark-") + "/meta"
    meta.write.json(path, ignoreNullFields=False)
    again = spark.read.schema(documents.DOCUMENT_META).json(path)
    assert [f.name for f in again.schema] == meta.columns and {(r.document_id, r.part): r for r in again.collect()} == rows


def test_publishing_moves_the_version_once(spark):
    courses = spark.createDataFrame([("c1", "draft", 3, "x"), ("c2", "draft", 1, "y"), ("c3", "published", 9, "z")], "course_id string, status string, version long, title string")
    requests = spark.createDataFrame([("c1", 3, "a", 20), ("c1", 3, "b", 10), ("c1", 2, "c", 1), ("c2", 1, "d", 5), ("c9", 1, "e", 5), ("c3", None, "f", 5), ("c3", 9, "g", 6)], "course_id string, expected long, request_id string, at long")
    after, outcomes = documents.published(courses, requests, spark.createDataFrame([("c2",), ("c2",)], "course_id string"))
    assert {r.request_id: r.outcome for r in outcomes.collect()} == {"a": "conflict", "b": "published", "c": "conflict", "d": "invalid", "e": "unknown", "f": "conflict", "g": "published"}
    assert {tuple(r) for r in after.collect()} == {("c1", "published", 4, "x"), ("c2", "draft", 1, "y"), ("c3", "published", 10, "z")}
