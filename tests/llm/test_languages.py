"""Language identification against plain kernels over sets of n-grams, on held-out rows and on awkward tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from rows import COLUMNS, TEXTS, documents

from lectern.llm import languages
from lectern.llm.catalogue import queries


def plain_grams(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return {f" {w} "[i : i + n] for w in words for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n)} if any(c.isalpha() for w in words for c in w) else set()


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def plain_model(rows, landmarks=240, most_of_a_lang=1000, most_rows=6000):
    """Function of a text: (lang, score). Kernels one by one, the ridge regression by gradient-free least squares on stacked rows."""
    draw = lambda i: int(hashlib.md5(f"11003\x1f{i}".encode()).hexdigest()[:13], 16)
    by_lang = defaultdict(set)
    for doc_id, _, lang in rows:
        if doc_id is not None and lang is not None and not is_held_out(doc_id):
            by_lang[lang].add((draw(doc_id), doc_id))
    turns = sorted((place, *pair, lang) for lang, ids in by_lang.items() for place, pair in enumerate(sorted(ids)[:most_of_a_lang]))[:most_rows]
    texts = {(i, lang): t for i, t, lang in rows if t is not None}
    ordered = [(lang, texts[i, lang]) for place, _, i, lang in sorted(turns, key=lambda x: (x[0], x[3], x[1])) if (i, lang) in texts]
    marks = [g for g in (plain_grams(t) for _, t in ordered[:landmarks]) if g]
    known = set().union(*marks)
    train = [(lang, g & known) for lang, t in ordered if (g := plain_grams(t))]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * len(b))
    k, own = np.array([[kernel(g, m) for m in marks] for _, g in train]), np.array([[kernel(a, b) for b in marks] for a in marks])
    langs = sorted({lang for lang, _ in train})
    values, sides = np.linalg.eigh(own)
    kept = values > 1e-6 * max(1, values.max())
    root = sides[:, kept] / np.sqrt(values[kept])
    y = np.array([[1.0 if x == lang else -1.0 for x in langs] for lang, _ in train])
    weight = np.array([1 / sum(x == lang for x, _ in train) for lang, _ in train])
    weight = np.sqrt(weight / weight.sum())[:, None]
    features = np.hstack([k @ root, np.ones((len(k), 1))])
    penalty = np.sqrt(np.diag([1e-2] * kept.sum() + [1e-8]))
    found, *_ = np.linalg.lstsq(np.vstack([features * weight, penalty]), np.vstack([y * weight, np.zeros((len(penalty), len(langs)))]), rcond=None)

    def predict(text):
        g = plain_grams(text)
        if not g:
            return "und", 0.0
        f = np.array([kernel(g & known, m) for m in marks]) @ root @ found[:-1] + found[-1]
        return langs[int(f.argmax())], float(min(1, max(0, (f.max() + 1) / 2)))

    return predict


def test_query_against_plain_kernels(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    predict, texts = plain_model(rows), {i: t for i, t, _ in rows}
    out = queries()["op11_language_id"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(r.held_out == is_held_out(r.doc_id) for r in got)
    for r in got:
        lang, score = predict(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_few_landmarks_against_plain_kernels(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    predict = plain_model(rows, landmarks=9, most_of_a_lang=20, most_rows=50)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    for r in languages.identify(docs, languages.learn(docs, landmarks=9, most_of_a_lang=20, most_rows=50)).collect():
        lang, score = predict(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries()["op11_language_id"](spark, sf).collect() if r.held_out]
    assert len(held) > 300 and sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.98 * len(held)


def test_awkward_rows(spark):
    texts = [(i, "der Hund und die Katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en", "a") for i in range(60)]
    more = [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, " 12 _ ½ 34\n", "en", "a"), (1003, "½ und die", None, "a"), (1004, "жук", "en", "a"), (None, "the cat and", "de", "a"), (1005, "w" * 2_000_000, "en", None), (1006, "the dog " * 200_000, "de", None)]
    docs = documents(spark, texts + more + more[:3] + texts[:9] * 4 + TEXTS)
    model = languages.learn(docs)
    assert model.langs == ["de", "en", "es"]
    out = languages.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "_score"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r._score <= 1 and r.score is None for r in rows)
    said = {(r.doc_id, r.text): (r.lang_pred, r._score) for r in rows}
    assert len(said) == len({(r.doc_id, r.text, r.lang_pred, r._score) for r in rows})
    assert all(said[i, t] == ("und", 0.0) for i, t, *_ in more[:3])
    assert said[1003, "½ und die"][0] == "de" and said[None, "the cat and"][0] == "en" and said[1004, "жук"][0] in model.langs and said[1006, more[7][1]][0] == "en"
    again = languages.learn(docs.repartition(7))
    assert again.places == model.places and (again.weights == model.weights).all()


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, "no letters? 12", None, "a")], [(2, "12 34", "en", "a")]):
        docs = documents(spark, rows)
        assert languages.learn(docs) is None
        assert [(r.lang_pred, r._score) for r in languages.identify(docs, None).collect()] == [("und", 0.0)] * len(rows)


def test_held_out_languages_are_not_seen(spark):
    ids = [i for i in range(40) if is_held_out(i)]
    docs = documents(spark, [(i, "una palabra", "xx", "a") for i in ids] + [(i, "a word", "en", "a") for i in range(40) if i not in ids])
    assert languages.learn(docs).langs == ["en"]


@pytest.mark.parametrize("most", [4, 9])
def test_samples_take_languages_in_turn(spark, most):
    docs = documents(spark, [(i, "t", "hot", "a") for i in range(300)] + [(1000 + i, "t", f"l{i % 3}", "a") for i in range(12)])
    taken = [r.lang for r in languages.drawn(docs, most, 5).collect()]
    assert len(taken) == most and len(set(taken)) == 4
    assert "lang string" in COLUMNS
