"""Operators do the whole job, whatever the sizes of tables and groups."""

import random
from collections import Counter

from rows import documents

import numpy as np

from lectern.llm import decontamination, pii, quality, sharding


def test_rare_kinds_are_learnt_beside_frequent_ones(spark):
    many = [(i, " ".join(f"call 555-{i % 900 + 100}-{1000 + k} now" for k in range(40)), "en", "a") for i in range(500)]
    rare = [(1000 + i, f"api_key = {'9f86d081884c7d659a2feaa0c55ad015'[i:]}{'a3bf4f1b2b0b822cd15d6c15b0f00a08'[:i]}", "en", "a") for i in range(4)]
    proposed = pii.propose(documents(spark, many + rare)).cache()
    drawn = pii._drawn(proposed.selectExpr("doc_id", "inline(proposed)"), 8).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in drawn} == {"phone": 8, "secret": 4}
    assert set(pii.learn(proposed, most_spans=8)) == {"phone", "secret"}
    found = pii.find_personal(documents(spark, many + rare), most_spans=8).filter("doc_id >= 1000").collect()
    alone = pii.find_personal(documents(spark, rare)).collect()
    assert sorted((r.doc_id, r.spans) for r in found) == sorted((r.doc_id, r.spans) for r in alone) and all(r.spans for r in found)


def test_small_groups_are_judged(spark):
    rng = random.Random(3)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(80, 300))) for _ in range(300)]
    odd = " ".join(f"{i}#$%&#$%&{'z' * 50}" for i in range(100))
    texts = [(i, t, ("en", "de", None)[i % 3], f"s{i}" if i % 2 else None) for i, t in enumerate(plain)]
    texts += [(300, odd, "en", "tail"), (301, odd, None, "tail"), (302, odd, "nl", "tail"), (303, plain[0], "nl", None)]
    out = {r.doc_id: r for r in quality.judge(documents(spark, texts)).collect()}
    assert not any(out[i].kept for i in (300, 301, 302)) and out[303].kept
    assert all(r.d2 is not None for r in out.values()) and sum(r.kept for r in out.values()) >= 297


def test_large_groups_are_judged_by_themselves(spark):
    rng = random.Random(4)
    text = lambda low, high: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(low, high))) for _ in range(rng.randint(80, 300)))
    own = [(i, text(3, 7), "en", "a") for i in range(60)]
    more = [(100 + i, text(30, 40), "en", f"s{i}") for i in range(200)]
    out = {r.doc_id: (r.d2, r.kept) for r in quality.judge(documents(spark, own + more)).collect()}
    alone = {r.doc_id: (r.d2, r.kept) for r in quality.judge(documents(spark, own)).collect()}
    assert all(abs(out[i][0] - alone[i][0]) < 1e-6 and out[i][1] == alone[i][1] for i in alone)


def test_many_automata_cut_as_one(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    body = [[word() for _ in range(30)] for _ in range(8)]
    items = [(i, " ".join(w)) for i, w in enumerate(body)]
    items += [(10 + i, " ".join(w[22:] + [word() for _ in range(4)])) for i, w in enumerate(body)]  # overlaps the end of another item
    texts = []
    for i in range(8):
        for j in range(8):
            rest = [word() for _ in range(40)]
            texts.append((len(texts), " ".join(rest[:20] + body[i] + rest[20:] + body[j]), "en", "a"))  # 30 of 100 words from either
            texts.append((len(texts), " ".join(rest + body[i] + items[8 + i][1].split()[-4:] + rest), "en", "a"))
    texts += [(None, None, "en", "a"), (500, "", "en", "a"), *texts[:2]]
    docs, table = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontamination.item_groups(table, most_words=120))) > 2
    one, many = (Counter((r.doc_id, r.text, r.n_chars) for r in decontamination.decontaminate(docs, table, most_words=n).collect()) for n in (400_000, 120))
    assert one == many and (0, texts[0][1], len(texts[0][1])) not in one and len(one) > 60


def test_many_automata_cut_as_one_in_whole_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = (Counter(map(tuple, decontamination.decontaminate(docs, items, most_words=n).collect())) for n in (400_000, 300))
    assert one == many


def test_long_items_are_cut_into_pieces(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    items = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(long[100:112])), *((10 + i, f"short {i} item") for i in range(400)), (5, None), (6, "")], "item_id long, text string")
    groups = list(decontamination.item_groups(items, most_words=1000))
    assert len(groups) > 5 and all(sum(len(w) for _, w in g) <= 1000 for g in groups)
    assert [len(w) for g in decontamination.item_groups(items.filter("item_id = 1"), most_words=4) for _, w in g] == [10, 10, 10]
    texts = [(i, " ".join(["x"] * i + long[k : k + n] + ["y"]), "en", "a") for i, (k, n) in enumerate([(0, 9), (0, 10), (985, 30), (990, 10), (991, 10), (4990, 10), (4991, 9), (100, 12), (0, 5000)])]
    texts += [(50 + i, f"a short {i} item here", "en", "a") for i in range(5)] + [(None, None, None, None)]
    docs, rows = documents(spark, texts), lambda most: sorted((r.doc_id or -1, r.n_words, sorted(map(tuple, r.runs)), sorted(r["items"])) for r in decontamination.find_leaks(docs, items, most_words=most).collect())
    assert rows(1000) == rows(400_000) and rows(3000) == rows(400_000)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcde") + rng.choice("xyz") for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 400)] + [" ".join(f"w{i}" for i in range(20_000)), " ".join(f"w{i % 7000}" for i in range(15_000)), "a a a a", None]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])

    def plain(text):
        words = (text or "").split()
        seen = Counter(zip(words, words[1:], words[2:]))
        return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)})

    want = {i: plain(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_repeat_words for r in quality.statistics(docs).collect()} == want
    few = quality._window_hash
    monkeypatch.setattr(quality, "_window_hash", lambda words, i: F.shiftleft(few(words, i).bitwiseAND(F.lit(255).cast("long")), 55))
    assert {r.doc_id: r.n_repeat_words for r in quality.statistics(docs).collect()} == want


def plain_distances(points):
    """Squared distances by a plain minimum covariance determinant: from the medians, steps until the half no longer changes."""
    least = np.diag(np.array(list(quality.COORDINATES.values())) ** 2)
    d2 = (((points - np.median(points, axis=0)) ** 2) / np.diag(least)).sum(axis=1)
    half = None
    for _ in range(100):
        now = np.argsort(d2, kind="stable")[: -(-len(points) // 2)]
        if half is not None and set(now) == set(half):
            break
        half = now
        off = points - points[half].mean(axis=0)
        d2 = np.einsum("ni,ij,nj->n", off, np.linalg.inv(np.cov(points[half].T, bias=True) / quality.SHORT_5 + least), off)
    return d2


def test_verdicts_are_those_of_a_plain_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge(docs.withColumn("source", docs.lang)).collect()  # a group a language: large ones, judged by themselves
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    checked, rejected = 0, 0
    for lang in set(langs.values()):
        mine = [r for r in rows if langs[r.doc_id] == lang and not r.base_failed]
        assert len(mine) >= quality.FEWEST
        share = [r.n_repeat_words / r.n_words for r in mine]
        points = np.array([(np.log(r.n_words), np.log(r.word_chars / r.n_words), np.log1p(10 * r.n_symbols / r.n_words), np.log1p(r.n_dup_lines), np.arcsin(np.sqrt(x))) for r, x in zip(mine, share)])
        for r, d2 in zip(mine, plain_distances(points)):
            if abs(np.log(d2 / quality.LIMIT_5)) > 0.25:  # bins of distances make the half a little larger
                assert r.kept == (d2 <= quality.LIMIT_5), (r, d2)
                checked += 1
                rejected += not r.kept
    assert checked > 0.97 * sum(not r.base_failed for r in rows) and rejected > 10


def test_native_plans_have_no_python(spark, sf):
    for query in (quality.op5_quality, sharding.op1_sharding):
        plan = query(spark, sf)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def planted_texts(rng, n):
    """(text, personal spans) with spelt-out addresses, local numbers, keys and names, beside what only looks like them."""
    word = lambda low=3, high=8: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    surname = lambda: word(5, 9).capitalize()
    personal = [
        lambda: ("email ", f"{word()} (at) {word()} (dot) com", " soon"), lambda: ("write to ", f"{word()}.{word()} [at] {word()} [dot] org", ""),
        lambda: ("call ", f"({rng.choice((212, 415, 310))}) 555-{digits(4)}", " now"), lambda: ("phone: ", f"030 {digits(4)} {digits(4)}", ""),
        lambda: ('api_key = "', hexes(40), '"'), lambda: ("token: ", f"ghp_{hexes(36)}", ""), lambda: ("password = ", f"{hexes(12)}Xq{hexes(12)}", ""),
        lambda: ("signed by ", f"{rng.choice(sorted(pii.GIVEN_NAMES))} {surname()}", " today"), lambda: ("we met Dr. ", f"{surname()} {surname()}", " there"), lambda: ("and Frau ", f"{surname()} {surname()}", " said"),
    ]
    decoys = [
        lambda: f"on {2000 + rng.randint(0, 24)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} it", lambda: f"pages {rng.randint(10, 99)}-{rng.randint(100, 999)} of", lambda: f"version {digits(2)}.{digits(2)}.{digits(3)}",
        lambda: word(20, 26), lambda: f"the {surname()} {surname()} fell", lambda: f"end. {surname()} {surname()} fell", lambda: f"arrived at {word()}.{word(2, 3)} by", lambda: f"year {digits(4)} {digits(4)}",
    ]
    texts = []
    for _ in range(n):
        text, spans = word(), set()
        for _ in range(6):
            text += " " + " ".join(word() for _ in range(rng.randint(4, 9))) + " "
            if rng.random() < 0.3:
                before, span, after = rng.choice(personal)()
                spans.add((len(text + before), len(text + before + span)))
                text += before + span + after
            else:
                text += rng.choice(decoys)()
        texts.append((text, spans))
    return texts


def test_added_spans_are_right(spark):
    texts = planted_texts(random.Random(11), 1500)
    out = pii.find_personal(documents(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(texts)])).collect()
    found = {(r.doc_id, s.start, s.end) for r in out for s in r.spans}
    planted = {(i, a, b) for i, (_, spans) in enumerate(texts) for a, b in spans}
    precision, recall = len(found & planted) / len(found), len(found & planted) / len(planted)
    assert precision > 0.95 and recall > 0.95, (precision, recall)


def test_clean_texts_get_no_spans(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 24)))
    texts = [". ".join(f"{word().capitalize()} {word().capitalize()} {word()} {word()} {word()}" for _ in range(20)) for _ in range(200)]
    assert not any(r.spans for r in pii.find_personal(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect())
