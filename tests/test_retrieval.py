import random

from pyspark.sql import functions as F

from lectern.operators import passages, retrieval
from lectern.plans import course

ITEM = "id string, pos long, title string, content string, scope string, priority string, aliases array<string>, source string"


def items(spark, *rows):
    return spark.createDataFrame([(r.get("id"), i, r.get("title", ""), r.get("content", ""), r.get("scope"), r.get("priority"), r.get("aliases"), r.get("source")) for i, r in enumerate(rows)], ITEM)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q_id long, question string")


def ids(ranked, k=9):
    return [r.id for r in retrieval.top(ranked, k).orderBy("q_id", "rank").collect()]


def test_scope(spark):
    rows = items(spark, {"id": "a", "content": "montaje paralelo"}, {"id": "b", "content": "montaje paralelo", "scope": "excluded"}, {"id": "c", "content": "montaje paralelo", "scope": "reference"})
    q = asked(spark, "montaje paralelo")
    assert ids(retrieval.rank(rows, q)) == ["a"]
    assert ids(retrieval.rank(rows, q, include_reference=True)) == ["a", "c"]


def test_priority_orders_equal_items_and_hides_none(spark):
    rows = items(spark, {"id": "n", "content": "ritmo"}, {"id": "c", "content": "ritmo", "priority": "context"}, {"id": "p", "content": "ritmo", "priority": "central"})
    assert ids(retrieval.rank(rows, asked(spark, "ritmo"))) == ["p", "n", "c"]


def test_aliases_phrases_and_silence(spark):
    rows = items(spark, {"id": "alias", "aliases": ["plano secuencia"]}, {"id": "phrase", "content": "un plano secuencia largo"}, {"id": "none", "content": "otra cosa"})
    ranked = {r.id: r.score for r in retrieval.rank(rows, asked(spark, "plano secuencia")).collect()}
    assert set(ranked) == {"alias", "phrase"}
    assert ranked["alias"] > ranked["phrase"]
    assert retrieval.rank(rows, asked(spark, "de la", "")).count() == 0


def test_context_helps_a_follow_up(spark):
    rows = items(spark, {"id": "x", "content": "sincresis une sonido"}, {"id": "y", "content": "encuadre fijo"})
    ranked = retrieval.rank(rows, asked(spark, "y eso?"), contexts=asked(spark, "hablemos de sincresis"))
    assert ids(ranked) == ["x"]


def test_alternatives_reach_other_wordings(spark):
    rows = items(spark, {"id": "src", "content": "acusmatica pura"})
    other = spark.createDataFrame([(0, 1, "acusmatica", 0.9)], "q_id long, alt int, question string, weight double")
    row = retrieval.rank(rows, asked(spark, "voz sin cuerpo"), alternatives=other).first()
    direct = retrieval.score(retrieval.normalized(retrieval.as_items(rows)), asked(spark, "acusmatica")).first().score
    assert abs(row.expanded - 0.7 * direct) < 1e-9


def test_long_items_come_once(spark):
    text = ". ".join(f"frase {i} sobre montaje" for i in range(300))
    rows = items(spark, {"id": "long", "content": text}, {"id": "short", "content": "montaje"})
    out = course.retrieve(asked(spark, "montaje"), rows)
    assert sorted(r.id for r in out.collect()) == ["long", "short"]


def test_evidence_follows_the_corpus(spark):
    corpus = items(spark, {"id": "1", "scope": "excluded"}, {"id": "2", "priority": "central", "source": "s2"}, {"id": "3", "scope": "reference"})
    entries = spark.createDataFrame([(1, [("1",), ("2",)]), (2, [("1",)]), (3, [("3",), ("zz",)])], "entry_id long, evidence array<struct<source_id: string>>")
    out = {r.entry_id: (r.scope, r.priority, r.n_evidence) for r in retrieval.live_evidence(entries, corpus, include_reference=True).collect()}
    assert out == {1: ("included", "central", 1), 3: ("reference", "normal", 1)}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = retrieval.live_evidence(entries, corpus)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_cuts_cover_the_text():
    text = " ".join(f"palabra{i}" for i in range(900))
    parts = list(passages.retrieval_cuts(text))
    assert all(len(p) <= 1101 for p in parts) and parts[0] == text[: len(parts[0])] and text.endswith(parts[-1])
    assert all(p in text for p in parts)
    assert list(passages.retrieval_cuts("corto ")) == ["corto "]
    assert list(passages.index_cuts("  ")) == []


def test_prompt_context_keeps_budgets(spark):
    hits = spark.createDataFrame([(0, p, 2, str(p), 1.0) for p in range(1, 9)], "q_id long, place int, kind int, id string, score double")
    texts = spark.createDataFrame([(2, str(p), "x " * 600) for p in range(1, 9)], "kind int, id string, text string")
    out = course.prompt_context(hits, texts).collect()
    assert [r.kind for r in out] == ["corpus"] and len(out[0].context) <= 3000 + 2 * 7


def plain_bonus(item, phrase):
    heads, body, names = item
    return (10 if phrase in heads else 0) + (4 if phrase in body else 0) + 6 * sum(len(a) >= 3 and a in phrase for a in names)


def test_phrases_and_names_are_found_within_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.choice((1, 2, 3, 4, 7))))
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    cut = lambda t: t[(k := rng.randrange(max(1, len(t) - 8))) : k + rng.randint(3, 16)].strip()
    rows = [{"id": str(i), "title": word(), "content": t, "aliases": [cut(rng.choice(texts)) for _ in range(3)] + [word()]} for i, t in enumerate(texts)]
    questions = [cut(rng.choice(texts)) for _ in range(300)] + ["abc", "x" * 300 + "abc", "", "de la"]
    known = retrieval.normalized(retrieval.as_items(items(spark, *rows)))
    got = {(r.q_id, r.pos): r.bonus for r in retrieval.phrase_hits(known, asked(spark, *questions), block=40).collect()}
    heads = [f"{r['title']} {' '.join(r['aliases'])}" for r in rows]
    terms = {r.q_id for r in retrieval.question_terms(asked(spark, *questions)).collect()}
    want = {(q, i): plain_bonus((heads[i], r["content"], r["aliases"]), text) for q, text in enumerate(questions) if q in terms for i, r in enumerate(rows)}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 300


def test_no_nested_loops(spark):
    from lectern.operators import analytics

    rows = items(spark, {"id": "a", "content": "plano secuencia", "aliases": ["plano"]})
    texts, names = rows.select(F.col("id").alias("key"), F.col("content").alias("text")), spark.createDataFrame([("plano",), ("cuen",)], "name string")
    for df in (retrieval.rank(rows, asked(spark, "plano secuencia"), contexts=asked(spark, "plano")), analytics.named_concepts(texts, names)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert sorted(r.concept for r in analytics.named_concepts(texts, names).collect()) == ["cuen", "plano"]


def test_empty_tables(spark):
    nothing = items(spark).limit(0)
    assert retrieval.rank(nothing, asked(spark, "algo")).count() == 0
    assert retrieval.rank(items(spark, {"id": "a", "content": "algo"}), asked(spark, "algo").limit(0)).count() == 0
    assert F is not None


def test_words_of_megabytes_are_searched_in_stretches(spark):
    import random
    import time

    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    longs = [letters(n) for n in (255, 256, 257, 300, 70_000)]
    parts = [w[a : a + n] for w in longs for a, n in ((0, 3), (len(w) - 4, 4), (len(w) // 2, 5), (len(w) // 2, 40), (250, 9), (65_530, 12))] + ["x", "abcdabcdabcdx", letters(9), "d"]
    df = lambda rows, name: spark.createDataFrame([(r,) for r in dict.fromkeys(rows) if r], f"{name} string")
    got = {(r.word, r.part) for r in retrieval.words_around(df(longs + ["short"], "word"), df(parts, "part")).collect()}
    assert got == {(w, p) for w in longs + ["short"] for p in set(parts) if p and p in w}
    huge = letters(2_900_000) + "zebra"
    start = time.time()
    assert [r.part for r in retrieval.words_around(df([huge], "word"), df(["zebra", "zebras"], "part")).select("part").collect()] == ["zebra"]
    assert time.time() - start < 60


def test_items_are_merged_with_scores_not_broadcast(spark):
    rows = items(spark, {"id": "a", "content": "plano secuencia", "aliases": ["plano"]})
    assert "strategy=merge" in retrieval.rank(rows, asked(spark, "plano secuencia"))._jdf.queryExecution().optimizedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_texts_are_not_moved_for_names_and_phrases(spark):
    from lectern.operators import analytics

    rows = items(spark, {"id": "a", "content": "el plano secuencia largo"}, {"id": "b", "content": "otro plano"}, {"id": "b", "content": "otro plano"})
    texts, names = rows.select(F.col("id").alias("key"), F.col("content").alias("text")), spark.createDataFrame([("plano",), ("plano",), ("o secuencia l",), ("ano secu",)], "name string")
    found = analytics.named_concepts(texts, names)
    assert "SortMergeJoin" not in plan_of(found)
    assert sorted((r.key, r.concept) for r in found.collect()) == [("a", "ano secu"), ("a", "o secuencia l"), ("a", "plano"), ("b", "plano"), ("b", "plano")]
    known = retrieval.normalized(retrieval.as_items(rows))
    assert "SortMergeJoin" not in plan_of(retrieval.shares(known, asked(spark, "el plano secuencia largo")))


def test_best_is_the_top_of_rank(spark):
    rng = random.Random(3)
    words = ["plano", "secuencia", "montaje", "luz", "cámara", "sonido", "ritmo"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"i{k}", k, said(2), [rng.choice(words)], said(rng.choice((0, 5, 400))), rng.choice(("central", "context", None)), rng.choice(("included", "excluded"))) for k in range(40)]
    items = course.passages_of(spark.createDataFrame(rows, "id string, pos int, title string, aliases array<string>, content string, priority string, scope string"))
    questions = spark.createDataFrame([(q, said(3)) for q in range(6)], "q_id int, question string")
    before = spark.createDataFrame([(q, said(4)) for q in range(0, 6, 2)], "q_id int, question string")
    other = spark.createDataFrame([(q, a, said(1), 0.3 * a) for q in range(5) for a in (1, 2, 3)], "q_id int, alt int, question string, weight double")
    for more in ({}, {"contexts": before, "alternatives": other}):
        ranked = retrieval.rank(items, questions, **more)
        shown = lambda df: sorted((r.q_id, r["rank"], r.id, tuple(r.pos), *(round(r[c], 6) for c in ("direct", "contextual", "expanded", "score"))) for r in df.collect())
        assert shown(retrieval.best(items, questions, 3, **more)) == shown(retrieval.top(ranked, 3))
        assert shown(retrieval.best(items, questions, 3, per_item=True, **more)) == shown(retrieval.top(retrieval.best_per_item(ranked), 3))


def test_passages_stay_in_their_row_and_pairs_where_they_are_made(spark):
    rows = spark.createDataFrame([("a", 1, "t", "plano. " * 500), ("b", 2, "t", "  "), ("c", 3, "t", None)], "id string, pos int, title string, content string")
    items = course.passages_of(rows)
    assert "Join" not in items._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, tuple(r.pos), r.content) for r in items.collect()] == [("a", (1, n), x) for n, x in enumerate(passages.retrieval_cuts("plano. " * 500))]
    found = retrieval.best(items, spark.createDataFrame([(1, "plano"), (2, "secuencia")], "q_id int, question string"), 1, per_item=True)
    assert [(r.q_id, r.id) for r in found.collect()] == [(1, "a")]
    # Terms, names and phrases are dealt by item; of the pairs only each task's best go on, to their question.
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(id#" in line for line in moved)
    assert not any("hashpartitioning(q_id#" in line and ", pos#" in line.split("hashpartitioning(")[1].split(")")[0] for line in moved), moved


def test_wordings_that_questions_share_are_scored_once(spark, monkeypatch):
    scored, plain = [], retrieval.dealt_shares
    monkeypatch.setattr(retrieval, "dealt_shares", lambda known, n, questions, tasks: (scored.append(questions.count()), plain(known, n, questions, tasks))[1])
    other = spark.createDataFrame([(0, 1, "montaje", 0.5), (1, 1, "montaje", 0.2), (1, 4, "montaje", 0.9)], "q_id long, alt int, question string, weight double")
    found = retrieval.best(items(spark, {"id": "a", "content": "montaje"}), asked(spark, "plano", "luz"), 1, alternatives=other).collect()
    assert scored == [2, 1]
    told = {r.q_id: r.expanded for r in found}
    assert abs(told[1] / told[0] - 0.7 / 0.5) < 1e-9
