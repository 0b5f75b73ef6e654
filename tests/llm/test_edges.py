"""Every operator on awkward rows and on an empty table."""

from collections import Counter

import pytest
from rows import TEXTS, documents

import corpus_pipeline
from lectern.llm import decontamination, licences, mixing, pii, quality, sharding, simhash, suffix_dedup, token_counts, toxicity

N = len(TEXTS)


def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs", 0), (2, "solo", 0), (3, None, 0), (None, "", 0), (4, "solo", 0)], "item_id long, text string, n_words int")


def files(df):
    return df.drop("path").withColumn("path", licences.document_path())


OPERATORS = {
    "sharding": lambda spark, df: sharding.interleave(df),
    "simhash": lambda spark, df: simhash.near_duplicates(df),
    "pii": lambda spark, df: pii.find_personal(df),
    "quality": lambda spark, df: quality.judge(df),
    "suffix": lambda spark, df: suffix_dedup.repeated_spans(df),
    "mixing": lambda spark, df: mixing.mix(df),
    "licences": lambda spark, df: licences.scan(files(df)),
    "decontamination": lambda spark, df: decontamination.find_leaks(df, items(spark)),
    "tokens": lambda spark, df: token_counts.token_counts(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, documents(spark))
    rows = out.collect()
    assert len(rows) == N
    if "doc_id" in out.columns:
        assert Counter(r.doc_id for r in rows) == Counter(t[0] for t in TEXTS)
    assert OPERATORS[name](spark, documents(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    labelled = spark.createDataFrame([("you vile fool", 1), ("a calm walk", 0), (None, 0), ("", 1), ("odd", None)], "text string, toxic int")
    return toxicity.train(labelled)


def test_toxicity(spark, model):
    out = toxicity.score(documents(spark), model)
    assert out.columns == [*documents(spark).columns, "_score"]
    rows = out.collect()
    assert len(rows) == N and all(0 <= r._score <= 1 and r.score is None for r in rows)
    assert len({r._score for r in rows if not (r.text or "").strip()}) == 1
    alike = [r._score for r in rows if r.text == "solo"]
    assert len(alike) == 3 and len(set(alike)) == 1
    nothing = toxicity.train(spark.createDataFrame([], "text string, toxic int"))
    assert {r._score for r in toxicity.score(documents(spark), nothing).collect()} == {0.5} and toxicity.below(documents(spark).limit(0), nothing).count() == 0


def test_toxicity_learns_from_awkward_rows(spark):
    docs, kind = documents(spark, [(i, "you vile fool" if i % 2 else "a calm walk", "en", "a") for i in range(60)] + [(None, "vile", "en", "a"), (7, None, "en", "a"), (8, "", "en", "a"), (9, "you vile fool", "en", "a")]), "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(9, 0, 0), (9, 0, 1), (None, 0, 1), (11, 1, None), (13, 1, 5), (999, 0, 1)], kind)
    folded = toxicity.learn(docs, labels).folded()
    bad, calm, empty = (toxicity.Scorer(*folded)(t) for t in ("you vile fool", "a calm walk", None))
    assert bad > 0.9 and calm < 0.1 and 0 <= empty <= 1
    again = toxicity.learn(docs.repartition(5), labels.repartition(3)).folded()
    assert (again[0] == folded[0]).all() and again[1] == folded[1]
    for d, l in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs.limit(0), labels.limit(0))):
        assert toxicity.Scorer(*toxicity.learn(d, l).folded())("you vile fool") == 0.5


def test_toxicity_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)], "draw long, toxic int, text string")
    assert not toxicity._fit(rows, most_bytes=0).folded()[0].any()
    size = len(toxicity._bag(rows.first().text.split(), {})[0]) * 4
    some, all_rows = toxicity._fit(rows, most_bytes=9 * size).folded(), toxicity._fit(rows).folded()
    first = toxicity._fit(rows.filter("draw < 8")).folded()
    assert (some[0] == first[0]).all() and not (some[0] == all_rows[0]).all()


def test_pipeline_on_awkward_tables(spark, tmp_path):
    columns = "doc_id", "text", "lang", "source", "n_chars"
    docs = documents(spark).select(*columns)
    tables = {"documents": docs, "benchmark": items(spark), "labels": spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")}
    for folder, few in (("some", False), ("none", True)):
        for name, table in tables.items():
            (table.limit(0) if few else table).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{folder}").collect()
        assert bool(rows) != few
        assert {r.doc_id for r in rows} <= {t[0] for t in TEXTS}


def test_stages_keep_columns(spark, model):
    docs = documents(spark)
    for out in (toxicity.below(docs, model), simhash.keep_one(docs), decontamination.decontaminate(docs, items(spark)), mixing.mixed(docs)):
        assert out.columns == docs.columns
        assert out.count() <= 3 * N
    empty = docs.limit(0)
    for out in (simhash.keep_one(empty), decontamination.decontaminate(empty, items(spark)), mixing.mixed(empty)):
        assert out.count() == 0


def test_one_of_each_group_stays(spark):
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(documents(spark)).collect()]
    assert len(kept) == len(set(kept))
    assert sum(not (t or "").strip() for _, t in kept) == 1 and (5, "solo") in kept and (6, "solo") not in kept


def test_mix_repeats_rows(spark):
    docs = documents(spark, [(i, "w " * n, "en", s) for i, (n, s) in enumerate([(100, "a"), (5, "b"), (5, "b"), (7, None)])])
    taken = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    assert Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect()) == Counter({k: n for k, n in taken.items() if n})


def test_stages_are_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
