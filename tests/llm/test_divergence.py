"""Divergences of sources against SQL over every kept term, and on awkward tables."""

import random

import duckdb
import pandas as pd
from rows import documents

from lectern.llm import divergence
from same import assert_same


def by_sql(docs, least=10):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([tuple(r) for r in docs.select("text", "lang", "source").collect()], columns=["text", "lang", "source"]).astype(object).where(lambda x: x.notna(), None))
    return con.sql(divergence.OP12_SQL.replace(">= 10", f">= {least}")).df()


def texts(n, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "straße", "Ñandú", "日本語", "x", "É", "é"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "!", "1", "\x00", "-"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""])) for i in range(n)]
    rows += [(i, None, "en", "silent") for i in range(3)] + [(9, "", "fr", "only"), (9, " \t1", "fr", None), (None, None, None, None)]
    return rows + rows[:40] + [(777, "long " * 60_000 + "z" * 300_000, "en", "a")]


def test_against_sql_on_awkward_rows(spark):
    docs = documents(spark, texts(300))
    got = divergence.divergence(docs).toPandas()
    assert_same(got, by_sql(docs))
    assert set(got[got.lang == "fr"].value) == {0} and set(got[got.lang == "fr"].source) == {"only", ""}
    assert "silent" in set(got[got.part == "pair"].source) and "silent" not in set(got[got.part == "term"].source)
    assert_same(divergence.divergence(docs, least_docs=1).toPandas(), by_sql(docs, 1))


def test_tallies_handed_on_early_add_up(spark, monkeypatch):
    docs = documents(spark, texts(120))
    whole = divergence.divergence(docs, least_docs=2).toPandas()
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    import pyarrow as pa

    seen = []

    class Rows:
        """What the operator's map sees, run in this process so that the small limit holds."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for t, _, _ in rows]), pa.array([x or "" for _, x, _ in rows]), pa.array([x or "" for _, _, x in rows])], names=["body", "lang", "source"])
            seen.extend(run(iter([batch])))
            return spark.createDataFrame(pa.Table.from_batches(seen).to_pandas(), "lang string, source string, term binary, n long, n_docs long")

        __getitem__ = lambda self, name: documents(spark, [])[name]

    told = divergence.count_terms(Rows()).toPandas()
    assert len(seen) > 50
    plain = divergence.count_terms(docs).toPandas()
    key = lambda df: {(r.lang, r.source, bytes(r.term), r.n, r.n_docs) for r in df.itertuples()}
    assert key(told) == key(plain) and len(whole)


def test_empty_table(spark):
    assert divergence.divergence(documents(spark, [])).count() == 0


def test_counts_beyond_longs(spark):
    row = spark.sql("SELECT 12345678901234 AS n, 98765432109876 AS total, 1000 AS terms").select(divergence.share("n", "total", "terms").alias("p")).first()
    assert row.p == 1 + 10**9 * (12345678901234 + 2) // (98765432109876 + 2000)
