"""Row numbers in ranges, and what is built on them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import ranks
from lectern.streaming import state


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(800)]
    return spark.createDataFrame(data, "g string, o long, id long").repartition(6)


def test_places_and_sizes(rows):
    got = ranks.numbered(rows, "g", "o", size="n").collect()
    assert len(got) == 800
    for g, n in Counter(r.g for r in got).items():
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.nth)
        assert [r.nth for r in mine] == list(range(1, n + 1)) and {r.n for r in mine} == {n}
        assert [-1 if r.o is None else r.o for r in mine] == sorted(-1 if r.o is None else r.o for r in mine)
    assert ranks.numbered(rows.limit(0), "g", "o").count() == 0


def test_even_sample_has_both_ends(rows):
    got = ranks.even_sample(rows.withColumn("o", F.col("id")), "g", "o", 4).collect()
    for g, n in Counter(r.g for r in got).items():
        ids = sorted(r.id for r in rows.collect() if r.g == g)
        assert sorted(r.id for r in got if r.g == g) == [ids[int(j * (len(ids) - 1) / 3 + 0.5)] for j in range(4)]


def test_rolling_sums_across_slices(spark):
    rng = random.Random(5)
    data = [(i, f"m{rng.randrange(2)}", rng.randrange(2_000), rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, model string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    for span in (1, 60, 100, 3600):
        got = {r.id: r.window_tokens for r in state.rolling_tokens(df, slice_seconds=span).collect()}
        assert got == {i: sum(t for _, n, x, t in data if n == m and s - 60 <= x <= s) for i, m, s, _ in data}
