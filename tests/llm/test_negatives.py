"""Hard negatives against all scores, sorted, in plain Python."""

import math
import random

import pytest

from lectern.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long, window long, width int, vector string, score long, rank int, most long"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA)


def plain(rows, every=100, low=80, high=100, k=5):
    parts = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        parts.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out = []
    for a, (anchor, va, la) in enumerate(parts):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i is None, i or 0, r, label) for r, (i, v, label) in enumerate(parts) if r != a))
        for s, none, i, *_ in [x for x in scored if x[4] == la][:k]:
            near = [x for x in scored if x[4] != la and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(anchor, None if none else i, n + 1, None if x[1] else x[2], -s, -x[0]) for n, x in enumerate(near)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in frame.collect()), key=str)


def vectors(n, dim=6, seed=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.4) for _ in range(dim)], rng.randrange(4)) for i in range(n)]


def test_awkward_rows(spark):
    rows = vectors(260) + [(500, None, 1), (501, [0.1] * 6, None), (502, [0.1, None, 0.2], 1), (503, [math.nan] * 6, 1), (504, [math.inf] * 6, 2), (None, [0.9] * 6, 1), (None, [0.9] * 6, 2), (-700, [0.5] * 6, 3), (600, [], 2), (601, [0.7], 2), (602, [0.2] * 9, 2)]
    rows += rows[:30] + rows[95:105]
    assert got(negatives.hard_negatives(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("few", [48, 0])
def test_one_vector_in_a_third_of_the_rows(spark, monkeypatch, few):
    monkeypatch.setattr(negatives, "FEW", few)
    hot = [0.6, -0.2, 0.5, 0.1, 0.3, 0.4]
    rows = [(i * 977 - 40_000, hot if i % 3 == 0 else v, label) for i, v, label in vectors(700)] + [(100, hot, 0), (1 << 62, hot, 1)]
    random.Random(1).shuffle(rows)
    assert got(negatives.hard_negatives(table(spark, rows).repartition(5), every=100)) == plain(rows)


def test_blocks_agree(spark):
    rows = vectors(300)
    want = plain(rows, every=10)
    assert got(negatives.hard_negatives(table(spark, rows), every=10, most_anchors=7)) == want
    assert got(negatives.hard_negatives(table(spark, rows), every=10, most_bytes=100)) == want


def test_large_components(spark):
    rows = [(i, [x * 10**k for x in v], label) for k in (0, 4, 6) for i, v, label in vectors(60, seed=k)]
    assert got(negatives.hard_negatives(table(spark, rows), every=5)) == plain(rows, every=5)
    with pytest.raises(Exception, match="long"):
        negatives.hard_negatives(table(spark, [(0, [1e30], 1), (1, [1.0], 1)]))


def test_empty_table(spark):
    for rows in ([], [(0, None, 1)], [(1, [0.5], 1)], [(0, [0.5], 1)]):
        assert got(negatives.hard_negatives(table(spark, rows))) == []
