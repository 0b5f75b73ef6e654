"""Alignments against every one that is possible; strategies on documents that call for each."""

import random
from itertools import combinations

import pytest

from lectern.operators import boundaries as B

KINDS = {
    "documents": "doc long, pages long", "contents": "doc long, first_page long, last_page long, confidence double", "entries": "doc long, nth long, title string, number string, level int, printed long",
    "outline": "doc long, nth long, title string, level int, page long", "headings": "doc long, page long, line long, title string, number string, level int, score double, confidence double",
}


def best_alignment(pairs):
    """Highest sum over all sets of pairs that keep the order."""
    most = 0
    for n in range(len(pairs) + 1):
        for some in combinations(sorted(pairs), n):
            if all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(some, some[1:])):
                most = max(most, sum(w for *_, w in some))
    return most


def test_alignments_add_up_to_most(spark):
    rng = random.Random(5)
    docs = {d: list({(rng.randrange(5), rng.randrange(4)): 0 for _ in range(rng.randint(1, 9))}) for d in range(25)}
    rows = [(d, e, at, rng.randint(1, 9) / 10) for d, some in docs.items() for e, at in some]
    got = B.aligned(spark.createDataFrame(rows, "doc long, nth long, at long, score double")).collect()
    for d in docs:
        mine = sorted((r.nth, r.at, round(r.score * 10)) for r in got if r.doc == d)
        assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(mine, mine[1:])) and set(mine) <= {(e, at, round(s * 10)) for dd, e, at, s in rows if dd == d}
        assert sum(w for *_, w in mine) == best_alignment([(e, at, round(s * 10)) for dd, e, at, s in rows if dd == d])


def choose(spark, **rows):
    tables = [spark.createDataFrame(rows.get(k, []), kind) for k, kind in KINDS.items()]
    found, documents = B.choose_boundaries(*tables)
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0] or 0, *r[2:4])), {r.doc: r for r in documents.collect()}


def heading(doc, page, line, title, number="", score=8.0, confidence=0.8):
    return (doc, page, line, title, number, 1, score, confidence)


TITLES = ["Origins of the school", "Methods and materials", "Listening in practice", "Conclusions of the author"]


def test_each_document_takes_its_first_strategy_that_holds(spark):
    entries = [(d, n, t, "", 1, 10 * n + 5) for d in (1, 5, 6) for n, t in enumerate(TITLES)]
    headings = [heading(1, 10 * n + 8, 1, t) for n, t in enumerate(TITLES)] + [heading(2, 7, 3, TITLES[0])] + [heading(3, p, 2, f"Looks {p}", score=9.5) for p in (3, 9)]
    headings += [heading(5, 30, 1, TITLES[0]), heading(5, 31, 1, "odd one"), heading(5, 32, 1, "odd two")]  # one of four entries is confirmed
    headings += [heading(6, 10 * n + 1, 1, t) for n, t in enumerate(TITLES[:3])]  # the list stands behind the body
    outline = [(2, 0, TITLES[0], 1, 6), (2, 1, TITLES[1], 1, 12), (2, 2, "Past the end", 1, 400), (1, 0, "Unused", 1, 3), (1, 1, "Unused too", 1, 4)]
    found, docs = choose(spark, documents=[(i, 60) for i in (1, 2, 3, 4, 5)] + [(6, 50), (6, 50), (None, 3), (7, None)], contents=[(1, 2, 3, 0.8), (5, 2, 3, 0.8), (6, 45, 46, 0.7)], entries=entries, outline=outline, headings=headings)
    assert {d: r.strategy for d, r in docs.items()} == {1: "contents", 2: "outline", 3: "looks", 4: "whole", 5: "whole", 6: "contents"}
    assert [r[2:5] for r in found if r[0] == 1] == [(8, 1, TITLES[0]), (18, 1, TITLES[1]), (28, 1, TITLES[2]), (38, 1, TITLES[3])]
    assert [r[2:5] for r in found if r[0] == 2] == [(7, 3, TITLES[0]), (12, 0, TITLES[1])]
    assert docs[1].confirmed_share == 1 and docs[6].confirmed == 3 and docs[6].boundaries == 3 and docs[2].confirmed_share == 0.5
    assert [r[4] for r in found if r[0] in (4, 5)] == [B.WHOLE_TITLE] * 2


def test_pages_never_go_back(spark):
    entries = [(1, n, t, "", 1, 10 * n + 5) for n, t in enumerate(TITLES)]
    headings = [heading(1, 50, 1, TITLES[0], confidence=0.99), heading(1, 6, 1, TITLES[0], confidence=0.1)] + [heading(1, 10 * n + 5, 1, t) for n, t in enumerate(TITLES) if n]
    found, docs = choose(spark, documents=[(1, 60)], contents=[(1, 2, 3, 0.9)], entries=entries, headings=headings)
    assert [r[2] for r in found] == [6, 15, 25, 35] and docs[1].boundaries == 4


@pytest.mark.parametrize("rows", [{}, {"documents": [(1, 5)]}])
def test_without_rows(spark, rows):
    found, docs = choose(spark, **rows)
    assert len(found) == len(docs) == len(rows.get("documents", []))


def test_alignment_of_thousands_of_pairs(spark):
    import time

    rng = random.Random(6)
    rows = sorted({(rng.randrange(900), rng.randrange(900)) for _ in range(5_000)})
    rows = [(1, n, at, rng.randint(1, 9) / 10) for n, at in rows]
    began = time.monotonic()
    got = B.aligned(spark.createDataFrame(rows, "doc long, nth long, at long, score double")).collect()
    assert time.monotonic() - began < 30  # a step for each two pairs took minutes
    ends = []  # (nth, at, sum) of chains, a plain walk
    for _, n, at, s in rows:
        ends.append((n, at, round(s * 10) + max((t for m, a, t in ends if m < n and a <= at), default=0)))
    assert sum(round(r.score * 10) for r in got) == max(t for *_, t in ends)


def test_titles_that_repeat_are_compared_once(spark):
    from lectern.operators import layout

    entries = spark.range(3_000).selectExpr("1 AS doc", "id AS entry_id", "id AS nth", "element_at(array('Origins', 'Methods', 'Listening'), cast(id % 3 + 1 AS int)) AS title", "'' AS number", "id % 5 AS target")
    headings = spark.range(3_000).selectExpr("1 AS doc", "id % 7 AS page", "id AS line", "element_at(array('Origins', 'Methods', 'Listening'), cast(id % 3 + 1 AS int)) AS title", "'' AS number", "0.5D AS confidence")
    assert layout.similar_titles(entries, headings, "doc", 0.84).count() == 3
    found = layout.match_headings(entries, headings, "doc")
    assert found.count() == 3_000 and {(r.page, r.similarity) for r in found.filter("entry_id % 5 = 4").collect()} == {(4, 1.0)}
