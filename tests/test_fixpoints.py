import random

import pytest

from lectern.operators import contracts, knowledge


def test_long_chains_are_followed_to_their_end(spark):
    n = 140  # passages linked by batches and entries in turn
    batches = spark.createDataFrame([(i // 2, i) for i in range(n)] + [(900, 900), (900, 901)], "batch_id long, passage_id long")
    entries = spark.createDataFrame([((i + 1) // 2, i) for i in range(n)], "entry_id long, passage_id long")
    excluded = spark.createDataFrame([(0,), (5000,)], "passage_id long")
    found = knowledge.dirty_closure(batches, entries, excluded)
    assert sorted(r.passage_id for r in found.collect()) == list(range(1, n))


def test_names_of_one_entry_are_not_carried(spark, monkeypatch):
    kept = []
    cut = knowledge.cut
    monkeypatch.setattr(knowledge, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    batches = spark.createDataFrame([(i, i) for i in range(300)] + [(900, 900), (900, 901)], "batch_id long, passage_id long")
    entries = spark.createDataFrame([(i, i) for i in range(300)], "entry_id long, passage_id long")
    found = knowledge.dirty_closure(batches, entries, spark.createDataFrame([(5,), (900,)], "passage_id long"))
    assert [r.passage_id for r in found.collect()] == [901]
    assert sum(df.count() for df in kept) <= 2


def test_cycles_are_told_from_paths_between_them(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 6), (8, 8), (0, 1), (7, 9), (10, 11), (11, 10), (10, 12), (12, 10), (5, 5), (None, 3), (2, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(r.node for r in contracts.cycle_members(df).collect()) == [1, 2, 3, 5, 6, 7, 8, 10, 11, 12]
    assert contracts.cycle_members(df.limit(0)).count() == 0


def folded(entries, existing=()):
    """Entries merged one after the other, as they arrive."""
    owner, root = {}, {}
    for i, names in existing:
        for n in names:
            owner.setdefault(n, i)
    for i, names in sorted(entries):
        joined = next((owner[n] for n in names if n in owner), i)
        root[i] = joined
        owner |= dict.fromkeys(names, joined)
    return root


@pytest.mark.parametrize("seed, run", [(1, 4096), (2, 3), (3, 7)])
def test_merges_in_order_of_arrival(spark, seed, run):
    rng = random.Random(seed)
    names = lambda: [f"n{rng.randrange(25)}" for _ in range(rng.randint(1, 3))]
    existing = [(i, names()) for i in range(4)]
    entries = [(i, ["hot"] if rng.random() < 0.3 else names()) for i in range(10, 70)]
    kind = "entry_id long, term string, aliases array<string>"
    df = lambda rows: spark.createDataFrame([(i, n[0], n[1:]) for i, n in rows], kind)
    got = lambda *a: {r.entry_id: r.root for r in knowledge.arrival_groups(*a, run=run).collect()}
    assert got(df(entries)) == folded(entries)
    assert got(df(entries), df(existing)) == folded(entries, existing)


def test_long_chains_of_merges_and_awkward_entries(spark):
    chain = [(i, f"n{i}", [f"n{i - 1}"]) for i in range(1, 90)]
    odd = [(100, "", None), (101, None, [None, " "]), (102, "  Ñandú ", []), (103, "nandu", None), (103, "nandu", None), (None, "n1", [])]
    got = {r.entry_id: r.root for r in knowledge.arrival_groups(spark.createDataFrame(chain + odd, "entry_id long, term string, aliases array<string>"), run=16).collect()}
    assert got == {i: 1 for i in range(1, 90)} | {100: 100, 101: 101, 102: 102, 103: 102}
