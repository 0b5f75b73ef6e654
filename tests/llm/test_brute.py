"""Operators against plain computations of the same."""

import hashlib
import os
import pickle
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from rows import documents

from lectern.llm import decontamination, pii, quality, sharding, simhash, suffix_dedup, token_counts, toxicity
from lectern.llm.catalogue import oracle_sql, queries
from same import assert_same


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "source").collect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, duck, name):
    assert_same(queries()[name](spark, sf).toPandas(), duck.sql(oracle_sql()[name]).df())


def test_shards(spark, sf, rows):
    out = queries()["op1_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows)
    per = Counter(r.shard for r in out)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in per.items())
    import zlib

    texts = {r.doc_id: r.text or "" for r in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)


def test_shards_match_the_mixture(spark):
    df = documents(spark, [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(2000)])
    out = sharding.interleave(df, 10).collect()
    share = Counter(r.source for r in out)
    for s in range(10):
        mine = Counter(r.source for r in out if r.shard == s)
        assert all(abs(mine[k] - share[k] / 10) <= 2 for k in share)
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(df.repartition(3), 10).collect()}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= most:
            root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash(spark, sf, rows):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    roots = components(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    out = queries()["op2_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(d, f"{f:016x}", least[roots[f]]) for d, f in fps.items()}


def test_gray_index_finds_all_links(spark):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(60)]
    for c in codes[:40]:
        for _ in range(8):
            codes.append(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    codes = sorted(set(codes))
    want = components(set(codes))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    from lectern.llm.components import components as joined

    for hot in (20_000, 7):
        got = {r.u % (1 << 64): r.v % (1 << 64) for r in joined(simhash.near_edges(df, len(codes), hot_group=hot)).collect()}
        groups, mine = {}, {}
        for c in codes:
            groups.setdefault(want[c], set()).add(c)
            mine.setdefault(got.get(c, c), set()).add(c)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_toxicity_generalises_to_misspellings(spark):
    rng = random.Random(9)
    calm, bad = ["garden", "river", "window", "letter", "music", "bread", "cloud"], ["wretched", "disgusting", "worthless", "pathetic"]

    def text(toxic, swap):
        words = [rng.choice(calm) for _ in range(20)]
        if toxic:
            for k in rng.sample(range(20), 4):
                w = rng.choice(bad)
                at = rng.randrange(1, len(w) - 1)
                words[k] = w[:at] + rng.choice("xz1") + w[at + 1 :] if swap else w
        return " ".join(words)

    train = [(text(i % 3 == 0, False), int(i % 3 == 0)) for i in range(240)]
    model = toxicity.train(spark.createDataFrame(train, "text string, toxic int"))
    held = [(i, text(i % 2 == 0, True)) for i in range(100)]
    out = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 2 == 0) for i in out]) > 0.9


def test_toxicity_query_does_not_see_held_out_labels(spark, sf, docs):
    import zlib

    out = queries()["op3_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in out)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    own = [(r.score, marks[r.doc_id]) for r in out if not r.held_out and r.doc_id in marks]
    bad, good = [s for s, t in own if t], [s for s, t in own if not t]
    if bad and good:
        assert np.mean([b > g for b in bad for g in good]) > 0.8


def plain_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], ("email", "ip", "card", "phone").index(x[2])))


PIECES = ["a.b@c.de", "x@y", "@", "p+q@r-s.t.u", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+34 (612) 345-678", "+1", "+123456789012345678", " ", "-", ".", "é", "🙂", "00012.3.4.5", "5500000000000004", "..", "a@b..c", "John Smith", "call 555-0101"]


def test_personal_data(spark, sf, rows):
    rng = random.Random(4)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", " ", ","]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    for text in [*made, *(r.text or "" for r in rows)]:
        assert pii.base_spans(text) == plain_spans(text)
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in queries()["op4_pii"](spark, sf).collect():
        want = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, x in want) for k in ("email", "ip", "card", "phone")]
        listed = [f"{k}:{a}:{b}" for a, b, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_labelers_reliabilities():
    rng = random.Random(2)
    good = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = "".join("+" if (truth if rng.random() < p else not truth) else "-" for p in (0.95, 0.9, 0.85, 0.5))
        good[votes] += 1
    told = pii.posteriors(dict(good))
    assert told["++++"] > 0.9 and told["---+"] < 0.1 and told["+++-"] > 0.9


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, sf, rows):
    texts = {r.doc_id: r.text for r in rows}
    for r in queries()["op5_quality"](spark, sf).collect():
        n, chars, symbols, dups, repeats = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(8)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(80, 300))) for _ in range(300)]
    odd = " ".join("q" * 60 + "#$%" * 20 for _ in range(100)).replace("q" * 60, "qqq", 3)
    odd = " ".join(f"{i}#$%&#$%&{'z' * 50}" for i in range(100))
    out = quality.judge(documents(spark, [(i, t, "en", "a") for i, t in enumerate([*plain, odd])])).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert not kept[300] and sum(kept.values()) >= 297


def plain_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [12, 400])
def test_suffixes(spark, length):
    rng = random.Random(length)
    shared = ["".join(rng.choice("ab é") for _ in range(length * 2)) for _ in range(3)]
    texts = []
    for _ in range(30):
        parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, length * 3))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(shared)[: rng.randint(0, length * 2)] + parts[1] + rng.choice(["", "z" * (length + 30)]) + parts[2])
    texts += [texts[0], "", texts[1] * 2]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(4)
    data = [t.encode() for t in texts]
    for i, gone in enumerate(plain_removed(data, length)):
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
        data[i] = (len(data[i]), [tuple(map(int, e)) for e in edges], hashlib.sha256(bytes(np.frombuffer(data[i], np.uint8)[~gone])).hexdigest())
    for batch, keys, bits, slab in ((2 << 20, 1 << 20, 64, 1 << 20), (500, 64, 64, 100), (3000, 1 << 20, 9, 2000)):
        out = suffix_dedup.repeated_spans(df, length=length, batch_bytes=batch, keys_in_bucket=keys, key_bits=bits, slab_bytes=slab).collect()
        for r in out:
            assert (r.n_bytes, [(s.first, s.end) for s in r.spans], r.kept_sha256) == data[r.doc_id]


def test_suffixes_with_one_key_are_told_apart(spark):
    """Different texts whose windows all have the same hash, among them the blocks that defeat polynomials modulo 2^64, lose nothing."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    rng = random.Random(1)
    middle = "".join(rng.choice("abcdef") for _ in range(330))
    near = ["".join(rng.choice("ghijkl") for _ in range(70)) for _ in range(6)]
    texts = [middle + x for x in near[:3]] + [x + middle for x in near[3:]] + [thue[:2048], thue[2048:], near[0] * 6]
    data = [t.encode() for t in texts]
    plain = [int(x.sum()) for x in plain_removed(data, 400)]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for bits in (1, 64):
        out = {r.doc_id: sum(s.end - s.first for s in r.spans) for r in suffix_dedup.repeated_spans(df, key_bits=bits, batch_bytes=700).collect()}
        assert [out[i] for i in range(len(texts))] == plain and not any(plain[:6])


@pytest.mark.parametrize("length", [40, 61, 100, 400])
def test_cover_ranks_compare_texts(length):
    rng = np.random.default_rng(length)
    data = np.concatenate([rng.integers(97, 99, 700, np.uint8), np.tile(rng.integers(97, 123, 37, np.uint8), 40), rng.integers(97, 123, 900, np.uint8), np.full(900, 97, np.uint8)])
    data = np.concatenate([data, data[:1200], data[2000:3500]])
    p, q = (rng.integers(0, len(data) - length + 1, 60_000) for _ in range(2))
    q = np.where(rng.random(len(q)) < 0.5, np.minimum(np.where(p < 1200, p + 3980, p + 37), len(data) - length), q)
    got = suffix_dedup.CoverRanks(data, length).equal(p, q)
    body = data.tobytes()
    want = np.array([body[a : a + length] == body[b : b + length] for a, b in zip(p.tolist(), q.tolist())])
    assert (got == want).all() and 1000 < want.sum() < len(want) - 1000


def test_shared_passages_are_told(spark):
    rng = random.Random(21)
    body = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    texts = [body(rng.randint(0, 900)) for _ in range(60)]
    passages = [body(260) for _ in range(5)]
    planted = {i: rng.choice(passages) for i in range(0, 40, 2)}
    texts = [t[: len(t) // 2] + planted.get(i, "") + t[len(t) // 2 :] for i, t in enumerate(texts)] + ["", None, body(300) * 3]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for batch, keys in ((2 << 20, 1 << 20), (900, 64)):
        out = suffix_dedup.repeated_spans(df, passage=200, batch_bytes=batch, keys_in_bucket=keys).collect()
        assert {r.doc_id for r in out if r.n_shared} == set(planted) and len(out) == len(texts)


def test_least_in_reach():
    values = np.random.default_rng(2).integers(0, 1 << 63, 1000, np.uint64)
    for reach in (1, 7, 273, 1500):
        got = suffix_dedup._least_in_reach(values, reach)
        assert [int(x) for x in got] == [int(values[i : i + reach].min()) for i in range(1000)]


def test_suffix_table_is_dropped_when_a_run_fails(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(Exception):
        suffix_dedup.repeated_spans(documents(spark), batch_bytes=None)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_many_automata_find_what_one_finds(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {r.doc_id: (r.n_words, r.runs, r.items) for r in decontamination.find_leaks(docs, items).collect()}
    many = {r.doc_id: (r.n_words, r.runs, r.items) for r in decontamination.find_leaks(docs, items, most_words=300).collect()}
    assert one == many and any(x[1] for x in one.values())


def test_cut_texts_hold_no_item(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.find_leaks(docs, items).filter("size(runs) > 0").select("doc_id").collect()}
    for most in (400_000, 300):
        out = decontamination.decontaminate(docs, items, most_words=most)
        texts = {r.doc_id: r.text for r in out.collect()}
        before = {r.doc_id: r.text for r in docs.collect()}
        assert all(texts[d] == t for d, t in before.items() if d not in dirty)
        assert decontamination.find_leaks(out, items).filter("size(runs) > 0").count() == 0


def test_tokens(spark, sf, rows):
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(), special_tokens={}).encode_ordinary
    want = {r.doc_id: len(encode(r.text or "")) for r in rows}
    assert {r.doc_id: r.n_tokens for r in queries()["op10_token_counts"](spark, sf).collect()} == want
    texts = [(0, "<|endoftext|>", "en", "a"), (1, "", "en", "a"), (2, None, "en", "a"), (3, "ab cd " * 50_000, "en", "a")]
    out = token_counts.token_counts(documents(spark, texts), block_bytes=64)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {i: len(encode(t or "")) for i, t, _, _ in texts}


def test_separators_at_block_edges(spark, tmp_path):
    rng = random.Random(6)
    want = {}
    for f in range(6):
        ids = [rng.choice([7, 8, 9, 50_256]) if rng.random() < 0.5 else 5 for _ in range(rng.choice([0, 1, 40, 333]))]
        np.array(ids, "<u2").tofile(tmp_path / f"tokens-{f}.bin")
        docs, n = [], 0
        for x in ids:
            if x == 50_256:
                docs.append(n)
                n = 0
            else:
                n += 1
        want |= {(f"tokens-{f}.bin", i): k for i, k in enumerate(docs + [n] * (n > 0))}
    for block, many in ((2, 4), (6, 2), (64, 3), (1 << 20, 9)):
        out = token_counts.count_tokens(spark, str(tmp_path), block_bytes=block, superblock=many).collect()
        assert {(r.file, r.ordinal): r.n_tokens for r in out} == want


def test_pieces_encode_alike():
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(), special_tokens={}).encode_ordinary
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "1", ".", "'s", " "]) for _ in range(120))
        assert [x for p in token_counts.pieces(text, 10) for x in encode(p)] == encode(text)


def test_pipeline(spark, sf, rows):
    """The stages' decisions, step by step, from plain computations on what each was given."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.toxicity(spark, docs, sf).cache()
    scores = {r.doc_id: r.score for r in queries()["op3_toxicity"](spark, sf).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, s in scores.items() if s < 0.7}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in clean.collect()}
    roots = components(set(fps.values()))
    firsts = {}
    for d, f in sorted(fps.items()):
        firsts.setdefault(roots[f], d)
    single = p.simhash_dedup(spark, clean, sf).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(firsts.values())
    out = p.run(spark, sf).collect()
    mixed = p.mixing(spark, p.decontamination(spark, single, sf), sf)
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per.values()) <= 1


def test_token_files_are_gone_and_long_words_are_counted(spark, tmp_path):
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(), special_tokens={}).encode_ordinary
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(1_500_000)), "日本" * 100_000, "\n" * 200_000, "a b"]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    shared = token_counts.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {i: len(encode(t)) for i, t in enumerate(texts)}
    assert not [x for x in set(os.listdir(shared)) - before if x.startswith("tokens-")]
    kept = token_counts.token_counts(df, folder=str(tmp_path / "kept"))
    assert kept.count() == 4 and [x for x in os.listdir(tmp_path / "kept") if x.endswith(".bin")]


def test_automata_reach_executors_without_the_package():
    automaton = decontamination.ItemAutomaton([("a", "one two three four five six seven eight nine ten eleven".split())])
    assert b"lectern" not in pickle.dumps(automaton.tables())
    runs, names = decontamination.hits(automaton.tables(), "x one two three four five six seven eight nine ten y".split())
    assert runs == [(1, 11)] and names == {"a"}


def test_repeated_items_count_once(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")] * 500 + [(2, "other words")], "item_id long, text string")
    assert len(list(decontamination.item_groups(items, most_words=1000))) == 1
