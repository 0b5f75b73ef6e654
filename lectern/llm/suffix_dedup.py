"""Removal of byte passages that occur more than once: suffixes sorted a bucket at a time, with a difference cover.

A suffix is asked for its first ``LENGTH`` bytes only: two suffixes tie if those agree, and a byte goes if a tied suffix
covers it. Keeping all suffixes at once is out of the question, so the work is blockwise, and most suffixes are resolved before
any bytes are compared:

1. Documents are packed into batches of some two megabytes and kept as a bucketed table. Documents that repeat as a
   whole are settled here, by a 128-bit BLAKE2 digest: one of them stands for all.
2. The cover sample: positions whose offset in the document, modulo 273, is in a perfect difference set of 17 residues.
   For any two suffixes one shift below 273 puts both on sampled positions. The sampled suffixes are told apart by a hash of
   their next 128 bytes, one bucket of the hash range at a time, and those that meet another are marked.
3. A suffix can tie only if a marked sample begins within its first 273 positions. The remaining ones are told apart by a
   hash of their 400 bytes, again one bucket at a time. Hashes only ever resolve: equal bytes have equal hashes, so whatever
   is dropped ties with nothing.
4. What is left is sorted by its bytes. Neighbouring suffixes with the same least 128-byte hash in reach form a stretch of text;
   equal suffixes are in stretches with the same least hash. Equal stretches are counted where they are, and a stretch that
   occurs twice needs no more. The rest come together by least hash, a bucket at a time, and its suffixes are compared as
   texts: 31 bytes at the front and the last bytes directly, all between by ranks of a cover sample (a perfect difference
   set modulo 31) that are made beforehand, so long ties cost no more than short ones. Suffixes that had only a hash in common are struck off.
5. Each batch cuts the bytes that its tied suffixes cover.

Passages that texts share but that are too short to be cut can be told of beside: of every ``PASSAGE_REACH`` neighbouring strings of ``PASSAGE`` bytes
the one with the least hash is looked up among all texts, so a shared passage of 250 bytes, some forty words, is always seen.

Batches send a bucket each key once, however often they hold it, so a passage that fills the corpus costs a bucket one key
for each batch. A bucket answers with one bit for each key. Texts are never shuffled, but for the stretches of step 4: they stay in
their table's buckets, and only the answers move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table

LENGTH = 400
BATCH_BYTES = 2 << 20
KEYS_IN_BUCKET = 1 << 20

# A perfect difference set; the differences of its 17 residues give every residue modulo 273.
COVER_PERIOD = 273
COVER = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)

# A perfect difference set modulo 31.
RANK_PERIOD = 31
RANK_COVER = (0, 1, 3, 8, 12, 18)

SLAB_BYTES = 1 << 20
#: Shorter passages are told of, not cut: strings of ``PASSAGE`` bytes that texts share, one of ``PASSAGE_REACH`` neighbours each.
PASSAGE = 200
PASSAGE_REACH = 51
PACKED_BYTES_IN_TASK = 64 << 20

BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20


# Hashes of windows.

def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(32))


class WindowHash:
    """Hashes of all windows of some length, segment by segment, so that working memory doesn't follow the text."""

    def __init__(self, length: int, bits: int = 64, segment: int = SEGMENT):
        self.length, self.segment, self.spare = length, segment, np.uint64(64 - bits)
        self.values = np.random.default_rng(12_091).integers(0, 1 << 64, 256, np.uint64)
        self.up = _powers(BASE, segment + length)
        self.down = _powers(pow(BASE, -1, 1 << 64), segment)

    def at(self, data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Hashes of the windows at the sorted positions ``wanted``; all windows lie inside ``data``."""
        out = np.empty(len(wanted), np.uint64)
        for a in range(0, len(data), self.segment):
            i, j = np.searchsorted(wanted, (a, a + self.segment))
            if i == j:
                continue
            part = data[a : a + self.segment + self.length]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.values[part] * self.up[: len(part)], out=sums[1:])
            p = wanted[i:j] - a
            out[i:j] = _mixed((sums[p + self.length] - sums[p]) * self.down[p])
        return (out >> self.spare) << self.spare


WHOLE = np.dtype("V16")


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether each came more than once."""
    found, counts = np.unique(keys, return_counts=True)
    return found, counts > 1


# Exchange of keys between batches and buckets of their range.

def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the keys, which are sorted: numbers, or digests in the order of their bytes."""
    lead = keys.view(">u8")[::2].astype(np.uint64) if keys.dtype == WHOLE else keys
    return ((lead >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _in_buckets(batch: int, keys: np.ndarray, twice: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that gets keys of the batch."""
    full, heads = np.unique(_bucket_of(keys, buckets), return_index=True)
    bounds = [*heads.tolist(), len(keys)]
    spans = list(zip(bounds, bounds[1:]))
    columns = [
        pa.array(full.astype(np.int64)), pa.array(np.full(len(full), batch), pa.int64()),
        pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "keys", "twice"])


def _sorted_bucket(batches: list[int], payloads: list[bytes], twice: list[bytes], kind: np.dtype) -> list[tuple[int, bytes]]:
    """For each batch two bits a key: whether others have it too; whether this batch is the first that has it."""
    keys = np.frombuffer(b"".join(payloads), kind)
    sizes = [len(p) // kind.itemsize for p in payloads]
    again = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(twice, sizes)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    heads = np.flatnonzero(new)
    counts = np.diff(np.r_[heads, len(ranked)])
    tied = (counts > 1) | np.logical_or.reduceat(again[order], heads)
    bits = np.empty((2, len(keys)), bool)
    bits[0, order] = np.repeat(tied, counts)
    bits[1, order] = new
    ends = np.cumsum(sizes)
    return [(batch, np.packbits(bits[:, end - n : end]).tobytes()) for batch, n, end in zip(batches, sizes, ends)]


def exchange(keys: DataFrame, kind: np.dtype) -> DataFrame:
    """(bucket, batch, keys, twice) -> (batch, answers): the buckets' answers to a batch, an array of (bucket, bits)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(bucket: int, batches: list[int], payloads: list[bytes], twice: list[bytes]) -> pa.RecordBatch:
            told = _sorted_bucket(batches, payloads, twice, kind)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in told], pa.int64()), pa.array([bucket] * len(told), pa.int64()), pa.array([x for _, x in told], pa.binary())], names=["batch", "bucket", "bits"])

        now, batches, payloads, twice = None, [], [], []
        for part in parts:
            for bucket, batch, payload, again in zip(*(part.column(c).to_pylist() for c in ("bucket", "batch", "keys", "twice"))):
                if bucket != now and batches:
                    yield answers(now, batches, payloads, twice)
                    batches, payloads, twice = [], [], []
                now = bucket
                batches.append(batch)
                payloads.append(payload)
                twice.append(again)
        if batches:
            yield answers(now, batches, payloads, twice)

    answered = keys.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, "batch long, bucket long, bits binary")
    return answered.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))


def _told(keys: np.ndarray, answers: list[dict] | None, buckets: int) -> np.ndarray:
    """(2, n) booleans: the answers to the batch's sorted keys."""
    if not len(keys):
        return np.zeros((2, 0), bool)
    _, sizes = np.unique(_bucket_of(keys, buckets), return_counts=True)
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=2 * n).reshape(2, -1) for x, n in zip(answers, sizes)]
    return np.concatenate(parts, axis=1).astype(bool)


# Suffixes as texts.

def _least_in_reach(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of ``reach`` values from each place on."""
    n = len(values)
    padded = np.full(-(-(n + reach) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])


def _shifts() -> np.ndarray:
    """For two residues the least shift that puts both on the cover."""
    on = np.isin(np.arange(2 * RANK_PERIOD) % RANK_PERIOD, RANK_COVER)
    return np.array([[next(d for d in range(RANK_PERIOD) if on[a + d] and on[b + d]) for b in range(RANK_PERIOD)] for a in range(RANK_PERIOD)])


def _names(*parts: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of ranks."""
    name = parts[0]
    for part in parts[1:]:
        name = np.unique(name * (int(part.max()) + 1) + part, return_inverse=True)[1]
    return name


class CoverRanks:
    """Ranks of the suffixes on a difference cover of ``data``, by as many whole periods as a suffix has after any shift."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.periods = max(0, (length - RANK_PERIOD + 1) // RANK_PERIOD)
        self.shift = _shifts()
        if not self.periods:
            return
        on = np.isin(np.arange(len(data)) % RANK_PERIOD, RANK_COVER)
        self.place = np.cumsum(on) - 1
        at = np.flatnonzero(on)
        room = np.concatenate([data, np.zeros(RANK_PERIOD, np.uint8)])
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(room, RANK_PERIOD)[at])
        name = np.unique(rows.view(f"V{RANK_PERIOD}").ravel(), return_inverse=True)[1]
        rank, done, width = None, 0, 1
        while width <= self.periods:
            if self.periods & width:
                rank = name if rank is None else _names(rank, self._later(name, at, done))
                done += width
            name = _names(name, self._later(name, at, width))
            width *= 2
        self.rank = rank

    def _later(self, name: np.ndarray, at: np.ndarray, periods: int) -> np.ndarray:
        """Names so many periods later, where the cover has a place too; 0 past the end, where no whole suffix is."""
        to = at + periods * RANK_PERIOD
        inside = to < len(self.data)
        out = np.zeros(len(at), np.int64)
        out[inside] = name[self.place[to[inside]]] + 1
        return out

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the suffixes at p and q tie, pair by pair."""
        ranked = self.periods * RANK_PERIOD
        places = np.r_[np.arange(min(RANK_PERIOD - 1, ranked)), np.arange(ranked, self.length)]
        same = np.ones(len(p), bool)
        if ranked:
            d = self.shift[p % RANK_PERIOD, q % RANK_PERIOD]
            same = self.rank[self.place[p + d]] == self.rank[self.place[q + d]]
        for a in range(0, len(p), 1 << 16):
            some = slice(a, a + (1 << 16))
            same[some] &= (self.data[p[some, None] + places] == self.data[q[some, None] + places]).all(axis=1)
        return same


def untied(texts: list[bytes], times: list[int], length: int, hashed: WindowHash) -> list[np.ndarray]:
    """For each stretch of text the suffixes in it that tie with none, of this or another stretch. ``times``: places it has."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    heads = np.cumsum(sizes) - sizes
    suffixes = sizes - length + 1
    at = np.repeat(heads - np.cumsum(suffixes) + suffixes, suffixes) + np.arange(suffixes.sum())
    keys = hashed.at(data, at)
    order = np.argsort(keys, kind="stable")
    ranked, weight = at[order], np.repeat(np.array(times), suffixes)[order]
    same_key = keys[order][1:] == keys[order][:-1]
    same = same_key.copy()
    pairs = np.flatnonzero(same_key)
    same[pairs] = CoverRanks(data, length).equal(ranked[pairs], ranked[pairs + 1])
    heads_of = np.flatnonzero(np.r_[True, ~same])
    total = np.repeat(np.add.reduceat(weight, heads_of), np.diff(np.r_[heads_of, len(ranked)]))
    clash = np.flatnonzero(same_key & ~same)
    if len(clash):  # different suffixes with one key: theirs are told apart by their bytes alone
        group = np.cumsum(np.r_[True, ~same_key])
        for g in np.unique(group[clash]):
            members = np.flatnonzero(group == g)
            bodies = [data[p : p + length].tobytes() for p in ranked[members]]
            counts: dict[bytes, int] = {}
            for body, n in zip(bodies, weight[members].tolist()):
                counts[body] = counts.get(body, 0) + n
            total[members] = [counts[body] for body in bodies]
    alone = np.zeros(len(at), bool)
    alone[order] = total < 2
    bounds = np.cumsum(suffixes)[:-1]
    return [np.flatnonzero(x) for x in np.split(alone, bounds)]


def struck_off(stretches: DataFrame, length: int, key_bits: int, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(least, stretch, places, batch, first) -> (batch, answers): places in the batches of suffixes that tie with nothing.

    Equal stretches are counted before they are shuffled. Those with the same least hash come together, and are compared where any of them has
    one place only; a task holds a slab of them, or all distinct stretches about one 128-byte string if those are more.
    """
    found = stretches.groupBy("least", "stretch").agg(F.sum("places").alias("places"), F.max("batch").alias("batch"), F.max("first").alias("first"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WindowHash(length, key_bits)

        def struck(rows: list[tuple]) -> pa.RecordBatch:
            alone = untied([r[1] for r in rows], [r[2] for r in rows], length, hashed)
            out = [(batch, (first + places).tolist()) for (_, _, times, batch, first), places in zip(rows, alone) if times == 1 and len(places)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["batch", "struck"])

        rows, size, same = [], 0, []
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("least", "stretch", "places", "batch", "first"))):
                if same and row[0] != same[-1][0]:
                    if any(r[2] == 1 for r in same):
                        rows += same
                        size += sum(len(r[1]) for r in same)
                    same = []
                    if size >= slab_bytes:
                        yield struck(rows)
                        rows, size = [], 0
                same.append(row)
        if any(r[2] == 1 for r in same):
            rows += same
        if rows:
            yield struck(rows)

    together = found.repartition("least").sortWithinPartitions("least").select("least", "stretch", "places", "batch", "first")
    return together.mapInArrow(run, "batch long, struck array<long>").groupBy("batch").agg(F.flatten(F.collect_list("struck")).alias("answers"))


# What a batch does.

class Batch:
    """Texts end to end in ``data``; text i spans ends[i-1] to ends[i]."""

    def __init__(self, row: dict, length: int = LENGTH):
        self.row, self.length = row, length
        self.data = np.frombuffer(row["data"], np.uint8)
        self.ends = np.asarray(row["ends"], np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64) if len(self.ends) else self.ends

    def whole_keys(self) -> np.ndarray:
        """A key for each text that can hold a window, of all its bytes."""
        return np.frombuffer(b"".join(hashlib.blake2b(self.data[a:b], digest_size=WHOLE.itemsize).digest() for a, b in self._long()), WHOLE)

    def _long(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b in zip(self.starts, self.ends) if b - a >= self.length]

    def settled(self, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Bytes of texts that repeat as a whole, and the spans of the texts that go on."""
        keys, spans = self.whole_keys(), self._long()
        distinct, place = np.unique(keys, return_inverse=True)
        tied, first = _told(distinct, answers, buckets)
        covered, on, seen = np.zeros(len(self.data), bool), [], set()
        for (a, b), at in zip(spans, place):
            if tied[at]:
                covered[a:b] = True
            if first[at] and at not in seen:
                on.append((a, b))
            seen.add(at)
        return covered, on

    def samples(self, spans: list[tuple[int, int]], period: int, cover: np.ndarray, window: int) -> np.ndarray:
        offsets = [(np.arange(0, b - a, period)[:, None] + cover).ravel() + a for a, b in spans]
        return np.concatenate([x[x <= b - window] for x, (_, b) in zip(offsets, spans)]) if spans else np.zeros(0, np.int64)

    def candidates(self, spans: list[tuple[int, int]], marked: np.ndarray, reach: int) -> np.ndarray:
        """Starts of windows inside a text in whose first ``reach`` positions a marked sample begins."""
        n = len(self.data)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.maximum(marked - reach + 1, 0), 1)
        np.add.at(step, marked + 1, -1)
        inside = np.zeros(n + 1, np.int32)
        for a, b in spans:
            inside[a] += 1
            inside[b - self.length + 1] -= 1
        return np.flatnonzero((np.cumsum(step)[:n] > 0) & (np.cumsum(inside)[:n] > 0))

    def stretches(self, tied: np.ndarray, grams: WindowHash, reach: int) -> dict[tuple[int, bytes], list[int]]:
        """(least hash, text) of each run of ``tied`` starts with the same least hash in reach -> [number of places, first place]."""
        out: dict[tuple[int, bytes], list[int]] = {}
        if not len(tied):
            return out
        n = len(self.data)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, tied, 1)
        np.add.at(step, tied + reach, -1)
        wanted = np.flatnonzero(np.cumsum(step)[:n] > 0)
        hashes = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        hashes[wanted] = grams.at(self.data, wanted)
        least = _least_in_reach(hashes, reach)[tied]
        new = np.r_[True, (np.diff(tied) != 1) | (least[1:] != least[:-1])]
        firsts = np.flatnonzero(new)
        lasts = np.r_[firsts[1:], len(tied)] - 1
        for key, a, b in zip(least[firsts].view(np.int64).tolist(), tied[firsts].tolist(), (tied[lasts] + self.length).tolist()):
            out.setdefault((key, self.data[a:b].tobytes()), [0, a])[0] += 1
        return out

    def shared_strings(self, strings: WindowHash, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash): the least hash in each reach of a text's strings, once for each text; texts by number."""
        room = strings.length + reach - 1
        whole = np.flatnonzero(self.ends - self.starts >= room)
        if not len(whole):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sizes = (self.ends - self.starts)[whole] - room + 1
        text = np.repeat(whole, sizes)
        at = np.repeat(self.starts[whole] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        hashes = np.full(len(self.data), np.iinfo(np.uint64).max, np.uint64)
        hashes[: len(self.data) - strings.length + 1] = strings.at(self.data, np.arange(len(self.data) - strings.length + 1))
        keys = _least_in_reach(hashes, reach)[at]
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])
        pairs = np.unique(np.rec.fromarrays([text[new], keys[new]]))
        return pairs.f0, pairs.f1

    def cover(self, covered: np.ndarray, tied: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, tied, 1)
        np.add.at(step, tied + self.length, -1)
        return covered | (np.cumsum(step)[:-1] > 0)


def _pack(batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, ends, data, size = [], [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())], names=["batch", "ids", "ends", "data"])

        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                size += len(body)
                ids.append(doc_id)
                data.append(body)
                ends.append(size)
                if size >= batch_bytes:
                    yield packed()
                    number += 1
                    ids, ends, data, size = [], [], [], 0
        if ids:
            yield packed()

    return run


def repeated_spans(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batch_bytes: int = BATCH_BYTES,
    keys_in_bucket: int = KEYS_IN_BUCKET, key_bits: int = 64, slab_bytes: int = SLAB_BYTES, keep_bytes: bool = False, passage: int | None = None, passage_reach: int = PASSAGE_REACH,
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256[, kept][, n_shared]) for each row of ``docs``.

    spans are the maximal runs (first byte, end) that windows of ``length`` bytes cover which start at more than one place, in
    this text or any other; kept_sha256 digests the other bytes, kept holds them. With ``passage``, n_shared counts
    strings of so many bytes that another text holds too, of every ``passage_reach`` neighbours the one with the least hash. A null text is empty. Texts shorter than a
    window lose nothing, rows alike in all columns are different places. Empty tables give an empty result; further
    columns are ignored, whatever their names. doc_id is an integer or null. The result doesn't depend on the sizes of batches,
    buckets and slabs, nor on how many bits of the hashes are used.
    """
    spark = docs.sparkSession
    # A period of ``COVER_PERIOD`` leaves the rest of the window to tell samples apart by; shorter windows use every position.
    period, cover = (COVER_PERIOD, np.array(COVER)) if length >= COVER_PERIOD + 31 else (1, np.zeros(1, np.int64))
    window = length - period + 1
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (8 * keys_in_bucket)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PACKED_BYTES_IN_TASK))
    name = f"packed_{uuid.uuid4().hex}"
    shape = "batch long, ids array<long>, ends array<long>, data binary"
    hashes: dict[int, WindowHash] = {}

    def hashed(size: int) -> WindowHash:
        if size not in hashes:
            hashes[size] = WindowHash(size, key_bits)
        return hashes[size]

    def settle(batch: Batch, _: list) -> Iterator[pa.RecordBatch]:
        yield _in_buckets(batch.row["batch"], *distinct_keys(batch.whole_keys()), buckets)

    def sample(batch: Batch, told: list) -> Iterator[pa.RecordBatch]:
        _, spans = batch.settled(told[0], buckets)
        yield _in_buckets(batch.row["batch"], *distinct_keys(hashed(window).at(batch.data, batch.samples(spans, period, cover, window))), buckets)

    def remaining(batch: Batch, told: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        covered, spans = batch.settled(told[0], buckets)
        places = batch.samples(spans, period, cover, window)
        distinct, place = np.unique(hashed(window).at(batch.data, places), return_inverse=True)
        starts = batch.candidates(spans, places[_told(distinct, told[1], buckets)[0][place]], period)
        return covered, starts, hashed(length).at(batch.data, starts)

    def rank(batch: Batch, told: list) -> Iterator[pa.RecordBatch]:
        yield _in_buckets(batch.row["batch"], *distinct_keys(remaining(batch, told)[2]), buckets)

    def tie(batch: Batch, told: list) -> Iterator[pa.RecordBatch]:
        covered, starts, keys = remaining(batch, told)
        distinct, place = np.unique(keys, return_inverse=True)
        tied = starts[_told(distinct, told[2], buckets)[0][place]]
        heads = np.flatnonzero(np.diff(tied, prepend=-2) != 1)
        runs = {"first": tied[heads], "length": np.diff(np.r_[heads, len(tied)]), "whole": np.flatnonzero([b > a and covered[a] for a, b in zip(batch.starts, batch.ends)])}
        yield pa.RecordBatch.from_arrays([pa.array([batch.row["batch"]], pa.int64()), pa.array([{k: x.astype(np.int64).tobytes() for k, x in runs.items()}], pa.struct([(k, pa.binary()) for k in runs]))], names=["batch", "answers"])

    def met(runs: dict) -> np.ndarray:
        first, length = (np.frombuffer(runs[k], np.int64) for k in ("first", "length"))
        return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())

    def stretch(batch: Batch, told: list) -> Iterator[pa.RecordBatch]:
        found = batch.stretches(met(told[0]), hashed(window), period)
        columns = [
            pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary()), pa.array([n for n, _ in found.values()], pa.int64()),
            pa.array([batch.row["batch"]] * len(found), pa.int64()), pa.array([at for _, at in found.values()], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["least", "stretch", "places", "batch", "first"])

    def mark(batch: Batch, _: list) -> Iterator[pa.RecordBatch]:
        yield _in_buckets(batch.row["batch"], *distinct_keys(batch.shared_strings(hashed(passage), passage_reach)[1]), buckets)

    def shared(batch: Batch, answers: list[dict] | None) -> np.ndarray:
        text, keys = batch.shared_strings(hashed(passage), passage_reach)
        distinct, place = np.unique(keys, return_inverse=True)
        return np.bincount(text[_told(distinct, answers, buckets)[0][place]], minlength=len(batch.ends))

    def cut(batch: Batch, told: list) -> Iterator[pa.RecordBatch]:
        tied = met(told[0])
        if told[1]:
            tied = np.setdiff1d(tied, np.array(told[1], np.int64), assume_unique=True)
        covered = np.zeros(len(batch.data), bool)
        for i in np.frombuffer(told[0]["whole"], np.int64):
            covered[batch.starts[i] : batch.ends[i]] = True
        covered = batch.cover(covered, tied)
        out: dict[str, list] = {"n_bytes": [], "spans": [], "kept_sha256": [], "kept": []}
        for a, b in zip(batch.starts, batch.ends):
            gone, data = covered[a:b], batch.data[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = data[~gone] if len(edges) else data
            out["n_bytes"].append(int(b - a))
            out["spans"].append([{"first": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.tobytes() if keep_bytes else None)
        counts = pa.array(shared(batch, told[2]).astype(np.int64)) if passage else pa.nulls(len(batch.ends), pa.int64())
        columns = [pa.array(batch.row["ids"], pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary()), counts]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept_sha256", "kept", "n_shared"])

    try:
        narrow.mapInArrow(_pack(batch_bytes), shape).write.option("parquet.block.size", 8 * batch_bytes).option("compression", "zstd").bucketBy(tasks, "batch").saveAsTable(name)
        packed = spark.table(name)

        def over(told: list[DataFrame], act: Callable[[Batch, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
            """Each batch with the answers that it got in earlier rounds; the texts' side of the join stays where it is."""
            table, rounds = packed, len(told)
            for k, answers in enumerate(told):
                table = table.join(answers.withColumnRenamed("answers", f"answers{k}").hint("shuffle_hash"), "batch", "left")

            def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    for i in range(part.num_rows):
                        row = {c: part.column(c)[i] for c in part.schema.names}
                        batch = {"batch": row["batch"].as_py(), "ids": row["ids"].as_py(), "ends": row["ends"].as_py(), "data": row["data"].as_buffer()}
                        yield from act(Batch(batch, length), [row[f"answers{k}"].as_py() for k in range(rounds)])

            return table.mapInArrow(run, schema)

        told: list[DataFrame] = []
        for act, kind in ((settle, WHOLE), (sample, np.dtype(np.uint64)), (rank, np.dtype(np.uint64))):
            told = [*told, cut_lineage(exchange(over(told, act, "bucket long, batch long, keys binary, twice binary"), kind))]
        runs = cut_lineage(over(told, tie, "batch long, answers struct<first: binary, length: binary, whole: binary>"))
        stretches = over([runs], stretch, "least long, stretch binary, places long, batch long, first long")
        struck = cut_lineage(struck_off(stretches, length, key_bits, slab_bytes))
        seen = [cut_lineage(exchange(over([], mark, "bucket long, batch long, keys binary, twice binary"), np.dtype(np.uint64)))] if passage else []
        result = over([runs, struck, *seen], cut, "doc_id long, n_bytes long, spans array<struct<first: long, end: long>>, kept_sha256 string, kept binary, n_shared long")
        return cut_lineage(result.drop(*([] if keep_bytes else ["kept"]), *([] if passage else ["n_shared"])))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes that 400-byte repeats cover, and how many 200-byte strings it shares with others."""
    out = repeated_spans(read_table(spark, sf_dir, "documents"), passage=PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared")
