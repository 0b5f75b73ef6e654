"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most 4 of 64 bits agree in at least one of five bit ranges (in more ranges, if the bits
are cut finer). Spark routes every distinct fingerprint to one group for each range, keyed by the bits of that range: the
uppermost masked pattern. Within its task a group is sorted by Gray rank, so that neighbours share most bits. Runs of
neighbours become nodes that keep the bit patterns which all their members share (as the AND and the OR of the members);
nodes of nodes follow, up to one root for each group. Linked pairs are found by descending from pairs of roots: the bits
in which two nodes certainly differ are accumulated, and a pair of nodes with more than 4 such bits is dropped with all
that is below it. A pair whose members can't differ in more than 4 bits is linked as a whole.

A group links its members with few edges, a star for each local component, as only connectivity is asked for. Groups over
``HOT_GROUP`` fingerprints are dealt over tiles, each of two chunks of the group, so that no task holds more than two
chunks of one group at a time and every pair still meets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, free_name, one_of_each, read_table, row_key
from lectern.llm.components import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
HOT_GROUP = 20_000
FANOUT = 8


# Fingerprints.

def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits of a text; 0 without words. Words are lower-cased in A-Z only and split at ASCII blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends[:-1])]
    last = ends[shingle - 1:] or ends[-1:]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), 0
    spans = zip(starts, last)
    while hashes := [digest(joined[a:b], seed) for a, b in itertools.islice(spans, 1 << 16)]:
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text and with ``fp``: the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + (", " if rest else "") + "fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps)], names=[*rest, "fp"])

    return docs.mapInArrow(run, schema)


# The index within a task.

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes sorted by (group, Gray rank). Level 0 are the codes; a node never crosses groups."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((gray_rank(codes), groups))
        codes, groups = codes[self.order], groups[self.order]
        self.ands, self.ors, self.children, self.leaves = [codes], [codes], [None], [(np.arange(len(codes)), np.ones(len(codes), np.int64))]
        while len(groups) and (groups[1:] == groups[:-1]).any():
            first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            within = np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))
            heads = np.flatnonzero(within % fanout == 0)
            self.children.append((heads, np.diff(np.r_[heads, len(groups)])))
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], heads))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], heads))
            start, size = self.leaves[-1]
            self.leaves.append((start[heads], np.add.reduceat(size, heads)))
            groups = groups[heads]
        self.roots = len(groups)

    def links(self, most: int, at_once: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of positions in the original order; together they connect all codes of a group within ``most`` bits."""
        top = len(self.ands) - 1
        roots = np.arange(self.roots)
        stack = [(top, roots, roots)]
        while stack:
            level, left, right = stack.pop()
            if len(left) > at_once // FANOUT**2 and level:
                half = len(left) // 2
                stack += [(level, left[half:], right[half:]), (level, left[:half], right[:half])]
                continue
            ands, ors = self.ands[level], self.ors[level]
            apart = np.bitwise_count((ands[left] & ~ors[right]) | (ands[right] & ~ors[left]))
            near = apart <= most
            left, right = left[near], right[near]
            if level == 0:
                other = left != right
                yield self.order[left[other]], self.order[right[other]]
                continue
            spread = np.bitwise_count((ors[left] | ors[right]) & ~(ands[left] & ands[right]))
            whole = spread <= most
            if whole.any():
                yield self._stars(level, left[whole], right[whole])
            left, right = left[~whole], right[~whole]
            if len(left):
                stack.append((level - 1, *self._below(level, left, right)))

    def _below(self, level: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads, sizes = self.children[level]
        each = sizes[left] * sizes[right]
        pair = np.repeat(np.arange(len(left)), each)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        i, j = heads[left][pair] + k // sizes[right][pair], heads[right][pair] + k % sizes[right][pair]
        keep = (left[pair] != right[pair]) | (i <= j)
        return i[keep], j[keep]

    def _stars(self, level: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.leaves[level]
        hub = np.concatenate([start[left], start[left]])
        nodes = np.concatenate([left, right])
        each = size[nodes]
        leaf = np.repeat(start[nodes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return self.order[np.repeat(hub, each)], self.order[leaf]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after merging the components of a[i] and b[i]; a component's label is its smallest position."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def link_groups(codes: np.ndarray, groups: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code) of stars that connect what is linked within each group."""
    index, labels = GrayIndex(codes, groups), np.arange(len(codes))
    for a, b in index.links(most):
        labels = join_labels(labels, a, b)
    other = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[other], codes[labels[other]]


# Routing.

def ranges_for(n: int, most: int = MOST_BITS) -> list[int]:
    """Bit masks, one for each route. Two codes within ``most`` bits agree under one mask at least; masks hold so many bits that
    a group of random codes has a few hundred members at any number of codes."""
    parts = most + 1
    while True:
        widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
        cuts = [64 - sum(widths[: i + 1]) for i in range(parts)]
        masks = [((1 << w) - 1) << c for w, c in zip(widths, cuts)]
        chosen = [sum(x) for x in itertools.combinations(masks, parts - most)]
        if n >> min(m.bit_count() for m in chosen) <= 512 or parts >= 2 * most:
            return chosen
        parts += 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def route(codes: DataFrame, masks: list[int], hot_group: int = HOT_GROUP) -> DataFrame:
    """(fp) -> (fp, grp): one row for each mask, or one for each tile of a hot group."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))
    routed = codes.select("fp", F.explode(keys).alias("grp"))
    hot = cut_lineage(routed.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > hot_group))
    if hot.isEmpty():
        return routed
    chunks = F.ceil(F.col("n") / hot_group).cast("long")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), chunks)
    tiles = F.transform(F.sequence(F.lit(0), chunks - 1), lambda other: F.xxhash64(F.col("grp"), F.least(chunk, other), F.greatest(chunk, other)))
    return routed.join(hot, "grp", "left").select("fp", F.explode(F.when(F.col("n").isNull(), F.array("grp")).otherwise(tiles)).alias("grp"))


def near_edges(codes: DataFrame, n: int, most: int = MOST_BITS, hot_group: int = HOT_GROUP, buffer: int = 1 << 18) -> DataFrame:
    """Edges (u, v) that connect all distinct codes ``fp`` within ``most`` bits of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def edges(grp: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = link_groups(fp.view(np.uint64), grp, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append((batch.column("grp").to_numpy(), batch.column("fp").to_numpy()))
            rows += batch.num_rows
            if rows < buffer:
                continue
            grp, fp = (np.concatenate(x) for x in zip(*held))
            done = np.searchsorted(grp, grp[-1])  # the last group may go on
            if done:
                yield edges(grp[:done], fp[:done])
            held, rows = [(grp[done:], fp[done:])], len(grp) - done
        if rows:
            yield edges(*(np.concatenate(x) for x in zip(*held)))

    routed = route(codes, ranges_for(n, most), hot_group)
    return routed.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS, hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest id that links lead to.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows with the same text are one node. A null
    id counts for no component's id, so a component of null ids alone has a null id. Empty tables give an empty result;
    further columns are ignored, whatever their names.
    """
    marked = cut_lineage(fingerprints(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", shingle))
    rooted = _roots(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), most, hot_group)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _roots(nodes: DataFrame, most: int, hot_group: int) -> DataFrame:
    """Distinct fingerprints with what is known of them, and ``root``, the smallest fingerprint that links lead to."""
    nodes = cut_lineage(nodes)
    stars = components(near_edges(nodes.select("fp"), nodes.count(), most, hot_group))
    return nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select(*(nodes[c] for c in nodes.columns), F.coalesce("v", nodes["fp"]).alias("root"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS, hot_group: int = HOT_GROUP) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, then of the smallest digest of id and text.

    Null ids come after all others. Of rows that agree in id and text one stays, whatever else they hold. All columns are kept.
    """
    key = free_name(docs, "row_key")
    digest = row_key(docs[doc_id], docs[text])
    marked = cut_lineage(fingerprints(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), digest.alias("key")), "text", shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key"))
    rooted = _roots(marked.groupBy("fp").agg(first.alias("first")), most, hot_group)
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    return one_of_each(docs.withColumn(key, digest).join(winners, key, "left_semi"), key, docs.columns).select("row.*")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that links lead to."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
