"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The items become sequences of word numbers; one automaton holds all their substrings. Documents are streamed through it:
each word follows a transition, or drops to shorter suffixes until one exists, so that at every word the longest
stretch of words ending there that is part of some item is known. Wherever that stretch is as long as a window, the
window's words are hit, and the state tells the items that hold it.

The automaton is made on the driver from a bounded number of item words and broadcast. More items than ``ITEM_WORDS``
words make several automata, one pass over the unchanged documents for each; a longer item is cut into pieces that share a window less a word. Each one's hits are written before the
next is made, and are united by document before anything is cut or judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, free_name, read_table

WINDOW = 10
ITEM_WORDS = 400_000
#: The share of a document's words above which hits reject it as a whole.
MOST_COVERED = 0.5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER)) if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the windows' items at its states.

    ``step`` transitions by word, ``link`` suffix links, ``longest`` lengths. ``items`` has, for a state that holds a
    window, a list of (window length, items in which it occurs); ``below`` leads to the nearest such state among the
    suffixes.
    """

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[str, int]] = [{}]
        self.link, self.longest = [-1], [0]
        held = [(item, words) for item, words in items if words]
        for _, words in held:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, list[tuple[int, frozenset[str]]]] = {}
        found: dict[tuple[int, int], set[str]] = {}
        for item, words in held:
            size = min(window, len(words))
            state = length = 0
            for word in words:
                state, length = self.step[state][word], length + 1
                while length > size and self.longest[self.link[state]] >= size:
                    state = self.link[state]
                    length = self.longest[state]
                length = min(length, size)
                if length == size:
                    found.setdefault((state, size), set()).add(item)
        for (state, size), names in found.items():
            self.items.setdefault(state, []).append((size, frozenset(names)))
        for sizes in self.items.values():
            sizes.sort(key=lambda x: -x[0])
        self.below = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.longest.__getitem__):
            self.below[state] = state if state in self.items else self.below[self.link[state]]
        self.shortest = min((size for sizes in self.items.values() for size, _ in sizes), default=window)

    def _new(self, longest: int, step: dict[str, int], link: int) -> int:
        self.longest.append(longest)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, parent: int, word: str, child: int) -> int:
        """A copy of ``child`` for the suffixes that are no longer than ``parent`` and one word."""
        copy = self._new(self.longest[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: str) -> int:
        there = self.step[last].get(word)
        if there is not None:
            return there if self.longest[there] == self.longest[last] + 1 else self._split(last, word, there)
        state = self._new(self.longest[last] + 1, {}, 0)
        parent = last
        while parent >= 0 and word not in self.step[parent]:
            self.step[parent][word] = state
            parent = self.link[parent]
        if parent >= 0:
            there = self.step[parent][word]
            self.link[state] = there if self.longest[there] == self.longest[parent] + 1 else self._split(parent, word, there)
        return state

    def tables(self) -> tuple:
        """What ``hits`` walks on: lists and dictionaries, which executors read without this package."""
        return self.step, self.link, self.longest, self.below, self.items, self.shortest


def hits(tables: tuple, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal runs (first, end) of hit words, and the items whose windows occur."""
    runs: list[tuple[int, int]] = []
    names: set[str] = set()
    step, link, longest, below, items, shortest = tables
    state = length = 0
    root = step[0]
    for at, word in enumerate(words):
        if state == 0:
            state = root.get(word, 0)
            length = 1 if state else 0
        else:
            there = step[state].get(word)
            while there is None and state:
                state = link[state]
                length = longest[state]
                there = step[state].get(word)
            state, length = (there, length + 1) if there is not None else (0, 0)
        if length < shortest:
            continue
        reach, holder = 0, below[state]
        while holder:
            for size, which in items[holder]:
                if size <= length:
                    reach = max(reach, size)
                    names |= which
            holder = below[link[holder]]
        if reach:
            first = at + 1 - reach
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append((first, at + 1))
    return runs, names


def item_pieces(items: DataFrame, item_id: str, text: str, most_words: int, window: int) -> DataFrame:
    """(item, words, n): items in normalised words, blank between; rows that repeat count once.

    An item of more than ``most_words`` words is cut into pieces that overlap by a window less a word, so that every window is in one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, pieces, sizes = [], [], []
            for item, value in zip(batch.column("item").to_pylist(), batch.column("text")):
                words = words_in(value.as_py())
                step = max(1, most_words - window + 1)
                for at in range(0, max(1, len(words) - window + 1), step):
                    piece = words[at : at + step + window - 1]
                    names.append(item)
                    pieces.append(" ".join(piece))
                    sizes.append(len(piece))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.string()), pa.array(sizes, pa.int64())], names=["item", "words", "n"])

    listed = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"), items[text].alias("text")).distinct()
    return listed.mapInArrow(run, "item string, words string, n long").filter("n > 0")


def item_groups(items: DataFrame, item_id: str = "item_id", text: str = "text", most_words: int = ITEM_WORDS, window: int = WINDOW) -> Iterator[list[tuple[str, list[str]]]]:
    """All items as (item, words), in groups of ``most_words`` words at most (a window's words, where that is more), one group at least.

    The driver holds a group, and a share of the pieces that is about half as large, at a time.
    """
    pieces = cut_lineage(item_pieces(items, item_id, text, most_words, window))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    group, held = [], 0
    for row in pieces.repartition(max(1, int(-(-2 * total // most_words))), "item", "words").toLocalIterator():
        if group and held + row.n > most_words:
            yield group
            group, held = [], 0
        group.append((row["item"], row.words.split(" ")))
        held += row.n
    yield group


def automata(items: DataFrame, item_id: str, text: str, most_words: int, window: int) -> Iterator[ItemAutomaton]:
    """The automata of the groups of items, one after the other."""
    return (ItemAutomaton(group, window) for group in item_groups(items, item_id, text, most_words, window))


def scan(docs: DataFrame, automaton: ItemAutomaton, text: str = "text") -> DataFrame:
    """``docs`` without the text and with n_words, runs (hit words, first and end) and items."""
    rest = [c for c in docs.columns if c != text]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest) + "n_words long, runs array<struct<first: long, end: long>>, items array<string>"
    shared = docs.sparkSession.sparkContext.broadcast(automaton.tables())
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            sizes, runs, items = [], [], []
            for value in batch.column(text):
                words = words_in(value.as_py())
                hit, names = hits(found, words)
                sizes.append(len(words))
                runs.append([{"first": a, "end": b} for a, b in hit])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))], names=[*rest, "n_words", "runs", "items"])

    return docs.mapInArrow(run, schema)


def _united(parts: list[DataFrame]) -> DataFrame:
    """The hits that several automata found in the same rows, which (doc_id, sha) names; rows alike in both have the same hits."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    each = whole.groupBy("doc_id", "sha").agg(
        F.first("n_words").alias("n_words"), (F.count("*") / len(parts)).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_set("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = F.aggregate(
        "runs", F.array().cast("array<struct<first: long, end: long>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["first"]),
                               F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(x))),
    )
    copied = each.withColumn("runs", merged).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return copied.select("doc_id", "n_words", "runs", "items")


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, items) for each row of ``docs``: maximal runs of hit words, and the items that they hold.

    Null and empty texts have no words. An item of fewer words than a window is one window; one without words is none.
    Repeated items are found each under its id; a null item id reads as an empty string. Without items nothing is hit. Empty tables give
    an empty result; further columns of either table are ignored, whatever their names.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    made = automata(items, item_id, item_text, most_words, window)
    first, second = next(made), next(made, None)
    if second is None:
        return scan(narrow, first)
    named = narrow.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return _united([cut_lineage(scan(named, automaton)) for automaton in chain((first, second), made)])


def hit_words(runs: str = "runs"):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])


def clean_text(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    """The text without the hit words and what stands between them."""
    if not text or not runs:
        return text
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    cuts = [(places[a][0], places[b - 1][1]) for a, b in runs]
    bounds = [0, *chain.from_iterable(cuts), len(text)]
    return "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))


def united(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, end) in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _cut(docs: DataFrame, text: str, most_covered: float, *, automaton: ItemAutomaton | None = None, found: str = "") -> DataFrame:
    """``docs`` with the hit words cut out of the text, without the rows of which too much was hit.

    Hits are those of ``automaton``, or the runs in the column ``found``, which goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton.tables()) if automaton else None
    rest = [c for c in docs.columns if c != found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = [], []
            for at, value in enumerate(batch.column(text)):
                body = value.as_py()
                words = words_in(body)
                runs = hits(shared.value, words)[0] if shared else united((x["first"], x["end"]) for x in batch.column(found)[at].as_py() or ())
                texts.append(clean_text(body, runs))
                kept.append(sum(b - a for a, b in runs) <= most_covered * len(words))
            cut = pa.array(texts, batch.schema.field(text).type)
            yield batch.set_column(batch.schema.get_field_index(text), text, cut).select(rest).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in rest)).schema)


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = ITEM_WORDS, most_covered: float = MOST_COVERED) -> DataFrame:
    """``docs`` without spans of test items: hit words go, and rows of which over ``most_covered`` of the words are hit go as a whole.

    All columns are kept; ``n_chars``, where there is one, follows the new text. Texts without hits stay as they are, null ones too. Several
    automata all read the unchanged texts; their hits count together, so the result is that of one automaton of all items.
    """
    columns = docs.columns
    made = automata(items, item_id, item_text, most_words, window)
    first, second = next(made), next(made, None)
    if second is None:
        docs = _cut(docs, text, most_covered, automaton=first)
    else:
        sha, found = free_name(docs, "sha"), free_name(docs, "found")
        named = docs.select(F.sha2(F.col(f"`{text}`"), 256).alias("sha"), F.col(f"`{text}`").alias("text"))
        leaks = None
        for automaton in chain((first, second), made):
            part = cut_lineage(scan(named, automaton).filter(F.size("runs") > 0).select("sha", "runs").distinct())
            leaks = part if leaks is None else leaks.unionByName(part)
        by_text = leaks.groupBy("sha").agg(F.flatten(F.collect_set("runs")).alias(found)).withColumnRenamed("sha", sha)
        docs = _cut(docs.withColumn(sha, F.sha2(F.col(f"`{text}`"), 256)).join(by_text, sha, "left").drop(sha), text, most_covered, found=found)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hit words and the test items whose windows it holds."""
    out = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


#: DuckDB's form: words and windows as rows, windows joined by their words.
OP9_SQL = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM item_windows),
starts AS (
  SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM doc_words, sizes),
found AS (
  SELECT s.doc_id, s.i, s.size, t.item_id
  FROM starts s JOIN item_windows t ON t.size = s.size AND t.win = array_to_string(s.w[s.i : s.i + s.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
