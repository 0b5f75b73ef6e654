"""Personal data: fixed patterns, and further spans by weak supervision.

Four kinds have fixed patterns (the base spans). Beyond them, wide patterns propose candidates by shape alone: numbers that may be
phones, spelt-out mail addresses, long runs that may be secrets, capitalised words that may be names. Several labelers vote on each:
strict formats, gazetteers, words of the context and shapes, each for, against or silent. How often each combination of votes occurs is
counted over all documents; from these counts expectation-maximisation estimates every labeler's reliability for each kind, without any
true labels. A span that no labeler votes for is none. The posteriors then train a logistic classifier of spans on surface features,
which says what is added; so a name that is in no gazetteer is found by its context.

Texts are read once. What is kept of them are spans with votes and features; the counts of vote patterns that reach
the driver are bounded by the number of patterns, and the classifier's rows by ``TRAIN_SPANS`` for each kind: a kind that
has fewer candidates is learnt from all of them, however many others there are.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, read_table, seeded_bits

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email", "phone", "secret", "name")
KINDS = ("email", "ip", "card", "phone", "secret", "name")
TRAIN_SPANS = 20_000
SEED = 4_099
#: Slices of the 52 bits of a draw, whose counts say how far each kind's draws go.
DRAW_SLICES = 4_096
CONTEXT = 40

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# The gazetteers and the words of contexts.
ENDINGS = frozenset("com org net edu gov info biz io de es fr it uk eu us".split())
GIVEN_NAMES = frozenset("James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Barbara Susan Maria Anna Peter Paul Hans Klaus Jürgen Jean Pierre Marie Claire Carlos José Juan Carmen Lucía Sofía Thomas Laura Daniel Sarah".split())
DIALLING_CODES = frozenset("01 02 03 04 05 06 07 08 09 020 030 040 0211 0221 069 089 0711 91 93 201 202 206 212 213 214 305 310 312 323 404 408 415 416 512 555 604 617 646 650 702 713 718 773 800 805 818 832 855 866 877 888 917 949".split())
SECRET_PREFIXES = ("sk-", "sk_", "pk-", "pk_", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ")
TITLES = frozenset("mr mrs ms dr prof herr frau señor señora monsieur madame".split())
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone contact".split()),
    "secret": frozenset("token key secret password passwd apikey api_key auth bearer credential pwd".split()),
    "name": frozenset("name signed author contact dear regards sincerely by".split()) | TITLES,
}
COUNTER_CUES = frozenset("page pages isbn issn version volume figure table year doi commit checksum the this sha256 md5".split())

CANDIDATES = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[ .-]\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}(?![A-Za-z0-9_+/=-])"),
    "name": re.compile(r"(?<![\w-])[A-ZÀ-Ý][a-zß-ÿ]+(?: [A-ZÀ-Ý][a-zß-ÿ]+){1,3}(?![\w-])"),
}
STRICT = {
    "email": re.compile(r"[^ ]+ ?[\[(]at[\])] ?[^ ]+ ?[\[(]dot[\])] ?[A-Za-z]{2,}", re.I),
    "phone": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{2,4}\)?[ .-][0-9]{3,5}(?:[ .-][0-9]{2,5})*"),
    "secret": re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"),
}
DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-][0-9]{2}(?:[ .-][0-9]{2,4})?|[0-9]{2}[.-][0-9]{2}[.-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}-(?:19|20)?[0-9]{2}")
FEATURES = ("one", "length", "digits", "uppers", "marks", "variety", "cue", "counter_cue", "gazetteer", "strict", "shape", "quoted")


# Base spans.

def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the whole pattern, found from the @ outwards, so that long runs of letters cost their length once."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; offsets are code points."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# Candidates, their votes and features.

def _name_part(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The words from the first given name on, or else those after titles and cues; None if fewer than two are left."""
    words = text[start:end].split(" ")
    known = [i for i, w in enumerate(words[:-1]) if w in GIVEN_NAMES]
    skip = known[0] if known else 0
    while not known and skip < len(words) and words[skip].lower() in CUES["name"]:
        skip += 1
    if len(words) - skip < 2:
        return None
    first = start + sum(len(w) + 1 for w in words[:skip])
    return first, first + len(" ".join(words[skip : skip + 3]))


def _vote(kind: str, span: str, before: str, after: str) -> tuple[str, list[float]]:
    """Votes as a string of + - 0, one for each labeler; and the features."""
    words = re.findall(r"[^\W_][\w-]*", before.lower())[-5:]
    cue, counter = any(w in CUES[kind] for w in words), any(w in COUNTER_CUES for w in words)
    quoted = before.rstrip()[-1:] in ("=", ":", '"', "'", "<") or after[:1] in ('"', "'", ">")
    n, digits, counts = len(span), len(_digits(span)), Counter(span)
    variety = -sum(c / n * math.log2(c / n) for c in counts.values())
    strict = int(kind != "name" and bool(STRICT[kind].fullmatch(span)))
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]", span.lower())[-1].strip("-") in ENDINGS else -1
        shape = 1 if "(" in span or "[" in span else -1
    elif kind == "phone":
        gazetteer = int(re.search("[0-9]+", span)[0] in DIALLING_CODES)
        shape = -1 if DATE.fullmatch(span) or not 7 <= digits <= 12 else 0
    elif kind == "secret":
        gazetteer = int(span.startswith(SECRET_PREFIXES))
        shape = 1 if variety > 3.2 and digits and digits < n else -1
    else:
        parts = span.split(" ")
        strict = int(bool(words) and words[-1] in TITLES and bool(re.search(r"[^\W_.][.]? $", before)))
        gazetteer = int(parts[0] in GIVEN_NAMES)
        opens = not before.strip() or before.rstrip(" ")[-1:] in ".!?\n" and not strict
        shape = -1 if opens and not gazetteer or len({p.lower() for p in parts}) < len(parts) else 0
    votes = [strict, gazetteer, 1 if cue else 0, -1 if counter else 0, shape, 1 if quoted else 0]
    features = [1.0, min(n, 100) / 50, digits / n, sum(c.isupper() for c in span) / n, sum(not c.isalnum() for c in span) / n, variety / 4, float(cue), float(counter), float(gazetteer), float(strict), float(shape), float(quoted)]
    return "".join("-0+"[v + 1] for v in votes), features


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, list[float]]]:
    """(start, end, kind, votes, features) of wide matches that touch no base span; leftmost and longest first."""
    taken = sorted((a, b) for a, b, _ in base)
    found = []
    for kind in ADDED_KINDS:
        for m in CANDIDATES[kind].finditer(text):
            place = _name_part(text, *m.span()) if kind == "name" else m.span()
            if place:
                found.append((*place, kind))
    out, done, k = [], 0, 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a < done or any(x < b and y > a for x, y in taken[k : k + 8]):
            continue
        votes, features = _vote(kind, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + 2])
        out.append((a, b, kind, votes, features))
        done = b
    return out


SPANS = "array<struct<start: int, end: int, kind: string>>"
PROPOSED = "array<struct<start: int, end: int, kind: string, votes: string, features: array<double>>>"


def propose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, base_sha256, proposed) for each row of ``docs``; the one pass over texts."""
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    more_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.string()), ("features", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, digests, more = [], [], []
            for value in batch.column("text"):
                body = value.as_py() or ""
                base = base_spans(body)
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest())
                more.append([{"start": a, "end": b, "kind": k, "votes": v, "features": f} for a, b, k, v, f in candidates(body, base)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, base_type), pa.array(digests), pa.array(more, more_type)], names=["doc_id", "base", "base_sha256", "proposed"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, base {SPANS}, base_sha256 string, proposed {PROPOSED}")


# Reliabilities and the classifier.

def posteriors(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The probability that a span is personal data, for each pattern of votes, by expectation-maximisation.

    Labelers are independent given the truth; each has a distribution over for, silent and against for either truth. The start is
    the majority of the votes, so that the two classes keep their meaning; patterns without a vote for stay with the other class.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    votes = np.array([["-0+".index(c) for c in name] for name in names])
    weight = np.array([patterns[name] for name in names], float)
    backed = (votes == 2).any(axis=1)
    right = backed / (1 + np.exp(-(votes - 1).sum(axis=1) + 0.5))
    seen = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        share = []
        for truth in (right, 1 - right):
            told = np.einsum("p,plv->lv", weight * truth, seen) + 0.5
            share.append(np.log(told / told.sum(axis=1, keepdims=True)))
        prior = ((weight * right).sum() + 1) / (weight.sum() + 2)
        odds = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", seen, share[0] - share[1])
        right = backed / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(names, right.tolist()))


def fit_classifier(features: np.ndarray, truth: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier of soft labels, by Newton steps with a ridge."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (p - truth) + ridge * w
        w -= np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w)), slope)
    return w


def _drawn(spans: DataFrame, most_spans: int) -> DataFrame:
    """Of each kind the ``most_spans`` rows whose draws are smallest, or all of a kind that has fewer."""
    marked = spans.withColumn("draw", seeded_bits(SEED, F.col("doc_id"), F.col("start"), F.col("kind"))).withColumn("slice", F.floor(F.col("draw") / ((1 << 52) // DRAW_SLICES)))
    sizes: dict[str, dict[int, int]] = {}
    for row in marked.groupBy("kind", "slice").agg(F.count("*").alias("n")).collect():  # DRAW_SLICES of each kind at most
        sizes.setdefault(row.kind, {})[row.slice] = row.n
    near = F.lit(False)
    for kind, held in sorted(sizes.items()):
        through, last = 0, -1
        for last in sorted(held):
            through += held[last]
            if through >= most_spans:
                break
        near = near | ((F.col("kind") == kind) & (F.col("slice") <= last))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("draw", "doc_id", "start", "end", "votes", "features"))
    return marked.filter(near).withColumn("nth", nth).filter(F.col("nth") <= most_spans)


def learn(proposed: DataFrame, most_spans: int = TRAIN_SPANS) -> dict[str, list[float]]:
    """Weights for each kind that occurs, from all its vote patterns and from at most ``most_spans`` of its spans."""
    spans = proposed.select("doc_id", F.explode("proposed").alias("s")).select("doc_id", "s.*")
    counted: dict[str, dict[str, int]] = {}
    for row in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():  # 3 ** 6 patterns of each kind at most
        counted.setdefault(row.kind, {})[row.votes] = row.n
    truth = {kind: posteriors(patterns) for kind, patterns in counted.items()}
    rows = {kind: (array("d"), array("d")) for kind in truth}
    for row in _drawn(spans, most_spans).select("kind", "votes", "features").toLocalIterator():
        rows[row.kind][0].extend(row.features)
        rows[row.kind][1].append(truth[row.kind][row.votes])
    return {kind: fit_classifier(np.array(f).reshape(-1, len(FEATURES)), np.array(t)).tolist() for kind, (f, t) in sorted(rows.items())}


def _is_personal(span: Column, weights: dict[str, list[float]]) -> Column:
    found = F.lit(False)
    for kind, w in weights.items():
        odds = sum((span["features"][i] * F.lit(x) for i, x in enumerate(w)), F.lit(0.0))
        found = F.when(span["kind"] == kind, odds > 0).otherwise(found)
    return found


def _place(span: Column) -> Column:
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), span["kind"]).cast("int")
    return F.struct(span["start"].alias("start"), rank.alias("rank"), span["end"].alias("end"), span["kind"].alias("kind"))


def find_personal(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_spans: int = TRAIN_SPANS) -> DataFrame:
    """(doc_id, base, base_sha256, spans) for each row of ``docs``; spans hold the base spans and the added ones in order.

    Spans are structs (start, rank, end, kind) with code point offsets, ends exclusive. A null text is empty and has no spans; added
    spans touch no base span and no other added one. Empty tables give an empty result; further columns are ignored.
    """
    proposed = cut_lineage(propose(docs, doc_id, text))
    weights = learn(proposed, most_spans)
    added = F.filter("proposed", lambda s: _is_personal(s, weights))
    spans = F.array_sort(F.concat(F.transform("base", _place), F.transform(added, _place)))
    return proposed.select("doc_id", "base", "base_sha256", spans.alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base spans' counts and digest, all spans, and the numbers of all and of the added ones."""
    out = find_personal(read_table(spark, sf_dir, "documents"))
    kinds = F.col("base")["kind"]
    counts = {f"n_{kind}": (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long") for kind in BASE_KINDS}
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *(c.alias(n) for n, c in counts.items()), "base_sha256", listed.alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
