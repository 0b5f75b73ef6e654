"""Text functions as Column expressions: folding, tokens, keys, slugs, hashes, similarity. Nothing here leaves the JVM.

Each function takes columns (or names) and gives a column; null text counts as empty unless said otherwise. Lengths are in code
points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.fixed import DOCUMENT_TYPES, FOLLOW_UP, NO_AUTHOR, STOP_WORDS


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of ``value``, which is worked out once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def accent_map(first: int = 0xC0, end: int = 0x180) -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and those ASCII letters."""
    pairs = []
    for code in range(first, end):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(unicodedata.combining(m) for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = accent_map()


def fold(text: Column | str) -> Column:
    """Lower case without accents."""
    marked = F.translate(F.lower(F.coalesce(_col(text), F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_replace(marked, "[̀-ͯ]", "")


def normalize(text: Column | str) -> Column:
    """Folded letters and digits, all else one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def squeeze(text: Column | str) -> Column:
    """Folded, with white space squeezed."""
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def raw_tokens(normalized: Column | str) -> Column:
    return F.filter(F.split(_col(normalized), " "), lambda t: F.length(t) >= 3)


def stem(token: Column) -> Column:
    """Plural endings off: "es" from over six letters, "s" from over five."""
    n = F.length(token)
    return F.when((n > 6) & F.endswith(token, F.lit("es")), F.left(token, n - 2)).when((n > 5) & F.endswith(token, F.lit("s")), F.left(token, n - 1)).otherwise(token)


def terms(text: Column | str) -> Column:
    """Distinct stems of a text's tokens."""
    return F.array_distinct(F.transform(raw_tokens(normalize(text)), stem))


def query_terms(text: Column | str) -> Column:
    """Distinct stems of a question's tokens without stop words, in order."""
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))
    kept = F.filter(raw_tokens(normalize(text)), lambda t: ~F.array_contains(stops, t))
    return F.array_distinct(F.filter(F.transform(kept, stem), lambda t: F.length(t) >= 3))


def needs_context(question: Column | str) -> Column:
    """Whether a question leans on what was said before: it has no terms of its own, or a cue."""
    return (F.size(query_terms(question)) == 0) | normalize(question).rlike(FOLLOW_UP)


def furniture_key(text: Column | str) -> Column:
    """Key of a running header or footer: digits become #, all else but letters a space."""
    digits = F.regexp_replace(fold(text), "[0-9]+", "#")
    return F.trim(F.regexp_replace(digits, "[^a-z0-9#]+", " "))


def core_title(text: Column | str) -> Column:
    """A title's key without brackets, daggers and quotes."""
    return furniture_key(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "\\([^)]*\\)|[†‡*“”\"']+", " "))


def slug(text: Column | str, size: int, default: str) -> Column:
    """Folded words joined by dashes, one dash off either end, cut to ``size``; ``default`` where nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.left(dashed, F.lit(size)), F.lit("")), F.lit(default))


def clean_line(text: Column | str) -> Column:
    """Soft hyphens off, white space squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_col(text), F.lit("")), "­", ""), r"\s+", " "))


def clean_text(text: Column | str) -> Column:
    """Soft hyphens off, blanks squeezed, at most one empty line in a row."""
    soft = F.regexp_replace(F.translate(F.coalesce(_col(text), F.lit("")), "­\r", ""), "[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(soft, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def rejoin_hyphens(text: Column | str) -> Column:
    """Words that a hyphen and blanks before a small letter cut in two are joined."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), "([A-Za-zÀ-ÿ])-\\s+([a-zà-ÿ])", "$1$2")


def shorten(text: Column | str, size: int) -> Column:
    """Squeezed white space; what is longer than ``size`` ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.left(flat, F.lit(size - 1))), F.lit("…"))).otherwise(flat)


def split_list(text: Column | str, separator: str) -> Column:
    """Trimmed, non-blank parts of a cell."""
    return F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\\" + separator), lambda x: F.trim(x)), lambda x: x != "")


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), "[^0-9]", "")


def safe_name(text: Column | str, size: int = 120) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    return F.left(F.regexp_replace(fold(text), "[^a-z0-9._-]+", "_"), F.lit(size))


def numbering(text: Column | str) -> Column:
    """(number, level) of a heading such as "2.1 Name"; null without a number."""
    number = F.regexp_extract(clean_line(text), r"^([0-9]+(?:\.[0-9]+){0,8})[.)]?\s+\S", 1)
    return F.when(number != "", F.struct(number.alias("number"), F.least(F.size(F.split(number, r"\.")), F.lit(8)).alias("level")))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over code points, as eight hex digits."""
    letters = F.filter(F.split(F.coalesce(_col(text), F.lit("")), ""), lambda c: c != "")
    value = F.aggregate(letters, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619).bitwiseAND(4294967295))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal keys, 0.93 for a title within the other, else a mean of the overlaps of words of three letters and more."""
    return key_similarity(core_title(a), core_title(b))


def key_similarity(ka: Column, kb: Column) -> Column:
    """``title_similarity`` of titles whose ``core_title`` is known."""
    wa = F.array_distinct(F.filter(F.split(ka, " "), lambda t: F.length(t) >= 3))
    wb = F.array_distinct(F.filter(F.split(kb, " "), lambda t: F.length(t) >= 3))
    both, na, nb = F.size(F.array_intersect(wa, wb)).cast("double"), F.size(wa), F.size(wb)
    share = F.greatest(both / na * 0.62 + both / nb * 0.18, both / F.least(na, nb) * 0.84)
    within = (F.contains(ka, kb) | F.contains(kb, ka)) & (F.least(na, nb) >= 2)
    return F.when((ka == "") | (kb == ""), 0.0).when(ka == kb, 1.0).when(within, 0.93).when((na == 0) | (nb == 0), 0.0).otherwise(share)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word becomes one character, so that two texts are compared."""
    known = F.array_distinct(F.concat(a, b))
    drawn = lambda words: F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0")), "")), "UTF-32")
    return F.levenshtein(drawn(a), drawn(b))


def error_words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def duration_ms(text: Column | str) -> Column:
    """Milliseconds of a text such as "1h2m3.5s"; null without any part."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)(ms|d|h|m|s)"
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    units = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(2)), lambda u: F.when(u == "ms", 1.0).when(u == "s", 1000.0).when(u == "m", 60000.0).when(u == "h", 3600000.0).otherwise(86400000.0))
    values = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda v: v.cast("double"))
    parts = F.zip_with(values, units, lambda v, u: v * u)
    return F.when(F.size(parts) > 0, F.ceil(F.aggregate(parts, F.lit(0.0), lambda n, x: n + x)))


def token_estimate(text: Column | str, reserve: int = 0, images: int = 0) -> Column:
    """Tokens that a request may cost: a third of the characters, what is kept for the answer, and images."""
    return F.ceil(F.length(F.coalesce(_col(text), F.lit(""))) / 3.0) + reserve + 2088 * images + 200


def first_sentence(text: Column | str, size: int = 240) -> Column:
    """Up to the first full stop, at most ``size`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    found = F.regexp_extract(flat, r"^(.*?[.!?])( |$)", 1)
    return F.left(F.when(found != "", found).otherwise(flat), F.lit(size))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def document_type(text: Column | str) -> Column:
    """What kind of document a description speaks of; short material where it says nothing. Earlier kinds win."""
    said = fold(text)
    kind = F.lit(None)
    for name, words in DOCUMENT_TYPES:
        kind = F.coalesce(kind, F.when(said.rlike(rf"\b({words})\b"), F.lit(name)))
    return F.coalesce(kind, F.lit("apunte"))


def document_id(source_name: Column | str) -> Column:
    name = F.coalesce(F.nullif(_col(source_name), F.lit("")), F.lit("material"))
    return F.concat(F.lit("doc-"), slug(name, 56, "fragmento"))


def section_id(document: Column | str, nth: Column, path: Column, title: Column | str) -> Column:
    """The id of a document's ``nth`` section, from 0: its number stands before its path and title, which may be cut."""
    name = F.coalesce(F.nullif(_col(title), F.lit("")), F.lit("material"))
    parts = F.concat(F.array(_col(document), F.lit("seccion"), (nth + 1).cast("string")), F.coalesce(path, F.array().cast("array<string>")), F.array(name))
    return slug(F.array_join(parts, "-"), 56, "fragmento")


def page_list(text: Column | str, pages: Column) -> Column:
    """The whole numbers of a list with commas that are pages, each once, in order."""
    numbers = F.transform(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda x: F.trim(x).try_cast("double"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= pages) & (n == F.floor(n))), lambda n: n.cast("int"))))


def marked_pages(text: Column | str) -> Column:
    """An array of (page, text): what stands behind each line "=== page ==="; of a page that is marked twice, both in order. Without marks it is empty."""
    body = F.trim(F.coalesce(_col(text), F.lit("")))
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^===\s*([0-9]+)\s*===$"), F.lit(1)), lambda n: n.try_cast("int"))
    parts = F.split(body, r"(?m)^===\s*[0-9]+\s*===$")
    return F.transform(numbers, lambda n, i: F.struct(n.alias("page"), F.regexp_replace(parts[i + 1], r"^\s+|\s+$", "").alias("text")))


def author_guess(lines: Column | str) -> Column:
    """The first line of 120 characters at most with a capitalised word that names no institution and ends in no full stop; empty if there is none."""
    fits = F.filter(_col(lines), lambda x: (F.length(x) <= 120) & x.rlike("[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+") & ~F.lower(x).rlike(NO_AUTHOR) & ~x.rlike("[.!?]$"))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))
