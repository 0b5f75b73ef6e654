"""Ranked retrieval of items for questions by a fielded lexical score.

An item's fields are title, keywords, summary, content and source. A question's terms each count with the largest weight among the
fields that hold the term, times its inverse document frequency over the items at hand; phrases, aliases and the share
of terms that are met add to it. Term matches come from a join on terms, so that nothing is scored that shares no term. A phrase that
stands in a text has all its words but the first and the last as words of the text: it is looked for where a join on the longest of these
says so. Shorter phrases are looked for in every text. What questions hold is sent to the texts, which stay where they are.

Items have: id, pos (the order that breaks ties), title, chapter, section_path, teacher_topic, teacher_concepts, aliases, keywords, summary,
explanation, teacher_limit, content, source, scope, priority; missing ones are filled in by ``as_items``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import ALIAS, CONTENT_PHRASE, CONTEXT_SHARE, COVERAGE, FIELD_WEIGHTS, MOST_ALTERNATIVE, PRIORITY, TITLE_PHRASE
from lectern.functions.text import normalize, query_terms, stem
from lectern.operators.knowledge import cut

TEXTS = ("title", "chapter", "teacher_topic", "summary", "explanation", "teacher_limit", "content", "source", "scope", "priority")
LISTS = ("section_path", "teacher_concepts", "aliases", "keywords")
BLOCK = 4096  # short phrases that are looked for together in a text
SMALL = 200_000  # rows of questions that are sent to every task; more are merged
PIECE = 5  # letters of a word that are joined on, where it stands within another
LONG_WORD = 256
PAIRS = 1_000_000  # items times questions of one task, where their pairs are made


def as_items(df: DataFrame) -> DataFrame:
    """``df`` with all columns of an item; missing texts are empty, missing lists too, a missing scope is "included"."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in TEXTS}
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in df.columns else F.array().cast("array<string>") for c in LISTS}
    filled = df.select("id", "pos", *(v.alias(k) for k, v in (texts | lists).items()))
    return filled.withColumns({"scope": F.coalesce(F.nullif("scope", F.lit("")), F.lit("included")), "priority": F.coalesce(F.nullif("priority", F.lit("")), F.lit("normal"))})


def in_scope(items: DataFrame, include_reference: bool = False) -> DataFrame:
    """Items that may be shown: never excluded ones, reference material on demand."""
    return items.filter(F.col("scope").isin("included", "reference") if include_reference else F.col("scope") == "included")


def body_of(explanation: str = "explanation") -> Column:
    """The first of content, explanation and summary that isn't empty."""
    return F.coalesce(F.nullif("content", F.lit("")), F.nullif(explanation, F.lit("")), F.nullif("summary", F.lit("")), F.lit(""))


def fields() -> dict[str, Column]:
    listed = F.concat("teacher_concepts", "aliases", "keywords")
    return {
        "title": normalize(F.concat_ws(" ", "title", "chapter", F.concat_ws(" ", "section_path"))),
        "keywords": normalize(F.concat_ws(" ", "teacher_topic", F.concat_ws(" ", listed))),
        "summary": normalize(F.concat_ws(" ", "summary", "explanation", "teacher_limit")),
        "content": normalize("content"),
        "source": normalize("source"),
    }


def item_columns(known: DataFrame) -> list[str]:
    """The columns that tell ``normalized`` items apart: pos, or id, lift and pos."""
    return [c for c in ("id", "lift", "pos") if c in known.columns]


def normalized(items: DataFrame) -> DataFrame:
    """(pos, the normalised fields, names): what scores read of the items; id and lift too, where there is a lift. names are aliases, keywords and concepts of three letters or more."""
    at = item_columns(items) if "lift" in items.columns else ["pos"]
    names = F.filter(F.transform(F.concat("aliases", "keywords", "teacher_concepts"), normalize), lambda a: F.length(a) >= 3)
    return items.select(*at, *(c.alias(k) for k, c in fields().items()), names.alias("names"))


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, kept, and sent to every task of a join where they are few."""
    kept = cut(rows)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def item_terms(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, or what else tells items apart, term, weight, in_text): the ``wanted`` terms (term) that ``normalized`` items hold, with the largest weight among their fields.

    Tokens that nobody asks for are dropped before anything is grouped. in_text is false for terms of an item's source alone.
    """
    at = item_columns(known)
    parts = F.array(*(F.struct(F.col(k).alias("text"), F.lit(w).alias("weight"), F.lit(k != "source").alias("in_text")) for k, w in FIELD_WEIGHTS.items()))
    tokens = known.select(*at, F.inline(parts)).select(*at, "weight", "in_text", F.explode(F.array_distinct(F.split("text", " "))).alias("token")).filter(F.length("token") >= 3)
    named = tokens.select(*at, stem(F.col("token")).alias("term"), "weight", "in_text").join(sent(wanted.select("term").distinct()), "term", "left_semi")
    # An item's terms stay together, so that its scores are summed up before they are shuffled.
    return named.repartition("pos").groupBy(*at, "term").agg(F.max("weight").alias("weight"), F.max("in_text").alias("in_text"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(q_id, term, n_terms) of questions (q_id, question)."""
    return questions.select("q_id", query_terms("question").alias("terms")).select("q_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def idf_table(held: DataFrame, n_items: int) -> DataFrame:
    """(term, df, idf) of the terms that questions and items share; ``held`` has a row for each item and term."""
    df = held.filter("in_text").groupBy("term").agg(F.count("*").alias("df"))
    n = float(max(1, n_items))
    return df.withColumn("idf", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def longest_word(phrase: str) -> Column:
    """The first of the longest words of a normalised phrase."""
    words = F.transform(F.split(phrase, " "), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("place"), w.alias("word")))
    return F.array_max(words)["word"]


def _stretches(text: Column, size: int) -> Column:
    """A text in stretches of ``size`` letters, each with the few that follow, so that a piece lies within one."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(starts, lambda k: F.substr(text, k * size + 1, F.lit(size + PIECE - 1)))


def words_around(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, part) for each of the distinct ``words`` (word) and the ``parts`` (part) that stand in it, by a join on the first letters of the parts.

    A word of over ``LONG_WORD`` letters is looked at stretch by stretch, under a digest, and read again as a whole only for the parts of which it has the first letters.
    """
    def pieces(size: int) -> Column:
        places = F.sequence(F.lit(1), F.length("word") - size + 1)
        return F.when(F.length("word") >= size, F.transform(places, lambda i: F.substr(F.col("word"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    every_piece = F.explode(F.array_distinct(F.concat(*(pieces(n) for n in range(1, PIECE + 1))))).alias("piece")
    keyed = parts.select("part", F.left("part", F.lit(PIECE)).alias("piece")).distinct()
    cut_words = words.filter(F.length("word") <= LONG_WORD).select("word", every_piece)
    found = cut_words.join(keyed, "piece").filter(F.contains("word", F.col("part"))).select("word", "part")
    long = words.filter(F.length("word") > LONG_WORD).select("word", F.sha2("word", 256).alias("digest"))
    coarse = long.select("digest", F.explode(_stretches(F.col("word"), LONG_WORD * LONG_WORD)).alias("word"))
    fine = coarse.select("digest", F.explode(_stretches(F.col("word"), LONG_WORD)).alias("word")).select("digest", every_piece)
    maybe = fine.join(keyed, "piece").select("digest", "part").distinct()
    return found.unionByName(long.join(maybe, "digest").filter(F.contains("word", F.col("part"))).select("word", "part"))


def inner_word(phrase: str) -> Column:
    """The longest word of a phrase between its first and its last, which any text that has the phrase has as a word; null without one."""
    words = F.split(phrase, " ")
    inner = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("place"), w.alias("word")))
    return F.array_max(inner)["word"]


def texts_with(texts: DataFrame, columns: list[str], phrases: DataFrame, words: Column, held: Callable[[Column], Column], block: int = BLOCK) -> DataFrame:
    """(columns, _key, phrase) of each row of ``texts`` and each of the ``phrases`` (key, phrase) for which ``held``, a test of a phrase, is true.

    ``words`` are the words of what ``held`` looks at, cut at blanks. Texts aren't moved: phrases go to them, those of three words and more by an inner word, others all, ``block`` at a time.
    """
    told = cut(phrases.select(F.col("key").alias("_key"), "phrase", inner_word("phrase").alias("word")))
    n_all, n_long = told.agg(F.count("*"), F.count("word")).first()
    n = max(1, -(-(n_all - n_long) // block))
    blocks = told.filter("word IS NULL").groupBy(F.pmod(F.hash("_key", "phrase"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("_key", "phrase")).alias("ps"))
    dealt = texts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = dealt.join(F.broadcast(blocks), "b").select(*columns, F.explode(F.filter("ps", lambda p: held(p["phrase"]))).alias("p")).select(*columns, "p._key", "p.phrase")
    if not n_long:
        return found
    long = told.filter("word IS NOT NULL")
    by_word = texts.withColumn("word", F.explode(F.array_distinct(words))).join(F.broadcast(long) if n_long <= SMALL else long, "word").filter(held(F.col("phrase"))).select(*columns, "_key", "phrase")
    return by_word if n_all == n_long else by_word.unionByName(found)


def phrase_parts(known: DataFrame, questions: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions that stand in an item's text as a whole (q_id, pos, bonus), the items' names (pos, name), and those of them that stand in a question (q_id, name).

    ``known`` is what ``normalized`` gives.
    """
    at = item_columns(known)
    asked = cut(questions.filter(F.size(query_terms("question")) > 0).select(F.col("q_id").alias("key"), normalize("question").alias("phrase")))
    texts = known.select(*at, F.concat_ws(" ", "title", "keywords").alias("heads"), "content")
    words = F.split(F.concat_ws(" ", "heads", "content"), " ")
    # The phrase goes with its hits, so that a text is asked for its heads and its content once for each hit.
    bonus = F.when(F.contains("heads", F.col("phrase")), TITLE_PHRASE).otherwise(0.0) + F.when(F.contains("content", F.col("phrase")), CONTENT_PHRASE).otherwise(0.0)
    found = texts_with(texts, [*at, "heads", "content"], asked, words, lambda p: F.contains("heads", p) | F.contains("content", p), block)
    in_text = found.select(F.col("_key").alias("q_id"), *at, bonus.alias("bonus"))

    names = known.select(*at, F.explode("names").alias("name"))
    parts = names.select("name").distinct().withColumn("part", longest_word("name"))
    said = asked.select(F.col("key").alias("q_id"), "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    meant = said.join(words_around(said.select("word").distinct(), parts.select("part")), "word").join(parts, "part").filter(F.contains("phrase", F.col("name"))).select("q_id", "name").distinct()
    return in_text, names, meant


def phrase_hits(known: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q_id, pos, bonus) for questions that stand in an item's text as a whole, and for item names that stand in a question."""
    in_text, names, meant = phrase_parts(known, questions, block)
    by_name = names.join(sent(meant), "name").groupBy("q_id", "pos").agg((F.count("*") * F.lit(ALIAS)).cast("double").alias("bonus"))
    return in_text.unionByName(by_name).groupBy("q_id", "pos").agg(F.sum("bonus").alias("bonus"))


def shares(known: DataFrame, questions: DataFrame) -> DataFrame:
    """(q_id, pos, s, met, n_terms): what each term and each phrase adds to a score, for ``summed``; document frequencies count the given items."""
    asked = cut(question_terms(questions))
    # Read texts once: what questions and items share is small, and serves the frequencies and the sums.
    held = cut(item_terms(known, asked))
    weighed = sent(asked.join(idf_table(held, known.count()), "term", "left").select("q_id", "term", "n_terms", F.coalesce("idf", F.lit(1.0)).alias("idf")))
    by_term = held.join(weighed, "term").select("q_id", "pos", (F.col("weight") * F.col("idf")).alias("s"), F.lit(1).alias("met"), "n_terms")
    return by_term.unionByName(phrase_hits(known, questions).select("q_id", "pos", F.col("bonus").alias("s"), F.lit(0).alias("met"), F.lit(1).alias("n_terms")))


def summed(of: Column | None = None) -> Column:
    """The score of the ``shares`` of a question and an item, or of those of them that ``of`` tells; 0 without any."""
    only = (lambda c: F.when(of, F.col(c))) if of is not None else F.col
    return F.coalesce(F.sum(only("s")) + F.sum(only("met")) / F.max(only("n_terms")) * COVERAGE, F.lit(0.0))


def score(known: DataFrame, questions: DataFrame) -> DataFrame:
    """(q_id, pos, score) of all ``normalized`` items with a score above zero; document frequencies count the given items."""
    return shares(known, questions).groupBy("q_id", "pos").agg(summed().alias("score"))


def rank(items: DataFrame, questions: DataFrame, *, include_reference: bool = False, contexts: DataFrame | None = None, alternatives: DataFrame | None = None) -> DataFrame:
    """(q_id, pos, id, direct, contextual, expanded, score), unordered.

    ``contexts`` (q_id, question) are what was said before each question, ``alternatives`` (q_id, alt, question, weight) other wordings.
    An item needs one of the three scores; its priority then adds to or takes from the sum.
    """
    items = in_scope(as_items(items), include_reference)
    known = cut(normalized(items))
    rows = shares(known, questions).withColumn("told", F.lit(False))
    if contexts is not None:
        rows = rows.unionByName(shares(known, contexts).withColumn("told", F.lit(True)))
    found = rows.groupBy("q_id", "pos").agg(summed(~F.col("told")).alias("direct"), summed(F.col("told")).alias("contextual"))
    if alternatives is not None:
        keyed = alternatives.select(F.struct("q_id", "alt").alias("q_id"), "question")
        other = score(known, keyed).select(F.col("q_id.q_id").alias("q_id"), F.col("q_id.alt").alias("alt"), "pos", "score")
        other = other.join(alternatives.select("q_id", "alt", F.least(F.lit(MOST_ALTERNATIVE), "weight").alias("weight")), ["q_id", "alt"])
        found = found.join(other.groupBy("q_id", "pos").agg(F.max(F.col("score") * F.col("weight")).alias("expanded")), ["q_id", "pos"], "full_outer").fillna(0.0, ["direct", "contextual", "expanded"])
    else:
        found = found.withColumn("expanded", F.lit(0.0))
    lift = F.coalesce(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[F.col("priority")], F.lit(0.0))
    total = F.col("direct") + CONTEXT_SHARE * F.col("contextual") + F.col("expanded") + lift
    return found.join(items.select("pos", "id", "priority").hint("merge"), "pos").withColumn("score", total).select("q_id", "pos", "id", "direct", "contextual", "expanded", "score")


def dealt_shares(known: DataFrame, n_items: int, questions: DataFrame, tasks: int) -> DataFrame:
    """(q_id, id, lift, pos, s, met, n_terms) as ``shares``, lying by id in so many ``tasks``: terms and names are dealt before they meet the questions, so that pairs are never moved."""
    at = item_columns(known)
    asked = cut(question_terms(questions))
    held = cut(item_terms(known, asked))
    weighed = sent(asked.join(idf_table(held, n_items), "term", "left").select("q_id", "term", "n_terms", F.coalesce("idf", F.lit(1.0)).alias("idf")))
    in_text, names, meant = phrase_parts(known, questions)
    none = [F.lit(0).alias("met"), F.lit(1).alias("n_terms")]
    by_term = held.select(*at, "term", "weight").repartition(tasks, "id").join(weighed, "term").select("q_id", *at, (F.col("weight") * F.col("idf")).alias("s"), F.lit(1).alias("met"), "n_terms")
    wanted = sent(meant)
    by_name = names.join(wanted.select("name").distinct(), "name", "left_semi").repartition(tasks, "id").join(wanted, "name").select("q_id", *at, F.lit(ALIAS).cast("double").alias("s"), *none)
    by_text = in_text.repartition(tasks, "id").select("q_id", *at, F.col("bonus").alias("s"), *none)
    return by_term.unionByName(by_name).unionByName(by_text)


def best(items: DataFrame, questions: DataFrame, k: int, *, include_reference: bool = False, contexts: DataFrame | None = None, alternatives: DataFrame | None = None, per_item: bool = False) -> DataFrame:
    """The ``k`` best rows of ``rank`` for each question, with their ``rank``; with ``per_item`` each id counts once, by its best row.

    Pairs of questions and items are made, summed up and compared where the item lies, and only the best of a task are moved.
    """
    lift = F.coalesce(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[F.col("priority")], F.lit(0.0))
    # Texts are dealt evenly, once: a file may be few tasks, and each of its texts many pieces.
    known = cut(normalized(in_scope(as_items(items), include_reference).withColumn("lift", lift).repartition("pos")))
    n_items, at = known.count(), ["id", "lift", "pos"]
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_items * questions.count() // PAIRS))
    rows = dealt_shares(known, n_items, questions, tasks).withColumn("told", F.lit(False))
    if contexts is not None:
        rows = rows.unionByName(dealt_shares(known, n_items, contexts, tasks).withColumn("told", F.lit(True)))
    found = rows.groupBy("q_id", *at).agg(summed(~F.col("told")).alias("direct"), summed(F.col("told")).alias("contextual")).withColumn("expanded", F.lit(0.0))
    if alternatives is not None:
        # Many questions have the same other wordings, each of which is scored once.
        wordings = cut(alternatives.select("question").distinct().withColumn("wording", F.monotonically_increasing_id()))
        worded = alternatives.join(wordings, "question").groupBy("wording", "q_id").agg(F.max(F.least(F.lit(MOST_ALTERNATIVE), "weight")).alias("weight"))
        other = dealt_shares(known, n_items, wordings.select(F.col("wording").alias("q_id"), "question"), tasks).groupBy("q_id", *at).agg(summed().alias("score")).withColumnRenamed("q_id", "wording")
        other = other.join(sent(worded), "wording")
        other = other.select("q_id", *at, F.lit(0.0).alias("direct"), F.lit(0.0).alias("contextual"), (F.col("score") * F.col("weight")).alias("expanded"))
        found = found.unionByName(other).groupBy("q_id", *at).agg(*(F.max(c).alias(c) for c in ("direct", "contextual", "expanded")))
    total = F.col("direct") + CONTEXT_SHARE * F.col("contextual") + F.col("expanded") + F.col("lift")
    ranked = found.withColumn("score", total).select("q_id", "pos", "id", "direct", "contextual", "expanded", "score")
    return top(best_per_item(ranked) if per_item else ranked, k)


def top(ranked: DataFrame, k: int, by: list[str] = ["q_id"]) -> DataFrame:  # noqa: B006
    """The ``k`` best rows of each question with their ``rank``; ties keep the items' order. Scores tie from six decimals."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 6).desc(), "pos")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_per_item(ranked: DataFrame, key: str = "id") -> DataFrame:
    """Of several passages of an item, the best for each question."""
    order = Window.partitionBy("q_id", key).orderBy(F.round("score", 6).desc(), "pos")
    return ranked.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def alternatives(entries: DataFrame, questions: DataFrame, most: int = 12) -> DataFrame:
    """(q_id, alt, question, weight): other wordings from the entries that a question found.

    ``entries`` has q_id, rank, term, aliases, related. A term weighs 0.48, up to four aliases 0.56 each, up to three related terms
    0.22. Wordings without terms, like the question or like an earlier one count for nothing; the first ``most`` stay.
    """
    wording = lambda text, w, place: F.struct(text.alias("question"), F.lit(w).alias("weight"), F.lit(place).alias("place"))
    listed = F.concat(F.array(wording(F.col("term"), 0.48, 0)), F.transform(F.slice("aliases", 1, 4), lambda a: wording(a, 0.56, 1)), F.transform(F.slice("related", 1, 3), lambda r: wording(r, 0.22, 2)))
    rows = entries.select("q_id", "rank", F.posexplode(listed).alias("nth", "x")).select("q_id", "rank", "nth", "x.*").withColumn("key", normalize("question"))
    rows = rows.filter(F.size(query_terms("question")) > 0).join(questions.select("q_id", normalize("question").alias("asked")), "q_id").filter("key <> asked")
    first = Window.partitionBy("q_id", "key").orderBy("rank", "nth")
    order = Window.partitionBy("q_id").orderBy("rank", "nth")
    return rows.withColumn("again", F.row_number().over(first)).filter("again = 1").withColumn("alt", F.row_number().over(order)).filter(F.col("alt") <= most).select("q_id", "alt", F.trim("question").alias("question"), "weight")


def live_evidence(entries: DataFrame, corpus: DataFrame, include_reference: bool = False) -> DataFrame:
    """Index entries with what the corpus says of their evidence today.

    ``entries`` has entry_id and evidence (array of source_id, excerpt); evidence of unknown, excluded or hidden chunks goes, and
    an entry without any goes too. An entry is reference material if all its evidence is; it takes the best priority of its evidence.
    """
    told = entries.select("entry_id", F.posexplode("evidence").alias("nth", "e")).select("entry_id", "nth", "e.*")
    visible = in_scope(as_items(corpus), include_reference).select(F.col("id").alias("source_id"), F.col("source").alias("live_source"), "scope", "priority")
    rank_of = F.when(F.col("priority") == "central", 0).when(F.col("priority") == "normal", 1).otherwise(2)
    # Evidence goes by a table of its chunks; it is not sorted, since a chunk may have very many entries.
    rolled = told.join(visible.hint("shuffle_hash"), "source_id").withColumn("p", rank_of).groupBy("entry_id").agg(
        F.bool_and(F.col("scope") == "reference").alias("all_reference"), F.min("p").alias("p"),
        F.countDistinct("source_id").alias("n_sources"), F.min_by("live_source", "nth").alias("source"), F.count("*").alias("n_evidence"),
    )
    return rolled.select("entry_id", F.when(F.col("all_reference"), "reference").otherwise("included").alias("scope"), F.element_at(F.array(F.lit("central"), F.lit("normal"), F.lit("context")), F.col("p") + 1).alias("priority"), "n_sources", "n_evidence", "source")


def first_of_kinds(hits: DataFrame) -> DataFrame:
    """Hits of several kinds as one list for each question: kinds in order, each key once, ties by key. ``hits``: q_id, kind, rank, key."""
    first = Window.partitionBy("q_id", "key").orderBy("kind", "rank")
    order = Window.partitionBy("q_id").orderBy("kind", "rank", "key")
    return hits.withColumn("again", F.row_number().over(first)).filter("again = 1").drop("again").withColumn("place", F.row_number().over(order))


def retrieved_ids(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q_id, ids): the passages that each question's hits stand for, each once, in the order of the hits.

    ``hits``: q_id, place, kind, id; an entry (kind 0) stands for its evidence's sources (``evidence``: id, sources), any other hit for itself. Empty and null ids don't count; a question without any has no row. A question's hits are few.
    """
    met = hits.join(evidence.select("id", "sources").withColumn("kind", F.lit(0)), ["id", "kind"], "left")
    none = F.array().cast("array<string>")
    meant = F.when(F.col("kind") == 0, F.coalesce(F.col("sources").cast("array<string>"), none)).otherwise(F.array(F.col("id").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("place", "kind", "id", meant.alias("ids"))))
    told = met.groupBy("q_id").agg(F.array_distinct(F.filter(F.flatten(F.transform(listed, lambda x: x["ids"])), lambda x: x != "")).alias("ids"))
    return told.filter(F.size("ids") > 0)
