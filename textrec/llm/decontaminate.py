"""Benchmark passages in training documents, found over a positional inverted index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.llm.common import ascii_lower
from textrec.session import stored

# What stands between words after lower-casing A-Z: ASCII white space, punctuation and control characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10

# Stands at the end of every document's words, so that its length is in the index.
END = "\n"


def words(text: str | Column) -> Column:
    """The words of a text in order; none for null.

    Cut between words, which Spark does several times faster than it lists
    matches; what is empty stands before the first word or after the last.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def terms_of(phrases: DataFrame) -> DataFrame:
    """``(word, term)``: a number from 2 on for each word of the ``phrases (phrase, words)``, and 1 for the end of a document."""
    used = phrases.select(F.explode("words").alias("word")).distinct()
    end = phrases.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(1).cast("long").alias("term"))
    return stored(used.select("word", (F.monotonically_increasing_id() + 2).alias("term")).union(end), "terms")


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, doc, at, term)``: where each of the ``terms`` stands in each document, and where each document ends.

    ``doc`` is a digest of the text; with the id it tells documents apart, so
    repeated rows share their postings and rows with one id and other texts do
    not. The postings are written to the shared folder: documents are taken apart
    once, and without a shuffle where Spark finds the terms small enough.
    """
    named = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("doc"),
        F.concat(words(text_col), F.array(F.lit(END))).alias("words"),
    )
    # No list is empty, as the end is in it. The outer form keeps Spark from cutting each text a second time to look for empty lists.
    tokens = named.select("id", "doc", F.posexplode_outer("words").alias("at", "word"))
    return stored(tokens.join(terms, "word").select("id", "doc", "at", "term"), "postings")


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(item, words)``: each run of ``size`` words of an item; a shorter item is one window, an empty one none."""
    named = items.select(F.col(id_col).alias("item"), words(text_col).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - size, F.lit(0))
    starts = named.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    return starts.select("item", F.slice("all", F.col("start") + 1, F.lit(size)).alias("words"))


def _same_place(left: str, right: str, *more: str) -> Column:
    """Joined by document; ids may be null on both sides."""
    tests = [F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")), F.col(f"{left}.doc") == F.col(f"{right}.doc")]
    for name in more:
        tests.append(F.col(f"{left}.{name}") == F.col(f"{right}.{name}"))
    out = tests[0]
    for test in tests[1:]:
        out &= test
    return out


def phrase_places(index: DataFrame, phrases: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """``(phrase, size, id, doc, start)``: every place where a phrase stands.

    ``phrases`` has ``phrase`` and ``words``. Each list of postings, less the
    term's place in the phrase, gives possible starts. The lists of the two
    rarest terms of a phrase (by postings in the whole index) are intersected
    first; what is left asks for all its terms, in the postings of the documents
    that are left. With ``slop`` each word may stand up to that many words before
    or after its place (proximity), and a start is any from which that holds.

    Joins are by document and position, so a frequent term spreads over all
    tasks; only lists are found by term, from a table as small as the phrases.
    """
    listed = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("i", "word"))
    asked = listed.join(terms, "word").select("phrase", "size", "i", "term")
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    rarity = Window.partitionBy("phrase").orderBy("n", "term", "i")
    known = asked.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = stored(known.withColumn("step", F.row_number().over(rarity)), "asked")

    def starts(step: int) -> DataFrame:
        rare = ranked.where((F.col("step") == step) & (F.col("n") > 0)).select("phrase", "size", "i", "term")
        found = index.join(rare, "term").select("phrase", "size", "id", "doc", (F.col("at") - F.col("i")).alias("start"))
        if slop:
            near = F.sequence(F.col("start") - slop, F.col("start") + slop)
            found = found.withColumn("start", F.explode(near))  # a start found twice goes with what likely repeats
        return found.where(F.col("start") >= -slop)

    first = starts(1)
    second = first.where("size > 1").alias("a").join(starts(2).alias("b"), _same_place("a", "b", "phrase", "start"), "left_semi")
    likely = stored(first.where("size = 1").union(second).distinct(), "likely")
    there = stored(likely.select("id", "doc").distinct(), "likely-documents")
    near = index.alias("a").join(there.alias("b"), _same_place("a", "b"), "left_semi")
    wanted = likely.join(ranked.select("phrase", "i", "term"), "phrase").withColumn("at", F.col("start") + F.col("i"))
    if slop:
        wanted = wanted.withColumn("at", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)))
    met = wanted.alias("a").join(near.alias("b"), _same_place("a", "b", "at", "term"), "left_semi")
    whole = met.groupBy("phrase", "size", "id", "doc", "start").agg(F.count_distinct("i").alias("met"))
    return whole.where(F.col("met") == F.col("size")).select("phrase", "size", "id", "doc", "start")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW_WORDS,
    slop: int = 0,
    digest: str | None = None,
) -> DataFrame:
    """``(id_col, n_words, n_hit, items)`` of every row of ``docs``.

    ``n_hit`` counts the words inside any place of any window of an item,
    ``items`` are the ids of the items found, as sorted texts. A window is
    ``size`` consecutive words; an item with fewer is one window. Null and empty
    texts have no words and no windows; an item with a null id marks words but is
    not listed; repeated items count once and repeated documents are all
    returned. Other columns are not looked at. Without documents there are no
    rows, without items nothing is hit. With a name for the ``digest`` of a row's
    text (``xxhash64``) it is a further column. Built-in functions only.
    """
    cut = windows(items, size, item_col, item_text_col)
    phrases = stored(cut.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "windows")
    terms = terms_of(phrases)
    index = positional_index(docs, terms, id_col, text_col)
    places = stored(phrase_places(index, phrases, terms, slop), "places")

    ends = index.where(F.col("term") == 1).select("id", "doc", F.col("at").cast("long").alias("n_words"))
    lengths = ends.distinct()
    if slop:  # a shifted place may reach over either end
        places = places.alias("a").join(lengths.alias("b"), _same_place("a", "b")).select("a.*", "n_words")
    else:
        places = places.withColumn("n_words", F.lit(None).cast("long"))
    spans = places.groupBy("id", "doc", F.greatest("start", F.lit(0)).alias("start")).agg(
        F.max(F.least(F.col("start") + F.col("size"), F.coalesce("n_words", F.col("start") + F.col("size")))).alias("end")
    )
    before = Window.partitionBy("id", "doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reached", F.lit(0))))
    hits = spans.withColumn("reached", F.max("end").over(before)).groupBy("id", "doc").agg(F.sum(covered).cast("long").alias("n_hit"))

    of = cut.join(phrases, "words").select("phrase", F.col("item").cast("string").alias("item")).distinct()
    named = places.select("phrase", "id", "doc").distinct().join(of, "phrase").where(F.col("item").isNotNull())
    found = named.groupBy("id", "doc").agg(F.sort_array(F.collect_set("item")).alias("items"))

    both = hits.alias("a").join(found.alias("b"), _same_place("a", "b"), "left").select("a.id", "a.doc", "n_hit", "items")
    out = ends.alias("a").join(both.alias("b"), _same_place("a", "b"), "left")
    return out.select(
        *([F.col("a.doc").alias(digest)] if digest else []),
        F.col("a.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a window of any item, all columns unchanged, whatever their names.

    A row is judged by its own text: one with a null id goes if it holds a
    window, and of several rows with an id those that hold one go.
    """
    own, text = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"  # no columns of the table
    found = contamination(docs, items, id_col, text_col, digest=text, **options).where("n_hit > 0")
    hit = stored(found.select(F.col(id_col).alias(own), text).distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(text))
    return docs.join(hit, same, "left_anti")
