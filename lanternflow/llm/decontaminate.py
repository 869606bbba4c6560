"""Benchmark decontamination with a distributed positional inverted index.

Every benchmark item is cut into windows of consecutive words. The index holds the positional
postings (term, document, position) of the terms that the windows are looked up by: for each
window the rarest of its terms over the whole corpus. A window's postings lists are shifted
by the term's place in the window and intersected, rarest first; what is left is compared
word by word with the document. Frequencies, postings and matches cover all documents.

Only DataFrame operations are used. The word frequencies and the index are shuffles with map-side
combining; rare terms have short lists by choice, so a frequent word never forms a hot key
unless all words of a passage are frequent, and then its list is part of the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import boxed, durable
from lanternflow.llm.urlfilter import LOWER, UPPER

# What separates words of a lowered text, as single characters. Cutting 0.1 GB of texts at it took 6 CPU seconds;
# extracting what matches the negated class of the ranges between took 112.
BETWEEN = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isdigit() and not chr(c).islower()) + "]+"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for a null."""
    return _words(F.translate(text, UPPER, LOWER))


def _words(lowered: Column) -> Column:
    # Cutting leaves an empty string before a separator that begins the text and after one that ends it.
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def _folded(text: Column) -> Column:
    """``lower()`` that doesn't depend on the neighbours: a capital sigma becomes one of two letters by its place."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _kept(text: Column, candidates: str, holds: Callable[[Column, Column], Column]) -> Column:
    """The ``candidates`` for which ``holds(words of the text, candidate)``; null for null.

    The words are bound as the element of a list, which cuts them once a row. As a column of their own the optimizer
    would put them into the inner function, where they are cut once a candidate.
    """
    each = F.transform(F.array(words_of(text)), lambda w: F.filter(candidates, lambda c: holds(w, c)))
    return F.when(F.col(candidates).isNotNull(), each[0])


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct windows: ``window, phrase, len, terms, items`` (ids of the items that hold it).

    ``window`` is a number by which the index knows the phrase; it holds once the table is written.

    ``width`` consecutive words; an item of fewer words, but not none, is one window.
    """
    w = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("terms"))
    return (each.groupBy(F.array_join("terms", " ").alias("phrase"))
            .agg(F.first("terms").alias("terms"), F.collect_set("item_id").alias("items"))
            .withColumn("len", F.size("terms")).withColumn("window", F.monotonically_increasing_id()))


def _tokens(docs: DataFrame) -> DataFrame:
    # Terms are folded by lower(), which is much cheaper than translate(), equates more words than A-Z
    # does, and cuts at the same places; with both sigmas made one, a word folds alike alone and in its
    # text. So lists are supersets, and the comparison that follows is exact.
    return docs.select("doc_id", F.posexplode(_words(_folded(F.col("text")))).alias("pos", "term"))


def build_index(docs: DataFrame, windows: DataFrame, rarest: int) -> tuple[DataFrame, DataFrame]:
    """(lookups ``window, term, off, turn``, postings ``term, doc_id, pos``), both written.

    A window is looked up at its ``rarest`` places with the least frequent terms; windows with
    a term that no document has can't occur and are left out.
    """
    places = windows.select("window", F.posexplode(F.transform("terms", _folded)).alias("off", "term"))
    vocabulary = durable(places.select("term").distinct())
    df = durable(_tokens(docs).select("term").join(vocabulary, "term", "left_semi")
                 .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    counted = (places.join(df, "term", "left").groupBy("window")
               .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("by_n"))
               .filter(F.col("by_n")[0]["n"] > 0))
    lookups = durable(counted.select("window", F.posexplode(F.slice("by_n", 1, rarest)).alias("turn", "t"))
                      .select("window", "turn", "t.off", "t.term"))
    postings = durable(_tokens(docs).join(lookups.select("term").distinct(), "term", "left_semi")
                       .select("term", "doc_id", "pos"))
    return lookups, postings


def phrase_candidates(lookups: DataFrame, postings: DataFrame) -> DataFrame:
    """``doc_id, window, start`` where all lookup terms of a window stand at their places."""
    shifted = (postings.join(lookups, "term").select("doc_id", "window", (F.col("pos") - F.col("off")).alias("start"), "turn")
               .filter("start >= 0"))
    wanted = lookups.groupBy("window").agg(F.bit_or(F.expr("shiftleft(1, turn)")).alias("all"))
    seen = shifted.groupBy("doc_id", "window", "start").agg(F.bit_or(F.expr("shiftleft(1, turn)")).alias("have"))
    return seen.join(wanted, "window").filter(F.col("have") == F.col("all")).select("doc_id", "window", "start")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2) -> DataFrame:
    """Add ``n_words, n_hit, hit_spans, item_ids`` to ``docs(doc_id, text, ...)``.

    A word is hit if it lies inside an occurrence of a window; ``hit_spans`` lists the
    occurrences as (start, len), ``item_ids`` the items that have an occurring window, sorted as
    strings. A null or wordless text has no words and no hits; a null item text has no window.
    Rows that share a doc_id are judged each by its own text. Columns of ``docs`` stay.
    """
    windows = durable(item_windows(items.select("item_id", "text"), width))
    base = docs.select("doc_id", "text")
    lookups, postings = build_index(base, windows, rarest)
    found = phrase_candidates(lookups, postings).join(windows.select("window", "phrase", "len", "items"), "window")
    # A document has at most one candidate per start and window length, so the list is no longer than its text.
    per_doc = durable(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "phrase", "items")).alias("_c")))
    own = boxed(docs, "n_words", "n_hit", "hit_spans", "item_ids")
    joined = own.join(per_doc.withColumnRenamed("doc_id", "_id").hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    exact = _kept(F.col("_row.text"), "_c", lambda w, c: F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ") == c["phrase"])
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    return (joined.withColumn("_hits", exact)
            .withColumn("n_words", F.size(_words(F.lower("_row.text"))).cast("long"))
            .withColumn("n_hit", F.when(F.col("_hits").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
            .withColumn("hit_spans", F.coalesce(F.transform("_hits", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"))),
                                                F.array().cast("array<struct<start:int,len:int>>")))
            .withColumn("item_ids", F.coalesce(F.array_sort(F.array_distinct(F.transform(
                F.flatten(F.transform("_hits", lambda c: c["items"])), lambda i: i.cast("string")))), F.array().cast("array<string>")))
            .select("_row.*", "n_words", "n_hit", "hit_spans", "item_ids"))


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 5) -> DataFrame:
    """``doc_id, phrase, items`` where all words of a window stand, in any order, within ``len + slop`` words.

    The postings of the window's rarest term give the places to look at; each is then checked
    in the document. Exact phrases are among the matches.
    """
    windows = durable(item_windows(items.select("item_id", "text"), width))
    base = docs.select("doc_id", "text")
    lookups, postings = build_index(base, windows, 1)
    near = (postings.join(lookups, "term").join(windows, "window")
            .groupBy("doc_id").agg(F.collect_list(F.struct("pos", "len", "phrase", "terms", "items")).alias("_c")))
    near = durable(near)
    joined = (base.join(near.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id"))
    inside = lambda w, c: F.exists(
        F.sequence(F.greatest(c["pos"] - c["len"] - slop + 1, F.lit(0)), c["pos"]),
        lambda s: F.size(F.array_except(c["terms"], F.slice(w, s + 1, c["len"] + slop))) == 0)
    return (joined.select("doc_id", F.explode(_kept(F.col("text"), "_c", inside)).alias("c"))
            .select("doc_id", "c.phrase", "c.items").distinct())
