"""Spelling variants: words one edit apart meet on shared deletions; the commoner one is the other's form.

Every word emits itself and its distinct single deletions. Words that are one edit apart share exactly one
of these keys, so the equi-join yields each such pair once each way. Distinct words that share a key of
length L differ in one place of at most L + 1, so a key holds at most (L + 1) x alphabet words, however
large the corpus is.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import materialise

#: Words are maximal runs of these letters; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 5


def word_counts(docs: DataFrame, spelt: Callable[[Column, Column], Column] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all words of at least ``least_length`` code points that occur ``least_count`` times overall.

    ``spelt`` maps (doc_id, lower-cased run) to the word to count, never a longer one. Counts are added up
    before the shuffle, so a word that fills a third of all texts is one row a task.
    """
    runs = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), f"[^{LETTERS}]+")).alias("run")).filter(F.length("run") >= least_length)
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    words = runs.select("doc_id", run.alias("run")).select((spelt(F.col("doc_id"), F.col("run")) if spelt else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keys(word: Column) -> Column:
    """The word and its distinct single deletions: of equal letters in a row only the last is deleted."""
    letters, length = F.split(word, ""), F.length(word)
    last = lambda i: (i == length - 1) | (F.get(letters, i) != F.get(letters, i + 1))
    places = F.filter(F.sequence(F.lit(0), length - 1), last)
    return F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i), F.substr(word, i + 2))))


def near_words(counts: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: every ordered pair of words that one inserted, deleted or replaced code point tells apart."""
    keys = counts.select("word", "n", F.explode(_keys(F.col("word"))).alias("key"))
    others = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return keys.join(others, "key").filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).drop("key")


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` at the end of each chain of ``(word, root)`` links.

    Each round every word takes the root of its root, so a chain of length c takes log2(c) rounds. Forms are
    ``FORM_RATIO`` times as common, so chains have no cycles and at most some dozens of links.
    """
    links = materialise(links, "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, spelt: Callable[[Column, Column], Column] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word counted.

    ``form``: the near word of largest n (ties: smallest in code-point order), if its n is at least ``ratio``
    times the word's; ``root``: the last form of the chain, the word itself if it has none. Null and empty
    texts have no words, texts without words neither; very long texts are read whole, in one task each; a
    word of L letters costs L squared bytes of keys; repeated rows count each; further columns are ignored;
    an empty table gives an empty result.
    """
    counts = materialise(word_counts(docs, spelt, least_length, least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    near = near_words(counts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = counts.join(near, "word", "left")
    has = F.col("best.form_n") >= ratio * F.col("n")
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, F.col("best.form_n")).alias("form_n")), "forms")
    roots = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
