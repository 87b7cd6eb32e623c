"""Which passages of which pages fit a budget: topics, neighbours, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import identity as I
from claimloom.sources.scratch import read_once

#: Wording that makes a passage strong for a topic, and what it adds.
STRONG = {
    "cost": (r"(?i)(?:\$|€|£)\s?\d|\b(?:USD|EUR|GBP)\b", 8),
    "eligibility": (r"(?i)\b(?:eligible|eligibility|may apply|can apply|grades?\s+\d|high school|undergraduate|college students?)\b", 6),
    "deadline": (r"(?i)\b(?:deadline|due|closes?)\b", 5),
    "operator": (r"(?i)\b(?:operated|administered|run|managed|organized|provided) by\b", 7),
    "institution_relationship": (r"(?i)\b(?:partnership|partnered|sponsored|hosted|operated|administered) by\b", 6),
}
#: Wording of the passages that a stage of extraction reads.
STAGES = {
    "foundation": r"(?i)\b(name|about|operat|administ|sponsor|fund(?:er|ing)?|host|partner|institution|university|college|founder|mentor|staff|eligib|grade|age|citizen|resident|team|individual|cycle|cohort|season|fall|winter|spring|summer|track|tier|variant|current|upcoming|20\d{2})\b",
    "process": r"(?i)\b(apply|application|deadline|date|schedule|interview|review|semifinal|finalist|winner|selection|round|stage|pathway|advance|pitch|submission|notification|travel|hours?|weeks?|duration|online|virtual|remote|campus|residential|in[ -]person)\b",
    "financial": r"(?i)\b(tuition|cost|fee|deposit|refund|aid|scholarship|prize|award|stipend|fund|funding|budget|cash|reimburse|travel support|lodging|meals|materials|certificate|credit|mentorship|equipment|benefit|outcome|recipient|distribution|winner|finalist|team|individual|school|teacher|educator)\b",
}
ORGANIZATION_PAGE = r"(?i)\b(?:about|privacy|terms)(?:\b|[-_/])"


def plain_blocks(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """TXT-09: the nonempty lines of a plain text as paragraphs, ``block_index`` from 0."""
    lines = F.filter(F.transform(F.split(F.col(text_col), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\f\x0b ]+", " "))), lambda x: x != "")
    return texts.select(*(c for c in texts.columns if c != text_col), F.posexplode(lines).alias("block_index", "text"))


def topic_score(text: Column, topic: Column, n_topics: Column, first_source: Column) -> Column:
    """ORD-05: how well a passage speaks to a topic."""
    score = F.when(first_source, 2).otherwise(0) + F.when(F.length(text).between(24, 1600), 2).otherwise(0) + F.when(text.rlike(r"\d"), 1).otherwise(0) + F.when(n_topics == 1, 1).otherwise(0)
    return score + sum((F.when((topic == name) & text.rlike(p), worth).otherwise(0) for name, (p, worth) in STRONG.items()), F.lit(0))


def topic_passages(blocks: DataFrame, most: int = 3) -> DataFrame:
    """WIN-07: ``(slug, topic, place, source_index, block_index, score)``: the best passages of each topic, one of each source first. A passage that many blocks repeat is read once.

    ``blocks``: ``(slug, source_index, block_index, text)``.
    """
    read = read_once(blocks, ["text"], F.size("topics") > 0, topics=F.transform(E.topics(F.col("text")), lambda t: F.struct(t.alias("topic"), topic_score(F.col("text"), t, F.size(E.topics(F.col("text"))), F.lit(False)).alias("says"))))
    one = read.select("slug", "source_index", "block_index", F.explode("topics").alias("t"))
    scored = one.select("slug", "source_index", "block_index", "t.topic", (F.col("t.says") + F.when(F.col("source_index") == 0, 2).otherwise(0)).alias("score"))
    order = [F.desc("score"), "source_index", "block_index"]
    nth = scored.withColumn("nth", F.row_number().over(Window.partitionBy("slug", "topic", "source_index").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy("slug", "topic").orderBy(F.col("nth") > 1, *order))
    return nth.withColumn("place", place).filter(F.col("place") <= most).select("slug", "topic", "place", "source_index", "block_index", "score")


def greedy_fill(passages: DataFrame, budget: int) -> DataFrame:
    """WIN-09: ``(slug, place)`` of the passages that fit, in order of ``place``; one that doesn't fit is skipped, and later ones still may.

    ``passages``: ``(slug, place, n_characters)``; a fold over the lengths of a card's passages, which its pages bound.
    """
    listed = passages.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("place", "n_characters"))).alias("listed"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def add(state, x):
        used = state["used"] + F.when(F.size(state["kept"]) > 0, 1).otherwise(0) + x["n_characters"]
        fits = used <= budget
        return F.struct(F.when(fits, used).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(x["place"].cast("int")))).otherwise(state["kept"]).alias("kept"))

    return listed.select("slug", F.explode(F.aggregate("listed", start, add)["kept"]).alias("place"))


def equal_shares(pages: DataFrame, budget: int) -> DataFrame:
    """WIN-10, AGG-21: ``(slug, source_index, share)``: an equal share for each page, and what short pages leave handed out in order; ``pages``: ``(slug, source_index, n_characters)``."""
    whole, order = Window.partitionBy("slug"), Window.partitionBy("slug").orderBy("source_index")
    shared = pages.withColumn("own", F.least(F.col("n_characters"), F.floor(F.lit(budget) / F.count("*").over(whole))))
    left = shared.withColumn("left", budget - F.sum("own").over(whole)).withColumn("more", F.col("n_characters") - F.col("own"))
    before = F.coalesce(F.sum("more").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return left.select("slug", "source_index", (F.col("own") + F.greatest(F.lit(0), F.least("more", F.col("left") - before))).alias("share"))


def stage_payload(blocks: DataFrame, stage: str, budget: int, heads: tuple[int, int] = (12, 5)) -> DataFrame:
    """TXT-11, WIN-04: ``(slug, source_index, text, truncated)``: a page's first blocks, those that match the stage, and the neighbours of both.

    Where all pages together exceed ``budget`` characters, each is cut to an equal share. A page's blocks are one list.
    """
    near = Window.partitionBy("slug", "source_index").orderBy("block_index").rowsBetween(-1, 1)
    head = F.col("block_index") < F.when(F.col("source_index") == 0, heads[0]).otherwise(heads[1])
    chosen = blocks.withColumn("own", (head | F.col("text").rlike(STAGES[stage])).cast("int")).withColumn("kept", F.max("own").over(near) == 1)
    pages = chosen.groupBy("slug", "source_index").agg(F.sum(F.length("text") + 1).alias("n"), F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("block_index", "text")))).alias("listed"))
    texts = pages.withColumn("text", F.array_join(F.transform("listed", lambda x: x["text"]), "\n"))
    whole = Window.partitionBy("slug")
    over = F.sum(F.length("text")).over(whole) > budget
    share = F.floor(F.lit(budget) / F.count("*").over(whole)).cast("int")
    cut = texts.withColumn("over", over).withColumn("share", share)
    return cut.select("slug", "source_index", F.when(F.col("over"), F.substring("text", F.lit(1), F.col("share"))).otherwise(F.col("text")).alias("text"), (F.col("over") | (F.length("text") < F.col("n") - 1)).alias("truncated"))


def source_relevance(pages: DataFrame) -> DataFrame:
    """TXT-10: ``(slug, source_index, relevance, explicit, targets)`` from ``(slug, source_index, url, title, headings)``; the first page of a slug is its target.

    ``headings``: the texts of the heading blocks among a page's first twelve.
    """
    named = F.flatten(F.transform(F.filter("headings", lambda h: h.rlike(I.KIND)), I.words))
    path = I.path_identity(F.col("url"))
    root = F.array_distinct(F.concat(I.title_words(F.col("title")), named, F.coalesce(I.words(path), F.array().cast("array<string>"))))
    own = F.array_distinct(F.concat(I.title_words(F.col("title")), F.flatten(F.transform("headings", I.words))))
    roots = pages.filter("source_index = 0").select("slug", root.alias("targets"), path.alias("root_path"))
    rows = pages.withColumn("path", path).withColumn("own", own).join(roots, "slug")
    fits = I.same_identity(F.col("targets"), F.col("own"))
    conflict = F.coalesce(F.col("path") != F.col("root_path"), F.lit(False))
    same_path = F.coalesce(F.col("path") == F.col("root_path"), F.lit(False))
    first_part = F.split("title", r"\s+[|–—:]\s+")[0]
    another = (F.size(I.distinctive(I.title_words(F.col("title")))) > 0) & (I.overlap(I.distinctive(F.col("targets")), I.distinctive(F.col("own"))) == 0) & first_part.rlike(I.KIND)
    first = F.col("source_index") == 0
    relevance = F.when(first, "target").when(conflict, "sibling").when(same_path | fits, "target").when(another, "sibling").when(F.col("url").rlike(ORGANIZATION_PAGE), "organization_level").otherwise("unclear")
    return rows.select("slug", "source_index", relevance.alias("relevance"), (relevance == "target").alias("explicit"), "targets")


def supports_target(relevance: Column, explicit: Column, targets: Column, excerpt: Column) -> Column:
    """FLT-20: a page may support a claim on the target: it is about it, or, if no sibling, its excerpt names two of the target's words."""
    named = I.overlap(targets, F.array_distinct(I.words(F.coalesce(excerpt, F.lit(""))))) >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(targets)))
    return (relevance != "sibling") & ((relevance == "target") | explicit | (F.coalesce(excerpt, F.lit("")) != "") & named)
