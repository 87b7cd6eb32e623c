"""Which links of a page lead to pages on the same opportunity: topics, identity, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import identity as I
from claimloom.functions import markers as M
from claimloom.functions import urls as U
from claimloom.sources.scratch import read_once

#: Topics in their order, each with its weight and patterns.
TOPICS = [
    ("privacy", 18, [r"\bprivacy\b", r"\bdata\s+(?:use|sharing|policy)\b"]),
    ("refund", 17, [r"\brefunds?\b", r"\bnon[ -]?refundable\b"]),
    ("cancellation", 16, [r"\bcancell?ation\b", r"\bcancel(?:led|ed|s|ing)?\b"]),
    ("financial_aid", 15, [r"\bfinancial\s+aid\b", r"\bscholarships?\b", r"\bfee\s+waivers?\b"]),
    ("cost", 14, [r"\btuition\b", r"\bcosts?\b", r"\bfees?\b", r"\bdeposits?\b", r"\bpricing\b"]),
    ("rules", 14, [r"\brules?\b", r"\bregulations?\b", r"\bguidelines?\b"]),
    ("terms", 14, [r"\bterms(?:\s+(?:of\s+(?:use|service)|and\s+conditions))?\b", r"\bconditions\b", r"\bpolic(?:y|ies)\b"]),
    ("faq", 13, [r"\bfaqs?\b", r"\bfrequently\s+asked\s+questions?\b", r"\bquestions?\s+and\s+answers?\b"]),
    ("eligibility", 12, [r"\beligib(?:le|ility)\b", r"\brequirements?\b", r"\bwho\s+can\s+apply\b"]),
    ("admissions", 11, [r"\badmissions?\b", r"\bselection\b", r"\brank(?:ed|ing|ings|s)?\b", r"\bfinalists?\b", r"\bmatch(?:ed|es|ing)?\b", r"\b(?:stages?|rounds?)\b"]),
    ("application", 10, [r"\bapply\b", r"\bapplication\b"]),
    ("award", 10, [r"\bawards?\b", r"\bprizes?\b", r"\bstipends?\b", r"\bbenefits?\b"]),
    ("schedule", 9, [r"\bschedules?\b", r"\bdates?\b", r"\bdeadlines?\b", r"\bcalendar\b"]),
    ("other", 8, [r"\babout(?:\s+us)?\b", r"\bwho\s+(?:we|they)\s+are\b", r"\borganization\b", r"\borganizer\b"]),
]
#: Wording that takes 10, and wording that takes 25; files and actions that no link leads to.
NEGATIVE = [r"\b(?:sign|log)[ -]?in\b", r"\baccounts?\b", r"\bdonat(?:e|ion)\b", r"\bcareers?\b", r"\bpress\b", r"\bnews\b", r"\bblog\b", r"\bsocial\b"]
STRONG_NEGATIVE = [r"\badmissions?\s+(?:results?|officers?|sessions?)\b", r"\bcounsel(?:ing|lor|lors)\b"]
NO_TEXT = r"(?i)\.(?:avif|bmp|csv|docx?|gif|jpe?g|json|mp3|mp4|mov|odt|pdf|png|pptx?|svg|webm|webp|xlsx?|xml|zip)$"
ACTIONS = r"(?i)(?:^|[\s/._-])(?:log[ -]?in|log[ -]?out|sign[ -]?in|sign[ -]?out|delete|unsubscribe|remove[ -]?account)(?:$|[\s/?#._=&-])"


def classify(text: Column, path: Column) -> Column:
    """TXT-06: (topic, score): a pattern in the text adds its weight, one in the path max(2, weight - 3), over all topics; the topic of the most, the earlier of equals."""
    text, path = F.lower(text), F.lower(path)
    each = [(topic, sum((F.when(text.rlike(p), w).otherwise(0) + F.when(path.rlike(p), max(2, w - 3)).otherwise(0) for p in patterns), F.lit(0))) for topic, w, patterns in TOPICS]
    both = F.concat(text, F.lit(" "), path)
    lost = sum((F.when(both.rlike(p), n).otherwise(0) for listed, n in ((NEGATIVE, 10), (STRONG_NEGATIVE, 25)) for p in listed), F.lit(0))
    best = F.array_max(F.array(*(F.struct(own.alias("own"), F.lit(-k).alias("first"), F.lit(topic).alias("topic")) for k, (topic, own) in enumerate(each))))
    return F.struct(F.when(best["own"] > 0, best["topic"]).otherwise("other").alias("topic"), (sum((own for _, own in each), F.lit(0)) - lost).alias("score"))


def rank_links(links: DataFrame, most: int = 6) -> DataFrame:
    """TXT-06, WIN-08, ORD-02: ``(page_id, place, url, topic, score)``: a page's best links, one of each topic first.

    ``links``: ``(page_id, page_url, title, document_order, url, text)``. Links to other origins, to the page itself, to files or actions,
    under another opportunity's path, or naming another opportunity are left out; each word of the title's identity in a
    link's adds 5; of a resource's links the best counts, the earlier of equals. A link that many pages repeat is read once.
    """
    url, page, path = F.col("url"), F.col("page_url"), M.searchable_url(F.col("url"))
    own, other = I.path_identity(page), I.path_identity(url)
    target, named = I.title_words(F.col("title")), I.title_words(F.col("text"))
    under = F.coalesce(own == other, F.lit(False))
    fits = (U.origin(url) == U.origin(page)) & (U.resource_key(url) != U.resource_key(page)) & U.is_public(url) & ~U.is_sensitive(url)
    fits = fits & ~U.part(url, "path").rlike(NO_TEXT) & ~F.concat("text", F.lit(" "), path).rlike(ACTIONS) & ~F.coalesce(own != other, F.lit(False))
    fits = fits & ~((F.col("title") != "") & ~under & I.names_another(F.col("text"), target))
    read = {"fits": fits, "c": classify(F.col("text"), path), "added": 5 * I.overlap(named, target), "key": U.resource_key(url)}
    score = F.col("c.score") + F.col("added")
    found = read_once(links, ["page_url", "title", "url", "text"], F.col("fits") & (score > 0), **read).withColumn("score", score)
    best = F.row_number().over(Window.partitionBy("page_id", "key").orderBy(F.desc("score"), "document_order"))
    order = [F.desc("score"), "document_order", "url"]
    one = found.select("page_id", "document_order", "url", "score", F.col("c.topic").alias("topic"), "key").withColumn("b", best).filter("b = 1")
    nth = one.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "topic").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("nth") > 1, *order))
    return nth.withColumn("place", place).filter(F.col("place") <= most).select("page_id", "place", "url", "topic", "score")
