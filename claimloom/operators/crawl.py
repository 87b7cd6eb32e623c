"""One level of links from every page, as joins: ranked links meet the table of pages on their resource."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import html, links
from claimloom.sources.scratch import cut

#: Why a linked page isn't reviewed.
NOT_FOUND, OTHER_ORIGIN = "FETCH_FAILED", "CROSS_ORIGIN_REDIRECT"


def crawl(pages: DataFrame, most: int = 6) -> DataFrame:
    """SRC-08: ``(page_id, place, url, topic, final_url, target_id, outcome)``, a row for each link that a page's ranking chooses.

    ``pages``: ``(url, html)`` and, where a request was redirected, ``final_url`` (null or absent: ``url``). ``outcome`` is
    ``reviewed``; ``duplicate`` where the page itself or an earlier link ends at the same address; else a
    failure: no such page, a page that isn't read (``page_status``), or a redirect to another origin, which only the first
    application link of a page may take. Of pages with one resource the one of smallest address is read; pages
    without a url lead nowhere. Of pages that end at one address the one of smallest title, then smallest links, gives the
    links; they are cut, since the ranking reads them twice and would have pages parsed twice. The join is on the resource and the windows on a page, which has at most ``most`` links.
    """
    given = pages if "final_url" in pages.columns else pages.withColumn("final_url", F.col("url"))
    final = given.select(F.coalesce("final_url", "url").alias("url"), "html")
    one = html.parse_pages(final).groupBy("page_id", F.col("url").alias("page_url")).agg(F.min(F.struct("title", "links")).alias("p"))
    opened = cut(one).select("page_id", "page_url", "p.title", F.explode("p.links").alias("l"))
    ranked = links.rank_links(opened.select("page_id", "page_url", "title", "l.document_order", "l.url", "l.text"), most)
    ends = html.page_status(final).filter("page_id IS NOT NULL").groupBy("page_id").agg(F.first("url").alias("end"), F.max(F.struct(F.col("status") == "read", "status"))["status"].alias("status"))
    asked = given.filter("url IS NOT NULL").select(T.canonical_url(F.col("url")).alias("asked"), T.stable_page_id(T.canonical_url(F.coalesce("final_url", "url"))).alias("target_id"))
    asked = asked.groupBy(U.resource_key(F.col("asked")).alias("resource")).agg(F.min(F.struct("asked", "target_id"))["target_id"].alias("target_id"))
    targets = asked.join(ends.select(F.col("page_id").alias("target_id"), F.col("end").alias("final_url"), "status"), "target_id")
    found = ranked.withColumn("resource", U.resource_key(T.canonical_url(F.col("url")))).join(targets, "resource", "left").join(ends.select("page_id", F.col("end").alias("page_url")), "page_id")
    earlier = F.count_if(F.col("topic") == "application").over(Window.partitionBy("page_id").orderBy("place"))
    abroad = (U.origin(F.col("final_url")) != U.origin(F.col("page_url"))) & ~((F.col("topic") == "application") & (earlier == 1))
    failure = F.when(F.col("target_id").isNull(), NOT_FOUND).when(abroad, OTHER_ORIGIN).when(F.col("status") != "read", F.col("status"))
    failed = found.withColumn("failure", failure)
    nth = F.row_number().over(Window.partitionBy("page_id", "failure", "target_id").orderBy("place"))
    outcome = F.coalesce("failure", F.when((F.col("target_id") == F.col("page_id")) | (nth > 1), "duplicate").otherwise("reviewed"))
    return failed.select("page_id", "place", "url", "topic", "final_url", "target_id", outcome.alias("outcome"))
