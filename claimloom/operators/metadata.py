"""TXT-03: text blocks from the JSON-LD of pages, as a walk over VARIANT values, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators.html import MOST_BYTES
from claimloom.sources.scratch import cut

#: Fixed limits: scripts of a page, characters of a script, nodes of a script, characters of a page's blocks.
MOST_SCRIPTS, MOST_SCRIPT, MOST_NODES, MOST_CHARACTERS = 20, 250_000, 10_000, 50_000
#: Which properties of which type become blocks of which kind, in this order.
TEXTS = [
    ("Question", "name", "heading"),
    ("Answer", "text", "paragraph"),
    ("Course", "name", "heading"),
    ("Course", "description", "paragraph"),
    ("Course", "courseMode", "definition"),
    ("Course", "duration", "definition"),
    ("Course", "educationalLevel", "definition"),
    ("Offer", "price", "definition"),
    ("Offer", "priceCurrency", "definition"),
    ("Organization", "name", "definition"),
]
#: Which properties of which type are walked, in this order, after ``@graph``.
CHILDREN = [("FAQPage", "mainEntity"), ("Question", "acceptedAnswer"), ("Course", "provider"), ("Course", "offers")]
_LD = r"""<script\b[^>]*\btype\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s>]))[^>]*>"""


def _at(key: str, kind: str = "variant") -> Column:
    return F.expr(f"try_variant_get(v, '$[\"{key}\"]', '{kind}')")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def json_ld_scripts(pages: DataFrame) -> DataFrame:
    """``(page_id, path, v)``: the parsed scripts of each page that is read; malformed and too long ones are left out, comments and other scripts hold none."""
    url = T.canonical_url(F.col("url"))
    pattern = F.lit(rf"(?is)<!--.*?-->|({_LD}.*?)</script\b|<script\b.*?</script\b")
    # a page's text is named once, so whatever it is made of is made once
    read = lambda html: F.when((F.octet_length(html) <= MOST_BYTES) & F.contains(F.lower(html), F.lit("application/ld+json")), F.regexp_extract_all(html, pattern, 1))
    found = F.flatten(F.transform(F.array("html"), lambda html: F.coalesce(read(html), F.array().cast("array<string>"))))
    scripts = F.slice(F.filter(found, lambda s: s != ""), 1, MOST_SCRIPTS)
    opened = pages.filter(url.isNotNull()).select(T.stable_page_id(url).alias("page_id"), F.posexplode(scripts).alias("n", "script"))
    body = F.regexp_replace("script", r"(?is)^<script\b[^>]*>", "")
    fits = opened.select("page_id", "n", body.alias("body"))
    # parsed before the cut and asked for after it, or each script would be parsed for the condition too
    v = F.when((F.length("body") > 0) & (F.length("body") <= MOST_SCRIPT), F.try_parse_json("body"))
    return cut(fits.select("page_id", F.array("n").alias("path"), v.alias("v"))).filter("v IS NOT NULL")


def json_ld_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, place, kind, text)`` of what a page's JSON-LD says of questions, answers, courses, offers and organizations.

    Nodes are read in document order, ``MOST_NODES`` of a script; of texts equal but for case the first
    counts; a text that would take the page beyond ``MOST_CHARACTERS`` is left out, later ones may still fit.
    A level of all scripts is opened at a time; a node knows its path, and paths sort in document order. The
    last fold is over the blocks of one page, which the limits on scripts bound.
    """
    level = json_ld_scripts(pages)
    found = []
    own, typed = F.col("own"), lambda t: F.coalesce(F.array_contains("types", t), F.lit(False))
    while not level.isEmpty():
        types = F.coalesce(_at("@type", "array<string>"), F.array(_at("@type", "string")))
        level = level.withColumn("own", _is(F.col("v"), "OBJECT")).withColumn("types", F.when(F.col("own"), types))
        said = [F.when(typed(t) & _is(_at(key), "STRING"), F.struct(F.lit(kind).alias("kind"), T.normalize_visible(_at(key, "string")).alias("text"))) for t, key, kind in TEXTS]
        found.append(level.select("page_id", "path", F.when(own, F.filter(F.array(*said), lambda s: s.isNotNull())).alias("said")))
        # a child that isn't there still counts as a node; @graph is one only if it is an array
        listed = [F.when(_is(_at("@graph"), "ARRAY"), F.struct(_at("@graph").alias("v")))] + [F.when(typed(t), F.struct(_at(key).alias("v"))) for t, key in CHILDREN]
        items = F.transform(F.expr("try_variant_get(v, '$', 'array<variant>')"), lambda x: F.struct(x.alias("v")))
        below = F.when(_is(F.col("v"), "ARRAY"), items).when(own, F.filter(F.array(*listed), lambda c: c.isNotNull()))
        level = cut(level.select("page_id", "path", F.posexplode(below).alias("n", "c")).select("page_id", F.concat("path", F.array("n")).alias("path"), F.col("c.v").alias("v")))
    if not found:
        return pages.sparkSession.createDataFrame([], "page_id string, place int, kind string, text string")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("page_id", F.col("path")[0]).orderBy("path"))
    texts = nodes.withColumn("rank", rank).filter(F.col("rank") <= MOST_NODES).select("page_id", "path", F.posexplode("said").alias("n", "s"))
    texts = texts.select("page_id", F.struct("path", "n").alias("at"), "s.kind", "s.text").filter("text <> ''")
    first = F.row_number().over(Window.partitionBy("page_id", F.lower("text")).orderBy("at"))
    listed = texts.withColumn("first", first).filter("first = 1").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("listed"))
    kept = F.array().cast("array<struct<kind: string, text: string>>")

    def add(state, x):
        used = state["used"] + F.length(x["text"])
        fits = used <= MOST_CHARACTERS
        return F.struct(F.when(fits, used).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(F.struct(x["kind"].alias("kind"), x["text"].alias("text"))))).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate("listed", F.struct(F.lit(0).alias("used"), kept.alias("kept")), add)["kept"]
    return listed.select("page_id", F.posexplode(kept).alias("place", "b")).select("page_id", "place", "b.kind", "b.text")


def with_metadata(blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """TXT-08: a page's visible blocks, then the metadata blocks that no visible block says, whatever its case; cap them after that."""
    blocks = cut(blocks)  # read three times below, and pages are parsed for it
    spoken = blocks.select("page_id", F.lower("text").alias("low")).distinct()
    new = metadata.withColumn("low", F.lower("text")).join(spoken, ["page_id", "low"], "left_anti").drop("low")
    last = blocks.groupBy("page_id").agg(F.max("block_index").alias("last"))
    new = new.join(last, "page_id", "left").select("page_id", (F.coalesce("last", F.lit(-1)) + 1 + F.col("place")).alias("block_index"), "kind", F.lit(None).cast("int").alias("heading_level"), "text")
    return blocks.unionByName(new)
