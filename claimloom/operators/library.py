"""Cards of a repository and how readers filter, select, compare and carry them over."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimloom.sources.scratch import cut

#: Review states that are public, and those that a sidecar must attest.
PUBLIC_STATES = ["demo", "ai_audited", "human_reviewed", "organizer_confirmed"]
ATTESTED_STATES = ["ai_audited", "human_reviewed", "organizer_confirmed"]
SETTLED = ["disclosed", "conflicting", "not_applicable"]


def active_filters(*choices: Column) -> Column:
    """FLT-08: how many choices narrow anything: neither ``all`` nor blank."""
    return sum((F.when(F.coalesce(F.trim(c), F.lit("all")).isin("", "all"), 0).otherwise(1) for c in choices), F.lit(0))


def fact_filter(facts: DataFrame, query: str, status: str) -> DataFrame:
    """FLT-09: facts whose words hold the query, of the wanted status; unresolved takes facts that nobody assessed as well."""
    wanted = F.lit(True) if status == "all" else F.col("status").isin("not_found", "unclear", "conflicting", "unassessed") if status == "unresolved" else F.col("status") == status
    return facts.filter(F.contains(F.lower("words"), F.lit(query.strip().lower())) & wanted)


def comparison_rows(rows: DataFrame, mode: str, core: list, keys: list) -> DataFrame:
    """FLT-10: all rows, those of core fields, or those that differ in a key field."""
    if mode == "full":
        return rows
    return rows.filter(F.col("field_id").isin(core) if mode == "core" else F.col("differs") & F.col("field_id").isin(keys))


def overview_tiles(facts: DataFrame, always: list) -> DataFrame:
    """FLT-12: ``(slug, field_id, tile)``: supported facts and those always shown, in order; the first supported or listed one leads where only these are left.

    ``facts``: ``(slug, place, field_id, status)``, the fields that a tile may show.
    """
    supported, shown = F.col("status").isin("disclosed", "conflicting"), F.col("field_id").isin(always)
    whole = Window.partitionBy("slug")
    rows = facts.withColumn("any_supported", F.max((supported & ~shown).cast("int")).over(whole) == 1).withColumn("first_free", F.min(F.when(~shown, F.col("place"))).over(whole))
    lead = ~F.col("any_supported") & (F.col("place") == F.col("first_free"))
    kept = rows.filter(supported | shown | F.coalesce(lead, F.lit(False)))
    tile = F.row_number().over(Window.partitionBy("slug").orderBy(F.when(lead, 0).otherwise(1), "place"))
    return kept.select("slug", "field_id", tile.alias("tile"))


def repository(demo: DataFrame, attested: DataFrame, sidecars: DataFrame) -> DataFrame:
    """SRC-02, SET-01: ``(slug, review_state, problem)`` of both folders' cards; cards that need an attestation and have none, and slugs that stand twice, say so (JN-13)."""
    cards = demo.select("slug", "review_state").unionByName(attested.select("slug", "review_state"))
    known = sidecars.select("slug").distinct().withColumn("attested", F.lit(True))
    n = F.count("*").over(Window.partitionBy("slug"))
    missing = F.col("review_state").isin(ATTESTED_STATES) & F.col("attested").isNull()
    return cards.join(known, "slug", "left").select("slug", "review_state", F.when(n > 1, "duplicate slug").when(missing, "attestation missing").alias("problem"))


def restored_selection(stored: DataFrame, most: int = 3) -> DataFrame:
    """SRC-11: ``(owner, slug, place)``: what can be read, its first three, then each slug once, the first."""
    first = stored.filter("readable").withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy("place"))).filter(F.col("n") <= most)
    return first.groupBy("owner", "slug").agg(F.min("place").alias("place"))


def batch_manifest(urls: DataFrame, canonical: Column, most: int = 5) -> DataFrame:
    """SRC-12, SET-08: ``(batch, url, place, duplicates, problem)``: each canonical address once, where it first stands; ``duplicates``: how many the batch lost.

    A batch is rejected as a whole if it has more than ``most`` addresses or none that is valid: one row without address says why.
    """
    valid = urls.withColumn("url", canonical)
    sizes = valid.groupBy("batch").agg(F.count("url").alias("n"))
    problem = F.when(F.col("n") > most, "too many addresses").when(F.col("n") == 0, "no address")
    judged = sizes.withColumn("problem", problem)
    once = valid.filter("url IS NOT NULL").groupBy("batch", "url").agg(F.min("place").alias("place"))
    kept = once.join(judged.filter("problem IS NULL").select("batch", "n"), "batch")
    kept = kept.select("batch", "url", "place", (F.col("n") - F.count("*").over(Window.partitionBy("batch"))).alias("duplicates"))
    return kept.unionByName(judged.filter("problem IS NOT NULL").select("batch", "problem"), allowMissingColumns=True)


def pasted_sources(sources: DataFrame, most: int = 7, characters: int = 80_000, total: int = 400_000) -> DataFrame:
    """SRC-09: ``(owner, problem)`` of requests of pasted texts ``(owner, url, text)``, null where they fit."""
    g = sources.groupBy("owner").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("all"))
    return g.select("owner", F.when(F.col("n") > most, "too many sources").when(F.col("urls") < F.col("n"), "repeated address").when(F.col("longest") > characters, "source too long").when(F.col("all") > total, "sources too long together").alias("problem"))


def latest(entries: DataFrame, now: Column) -> DataFrame:
    """SRC-13, SNK-05: ``(key, entry_id)``: an upsert's newest entry of each key, unless it has expired."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("entry_id")))
    return entries.withColumn("n", newest).filter((F.col("n") == 1) & (F.col("expires") > now)).select("key", "entry_id")


def carried_attention(items: DataFrame, before: DataFrame, after: DataFrame, claims: DataFrame) -> DataFrame:
    """JN-16, PIPE-11: ``(slug, item)`` that stay: all their fields are unchanged, and all their claims survive.

    ``items``: ``(slug, item, field_id, claim_id)``, a row a reference; ``before``, ``after``: ``(slug, field_id, fact)``; ``claims``: ``(slug, claim_id)`` that are left.
    """
    same = before.alias("b").join(after.alias("a"), ["slug", "field_id"]).filter(F.col("b.fact").eqNullSafe(F.col("a.fact"))).select("slug", "field_id", F.lit(True).alias("same"))
    alive = claims.select("slug", "claim_id", F.lit(True).alias("alive")).distinct()
    rows = items.join(same, ["slug", "field_id"], "left").join(alive, ["slug", "claim_id"], "left")
    ok = (F.col("field_id").isNull() | F.col("same").isNotNull()) & (F.col("claim_id").isNull() | F.col("alive").isNotNull())
    return rows.groupBy("slug", "item").agg(F.bool_and(ok).alias("ok")).filter("ok").select("slug", "item")


def first_valid(candidates: DataFrame) -> DataFrame:
    """WIN-13: ``(slug, field_id, place)``: a field's first candidate that is valid; one that isn't takes no place."""
    return candidates.filter("valid").groupBy("slug", "field_id").agg(F.min("place").alias("place"))


def sanitized(facts: DataFrame) -> DataFrame:
    """PIPE-03: ``(slug, field_id, status, claim_kind, note)`` of model facts ``(…, valid, n_sources)``: what is inconsistent keeps its sources at most, as unclear."""
    status, valid = F.col("status"), F.col("valid")
    absent = status.isin("not_found", "not_applicable")
    now = F.when(valid | absent, status).when(F.col("n_sources") > 0, "unclear").otherwise("not_found")
    kind = F.when(valid, F.col("claim_kind")).when(now == "unclear", "source_stated")
    note = F.when(valid, F.col("note")).when(status == "not_applicable", F.coalesce("note", F.lit("The model proposed that this field does not apply; human review is required."))).when(now == "unclear", "The model returned an internally inconsistent claim; its cited text requires human review.")
    return facts.select("slug", "field_id", now.alias("status"), kind.alias("claim_kind"), note.alias("note"))


def invalidated(cards: DataFrame) -> DataFrame:
    """PIPE-13: an imported card's attestation doesn't travel: it is a draft again, without a review date."""
    attested = F.col("review_state").isin(ATTESTED_STATES)
    return cards.select("slug", F.when(attested, "draft").otherwise(F.col("review_state")).alias("review_state"), F.when(~attested, F.col("reviewed_at")).alias("reviewed_at"), attested.alias("invalidated"))


def dataset_problems(cards: DataFrame, least: int = 6) -> DataFrame:
    """PIPE-16: ``(slug, problem)``: demo cards whose host isn't a ``.example`` one, and a row without slug where there are too few of them."""
    demo = cards.filter("review_state = 'demo'")
    hosts = demo.filter(~F.coalesce(F.col("host").rlike(r"(^|\.)example$"), F.lit(False))).select("slug", F.lit("demo host must end in .example").alias("problem"))
    few = demo.agg(F.count("*").alias("n")).filter(F.col("n") < least).select(F.lit(None).cast("long").alias("slug"), F.lit("too few demo cards").alias("problem"))
    return hosts.unionByName(few)


def salvaged(records: DataFrame) -> DataFrame:
    """WIN-15: records ``(slug, id, needs)`` that can be added once what they need is there, pass after pass; a pass that adds nothing ends it.

    Records and every pass are written, so no pass reads the input again and its plan doesn't grow; there are as many as a card's longest chain of needs.
    """
    records = cut(records.select("slug", "id", "needs"))
    new = cut(records.filter("needs IS NULL").select("slug", "id").distinct())
    kept = new
    while not new.isEmpty():
        more = records.join(new.select("slug", F.col("id").alias("needs")), ["slug", "needs"], "left_semi").select("slug", "id").distinct()
        new = cut(more.join(kept, ["slug", "id"], "left_anti"))
        kept = kept.unionByName(new)
    return kept


def unique_match(rows: DataFrame) -> DataFrame:
    """JN-09: ``(slug, block, excerpt)``: the exact slice of ``text`` that equals ``quote`` but for white space, where the quote has 16 characters or more and stands exactly once.

    The position comes from a pattern of the quote's characters with optional white space between them.
    """
    compact = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    own = compact(F.col("quote"))
    loose = F.concat(F.lit(r"(?i)\Q"), F.array_join(F.transform(F.split(F.regexp_replace("quote", r"\s+", ""), ""), lambda ch: ch), r"\E\s*\Q"), F.lit(r"\E"))
    whole = compact(F.col("text"))
    first = F.position(own, whole)
    once = (F.length(own) >= 16) & (first > 0) & (F.position(own, whole, first + 1) == 0)  # matches may overlap
    return rows.filter(once).select("slug", "block", F.regexp_substr("text", loose).alias("excerpt"))


def comparable(status: Column, normalized: Column, value: Column) -> Column:
    """FN-39: what two facts must share to be the same."""
    return F.to_json(F.struct(status.alias("status"), F.coalesce(normalized, value).alias("value")))


def words(x: Column) -> Column:
    """FN-11: an enumerated token in words, each with a capital."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def anonymous_identifier(address: Column, secret: str) -> Column:
    """FN-40: HMAC-SHA-256, in hex, of the first forwarded address."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    first = F.substring(F.trim(F.substring_index(address, ",", 1)), 1, 128)
    message = F.encode(F.when(F.coalesce(first, F.lit("")) == "", "unavailable").otherwise(first), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256)


#: Signs in the order of the root collation; digits and letters come after them.
_SIGNS = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def _key_order(key: str):
    """As a reader's dictionary: signs, digits, letters; accents count after all letters, and case last, lower first. Not the full Unicode tables."""
    plain = [(base[0], base[1:], c) for c in key for base in [unicodedata.normalize("NFD", c)]]
    letters = [(0, _SIGNS.find(c), c) if not c.isalnum() else (1, 0, c) if c.isdigit() else (2, 0, c.lower()) for c, _, _ in plain]
    return letters, [accent for _, accent, _ in plain], [c.isupper() for c, _, _ in plain]


def _is_index(key: str) -> bool:
    return key.isdecimal() and key.isascii() and str(int(key)) == key and int(key) < 2**32 - 1


def _number(x: float) -> str:
    """As a browser prints it: a double's shortest digits, plain from 1e-6 to below 1e21; what is no finite double is null."""
    if x == 0 or not math.isfinite(x):
        return "0" if x == 0 else "null"
    _, digits, exponent = Decimal(repr(abs(x))).normalize().as_tuple()
    text, point, sign = "".join(map(str, digits)), len(digits) + exponent, "-" if x < 0 else ""
    if 0 < point <= 21:
        return sign + (text.ljust(point, "0") if exponent >= 0 else f"{text[:point]}.{text[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{text}"
    return f"{sign}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def _string(text: str) -> str:
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def _canonical(value) -> str:
    """Keys that are array indexes come first, by number, as objects list them; the others in a reader's order."""
    if isinstance(value, dict):
        indexes = sorted((k for k in value if _is_index(k)), key=int)
        names = sorted((k for k in value if not _is_index(k)), key=_key_order)
        return "{" + ",".join(f"{_string(k)}:{_canonical(value[k])}" for k in [*indexes, *names]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return _string(value) if isinstance(value, str) else _number(value)


def _refuse(token: str):
    raise ValueError(token)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """FN-12, ORD-08: JSON with keys in a reader's order and numbers as a browser prints them; null where it isn't JSON."""

    def one(text):
        try:
            return None if text is None else _canonical(json.loads(text, parse_int=float, parse_constant=_refuse))
        except ValueError:
            return None

    return texts.map(one)
