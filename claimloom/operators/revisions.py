"""Cards of several schema versions brought to the current one, and review records checked against the cards they review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.library import canonical_json

#: Schema versions, oldest first; review states that no file can carry, and those that the last version brought.
VERSIONS = ["1.0.0", "2.0.0", "2.1.0", "2.2.0"]
ATTESTED = ["ai_audited", "human_reviewed", "organizer_confirmed"]
NEW_STATES = ["ai_audited", "automated_draft"]
FAMILIES = ["organizations", "organizationRoles", "institutionRelationships", "variants", "stages", "pathways", "costItems", "outcomes"]
KEPT = ["slug", "summary", "sourcePagesChecked", "conflicts", "facts"]

_PARTS = "map<string, variant>"


def _literal(json: str) -> Column:
    return F.parse_json(F.lit(json))


def _text(of: Column, path: str) -> Column:
    return F.try_variant_get(of, path, "string")


def _values(claim: Column) -> Column:
    """A claim's value and those of its conflicting values, as variants."""
    others = F.transform(F.coalesce(F.try_variant_get(claim, "$.conflictingValues", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$.value", "variant"))
    return F.concat(F.array(F.try_variant_get(claim, "$.value", "variant")), others)


def _uses_later_words(v: Column) -> Column:
    """Version 2.0.0 knows no educators as recipients or payees, nor schools as payees."""

    def one(outcome):
        part = lambda name: _values(F.try_variant_get(outcome, f"$.{name}", "variant"))
        kinds = F.exists(part("definition"), lambda x: F.coalesce(_text(x, "$.outcomeType") == "educator_cash_prize", F.lit(False)))
        scopes = F.exists(part("recipientScope"), lambda x: F.coalesce(_text(x, "$") == "educator", F.lit(False)))
        payees = F.exists(part("distribution"), lambda x: F.exists(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>")), lambda d: F.coalesce(_text(d, "$.payee").isin("educator", "school"), F.lit(False))))
        return kinds | scopes | payees

    records = F.coalesce(F.try_variant_get(v, "$.outcomes.records", "array<variant>"), F.array().cast("array<variant>"))
    return F.exists(records, one)


def migrate(cards: DataFrame) -> DataFrame:
    """PIPE-12, SRC-10: ``(slug, from_version, card, fault)`` of imported cards ``(slug, card)``, JSON text.

    ``card`` is the card in the current version, with its attestation taken away, or null where ``fault`` says why it isn't
    taken: ``not_json``, ``undeclared``, ``unsupported``, ``later_state``, ``later_word``, ``projection_version``. A card of 1.0.0 becomes a draft of
    the next card version with unassessed records and a digest of what it was; one of 2.0.0 or 2.1.0 keeps its claims
    and its facts get the current version in their projections, which the caller derives again. One scan, no shuffle.
    """
    v = F.try_parse_json("card")
    opened = cards.select("slug", "card", v.alias("v"), F.from_json("card", _PARTS).alias("m"))
    own, version, state = F.schema_of_variant("v").startswith("OBJECT"), _text(F.col("v"), "$.schemaVersion"), _text(F.col("v"), "$.reviewState")
    later = version.isin(VERSIONS[1:3])
    facts = F.try_variant_get("v", "$.facts", _PARTS)
    projected = lambda f: F.try_variant_get(f, "$.projection", _PARTS)
    stale = F.exists(F.map_values(facts), lambda f: F.coalesce(~F.is_variant_null(F.try_variant_get(f, "$.projection", "variant")), F.lit(False)) & ~F.coalesce(_text(f, "$.projection.schemaVersion") == version, F.lit(False)))
    fault = (
        F.when(F.col("v").isNull() | ~own, "not_json").when(version.isNull(), "undeclared").when(~version.isin(VERSIONS), "unsupported")
        .when(later & F.coalesce(state.isin(NEW_STATES), F.lit(False)), "later_state").when((version == VERSIONS[1]) & _uses_later_words(F.col("v")), "later_word").when(later & F.coalesce(stale, F.lit(False)), "projection_version")
    )
    rows = opened.select("slug", "card", "v", "m", version.alias("from_version"), state.alias("state"), fault.alias("fault"), F.try_variant_get("v", "$.cardVersion", "long").alias("n"))
    put = lambda m, **new: F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(*new)), F.create_map(*(x for k, value in new.items() for x in (F.lit(k), value))))
    as_variant = lambda c: F.parse_json(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}))
    scalar = lambda c: F.try_variant_get(as_variant(c), "$.x", "variant")
    null, current = _literal("null"), _literal(f'"{VERSIONS[-1]}"')
    empty = _literal('{"status":"unassessed","records":[],"note":null}')
    origin = F.to_variant_object(F.struct(F.col("from_version").alias("schemaVersion"), F.col("n").alias("cardVersion"), F.try_variant_get("v", "$.reviewedAt", "string").alias("reviewedAt"), F.sha2(canonical_json("card"), 256).alias("cardSha256")))
    first = put(F.map_filter("m", lambda k, _: k.isin(KEPT)), schemaVersion=current, opportunityId=null, cycle=_literal('{"status":"unassessed","value":null}'), cardVersion=scalar(F.col("n") + 1), reviewState=_literal('"draft"'), reviewedAt=null, projectionRefs=_literal("{}"), migratedFrom=origin, **dict.fromkeys(FAMILIES, empty))
    bumped = F.transform_values(F.try_variant_get("v", "$.facts", _PARTS), lambda _, f: F.when(projected(f).isNotNull(), F.to_variant_object(put(F.try_variant_get(f, "$", _PARTS), projection=F.to_variant_object(put(projected(f), schemaVersion=current))))).otherwise(f))
    second = F.when(F.try_variant_get("v", "$.facts", _PARTS).isNotNull(), put(F.col("m"), schemaVersion=current, facts=F.to_variant_object(bumped))).otherwise(put(F.col("m"), schemaVersion=current))
    whole = F.when(F.col("from_version") == VERSIONS[0], first).when(F.col("from_version").isin(VERSIONS[1:3]), second).otherwise(F.col("m"))
    revoked = F.when(F.col("state").isin(ATTESTED) & (F.col("from_version") != VERSIONS[0]), put(F.col("whole"), cardVersion=scalar(F.col("n") + 1), reviewState=_literal('"draft"'), reviewedAt=null)).otherwise(F.col("whole"))
    rows = rows.withColumn("whole", F.when(F.col("fault").isNull(), whole)).withColumn("whole", F.when(F.col("fault").isNull(), revoked))
    return rows.select("slug", "from_version", F.to_json("whole", {"ignoreNullFields": "false"}).alias("card"), "fault")


def manifests(items: DataFrame) -> DataFrame:
    """PIPE-14: ``(slug, manifest_sha256, content_sha256, n_items, repeated)``: digests of a card's list of items and of what they hold.

    ``items``: ``(slug, section, section_no, place, item_id, content)``, the union of a card's sources, facts, records and
    final checks; null contents are told from empty ones. A card's items are one array: a card is one bounded
    document. Contents are dealt once, by their card; its few sections are told apart in the array.
    """
    ordered = items.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("section_no", "section", "place", "item_id", "content"))).alias("rows"))
    sections = F.array_distinct(F.transform("rows", lambda r: F.struct(r["section_no"].alias("no"), r["section"].alias("id"))))
    of = lambda k: F.filter("rows", lambda r: r["section_no"].eqNullSafe(k["no"]) & r["section"].eqNullSafe(k["id"]))
    listed = F.transform(sections, lambda k: F.struct(k["id"].alias("id"), F.transform(of(k), lambda r: r["item_id"]).alias("itemIds")))
    ids = F.transform("rows", lambda r: r["item_id"])
    held = F.transform("rows", lambda r: F.struct(r["content"].alias("content"), r["item_id"].alias("id")))
    digest = lambda x: F.sha2(F.to_json(x, {"ignoreNullFields": "false"}), 256)
    return ordered.select("slug", digest(listed).alias("manifest_sha256"), digest(held).alias("content_sha256"), F.size(ids).cast("long").alias("n_items"), (F.size(F.array_distinct(ids)) < F.size(ids)).alias("repeated"))


def check_attestations(cards: DataFrame, items: DataFrame, records: DataFrame, done: DataFrame) -> DataFrame:
    """PIPE-14: ``(slug, n_missing, n_unexpected, n_repeated, verdict)`` of review records, one a card.

    ``cards``: ``(slug, opportunity_id, card_version, review_state, reviewed_at)``; ``records`` the same without the state, with
    ``manifest_sha256`` and ``content_sha256``; ``done``: ``(slug, item_id)`` of the items a record ticks. The digests are derived
    again from the card at hand. ``verdict`` is null for a valid record, else the first of ``other_state``, ``no_identity``,
    ``repeated_items``, ``stale`` and ``items``; cards in the state human_reviewed without a record have ``no_record``. Two joins on the card, one on the item.
    """
    expected = items.groupBy("slug", "item_id").agg(F.lit(1).alias("own"))
    ticked = done.groupBy("slug", "item_id").agg(F.count("*").alias("times"))
    off = lambda condition: F.count_if(condition)
    differ = expected.join(ticked, ["slug", "item_id"], "full").groupBy("slug").agg(off(F.col("times").isNull()).alias("n_missing"), off(F.col("own").isNull()).alias("n_unexpected"), off(F.col("times") > 1).alias("n_repeated"))
    theirs = records.select("slug", *(F.col(c).alias(f"r_{c}") for c in ("opportunity_id", "card_version", "reviewed_at", "manifest_sha256", "content_sha256")), F.lit(True).alias("recorded"))
    all_ = cards.join(theirs, "slug", "left").join(manifests(items), "slug", "left").join(differ, "slug", "left")
    stale = F.lit(False)
    for c in ("opportunity_id", "card_version", "reviewed_at", "manifest_sha256", "content_sha256"):
        stale = stale | ~F.col(c).eqNullSafe(F.col(f"r_{c}"))
    reviewed = F.coalesce(F.col("review_state") == "human_reviewed", F.lit(False))
    verdict = (
        F.when(F.col("recorded").isNull(), "no_record").when(~reviewed, "other_state").when(F.col("opportunity_id").isNull(), "no_identity").when(F.col("repeated"), "repeated_items")
        .when(stale, "stale").when((F.col("n_missing") > 0) | (F.col("n_unexpected") > 0) | (F.col("n_repeated") > 0), "items")
    )
    counts = [F.when(F.col("recorded"), F.coalesce(c, F.lit(0))).alias(c) for c in ("n_missing", "n_unexpected", "n_repeated")]
    return all_.filter(F.col("recorded").isNotNull() | reviewed).select("slug", *counts, verdict.alias("verdict"))
