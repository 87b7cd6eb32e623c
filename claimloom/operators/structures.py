"""A card's structured records: claims counted in nested cards, checked against evidence, pruned and salvaged.

Nine families of records hold claims (``slug, family, record_id, slot, claim_id, status``) and refer to each
other (``slug, record_id, claim_id, edge, target``; the claim is the one that states the reference). All work
is joins on a card and an identifier, so no card is gathered in one task.
"""

from __future__ import annotations

import json
import sys
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import text as T
from claimloom.sources.scratch import cut

#: Families in the order they are taken up again, and the slots a record can't be without.
FAMILIES = ["organizations", "organizationRoles", "institutionRelationships", "variants", "stages", "pathways", "cycle", "costItems", "outcomes"]
REQUIRED = {
    "organizations": ["name", "kind"],
    "organizationRoles": ["role"],
    "institutionRelationships": ["assertion"],
    "variants": ["definition"],
    "stages": ["definition"],
    "pathways": ["definition"],
    "cycle": ["label", "status", "cycleType"],
    "costItems": ["definition", "amount"],
    "outcomes": ["definition", "recipientScope"],
}
#: Families whose evidence must name no year outside the cycle's.
OF_A_CYCLE = ["cycle", "variants", "stages", "pathways", "costItems", "outcomes"]

#: What an excerpt must say for a role or a relationship, and what denies one.
ROLE_WORDS = {
    "operator": r"\b(operat(?:e|es|ed|or)|run by|organize(?:s|d)?)\b",
    "manager": r"\bmanag(?:e|es|ed|er|ement)\b",
    "administrator": r"\badminist(?:er|ers|ered|rator|ration)\b",
    "sponsor": r"\bsponsor(?:s|ed|ship)?\b",
    "funder": r"\b(fund(?:s|ed|ing|er)|financial support)\b",
    "host": r"\b(host(?:s|ed)?|held at|takes place)\b",
    "academic_partner": r"\b(academic|credit)\b.{0,40}\bpartner",
    "platform_provider": r"\bplatform\b",
}
RELATIONSHIP_WORDS = {
    "institution_operated": r"\b(operat(?:e|es|ed|or)|run by|administ(?:er|ered|ration))\b",
    "institution_sponsored": r"\bsponsor(?:s|ed|ship)?\b",
    "institution_partnered": r"\bpartner(?:s|ed|ship)?\b",
    "hosted_at_institution": r"\b(host(?:s|ed)?|held at|takes place|classroom space)\b",
    "credit_partnership": r"\bcredit\b.{0,80}\b(partner|transcript|extended studies)\b|\b(partner|extended studies)\b.{0,80}\bcredit\b",
    "founders_affiliated_with": r"\b(found(?:er|ers|'s)?|founded by)\b.{0,160}\b(researcher(?:s)?|alumni|affiliat(?:e|ed|ion)|graduate(?:d)?|studied|attended)\b",
    "mentors_affiliated_with": r"\b(mentor|researcher)(?:s)?\b.{0,160}\b(affiliat(?:e|ed|ion)|universit(?:y|ies)|college|institute)\b",
    "staff_affiliated_with": r"\bstaff\b.{0,120}\b(affiliat(?:e|ed|ion)|universit(?:y|ies)|college|institute)\b",
    "independent": r"\b(independent|no (?:role|partnership|sponsorship|endorsement))\b",
}
DENIALS = {
    "institution_partnered": r"\b(does not|is not|no)\b.{0,80}\bpartner(?:s|ed|ship)?\b",
    "institution_sponsored": r"\b(does not|is not|no)\b.{0,80}\bsponsor(?:s|ed|ship)?\b",
    "institution_operated": r"\b(does not|is not|no)\b.{0,80}\boperat(?:e|es|ed|or)\b",
    "credit_partnership": r"\b(no|not|does not)\b.{0,80}\bcredit\b|\bcredit\b.{0,80}\b(no|not|does not)\b",
}
#: The subject that a relationship on persons needs, outcome types paid in cash, and recipients that a type needs.
SUBJECTS = {"founders_affiliated_with": "founders", "mentors_affiliated_with": "mentors", "staff_affiliated_with": "staff"}
CASH_TYPES = ["personal_cash_prize", "team_cash_prize", "educator_cash_prize", "stipend"]
RECIPIENTS = {"personal_cash_prize": "individual", "team_cash_prize": "team", "educator_cash_prize": "educator"}


def _lookup(of: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), key)


#: Fixed limit: JSON nested deeper is none, as for ``try_parse_json``.
MOST_NESTED = 1000


def _of_list(values: list) -> tuple[int, int, int, int]:
    """What ``_of_object`` gives, of an array."""
    claims = candidates = depth = nested = 0
    for value in values:
        kind = type(value)
        if kind is list:
            value = _of_list(value)
        elif kind is not tuple:
            continue
        c, d, walked, all_ = value
        claims += c
        candidates += d
        if walked > depth:
            depth = walked
        if all_ > nested:
            nested = all_
    return claims, candidates, depth + 1, nested + 1


def _of_object(pairs: list) -> tuple[int, int, int, int]:
    """Claims and candidates from an object down, how deep those lie that are walked, and how deep all do; inner objects come as such tuples."""
    of = dict(pairs)
    if len(of) < len(pairs):
        raise ValueError("a key twice")
    claims = candidates = depth = nested = 0
    status = of.get("status")
    if status == "disclosed" or status == "conflicting":
        candidates = int("claimId" in of or "sources" in of)
        claims = int(status == "disclosed" and type(of.get("claimId")) is str)
    for key, value in pairs:
        kind = type(value)
        if kind is list:
            value = _of_list(value)
        elif kind is not tuple:
            continue
        c, d, walked, all_ = value
        if all_ > nested:
            nested = all_
        if key != "sources" and key != "conflictingValues":
            if key != "facts":
                claims += c
            candidates += d
            if walked > depth:
                depth = walked
    return claims, candidates, depth + 1, nested + 1


def _no_constant(name: str):
    raise ValueError(name)


#: Reads as strictly as ``try_parse_json``: no key twice, no NaN. A number of any length is one; its value isn't asked for.
_JSON = json.JSONDecoder(object_pairs_hook=_of_object, parse_constant=_no_constant, parse_int=len, parse_float=len)


def _count_card(text: str | None) -> tuple[int, int, int]:
    """Claims and candidates of one card, counted as its objects close, and its depth; what is no JSON has none."""
    try:
        card = _JSON.raw_decode((text or "").lstrip(" \t\n\r"))[0]
        claims, candidates, depth, nested = _of_list(card) if type(card) is list else card if type(card) is tuple else (0, 0, 0, 0)
    except (ValueError, RecursionError):
        return 0, 0, 0
    return (claims, candidates, depth) if nested <= MOST_NESTED else (0, 0, 0)


def claim_counts(cards: DataFrame, most_depth: int = 100) -> DataFrame:
    """AGG-03, AGG-04: ``(slug, n_claims, n_candidates)`` of nested cards ``(slug, card)``, JSON text.

    A claim is an object with a string ``claimId`` and the status disclosed, outside ``facts``; a candidate is
    disclosed or conflicting and has a ``claimId`` or ``sources``, even null, in facts as well. What lies in ``sources`` or
    ``conflictingValues`` never counts. A card is read once, in Arrow batches, and only its counts are written; text
    that is no JSON has none; deeper cards than ``most_depth`` fail.
    """

    def count(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * MOST_NESTED))
        for batch in batches:
            found = [_count_card(text) for text in batch.column("card").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slug"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], ["slug", "c", "d", "depth"])

    counts = cut(cards.select("slug", "card").mapInArrow(count, f"slug {dict(cards.dtypes)['slug']}, c long, d long, depth long"))
    if not counts.filter(F.col("depth") > most_depth).isEmpty():
        raise ValueError(f"a card is nested deeper than {most_depth} levels")
    return counts.groupBy("slug").agg(F.sum("c").alias("n_claims"), F.sum("d").alias("n_candidates"))


def evidence_warnings(claims: DataFrame, sources: DataFrame, texts: DataFrame, supported: Column) -> DataFrame:
    """PIPE-07: ``(slug, family, claim_id, source_id, rule)`` of every reason to withhold a claim.

    ``sources (slug, claim_id, candidate, source_id, excerpt)``: candidate 0 is the claim's own evidence;
    ``texts (source_id, text, year, ...)``, the year null where no cycle is known; ``supported``: whether a
    source speaks of the card's target. ``claims.failure`` says what else is wrong with a claim, if anything.
    """
    plain = lambda c: F.lower(T.normalize_whitespace(F.col(c)))
    read = texts.withColumn("plain", plain("text")).drop("text")  # once a text, before the join
    own = F.col("candidate") == 0
    missing = ~F.coalesce((plain("excerpt") != "") & F.contains(F.col("plain"), plain("excerpt")), F.lit(False))
    unsupported = own & ~F.coalesce(supported, F.lit(False))
    strays = own & F.coalesce(~E.matches_cycle(F.col("excerpt"), F.array("year")) & F.col("year").isNotNull(), F.lit(False))
    # what a text says of an excerpt is settled where they meet; no text goes on to the join with claims
    seen = sources.join(read, "source_id", "left").select("slug", "claim_id", "source_id", missing.alias("missing"), unsupported.alias("unsupported"), strays.alias("strays")).filter("missing OR unsupported OR strays")
    checked = seen.join(claims.select("slug", "claim_id", "family"), ["slug", "claim_id"])
    missing, elsewhere, other_year = F.col("missing"), F.col("unsupported") & (F.col("family") != "organizations"), F.col("strays") & F.col("family").isin(OF_A_CYCLE)
    wrong = F.array(*(F.when(cond, F.struct(F.lit(rule).alias("rule"), F.when(F.lit(rule) == "excerpt_not_found", F.col("source_id")).alias("source_id"))) for rule, cond in (("excerpt_not_found", missing), ("other_opportunity", elsewhere), ("outside_cycle", other_year))))
    cited = checked.select("slug", "family", "claim_id", F.explode(F.filter(wrong, lambda w: w.isNotNull())).alias("w")).select("slug", "family", "claim_id", "w.source_id", "w.rule")
    times = F.when(F.col("rule") == "excerpt_not_found", F.col("n")).otherwise(F.lit(1).cast("long"))  # every excerpt counts, other reasons once a claim
    cited = cited.groupBy(*cited.columns).agg(F.count("*").alias("n")).select(*cited.columns, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*cited.columns)
    reasons = F.filter(F.array(F.when(F.col("status") == "not_applicable", F.lit("not_applicable")), F.col("failure")), lambda r: r.isNotNull())
    of_itself = claims.select("slug", "family", "claim_id", F.lit(None).cast(dict(sources.dtypes)["source_id"]).alias("source_id"), F.explode(reasons).alias("rule"))
    return cited.unionByName(of_itself)


class Pruned(NamedTuple):
    records: DataFrame  # slug, family, record_id
    claims: DataFrame  # slug, family, record_id, slot, claim_id, status
    timings: DataFrame  # slug, record_id, target: a cycle's timing references


def prune(records: DataFrame, claims: DataFrame, refs: DataFrame, invalid: DataFrame) -> Pruned:
    """JN-20: what is left when the claims ``invalid (slug, claim_id)`` go, edge after edge.

    A record goes with a required claim. Then go roles and relationships of unknown organizations, variants
    whose parent is gone (looked up twice), pathways of a variant that is gone, steps to a stage that is
    gone, pathways without a step, a cost's treatment unless it is disclosed and all its targets are there,
    and a cycle's references to timings that are gone. A reference without target is unknown.
    """
    key = ["slug", "record_id"]
    required = F.concat_ws(".", "family", "slot").isin([f"{family}.{slot}" for family, slots in REQUIRED.items() for slot in slots])
    marked = cut(claims.join(invalid.select("slug", "claim_id").distinct().withColumn("gone", F.lit(True)), ["slug", "claim_id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    kept = cut(records.join(marked.filter(F.col("gone") & required).select(*key), key, "left_anti"))
    live, refs = marked.filter(~F.col("gone")), cut(refs)
    of = lambda family: kept.filter(F.col("family") == family)
    edges = lambda *names: refs.filter(F.col("edge").isin(*names))

    def lost(found: DataFrame, targets: DataFrame) -> DataFrame:
        """References whose target isn't among the records."""
        return found.join(targets.select("slug", F.col("record_id").alias("target")), ["slug", "target"], "left_anti")

    bound = kept.filter(F.col("family").isin("organizationRoles", "institutionRelationships")).join(lost(edges("role", "relationship"), of("organizations")), key, "left_anti")
    variants = of("variants")
    for _ in range(2):
        variants = variants.join(lost(edges("parent"), variants), key, "left_anti")
    variants = cut(variants)
    pathways = of("pathways").join(lost(edges("pathway_variant"), variants), key, "left_anti")
    steps = edges("step").join(live.select("slug", "claim_id"), ["slug", "claim_id"], "left_semi").join(of("stages").select("slug", F.col("record_id").alias("target")), ["slug", "target"], "left_semi")
    pathways = pathways.join(steps, key, "left_semi")
    left = cut(kept.filter(~F.col("family").isin("organizationRoles", "institutionRelationships", "variants", "pathways")).unionByName(bound).unionByName(variants).unionByName(pathways))

    untreated = lost(edges("treatment"), of("costItems")).select("slug", "claim_id")
    treated = (F.col("slot") != "treatment") | (F.col("status") == "disclosed")
    stay = live.filter(treated).join(left.select(*key), key, "left_semi").join(untreated, ["slug", "claim_id"], "left_anti")
    stay = stay.filter("slot <> 'steps'").unionByName(stay.filter("slot = 'steps'").join(steps, ["slug", "claim_id"], "left_semi"))
    stay = cut(stay.select("slug", "family", "record_id", "slot", "claim_id", "status"))
    timed = stay.filter("slot = 'timings'").select("slug", F.col("claim_id").alias("target"))
    timings = edges("timing").join(left.select(*key), key, "left_semi").join(timed, ["slug", "target"], "left_semi").select(*key, "target")
    return Pruned(left, stay, timings)


def unbound_roles(roles: DataFrame, names: DataFrame) -> DataFrame:
    """Roles ``(slug, claim_id, role, organization_id, evidence)`` whose evidence doesn't bind role and organization ``(slug, organization_id, name)``."""
    said = F.regexp_like(F.lower("evidence"), _lookup(ROLE_WORDS, F.col("role")))
    bound = F.coalesce(said, F.lit(True)) & F.coalesce(E.entity_appears(F.col("name"), F.lower("evidence")), F.lit(False))
    return roles.join(names, ["slug", "organization_id"], "left").filter(~bound).select("slug", "claim_id")


def unbound_relationships(relationships: DataFrame, names: DataFrame) -> DataFrame:
    """Disclosed relationships ``(slug, claim_id, type, organization_id, institution, evidence)`` that their evidence denies or doesn't bind."""
    text = F.lower("evidence")
    said = F.regexp_like(text, _lookup(RELATIONSHIP_WORDS, F.col("type"))) & ~F.coalesce(F.regexp_like(text, _lookup(DENIALS, F.col("type"))), F.lit(False))
    target = F.when(F.col("organization_id").isNull(), F.col("institution")).otherwise(F.col("name"))
    bound = F.coalesce(said, F.lit(True)) & F.coalesce(E.entity_appears(target, text), F.lit(False))
    return relationships.join(names, ["slug", "organization_id"], "left").filter(~bound).select("slug", "claim_id")


def outcome_faults(outcomes: DataFrame) -> DataFrame:
    """``(slug, record_id, message)`` of outcomes whose nature, restriction or recipient doesn't fit their type; columns are null unless disclosed."""
    cash, budget = F.col("type").isin(CASH_TYPES), F.col("type") == "project_budget"
    differs = lambda c, wanted: ~F.coalesce(F.col(c) == wanted, F.lit(False))
    recipient = _lookup(RECIPIENTS, F.col("type"))
    faults = F.array(
        F.when(cash & differs("nature", "cash"), F.lit("cash outcomes need a disclosed cash classification")),
        F.when(budget & differs("nature", "restricted_funding"), F.lit("project budgets are restricted funding")),
        F.when(budget & F.col("restriction").isNull(), F.lit("project budgets need a use restriction")),
        F.when(F.col("recipient") != recipient, F.concat(F.col("type"), F.lit(" needs recipient "), recipient)),
    )
    return outcomes.select("slug", "record_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("message"))


def relationship_faults(relationships: DataFrame) -> DataFrame:
    """``(slug, record_id, message)`` of relationships whose subject and type don't go together: affiliations of persons are no ties of institutions."""
    subject = _lookup(SUBJECTS, F.col("type"))
    allowed = _lookup({v: k for k, v in SUBJECTS.items()}, F.col("subject"))
    faults = F.array(
        F.when(F.col("subject") != subject, F.concat(F.col("type"), F.lit(" needs subject "), subject)),
        F.when((F.col("type") != allowed) & ~F.col("type").isin("unclear", "other"), F.concat(F.col("subject"), F.lit(" can only carry "), allowed)),
    )
    return relationships.select("slug", "record_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("message"))


def salvage(records: DataFrame, refs: DataFrame, faulty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PIPE-08: the records that form a valid card, and warnings ``(slug, family, place, record_id, problem)`` on the rest.

    ``records (slug, family, place, record_id)``; ``refs (slug, record_id, target)``: each target must be there
    too; ``faulty (slug, record_id)``: records with a fault of their own. A card without fault or unknown
    target is taken whole. Else its families are taken up in order: whole, if valid with what has been taken
    so far; record by record otherwise, until a pass adds none. Of a repeated record_id the first, by family
    and place, can stay. A cycle is taken whole or not; a family of which nothing stays has a row without a record.

    A reference meets both its records once; from then on only what is lost goes from family to family.
    """
    key, row = ["slug", "record_id"], ["slug", "family", "place", "record_id"]
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    by_id = Window.partitionBy(*key).orderBy(order, "place")
    again = F.row_number().over(by_id) > 1
    twin = F.coalesce((F.first("family").over(by_id) == F.col("family")) & (F.first("place").over(by_id) == F.col("place")) & F.col("record_id").isNotNull(), F.lit(False))
    bad = faulty.select(*key).distinct().withColumn("bad", F.lit(True))
    rows = records.select(*row, F.coalesce(order, F.lit(0)).cast("int").alias("rank"), again.alias("again"), twin.alias("twin"))  # twin: equal to the first of its identifier, as that is itself
    rows = cut(rows.join(bad, key, "left").withColumn("bad", F.coalesce("bad", F.col("again"))))
    odd = F.col("slug").isNotNull() & ((F.col("rank") == 0) | ~F.col("twin") & ~F.col("again"))  # of no known family, or without place or identifier
    aside = cut(rows.filter(F.col("bad") | odd))

    # of a repeated identifier the first record alone can stay, so a reference goes from first record to first record;
    # both joins read the same columns of them, so they share a shuffle
    first = rows.filter("NOT again").select(*key, "place", "rank", "bad")
    meets = lambda record, by: (F.col("r.slug") == F.col(f"{record}.slug")) & (F.col(f"r.{by}") == F.col(f"{record}.record_id"))
    refs = refs.alias("r").join(first.alias("o"), meets("o", "record_id")).select("r.slug", "r.record_id", "r.target", "o.place", "o.rank", "o.bad")
    refs = refs.alias("r").join(first.alias("t"), meets("t", "target"), "left").select("r.*", *(F.col(f"t.{c}").alias(f"target_{c}") for c in ("place", "rank", "bad")))
    refs = cut(refs)
    broken = cut(aside.filter("bad").select("slug").unionByName(refs.filter("target_rank IS NULL").select("slug")).distinct())
    ahead = refs.filter("NOT target_bad AND (target_rank = 0 OR target_rank > rank)").join(broken, "slug", "left_semi")
    hopeless = cut(refs.filter("target_rank IS NULL OR target_bad").unionByName(ahead).select(*key, "place", "rank").distinct())
    refs = refs.filter("NOT target_bad AND target_rank BETWEEN 1 AND rank")
    linked = {(r["rank"], r["target_rank"]) for r in refs.select("rank", "target_rank").distinct().collect()}  # pairs of families at most

    of_broken = aside.join(broken, "slug", "left_semi")
    lost = of_broken.filter("rank = 0 AND NOT again").select(*row)
    named = lambda df: df.select("slug", F.col("record_id").alias("target"))
    for rank, family in enumerate(FAMILIES, 1):
        of_family, here = F.col("rank") == rank, ["slug", F.lit(family).alias("family"), "place", "record_id"]
        stuck = hopeless.filter(of_family).select(*here)
        if any(of == rank and target < rank for of, target in linked):
            stuck = stuck.unionByName(refs.filter(of_family & (F.col("target_rank") < rank)).join(named(lost), ["slug", "target"], "left_semi").select(*here))
        stuck = cut(stuck)
        own = aside.filter(of_family & F.col("bad"))
        flawed = own.select("slug").unionByName(stuck.select("slug")).distinct()
        if family == "cycle":
            gone = cut(rows.filter(of_family & ~F.col("again")).join(flawed, "slug", "left_semi").select(*row))
        else:
            never = own.filter("NOT again").select(*row).unionByName(stuck)
            inner = refs.filter(of_family & (F.col("target_rank") == rank)).join(flawed, "slug", "left_semi").select(*here, "target")
            inner = cut(inner) if (rank, rank) in linked else inner.filter("false")
            gone = cut(never.unionByName(inner.select(*row)).distinct())
            before, now = 0, gone.count() if (rank, rank) in linked else 0
            while now != before:  # who waits for none that is gone stays
                gone = cut(never.unionByName(inner.join(named(gone), ["slug", "target"], "left_semi").select(*row)).distinct())
                before, now = now, gone.count()
        lost = lost.unionByName(gone)

    is_lost = lost.select(F.col("slug").alias("s"), F.col("record_id").alias("r"))
    same = (F.col("slug") == F.col("s")) & F.col("record_id").eqNullSafe(F.col("r"))
    taken = rows.filter("slug IS NULL OR NOT again").join(is_lost, same, "left_anti").select(*row)
    copies = aside.filter("again AND slug IS NOT NULL")
    left = copies.filter("NOT twin").unionByName(copies.filter("twin").join(is_lost, same, "left_semi"))
    left = left.unionByName(of_broken.filter("rank > 0 AND NOT twin AND NOT again").join(is_lost, same, "left_anti")).select(*row).unionByName(lost)
    number = rows.select("slug", "family", F.when(F.col("again"), 0).otherwise(1).alias("n")).unionByName(lost.select("slug", "family", F.lit(-1).alias("n")))
    none = number.filter("slug IS NOT NULL AND family <> 'cycle'").groupBy("slug", "family").agg(F.sum("n").alias("n")).filter("n = 0").select("slug", "family")
    warnings = left.withColumn("problem", F.when(F.col("family") == "cycle", "family withheld").otherwise("record withheld"))
    return taken, warnings.unionByName(none.withColumn("problem", F.lit("family withheld")), allowMissingColumns=True)
