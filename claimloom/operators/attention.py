"""What a reader should check: deterministic attention items, their order, and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories and priorities in their order; fields that measure selectivity, and wording that does.
CATEGORIES = ["cost", "deadline", "eligibility", "organization_relationship", "selection", "outcome", "refund", "source_coverage", "cycle", "other"]
PRIORITIES = ["high", "medium", "low"]
MEASURES = ["applicant_count", "acceptance_count", "acceptance_rate_claim"]
MEASURE_WORDS = r"(?i)\b(?:applicant totals?|acceptance(?: totals?| counts?| rates?)?|numerical selectivity|selectivity (?:data|figure|figures|number|numbers)|quantif(?:y|ied|ication))\b"
SCHEDULE = ["start_date", "end_date", "duration"]
#: Id, category, priority and fields of each item.
ITEMS = [
    ("mandatory-cost-incomplete", "cost", "high", ["estimated_total_mandatory_cost", "tuition", "other_mandatory_costs"]),
    ("deadline-conflict", "deadline", "high", ["application_deadline"]),
    ("deadline-unresolved", "deadline", "high", ["application_deadline"]),
    ("refund-unresolved", "refund", "high", ["refund_policy", "tuition"]),
    ("institution-relationship-unresolved", "organization_relationship", "high", ["named_institution", "institution_relationship"]),
    ("selectivity-not-quantified", "selection", "medium", MEASURES),
    ("cycle-unresolved", "cycle", "high", ["application_deadline"]),
]


def _conditions(of) -> list[Column]:
    open_ = lambda field: of(field).isin("not_found", "unclear")
    stated = lambda field: of(field).isin("disclosed", "conflicting")
    total = of("estimated_total_mandatory_cost")
    conflict = of("application_deadline") == "conflicting"
    return [
        (total == "unclear") | (stated("tuition") & (total == "not_found")) | F.col("costs_incomplete"),
        conflict,
        ~conflict & open_("application_deadline"),
        open_("refund_policy") & stated("tuition"),
        open_("institution_relationship") & (of("named_institution") == "disclosed"),
        open_(MEASURES[0]) & open_(MEASURES[1]) & open_(MEASURES[2]) & F.col("selectivity_matters"),
        ~F.col("cycle_modeled") & stated("application_deadline"),
    ]


def deterministic(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """PIPE-09: ``(slug, id, category, priority, field_ids, place)``; ``facts``: ``(slug, field_id, status)``, ``cards``: ``(slug, costs_incomplete, cycle_modeled, selectivity_matters)``. A field that isn't there is not found."""
    fields = sorted({f for *_, own in ITEMS for f in own})
    wide = cards.join(facts.groupBy("slug").agg(*(F.max(F.when(F.col("field_id") == f, F.col("status"))).alias(f) for f in fields)), "slug", "left")
    of = lambda field: F.coalesce(F.col(field), F.lit("not_found"))
    listed = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(category).alias("category"), F.lit(priority).alias("priority"), F.array(*map(F.lit, own)).alias("field_ids"), F.lit(place).alias("place"))) for place, ((name, category, priority, own), cond) in enumerate(zip(ITEMS, _conditions(of), strict=True)))))
    return wide.select("slug", F.explode(listed).alias("i")).select("slug", "i.*")


def _measures(item: Column) -> Column:
    return (item["category"] == "selection") & (F.arrays_overlap(item["field_ids"], F.array(*map(F.lit, MEASURES))) | item["words"].rlike(MEASURE_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """JN-18: the same id, or the same category and a shared reference or both on selectivity figures."""
    shared = F.arrays_overlap(a["field_ids"], b["field_ids"]) | F.arrays_overlap(a["claim_ids"], b["claim_ids"])
    return (a["id"] == b["id"]) | ((a["category"] == b["category"]) & (shared | (_measures(a) & _measures(b))))


def deduplicate(items: DataFrame) -> DataFrame:
    """ORD-03, WIN-12: ``(slug, rank, id)`` of the items that overlap no earlier one that stayed, by priority, category, grounded first, then place.

    ``items``: ``(slug, id, category, priority, grounded, place, field_ids, claim_ids, words)``; a fold over a card's items, which its schema bounds.
    """
    rank = lambda listed, c: F.array_position(F.array(*map(F.lit, listed)), F.col(c))
    item = F.struct(rank(PRIORITIES, "priority").alias("p"), rank(CATEGORIES, "category").alias("c"), (~F.col("grounded")).alias("g"), "place", "id", "category", "field_ids", "claim_ids", "words")
    ordered = items.groupBy("slug").agg(F.array_sort(F.collect_list(item)).alias("listed"))
    kept = F.aggregate("listed", F.slice("listed", 1, 0), lambda out, x: F.when(F.exists(out, lambda y: overlap(y, x)), out).otherwise(F.concat(out, F.array(x))))
    return ordered.select("slug", F.posexplode(kept).alias("at", "item")).select("slug", (F.col("at") + 1).alias("rank"), "item.id")


def material(items: DataFrame, facts: DataFrame) -> DataFrame:
    """FLT-22: without items that only miss an end date where start and duration are disclosed."""
    status = facts.groupBy("slug").agg(*(F.max(F.when(F.col("field_id") == f, F.col("status"))).alias(f"_{f}") for f in SCHEDULE))
    known = (F.coalesce("_end_date", F.lit("not_found")) == "not_found") & (F.col("_start_date") == "disclosed") & (F.col("_duration") == "disclosed")
    only = F.array_contains("field_ids", "end_date") & (F.size("claim_ids") == 0) & (F.size(F.array_except("field_ids", F.array(*map(F.lit, SCHEDULE)))) == 0)
    return items.join(status, "slug", "left").filter(~F.coalesce(known & only, F.lit(False))).select(items.columns)
