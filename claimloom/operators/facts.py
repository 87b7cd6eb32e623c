"""Operators on long facts ``(slug, field_id, status, ...)``; five statuses, none of them SQL null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNRESOLVED = ["not_found", "unclear", "conflicting"]


def matches_disclosure(status: Column, wanted: str) -> Column:
    """FLT-03: a status against ``all``, ``disclosed``, ``not_applicable`` or ``unresolved``."""
    if wanted == "all":
        return F.lit(True)
    return status.isin(UNRESOLVED) if wanted == "unresolved" else status == wanted


def disclosure_counts(facts: DataFrame, total: int) -> DataFrame:
    """AGG-01: one row for each slug; ``total``: core fields there are; facts: core ones that were assessed."""
    of = lambda s: F.count_if(F.col("status") == s)
    counts = facts.groupBy("slug").agg(of("disclosed").alias("disclosed"), of("not_found").alias("not_found"), of("unclear").alias("unclear"), of("conflicting").alias("conflicting"), of("not_applicable").alias("not_applicable"), F.count("*").alias("assessed"))
    part = lambda n, words: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {words}")))
    col = F.col
    detail = F.concat_ws(" · ", F.concat(col("assessed").cast("string"), F.lit(f" of {total} core areas assessed")), part(col("not_found"), "not found"), part(col("unclear"), "unclear"), part(col("conflicting"), "conflicting"), part(col("not_applicable"), "not applicable"), part(col("unassessed"), "unassessed"))
    label = F.concat(col("disclosed").cast("string"), F.lit(" of "), col("applicable").cast("string"), F.lit(" applicable core facts disclosed"))
    return counts.withColumn("applicable", col("assessed") - col("not_applicable")).withColumn("unassessed", F.lit(total) - col("assessed")).withColumn("label", label).withColumn("detail_label", detail)


def quality_signals(facts: DataFrame) -> DataFrame:
    """AGG-02: supported counts conflicting facts as well; unresolved doesn't."""
    s = F.col("status")
    return facts.groupBy("slug").agg(F.count_if(s.isin("disclosed", "conflicting")).alias("supported"), F.count_if(s != "not_applicable").alias("applicable"), F.count_if(s.isin("not_found", "unclear")).alias("unresolved"))


def compare(facts: DataFrame, slugs: list[str]) -> DataFrame:
    """JN-11: two or three cards, one row for each field, a column for each card, and whether they differ; of repeated facts the greatest counts."""
    if not 2 <= len(slugs) <= 3:
        raise ValueError("a comparison takes two or three cards")
    cell = F.max(F.concat_ws("|", "status", F.coalesce("value", F.lit(""))))
    wide = facts.filter(F.col("slug").isin(slugs)).groupBy("field_id").pivot("slug", slugs).agg(cell)
    cells = [F.coalesce(F.col(f"`{s}`"), F.lit("")) for s in slugs]
    return wide.select("field_id", *(c.alias(f"card_{k}") for k, c in enumerate(cells, 1)), (F.size(F.array_distinct(F.array(*cells))) > 1).alias("differs"))


def keep_baseline(base: DataFrame, extended: DataFrame) -> DataFrame:
    """JN-15: baseline facts that settle a field win over extended ones."""
    settled = F.col("b.status").isin("disclosed", "conflicting", "not_applicable")
    pick = lambda c: F.when(settled, F.col(f"b.{c}")).otherwise(F.coalesce(F.col(f"e.{c}"), F.col(f"b.{c}"))).alias(c)
    return base.alias("b").join(extended.alias("e"), ["slug", "field_id"], "left").select("slug", "field_id", pick("status"), pick("value"))


def validate_evidence(facts: DataFrame, evidence: DataFrame, texts: DataFrame, supported: Column) -> DataFrame:
    """PIPE-01: statuses after checking evidence ``(slug, field_id, candidate, source_id, excerpt)`` against ``(source_id, text)``.

    Disclosed needs one supported excerpt, conflicting two candidates with one each; either falls to
    unclear. ``errors`` counts excerpts that aren't in their source's text.
    """
    checked = evidence.join(texts, "source_id", "left").withColumn("ok", F.coalesce(supported, F.lit(False)))
    found = checked.groupBy("slug", "field_id").agg(F.count_if("ok").alias("supported"), F.count_if(~F.col("ok")).alias("errors"), F.count_distinct(F.when(F.col("ok"), F.col("candidate"))).alias("candidates"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when((F.col("status") == "disclosed") & (n("supported") == 0), "unclear").when((F.col("status") == "conflicting") & (n("candidates") < 2), "unclear").otherwise(F.col("status"))
    return facts.join(found, ["slug", "field_id"], "left").select("slug", "field_id", status.alias("status"), n("supported").alias("supported"), n("errors").alias("errors"))


def first_writer(projected: DataFrame) -> DataFrame:
    """WIN-14: of several rules that write a field of a card, the one of lowest priority number."""
    order = F.row_number().over(Window.partitionBy("slug", "field_id").orderBy("rule_priority"))
    return projected.withColumn("place", order).filter("place = 1").drop("place")


def project_costs(costs: DataFrame) -> DataFrame:
    """PRJ-14: one row for each slug and cost kind, from ``(slug, record_id, kind, requirement, status, amount, currency, conditional, scoped)``."""
    needed = costs.filter("requirement <> 'optional'")
    disclosed = F.col("status") == "disclosed"
    g = needed.groupBy("slug", "kind").agg(
        F.count("*").alias("n"), F.count_if(disclosed).alias("n_disclosed"), F.count_distinct(F.struct("amount", "currency")).alias("n_amounts"), F.bool_or("conditional").alias("any_conditional"), F.bool_or("scoped").alias("any_scope"),
        F.min_by("amount", "record_id").alias("first_amount"), F.min_by(F.when(~disclosed, F.col("status")), F.when(~disclosed, F.col("record_id"))).alias("first_open"),
    )
    settled = F.col("n") == F.col("n_disclosed")
    label = F.when(~settled, F.lit(None)).when((F.col("n") == 1) & ~F.col("any_scope") & ~F.col("any_conditional"), F.lit("scalar")).when(F.col("any_conditional"), F.lit("Conditional")).when((F.col("n_amounts") == 1) & ~F.col("any_scope"), F.lit("same")).when((F.col("kind") == "application_fee") & ~F.col("any_scope"), F.lit("Multiple application fees")).otherwise(F.lit("Varies by program/cohort"))
    return g.select("slug", "kind", F.when(settled, F.lit("disclosed")).otherwise(F.col("first_open")).alias("status"), label.alias("label"), F.when(label == "scalar", F.col("first_amount")).alias("amount"))


# fixed values: the kinds of cost that have a field, in the order in which they write it
COST_FIELDS = {
    "application_fee": "application_fee",
    "deposit": "deposit",
    "tuition": "tuition",
    "materials": "other_mandatory_costs",
    "other": "other_mandatory_costs",
}


def project_cost_fields(costs: DataFrame) -> DataFrame:
    """PRJ-14 on the four cost fields: ``(slug, field_id, kind, status, amount, display, note, rule)``, one row for each field that a cost writes.

    Reads ``(slug, position, kind, label, requirement, status, scoped, amount, minimum, maximum, currency, display, note)``; a
    range has a minimum and maximum in place of an amount. Where two kinds write one field the later kind's row stays. One
    unscoped, unconditional cost gives its amount, or a range's text; several give a label, and equal amounts need equal currencies.
    """
    kinds = list(COST_FIELDS)
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    field = F.create_map(*(F.lit(x) for pair in COST_FIELDS.items() for x in pair))[F.col("kind")]
    disclosed = F.col("status") == "disclosed"
    needed = costs.filter("NOT (requirement <=> 'optional')").withColumn("field_id", field).filter("field_id IS NOT NULL")
    value = F.struct("amount", "minimum", "maximum", "currency")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "display"))), lambda c: F.concat(c["label"], F.lit(": "), c["display"]))
    by_card = needed.repartition("slug")  # dealt once: the distinct amounts, the kinds and the fields all group within a card
    g = by_card.groupBy("slug", "field_id", "kind", place.alias("place")).agg(
        F.count("*").alias("n"), F.count_if(disclosed).alias("n_disclosed"), F.count_distinct(F.when(disclosed, value)).alias("n_amounts"),
        F.bool_or(F.col("requirement") == "conditional").alias("conditional"), F.bool_or("scoped").alias("scoped"), F.array_join(listed, "; ").alias("all_costs"),
        F.min_by(F.struct("amount", "display"), "position").alias("first"), F.min_by(F.when(~disclosed, F.struct("status", "note")), F.when(~disclosed, F.col("position"))).alias("open"),
    )
    settled, universal = F.col("n") == F.col("n_disclosed"), ~F.col("scoped")
    single = settled & (F.col("n") == 1) & universal & ~F.col("conditional")
    label = (
        F.when(F.col("conditional"), F.lit("Conditional — see cost details"))
        .when(universal & (F.col("n_amounts") == 1), F.col("first.display"))
        .when(universal & (F.col("kind") == "application_fee"), F.lit("Multiple application fees — see cost details"))
        .otherwise(F.lit("Varies by program/cohort"))
    )
    status = F.when(settled, F.lit("disclosed")).when(F.col("open.status").isin("conflicting", "not_applicable", "not_found"), F.col("open.status")).otherwise(F.lit("unclear"))
    ending = F.when(single, F.lit("")).when(settled, F.lit("-matrix")).when(status == "conflicting", F.lit("-conflicting")).otherwise(F.lit("-unresolved"))
    disagree = F.lit("Reviewed sources support different amounts for this structured cost; no value was selected.")
    note = F.when(single, F.lit(None)).when(settled, F.col("all_costs")).when(status == "conflicting", disagree).otherwise(F.col("open.note"))
    row = F.struct(
        "kind", status.alias("status"), F.when(single, F.col("first.amount")).alias("amount"), F.when(single, F.col("first.display")).when(settled, label).alias("display"),
        note.alias("note"), F.concat(F.lit("costs."), F.col("kind"), ending).alias("rule"),
    )
    return g.groupBy("slug", "field_id").agg(F.max_by(row, "place").alias("row")).select("slug", "field_id", "row.*")


def project_total(costs: DataFrame, mapped: list[str]) -> DataFrame:
    """PRJ-15: the total's cascade over ``project_costs`` input with ``credited``, ``currency`` and ``complete``; first rule that applies."""
    charged = costs.filter("requirement <> 'optional' AND NOT credited")
    open_ = F.col("status") != "disclosed"
    g = charged.groupBy("slug").agg(
        F.min_by(F.when(open_, F.col("status")), F.when(open_, F.col("record_id"))).alias("first_open"), F.bool_and("complete").alias("complete"), F.bool_or("conditional").alias("any_conditional"), F.bool_or("scoped").alias("any_scope"),
        F.count_distinct("currency").alias("n_currencies"), F.bool_and(F.col("kind").isin(mapped)).alias("all_mapped"), F.count_distinct("kind").alias("n_kinds"), F.count("*").alias("n"), F.sum("amount").alias("total"),
    )
    fits = (F.col("n_currencies") == 1) & F.col("all_mapped") & (F.col("n_kinds") == F.col("n"))
    rule = F.when(F.col("first_open").isNotNull(), F.concat(F.lit("open:"), F.col("first_open"))).when(~F.col("complete"), "incomplete").when(F.col("any_conditional"), "conditional").when(F.col("any_scope"), "scoped").when(fits, "sum").otherwise("incompatible")
    return g.select("slug", rule.alias("rule"), F.when(rule == "sum", F.round("total", 2)).alias("total"))


def quality_gate(signals: DataFrame) -> DataFrame:
    """PIPE-10, normal gate, over one row of signals a card: reasons in order, outcome, and whether a failure may be cached."""
    c = F.col
    high = [
        ("TARGET_IDENTITY_UNRESOLVED", c("name_status") != "disclosed"),
        ("TOO_FEW_SUPPORTED_FACTS", (c("supported") < 5) | (c("practical_areas") < 3)),
        ("EXCESSIVE_CANDIDATE_REJECTION", (c("attempted") >= 6) & (c("rejected_ratio") >= 0.75) & (c("supported") < 8)),
        ("CYCLE_CONTEXT_UNRESOLVED", c("cycle_material") & ~c("cycle_modeled") & (c("practical_areas") < 5)),
        ("INSUFFICIENT_SOURCE_COVERAGE", (c("pages") <= 1) & (c("important_failures") >= 2) & (c("practical_areas") < 5)),
    ]
    medium = [("CORE_CLAIMS_WITHHELD", c("withheld_areas") > 0), ("PRIMARY_COVERAGE_GAPS", c("unresolved_primary") >= 3), ("HIGH_PRIORITY_CAVEATS", c("high_attention") > 0)]
    listed = lambda rules: F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))
    judged = signals.withColumn("high", listed(high)).withColumn("insufficient", F.size("high") > 0)
    reasons = F.when(c("insufficient"), c("high")).otherwise(listed(medium))
    good = (F.size("high") == 0) & (c("practical_areas") >= 7) & (c("withheld_areas") == 0) & (c("unresolved_primary") < 3)
    outcome = F.when(c("insufficient"), "insufficient").when(good, "good").otherwise("usable_with_caveats")
    return judged.select("slug", reasons.alias("reasons"), outcome.alias("outcome"), (c("insufficient") & ~c("transient_failure")).alias("cache_eligible"))


def prune_orphans(variants: DataFrame, passes: int = 2) -> DataFrame:
    """JN-19: drops rows whose parent isn't there, in exactly ``passes`` passes and not to a fixpoint."""
    for _ in range(passes):
        parents = variants.select(F.col("id").alias("parent_id")).distinct()
        variants = variants.filter("parent_id IS NULL").unionByName(variants.join(parents, "parent_id", "left_semi").select(variants.columns))
    return variants


def deadline_state(status: Column, iso_date: Column, wording: Column, today: str) -> Column:
    """FLT-05."""
    rolling = wording.rlike(r"(?i)\b(?:rolling|open until filled|applications? (?:are )?open)\b")
    return F.when(status != "disclosed", "missing").when(iso_date.isNotNull(), F.when(iso_date < today, "past").otherwise("upcoming")).when(rolling, "upcoming").otherwise("missing")


def ratio(n: Column, d: Column) -> Column:
    """AGG-10: null where nothing is counted."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def micro_usd(input_tokens: Column, cached: Column, output: Column, rates=(2.0, 0.2, 12.0)) -> Column:
    """AGG-15, report form: dollars a million tokens, cached input at its own rate."""
    return (input_tokens - cached) * rates[0] + cached * rates[1] + output * rates[2]


def milli_usd(input_tokens: Column, cached: Column, output: Column, rates=(2.0, 0.2, 12.0)) -> Column:
    """AGG-15, service form: never negative uncached input, rounded up to thousandths of a dollar."""
    return F.ceil((F.greatest(input_tokens - cached, F.lit(0)) * rates[0] + cached * rates[1] + output * rates[2]) / 1000)


def link_scores(links: DataFrame, rules: list[tuple[str, int, str, int]], negatives: list[str], most: int = 6) -> DataFrame:
    """The best links of each page by a vocabulary of one's own, rules ``(topic, rank, pattern, weight)``, one of each topic first; ``links.rank_links`` has the fixed one.

    A pattern in the text counts its weight, one in the path max(2, weight - 3); each negative takes 10.
    """
    path = F.regexp_replace(F.lower("url"), r"^\w+://[^/]*", "")
    own = lambda p, w: F.when(F.lower("text").rlike(p), w).otherwise(0) + F.when(F.col("path").rlike(p), max(2, w - 3)).otherwise(0)
    topics: dict[str, list] = {}
    for topic, rank, pattern, weight in rules:
        topics.setdefault(topic, [rank]).append(own(pattern, weight))
    listed = F.filter(F.array(*(F.struct(sum(parts, F.lit(0)).alias("own"), F.lit(-rank).alias("first"), F.lit(topic).alias("topic")) for topic, (rank, *parts) in topics.items())), lambda t: t["own"] > 0)
    lost = sum((F.when(F.lower("text").rlike(n), 10).otherwise(0) for n in negatives), F.lit(0))
    scored = links.withColumn("path", path).withColumn("hits", listed).withColumn("score", F.aggregate("hits", F.lit(0), lambda s, t: s + t["own"]) - lost).filter("score > 0").withColumn("topic", F.array_max("hits")["topic"])
    best = F.row_number().over(Window.partitionBy("page_id", "url").orderBy(F.desc("score"), "document_order"))
    ranked = scored.withColumn("b", best).filter("b = 1").withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "topic").orderBy(F.desc("score"), "document_order", "url")))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("nth") > 1, F.desc("score"), "document_order", "url"))
    return ranked.withColumn("place", place).filter(F.col("place") <= most).select("page_id", "url", "topic", "score", "place")
