"""Scores of drafts against reviewed cards, and counts over claims and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields of each core area.
SUPPORTED = ["disclosed", "conflicting"]


def ratio_of(n, d):
    """AGG-10: null where nothing is counted."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def claims_of(facts: DataFrame, expand: bool) -> DataFrame:
    """AGG-14: ``(slug, claim, field_id, attachments)`` from ``(slug, field_id, status, n_sources, candidates array<int>)``.

    ``expand``: the development scorer, which makes each conflicting candidate a claim with its own sources; else one
    claim a fact, with the top level's sources alone.
    """
    stated = facts.filter(F.col("status").isin(SUPPORTED))
    if not expand:
        return stated.select("slug", F.col("field_id").cast("string").alias("claim"), "field_id", F.col("n_sources").alias("attachments"))
    single = stated.filter("status = 'disclosed'").select("slug", F.col("field_id").cast("string").alias("claim"), "field_id", F.col("n_sources").alias("attachments"))
    each = stated.filter("status = 'conflicting'").select("slug", "field_id", F.posexplode("candidates").alias("k", "attachments"))
    return single.unionByName(each.select("slug", F.concat(F.col("field_id").cast("string"), F.lit("#"), F.col("k").cast("string")).alias("claim"), "field_id", "attachments"))


def case_scores(claims: DataFrame, truth: DataFrame, draft: DataFrame) -> DataFrame:
    """AGG-11: numerators and denominators of each case; ``claims``: ``(slug, attachments, correct, evidence_ok)``, the others ``(slug, field_id, status)``. A field that the draft lacks disagrees."""
    made = claims.groupBy("slug").agg(F.count("*").alias("claims"), F.count_if("correct").alias("correct"), F.sum("attachments").alias("evidence"), F.sum(F.when(F.col("evidence_ok"), F.col("attachments")).otherwise(0)).alias("evidence_correct"))
    both = truth.withColumnRenamed("status", "want").join(draft.withColumnRenamed("status", "got"), ["slug", "field_id"], "left")
    agreed = both.groupBy("slug").agg(F.count("*").alias("fields"), F.count_if(F.col("want") == F.col("got")).alias("agreed"), F.count_if(F.col("want").isin(SUPPORTED)).alias("supported"))
    zero = [c for c in ("claims", "correct", "evidence", "evidence_correct")]
    return agreed.join(made, "slug", "left").select("slug", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero), "fields", "agreed", "supported")


def report(scores: DataFrame) -> DataFrame:
    """AGG-12, SNK-06: the ratios of summed counts over all cases; one row."""
    s = scores.agg(*(F.sum(c).alias(c) for c in ("claims", "correct", "evidence", "evidence_correct", "fields", "agreed", "supported")))
    col = F.col
    return s.select(ratio_of(col("correct"), col("claims")).alias("precision"), ratio_of(col("correct"), col("supported")).alias("recall"), ratio_of(col("agreed"), col("fields")).alias("status_agreement"), ratio_of(col("evidence_correct"), col("evidence")).alias("evidence_correctness"))


def reconcile_areas(checks: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """AGG-22: ``(slug, area, model_status, status, n_candidates, n_retained)``.

    ``checks``: ``(slug, area, status)``, ``candidates``: ``(slug, area, field_id, status)``, ``facts``: ``(slug, field_id, status)``.
    What was proposed in an area decides its model status, else the check's own; the facts that stayed decide the rest.
    """
    both = candidates.join(facts.select("slug", "field_id", F.col("status").alias("now")), ["slug", "field_id"], "left")
    now = F.coalesce("now", F.lit("not_found"))
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    g = both.groupBy("slug", "area").agg(
        any_(F.col("status").isin(SUPPORTED)).alias("p_supported"), any_(F.col("status") == "unclear").alias("p_unclear"), any_(F.col("status") == "not_applicable").alias("p_na"),
        any_(now.isin(SUPPORTED)).alias("r_supported"), any_(now == "unclear").alias("r_unclear"), any_(now == "not_applicable").alias("r_na"),
        F.count_distinct("field_id").alias("n_candidates"), F.count_distinct(F.when(now != "not_found", F.col("field_id"))).alias("n_retained"),
    )
    rows = checks.withColumnRenamed("status", "own").join(g, ["slug", "area"], "left")
    model = F.when(F.col("p_supported"), "supported").when(F.col("p_unclear"), "unclear").when(F.col("p_na"), "not_applicable").otherwise(F.col("own"))
    status = F.when(F.col("m") == "not_found", "checked_not_found").when((F.col("m") == "supported") & F.col("r_supported"), "retained").when((F.col("m") == "unclear") & F.col("r_unclear"), "unclear").when(F.col("m").isin("supported", "unclear"), "withheld").when(F.col("r_na"), "not_applicable").otherwise("withheld")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.withColumn("m", model).select("slug", "area", F.col("m").alias("model_status"), status.alias("status"), zero("n_candidates"), zero("n_retained"))


def evidence_counts(facts: DataFrame) -> DataFrame:
    """AGG-04, AGG-17: ``(slug, supported, evidence)``: stated facts with a claim or sources, and all sources, those of a conflict being its candidates'."""
    n = F.when(F.col("status") == "conflicting", F.aggregate("candidates", F.lit(0), lambda s, x: s + x)).otherwise(F.col("n_sources"))
    counted = F.col("status").isin(SUPPORTED) & (F.col("has_claim") | (F.col("n_sources") > 0))
    return facts.groupBy("slug").agg(F.count_if(counted).alias("supported"), F.sum(n).alias("evidence"))


def resolved_urls(reviewed: DataFrame, acquired: DataFrame) -> DataFrame:
    """JN-21: ``(slug, n_acquired, n_reviewed)``: exact reviewed addresses that were acquired."""
    hit = acquired.select("slug", "url").distinct().withColumn("hit", F.lit(True))
    return reviewed.join(hit, ["slug", "url"], "left").groupBy("slug").agg(F.count_if("hit").alias("n_acquired"), F.count("*").alias("n_reviewed"))
