"""Structured records of a card (organizations, relationships, outcomes, scoped claims) as summary fields.

Every operator is one grouping by card; lists hold one card's records, which a card's schema bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Summary fields and the outcome types that fill them.
OUTCOME_FIELDS = {
    "cash_award": ["personal_cash_prize", "team_cash_prize"],
    "stipend": ["stipend"],
    "tuition_waiver": ["tuition_waiver", "scholarship"],
    "program_seat": ["program_seat"],
    "in_kind_value": ["equipment", "other_in_kind"],
    "mentorship": ["mentorship"],
    "certificate": ["certificate"],
    "college_credit": ["college_credit"],
}
#: Outcomes of educators, which no participant's field shows.
EDUCATOR_TYPES = ["educator_cash_prize"]
PARTICIPANTS = ["individual", "team", "project"]
#: Relationship types that keep or change their name in the summary.
RELATIONSHIPS = {t: t for t in ["institution_operated", "institution_sponsored", "institution_partnered", "hosted_at_institution", "independent", "unclear"]} | {"founders_affiliated_with": "founded_by_affiliates"}


def _in_order(key: str, value: Column) -> Column:
    """The values of a group that aren't null, by key."""
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(key).alias("k"), value.alias("v")))))
    return F.transform(listed, lambda x: x["v"])


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def primary_operator(roles: DataFrame, organizations: DataFrame) -> DataFrame:
    """PRJ-01, PRJ-02: ``(slug, operating_organization, organization_type)`` from ``(slug, role_id, org_id, role)`` and ``(org_id, name, kind)``.

    Operators in id order, else every role with its name in brackets; unknown organizations give no piece,
    cards without a piece no row. The type needs exactly one operator of known kind.
    """
    named = roles.join(organizations, "org_id", "left")
    is_operator = F.col("role") == "operator"
    with_role = F.concat("name", F.lit(" ("), F.lower(F.replace("role", F.lit("_"), F.lit(" "))), F.lit(")"))
    g = named.groupBy("slug").agg(
        F.count_if(is_operator).alias("n"), _in_order("role_id", F.when(is_operator, F.col("name"))).alias("operators"), _in_order("role_id", with_role).alias("others"), F.max(F.when(is_operator, F.col("kind"))).alias("kind")
    )
    pieces = F.when(F.col("n") > 0, F.col("operators")).otherwise(F.col("others"))
    return g.filter(F.size(pieces) > 0).select("slug", F.array_join(pieces, "; ").alias("operating_organization"), F.when(F.col("n") == 1, F.col("kind")).alias("organization_type"))


def relationships(records: DataFrame, organizations: DataFrame) -> DataFrame:
    """PRJ-03..05 from ``(slug, relation_id, status, type, target_name, org_id, display, description)``; disclosed records only.

    A target's own name beats its organization's; several relationships have one general label and no
    normalised value.
    """
    known = records.filter("status = 'disclosed'").join(organizations.select("org_id", "name"), "org_id", "left")
    target = F.coalesce("target_name", "name")
    g = known.groupBy("slug").agg(F.count("*").alias("n"), F.array_distinct(_in_order("relation_id", target)).alias("targets"), F.min("display").alias("display"), F.min("type").alias("type"), _in_order("relation_id", F.col("description")).alias("why"))
    one = F.col("n") == 1
    return g.select(
        "slug",
        F.when(F.size("targets") > 0, F.array_join("targets", "; ")).alias("named_institution"),
        F.when(one, F.col("display")).otherwise("Multiple institution relationships — see details").alias("institution_relationship"),
        F.when(one, _lookup(RELATIONSHIPS, F.col("type"))).alias("relationship"),
        F.array_join("why", "; ").alias("relationship_explanation"),
    )


def scoped_projection(claims: DataFrame) -> DataFrame:
    """PRJ-08..12: ``(slug, field_id, display, note)`` from ``(slug, field_id, claim_id, display, by_variant, by_process)``.

    One display without scope stands as it is; otherwise a label tells what the values vary by, and the
    note has the distinct displays in order.
    """
    g = claims.groupBy("slug", "field_id").agg(F.array_distinct(_in_order("claim_id", F.col("display"))).alias("displays"), F.bool_or("by_variant").alias("v"), F.bool_or("by_process").alias("p"))
    v, p, several = F.col("v"), F.col("p"), F.size("displays") > 1
    by = F.when(v & p, "program/cohort and stage/pathway").when(v, "program/cohort").when(p, "stage/pathway").otherwise("source record")
    scalar = ~several & ~v & ~p
    label = F.when(scalar, F.col("displays")[0]).when(several, F.concat(F.lit("Varies by "), by)).otherwise(F.concat(F.lit("Scoped by "), by, F.lit(" — see details")))
    return g.select("slug", "field_id", label.alias("display"), F.when(~scalar, F.array_join("displays", "; ")).alias("note"))


def project_outcomes(outcomes: DataFrame) -> DataFrame:
    """PRJ-16, PRJ-17: ``(slug, field_id, display, amount, note)`` from ``(slug, outcome_id, type, label, recipient, nature, amount, amount_display)``.

    Only what participants receive counts; cash awards and stipends must be cash. One outcome shows its
    label, and its amount by recipient; several have a general label. Types of no field are other benefits.
    """
    types = {t: field for field, listed in OUTCOME_FIELDS.items() for t in listed}
    field = F.coalesce(_lookup(types, F.col("type")), F.lit("other_benefits"))
    shown = outcomes.filter(F.col("recipient").isin(PARTICIPANTS) & ~F.col("type").isin(EDUCATOR_TYPES)).withColumn("field_id", field)
    shown = shown.filter(~F.col("field_id").isin("cash_award", "stipend") | F.coalesce(F.col("nature") == "cash", F.lit(False)))
    single = F.when(F.col("amount").isNotNull(), F.concat("label", F.lit(" — "), "amount_display", F.lit("/"), "recipient")).otherwise(F.col("label"))
    g = shown.groupBy("slug", "field_id").agg(F.count("*").alias("n"), F.min(single).alias("single"), F.min("amount").alias("amount"), F.array_join(_in_order("outcome_id", F.col("label")), "; ").alias("labels"))
    one, other = F.col("n") == 1, F.col("field_id") == "other_benefits"
    many = F.when(F.col("field_id") == "cash_award", "Multiple cash awards — see prize details").otherwise("Multiple outcomes — see details")
    display = F.when(other, F.col("labels")).when(one, F.col("single")).otherwise(many)
    return g.select("slug", "field_id", display.alias("display"), F.when(one & ~other, F.col("amount")).alias("amount"), F.when(~one & ~other, F.col("labels")).alias("note"))


def reset_projected(facts: DataFrame) -> DataFrame:
    """PRJ-19: facts ``(slug, field_id, status, value, rule)`` that a rule wrote fall back to not found; entered ones stay."""
    written = F.col("rule").isNotNull()
    return facts.select("slug", "field_id", F.when(written, "not_found").otherwise(F.col("status")).alias("status"), F.when(~written, F.col("value")).alias("value"))


def drift(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """PRJ-20: fields whose stored status or value isn't what the rules give now, either side's absence included."""
    side = lambda df, s: df.select("slug", "field_id", F.struct("status", "value").alias(s))
    both = side(stored, "stored").join(side(computed, "computed"), ["slug", "field_id"], "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("computed"))).select("slug", "field_id", F.col("stored.status").alias("stored"), F.col("computed.status").alias("computed"))


def limit_coverage(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """PIPE-06: absence can't be claimed where a source ``(slug, text, truncated)`` had no text or was cut; such facts become unclear."""
    g = sources.groupBy("slug").agg(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) == "").alias("no_text"), F.bool_or("truncated").alias("cut"))
    limited = (F.col("status") == "not_found") & (F.col("no_text") | F.col("cut"))
    held = facts.join(g, "slug", "left")
    return held.select("slug", "field_id", F.when(limited, "unclear").otherwise(F.col("status")).alias("status"), F.when(limited, F.when(F.col("no_text"), "no_text").otherwise("truncated")).alias("reason"))


def metadata_mismatches(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """JN-01: evidence ``(evidence_id, page_id, url, title)`` of an unknown page, or of one with another url or title."""
    known = pages.select("page_id", F.struct("url", "title").alias("page"))
    met = evidence.join(known, "page_id", "left")
    problem = F.when(F.col("page").isNull(), "unknown page").when(~F.col("page").eqNullSafe(F.struct("url", "title")), "different page")
    return met.select("evidence_id", problem.alias("problem")).filter("problem IS NOT NULL")
