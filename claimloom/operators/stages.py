"""Stages, timings and pathways of a card as summary fields; every operator is a grouping by card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The summary field of a timing's event, in the order in which events may fill it.
EVENT_FIELDS = {"deadline": "application_deadline", "decision": "decision_date", "notification": "decision_date", "starts": "start_date", "ends": "end_date"}
#: Kinds and wording of stages that select.
SELECTION_KINDS = ["application", "interview", "proposal_review", "semifinal", "pitch", "finalist", "summit_final", "winner_selection"]
SELECTION_WORDS = r"(?i)\b(?:application|apply|interview|review|selection|semifinal|finalist|decision|ranking|match day|winner|pitch)\b"
SCOPE = ["scope_variants", "scope_stages", "scope_pathways"]


def _ordered(*keys: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"])


def _nonempty(column: str) -> Column:
    return F.size(column) > 0


def variation_label(by_variant: Column, by_process: Column, differ: Column) -> Column:
    of = F.when(by_variant & by_process, "program/cohort and stage/pathway").when(by_variant, "program/cohort").when(by_process, "stage/pathway").otherwise("source record")
    return F.when(differ, F.concat(F.lit("Varies by "), of)).otherwise(F.concat(F.lit("Scoped by "), of, F.lit(" — see details")))


def _summed(claims: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Displays in order, and what the scopes of a group have in common; claims: ``place``, ``display``, the scope arrays."""
    key = F.to_json(F.struct(*(F.array_sort(c).alias(c) for c in SCOPE)))
    return claims.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_distinct(_ordered("place", "claim_id", value=F.col("display"))).alias("displays"), F.bool_or(_nonempty("scope_variants")).alias("by_variant"),
        F.bool_or(_nonempty("scope_stages") | _nonempty("scope_pathways")).alias("by_process"), F.count_distinct(key).alias("n_scopes"), *more,
    ).withColumn("universal", ~F.col("by_variant") & ~F.col("by_process"))


def cycle_dates(refs: DataFrame, timings: DataFrame) -> DataFrame:
    """PRJ-06: ``(slug, field_id, display, iso_date, note, rule)`` from the cycle's references ``(slug, closes, coverage_start, opens, coverage_end)`` to timing claims.

    Where no start of participation is referenced, the opening stands in, with a note; only stated days are normalised.
    """
    one = lambda field, claim, rule: F.struct(F.lit(field).alias("field_id"), claim.alias("claim_id"), rule.alias("rule"))
    began = F.col("coverage_start").isNotNull()
    wanted = F.array(one("application_deadline", F.col("closes"), F.lit("cycle.closes")), one("start_date", F.coalesce("coverage_start", "opens"), F.when(began, "cycle.coverage-start").otherwise("cycle.opens")), one("end_date", F.col("coverage_end"), F.lit("cycle.coverage-end")))
    asked = refs.select("slug", F.explode(wanted).alias("w")).select("slug", "w.*")
    stated = F.when((F.col("precision") == "date") & (F.col("certainty") == "stated"), F.col("iso_date"))
    note = F.when(F.col("rule") == "cycle.opens", "The cycle opening is used because no separate participation start was identified.")
    return asked.join(timings, ["slug", "claim_id"]).select("slug", "field_id", "display", stated.alias("iso_date"), note.alias("note"), "rule")


def stage_dates(timings: DataFrame) -> DataFrame:
    """PRJ-07: one row for each card and event that fills a field; ``timings``: ``(slug, claim_id, place, stage_id, stage_kind, event, precision, certainty, display, iso_date, scopes)``.

    Deadlines count in application stages only, and are not narrowed by the ids of these.
    """
    applications = timings.filter("stage_kind = 'application'").groupBy("slug").agg(F.collect_set("stage_id").alias("applying"))
    fields = F.create_map(*(F.lit(x) for pair in EVENT_FIELDS.items() for x in pair))
    rows = timings.withColumn("field_id", F.try_element_at(fields, F.col("event"))).filter("field_id IS NOT NULL AND (event <> 'deadline' OR stage_kind = 'application')")
    rows = rows.join(applications, "slug", "left").withColumn("scope_stages", F.when(F.col("event") == "deadline", F.array_except("scope_stages", F.coalesce("applying", F.array().cast("array<string>")))).otherwise(F.col("scope_stages")))
    days = F.collect_list(F.when((F.col("precision") == "date") & (F.col("certainty") == "stated"), F.col("iso_date"))).alias("days")
    g = _summed(rows, ["slug", "event", "field_id"], days)
    single = (F.size("displays") == 1) & F.col("universal")
    several = (F.col("event") == "deadline") & (F.size("displays") > 1) & (F.col("n_scopes") == 1)
    display = F.when(single, F.col("displays")[0]).when(several, "Multiple application deadlines — see schedule").otherwise(variation_label(F.col("by_variant"), F.col("by_process"), F.size("displays") > 1))
    return g.select("slug", "field_id", display.alias("display"), F.when(single & (F.size("days") == 1), F.col("days")[0]).alias("iso_date"), F.when(~single, F.array_join("displays", "; ")).alias("note"), F.concat(F.lit("stages."), F.col("event")).alias("rule"))


def dates(refs: DataFrame, timings: DataFrame) -> DataFrame:
    """PRJ-06 and PRJ-07: the cycle's own references first, then events in order; the first writer of a field wins."""
    order = F.array_position(F.array(*(F.lit(f"stages.{e}") for e in EVENT_FIELDS)), F.col("rule"))  # 0 for the cycle's
    place = F.row_number().over(Window.partitionBy("slug", "field_id").orderBy(order))
    return cycle_dates(refs, timings).unionByName(stage_dates(timings)).withColumn("writer", place).filter("writer = 1").drop("writer")


def stage_fields(claims: DataFrame) -> DataFrame:
    """PRJ-08..12: ``(slug, field_id, display, note, normalized)``; ``claims``: ``(slug, claim_id, place, kind, display, label, period, minimum, maximum, unit, formats, scopes)``.

    Commitments of a week fill weekly_hours, those labelled live required_live_hours, whatever their period.
    """
    field = lambda name, fits: F.when(fits, F.lit(name))
    kind = F.col("kind")
    fields = F.array_compact(F.array(field("duration", kind == "duration"), field("weekly_hours", (kind == "commitment") & (F.col("period") == "week")), field("required_live_hours", (kind == "commitment") & F.contains(F.lower("label"), F.lit("live"))), field("participation_format", kind == "format"), field("location", kind == "location")))
    number = lambda c: F.col(c).cast("string")
    own = F.when(kind == "duration", F.concat(number("minimum"), F.lit(" "), "unit")).when(kind == "commitment", F.concat(number("minimum"), F.coalesce(F.concat(F.lit("-"), number("maximum")), F.lit("")), F.lit(" a "), "period"))
    rows = claims.withColumn("own", own).withColumn("field_id", F.explode(fields))
    g = _summed(rows, ["slug", "field_id"], F.min("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("formats"))).alias("all_formats"))
    single = (F.size("displays") == 1) & F.col("universal")
    normalized = F.when(F.col("field_id") == "participation_format", F.when((F.size("all_formats") == 1) & F.col("universal"), F.col("all_formats")[0])).otherwise(F.when((F.col("n") == 1) & F.col("universal"), F.col("own")))
    display = F.when(single, F.col("displays")[0]).otherwise(variation_label(F.col("by_variant"), F.col("by_process"), F.size("displays") > 1))
    return g.select("slug", "field_id", display.alias("display"), F.when(~single, F.array_join("displays", "; ")).alias("note"), F.when(single, normalized).alias("normalized"))


def selection_process(stages: DataFrame, steps: DataFrame) -> DataFrame:
    """PRJ-13: ``(slug, display, note)``; ``stages``: ``(slug, stage_id, stage_order, kind, label, has_rules)``, ``steps``: ``(slug, pathway_id, pathway_order, pathway_label, step_order, stage_id)``.

    A card with pathways shows their selecting steps, in their order; any other its selecting stages.
    """
    selects = stages.filter(F.col("kind").isin(SELECTION_KINDS) | F.col("has_rules") | F.col("label").rlike(SELECTION_WORDS))
    plain = selects.groupBy("slug").agg(F.array_join(_ordered("stage_order", "stage_id", value=F.col("label")), " → ").alias("display"))
    routes = steps.groupBy("slug").agg(F.count_distinct("pathway_id").alias("n_routes"))
    route = steps.join(selects.select("slug", "stage_id", "label"), ["slug", "stage_id"]).groupBy("slug", "pathway_id", "pathway_order", "pathway_label").agg(F.array_join(_ordered("step_order", value=F.col("label")), " → ").alias("labels"))
    along = route.groupBy("slug").agg(F.array_join(_ordered("pathway_order", "pathway_id", value=F.concat("pathway_label", F.lit(": "), "labels")), "; ").alias("display"))
    note = F.when(F.col("n_routes") > 1, "The v2 pathway ledger preserves the branches rather than selecting one route.").otherwise("The v2 pathway ledger defines the authoritative route; unrelated stages are not inserted into it.")
    return plain.join(routes, "slug", "left_anti").withColumn("note", F.lit(None).cast("string")).unionByName(along.join(routes, "slug").select("slug", "display", note.alias("note")))


def rebuilt_conflicts(conflicts: DataFrame, facts: DataFrame, projected: DataFrame) -> DataFrame:
    """PRJ-18: ``(slug, field_id, summary)``: conflicts of fields that had no projection, then projected conflicts; ``facts``: ``(slug, field_id, had_projection)``."""
    kept = conflicts.join(facts.filter("had_projection").select("slug", "field_id"), ["slug", "field_id"], "left_anti").select("slug", "field_id", "summary")
    words = F.coalesce("note", F.concat(F.lit("Reviewed structured claims conflict for "), F.col("field_id").cast("string"), F.lit(".")))
    return kept.unionByName(projected.filter("status = 'conflicting'").select("slug", "field_id", F.substring(words, 1, 500).alias("summary")))
