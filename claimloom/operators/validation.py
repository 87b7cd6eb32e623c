"""Card validation as a frame of violations: one rule, one query; a card is valid where none names it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each rule on a fact says.
FACT_RULES = {
    "disclosed_value": "A disclosed fact requires both value and displayValue.",
    "disclosed_sources": "A disclosed fact requires at least one evidence source.",
    "disclosed_kind": "A disclosed fact requires a claim kind.",
    "conflict_values": "A conflict must preserve at least two supported values.",
    "conflict_top": "A conflicting fact cannot silently select one top-level value or claim kind.",
    "conflict_distinct": "Conflicting values must be distinct.",
    "conflict_only": "Only a conflicting fact may contain conflictingValues.",
    "absent_value": "facts cannot carry a displayed value or evidence.",
    "na_reason": "A not-applicable fact requires an affirmative reason.",
    "unclear_value": "An unclear fact cannot present an unresolved statement as a value or calculation.",
    "calculated_inputs": "A calculated fact requires its formula, inputs, and explanation.",
    "calculation_kind": "Calculation metadata is only valid for a calculated claim.",
}


def fact_violations(facts: DataFrame) -> DataFrame:
    """PIPE-15, SET-07: ``(slug, path, message)`` of every broken rule of every fact; one scan.

    ``facts``: ``(slug, field_id, status, value, display, normalized, n_sources, claim_kind, calculated, note, candidates array<string>)``.
    """
    c = F.col
    is_ = lambda *s: c("status").isin(*s)
    any_value = c("value").isNotNull() | c("display").isNotNull() | c("normalized").isNotNull() | c("calculated")
    n = F.size("candidates")
    broken: dict[str, Column] = {
        "disclosed_value": is_("disclosed") & (c("value").isNull() | c("display").isNull()),
        "disclosed_sources": is_("disclosed") & (c("n_sources") == 0),
        "disclosed_kind": is_("disclosed") & c("claim_kind").isNull(),
        "conflict_values": is_("conflicting") & (n < 2),
        "conflict_top": is_("conflicting") & (any_value | c("claim_kind").isNotNull()),
        "conflict_distinct": is_("conflicting") & (F.size(F.array_distinct("candidates")) < n),
        "conflict_only": ~is_("conflicting") & (n > 0),
        "absent_value": is_("not_found", "not_applicable") & (any_value | (c("n_sources") > 0) | c("claim_kind").isNotNull()),
        "na_reason": is_("not_applicable") & c("note").isNull(),
        "unclear_value": is_("unclear") & any_value,
        "calculated_inputs": F.coalesce(c("claim_kind") == "calculated", F.lit(False)) & ~c("calculated"),
        "calculation_kind": c("calculated") & F.coalesce(c("claim_kind") != "calculated", F.lit(True)),
    }
    words = lambda name: F.concat("status", F.lit(" "), F.lit(FACT_RULES[name])) if name == "absent_value" else F.lit(FACT_RULES[name])
    found = F.array_compact(F.array(*(F.when(cond, words(name)) for name, cond in broken.items())))
    return facts.select("slug", F.concat(F.lit("facts."), F.col("field_id").cast("string")).alias("path"), F.explode(found).alias("message"))


def _broken(rows: DataFrame, path: str, message: str | Column) -> DataFrame:
    return rows.select("slug", F.lit(path).alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def duplicates(rows: DataFrame, key: str, path: str, message: str) -> DataFrame:
    """SET-06: one violation for each card in which a key stands twice."""
    return _broken(rows.filter(F.col(key).isNotNull()).groupBy("slug", key).count().filter("count > 1").select("slug").distinct(), path, message)


def unknown(rows: DataFrame, key: str, known: DataFrame, known_key: str, path: str, what: str) -> DataFrame:
    """JN-02, JN-05: references of a card that no row of the same card has."""
    there = known.select("slug", F.col(known_key).alias(key)).distinct()
    return _broken(rows.filter(F.col(key).isNotNull()).join(there, ["slug", key], "left_anti"), path, F.concat(F.lit(what + " "), F.col(key).cast("string"), F.lit(".")))


def unknown_scopes(rows: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """JN-03: ids of scopes that are unknown or stand twice; ``records``: scope column to ``(slug, id)``."""
    parts = []
    for column, known in records.items():
        each = rows.select("slug", F.explode(column).alias("id"))
        parts.append(unknown(each, "id", known, "id", column, "Scope references unknown record"))
        parts.append(_broken(rows.filter(F.size(F.array_distinct(column)) < F.size(column)), column, "Scope IDs must be unique."))
    return reduce(DataFrame.unionByName, parts)


def unmatched_timing(refs: DataFrame, timings: DataFrame) -> DataFrame:
    """JN-04: ``(slug, path, message)`` of cycle references ``(slug, role, claim_id, event)`` that name no timing of the card with the event they stand for."""
    found = refs.join(timings.select("slug", "claim_id", F.col("event").alias("found")), ["slug", "claim_id"], "left")
    return found.filter(~F.coalesce(F.col("found") == F.col("event"), F.lit(False))).select("slug", F.concat(F.lit("cycle.timingRefs."), "role").alias("path"), F.concat(F.lit("Cycle timing must reference a disclosed "), "event", F.lit(" claim.")).alias("message"))


def tally(violations: DataFrame) -> DataFrame:
    """AGG-23: how often each message stands at each path, whatever the card."""
    return violations.groupBy("path", "message").agg(F.count("*").alias("n"), F.count_distinct("slug").alias("n_cards"))
