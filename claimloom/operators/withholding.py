"""PIPE-04, PIPE-05: facts withheld where their evidence speaks of something else, as one ordered fold over a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import text as T
from claimloom.sources.scratch import read_once

#: Fields that speak of one cycle, and those that speak of an organization whatever the page.
CYCLE_FIELDS = ["application_deadline", "decision_date", "start_date", "end_date", "applicant_count", "acceptance_count", "acceptance_rate_claim"]
ORGANIZATION_FIELDS = ["operating_organization", "organization_type"]
#: Patterns of lower-cased evidence.
OPERATES = r"\b(operat(?:e|es|ed|or)|run by|organize(?:s|d)?|provided by|offered by|program of|owned by)\b"
PERSONS = r"\b(founders?|mentors?|staff|employees?|students?|alumn(?:us|a|i|ae)|graduates?|attended|studied at)\b"
PROGRAM_TIE = r"\b(program|opportunity|fellowship|challenge|competition|organization|company)\b.{0,140}\b(partner(?:s|ed|ship)?|sponsor(?:s|ed|ship)?|host(?:s|ed)?|operat(?:e|es|ed|or)|administ(?:er|ers|ered|rator)|collaborat(?:e|es|ed|ion)|owned by|program of)\b|\b(partner(?:s|ed|ship)?|sponsor(?:s|ed|ship)?|host(?:s|ed)?|operat(?:e|es|ed|or)|administ(?:er|ers|ered|rator)|owned by)\b.{0,140}\b(program|opportunity|fellowship|challenge|competition|organization|company)\b"
OFFICE = r"\b(office|headquarters|program at|agency(?:['’]s)? .{0,50}(?:center|facility))\b"
TAKES_PART = r"\b(participat|attend|event (?:is|was|will be) held|takes place|virtual|online)\b"
ORGANIZER_CANCELS = r"\b(sponsor|organizer|administrator)\b.{0,100}\b(cancel|amend|suspend|modify)\b"
PARTICIPANT_CANCELS = r"\b(participant|applicant|student|team|withdraw|refund)\b"
REMOVAL = r"\b(?:remove|expel|suspend|terminate)\b.{0,120}\b(?:participant|student|fellow|entrant)\b|\b(?:participant|student|fellow|entrant)\b.{0,120}\b(?:remove|expel|suspend|terminate)\b"
REFUND = r"\b(?:refund requests?|request(?:ed|ing)? (?:a )?refund|withdraw(?:al)?|participant cancellation|student cancellation|cancel(?:s|led)? (?:their|the) enrollment)\b"
SHARED_WITH = ["service provider", "judge", "consultant"]
VOLUNTEERS = r"\bvolunteer\b.{0,100}\b(judg|mentor)"
MENTORED = r"\b(participant|student|team).{0,100}\b(receive|matched|mentor|support|access)\b"
BROAD_AUDIENCE = r"\b(programs|education)\b.{0,160}\bmiddle school\b"
ELIGIBLE = r"\beligib(?:le|ility)|applicants? must|students? in grades?\b"
PRIZE_MATRIX = r"\btop (?:two|three|four|five|six|\d+)\b|\bboth\b.{0,80}\btracks?\b|\b(?:multiple|several)\b.{0,40}\b(?:awards?|prizes?)\b"
FEE_ALTERNATIVE = r"\b(?:or|depending on|var(?:y|ies) by|different(?: fee)? for)\b"
FEE_PLAN = r"\b(?:early action|regular decision|application (?:plan|round|pathway)|tier|track|program|cohort|session)\b"
SEVERAL_FEES = "Multiple application fees — see cost details"


#: The patterns that all of a fact's excerpts are read for, by what a reading calls them.
_SAYS = {"operates": OPERATES, "persons": PERSONS, "office": OFFICE, "takes_part": TAKES_PART, "organizer_cancels": ORGANIZER_CANCELS, "participant_cancels": PARTICIPANT_CANCELS, "removal": REMOVAL, "refund": REFUND, "volunteers": VOLUNTEERS, "mentored": MENTORED, "broad_audience": BROAD_AUDIENCE, "eligible": ELIGIBLE, "prize_matrix": PRIZE_MATRIX}


def reading(excerpts: Column, years: Column) -> Column:
    """What a fact's excerpts say, whatever fact it is: one flag each."""
    said = F.lower(F.array_join(excerpts, " "))
    off_year = F.exists(excerpts, lambda x: ~E.matches_cycle(x, years))
    tied = F.exists(excerpts, lambda x: F.lower(x).rlike(PROGRAM_TIE))
    shares = [F.contains(said, F.lit(category)).alias(category) for category in SHARED_WITH]
    return F.struct(*(said.rlike(pattern).alias(name) for name, pattern in _SAYS.items()), off_year.alias("off_year"), tied.alias("tied"), *shares)


def rules() -> list[tuple[str, list[str], list[str], bool, Column, Column]]:
    """(name, fields, what else goes with them, only if disclosed, condition, note), in the order in which they apply.

    Conditions are on a fact's own columns, its card's and the ``reading`` of its excerpts; whether a fact is still there is for the fold to say.
    """
    c = F.col
    names = {pattern: name for name, pattern in _SAYS.items()}
    one = lambda pattern: c("read")[names[pattern]]
    off_year, tied = c("read")["off_year"], c("read")["tied"]
    elsewhere = F.exists("evidence", lambda s: ~F.coalesce(s["fits"], F.lit(False))) & ~c("field_id").isin(ORGANIZATION_FIELDS)
    shown = F.lower(F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("display", F.lit(""))))
    unshared = F.lit(False)
    for category in SHARED_WITH:
        unshared = unshared | (F.contains(shown, F.lit(category)) & ~c("read")[category])
    note = F.lit
    return [
        ("typed_value", [], [], False, c("failure").isNotNull(), F.concat(F.lit("The displayed typed value was withheld because "), c("failure"), F.lit("."))),
        ("subject_scope", [], [], False, c("scope").isNotNull(), c("scope")),
        ("other_opportunity", [], [], False, elsewhere, note("The cited page describes a different opportunity on the same organization site, so it cannot support this target-specific fact.")),
        ("other_year", CYCLE_FIELDS, [], False, c("cycle_label").isNotNull() & off_year, F.concat(F.lit("The attached evidence names a year outside the resolved "), c("cycle_label"), F.lit(" target cycle."))),
        ("operator", ["operating_organization"], [], True, ~one(OPERATES), note("The excerpt names an organization or opportunity but does not explicitly support the primary operator role.")),
        ("affiliation", ["institution_relationship"], ["relationship_explanation"], True, one(PERSONS) & ~tied, note("The excerpt supports a person's institutional affiliation, not a relationship between the institution and the opportunity.")),
        ("office", ["location"], [], True, one(OFFICE) & ~one(TAKES_PART), note("The excerpt identifies an organizer or program location, not where participants take part.")),
        ("organizer_cancels", ["cancellation_policy"], [], True, one(ORGANIZER_CANCELS) & ~one(PARTICIPANT_CANCELS), note("The excerpt describes organizer modification or cancellation rights, not a participant cancellation policy.")),
        ("removal", ["cancellation_policy"], [], True, one(REMOVAL) & ~one(REFUND), note("The excerpt describes organizer-initiated disciplinary removal, not the participant's cancellation, withdrawal, or refund rights.")),
        ("sharing", ["data_sharing"], [], True, unshared, note("The displayed sharing categories exceeded the categories named in the attached excerpts.")),
        ("volunteers", ["mentorship"], [], True, one(VOLUNTEERS) & ~one(MENTORED), note("The excerpt describes a volunteer role, not a mentorship benefit received by participants.")),
        ("broad_audience", ["grade_levels"], [], True, one(BROAD_AUDIENCE) & ~one(ELIGIBLE), note("The excerpt describes an organization's broader audience, not eligibility for one identified program and cycle.")),
        ("no_cycle", CYCLE_FIELDS, [], False, ~c("cycle_modeled"), note("The supplied pages did not establish one target cycle, so automated extraction withheld cycle-specific dates and selection statistics.")),
        ("no_variant", ["duration"], [], False, c("extended") & ~c("variants_modeled"), note("The supplied pages did not establish one applicable variant or cohort, so automated extraction withheld a universal duration.")),
        ("no_inventory", ["estimated_total_mandatory_cost"], [], True, ~c("costs_complete"), note("Automated extraction did not establish a complete structured inventory of mandatory costs, so it cannot present one total.")),
        ("prize_matrix", ["cash_award"], [], True, one(PRIZE_MATRIX) & (c("cash_outcomes") < 2), note("The excerpts describe a prize matrix that the automated structured outcomes did not represent completely.")),
    ]


def withhold(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """PIPE-04: ``(slug, field_id, status, note, rule)`` of all facts; ``rule`` is the one that withheld a fact, null for the others.

    ``facts (slug, field_id, status, value, display, failure, scope, note, evidence array<struct<excerpt, fits>>)``;
    ``cards (slug, cycle_label, years, cycle_modeled, extended, variants_modeled, costs_complete, cash_outcomes)``.
    A rule applies to facts that are disclosed, most also to conflicting ones, at its turn; what is withheld
    becomes unclear, or not found where there is no evidence. So of two rules on a fact the earlier one
    counts, and a relationship that is withheld earlier takes no explanation with it. Excerpts that many facts
    repeat are read once; only hits travel with a card's facts, and one fold in rule order settles a card.
    """
    rows = facts.join(cards, "slug").withColumn("excerpts", F.transform("evidence", lambda s: s["excerpt"]))
    rows = read_once(rows, ["excerpts", "years"], read=reading(F.col("excerpts"), F.col("years")))
    hits = []
    for number, (name, fields, more, disclosed, condition, note) in enumerate(rules()):
        here = F.coalesce(condition, F.lit(False)) & (F.col("field_id").isin(fields) if fields else F.lit(True))
        hits.append(F.when(here, F.struct(F.lit(number).alias("number"), F.col("field_id").alias("field"), F.lit(name).alias("rule"), F.lit(disclosed).alias("disclosed"), F.array(F.col("field_id"), *map(F.lit, more)).alias("targets"), note.alias("note"))))
    fact = F.struct("status", "note", F.lit(None).cast("string").alias("rule"), (F.size("evidence") > 0).alias("cited"))
    per_card = rows.select("slug", "field_id", fact.alias("fact"), F.filter(F.array(*hits), lambda h: h.isNotNull()).alias("hits"))
    per_card = per_card.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "fact"))).alias("facts"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))

    def step(state: Column, hit: Column) -> Column:
        status = F.element_at(state, hit["field"])["status"]
        on = (status == "disclosed") | (~hit["disclosed"] & (status == "conflicting"))

        def settle(field: Column, own: Column) -> Column:
            goes = F.array_contains(hit["targets"], field) & own["status"].isin("disclosed", "conflicting")
            gone = F.struct(F.when(own["cited"], "unclear").otherwise("not_found").alias("status"), F.when(own["cited"], hit["note"]).alias("note"), hit["rule"].alias("rule"), own["cited"].alias("cited"))
            return F.when(on & goes, gone).otherwise(own)

        return F.transform_values(state, settle)

    settled = per_card.select("slug", F.explode(F.aggregate("hits", F.col("facts"), step)).alias("field_id", "f"))
    return settled.select("slug", "field_id", "f.status", "f.note", "f.rule")


def candidate_money(value: Column, display: Column, amount: Column, currency: Column) -> Column:
    """The money of a candidate: its normalised amount and currency, else its plain number in the one currency its wording names."""
    plain = F.when(value.rlike(r"^\d[\d,]*(?:\.\d{1,2})?$"), F.try_to_number(F.replace(value, F.lit(","), F.lit("")), F.lit("999999999999999.99")).cast("double"))
    codes = F.array_distinct(F.regexp_extract_all(F.upper(display), F.lit(r"\b(USD|CAD|AUD|EUR|GBP)\b"), 1))
    read = F.when(plain.isNotNull() & (F.size(codes) == 1), F.struct(plain.alias("amount"), codes[0].alias("currency")))
    return F.when(amount.isNotNull(), F.struct(amount.cast("double").alias("amount"), currency.alias("currency"))).otherwise(read)


def collapsed_fees(candidates: DataFrame) -> DataFrame:
    """PIPE-05: ``(slug, display, note)`` of cards whose conflicting application fees are alternatives that one excerpt states for different plans.

    ``candidates (slug, place, value, display, amount, currency, sources array<struct<id, url, excerpt>>)``: of
    each conflicting fee. All cite the same excerpt of one source, which has a word of alternatives and one of
    plans and states every amount; amounts are in one currency and not all the same. What many cards repeat is read once.
    """
    source = F.when(F.size("sources") == 1, F.element_at("sources", 1))
    money = candidate_money(F.col("value"), F.col("display"), F.col("amount"), F.col("currency"))
    plain = F.lower(T.normalize_whitespace(source["excerpt"]))
    stated = F.coalesce(E.money_appears(source["excerpt"], money["amount"], money["currency"]), F.lit(False))
    fits = source.isNotNull() & money.isNotNull() & stated & F.coalesce(plain.rlike(FEE_ALTERNATIVE) & plain.rlike(FEE_PLAN), F.lit(False))
    cited = F.struct(source["id"].alias("id"), source["url"].alias("url"), plain.alias("plain"))
    read = {"fits": fits, "m": F.when(fits, money), "cited": F.when(fits, cited)}  # one fee that doesn't fit ends its card, so nothing else of it goes on
    rows = read_once(candidates.select("slug", "place", "value", "display", "amount", "currency", "sources"), ["value", "display", "amount", "currency", "sources"], **read)
    ends = lambda c: (F.min(c), F.max(c))  # noqa: E731  distinct counts would multiply every row before the shuffle
    (cited_0, cited_1), (code_0, code_1), (amount_0, amount_1) = map(ends, ("cited", "m.currency", "m.amount"))
    g = rows.groupBy("slug").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("fits").alias("all_fit"), cited_0.eqNullSafe(cited_1).alias("one_source"), (code_0 == code_1).alias("one_currency"),
        (amount_0 < amount_1).alias("amounts"), F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fits"), F.col("display")).alias("display")))).alias("listed"),
    )
    collapsed = (F.col("n") >= 2) & F.col("all_fit") & F.col("one_source") & F.col("one_currency") & F.col("amounts")
    note = F.concat(F.lit("The source states plan-specific alternatives: "), F.array_join(F.transform("listed", lambda c: c["display"]), "; "), F.lit("."))
    return g.filter(collapsed).select("slug", F.lit(SEVERAL_FEES).alias("display"), note.alias("note"))
