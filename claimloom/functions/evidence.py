"""Markers and values that evidence texts state, as Column functions; all regular expressions run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: Words by which a passage belongs to a core area, in the areas' order.
TOPICS = {
    "identity": r"\b(name|about|opportunity|program|challenge|competition|scholarship|internship|fellowship)\b",
    "eligibility": r"\b(eligib(?:le|ility)?|who can apply|grades?|ages?|high school|secondary school|undergraduate|college students?|citizenship|citizens?|residen(?:t|cy)|international students?|team|teacher|adviser|sponsor)\b",
    "deadline": r"\b(apply|application|deadline|due|closes?|rolling admissions?|decision|notification)\b",
    "schedule": r"\b(start(?:s|ing)?|end(?:s|ing)?|dates?|schedule|duration|weeks?|months?|hours?|cycle|cohort|fall|winter|spring|summer|20\d{2})\b",
    "format_location": r"\b(online|virtual|remote|hybrid|residential|in[ -]person|location|campus|worldwide|anywhere in the world)\b",
    "cost": r"(?:\$|€|£)\s?\d|\b(?:USD|EUR|GBP|tuition|costs?|fees?|deposit|free|no charge|refund(?:s|able|ability)?)\b",
    "financial_aid": r"\b(financial aid|need[ -]based|merit|scholarships?|fee waiver|tuition assistance)\b",
    "operator": r"\b(operat(?:e|es|ed|ing|or|ors|ion)?|administ(?:er|ers|ered|ering|rator|ration)?|run by|managed by|organized by|provided by)\b",
    "institution_relationship": r"\b(partner(?:s|ed|ship|ships)?|sponsor(?:s|ed|ship)?|host(?:s|ed)?|institution(?:s|al)?|universit(?:y|ies)|colleges?|affiliat(?:e|ed|ion)|endorse(?:d|ment))\b",
    "selection": r"\b(selection|selective|interviews?|review(?:s|ed)?|semifinalists?|finalists?|advanc(?:e|es|ed|ement)|ranking|limited seats?|accepted|admission)\b",
    "outcomes": r"\b(winners?|prizes?|awards?|stipends?|fund(?:s|ed|ing)?|benefits?|mentors?|mentorship|certificate|credit|demo day|launch|project)\b",
}

#: What evidence for an enumerated value says, by group and value.
ENUMS = {
    "status": {
        "announced": r"\b(announc(?:e|ed|ement)|coming|will (?:open|launch|begin))\b",
        "applications_open": r"\b(applications? (?:are )?(?:(?:now|currently) )?open|apply now|accepting applications?)\b",
        "applications_closed": r"\b(applications? (?:are )?closed|submissions? (?:are )?closed|deadline (?:has )?passed)\b",
        "active": r"\b(active|in progress|underway)\b",
        "complete": r"\b(complete|completed|concluded|ended)\b",
    },
    "formats": {
        "online": r"\b(online|virtual|remote|pre-recorded)\b",
        "in_person": r"\b(in[- ]person|onsite|on[- ]site|live event|live pitch)\b",
        "hybrid": r"\bhybrid\b",
        "residential": r"\b(residential|housing|live on campus)\b",
        "commuter": r"\b(commuter|nonresidential|day program)\b",
    },
    "recipientScope": {
        "individual": r"\b(individual|participant|student|applicant|winner)s?\b",
        "team": r"\bteams?\b",
        "project": r"\b(project|experiment|venture)s?\b",
        "school": r"\bschools?\b",
        "organization": r"\b(organization|company|nonprofit|venture)s?\b",
        "educator": r"\b(teachers?|educators?|advisers?|advisors?)\b",
    },
    "monetaryNature": {
        "cash": r"\b(cash|prize money|cash award|stipend)\b",
        "restricted_funding": r"\b(project|experiment|build)\b.{0,80}\b(fund|funding|budget|grant)\b|\b(fund|funding|budget|grant)\b.{0,80}\b(project|experiment|build)\b",
        "reimbursement": r"\breimburs(?:e|ed|ement)\b",
        "source_stated_estimated_value": r"\b(estimated value|valued at|worth)\b",
        "not_monetized": r"\b(no (?:cash|monetary) value|not monetized|noncash|non-cash|in-kind)\b",
    },
}

#: Names of places and their markers; capitalised words that name no place.
PLACES = {
    "geo-us": r"\b(?:u\.?s\.?a?|united states|american)\b",
    "geo-canada": r"\bcanad(?:a|ian)\b",
    "geo-mexico": r"\bmexic(?:o|an)\b",
    "geo-uk": r"\b(?:u\.?k\.?|united kingdom|british)\b",
    "geo-australia": r"\baustrali(?:a|an)\b",
    "geo-india": r"\bindia(?:n)?\b",
    "geo-china": r"\bchin(?:a|ese)\b",
    "geo-global": r"\b(?:all countries|worldwide|globally?|international(?:ly)?|anywhere (?:in|around) the world)\b",
}
NO_PLACES = ["All", "Applicants", "Applications", "Citizens", "Eligible", "Eligibility", "International", "America", "Kingdom", "Not", "Permanent", "Residents", "Students", "States", "Teams", "The", "United"]
#: Citizenship wording and its markers; named school years.
CITIZENSHIP = {"citizen": r"\bcitizens?(?:hip)?\b", "permanent-resident": r"\bpermanent residents?|green cards?\b", "visa": r"\bvisas?\b", "citizenship-not-required": r"\b(?:no citizenship requirement|citizenship (?:is )?not required)\b"}
YEARS_AT_SCHOOL = {9: r"\b(?:9th grade|freshm(?:an|en))\b", 10: r"\b(?:10th grade|sophomores?)\b", 11: r"\b(?:11th grade|juniors?)\b", 12: r"\b(?:12th grade|seniors?)\b"}

#: Amounts with a currency, and wording that costs nothing.
MONEY = r"(?i)(?:\b(?:USD|CAD|AUD|EUR|GBP)\s*[$€£]?\s*\d[\d,]*(?:\.\d{1,2})?|[$€£]\s*\d[\d,]*(?:\.\d{1,2})?(?:\s*(?:USD|CAD|AUD|EUR|GBP))?|\b\d[\d,]*(?:\.\d{1,2})?\s*(?:USD|CAD|AUD|EUR|GBP)\b)"
FREE = r"(?i)\b(?:free(?: of charge)?|no (?:application )?(?:fee|cost|payment|purchase)|without (?:a )?(?:fee|charge)|at no cost)\b"
DATES = rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|(?:{T.MONTHS})\s+\d{{1,2}},\s*\d{{4}})\b"

#: Words that name no entity; wording of earlier cycles.
ENTITY_STOPS = ["and", "company", "corporation", "foundation", "inc", "incorporated", "llc", "ltd", "of", "organization", "the", "university"]
EARLIER = r"(?i)\b(last year|previous year|prior year|historical|earlier cohort|past cohort)\b"
#: Tokens of an explanation that its basis must hold; capitalised words that need none.
CONCRETE = r"(?i)(?:[$€£]\s*\d[\d,.]*|\b\d+(?:\.\d+)?%|\b20\d{2}\b|https?://\S+)"
PROPER = r"\b(?:[A-Z][a-z]{2,}|[A-Z]{2,})\b"
COMMON_CAPITALS = ["A", "An", "Application", "Award", "Check", "Cost", "Deadline", "Financial", "Institution", "Numerical", "Official", "Opportunity", "Program", "Refund", "Selection", "Source", "The", "This", "Total", "Verify"]


def named(x: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that the text matches, in the patterns' order."""
    return F.array_compact(F.array(*(F.when(x.rlike(f"(?i){p}"), F.lit(name)) for name, p in patterns.items())))


def all_of(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def topics(x: Column) -> Column:
    """FLT-16."""
    return named(x, TOPICS)


def enum_evidence(x: Column) -> Column:
    """FN-27: ``group:value`` for every enumerated value that the text gives evidence for."""
    return named(x, {f"{group}:{value}": p for group, values in ENUMS.items() for value, p in values.items()})


def money_mentions(x: Column) -> Column:
    """FN-22: every amount with a currency, as (amount, currency)."""
    found = F.transform(all_of(T.normalize_whitespace(x), MONEY), lambda c: F.struct(*(v.alias(n) for v, n in zip(T.parse_money(F.upper(c)), ("amount", "currency"), strict=True))))
    return F.filter(found, lambda m: m["amount"].isNotNull())


def money_appears(x: Column, amount: Column, currency: Column) -> Column:
    """FN-22: the text states the exact amount; nothing to pay may be put in words."""
    return ((amount == 0) & x.rlike(FREE)) | F.exists(money_mentions(x), lambda m: (m["amount"] == amount) & (m["currency"] == currency))


def date_mentions(x: Column) -> Column:
    """FN-23: every day that the text names in full, as yyyy-MM-dd."""
    return F.array_compact(F.transform(all_of(T.normalize_whitespace(x), DATES), T.parse_date))


def grade_markers(x: Column) -> Column:
    """FN-30: school years, with the schools they belong to; sorted."""
    n = F.lower(T.normalize_whitespace(x))
    nothing = F.array().cast("array<string>")
    span = lambda lo, hi: F.sequence(lo, F.greatest(lo, hi))
    marks = lambda g: F.array(F.concat(F.lit("grade-"), g.cast("string")), F.when(g.between(9, 12), "high-school").when(g.between(5, 8), "middle-school"))
    years = F.array_compact(F.array(*(F.when(n.rlike(p), F.lit(g)) for g, p in YEARS_AT_SCHOOL.items())))
    graders = F.transform(all_of(n, r"\b(\d{1,2})(?:st|nd|rd|th)?\s*-?\s*graders?\b", 1), lambda g: g.cast("int"))
    rule = r"\bgrades?\s*(\d{1,2})(?:\s*(?:-|through|to)\s*(\d{1,2}))?\b"
    pairs = F.zip_with(all_of(n, rule, 1), all_of(n, rule, 2), lambda a, b: F.struct(a.cast("int").alias("a"), F.when(b == "", a).otherwise(b).cast("int").alias("b")))
    ranges = F.flatten(F.transform(F.filter(pairs, lambda p: (p["b"] >= p["a"]) & (p["b"] - p["a"] <= 12)), lambda p: span(p["a"], p["b"])))
    found = F.flatten(F.transform(F.concat(years, graders, ranges), marks))
    schools = named(n, {"middle-school": r"\bmiddle school\b", "high-school": r"\bhigh school\b", "college": r"\b(?:college|university|undergraduate) students?\b"})
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(found, schools, nothing))))


def once_a_text(rows: DataFrame, text: str, of: Callable[[Column], Column], name: str) -> DataFrame:
    """The rows with a costly reading of a text column, which each distinct text gets once; null texts get null."""
    read = rows.select(text).filter(F.col(text).isNotNull()).distinct().select(text, of(F.col(text)).alias(name))
    return rows.join(read, text, "left")


def place_markers(x: Column) -> Column:
    """FN-30: places by their known names, and other capitalised words of four letters or more; sorted."""
    known = "(?i)" + "|".join(PLACES.values())
    proper = F.filter(all_of(x, r"\b[A-Z][A-Za-z]{3,}\b"), lambda w: ~w.isin(NO_PLACES) & ~w.rlike(known))
    return F.array_sort(F.array_distinct(F.concat(named(x, PLACES), F.transform(proper, lambda w: F.concat(F.lit("proper-"), F.lower(w))))))


def citizenship_markers(x: Column) -> Column:
    """FN-30: places, and what the text says of citizenship; sorted."""
    return F.array_sort(F.array_union(place_markers(x), named(T.normalize_whitespace(x), CITIZENSHIP)))


def supported(proposed: Column, evidence: Column) -> Column:
    """SET-04: every proposed marker is among the evidence's."""
    return F.size(F.array_except(proposed, evidence)) == 0


def entity_tokens(x: Column) -> Column:
    """FN-20, of text without accents."""
    plain = F.trim(F.regexp_replace(F.lower(T.normalize_whitespace(x)), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), lambda w: (F.length(w) >= 2) & ~w.isin(ENTITY_STOPS))


def entity_appears(name: Column, evidence: Column) -> Column:
    """FN-20: three quarters of a name's words, one at least, stand in the evidence."""
    own, other = entity_tokens(name), entity_tokens(evidence)
    return (F.size(own) > 0) & (F.size(F.filter(own, lambda w: F.array_contains(other, w))) >= F.greatest(F.lit(1), F.ceil(F.size(own) * 0.75)))


def matches_cycle(excerpt: Column, years: Column) -> Column:
    """FLT-19: no wording of earlier cycles, and no year outside the cycle's."""
    return ~excerpt.rlike(EARLIER) & F.forall(all_of(excerpt, r"\b(20\d{2})\b", 1), lambda y: F.array_contains(years, y.cast("int")))


def unsupported_tokens(explanation: Column, basis: Column) -> Column:
    """FN-35: amounts, shares, years and links of an explanation that its basis doesn't hold."""
    plain = F.replace(F.lower(basis), F.lit(","), F.lit(""))
    return F.filter(all_of(explanation, CONCRETE), lambda t: ~F.contains(plain, F.replace(F.lower(t), F.lit(","), F.lit(""))))


def unsupported_names(text: Column, basis: Column) -> Column:
    """FN-35: proper nouns of a text that its basis doesn't hold."""
    return F.filter(all_of(text, PROPER), lambda t: ~t.isin(COMMON_CAPITALS) & ~F.contains(F.lower(basis), F.lower(t)))
