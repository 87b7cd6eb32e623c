"""Typed values against the passages they are read from: money, dates, times, quantities and enumerated values.

A value is one struct of ``VALUE``, its other fields null. Texts named ``x`` are as ``normalize_whitespace`` leaves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import markers as M
from claimloom.functions import text as T

#: ``kind`` is exact or range and marks money; ``precision`` is date, month or date_time; ``low``, ``high`` and ``unit`` are a duration's.
VALUE = "kind string, amount double, minimum double, maximum double, currency string, precision string, date string, year int, month int, date_time string, certainty string, event string, count double, ordinal double, minimum_hours double, maximum_hours double, low double, high double, unit string, enums array<string>, enter_when string"
#: What is known of a card's cycle.
CYCLE = "years array<int>, source_id long, label string"

#: Symbols that stand for a currency, and minutes from UTC of named zones.
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}
ZONES = {"PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "UTC": 0, "GMT": 0}
ZONE = r"\b(PST|PDT|MST|MDT|CST|CDT|EST|EDT|UTC|GMT)\b"
OFFSET = r"(?:\b(?:UTC|GMT)\s*)?([+-])(\d{1,2})(?::?(\d{2}))\b"
DATE_TIME = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
#: Days of a range, in two months or one.
RANGES = [rf"(?i)\b({T.MONTHS})\s+(\d{{1,2}})\s*(?:-|to|through)\s*({T.MONTHS})\s+(\d{{1,2}})\b", rf"(?i)\b({T.MONTHS})\s+(\d{{1,2}})\s*(?:-|to|through)\s*()(\d{{1,2}})\b"]
#: Wording of earlier cycles, of the earlier and the later year of a cycle, of two years in a label.
EARLIER = r"(?i)\b(last|previous|prior)\s+(?:year|cycle|cohort)|\bhistorical(?:ly)?\b"
FIRST_YEAR = r"(?i)\b(?:application|deadline|form|match|ranking|requirements?|finalist|decision|results?)\b"
SECOND_YEAR = r"(?i)\b(?:admissions?|entry|enroll(?:ment|s|ed|ing)?|attends?|attendance|participation)\b"
TWO_YEARS = r"\b20\d{2}\s*[–—-]\s*(?:20)?\d{2}\b"
#: What a passage says of an expected date, of each event, and of what is due by a day.
EXPECTED = r"(?i)\b(expect(?:ed|s)?|anticipated|planned|projected)\b"
EVENTS = {
    "opens": r"(?i)\b(open|opens|opening|window begins)\b",
    "deadline": r"(?i)\b(deadline|due|closes|closing)\b",
    "starts": r"(?i)\b(starts?|begins?|commences?)\b",
    "ends": r"(?i)\b(ends?|concludes?|finishes?)\b",
    "decision": r"(?i)\b(decision|results?|selected|finalists?)\b",
    "notification": r"(?i)\b(notif(?:y|ied|ication)|announc(?:e|ed|ement))\b",
}
DUE_BY = r"(?i)\b(?:applications?|entries|materials?|forms?|submissions?|videos?|proposals?)\b.{0,100}\b(?:must\s+be\s+)?(?:submitted|received|completed|uploaded|filed|sent)?\s*by\b|\b(?:submit|apply|complete|upload|file|send)\b.{0,100}\bby\b"
HOURS = r"(?i)\b(?:hours?|hrs?)\b"
ADVANCING = ["selection", "selection_notice", "finalist", "semifinal", "winner"]
#: The reasons, in the order they are looked for.
FAILURES = {
    "money": "its typed money value does not match the exact cited excerpt and display value",
    "date": "its typed date does not match the exact cited excerpt and display value",
    "expected": "an expected date was proposed without expected or planned wording in the cited excerpt",
    "event": "its typed date event is not stated in the cited excerpt",
    "number": "its typed numeric value does not match the exact cited excerpt",
    "number_display": "its typed numeric value does not match its display value",
    "enum": "its typed enum value is not stated by the cited excerpt",
    "enum_display": "its typed enum value does not match its display value",
    "advancement": "its proposed advancement is only a program activity, not a stated selection or progression event",
    "step": "its pathway action or entry condition is not stated by the cited excerpt",
}

_sure = lambda x: F.coalesce(x, F.lit(False))
_two = lambda n: F.lpad(n.cast("string"), 2, "0")


def number_text(n: Column) -> Column:
    """A number as it is written: no exponent, no zeros behind the last digit of a fraction."""
    return F.regexp_replace(F.regexp_replace(n.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def says_number(n: Column, x: Column) -> Column:
    """The number stands in the text, thousands' commas aside, next to no digit or dot."""
    return T.number_appears(F.replace(x, F.lit(","), F.lit("")), number_text(n))


def currency_appears(currency: Column, x: Column) -> Column:
    """FN-22: the code as a word, or its symbol."""
    symbol = F.element_at(F.create_map(*(F.lit(s) for pair in SYMBOLS.items() for s in pair)), currency)
    return F.regexp_like(F.upper(x), F.concat(F.lit(r"\b"), currency, F.lit(r"\b"))) | _sure(F.contains(x, symbol))


def money_value_appears(v: Column, text: Column, x: Column) -> Column:
    """FN-22: an exact amount, or a range: both ends with the currency, or both numbers and the currency somewhere. ``text``: not normalised."""
    mentions = E.money_mentions(x)
    states = lambda amount: F.exists(mentions, lambda m: (m["amount"] == amount) & (m["currency"] == v["currency"]))
    exact = _sure((v["amount"] == 0) & text.rlike(E.FREE)) | states(v["amount"])
    loose = currency_appears(v["currency"], x) & says_number(v["minimum"], x) & says_number(v["maximum"], x)
    return _sure(F.when(v["kind"] == "exact", exact).otherwise((states(v["minimum"]) & states(v["maximum"])) | loose))


def day_ranges(x: Column) -> Column:
    """FN-23: the first and last day, without a year, of every range: those over two months first, then those within one."""
    month = lambda name: F.array_position(F.array(*(F.lit(m.lower()) for m in T.MONTHS.split("|"))), F.lower(name)).cast("int")

    def read(rule):
        def one(m):
            part = [F.regexp_extract(m, rule, g) for g in (1, 2, 3, 4)]
            last = F.when(part[2] == "", part[0]).otherwise(part[2])
            return F.struct(month(part[0]).alias("start_month"), part[1].cast("int").alias("start_day"), month(last).alias("end_month"), part[3].cast("int").alias("end_day"))

        return F.transform(E.all_of(x, rule), one)

    return F.concat(*(read(rule) for rule in RANGES))


def month_day(date: Column) -> tuple[Column, Column]:
    """Month and day of yyyy-MM-dd, null of anything else."""
    rule = r"^\d{4}-(\d{2})-(\d{2})$"
    return tuple(F.regexp_extract(date, rule, g).try_cast("int") for g in (1, 2))


def month_name(month: Column) -> Column:
    """Null where there is no such month."""
    return F.get(F.array(*(F.lit(m) for m in T.MONTHS.split("|"))), month - 1)


def month_day_appears(date: Column, x: Column) -> Column:
    """FN-23: the day's month and number, or a range that ends on it; the year doesn't count."""
    month, day = month_day(date)
    named = F.regexp_like(x, F.concat(F.lit(r"(?i)\b"), month_name(month), F.lit(r"\s+"), day.cast("string"), F.lit(r"\b")))
    return _sure(named | F.exists(day_ranges(x), lambda r: (r["end_month"] == month) & (r["end_day"] == day)))


def parse_date_time(x: Column) -> Column:
    """FN-24: (date, hour, minute, second, offset in minutes) of an ISO date and time with its zone, else null."""
    part = [F.regexp_extract(x, DATE_TIME, g) for g in range(6)]
    of_zone = lambda at: F.substring(part[5], at, 2).try_cast("int")
    offset = F.when(part[5] == "Z", 0).otherwise(F.when(part[5].startswith("-"), -1).otherwise(1) * (of_zone(2) * 60 + of_zone(5)))
    second = F.coalesce(part[4].try_cast("int"), F.lit(0))
    return F.when(part[0] != "", F.struct(part[1].alias("date"), part[2].try_cast("int").alias("hour"), part[3].try_cast("int").alias("minute"), second.alias("second"), offset.alias("offset")))


def time_appears(at: Column, x: Column) -> Column:
    """FN-24: the time of day on a clock of 24 hours or of 12; seconds and minutes may go unsaid where they are 0."""
    twelve = F.when(at["hour"] % 12 == 0, 12).otherwise(at["hour"] % 12).cast("string")
    half = F.when(at["hour"] >= 12, "PM").otherwise("AM")
    minute, second = _two(at["minute"]), F.when(at["second"] == 0, "(?::00)?").otherwise(F.concat(F.lit(":"), _two(at["second"])))
    clock = F.concat(F.lit(r"(?i)\b"), _two(at["hour"]), F.lit(":"), minute, second, F.lit(r"\b|\b"), twelve, F.lit(":"), minute, second, F.lit(r"\s*"), half, F.lit(r"\b"))
    whole = F.when((at["minute"] == 0) & (at["second"] == 0), F.concat(F.lit(r"|\b"), twelve, F.lit(r"\s*"), half, F.lit(r"\b"))).otherwise("")
    return _sure(F.regexp_like(x, F.concat(clock, whole)))


def offset_appears(minutes: Column, x: Column) -> Column:
    """FN-24: a named zone has this offset; only where no zone is named do numeric offsets count."""
    upper = F.upper(x)
    named, offset_of = E.all_of(upper, ZONE, 1), F.create_map(*(F.lit(s) for pair in ZONES.items() for s in pair))
    sign = lambda m: F.when(F.regexp_extract(m, OFFSET, 1) == "-", -1).otherwise(1)
    numeric = F.exists(E.all_of(upper, OFFSET), lambda m: sign(m) * (F.regexp_extract(m, OFFSET, 2).cast("int") * 60 + F.regexp_extract(m, OFFSET, 3).cast("int")) == minutes)
    return _sure(F.when(F.size(named) > 0, F.exists(named, lambda z: offset_of[z] == minutes)).otherwise(numeric))


def iso_date(v: Column) -> Column:
    """The day of a value that has one."""
    return F.when(v["precision"] == "date", v["date"]).when(v["precision"] == "date_time", parse_date_time(v["date_time"])["date"])


def implicit_year(cycle: Column, sources: Column, evidence: Column, v: Column) -> Column:
    """FN-25: the year that a passage without one means: that of the cycle's own source, or of two years the one whose part of a cycle it speaks of."""
    years = F.array_sort(cycle["years"])
    blocked = F.coalesce(cycle.isNull() | (F.size(sources) == 0) | evidence.rlike(r"\b20\d{2}\b") | evidence.rlike(EARLIER), F.lit(True))
    one = (F.size(years) == 1) & F.forall(sources, lambda s: s.eqNullSafe(cycle["source_id"]))
    two = (F.size(years) == 2) & (F.get(years, F.lit(1)) == F.get(years, F.lit(0)) + 1) & ~F.coalesce(cycle["label"], F.lit("")).rlike(TWO_YEARS)
    day = iso_date(v)
    proposed = F.when(day.isNotNull(), F.substring(day, 1, 4).try_cast("int")).when(v["precision"] == "month", v["year"])
    said = lambda i, rule: two & (proposed == F.get(years, F.lit(i))) & evidence.rlike(rule)
    return F.when(blocked, None).when(one, F.get(years, F.lit(0))).when(said(0, FIRST_YEAR), F.get(years, F.lit(0))).when(said(1, SECOND_YEAR), F.get(years, F.lit(1))).cast("int")


def temporal_appears(v: Column, x: Column, year: Column) -> Column:
    """FN-25: the text states the day, month or time; without a year where ``year`` is the value's own (null: never)."""
    days, at = E.date_mentions(x), parse_date_time(v["date_time"])
    states = lambda day: F.array_contains(days, day) | _sure(day.startswith(F.concat(year.cast("string"), F.lit("-"))) & month_day_appears(day, x))
    whole = F.concat(F.lpad(v["year"].cast("string"), 4, "0"), F.lit("-"), _two(v["month"]))
    month = F.exists(days, lambda d: d.startswith(whole)) | F.regexp_like(x, F.concat(F.lit(r"(?i)\b"), month_name(v["month"]), F.lit(r"\s+"), v["year"].cast("string"), F.lit(r"\b")))
    time = states(at["date"]) & time_appears(at, x) & offset_appears(at["offset"], x)
    return _sure(F.when(v["precision"] == "date", states(v["date"])).when(v["precision"] == "month", month).when(v["precision"] == "date_time", time))


def event_supported(v: Column, evidence: Column, x: Column) -> Column:
    """FN-23: the passage names the event; or the day starts or ends a range; or something is due by it. Unknown events pass."""
    day = iso_date(v)
    month, number = month_day(day)
    at_end = lambda end: (v["precision"] == "date") & F.exists(day_ranges(x), lambda r: (r[f"{end}_month"] == month) & (r[f"{end}_day"] == number))
    named = F.coalesce(*(F.when(v["event"] == event, evidence.rlike(rule)) for event, rule in EVENTS.items()), F.lit(True))
    ranged = F.when(v["event"] == "starts", at_end("start")).when(v["event"] == "ends", at_end("end"))
    due = (v["event"] == "deadline") & month_day_appears(day, x) & evidence.rlike(DUE_BY)
    return named | _sure(ranged) | _sure(due)


def unit_appears(unit: Column, x: Column) -> Column:
    """FN-26: one or many of it."""
    return _sure(F.regexp_like(x, F.concat(F.lit(r"(?i)\b"), F.regexp_replace(unit, "s$", ""), F.lit(r"s?\b"))))


def quantity_appears(v: Column, x: Column) -> Column:
    """FN-26: every number and unit of the value stands in the text; null where it has none."""
    given = [F.when(v[n].isNotNull(), says_number(v[n], x)) for n in ("count", "ordinal", "minimum_hours", "low", "high")]
    given += [F.when(v["minimum_hours"].isNotNull(), x.rlike(HOURS)), F.when(v["minimum_hours"].isNotNull() & v["maximum_hours"].isNotNull(), says_number(v["maximum_hours"], x))]
    checks = F.array_compact(F.array(*given, F.when(v["unit"].isNotNull(), unit_appears(v["unit"], x))))
    return F.when(F.size(checks) > 0, F.forall(checks, lambda c: c))


def enums_appear(group: Column, values: Column, text: Column) -> Column:
    """FN-27: the text gives evidence for every value; null where the group or a value isn't known, or there is none."""
    rules = F.create_map(*(F.lit(s) for g, of in E.ENUMS.items() for value, p in of.items() for s in (f"{g}:{value}", f"(?i){p}")))
    patterns = F.transform(values, lambda value: rules[F.concat(group, F.lit(":"), value)])
    return F.when((F.size(patterns) > 0) & F.forall(patterns, lambda p: p.isNotNull()), F.forall(patterns, lambda p: F.regexp_like(text, p)))


def typed_failures(claims: DataFrame) -> DataFrame:
    """FN-29: the claims with ``failure``, the first reason for which a value doesn't match its passages, or null.

    ``claims``: ``value`` (``VALUE``), ``display``, ``excerpts`` and ``source_ids`` in one order, ``path_key`` (the last name of
    the claim's path; it also names the group of ``value.enums``), ``cycle`` (``CYCLE`` or null). Null texts count as
    empty. Texts are normalised once a row, and every check is an expression of that row: no shuffle.
    """
    rows = claims.withColumns({"_e": F.array_join("excerpts", " ", ""), "_d": F.coalesce("display", F.lit(""))})
    rows = rows.withColumn("_e", F.coalesce("_e", F.lit(""))).withColumns({"_x": T.normalize_whitespace(F.col("_e")), "_y": T.normalize_whitespace(F.col("_d"))})
    v, e, d, x, y, key = (F.col(c) for c in ("value", "_e", "_d", "_x", "_y", "path_key"))
    rows = rows.withColumn("_year", implicit_year(F.col("cycle"), F.col("source_ids"), e, v))
    fails = lambda reason, bad: F.when(bad, F.lit(FAILURES[reason]))
    no = F.lit(None).cast("int")
    money = fails("money", ~money_value_appears(v, e, x) | ~money_value_appears(v, d, y))
    date = fails("date", ~temporal_appears(v, x, F.col("_year")) | ~temporal_appears(v, y, no))
    expected = fails("expected", _sure(v["certainty"] == "expected") & ~e.rlike(EXPECTED))
    event = fails("event", v["event"].isNotNull() & ~event_supported(v, e, x))
    stated = quantity_appears(v, x)
    numbers = F.coalesce(fails("number", ~stated), fails("number_display", stated & ~quantity_appears(v, y)))
    enum = enums_appear(key, v["enums"], e)
    enums = F.coalesce(fails("enum", ~enum), fails("enum_display", enum & ~enums_appear(key, v["enums"], d)))
    evidence_marks = M.process_markers(e)
    advancing = fails("advancement", (key == "advancement") & ~F.arrays_overlap(evidence_marks, F.array(*map(F.lit, ADVANCING))))
    steps = fails("step", (key == "steps") & v.isNotNull() & (F.size(F.array_except(M.process_markers(F.concat(d, F.lit(" "), F.coalesce(v["enter_when"], F.lit("")))), evidence_marks)) > 0))
    chain = F.when(v["kind"].isNotNull() & v["currency"].isNotNull(), money).when(v["precision"].isNotNull(), F.coalesce(date, expected, event)).otherwise(F.coalesce(numbers, enums, advancing, steps))
    return rows.withColumn("failure", chain).drop("_e", "_d", "_x", "_y", "_year")


#: A summary fact's normalised value, its other fields null; ``day`` is yyyy-MM-dd.
NORMALIZED = "kind string, amount double, currency string, day string, number double, unit string, minimum double, maximum double, flag boolean, text string, texts array<string>"
#: What a yes or no is about, and how it is said.
FLAG_SUBJECTS = {"travel_included": r"(?i)\b(travel|transportation|airfare|flight)\b", "lodging_included": r"(?i)\b(lodging|housing|accommodation|hotel)\b", "meals_included": r"(?i)\b(meals?|food)\b", "certificate": r"(?i)\bcertificate\b"}
YES, NO = r"(?i)\b(included|covered|provided|paid for|at no (?:additional )?cost)\b", r"(?i)\b(not included|excluded|not covered|not provided|participant(?:s)? (?:must|are responsible)|at (?:your|their|the participant's) expense)\b"
CERTIFICATE_YES = r"(?i)\b(?:receive|earn|award(?:ed)?|provide(?:d)?)\b.{0,80}\bcertificate\b|\bcertificate\b.{0,80}\b(?:receive|earn|award(?:ed)?|provide(?:d)?)\b"
CERTIFICATE_NO = r"(?i)\b(?:no|not|without)\b.{0,40}\bcertificate\b|\bcertificate\b.{0,40}\b(?:not|isn't|is not)\b"
PERCENT, WEEKLY = r"(?i)(?:%|\bpercent(?:age)?\b)", r"(?i)\b(?:per|each|a)\s+week|weekly\b"
#: Unrestricted geography as proposed and as stated, one and many entrants, what is required, optional and of whom.
ANYWHERE, ANYWHERE_STATED = r"(?i)\b(?:all countries|worldwide|globally?|no geographic restrictions?)\b", r"(?i)\b(?:all countries|worldwide|globally?|anywhere (?:in|around) the world|no geographic restrictions?)\b"
ALONE, TOGETHER = r"(?i)\b(individual|solo|alone)\b", r"(?i)\b(team|group)\b"
REQUIRED, OPTIONAL = r"(?i)\b(required|must|need(?:s|ed)? to|has to|shall)\b", r"(?i)\b(optional|may optionally|not required)\b"
SPONSORS = {"parent or guardian": r"(?i)\b(parent|guardian)\b", "teacher or adviser": r"(?i)\b(teacher|educator|adviser|advisor)\b", "school representative": r"(?i)\b(school|counselor|administrator)\b"}
#: The reasons for summary facts.
FLAT_FAILURES = {
    "money": "its money amount or currency does not match the cited excerpt and display value",
    "date": "its date does not match the cited excerpt and display value",
    "number": "its number does not match the cited excerpt and display value",
    "percentage": "its percentage does not match percentage wording in the cited excerpt and display value",
    "duration": "its duration does not match the cited excerpt and display value",
    "hours": "its hour amount or period does not match the cited excerpt and display value",
    "boolean": "its yes/no value is not explicitly supported by the cited excerpt",
    "participation_format": "its participation format does not match the cited excerpt and display value",
    "ages": "its participant age value does not match the cited excerpt",
    "age_range": "its participant age range does not match the cited excerpt",
    "grades": "its grade-level value does not match the cited excerpt",
    "places": "its participant geography does not match the cited excerpt",
    "anywhere": "its unrestricted-geography wording is not stated by the cited excerpt",
    "citizens": "its citizenship or residency value does not match the cited excerpt",
    "alone": "individual entry is not explicitly stated by the cited excerpt",
    "together": "team entry is not explicitly stated by the cited excerpt",
    "team_size": "its team-size value does not match the cited excerpt",
    "required": "its required adult, school, or sponsor modality is not stated by the cited excerpt",
    "sponsors": "its adult, school, or sponsor count does not match the cited excerpt",
    "raw_money": "its money amount does not match the cited excerpt and display value",
    "raw_free": "its zero-cost wording does not match the cited excerpt",
}
RAW_AMOUNT = r"(?:^|[^\d.])(\d+(?:\.\d{1,2})?)(?![\d.])"


def flag_appears(field: Column, value: Column, text: Column) -> Column:
    """FN-31: the passage says yes or no of the field's own subject."""
    of_subject = F.coalesce(*(F.when(field == f, text.rlike(rule)) for f, rule in FLAG_SUBJECTS.items()), F.lit(True))
    said = F.when(field == "certificate", F.when(value, text.rlike(CERTIFICATE_YES)).otherwise(text.rlike(CERTIFICATE_NO))).otherwise(F.when(value, text.rlike(YES)).otherwise(text.rlike(NO)))
    return of_subject & said


def text_failure(field: Column, proposed: Column, evidence: Column) -> Column:
    """FN-31: what a text says of ages, school years, places, citizenship, entrants or sponsors and its passage doesn't."""
    fails = lambda reason, bad: F.when(bad, F.lit(FLAT_FAILURES[reason]))
    more = lambda of: ~E.supported(of(proposed), of(evidence))
    says = lambda rule: proposed.rlike(rule) & ~evidence.rlike(rule)
    own, stated = M.age_range(proposed), M.age_range(evidence)
    rules = {
        "ages": [fails("ages", more(M.small_numbers)), fails("age_range", own.isNotNull() & stated.isNotNull() & (own != stated))],
        "grade_levels": [fails("grades", more(E.grade_markers))],
        "geographic_restrictions": [fails("places", more(E.place_markers)), fails("anywhere", proposed.rlike(ANYWHERE) & ~evidence.rlike(ANYWHERE_STATED))],
        "citizenship_restrictions": [fails("citizens", more(E.citizenship_markers))],
        "entry_format": [fails("alone", says(ALONE)), fails("together", says(TOGETHER)), fails("team_size", proposed.rlike(TOGETHER) & more(M.small_numbers))],
        "sponsor_requirement": [fails("required", proposed.rlike(REQUIRED) & (~evidence.rlike(REQUIRED) | evidence.rlike(OPTIONAL))), *(F.when(says(rule), F.lit(f"its {who} requirement is not stated by the cited excerpt")) for who, rule in SPONSORS.items()), fails("sponsors", more(M.small_numbers))],
    }
    return F.coalesce(*(F.when(field == f, F.coalesce(*found)) for f, found in rules.items()))


def flat_failures(facts: DataFrame) -> DataFrame:
    """FN-31: summary facts, or their conflicting candidates, with ``failure``: why a value doesn't match its passages, or null.

    ``facts``: ``field_id``, ``normalized`` (``NORMALIZED`` or null), ``raw`` (the value as text), ``money_field``, ``display`` (null: ``raw``),
    ``excerpts``, ``source_ids``, ``cycle`` (``CYCLE`` or null). A money field without a normalised value is held to its raw amounts,
    or to its wording that nothing is to pay. A row each, no shuffle.
    """
    shown = F.coalesce("display", "raw", F.lit(""))
    rows = facts.withColumns({"_e": F.coalesce(F.array_join("excerpts", " ", ""), F.lit("")), "_d": shown, "_r": F.coalesce("raw", F.lit(""))})
    rows = rows.withColumns({"_x": T.normalize_whitespace(F.col("_e")), "_y": T.normalize_whitespace(F.col("_d"))})
    n, e, d, x, y, field, raw = (F.col(c) for c in ("normalized", "_e", "_d", "_x", "_y", "field_id", "_r"))
    nothing = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in VALUE.split(", ")}
    value = lambda **given: F.struct(*(c.alias(name) for name, c in (nothing | given).items()))
    money, day = value(kind=F.lit("exact"), amount=n["amount"], currency=n["currency"]), value(precision=F.lit("date"), date=n["day"])
    span, hours = value(low=n["amount"], unit=n["unit"]), value(minimum_hours=n["minimum"], maximum_hours=n["maximum"])
    both = lambda of, v: _sure(of(v, x)) & _sure(of(v, y))
    number = _sure(says_number(n["number"], x)) & _sure(says_number(n["number"], y))
    kind = lambda name: n["kind"] == name
    enum = F.array(n["text"])
    ok = (
        F.when(kind("money"), money_value_appears(money, e, x) & money_value_appears(money, d, y))
        .when(kind("date"), temporal_appears(day, x, implicit_year(F.col("cycle"), F.col("source_ids"), e, day)) & temporal_appears(day, y, F.lit(None).cast("int")))
        .when(kind("number"), number).when(kind("percentage"), number & e.rlike(PERCENT)).when(kind("duration"), both(quantity_appears, span))
        .when(kind("hours"), both(quantity_appears, hours) & ((field != "weekly_hours") | e.rlike(WEEKLY))).when(kind("boolean"), flag_appears(field, n["flag"], e))
        .when(kind("participation_format"), _sure(enums_appear(F.lit("formats"), enum, e)) & _sure(enums_appear(F.lit("formats"), enum, d)))
    )
    typed = F.when(~ok, F.element_at(F.create_map(*(F.lit(s) for pair in FLAT_FAILURES.items() for s in pair)), n["kind"]))
    words = F.when(n["kind"].isin("text", "text_list"), text_failure(field, F.concat(F.coalesce(n["text"], F.array_join(n["texts"], " "), F.lit("")), F.lit(" "), d), e))
    amounts = F.transform(E.all_of(F.replace(T.normalize_whitespace(raw), F.lit(","), F.lit("")), RAW_AMOUNT, 1), lambda a: a.try_cast("double"))
    free = F.when((raw.rlike(E.FREE) | d.rlike(E.FREE)) & ~e.rlike(E.FREE), F.lit(FLAT_FAILURES["raw_free"]))
    bare = F.when(F.size(amounts) > 0, F.when(~F.forall(amounts, lambda a: says_number(a, y) & says_number(a, x)), F.lit(FLAT_FAILURES["raw_money"]))).otherwise(free)
    failure = F.when(n["kind"].isNull(), F.when(F.col("money_field"), bare)).otherwise(F.coalesce(typed, words))
    return rows.withColumn("failure", failure).drop("_e", "_d", "_r", "_x", "_y")


#: Relationships, formats and an amount with its currency's code, as values may give them.
RELATIONSHIPS = ["institution_operated", "institution_sponsored", "institution_partnered", "hosted_at_institution", "founded_by_affiliates", "independent", "unclear"]
FORMATS = ["online", "commuter", "residential", "hybrid", "in_person"]
CODED_AMOUNT = r"^(?:(USD|CAD|AUD|EUR|GBP)\s*)?([$€£]?)\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(USD|CAD|AUD|EUR|GBP)?$"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?$"


def normalized_value(value_type: Column, classified: Column, text: Column, number: Column, flag: Column, items: Column) -> Column:
    """FN-32: a proposed value as ``NORMALIZED`` by its field's type, or null where the type can't hold it.

    One of ``text``, ``number``, ``flag`` and ``items`` is the value, the others are null. An amount needs a ``classified`` field and
    exactly one code, which no symbol contradicts; a share is 0 to 100; the empty share is 0. Shares in other bases than ten are null.
    """
    x = T.normalize_whitespace(text)
    nothing = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in NORMALIZED.split(", ")}
    of = lambda kind, **given: F.struct(*(c.alias(name) for name, c in (nothing | {"kind": F.lit(kind)} | given).items()))
    before, symbol, digits, after = (F.regexp_extract(x, CODED_AMOUNT, g) for g in (1, 2, 3, 4))
    code = F.when(before != "", before).otherwise(after)
    agrees = F.when(symbol == "€", code == "EUR").when(symbol == "£", code == "GBP").when(symbol == "$", code.isin("USD", "CAD", "AUD")).otherwise(True)
    amount = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    paid = classified & x.rlike(CODED_AMOUNT) & ((before != "") != (after != "")) & agrees
    count = F.coalesce(T.parse_count(text).cast("double"), F.when((number >= 0) & (number == F.floor(number)) & (number < 2.0**53), number))
    bare = F.trim(F.regexp_replace(x, "%$", ""))
    share = F.coalesce(number, F.when(bare == "", 0.0).when(bare.rlike(DECIMAL), bare.try_cast("double")))
    token = F.lower(x)
    yes = F.coalesce(flag, F.when(token.isin("yes", "true"), True).when(token.isin("no", "false"), False))
    length, unit = T.parse_duration(text)
    low, high = T.parse_weekly_hours(text)
    least = F.coalesce(low, F.when((number >= 0) & (number < float("inf")), number))
    listed = F.filter(F.transform(items, T.normalize_whitespace), lambda i: i != "")
    day, tie, form = T.parse_date(text), T.enum_token(text, RELATIONSHIPS), T.enum_token(text, FORMATS)
    is_type = lambda *names: value_type.isin(*names)
    return (
        F.when(is_type("text", "url"), F.when(text.isNotNull(), of("text", text=x))).when(is_type("text_list"), F.when(items.isNotNull(), of("text_list", texts=listed)))
        .when(is_type("date"), F.when(day.isNotNull(), of("date", day=day))).when(is_type("money"), F.when(_sure(paid), of("money", amount=amount, currency=code)))
        .when(is_type("number"), F.when(count.isNotNull(), of("number", number=count))).when(is_type("boolean"), F.when(yes.isNotNull(), of("boolean", flag=yes)))
        .when(is_type("percentage"), F.when(share.between(0, 100), of("percentage", number=share))).when(is_type("duration"), F.when(length.isNotNull(), of("duration", amount=length, unit=unit)))
        .when(is_type("hours"), F.when(least.isNotNull(), of("hours", minimum=least, maximum=high))).when(is_type("relationship"), F.when(tie.isNotNull(), of("relationship", text=tie)))
        .when(is_type("participation_format"), F.when(form.isNotNull(), of("participation_format", text=form)))
    )


def sanitized_value(value_type: Column, classified: Column, text: Column, number: Column, flag: Column, items: Column, display: Column, proposed: Column, excerpts: Column) -> Column:
    """FN-32: the value by its field's type, else its display; else a proposed amount (``NORMALIZED``) that the value states, if its currency, or that nothing is to pay, is put in words."""
    nothing = [F.lit(None).cast(kind) for kind in ("double", "boolean", "array<string>")]
    own = F.coalesce(normalized_value(value_type, classified, text, number, flag, items), normalized_value(value_type, classified, display, *nothing))
    stated = F.coalesce(number == proposed["amount"], F.when(text.isNotNull(), says_number(proposed["amount"], T.normalize_whitespace(text))), F.lit(False))
    said = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(display, F.lit("")), excerpts)
    coded = F.regexp_like(said, F.concat(F.lit(r"(?i)\b"), proposed["currency"], F.lit(r"\b"))) | ((proposed["amount"] == 0) & said.rlike(E.FREE))
    return F.coalesce(own, F.when(_sure(classified & (proposed["kind"] == "money") & stated & coded), proposed))
