"""What a text says about a programme's process, people and cycle, and how values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import CURRENCIES, normalize_whitespace

#: Process markers and the words that show them.
PROCESS = {
    "application": r"\b(apply|application|submit|submission)\b",
    "interview": r"\binterviews?\b",
    "review": r"\breview(?:ed|ing|s)?\b",
    "selection": r"\b(select(?:ed|ion|s)?|advance(?:d|ment|s)?|move forward|proceed|qualif(?:y|ied|ication)|invited?)\b",
    "selection_notice": r"\b(notif(?:y|ied|ication)|announc(?:e|ed|ement)|selected as|decision(?:s)?|results?)\b",
    "finalist": r"\bfinalists?\b",
    "semifinal": r"\bsemi-?finalists?\b",
    "winner": r"\bwinners?\b",
    "match": r"\bmatch(?:ed|ing)?\b",
    "ranking": r"\brank(?:ed|ing|s)?\b",
    "requirements": r"\brequirements?\b",
    "pitch": r"\bpitch(?:es|ed|ing)?\b",
}
#: Cycle states and the words that show them; the first that matches counts.
CYCLE = {
    "applications_open": r"\b(applications? (?:are )?(?:(?:now|currently) )?open|apply now|accepting applications?)\b",
    "applications_closed": r"\b(applications? (?:are )?closed|submissions? (?:are )?closed|deadline (?:has )?passed)\b",
    "announced": r"\b(announced|upcoming|coming in|will open|will begin)\b",
    "active": r"\b(in progress|underway|currently running)\b",
    "complete": r"\b(completed|concluded|has ended)\b",
}
#: Wordings of an age range.
AGES = [
    r"\bbetween (?:the )?ages?(?: of)?\s*(\d{1,2})\s*(?:and|to|through|-)\s*(\d{1,2})\b",
    r"\bages?\s*(\d{1,2})\s*(?:and|to|through|-)\s*(\d{1,2})\b",
    r"\b(\d{1,2})\s*(?:to|through|-)\s*(\d{1,2})\s*years? old\b",
]
#: Kinds of admission that aren't steps.
NO_STEP = r"\b(?:early|regular)\s+decision\b"
OLDEST = 25


def process_markers(text: Column) -> Column:
    """FN-28: markers in the order of ``PROCESS``."""
    action = F.regexp_replace(text, f"(?i){NO_STEP}", "")
    return F.array_compact(F.array(*(F.when(action.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in PROCESS.items())))


def cycle_status(text: Column) -> Column:
    """FN-37: null if nothing tells."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in CYCLE.items()))


def small_numbers(text: Column) -> Column:
    """FN-30: whole numbers up to ``OLDEST`` of one or two digits, each once, ascending."""
    runs = F.regexp_extract_all(F.replace(normalize_whitespace(text), F.lit(","), F.lit("")), F.lit(r"\d+"), 0)
    short = F.transform(F.filter(runs, lambda x: F.length(x) <= 2), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(short, lambda n: n <= OLDEST)))


def age_range(text: Column) -> Column:
    """FN-30: (minimum, maximum) by the first wording whose first match makes sense, else null."""
    x = F.lower(normalize_whitespace(text))

    def found(pattern):
        low, high = (F.regexp_extract(x, pattern, k).try_cast("int") for k in (1, 2))
        return F.when((low <= high) & (high <= OLDEST), F.struct(low.alias("minimum"), high.alias("maximum")))

    return F.coalesce(*map(found, AGES))


def plain_number(x: Column) -> Column:
    """Thousands separated, at most two decimals, no zeros at the end."""
    return F.regexp_replace(F.format_number(x, 2), r"\.?0+$", "")


def money_display(amount: Column, currency: Column) -> Column:
    """FN-10: none or two decimals behind the currency's symbol, or its code and a no-break space."""
    symbol = F.coalesce(*(F.when(currency == code, F.lit(s)) for s, code in CURRENCIES.items()), F.concat(currency, F.lit(" ")))
    return F.concat(symbol, F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)))


def money_range(low: Column, high: Column, currency: Column) -> Column:
    return F.concat(money_display(low, currency), F.lit("–"), money_display(high, currency))


def date_display(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def hours_display(low: Column, high: Column, period: Column) -> Column:
    """FN-09, hours: one number where the maximum is missing or the same."""
    amount = F.when(high.isNull() | (high == low), plain_number(low)).otherwise(F.concat(plain_number(low), F.lit("–"), plain_number(high)))
    return F.concat(amount, F.lit(" hours "), F.when(period == "total", "total").otherwise(F.concat(F.lit("per "), period)))


def searchable_url(url: Column) -> Column:
    """FN-17: path and query as words; a broken escape leaves the text as it is."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^\w+://[^/?]*", "")
    both = F.concat(F.substring_index(rest, "?", 1), F.lit(" "), F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*", "")).otherwise(""))
    return F.regexp_replace(F.coalesce(F.try_url_decode(both), both), "[-_+/?.=&]+", " ")
