"""Text and value normalisation as Column functions; nothing here leaves the JVM except ``nfkc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query keys that only track visitors, besides ``utm_*``.
TRACKING_KEYS = ["attribution_id", "dclid", "fbclid", "gclid", "igshid", "li_fat_id", "mc_cid", "mc_eid", "msclkid", "ttclid", "twclid"]
#: Currency symbols and their codes.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(x: Column) -> Column:
    """Compatibility forms as plain characters; texts of ASCII alone stay in the JVM."""
    return F.coalesce(nfkc(F.when(x.rlike(r"[^\x00-\x7f]"), x)), x)


def normalize_whitespace(x: Column) -> Column:
    """Straight quotes and hyphens, single spaces, trimmed; compose with ``compatible`` for compatibility forms."""
    return F.trim(F.regexp_replace(F.translate(x, "‘’“”–—", "''\"\"--"), r"(?U)\s+", " "))


def normalize_visible(x: Column) -> Column:
    """Text as a reader sees it: no-break spaces, controls, blanks and line ends become single spaces."""
    x = F.regexp_replace(F.translate(x, " ", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[\t\f\x0b ]+", " "), r"\s*\r?\n\s*", " "))


def parse_date(x: Column) -> Column:
    """ISO or ``Month D, YYYY`` as ``yyyy-MM-dd``; null for anything else, and for days that don't exist."""
    x = normalize_whitespace(x)
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
    named = F.when(x.rlike(rf"(?i)^({MONTHS})\s+\d{{1,2}},\s*\d{{4}}$"), F.try_to_date(F.initcap(F.regexp_replace(x, r",\s*", ", ")), "MMMM d, yyyy"))
    return F.date_format(F.coalesce(iso, named), "yyyy-MM-dd")


def parse_money(x: Column, default: str = "USD") -> tuple[Column, Column]:
    """(amount, currency): a code beats a symbol beats the default; two decimals at most, nothing negative."""
    x = normalize_whitespace(x)
    code = F.regexp_extract(x, r"\b([A-Z]{3})\b", 1)
    symbol = F.coalesce(*(F.when(F.substring(x, 1, 1) == s, F.lit(c)) for s, c in CURRENCIES.items()))
    number = F.regexp_replace(F.regexp_replace(x, "[A-Z]{3}", ""), r"[$€£,\s]", "")
    ok = number.rlike(r"^\d+(\.\d{1,2})?$")
    return F.when(ok, number.try_cast("double")), F.when(ok, F.coalesce(F.when(code != "", code), symbol, F.lit(default)))


def parse_count(x: Column) -> Column:
    """A whole number of people with optional commas; the empty string is 0."""
    plain = F.trim(F.replace(x, F.lit(","), F.lit("")))
    return F.when(plain == "", F.lit(0)).when(plain.rlike(r"^\d{1,15}$"), plain.try_cast("long")).cast("long")


def parse_duration(x: Column) -> tuple[Column, Column]:
    """(amount, unit) of ``N hours|days|weeks|months``; units are never converted."""
    x, rule = normalize_whitespace(x), r"(?i)^(\d+(?:\.\d+)?)\s*(hour|day|week|month)s?$"
    ok = x.rlike(rule)
    return F.when(ok, F.regexp_extract(x, rule, 1).try_cast("double")), F.when(ok, F.concat(F.lower(F.regexp_extract(x, rule, 2)), F.lit("s")))


def parse_weekly_hours(x: Column) -> tuple[Column, Column]:
    """(minimum, maximum or null) of ``a[-b] hours[ per week]``; null where the maximum is smaller."""
    x, rule = normalize_whitespace(x), r"(?i)^(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(?:hours?|hrs?)(?:\s*per\s*week|/week)?$"
    low, high = F.regexp_extract(x, rule, 1).try_cast("double"), F.regexp_extract(x, rule, 2).try_cast("double")
    ok = x.rlike(rule) & (high.isNull() | (high >= low))
    return F.when(ok, low), F.when(ok, high)


def enum_token(x: Column, allowed: list[str]) -> Column:
    token = F.regexp_replace(F.lower(normalize_whitespace(x)), r"[\s-]+", "_")
    return F.when(token.isin(allowed), token)


def acceptance_rate(applicants: Column, accepted: Column) -> Column:
    """Percent with two decimals; null unless 0 <= accepted <= applicants and applicants > 0."""
    share = F.floor(accepted / applicants * 10_000 + 0.5) / 100
    return F.when((applicants > 0) & (accepted >= 0) & (accepted <= applicants), share)


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters, host in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    tracking = "|".join(["utm_[^=&]*", *TRACKING_KEYS])
    base, query = F.substring_index(bare, "?", 1), F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", ""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"(?i)^({tracking})(=|$)")), "&")
    base = F.concat(F.lower(F.regexp_extract(base, r"^(\w+://[^/]*)", 1)), F.regexp_replace(base, r"^\w+://[^/]*", ""))
    return F.when(F.coalesce(kept, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def stable_page_id(url: Column) -> Column:
    return F.concat(F.lit("page-"), F.substring(F.sha2(url, 256), 1, 16))


def text_fingerprint(x: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(x, r"\s+", " ")), 256)


def slug(x: Column, most: int = 100) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(plain, 1, most), "-+$", "")


def number_appears(text: Column, number: Column) -> Column:
    """The literal stands in the text, next to no digit or dot."""
    return F.regexp_like(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(r"[^0-9.]"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(r"[^0-9.]")))


def excerpt_in(text: Column, excerpt: Column) -> Column:
    """The excerpt, normalised and case-folded, is a nonempty substring of the text."""
    short, long = F.lower(normalize_whitespace(excerpt)), F.lower(normalize_whitespace(text))
    return (F.length(short) > 0) & F.contains(long, short)
