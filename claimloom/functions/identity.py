"""Which opportunity a page is about: identity words of titles, headings and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import urls as U

#: Path segments that a name follows; words that name nothing; words of general page titles; words that many names share.
PATH_MARKERS = ["challenge", "challenges", "competition", "competitions", "opportunity", "opportunities", "program", "programs", "programme", "programmes", "scholarship", "scholarships"]
STOPS = ["a", "about", "and", "apply", "application", "at", "by", "for", "from", "home", "in", "of", "official", "on", "program", "programme", "scholarship", "student", "students", "the", "to", "with"]
GENERIC_TITLES = ["about", "aid", "apply", "eligibility", "faq", "financial", "frequently", "home", "how", "asked", "privacy", "policy", "questions", "regulations", "requirements", "rules", "service", "terms", "tuition", "welcome"]
GENERIC_WORDS = ["challenge", "college", "competition", "conference", "contest", "fellow", "global", "high", "international", "junior", "match", "national", "prize", "research", "school", "scholar", "scholars", "senior", "summer", "young", "youth"]
KIND = r"(?i)\b(challenge|competition|conference|contest|fellowship|internship|match|olympiad|prize program|research program|summer program)\b"
_TITLE_CUT = r"\s+[|–—:]\s+"


def words(x: Column) -> Column:
    """FN-18: words of three letters or more that can name something; of text without accents."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), " ")
    one = F.transform(plain, lambda w: F.when(w.isin("fellow", "fellows", "fellowship", "fellowships"), "fellow").otherwise(w))
    return F.filter(one, lambda w: (F.length(w) >= 3) & ~w.isin(STOPS))


def title_words(title: Column) -> Column:
    """FN-19: of a title's first part, or of its last where the first is general."""
    parts = F.split(title, _TITLE_CUT)
    first = words(parts[0])
    return F.array_distinct(F.when((F.size(parts) > 1) & F.forall(first, lambda w: w.isin(GENERIC_TITLES)), words(F.element_at(parts, -1))).otherwise(first))


def path_identity(url: Column) -> Column:
    """FN-19: the path segment after a marker, if it is none itself; null otherwise."""
    raw = F.filter(F.split(U.part(url, "path"), "/"), lambda s: s != "")
    segments = F.transform(raw, lambda s: F.lower(F.coalesce(F.try_url_decode(s), s)))
    after = F.zip_with(segments, F.slice(segments, F.lit(2), F.greatest(F.size(segments), F.lit(1))), lambda a, b: F.when(a.isin(PATH_MARKERS) & ~b.isin(PATH_MARKERS), b))
    return F.get(F.array_compact(after), F.lit(0))


def distinctive(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(GENERIC_WORDS + GENERIC_TITLES))


def overlap(a: Column, b: Column) -> Column:
    """SET-03."""
    return F.size(F.array_intersect(a, b))


def same_identity(target: Column, candidate: Column) -> Column:
    """FN-19: three quarters of the target's words, or two of its distinctive ones."""
    own = distinctive(target)
    broad = overlap(target, candidate) >= F.greatest(F.lit(2), F.ceil(F.size(target) * 0.75))
    close = broad | (overlap(own, distinctive(candidate)) >= F.least(F.lit(2), F.size(own)))
    return F.when(F.size(own) > 0, close).when(F.size(target) == 1, overlap(target, candidate) == 1).otherwise(broad)


def names_another(link_text: Column, target: Column) -> Column:
    """The text names an opportunity of its own kind that isn't the target."""
    own = title_words(link_text)
    return link_text.rlike(KIND) & (F.size(distinctive(own)) > 0) & ~same_identity(target, own)
