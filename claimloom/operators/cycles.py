"""Which cycle a card's pages speak of: candidates, scores, the best, and the years that belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import cut

#: Wording of cycles, of the past, of eligibility by school year.
SEASONS = "Winter|Spring|Summer|Fall|Autumn"
ACTION = r"(?i)\b(apply|application|deadline|current|upcoming|cycle|cohort|class|program|challenge|competition)\b"
PAST = r"(?i)\b(last year|previous year|historical|in prior years?|alumni|since 20\d{2}|matched in|winners? in)\b"
PAST_CONTEXT = r"(?i)\b(?:last year|previous year|historical|in prior years?|alumni|since 20\d{2}|matched in|winners? in|selected in|class of)\b"
SCHOOL_YEAR = r"(?i)\b(?:graduate|graduation|eligible|eligibility)\b.{0,100}\b(?:academic |school )?year\b|\b(?:academic |school )?year\b.{0,100}\b(?:graduate|graduation|eligible|eligibility)\b"
STATISTICS = r"(?i)\b(statistic|applicants?|accepted|selected|winners?|finalists?|participants?)\b"
NO_STATISTICS = r"(?i)\b(apply|application|deadline|cycle|cohort)\b"
CURRENT = r"(?i)\b(?:apply|application|deadline|due|submissions?|sessions?|program|challenge|competition|scholars?|match|timeline|dates?|cohort|class|entry|enrollment|admissions?|current|upcoming|open)\b"
CURRENT_STRONG = r"(?i)\b(?:application|submissions?|deadline|due|current|open)\b"
ENTRY = r"(?i)\b(?:entry|enroll(?:ment|s|ed|ing)?|attend(?:s|ed|ing|ance)?|participation)\b"
LIFECYCLE = r"(?i)\b(?:application|deadline|submissions?|requirements?|admissions? decisions?|entry|enroll(?:ment|s|ed|ing)?|attend(?:s|ed|ing|ance)?|participation|program (?:begins|starts)|sessions?|academic school year)\b"
#: How each family of candidates is written.
BOTH_YEARS = rf"(?i)\b(20\d{{2}})\s+application\b.{{0,100}}?\b(?:({SEASONS})\s+)?(20\d{{2}})\s+(?:entry|enrollment|participation|program|start)\b"
PENDING = r"(?i)\b(20\d{2})\s+dates?\s+(?:tbd|pending|not yet available|to be announced)\b"
ROLLING = r"(?i)\brolling (?:admissions?|applications?)\b|\beach month\b.{0,80}\b(?:new )?cohort\b"
LONG_RANGE = r"\b(20\d{2})\s*[–—-]\s*(20\d{2})\b"
SHORT_RANGE = r"\b(20\d{2})\s*[–—-]\s*(\d{2})\b"
SEASON_YEAR = rf"(?i)\b({SEASONS})(?:\s+cohort)?\s+(20\d{{2}})\b"
YEAR_SEASON = rf"(?i)\b(20\d{{2}})\b.{{0,60}}?\b({SEASONS})(?:\s+(?:dates?|sessions?|cohort|program))?\b"
MONTHS_YEAR = r"(?i)\b(June|July|August)(?:\s*(?:&|and|,|through|to|-)\s*(?:June|July|August))?\s+(20\d{2})\b"
CYCLE_YEAR = r"(?i)\b(20\d{2})\s+(?:competition\s+)?(?:cycle|cohort|class|program|challenge|competition)\b"
YEAR = r"\b(20\d{2})\b"

_KIND = "struct<label:string,start_year:int,end_year:int,year:int,season:string,cycle_type:string,bonus:int>"


def _one(label, start=None, end=None, year=None, season=None, kind="other", bonus=0) -> Column:
    col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(col(label, "string").alias("label"), col(start, "int").alias("start_year"), col(end, "int").alias("end_year"), col(year, "int").alias("year"), col(season, "string").alias("season"), col(kind, "string").alias("cycle_type"), col(bonus, "int").alias("bonus"))


def _season(raw: Column) -> Column:
    return F.when(F.lower(raw) == "autumn", "fall").when(raw != "", F.lower(raw))


def _every(x: Column, pattern: str, make) -> Column:
    """A candidate of each match, from its groups."""
    first = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    if pattern in (CYCLE_YEAR, YEAR):
        return F.transform(first, make)
    return F.zip_with(first, F.regexp_extract_all(x, F.lit(pattern), F.lit(2)), make)


def of_place(source_index: Column, kind: Column) -> Column:
    """What speaks for a block by where it stands."""
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    return add(source_index == 0, 8) + add(kind == "heading", 6) + add(kind == "title", 8)


def score(x: Column, source_index: Column, kind: Column) -> Column:
    """FN-36: what speaks for a text, whatever it names."""
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    return of_place(source_index, kind) + add(x.rlike(ACTION), 4) - add(x.rlike(PAST), 10) - add(x.rlike(SCHOOL_YEAR), 8) - add(x.rlike(STATISTICS) & ~x.rlike(NO_STATISTICS), 4)


def candidates(blocks: DataFrame) -> DataFrame:
    """FN-36: ``(slug, source_index, block_index, nth, excerpt, label, start_year, end_year, year, season, cycle_type, score)``.

    ``blocks``: ``(slug, source_index, block_index, kind, text, title)``, all of a page's; its title is a block of its own, of kind title and index -1.
    Each distinct text and title is read once, however many cards repeat it, and what it names is joined to its blocks.
    """
    rows = blocks.withColumn("x", F.trim("text"))
    x = F.col("x")
    subject = F.concat(x, F.lit(" "), F.col("title"))
    inferred = F.when(subject.rlike(r"(?i)\b(?:challenge|competition)\b"), "competition_cycle").when(subject.rlike(r"(?i)\bcohort\b"), "cohort").otherwise("other")
    school = x.rlike(SCHOOL_YEAR)
    group = lambda p, g: F.regexp_extract(x, p, g)
    entry_season = _season(group(BOTH_YEARS, 2))
    both = F.when(x.rlike(BOTH_YEARS), F.array(_one(F.concat(group(BOTH_YEARS, 1), F.lit(" application / "), F.coalesce(F.concat(F.initcap(entry_season), F.lit(" ")), F.lit("")), group(BOTH_YEARS, 3), F.lit(" entry")), F.nullif(group(BOTH_YEARS, 1), F.lit("")), F.nullif(group(BOTH_YEARS, 3), F.lit("")), F.nullif(group(BOTH_YEARS, 3), F.lit("")), entry_season, bonus=8)))
    waiting = _season(F.regexp_extract(subject, rf"(?i)\b({SEASONS})\b", 1))
    pending = F.when(x.rlike(PENDING), F.array(_one(F.concat(F.coalesce(F.concat(F.initcap(waiting), F.lit(" ")), F.lit("")), group(PENDING, 1)), year=F.nullif(group(PENDING, 1), F.lit("")), season=waiting, kind=F.when(waiting.isNull(), inferred).otherwise("seasonal"), bonus=10)))
    rolling = F.when(x.rlike(ROLLING), F.array(_one("Rolling admissions", kind="rolling", bonus=5)))
    span = lambda a, b, kind, bonus: _one(F.concat(a, F.lit("–"), b), a, b, kind=kind, bonus=bonus)
    near = lambda c: (c["end_year"] >= c["start_year"]) & (c["end_year"] - c["start_year"] <= 2)
    long = F.when(~school, F.filter(_every(x, LONG_RANGE, lambda a, b: span(a, b, "academic_year", 2)), near))
    short_kind = F.when(x.rlike(r"(?i)\b(?:academic|school)\s+year\b"), "academic_year").otherwise(inferred)
    short = F.when(~school, F.filter(_every(x, SHORT_RANGE, lambda a, b: span(a, F.concat(F.substring(a, 1, 2), b), short_kind, 3)), near))
    of_season = lambda s, y, kind, bonus: _one(F.concat(F.initcap(_season(s)), F.lit(" "), y), year=y, season=_season(s), kind=kind, bonus=bonus)
    families = [
        both, pending, rolling, long, short,
        _every(x, SEASON_YEAR, lambda s, y: of_season(s, y, "seasonal", 3)),
        _every(x, YEAR_SEASON, lambda y, s: of_season(s, y, F.when(x.rlike(r"(?i)\bcohort\b"), "cohort").otherwise("seasonal"), 3)),
        _every(x, MONTHS_YEAR, lambda m, y: _one(F.concat(F.lit("Summer "), y), year=y, season="summer", kind="seasonal", bonus=4)),
        _every(x, CYCLE_YEAR, lambda y: _one(y, year=y, kind=inferred)),
        F.when(x.rlike(CURRENT) & ~school, _every(x, YEAR, lambda y: _one(y, year=y, kind=inferred, bonus=F.when(x.rlike(CURRENT_STRONG), 3).otherwise(0)))),
    ]
    nothing = F.array().cast(f"array<{_KIND}>")
    listed = F.concat(*(F.coalesce(f.cast(f"array<{_KIND}>"), nothing) for f in families))
    says = score(x, F.lit(None), F.lit(None)).alias("says")
    read = cut(rows.select("x", "title").distinct().select("x", "title", says, listed.alias("listed"))).filter(F.size("listed") > 0)  # before the cut, the filter would read every row
    same = rows.alias("b").join(read.alias("r"), F.col("b.x").eqNullSafe(F.col("r.x")) & F.col("b.title").eqNullSafe(F.col("r.title")))
    base = F.col("says") + of_place(F.col("source_index"), F.col("kind"))
    found = same.select("slug", "source_index", "block_index", F.col("b.x").alias("excerpt"), base.alias("base"), F.posexplode("listed").alias("nth", "c"))
    return found.select("slug", "source_index", "block_index", "nth", "excerpt", *(f"c.{k}" for k in ("label", "start_year", "end_year", "year", "season", "cycle_type")), (F.col("base") + F.col("c.bonus")).alias("score"))


def years_of(c) -> Column:
    return F.array_compact(F.array(c("year"), c("start_year"), c("end_year")))


def compatible(a, b) -> Column:
    """Two candidates may mean one cycle: the same label, or a shared year without rolling admission or different seasons."""
    apart = (a("cycle_type") == "rolling") | (b("cycle_type") == "rolling") | F.coalesce(a("season") != b("season"), F.lit(False))
    return (a("label") == b("label")) | (~apart & F.arrays_overlap(years_of(a), years_of(b)))


def ranked(found: DataFrame) -> DataFrame:
    """WIN-02: each label's best candidate, the earliest of equals; labels by score, then by first appearance."""
    at = F.struct("source_index", "block_index", "nth")
    label = Window.partitionBy("slug", "label")
    best = found.withColumn("first", F.min(at).over(label)).withColumn("own", F.row_number().over(label.orderBy(F.desc("score"), at))).filter("own = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("score"), "first"))).drop("own", "first")


_FIELDS = ["excerpt", "label", "start_year", "end_year", "year", "season", "cycle_type", "score"]


def resolve(found: DataFrame) -> DataFrame:
    """PIPE-02: ``(slug, label, years, start_year, end_year, year, season, cycle_type)``, one row for each card whose cycle is clear.

    WIN-03: no cycle where the best has a score under 4, or the runner-up means another and is at most one point behind.
    WIN-11: a later season's entry in the following year continues the best.
    """
    found = cut(found)  # read five times below
    order = cut(ranked(found))
    side = lambda rank, name: order.filter(f"rank = {rank}").select("slug", F.struct(*_FIELDS).alias(name))
    of = lambda name: lambda c: F.col(f"{name}.{c}")
    best, second = of("best"), of("second")
    clear = side(1, "best").join(side(2, "second"), "slug", "left").filter((best("score") >= 4) & ~F.coalesce(~compatible(best, second) & (second("score") >= best("score") - 1), F.lit(False)))
    later = order.join(clear.select("slug", best("year").alias("_year")), "slug").filter((F.col("rank") > 1) & (F.col("year") == F.col("_year") + 1) & F.col("season").isNotNull() & ~F.col("excerpt").rlike(PAST_CONTEXT) & ~F.col("excerpt").rlike(SCHOOL_YEAR) & F.col("excerpt").rlike(ENTRY))
    continued = later.groupBy("slug").agg(F.min_by(F.struct("label", "year", "season"), "rank").alias("next"))
    own = lambda c: F.col(c)
    beside = F.exists(years_of(own), lambda y: F.exists(years_of(best), lambda a: F.abs(y - a) <= 1))
    belongs = ~F.col("excerpt").rlike(PAST_CONTEXT) & ~F.col("excerpt").rlike(SCHOOL_YEAR) & (compatible(best, own) | (F.col("excerpt").rlike(LIFECYCLE) & beside))
    years = found.join(clear.select("slug", "best"), "slug").filter(belongs).select("slug", F.explode(years_of(own)).alias("y")).groupBy("slug").agg(F.array_sort(F.collect_set("y")).alias("years"))
    out = clear.join(continued, "slug", "left").join(years, "slug", "left")
    more = F.col("next").isNotNull()
    return out.select(
        "slug", F.when(more, F.concat(best("label"), F.lit(" / "), F.col("next.label"), F.lit(" entry"))).otherwise(best("label")).alias("label"), F.coalesce("years", F.array().cast("array<int>")).alias("years"),
        F.when(more, F.coalesce(best("start_year"), best("year"))).otherwise(best("start_year")).alias("start_year"), F.coalesce(best("end_year"), F.col("next.year")).alias("end_year"), best("year").alias("year"), F.coalesce(best("season"), F.col("next.season")).alias("season"), best("cycle_type").alias("cycle_type"),
    )
