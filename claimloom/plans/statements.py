"""Markers, values and addresses that texts state, on the driver's tables: a Spark query and SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import identity as I
from claimloom.functions import urls as U
from claimloom.plans.carriers import VIEWS, query

#: Sentences that the carrier table deals out to line items; between them they meet every rule below.
SENTENCES = [
    "Apply by February 12, 2027 for the Summer 2027 cohort", "Applications are now open for 2026-27", "The 2027 competition cycle begins on 2027-01-15",
    "Tuition is $2,500 and the deposit is USD 250.50", "There is no application fee", "A fee of 500 EUR or £420 covers materials", "Free of charge for all participants",
    "Open to grades 9 through 12", "High school juniors and seniors may apply", "For 7th graders and 8 - graders in middle school", "College students and undergraduate students are eligible", "Ages 14 to 18, grades 10-11",
    "Citizens of Canada and Mexico with visas", "United States citizens or permanent residents only", "No citizenship requirement; students worldwide may enter", "Residents of Norway and Freedonia are eligible",
    "Hosted by Stanford University in partnership with Acme Foundation", "Operated by the Northern Lights Organization", "Interviews and review of semifinalists", "Finalists pitch; winners are announced in July 2027",
    "Online sessions, two weeks, 6-8 hours per week", "Residential program on campus, in person", "A hybrid day program for commuters", "The stipend is paid in cash to each student",
    "Project funding of $1,000 to the team budget", "Travel is reimbursed for teachers", "Prizes worth an estimated value of $300, in-kind", "Last year the 2025 cohort had 400 applicants",
    "Winners in 2024 came from schools of the nonprofit", "Rolling admissions, deadline has passed for Fall 2026", "2027 application for Fall 2028 entry", "2027 dates TBD for the summer challenge",
    "Acceptance was 12.5% in 2026, see https://example.org/data", "Students who graduate in the 2026-2027 school year are eligible", "June and July 2027", "About the Program", "The class of 2023 has ended", "", "Refunds are available until May 1, 2027", "Merit scholarships and need-based financial aid",
]


def _case(key: str, texts: list[str]) -> str:
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(texts)) + " END"


VIEWS |= {
    "sentences": f"SELECT l_orderkey AS slug, l_linenumber AS block, {_case('(l_partkey + l_linenumber)', SENTENCES)} AS text, {_case('(l_partkey * 3 + l_suppkey)', SENTENCES)} AS basis FROM lineitem",
    "addresses": "SELECT page_id, concat(CASE page_id % 9 WHEN 0 THEN 'HTTP://User:pw@Example.org' WHEN 1 THEN 'https://127.0.0.1' WHEN 2 THEN 'https://localhost' WHEN 3 THEN 'https://a.Example.org:443' WHEN 4 THEN 'https://printer.local' WHEN 5 THEN 'http://8.8.8.8' WHEN 6 THEN 'ftp://example.org' WHEN 7 THEN 'https://example.org:8443' ELSE 'https://example.org' END, "
    "CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/Programs/x-y?utm_source=n&Q=1&ttclid=2' WHEN 2 THEN '/p?apiKey=1' WHEN 3 THEN '/faq#session_id=2' WHEN 4 THEN '/a/b?k=1&fbclid=3#top' WHEN 5 THEN '/about?monkey=1' ELSE '/programs/x-y/apply' END) AS url FROM pages",
}


def _named(text: str, patterns: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{name}' END" for name, p in patterns.items())
    return f"list_filter([{listed}], lambda x: x IS NOT NULL)"


_ENUMS = {f"{group}:{value}": p for group, values in E.ENUMS.items() for value, p in values.items()}
_joined = lambda column: F.array_join(column, ",")


@query("flt_16_topics", "sentences", sql=f"SELECT slug, block, array_to_string({_named('text', E.TOPICS)}, ',') AS topics FROM sentences")
def _(s):
    return s.select("slug", "block", _joined(E.topics(F.col("text"))).alias("topics"))


@query("fn_27_enum_evidence", "sentences", sql=f"SELECT slug, block, array_to_string({_named('text', _ENUMS)}, ',') AS markers FROM sentences")
def _(s):
    return s.select("slug", "block", _joined(E.enum_evidence(F.col("text"))).alias("markers"))


_MONEY_SQL = rf"list_transform(regexp_extract_all(text, '{E.MONEY}'), lambda c: struct_pack(a := regexp_replace(regexp_replace(upper(c), '[A-Z]{{3}}', ''), '[$€£,\s]', '', 'g')::DOUBLE, k := coalesce(nullif(regexp_extract(upper(c), '[A-Z]{{3}}'), ''), CASE left(c, 1) WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE 'USD' END)))"


@query("fn_22_money_values", "sentences", sql=f"SELECT slug, block, sum(m.a) AS total, string_agg(m.k, ',' ORDER BY m.k) AS currencies FROM (SELECT slug, block, unnest({_MONEY_SQL}) AS m FROM sentences) GROUP BY ALL")
def _(s):
    return s.select("slug", "block", F.explode(E.money_mentions(F.col("text"))).alias("m")).groupBy("slug", "block").agg(F.sum("m.amount").alias("total"), F.array_join(F.sort_array(F.collect_list("m.currency")), ",").alias("currencies"))


@query("fn_22_money_appears", "sentences", sql=f"SELECT slug, block, len(list_filter({_MONEY_SQL}, lambda m: m.a = 2500 AND m.k = 'USD')) > 0 AS states_2500, regexp_matches(text, '{E.FREE}') OR len(list_filter({_MONEY_SQL}, lambda m: m.a = 0 AND m.k = 'USD')) > 0 AS states_free FROM sentences")
def _(s):
    says = lambda amount: E.money_appears(F.col("text"), F.lit(amount), F.lit("USD"))
    return s.select("slug", "block", says(2500.0).alias("states_2500"), says(0.0).alias("states_free"))


@query("fn_23_date_mentions", "sentences", sql=f"SELECT slug, block, array_to_string(list_filter(list_transform(regexp_extract_all(text, '{E.DATES}'), lambda d: strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%B %d, %Y')), '%Y-%m-%d')), lambda d: d IS NOT NULL), ',') AS days FROM sentences")
def _(s):
    return s.select("slug", "block", _joined(E.date_mentions(F.col("text"))).alias("days"))


_MARKS = "[[concat('grade-', g), CASE WHEN g BETWEEN 9 AND 12 THEN 'high-school' WHEN g BETWEEN 5 AND 8 THEN 'middle-school' END] for g in {}]"
_YEARS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {g} END" for g, p in E.YEARS_AT_SCHOOL.items()) + "], lambda x: x IS NOT NULL)"


def _grades_sql(column: str) -> str:
    schools = _named("t", {"middle-school": r"\bmiddle school\b", "high-school": r"\bhigh school\b", "college": r"\b(?:college|university|undergraduate) students?\b"})
    ranges = r"regexp_extract_all(t, '\bgrades?\s*(\d{1,2})(?:\s*(?:-|through|to)\s*(\d{1,2}))?\b', %d)"
    pairs = f"list_filter(list_transform(list_zip({ranges % 1}, {ranges % 2}), lambda p: struct_pack(a := p[1]::INT, b := coalesce(nullif(p[2], ''), p[1])::INT)), lambda p: p.b >= p.a AND p.b - p.a <= 12)"
    graders = r"[g::INT for g in regexp_extract_all(t, '\b(\d{1,2})(?:st|nd|rd|th)?\s*-?\s*graders?\b', 1)]"
    every = f"list_concat({_YEARS}, {graders}, flatten(list_transform({pairs}, lambda p: range(p.a, p.b + 1)::INT[])))"
    return f"list_sort(list_distinct(list_filter(list_concat(flatten({_MARKS.format(every)}), {schools}), lambda x: x IS NOT NULL)))".replace("(t,", f"(lower({column}),")


@query("fn_30_grade_markers", "sentences", sql=f"SELECT slug, block, array_to_string({_grades_sql('text')}, ',') AS markers FROM sentences")
def _(s):
    return E.once_a_text(s, "text", E.grade_markers, "marked").select("slug", "block", _joined(F.col("marked")).alias("markers"))


@query("set_04_supported_markers", "sentences", sql=f"SELECT slug, block, list_has_all(b, a) AS supported, len(list_intersect(a, b)) AS shared FROM (SELECT slug, block, {_grades_sql('text')} AS a, {_grades_sql('basis')} AS b FROM sentences)")
def _(s):
    s = E.once_a_text(E.once_a_text(s, "text", E.grade_markers, "proposed"), "basis", E.grade_markers, "evidence")
    a, b = F.col("proposed"), F.col("evidence")
    return s.select("slug", "block", E.supported(a, b).alias("supported"), F.size(F.array_intersect(a, b)).cast("long").alias("shared"))


_PROPER = r"list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z]{3,}\b'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in E.NO_PLACES) + ") AND NOT (" + " OR ".join(f"regexp_matches(w, '(?i){p}')" for p in E.PLACES.values()) + "))"
_PLACES_SQL = f"list_concat({_named('text', E.PLACES)}, list_transform({_PROPER}, lambda w: 'proper-' || lower(w)))"


@query("fn_30_place_markers", "sentences", sql=f"SELECT slug, block, array_to_string(list_sort(list_distinct({_PLACES_SQL})), ',') AS markers FROM sentences")
def _(s):
    return s.select("slug", "block", _joined(E.place_markers(F.col("text"))).alias("markers"))


@query("fn_30_citizenship_markers", "sentences", sql=f"SELECT slug, block, array_to_string(list_sort(list_distinct(list_concat({_PLACES_SQL}, {_named('text', E.CITIZENSHIP)}))), ',') AS markers FROM sentences")
def _(s):
    return s.select("slug", "block", _joined(E.citizenship_markers(F.col("text"))).alias("markers"))


_NAMES = ["Acme Foundation", "Stanford University", "Northern Lights Organization", "The Company", "Summer Challenge Foundation Of Norway"]
_TOKENS = "list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in E.ENTITY_STOPS) + "))"


@query("fn_20_entity_name_appears", "sentences", sql=f"SELECT slug, block, len(a) > 0 AND len(list_filter(a, lambda w: list_contains(b, w))) >= greatest(1, ceil(len(a) * 0.75)) AS appears FROM (SELECT slug, block, {_TOKENS.format(_case('slug', _NAMES))} AS a, {_TOKENS.format('text')} AS b FROM sentences)")
def _(s):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("slug") % len(_NAMES) + 1).cast("int"))
    return s.select("slug", "block", E.entity_appears(name, F.col("text")).alias("appears"))


@query("flt_19_cycle_years", "sentences", sql=rf"SELECT slug, block FROM sentences WHERE NOT regexp_matches(text, '{E.EARLIER}') AND len(list_filter(regexp_extract_all(text, '\b(20\d{{2}})\b', 1), lambda y: y NOT IN ('2026', '2027'))) = 0")
def _(s):
    return s.filter(E.matches_cycle(F.col("text"), F.array(F.lit(2026), F.lit(2027)))).select("slug", "block")


@query("fn_35_grounding_tokens", "sentences", sql=f"""SELECT slug, block, array_to_string(list_filter(regexp_extract_all(text, '{E.CONCRETE}'), lambda t: NOT contains(replace(lower(basis), ',', ''), replace(lower(t), ',', ''))), ' ') AS tokens,
array_to_string(list_filter(regexp_extract_all(text, '{E.PROPER}'), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in E.COMMON_CAPITALS)}) AND NOT contains(lower(basis), lower(t))), ' ') AS names FROM sentences""")
def _(s):
    return s.select("slug", "block", F.array_join(E.unsupported_tokens(F.col("text"), F.col("basis")), " ").alias("tokens"), F.array_join(E.unsupported_names(F.col("text"), F.col("basis")), " ").alias("names"))


_P = r"regexp_extract(url, '(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$', %d)"
_SCHEME, _HOST, _PORT = f"lower({_P % 1})", f"lower({_P % 3})", f"CASE WHEN lower({_P % 1}) = 'https' AND {_P % 4} = '443' THEN '' ELSE {_P % 4} END"
_PATH = f"coalesce(nullif({_P % 5}, ''), '/')"
_PUBLIC = rf"({_SCHEME} IN ('http', 'https') AND {_PORT} = '' AND {_P % 2} = '' AND contains({_HOST}, '.') AND NOT regexp_matches({_HOST}, '(^|\.)(localhost|local|internal)$') AND {_HOST} <> '127.0.0.1')"
_SECRET = f"(contains(lower({_P % 6}), 'apikey') OR contains({_P % 7}, 'session_id'))"


@query("flt_14_public_url", "addresses", sql=f"SELECT page_id, {_PUBLIC} AS public FROM addresses")
def _(a):
    return a.select("page_id", U.is_public(F.col("url")).alias("public"))


@query("flt_15_sensitive_query", "addresses", sql=f"SELECT page_id, {_SECRET} AS sensitive FROM addresses")
def _(a):
    return a.select("page_id", U.is_sensitive(F.col("url")).alias("sensitive"))


@query("fn_15_canonical_or_rejected", "addresses", sql=rf"""SELECT page_id, CASE WHEN {_PUBLIC} AND NOT {_SECRET} THEN {_SCHEME} || '://' || {_HOST} || {_PATH} || CASE page_id % 7 WHEN 1 THEN '?Q=1' WHEN 4 THEN '?k=1' WHEN 5 THEN '?monkey=1' ELSE '' END END AS url FROM addresses""")
def _(a):
    return a.select("page_id", U.canonical(F.col("url")).alias("url"))


@query("fn_16_resource_key", "addresses", sql=f"SELECT page_id, {_SCHEME} || '://' || {_HOST} || ':' || CASE WHEN {_PORT} <> '' THEN {_PORT} WHEN {_SCHEME} = 'https' THEN '443' WHEN {_SCHEME} = 'http' THEN '80' ELSE '' END || {_PATH} || {_P % 6} AS resource FROM addresses")
def _(a):
    return a.select("page_id", U.resource_key(F.col("url")).alias("resource"))


@query("fn_38_typed_address", "addresses", sql=f"SELECT page_id, CASE WHEN {_SCHEME} IN ('http', 'https') AND {_P % 2} = '' AND contains({_HOST}, '.') THEN {_SCHEME} || '://' || {_HOST} || CASE WHEN {_PORT} = '' THEN '' ELSE ':' || {_PORT} END || {_PATH} || {_P % 6} || {_P % 7} END AS url FROM addresses")
def _(a):
    return a.select("page_id", U.typed_address(F.col("url")).alias("url"))


@query("flt_21_cache_bypass", "addresses", sql=f"SELECT page_id FROM addresses WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org'")
def _(a):
    return a.filter(U.host_matches(F.col("url"), ["example.org", "example.net"])).select("page_id")


@query("fn_19_path_identity", "addresses", sql="SELECT page_id, CASE WHEN page_id % 7 IN (1, 6) THEN 'x-y' END AS identity FROM addresses")
def _(a):
    return a.select("page_id", I.path_identity(F.col("url")).alias("identity"))


_STOPS = ", ".join(f"'{w}'" for w in I.STOPS)
_WORDS = f"list_filter(list_transform(string_split(trim(regexp_replace(lower({{}}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('fellow', 'fellows', 'fellowship', 'fellowships') THEN 'fellow' ELSE w END), lambda w: length(w) >= 3 AND w NOT IN ({_STOPS}))"


@query("fn_18_identity_words", "sentences", sql=f"SELECT slug, block, array_to_string({_WORDS.format('text')}, ' ') AS words FROM sentences")
def _(s):
    return s.select("slug", "block", F.array_join(I.words(F.col("text")), " ").alias("words"))


_GENERIC = ", ".join(f"'{w}'" for w in [*I.GENERIC_WORDS, *I.GENERIC_TITLES])


@query("fn_19_identity_match", "sentences", sql=f"""SELECT slug, block, CASE WHEN len(d) > 0 THEN broad OR len(list_intersect(d, e)) >= least(2, len(d)) WHEN len(a) = 1 THEN len(list_intersect(a, b)) = 1 ELSE broad END AS same FROM (
SELECT *, list_filter(a, lambda w: w NOT IN ({_GENERIC})) AS d, list_filter(b, lambda w: w NOT IN ({_GENERIC})) AS e, len(list_intersect(a, b)) >= greatest(2, ceil(len(a) * 0.75)) AS broad FROM (
SELECT slug, block, list_distinct({_WORDS.format('text')}) AS a, list_distinct({_WORDS.format('basis')}) AS b FROM sentences))""")
def _(s):
    a, b = (F.array_distinct(I.words(F.col(c))) for c in ("text", "basis"))
    return s.select("slug", "block", I.same_identity(a, b).alias("same"))
