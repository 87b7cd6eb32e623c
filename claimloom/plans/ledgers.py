"""Stages, attention, passages, cycles, scores and validation on the driver's tables: a Spark query and independent SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import identity as I
from claimloom.operators import attention as A
from claimloom.operators import cycles as C
from claimloom.operators import passages as P
from claimloom.operators import scoring as S
from claimloom.operators import stages as G
from claimloom.operators import validation as V
from claimloom.plans.carriers import VIEWS, query
from claimloom.plans.statements import SENTENCES, _case, _named

#: A card's records: line items, one for each number.
_LINES = "(SELECT l_orderkey AS slug, l_linenumber AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, CAST(min(l_quantity) AS INT) AS q, substr(CAST(min(l_shipdate) AS STRING), 1, 10) AS day FROM lineitem GROUP BY l_orderkey, l_linenumber) x"
_STATUS = _case("{}", ["disclosed", "conflicting", "unclear", "not_found", "not_applicable"])
_AREAS = ["cost", "deadline", "selection"]
_HEADLINES = ["Summer Challenge | Acme", "Acme Robotics Challenge — Home", "FAQ | Acme Robotics Challenge", "Northern Poetry Contest", "About us", "Privacy policy", "Robotics"]

VIEWS |= {
    "timings": f"SELECT slug, n AS place, concat(CAST(slug AS STRING), '-', CAST(n AS STRING)) AS claim_id, concat('s', CAST(n AS STRING)) AS stage_id, {_case('pk', ['application', 'application', 'interview', 'pitch'])} AS stage_kind, {_case('sk', ['deadline', 'decision', 'notification', 'starts', 'ends', 'opens', 'deadline'])} AS event, CASE WHEN q < 40 THEN 'date' ELSE 'month' END AS precision, CASE WHEN pk % 5 = 0 THEN 'estimated' ELSE 'stated' END AS certainty, CASE WHEN q < 40 THEN day ELSE substr(day, 1, 4) END AS display, day AS iso_date, "
    f"CASE WHEN q < 6 THEN 'v1' WHEN q < 9 THEN 'v2' END AS variant, CASE WHEN pk % 7 = 0 THEN concat('s', CAST(n AS STRING)) WHEN pk % 11 = 0 THEN 's99' END AS stage_scope, CASE WHEN sk % 13 = 0 THEN 'p1' END AS pathway FROM {_LINES}",
    "cycle_refs": "SELECT o_orderkey AS slug, " + ", ".join(f"CASE WHEN o_orderkey % {m} = 0 THEN concat(CAST(o_orderkey AS STRING), '-{k}') END AS {name}" for k, (name, m) in enumerate([("closes", 3), ("coverage_start", 5), ("opens", 4), ("coverage_end", 6)], 1)) + " FROM orders",
    "stage_claims": f"SELECT slug, n AS place, CAST(n AS STRING) AS claim_id, {_case('pk', ['duration', 'commitment', 'format', 'location'])} AS kind, concat({_case('pk', ['Lasts ', 'Takes ', 'Held ', 'In '])}, CAST(sk % 3 AS STRING)) AS display, CASE WHEN sk % 3 = 0 THEN 'Live sessions' ELSE 'Homework' END AS label, CASE WHEN q % 2 = 0 THEN 'week' ELSE 'day' END AS period, sk % 3 + 1 AS minimum, CASE WHEN q > 20 THEN sk % 3 + 4 END AS maximum, 'weeks' AS unit, {_case('sk', ['online', 'hybrid', 'in_person'])} AS format, CASE WHEN q < 5 THEN 'v1' END AS variant, CASE WHEN q > 47 THEN 's1' END AS stage_scope, CASE WHEN pk % 17 = 0 THEN 'p1' END AS pathway FROM {_LINES}",
    "process_stages": f"SELECT slug, concat('s', CAST(n AS STRING)) AS stage_id, sk % 3 AS stage_order, {_case('pk', ['application', 'orientation', 'pitch', 'program', 'travel'])} AS kind, concat({_case('sk', ['Apply online', 'Kickoff', 'Final Interview', 'Build week'])}, ' ', CAST(n AS STRING)) AS label, q % 9 = 0 AS has_rules FROM {_LINES}",
    "process_steps": f"SELECT slug, concat('p', CAST(pk % 2 AS STRING)) AS pathway_id, pk % 2 AS pathway_order, concat('Track ', CAST(pk % 2 AS STRING)) AS pathway_label, n AS step_order, concat('s', CAST(n AS STRING)) AS stage_id FROM {_LINES} WHERE slug % 3 = 0",
    "fact_fields": f"SELECT slug, {_case('n', ['estimated_total_mandatory_cost', 'application_deadline', 'tuition', 'refund_policy', 'institution_relationship', 'named_institution', 'end_date'])} AS field_id, {_STATUS.format('pk')} AS status FROM {_LINES}",
    "card_flags": "SELECT o_orderkey AS slug, o_orderkey % 4 = 0 AS costs_incomplete, o_orderkey % 3 > 0 AS cycle_modeled, o_orderkey % 5 = 0 AS selectivity_matters FROM orders",
    "attention_rows": f"SELECT slug, concat('i', CAST(pk % 9 AS STRING)) AS id, {_case('sk', ['cost', 'selection', 'selection', 'cycle'])} AS category, {_case('q', ['high', 'medium', 'low'])} AS priority, pk % 2 = 0 AS grounded, n AS place, {_case('pk', ['tuition', 'applicant_count', 'application_deadline', 'end_date', 'eligibility'])} AS field, CASE WHEN sk % 3 = 0 THEN concat('c', CAST(pk % 3 AS STRING)) END AS claim, CASE WHEN q % 4 = 0 THEN 'Acceptance rate missing' ELSE 'See site' END AS words FROM {_LINES}",
    "passage_rows": f"SELECT slug, (n - 1) % 3 AS source_index, n AS block_index, {_case('(pk + n)', SENTENCES)} AS text, CASE WHEN pk % 6 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, {_case('slug', ['Home', 'Summer Cohort', 'Spring challenge'])} AS title FROM {_LINES}",
    "page_titles": f"SELECT slug, n - 1 AS source_index, concat('https://acme.org', {_case('sk', ['/about', '/programs/robotics/faq', '/programs/poetry/rules', '/x', '/terms-of-use', '/challenge/robotics'])}) AS url, {_case('pk', _HEADLINES)} AS title, {_case('q', ['', 'Robotics Challenge 2027', 'Poetry Contest'])} AS heading FROM {_LINES}",
    "area_checks": f"SELECT slug, n AS field_id, {_case('n', _AREAS)} AS area, {_STATUS.format('pk')} AS proposed, {_STATUS.format('sk')} AS now, {_STATUS.format('slug')} AS checked FROM {_LINES}",
    "fact_rows": f"SELECT slug, n AS field_id, {_STATUS.format('pk')} AS status, CASE WHEN sk % 3 > 0 THEN 'v' END AS value, CASE WHEN sk % 4 > 0 THEN 'd' END AS display, CASE WHEN sk % 7 = 0 THEN 'n' END AS normalized, q % 3 AS n_sources, CASE pk % 3 WHEN 0 THEN 'calculated' WHEN 1 THEN 'source_stated' END AS claim_kind, pk % 4 = 0 AS calculated, CASE WHEN sk % 2 = 0 THEN 'why' END AS note, CASE WHEN q % 2 = 0 THEN 'x' END AS first_value, CASE WHEN q % 3 = 0 THEN 'x' WHEN q % 3 = 1 THEN 'y' END AS second_value, sk % 4 AS first_n, pk % 3 AS second_n FROM {_LINES}",
}


def _listed(*columns):
    return F.array_compact(F.array(*columns))


def _scoped(rows):
    return rows.withColumns({"scope_variants": _listed("variant"), "scope_stages": _listed("stage_scope"), "scope_pathways": _listed("pathway")})


_DIM = "CASE WHEN v AND p THEN 'program/cohort and stage/pathway' WHEN v THEN 'program/cohort' WHEN p THEN 'stage/pathway' ELSE 'source record' END"
_STATED = "CASE WHEN precision = 'date' AND certainty = 'stated' THEN iso_date END"
_CYCLE_DATES = " UNION ALL ".join(
    f"SELECT r.slug, '{field}' AS field_id, display, {_STATED} AS iso_date, {note} AS note, {rule} AS rule FROM cycle_refs r JOIN timings t ON r.slug = t.slug AND t.claim_id = {ref}"
    for field, ref, rule, note in [("application_deadline", "closes", "'cycle.closes'", "NULL"), ("start_date", "coalesce(coverage_start, opens)", "CASE WHEN coverage_start IS NULL THEN 'cycle.opens' ELSE 'cycle.coverage-start' END", "CASE WHEN coverage_start IS NULL THEN 'The cycle opening is used because no separate participation start was identified.' END"), ("end_date", "coverage_end", "'cycle.coverage-end'", "NULL")]
)


@query("prj_06_cycle_dates", "cycle_refs", "timings", sql=_CYCLE_DATES)
def _(refs, timings):
    return G.cycle_dates(refs, timings)


_DATES = f"""+ t AS (SELECT *, CASE event WHEN 'deadline' THEN 'application_deadline' WHEN 'decision' THEN 'decision_date' WHEN 'notification' THEN 'decision_date' WHEN 'starts' THEN 'start_date' WHEN 'ends' THEN 'end_date' END AS field_id FROM timings),
a AS (SELECT slug, list(stage_id) AS applying FROM timings WHERE stage_kind = 'application' GROUP BY slug),
k AS (SELECT t.*, CASE WHEN event = 'deadline' AND list_contains(applying, stage_scope) THEN NULL ELSE stage_scope END AS ss FROM t LEFT JOIN a USING (slug) WHERE field_id IS NOT NULL AND (event <> 'deadline' OR stage_kind = 'application')),
d AS (SELECT slug, event, field_id, string_agg(display, '; ' ORDER BY pos, display) AS listed, count(*) AS nd FROM (SELECT slug, event, field_id, display, min(place) AS pos FROM k GROUP BY ALL) GROUP BY ALL),
g AS (SELECT slug, event, field_id, bool_or(variant IS NOT NULL) AS v, bool_or(ss IS NOT NULL OR pathway IS NOT NULL) AS p, count(DISTINCT concat(variant, '|', ss, '|', pathway)) AS ns, count({_STATED}) AS days, min({_STATED}) AS day FROM k GROUP BY ALL),
s AS (SELECT slug, field_id, CASE WHEN nd = 1 AND NOT v AND NOT p THEN listed WHEN event = 'deadline' AND nd > 1 AND ns = 1 THEN 'Multiple application deadlines — see schedule' WHEN nd > 1 THEN 'Varies by ' || {_DIM} ELSE 'Scoped by ' || {_DIM} || ' — see details' END AS display,
CASE WHEN nd = 1 AND NOT v AND NOT p AND days = 1 THEN day END AS iso_date, CASE WHEN nd > 1 OR v OR p THEN listed END AS note, 'stages.' || event AS rule FROM d JOIN g USING (slug, event, field_id)),
w AS ({_CYCLE_DATES} UNION ALL SELECT * FROM s)
SELECT slug, field_id, display, iso_date, note, rule FROM (SELECT *, row_number() OVER (PARTITION BY slug, field_id ORDER BY coalesce(list_position(['stages.deadline', 'stages.decision', 'stages.notification', 'stages.starts', 'stages.ends'], rule), 0)) AS writer FROM w) WHERE writer = 1"""


@query("prj_07_dates", "cycle_refs", "timings", sql=_DATES)
def _(refs, timings):
    return G.dates(refs, _scoped(timings))


@query("prj_08_stage_fields", "stage_claims", sql=f"""+ k AS (SELECT *, unnest(list_filter([CASE WHEN kind = 'duration' THEN 'duration' END, CASE WHEN kind = 'commitment' AND period = 'week' THEN 'weekly_hours' END, CASE WHEN kind = 'commitment' AND label = 'Live sessions' THEN 'required_live_hours' END, CASE WHEN kind = 'format' THEN 'participation_format' END, CASE WHEN kind = 'location' THEN 'location' END], lambda x: x IS NOT NULL)) AS field_id,
CASE kind WHEN 'duration' THEN minimum || ' ' || unit WHEN 'commitment' THEN minimum || coalesce('-' || maximum, '') || ' a ' || period END AS own FROM stage_claims),
d AS (SELECT slug, field_id, string_agg(display, '; ' ORDER BY pos, display) AS listed, count(*) AS nd FROM (SELECT slug, field_id, display, min(place) AS pos FROM k GROUP BY ALL) GROUP BY ALL),
g AS (SELECT slug, field_id, count(*) AS n, bool_or(variant IS NOT NULL) AS v, bool_or(stage_scope IS NOT NULL OR pathway IS NOT NULL) AS p, min(own) AS own, count(DISTINCT format) AS nf, min(format) AS f FROM k GROUP BY ALL)
SELECT slug, field_id, CASE WHEN nd = 1 AND NOT v AND NOT p THEN listed WHEN nd > 1 THEN 'Varies by ' || {_DIM} ELSE 'Scoped by ' || {_DIM} || ' — see details' END AS display, CASE WHEN nd > 1 OR v OR p THEN listed END AS note,
CASE WHEN nd = 1 AND NOT v AND NOT p THEN CASE WHEN field_id = 'participation_format' THEN CASE WHEN nf = 1 THEN f END WHEN n = 1 THEN own END END AS normalized FROM d JOIN g USING (slug, field_id)""")  # fmt: skip
def _(claims):
    return G.stage_fields(_scoped(claims.withColumn("formats", _listed("format"))))


_KINDS = ", ".join(f"'{k}'" for k in G.SELECTION_KINDS)


@query("prj_13_selection_process", "process_stages", "process_steps", sql=rf"""+ z AS (SELECT * FROM process_stages WHERE kind IN ({_KINDS}) OR has_rules OR regexp_matches(label, '{G.SELECTION_WORDS}')),
r AS (SELECT slug, count(DISTINCT pathway_id) AS n FROM process_steps GROUP BY slug),
y AS (SELECT slug, pathway_id, pathway_order, pathway_label || ': ' || string_agg(label, ' → ' ORDER BY step_order) AS line FROM process_steps JOIN z USING (slug, stage_id) GROUP BY slug, pathway_id, pathway_order, pathway_label)
SELECT slug, string_agg(label, ' → ' ORDER BY stage_order, stage_id) AS display, NULL AS note FROM z WHERE slug NOT IN (SELECT slug FROM r) GROUP BY slug UNION ALL
SELECT slug, string_agg(line, '; ' ORDER BY pathway_order) AS display, CASE WHEN any_value(n) > 1 THEN 'The v2 pathway ledger preserves the branches rather than selecting one route.' ELSE 'The v2 pathway ledger defines the authoritative route; unrelated stages are not inserted into it.' END AS note FROM y JOIN r USING (slug) GROUP BY slug""")  # fmt: skip
def _(stages, steps):
    return G.selection_process(stages, steps)


@query("prj_18_rebuilt_conflicts", "fact_rows", sql="""SELECT slug, field_id, 'c' || second_n AS summary FROM fact_rows WHERE first_n = 1 AND NOT calculated UNION ALL
SELECT slug, field_id, coalesce(note, 'Reviewed structured claims conflict for ' || field_id || '.') AS summary FROM fact_rows WHERE status = 'conflicting' AND first_n = 2""")
def _(facts):
    conflicts = facts.filter("first_n = 1").select("slug", "field_id", F.concat(F.lit("c"), F.col("second_n").cast("string")).alias("summary"))
    return G.rebuilt_conflicts(conflicts, facts.select("slug", "field_id", F.col("calculated").alias("had_projection")), facts.filter("first_n = 2"))


_OF = "coalesce(max(status) FILTER (field_id = '{}'), 'not_found')"
_ATTENTION = {
    "mandatory-cost-incomplete": ("cost", "high", "total = 'unclear' OR tuition IN ('disclosed', 'conflicting') AND total = 'not_found' OR costs_incomplete"),
    "deadline-conflict": ("deadline", "high", "due = 'conflicting'"),
    "deadline-unresolved": ("deadline", "high", "due IN ('not_found', 'unclear')"),
    "refund-unresolved": ("refund", "high", "refund IN ('not_found', 'unclear') AND tuition IN ('disclosed', 'conflicting')"),
    "institution-relationship-unresolved": ("organization_relationship", "high", "tie IN ('not_found', 'unclear') AND named = 'disclosed'"),
    "selectivity-not-quantified": ("selection", "medium", "selectivity_matters"),
    "cycle-unresolved": ("cycle", "high", "NOT cycle_modeled AND due IN ('disclosed', 'conflicting')"),
}


@query("pipe_09_attention", "fact_fields", "card_flags", sql=f"""+ w AS (SELECT f.slug, {", ".join(f"{_OF.format(field)} AS {name}" for name, field in [("total", "estimated_total_mandatory_cost"), ("due", "application_deadline"), ("tuition", "tuition"), ("refund", "refund_policy"), ("tie", "institution_relationship"), ("named", "named_institution")])}, any_value(costs_incomplete) AS costs_incomplete, any_value(cycle_modeled) AS cycle_modeled, any_value(selectivity_matters) AS selectivity_matters
FROM card_flags f LEFT JOIN fact_fields d ON f.slug = d.slug GROUP BY f.slug) """ + " UNION ALL ".join(f"SELECT slug, '{name}' AS id, '{cat}' AS category, '{pri}' AS priority FROM w WHERE {cond}" for name, (cat, pri, cond) in _ATTENTION.items()))  # fmt: skip
def _(facts, cards):
    return A.deterministic(facts, cards).select("slug", "id", "category", "priority")


_MEASURE = "({0}.category = 'selection' AND ({0}.field = 'applicant_count' OR regexp_matches({0}.words, '" + A.MEASURE_WORDS + "')))"
_OVERLAP = f"y.id = o.id OR y.category = o.category AND (y.field = o.field OR coalesce(y.claim = o.claim, false) OR {_MEASURE.format('y')} AND {_MEASURE.format('o')})"


@query("win_12_overlap_dedupe", "attention_rows", sql=f"""+R o AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY list_position(['high', 'medium', 'low'], priority), list_position(['cost', 'selection', 'cycle'], category), NOT grounded, place) AS rn FROM attention_rows),
r AS (SELECT slug, rn, [struct_pack(id := id, category := category, field := field, claim := claim, words := words)] AS kept FROM o WHERE rn = 1
UNION ALL SELECT o.slug, o.rn, CASE WHEN len(list_filter(kept, lambda y: {_OVERLAP})) > 0 THEN kept ELSE list_append(kept, struct_pack(id := o.id, category := o.category, field := o.field, claim := o.claim, words := o.words)) END FROM r JOIN o ON o.slug = r.slug AND o.rn = r.rn + 1),
l AS (SELECT slug, arg_max(kept, rn) AS kept FROM r GROUP BY slug)
SELECT slug, generate_subscripts(kept, 1) AS rank, unnest(kept).id AS id FROM l""")
def _(rows):
    return A.deduplicate(rows.withColumns({"field_ids": _listed("field"), "claim_ids": _listed("claim")}))


@query("jn_18_attention_overlaps", "attention_rows", sql=f"SELECT o.slug, o.place AS a, y.place AS b FROM attention_rows o JOIN attention_rows y ON o.slug = y.slug AND o.place < y.place WHERE {_OVERLAP}")
def _(rows):
    item = rows.select("slug", F.struct("place", "id", "category", _listed("field").alias("field_ids"), _listed("claim").alias("claim_ids"), "words").alias("i"))
    pairs = item.withColumnRenamed("i", "x").join(item.withColumnRenamed("i", "y"), "slug").filter("x.place < y.place")
    return pairs.filter(A.overlap(F.col("x"), F.col("y"))).select("slug", F.col("x.place").alias("a"), F.col("y.place").alias("b"))


@query("flt_22_material_items", "attention_rows", "fact_fields", sql="SELECT a.slug, place FROM attention_rows a LEFT JOIN (SELECT slug, max(status) AS s FROM fact_fields WHERE field_id = 'end_date' GROUP BY slug) f ON a.slug = f.slug WHERE NOT (field = 'end_date' AND claim IS NULL AND coalesce(s, 'not_found') = 'not_found')")
def _(rows, facts):
    """Start and duration are disclosed for every card here."""
    cards = facts.select("slug").unionByName(rows.select("slug")).distinct()
    known = cards.select("slug", F.explode(F.array(F.lit("start_date"), F.lit("duration"))).alias("field_id"), F.lit("disclosed").alias("status"))
    items = rows.withColumns({"field_ids": _listed("field"), "claim_ids": _listed("claim")})
    return A.material(items, facts.filter("field_id = 'end_date'").unionByName(known)).select("slug", "place")


_SCORE = "CASE WHEN source_index = 0 THEN 2 ELSE 0 END + CASE WHEN length(text) BETWEEN 24 AND 1600 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN len(topics) = 1 THEN 1 ELSE 0 END + " + " + ".join(f"CASE WHEN topic = '{t}' AND regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for t, (p, n) in P.STRONG.items())


@query("win_07_topic_passages", "passage_rows", sql=f"""+ z AS (SELECT *, unnest(topics) AS topic FROM (SELECT *, {_named("text", E.TOPICS)} AS topics FROM passage_rows)),
y AS (SELECT *, {_SCORE} AS score FROM z), x1 AS (SELECT *, row_number() OVER (PARTITION BY slug, topic, source_index ORDER BY score DESC, block_index) AS nth FROM y)
SELECT slug, topic, place, source_index, block_index, score FROM (SELECT *, row_number() OVER (PARTITION BY slug, topic ORDER BY nth > 1, score DESC, source_index, block_index) AS place FROM x1) WHERE place <= 3""")
def _(blocks):
    return P.topic_passages(blocks)


@query("win_09_greedy_fill", "passage_rows", sql="""+R o AS (SELECT slug, block_index AS place, length(text) AS len, row_number() OVER (PARTITION BY slug ORDER BY block_index) AS rn FROM passage_rows),
r AS (SELECT slug, rn, place, CASE WHEN len <= 120 THEN len ELSE 0 END AS used, CASE WHEN len <= 120 THEN 1 ELSE 0 END AS kept, len <= 120 AS fits FROM o WHERE rn = 1
UNION ALL SELECT o.slug, o.rn, o.place, CASE WHEN used + len + (kept > 0)::INT <= 120 THEN used + len + (kept > 0)::INT ELSE used END, CASE WHEN used + len + (kept > 0)::INT <= 120 THEN kept + 1 ELSE kept END, used + len + (kept > 0)::INT <= 120 FROM r JOIN o ON o.slug = r.slug AND o.rn = r.rn + 1)
SELECT slug, place FROM r WHERE fits""")
def _(blocks):
    return P.greedy_fill(blocks.select("slug", F.col("block_index").alias("place"), F.length("text").alias("n_characters")), 120)


@query("win_10_equal_shares", "passage_rows", sql="""+ p AS (SELECT slug, source_index, sum(length(text))::BIGINT AS n FROM passage_rows GROUP BY ALL), s AS (SELECT *, least(n, 150 // count(*) OVER (PARTITION BY slug)) AS own FROM p),
l AS (SELECT *, 150 - sum(own) OVER (PARTITION BY slug) AS rest, coalesce(sum(n - own) OVER (PARTITION BY slug ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT slug, source_index, (own + greatest(0, least(n - own, rest - before)))::BIGINT AS share FROM l""")
def _(blocks):
    return P.equal_shares(blocks.groupBy("slug", "source_index").agg(F.sum(F.length("text")).alias("n_characters")), 150)


@query("txt_11_stage_payload", "passage_rows", sql=f"""+ c AS (SELECT *, (block_index < CASE WHEN source_index = 0 THEN 3 ELSE 2 END OR regexp_matches(text, '{P.STAGES["financial"]}'))::INT AS own FROM passage_rows),
k AS (SELECT *, max(own) OVER (PARTITION BY slug, source_index ORDER BY block_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS kept FROM c),
g AS (SELECT slug, source_index, coalesce(string_agg(text, chr(10) ORDER BY block_index) FILTER (kept = 1), '') AS text, sum(length(text) + 1) - 1 AS n FROM k GROUP BY ALL),
w AS (SELECT *, sum(length(text)) OVER (PARTITION BY slug) > 140 AS over_budget, 140 // count(*) OVER (PARTITION BY slug) AS share FROM g)
SELECT slug, source_index, CASE WHEN over_budget THEN substr(text, 1, share::INT) ELSE text END AS text, over_budget OR length(text) < n AS truncated FROM w""")
def _(blocks):
    return P.stage_payload(blocks, "financial", 140, (3, 2))


@query("txt_09_plain_blocks", "documents", sql=r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) - 1 AS block_index, line AS text FROM (SELECT doc_id, text, i, trim(regexp_replace(regexp_replace(l, '\r$', ''), '[\t\f\x0b ]+', ' ', 'g')) AS line FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> ''""")
def _(docs):
    return P.plain_blocks(docs.select("doc_id", "text"))


_GENERIC = ", ".join(f"'{w}'" for w in [*I.GENERIC_WORDS, *I.GENERIC_TITLES])
_STOPS = ", ".join(f"'{w}'" for w in I.STOPS)
_WORDS = f"list_filter(list_transform(string_split(trim(regexp_replace(lower({{}}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('fellow', 'fellows', 'fellowship', 'fellowships') THEN 'fellow' ELSE w END), lambda w: length(w) >= 3 AND w NOT IN ({_STOPS}))"
_TITLES = ", ".join(f"'{w}'" for w in I.GENERIC_TITLES)
_PATH = "CASE WHEN contains(url, 'robotics') THEN 'robotics' WHEN contains(url, 'poetry') THEN 'poetry' END"


@query("txt_10_source_relevance", "page_titles", sql=rf"""+ a AS (SELECT *, {_PATH} AS path, regexp_split_to_array(title, '\s+[|–—:]\s+') AS cut FROM page_titles),
b AS (SELECT *, CASE WHEN len(cut) > 1 AND len(list_filter({_WORDS.format("cut[1]")}, lambda w: w NOT IN ({_TITLES}))) = 0 THEN {_WORDS.format("cut[-1]")} ELSE {_WORDS.format("cut[1]")} END AS tw FROM a),
c AS (SELECT *, list_distinct(list_concat(tw, {_WORDS.format("heading")})) AS own FROM b),
q AS (SELECT slug, path AS root_path, list_distinct(list_concat(tw, CASE WHEN regexp_matches(heading, '{I.KIND}') THEN {_WORDS.format("heading")} ELSE [] END, CASE WHEN path IS NULL THEN [] ELSE [path] END)) AS targets FROM b WHERE source_index = 0),
d AS (SELECT *, list_filter(targets, lambda w: w NOT IN ({_GENERIC})) AS td, list_filter(own, lambda w: w NOT IN ({_GENERIC})) AS od, list_filter(tw, lambda w: w NOT IN ({_GENERIC})) AS wd, len(list_intersect(targets, own)) >= greatest(2, ceil(len(targets) * 0.75)) AS broad FROM c JOIN q USING (slug)),
e AS (SELECT *, CASE WHEN len(td) > 0 THEN broad OR len(list_intersect(td, od)) >= least(2, len(td)) WHEN len(targets) = 1 THEN len(list_intersect(targets, own)) = 1 ELSE broad END AS fits FROM d)
SELECT slug, source_index, CASE WHEN source_index = 0 THEN 'target' WHEN path <> root_path THEN 'sibling' WHEN fits OR path = root_path THEN 'target' WHEN len(wd) > 0 AND len(list_intersect(td, od)) = 0 AND regexp_matches(cut[1], '{I.KIND}') THEN 'sibling' WHEN regexp_matches(url, '(about|privacy|terms)') THEN 'organization_level' ELSE 'unclear' END AS relevance FROM e""")
def _(pages):
    return P.source_relevance(pages.withColumn("headings", F.array("heading"))).select("slug", "source_index", "relevance")


_ZIP = "list_zip(regexp_extract_all(x, '{0}', 1), regexp_extract_all(x, '{0}', 2))"
_SEASON = "CASE WHEN lower({0}) = 'autumn' THEN 'fall' ELSE lower({0}) END"
_NAME = "CASE WHEN lower({0}) = 'autumn' THEN 'Fall' ELSE upper(left({0}, 1)) || lower(substr({0}, 2)) END"


def _cand(label, start="NULL", end="NULL", year="NULL", season="NULL", kind="'other'", bonus="0"):
    return f"struct_pack(label := {label}, start_year := ({start})::INT, end_year := ({end})::INT, year := ({year})::INT, season := ({season})::VARCHAR, cycle_type := ({kind})::VARCHAR, bonus := ({bonus})::INT)"


_SHORT_END = "left(m[1], 2) || m[2]"
_WAIT = f"regexp_extract(x || ' ' || title, '(?i)\\b({C.SEASONS})\\b', 1)"
_BOTH = [f"regexp_extract(x, '{C.BOTH_YEARS}', {g})" for g in (1, 2, 3)]
_INFERRED = r"CASE WHEN regexp_matches(x || ' ' || title, '(?i)\b(?:challenge|competition)\b') THEN 'competition_cycle' WHEN regexp_matches(x || ' ' || title, '(?i)\bcohort\b') THEN 'cohort' ELSE 'other' END"
_FAMILIES = [
    f"CASE WHEN regexp_matches(x, '{C.BOTH_YEARS}') THEN [{_cand(f'''{_BOTH[0]} || ' application / ' || CASE WHEN {_BOTH[1]} = '' THEN '' ELSE {_NAME.format(_BOTH[1])} || ' ' END || {_BOTH[2]} || ' entry' ''', _BOTH[0], _BOTH[2], _BOTH[2], f'''nullif({_SEASON.format(_BOTH[1])}, '')''', bonus='8')}] ELSE [] END",
    f"CASE WHEN regexp_matches(x, '{C.PENDING}') THEN [{_cand(f'''CASE WHEN {_WAIT} = '' THEN '' ELSE {_NAME.format(_WAIT)} || ' ' END || regexp_extract(x, '{C.PENDING}', 1)''', year=f'''regexp_extract(x, '{C.PENDING}', 1)''', season=f'''nullif({_SEASON.format(_WAIT)}, '')''', kind=f'''CASE WHEN {_WAIT} = '' THEN inferred ELSE 'seasonal' END''', bonus='10')}] ELSE [] END",
    f"CASE WHEN regexp_matches(x, '{C.ROLLING}') THEN [{_cand('''CAST('Rolling admissions' AS VARCHAR)''', kind='''CAST('rolling' AS VARCHAR)''', bonus='5')}] ELSE [] END",
    f"[{_cand('''m[1] || '–' || m[2]''', 'm[1]', 'm[2]', kind='''CAST('academic_year' AS VARCHAR)''', bonus='2')} for m in {_ZIP.format(C.LONG_RANGE)} if NOT school AND m[2]::INT BETWEEN m[1]::INT AND m[1]::INT + 2]",
    f"[{_cand(f'''m[1] || '–' || {_SHORT_END}''', 'm[1]', _SHORT_END, kind='short_kind', bonus='3')} for m in {_ZIP.format(C.SHORT_RANGE)} if NOT school AND ({_SHORT_END})::INT BETWEEN m[1]::INT AND m[1]::INT + 2]",
    f"[{_cand(f'''{_NAME.format('m[1]')} || ' ' || m[2]''', year='m[2]', season=_SEASON.format('m[1]'), kind='''CAST('seasonal' AS VARCHAR)''', bonus='3')} for m in {_ZIP.format(C.SEASON_YEAR)}]",
    f"[{_cand(f'''{_NAME.format('m[2]')} || ' ' || m[1]''', year='m[1]', season=_SEASON.format('m[2]'), kind='of_cohort', bonus='3')} for m in {_ZIP.format(C.YEAR_SEASON)}]",
    f"[{_cand('''concat('Summer ', m[2])''', year='m[2]', season='''CAST('summer' AS VARCHAR)''', kind='''CAST('seasonal' AS VARCHAR)''', bonus='4')} for m in {_ZIP.format(C.MONTHS_YEAR)}]",
    f"[{_cand('m', year='m', kind='inferred')} for m in regexp_extract_all(x, '{C.CYCLE_YEAR}', 1)]",
    f"[{_cand('m', year='m', kind='inferred', bonus='strong')} for m in regexp_extract_all(x, '{C.YEAR}', 1) if NOT school AND regexp_matches(x, '{C.CURRENT}')]",
]
_BASE = f"CASE WHEN source_index = 0 THEN 8 ELSE 0 END + CASE kind WHEN 'heading' THEN 6 WHEN 'title' THEN 8 ELSE 0 END + CASE WHEN regexp_matches(x, '{C.ACTION}') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(x, '{C.PAST}') THEN 10 ELSE 0 END - CASE WHEN school THEN 8 ELSE 0 END - CASE WHEN regexp_matches(x, '{C.STATISTICS}') AND NOT regexp_matches(x, '{C.NO_STATISTICS}') THEN 4 ELSE 0 END"
_FOUND = f"""blocks AS (SELECT slug, source_index, block_index, kind, trim(text) AS x, title FROM passage_rows UNION ALL SELECT DISTINCT slug, source_index, -1, 'title', title, title FROM passage_rows),
flags AS (SELECT *, regexp_matches(x, '{C.SCHOOL_YEAR}') AS school, {_INFERRED} AS inferred, CASE WHEN regexp_matches(x, '(?i)\\b(?:academic|school)\\s+year\\b') THEN 'academic_year' ELSE {_INFERRED} END AS short_kind, CASE WHEN regexp_matches(x, '(?i)\\bcohort\\b') THEN 'cohort' ELSE 'seasonal' END AS of_cohort, CASE WHEN regexp_matches(x, '{C.CURRENT_STRONG}') THEN 3 ELSE 0 END AS strong FROM blocks),
every AS (SELECT slug, source_index, block_index, x AS excerpt, {_BASE} AS base, list_concat({", ".join(_FAMILIES)}) AS found FROM flags),
found AS (SELECT slug, source_index, block_index, excerpt, nth - 1 AS nth, c.label, c.start_year, c.end_year, c.year, c.season, c.cycle_type, base + c.bonus AS score FROM (SELECT *, unnest(found) AS c, generate_subscripts(found, 1) AS nth FROM every))"""


def _with_titles(blocks):
    titles = blocks.select("slug", "source_index", F.lit(-1).alias("block_index"), F.lit("title").alias("kind"), F.col("title").alias("text"), "title").distinct()
    return C.candidates(blocks.select(titles.columns).unionByName(titles))


@query("fn_36_cycle_candidates", "passage_rows", sql=f"+ {_FOUND} SELECT slug, source_index, block_index, nth, label, start_year, end_year, year, season, cycle_type, score FROM found")
def _(blocks):
    return _with_titles(blocks).drop("excerpt")


_RANKED = """first_of AS (SELECT *, min((source_index, block_index, nth)) OVER (PARTITION BY slug, label) AS first, row_number() OVER (PARTITION BY slug, label ORDER BY score DESC, source_index, block_index, nth) AS own FROM found),
ranks AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, first) AS rank FROM first_of WHERE own = 1)"""


@query("win_02_best_by_label", "passage_rows", sql=f"+ {_FOUND}, {_RANKED} SELECT slug, label, rank, score FROM ranks")
def _(blocks):
    return C.ranked(_with_titles(blocks)).select("slug", "label", "rank", "score")


_YEARS = "list_filter([{0}.year, {0}.start_year, {0}.end_year], lambda y: y IS NOT NULL)"
_FITS = f"(a.label = b.label OR NOT (a.cycle_type = 'rolling' OR b.cycle_type = 'rolling' OR coalesce(a.season <> b.season, false)) AND len(list_intersect({_YEARS.format('a')}, {_YEARS.format('b')})) > 0)"


@query("pipe_02_resolved_cycle", "passage_rows", sql=f"""+ {_FOUND}, {_RANKED},
clear AS (SELECT a.* FROM ranks a LEFT JOIN ranks b ON a.slug = b.slug AND b.rank = 2 WHERE a.rank = 1 AND a.score >= 4 AND NOT coalesce(NOT {_FITS} AND b.score >= a.score - 1, false)),
later AS (SELECT r.slug, arg_min((r.label, r.year, r.season), r.rank) AS nx FROM ranks r JOIN clear a ON a.slug = r.slug WHERE r.rank > 1 AND r.year = a.year + 1 AND r.season IS NOT NULL AND NOT regexp_matches(r.excerpt, '{C.PAST_CONTEXT}') AND NOT regexp_matches(r.excerpt, '{C.SCHOOL_YEAR}') AND regexp_matches(r.excerpt, '{C.ENTRY}') GROUP BY r.slug),
belong AS (SELECT a.slug, unnest({_YEARS.format('b')}) AS y FROM clear a JOIN found b ON a.slug = b.slug WHERE NOT regexp_matches(b.excerpt, '{C.PAST_CONTEXT}') AND NOT regexp_matches(b.excerpt, '{C.SCHOOL_YEAR}')
AND ({_FITS} OR regexp_matches(b.excerpt, '{C.LIFECYCLE}') AND len([1 for u in {_YEARS.format('b')} if len([1 for v in {_YEARS.format('a')} if abs(u - v) <= 1]) > 0]) > 0)),
listed AS (SELECT slug, string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR) AS years FROM belong GROUP BY slug)
SELECT a.slug, CASE WHEN nx IS NULL THEN label ELSE label || ' / ' || nx[1] || ' entry' END AS label, coalesce(years, '') AS years, CASE WHEN nx IS NULL THEN start_year ELSE coalesce(start_year, year) END AS start_year, coalesce(end_year, nx[2]) AS end_year, year, coalesce(season, nx[3]) AS season, cycle_type FROM clear a LEFT JOIN later USING (slug) LEFT JOIN listed USING (slug)""")  # fmt: skip
def _(blocks):
    return C.resolve(_with_titles(blocks)).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@query("agg_22_area_reconciliation", "area_checks", sql="""+ g AS (SELECT slug, area, any_value(checked) AS own, bool_or(proposed IN ('disclosed', 'conflicting')) AS ps, bool_or(proposed = 'unclear') AS pu, bool_or(proposed = 'not_applicable') AS pn, bool_or(now IN ('disclosed', 'conflicting')) AS rs, bool_or(now = 'unclear') AS ru, bool_or(now = 'not_applicable') AS rn, count(DISTINCT field_id) AS n_candidates, count(DISTINCT field_id) FILTER (now <> 'not_found') AS n_retained FROM area_checks GROUP BY ALL),
m AS (SELECT *, CASE WHEN ps THEN 'supported' WHEN pu THEN 'unclear' WHEN pn THEN 'not_applicable' ELSE own END AS model_status FROM g)
SELECT slug, area, model_status, CASE model_status WHEN 'not_found' THEN 'checked_not_found' WHEN 'supported' THEN CASE WHEN rs THEN 'retained' ELSE 'withheld' END WHEN 'unclear' THEN CASE WHEN ru THEN 'unclear' ELSE 'withheld' END ELSE CASE WHEN rn THEN 'not_applicable' ELSE 'withheld' END END AS status, n_candidates, n_retained FROM m""")
def _(rows):
    checks = rows.select("slug", "area", F.col("checked").alias("status")).distinct()
    return S.reconcile_areas(checks, rows.select("slug", "area", "field_id", F.col("proposed").alias("status")), rows.select("slug", "field_id", F.col("now").alias("status")))


def _claims_sql(expand: bool) -> str:
    one = "SELECT slug, field_id::VARCHAR AS claim, field_id, n_sources AS attachments FROM fact_rows WHERE status IN ('disclosed'{})"
    if not expand:
        return one.format(", 'conflicting'")
    return one.format("") + " UNION ALL SELECT slug, field_id || '#0' AS claim, field_id, first_n AS attachments FROM fact_rows WHERE status = 'conflicting' UNION ALL SELECT slug, field_id || '#1' AS claim, field_id, second_n AS attachments FROM fact_rows WHERE status = 'conflicting'"


def _counted(facts):
    return facts.withColumn("candidates", F.array("first_n", "second_n"))


@query("agg_14_claims_expanded", "fact_rows", sql=_claims_sql(True))
def _(facts):
    return S.claims_of(_counted(facts), True)


@query("agg_14_claims_by_fact", "fact_rows", sql=_claims_sql(False))
def _(facts):
    return S.claims_of(_counted(facts), False)


_CASES = "+ c AS (SELECT slug, count(*) AS claims, count(*) FILTER (value IS NOT NULL) AS correct, sum(n_sources) AS evidence, sum(CASE WHEN display IS NOT NULL THEN n_sources ELSE 0 END) AS evidence_correct FROM fact_rows WHERE status IN ('disclosed', 'conflicting') GROUP BY slug), t AS (SELECT slug, count(*) AS fields, count(*) FILTER (proposed = now AND field_id % 4 > 0) AS agreed, count(*) FILTER (proposed IN ('disclosed', 'conflicting')) AS supported FROM area_checks GROUP BY slug), s AS (SELECT t.slug, coalesce(claims, 0)::BIGINT AS claims, coalesce(correct, 0)::BIGINT AS correct, coalesce(evidence, 0)::BIGINT AS evidence, coalesce(evidence_correct, 0)::BIGINT AS evidence_correct, fields, agreed, supported FROM t LEFT JOIN c USING (slug)) "


def _scores(facts, checks):
    claims = S.claims_of(_counted(facts), False).join(facts.select("slug", "field_id", F.col("value").isNotNull().alias("correct"), F.col("display").isNotNull().alias("evidence_ok")), ["slug", "field_id"])
    truth, draft = (checks.select("slug", "field_id", F.col(c).alias("status")) for c in ("proposed", "now"))
    return S.case_scores(claims, truth, draft.filter("field_id % 4 > 0"))


@query("agg_11_case_scores", "fact_rows", "area_checks", sql=_CASES + "SELECT * FROM s")
def _(facts, checks):
    return _scores(facts, checks)


@query("snk_06_score_report", "fact_rows", "area_checks", sql=_CASES + "SELECT sum(correct) / sum(claims)::DOUBLE AS precision, sum(correct) / sum(supported)::DOUBLE AS recall, sum(agreed) / sum(fields)::DOUBLE AS status_agreement, sum(evidence_correct) / sum(evidence)::DOUBLE AS evidence_correctness FROM s")
def _(facts, checks):
    return S.report(_scores(facts, checks))


@query("agg_17_evidence_counts", "fact_rows", sql="SELECT slug, count(*) FILTER (status IN ('disclosed', 'conflicting') AND (claim_kind IS NOT NULL OR n_sources > 0)) AS supported, sum(CASE WHEN status = 'conflicting' THEN first_n + second_n ELSE n_sources END) AS evidence FROM fact_rows GROUP BY slug")
def _(facts):
    return S.evidence_counts(_counted(facts).withColumns({"candidates": F.col("candidates").cast("array<int>"), "has_claim": F.col("claim_kind").isNotNull()}))


@query("jn_21_resolved_urls", "page_titles", sql="+ a AS (SELECT DISTINCT slug, url FROM page_titles WHERE source_index % 2 = 0) SELECT p.slug, count(a.url) AS n_acquired, count(*) AS n_reviewed FROM page_titles p LEFT JOIN a ON p.slug = a.slug AND p.url = a.url GROUP BY p.slug")
def _(pages):
    return S.resolved_urls(pages.select("slug", "url"), pages.filter("source_index % 2 = 0"))


_ANY = "(value IS NOT NULL OR display IS NOT NULL OR normalized IS NOT NULL OR calculated)"
_N = "((first_value IS NOT NULL)::INT + (second_value IS NOT NULL)::INT)"
_RULES = {
    "disclosed_value": "status = 'disclosed' AND (value IS NULL OR display IS NULL)",
    "disclosed_sources": "status = 'disclosed' AND n_sources = 0",
    "disclosed_kind": "status = 'disclosed' AND claim_kind IS NULL",
    "conflict_values": f"status = 'conflicting' AND {_N} < 2",
    "conflict_top": f"status = 'conflicting' AND ({_ANY} OR claim_kind IS NOT NULL)",
    "conflict_distinct": "status = 'conflicting' AND first_value = second_value",
    "conflict_only": f"status <> 'conflicting' AND {_N} > 0",
    "absent_value": f"status IN ('not_found', 'not_applicable') AND ({_ANY} OR n_sources > 0 OR claim_kind IS NOT NULL)",
    "na_reason": "status = 'not_applicable' AND note IS NULL",
    "unclear_value": f"status = 'unclear' AND {_ANY}",
    "calculated_inputs": "claim_kind = 'calculated' AND NOT calculated",
    "calculation_kind": "calculated AND coalesce(claim_kind, '') <> 'calculated'",
}
_VIOLATIONS = " UNION ALL ".join(f"SELECT slug, 'facts.' || field_id AS path, {'''status || ' ' || ''' if name == 'absent_value' else ''}'{V.FACT_RULES[name]}' AS message FROM fact_rows WHERE {cond}" for name, cond in _RULES.items())


def _checked(facts):
    return V.fact_violations(facts.withColumn("candidates", _listed("first_value", "second_value")))


@query("pipe_15_fact_violations", "fact_rows", sql=_VIOLATIONS)
def _(facts):
    return _checked(facts)


@query("agg_23_issue_tally", "fact_rows", sql=f"SELECT path, message, count(*) AS n, count(DISTINCT slug) AS n_cards FROM ({_VIOLATIONS}) GROUP BY ALL")
def _(facts):
    return V.tally(_checked(facts))


@query("jn_03_unknown_scopes", "timings", "process_stages", sql="""SELECT slug, 'scope_stages' AS path, 'Scope references unknown record ' || stage_scope || '.' AS message FROM timings t WHERE stage_scope IS NOT NULL AND NOT EXISTS (SELECT 1 FROM process_stages p WHERE p.slug = t.slug AND p.stage_id = t.stage_scope)
UNION ALL SELECT slug, 'scope_variants' AS path, 'Scope references unknown record ' || variant || '.' AS message FROM timings WHERE variant = 'v2'""")
def _(timings, stages):
    rows = _scoped(timings)
    return V.unknown_scopes(rows, {"scope_stages": stages.select("slug", F.col("stage_id").alias("id")), "scope_variants": stages.select("slug", F.lit("v1").alias("id")).distinct()})


@query("jn_04_cycle_timings", "cycle_refs", "timings", sql="""+ r AS (SELECT slug, 'closes' AS role, closes AS claim_id, 'deadline' AS event FROM cycle_refs WHERE closes IS NOT NULL UNION ALL SELECT slug, 'opens', opens, 'opens' FROM cycle_refs WHERE opens IS NOT NULL)
SELECT r.slug, 'cycle.timingRefs.' || role AS path, 'Cycle timing must reference a disclosed ' || r.event || ' claim.' AS message FROM r LEFT JOIN timings t ON r.slug = t.slug AND r.claim_id = t.claim_id WHERE coalesce(t.event <> r.event, true)""")
def _(refs, timings):
    side = lambda role, event: refs.filter(f"{role} IS NOT NULL").select("slug", F.lit(role).alias("role"), F.col(role).alias("claim_id"), F.lit(event).alias("event"))
    return V.unmatched_timing(side("closes", "deadline").unionByName(side("opens", "opens")), timings)


@query("jn_05_unknown_claims", "cycle_refs", "timings", sql="SELECT r.slug, 'projectionRefs' AS path, 'Projection references unknown claim ' || coverage_end || '.' AS message FROM cycle_refs r WHERE coverage_end IS NOT NULL AND NOT EXISTS (SELECT 1 FROM timings t WHERE t.slug = r.slug AND t.claim_id = r.coverage_end)")
def _(refs, timings):
    return V.unknown(refs, "coverage_end", timings, "claim_id", "projectionRefs", "Projection references unknown claim")


@query("set_06_repeated_records", "process_steps", sql="SELECT DISTINCT slug, 'pathways' AS path, 'Structured record IDs must be globally unique within a card.' AS message FROM (SELECT slug FROM process_steps GROUP BY slug, pathway_id HAVING count(*) > 1)")
def _(steps):
    return V.duplicates(steps, "pathway_id", "pathways", "Structured record IDs must be globally unique within a card.")
