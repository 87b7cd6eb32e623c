"""Structured records on the driver's tables: a Spark query and independent SQL for each.

Every document is a card of 25 records (``structure_records``), whose claims cite passages of its text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import html
from claimloom.operators import metadata as M
from claimloom.operators import passages as P
from claimloom.operators import structures as R
from claimloom.operators import withholding as W
from claimloom.plans.carriers import VIEWS, query
from claimloom.plans.ledgers import _LINES
from claimloom.plans.statements import _case

_ID = "(SELECT doc_id AS slug, CAST(n_nationkey AS BIGINT) AS n, doc_id * 100 + n_nationkey AS record_id, (doc_id * 31 + n_nationkey * 17) % 97 AS h, text FROM documents JOIN nation ON n_nationkey < 25) d"
#: Family and slots of the records of a card, by number.
_RECORDS = [*[("organizations", "name kind")] * 3, *[("organizationRoles", "role")] * 3, *[("institutionRelationships", "assertion")] * 3, *[("variants", "definition notes")] * 4, *[("stages", "definition timings timings")] * 3, *[("pathways", "definition steps steps")] * 3, *[("costItems", "definition amount treatment")] * 3, *[("outcomes", "definition recipientScope amount")] * 2, ("cycle", "label status cycleType")]
_FAMILY, _SLOTS = (f"split_part('{','.join(r[i] for r in _RECORDS)}', ',', CAST(n + 1 AS INT))" for i in (0, 1))
_SLOT = f"nullif(split_part({_SLOTS}, ' ', CAST(slot_no + 1 AS INT)), '')"
_CLAIMS = f"(SELECT slug, n, h, text, family, record_id, record_id * 10 + slot_no AS claim_id, slot_no, {_SLOT} AS slot, CASE (h + 5 * slot_no) % 23 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'conflicting' ELSE 'disclosed' END AS status FROM (SELECT d.*, {_FAMILY} AS family, CAST(r_regionkey AS BIGINT) AS slot_no FROM {_ID} JOIN region ON r_regionkey < 3) AS b) AS c"
_TARGET = "CASE slot WHEN 'role' THEN slug * 100 + h % 4 WHEN 'assertion' THEN CASE WHEN h % 5 < 4 THEN slug * 100 + h % 4 END WHEN 'steps' THEN slug * 100 + 13 + (h + slot_no) % 4 WHEN 'treatment' THEN slug * 100 + 19 + h % 4 WHEN 'definition' THEN slug * 100 + 9 + h % 5 ELSE (slug * 100 + 13 + h % 3) * 10 + 1 + slot_no % 2 END"
_EDGE = "CASE slot WHEN 'role' THEN 'role' WHEN 'assertion' THEN 'relationship' WHEN 'steps' THEN 'step' WHEN 'treatment' THEN 'treatment' WHEN 'definition' THEN CASE family WHEN 'variants' THEN 'parent' ELSE 'pathway_variant' END ELSE 'timing' END"

VIEWS |= {
    "structure_records": f"SELECT slug, {_FAMILY} AS family, n AS place, record_id FROM {_ID}",
    "structure_claims": f"SELECT slug, family, record_id, slot, claim_id, status, h FROM {_CLAIMS} WHERE slot IS NOT NULL",
    "structure_refs": f"SELECT slug, record_id, claim_id, {_EDGE} AS edge, {_TARGET} AS target FROM {_CLAIMS} WHERE slot IN ('role', 'steps', 'treatment') OR (slot = 'assertion' AND status = 'disclosed') OR (slot = 'definition' AND (family = 'pathways' OR (family = 'variants' AND h % 3 > 0))) OR (family = 'cycle' AND slot_no < 3)",
    "structure_sources": f"SELECT slug, claim_id, CAST(r_regionkey AS BIGINT) AS candidate, slug AS source_id, CASE WHEN (h + slot_no) % 13 = 1 THEN 'held in 2026.' WHEN (h + slot_no) % 13 = 2 THEN 'Last year it was cold.' WHEN (h + r_regionkey) % 11 = 0 THEN concat(substr(text, 2, 24), ' zq') ELSE substr(text, CAST(1 + n + slot_no AS INT), 24) END AS excerpt FROM {_CLAIMS} JOIN region ON r_regionkey = 0 OR (r_regionkey < 3 AND status = 'conflicting') WHERE slot IS NOT NULL",
    "structure_texts": "SELECT doc_id AS source_id, concat(text, ' It is held in 2026. Last year it was cold.') AS text, CASE doc_id % 3 WHEN 1 THEN 2026 WHEN 2 THEN 2025 END AS year, CASE WHEN doc_id % 7 = 0 THEN 'sibling' WHEN doc_id % 7 = 1 THEN 'unclear' ELSE 'target' END AS relevance FROM documents",
    "structure_roles": f"SELECT l_orderkey AS slug, CAST(l_linenumber AS BIGINT) AS claim_id, {_case('l_partkey', [*R.ROLE_WORDS, 'other'])} AS role, CAST(l_suppkey AS BIGINT) AS organization_id, concat('It is ', {_case('l_suppkey', ['run by', 'managed by', 'administered by', 'sponsored by', 'funded by', 'held at', 'an academic course with our partner', 'on the platform of', 'told by'])}, ' ', CASE WHEN l_quantity < 10 THEN 'somebody' ELSE s_name END, '.') AS evidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "structure_names": "SELECT l_orderkey AS slug, CAST(l_suppkey AS BIGINT) AS organization_id, min(s_name) AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 10 > 0 GROUP BY l_orderkey, l_suppkey",
    "structure_ties": f"SELECT l_orderkey AS slug, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS record_id, CAST(l_linenumber AS BIGINT) AS claim_id, {_case('l_partkey', [*R.RELATIONSHIP_WORDS, 'unclear'])} AS type, {_case('l_suppkey', ['founders', 'mentors', 'staff', 'opportunity', 'organization'])} AS subject, CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey AS BIGINT) END AS organization_id, CASE WHEN l_suppkey % 8 = 0 THEN s_name END AS institution, concat({_case('l_quantity', ['It is not operated by', 'Operated by', 'Sponsored by', 'There is no partnership with', 'A partner of', 'Held at', 'Credit on a transcript of', 'No credit from', 'Founded by researchers of', 'Its mentors come from the college', 'Its staff is affiliated with', 'Independent of'])}, ' ', s_name, '.') AS evidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "structure_outcomes": f"SELECT l_orderkey AS slug, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS record_id, {_case('l_partkey', [*R.CASH_TYPES, 'project_budget', 'mentorship'])} AS type, {_case('l_suppkey', ['cash', 'cash', 'restricted_funding', 'in_kind', None])} AS nature, CASE WHEN l_quantity < 30 THEN 'Parts only' END AS restriction, {_case('l_quantity', ['individual', 'team', 'educator', None])} AS recipient FROM lineitem",
    "structure_cards": """SELECT l_orderkey AS slug, translate(concat('<"slug":"', CAST(l_orderkey AS STRING), '","facts":<"cost":<"claimId":"f","status":"disclosed","list":[<"sources":null,"status":"conflicting">]>>,"stages":<"status":"modeled","records":[', string_agg(record, ','), ']>>'), '<>', concat(chr(123), chr(125))) AS card
        FROM (SELECT l_orderkey, concat('<"id":"', CAST(l_linenumber AS STRING), '","definition":<"claimId":"c', CAST(l_linenumber AS STRING), '","status":"', CASE l_returnflag WHEN 'A' THEN 'disclosed' WHEN 'R' THEN 'conflicting' ELSE 'unclear' END, '","value":<"note":[[<"claimId":', CASE WHEN l_partkey % 3 = 0 THEN 'null' WHEN l_partkey % 3 = 1 THEN '7' ELSE '"n"' END, ',"status":"disclosed","facts":<"claimId":"in","status":"disclosed">>], ', CAST(l_suppkey AS STRING), ']>,"sources":[<"claimId":"s","status":"disclosed">],"conflictingValues":[<"claimId":"k","status":"disclosed">]>,"timings":[', CASE WHEN l_quantity < 25 THEN '<"claimId":"t","status":"disclosed">,<"sources":[],"status":"conflicting">' ELSE '' END, ']>') AS record FROM lineitem) AS r GROUP BY l_orderkey""",
}


@query("agg_03_nested_claims", "structure_cards", sql=r"""+ t AS (SELECT slug, j.value, j.fullkey FROM structure_cards, LATERAL (SELECT value, fullkey FROM json_tree(card) WHERE type = 'OBJECT') j),
o AS (SELECT slug, fullkey, json_type(value, '$.claimId') AS kind, json_exists(value, '$.claimId') OR json_exists(value, '$.sources') AS cited, value->>'$.status' AS status FROM t WHERE NOT regexp_matches(fullkey, '\.(sources|conflictingValues)(\.|\[|$)'))
SELECT slug, count(*) FILTER (kind = 'VARCHAR' AND status = 'disclosed' AND NOT regexp_matches(fullkey, '\.facts(\.|\[|$)')) AS n_claims, count(*) FILTER (cited AND status IN ('disclosed', 'conflicting')) AS n_candidates FROM o GROUP BY slug""")
def _(cards):
    return R.claim_counts(cards)


_WARNINGS = r"""t AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS plain FROM structure_texts),
s AS (SELECT s.*, c.family, t.plain, t.year, t.relevance, lower(trim(regexp_replace(excerpt, '\s+', ' ', 'g'))) AS e FROM structure_sources s JOIN structure_claims c ON s.slug = c.slug AND s.claim_id = c.claim_id LEFT JOIN t ON s.source_id = t.source_id),
w AS (SELECT slug, family, claim_id, source_id, 'excerpt_not_found' AS rule FROM s WHERE NOT coalesce(e <> '' AND contains(plain, e), false)
UNION ALL SELECT DISTINCT slug, family, claim_id, NULL, 'other_opportunity' FROM s WHERE candidate = 0 AND family <> 'organizations' AND NOT (relevance = 'target' OR (relevance = 'unclear' AND coalesce(excerpt = 'held in 2026.', false)))
UNION ALL SELECT DISTINCT slug, family, claim_id, NULL, 'outside_cycle' FROM s WHERE candidate = 0 AND family NOT IN ('organizations', 'organizationRoles', 'institutionRelationships') AND year IS NOT NULL AND ((excerpt = 'held in 2026.' AND year <> 2026) OR excerpt = 'Last year it was cold.' OR regexp_matches(excerpt, '(?i)\b(last year|previous year|prior year|historical|earlier cohort|past cohort)\b') OR len(list_filter(regexp_extract_all(excerpt, '\b20\d{2}\b'), lambda y: y::INT <> year)) > 0)
UNION ALL SELECT slug, family, claim_id, NULL, 'not_applicable' FROM structure_claims WHERE status = 'not_applicable'
UNION ALL SELECT slug, family, claim_id, NULL, 'value_not_in_excerpt' FROM structure_claims WHERE h % 29 = 3)"""


def _warned(claims, sources, texts):
    claims = claims.withColumn("failure", F.when(F.col("h") % 29 == 3, "value_not_in_excerpt"))
    return R.evidence_warnings(claims, sources, texts, P.supports_target(F.col("relevance"), F.lit(False), F.array(F.lit("held"), F.lit("2026")), F.col("excerpt")))


@query("pipe_07_evidence_warnings", "structure_claims", "structure_sources", "structure_texts", sql="+ " + _WARNINGS + " SELECT * FROM w")
def _(claims, sources, texts):
    return _warned(claims, sources, texts)


def _lost(edges: str, targets: str, name: str) -> str:
    return f"{name} AS (SELECT r.* FROM structure_refs r WHERE edge IN ({edges}) AND NOT EXISTS (SELECT 1 FROM {targets} x WHERE x.slug = r.slug AND x.record_id = r.target))"


_OF = lambda name, family: f"{name} AS (SELECT slug, family, record_id FROM k WHERE family = '{family}')"
_LESS = lambda name, rows, lost: f"{name} AS (SELECT * FROM {rows} x WHERE NOT EXISTS (SELECT 1 FROM {lost} l WHERE l.slug = x.slug AND l.record_id = x.record_id))"
_REQUIRED = " OR ".join(f"(family = '{f}' AND slot IN ({', '.join(repr(s) for s in slots)}))" for f, slots in R.REQUIRED.items())
_PRUNE = ", ".join([
    f"k AS (SELECT slug, family, record_id FROM structure_records r WHERE NOT EXISTS (SELECT 1 FROM structure_claims c JOIN bad USING (slug, claim_id) WHERE c.slug = r.slug AND c.record_id = r.record_id AND ({_REQUIRED})))",
    "live AS (SELECT c.* FROM structure_claims c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.slug = c.slug AND b.claim_id = c.claim_id))",
    _OF("org", "organizations"), _OF("v0", "variants"), _OF("st", "stages"), _OF("p0", "pathways"), _OF("co", "costItems"),
    "b0 AS (SELECT slug, family, record_id FROM k WHERE family IN ('organizationRoles', 'institutionRelationships'))",
    _lost("'role', 'relationship'", "org", "l0"), _LESS("b1", "b0", "l0"),
    _lost("'parent'", "v0", "l1"), _LESS("v1", "v0", "l1"), _lost("'parent'", "v1", "l2"), _LESS("v2", "v1", "l2"),
    _lost("'pathway_variant'", "v2", "l3"), _LESS("p1", "p0", "l3"),
    "step AS (SELECT r.* FROM structure_refs r JOIN live USING (slug, claim_id) JOIN st ON st.slug = r.slug AND st.record_id = r.target WHERE edge = 'step')",
    "p2 AS (SELECT * FROM p1 WHERE (slug, record_id) IN (SELECT slug, record_id FROM step))",
    "kept AS (SELECT * FROM k WHERE family NOT IN ('organizationRoles', 'institutionRelationships', 'variants', 'pathways') UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM p2)",
    _lost("'treatment'", "co", "l4"),
    "stay AS (SELECT live.* FROM live JOIN kept USING (slug, record_id) WHERE (slot <> 'steps' OR (live.slug, claim_id) IN (SELECT slug, claim_id FROM step)) AND (slot <> 'treatment' OR (status = 'disclosed' AND (live.slug, claim_id) NOT IN (SELECT slug, claim_id FROM l4))))",
    "timed AS (SELECT r.slug, r.record_id, r.target FROM structure_refs r JOIN kept USING (slug, record_id) JOIN stay s ON s.slug = r.slug AND s.claim_id = r.target AND s.slot = 'timings' WHERE edge = 'timing')",
    "found AS (SELECT slug, family AS kind, record_id AS id FROM kept UNION ALL SELECT slug, slot, claim_id FROM stay UNION ALL SELECT slug, 'timing', target FROM timed)",
])


def _found(left: R.Pruned):
    claims = left.claims.select("slug", F.col("slot").alias("kind"), F.col("claim_id").alias("id"))
    return left.records.select("slug", F.col("family").alias("kind"), F.col("record_id").alias("id")).unionByName(claims).unionByName(left.timings.select("slug", F.lit("timing").alias("kind"), F.col("target").alias("id")))


@query("jn_20_cascade_prune", "structure_records", "structure_claims", "structure_refs", sql=f"+ bad AS (SELECT slug, claim_id FROM structure_claims WHERE h % 13 = 0), {_PRUNE} SELECT * FROM found")
def _(records, claims, refs):
    return _found(R.prune(records, claims, refs, claims.filter("h % 13 = 0")))


@query("pipe_07_pruned_structures", "structure_records", "structure_claims", "structure_refs", "structure_sources", "structure_texts", sql=f"+ {_WARNINGS}, bad AS (SELECT DISTINCT slug, claim_id FROM w), {_PRUNE} SELECT * FROM found")
def _(records, claims, refs, sources, texts):
    return _found(R.prune(records, claims, refs, _warned(claims, sources, texts)))


def _pattern(of: dict[str, str], key: str, text: str) -> str:
    return f"CASE {key} " + " ".join("WHEN '{}' THEN regexp_matches({}, '{}')".format(k, text, v.replace("'", "''")) for k, v in of.items()) + " END"


@query("pipe_07_unbound_roles", "structure_roles", "structure_names", sql=f"SELECT r.slug, claim_id FROM structure_roles r LEFT JOIN structure_names n ON r.slug = n.slug AND r.organization_id = n.organization_id WHERE NOT (coalesce({_pattern(R.ROLE_WORDS, 'role', 'lower(evidence)')}, true) AND coalesce(contains(lower(evidence), lower(name)), false))")
def _(roles, names):
    return R.unbound_roles(roles, names)


@query("pipe_07_unbound_relationships", "structure_ties", "structure_names", sql=f"SELECT r.slug, claim_id FROM structure_ties r LEFT JOIN structure_names n ON r.slug = n.slug AND r.organization_id = n.organization_id WHERE NOT (coalesce({_pattern(R.RELATIONSHIP_WORDS, 'type', 'lower(evidence)')} AND NOT coalesce({_pattern(R.DENIALS, 'type', 'lower(evidence)')}, false), true) AND coalesce(contains(lower(evidence), lower(CASE WHEN r.organization_id IS NULL THEN institution ELSE name END)), false))")
def _(ties, names):
    return R.unbound_relationships(ties, names)


@query("pipe_15_outcome_faults", "structure_outcomes", sql="""SELECT slug, record_id, 'cash outcomes need a disclosed cash classification' AS message FROM structure_outcomes WHERE (type LIKE '%_cash_prize' OR type = 'stipend') AND nature IS DISTINCT FROM 'cash'
UNION ALL SELECT slug, record_id, 'project budgets are restricted funding' FROM structure_outcomes WHERE type = 'project_budget' AND nature IS DISTINCT FROM 'restricted_funding'
UNION ALL SELECT slug, record_id, 'project budgets need a use restriction' FROM structure_outcomes WHERE type = 'project_budget' AND restriction IS NULL
UNION ALL SELECT slug, record_id, type || ' needs recipient ' || w FROM (SELECT *, CASE type WHEN 'personal_cash_prize' THEN 'individual' WHEN 'team_cash_prize' THEN 'team' WHEN 'educator_cash_prize' THEN 'educator' END AS w FROM structure_outcomes) WHERE recipient <> w""")
def _(outcomes):
    return R.outcome_faults(outcomes)


@query("pipe_15_relationship_faults", "structure_ties", sql="""SELECT slug, record_id, type || ' needs subject ' || split_part(type, '_', 1) AS message FROM structure_ties WHERE type LIKE '%_affiliated_with' AND subject <> split_part(type, '_', 1)
UNION ALL SELECT slug, record_id, subject || ' can only carry ' || subject || '_affiliated_with' FROM structure_ties WHERE subject IN ('founders', 'mentors', 'staff') AND type NOT IN (subject || '_affiliated_with', 'unclear', 'other')""")
def _(ties):
    return R.relationship_faults(ties)


def _salvage_sql() -> str:
    """Family after family; a record of the carrier has at most one reference to its own family."""
    parts = [
        "f AS (SELECT slug, family, place, record_id, (slug * 7 + place * 5) % 41 = 0 OR (place = 24 AND slug % 4 = 0) AS bad FROM structure_records)",
        "r AS (SELECT DISTINCT slug, record_id, target FROM structure_refs WHERE edge <> 'timing' AND slug % 5 > 0)",
        "broken AS (SELECT slug FROM f WHERE bad UNION SELECT r.slug FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.slug = r.slug AND f.record_id = r.target))",
        "t0 AS (SELECT slug, family, place, record_id FROM f WHERE slug NOT IN (SELECT slug FROM broken))",
        "rest AS (SELECT * FROM f WHERE slug IN (SELECT slug FROM broken))",
    ]
    for i, family in enumerate(R.FAMILIES, 1):
        more = "" if family == "cycle" else f" UNION SELECT o.slug, o.family, o.place, o.record_id FROM o{i} o WHERE NOT bad AND NOT EXISTS (SELECT 1 FROM n{i} n WHERE n.slug = o.slug AND n.record_id = o.record_id)"
        parts += [
            f"o{i} AS (SELECT * FROM rest WHERE family = '{family}')",
            f"n{i} AS (SELECT r.* FROM r JOIN o{i} USING (slug, record_id) WHERE NOT EXISTS (SELECT 1 FROM t{i - 1} t WHERE t.slug = r.slug AND t.record_id = r.target))",
            f"x{i} AS (SELECT slug FROM o{i} WHERE bad UNION SELECT slug FROM n{i} n WHERE NOT EXISTS (SELECT 1 FROM o{i} o WHERE o.slug = n.slug AND o.record_id = n.target))",
            f"base{i} AS (SELECT slug, family, place, record_id FROM o{i} WHERE slug NOT IN (SELECT slug FROM x{i}){more})",
            f"g{i} AS (SELECT * FROM base{i} UNION SELECT o.slug, o.family, o.place, o.record_id FROM g{i} g JOIN n{i} n ON n.slug = g.slug AND n.target = g.record_id JOIN o{i} o ON o.slug = n.slug AND o.record_id = n.record_id WHERE NOT o.bad AND o.family <> 'cycle' AND (SELECT count(*) FROM n{i} m WHERE m.slug = o.slug AND m.record_id = o.record_id) = 1)",
            f"t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT * FROM g{i})",
        ]
    last = len(R.FAMILIES)
    parts.append(f"lost AS (SELECT slug, family, place, record_id FROM rest WHERE (slug, record_id) NOT IN (SELECT slug, record_id FROM t{last}))")
    return "+R " + ", ".join(parts) + f"""
SELECT *, NULL AS problem FROM t{last} UNION ALL SELECT *, CASE family WHEN 'cycle' THEN 'family withheld' ELSE 'record withheld' END FROM lost
UNION ALL SELECT DISTINCT slug, family, NULL::BIGINT, NULL::BIGINT, 'family withheld' FROM lost WHERE family <> 'cycle' AND (slug, family) NOT IN (SELECT slug, family FROM t{last})"""


@query("pipe_08_family_salvage", "structure_records", "structure_refs", sql=_salvage_sql())
def _(records, refs):
    faulty = records.filter("(slug * 7 + place * 5) % 41 = 0 OR (place = 24 AND slug % 4 = 0)")
    taken, warnings = R.salvage(records, refs.filter("edge <> 'timing' AND slug % 5 > 0"), faulty)
    return taken.withColumn("problem", F.lit(None).cast("string")).unionByName(warnings)


#: Pages with JSON-LD about themselves: a graph of questions and a course, behind a comment, a script that quotes one, and a malformed one.
_GRAPH = """<"@graph":[<"@type":"FAQPage","mainEntity":[<"@type":["Question","Thing"],"name":" Question  ', n, ' ","acceptedAnswer":<"@type":"Answer","text":"Answer at /', n, '">>,<"@type":"Question","name":"QUESTION ', n, '","acceptedAnswer":[<"@type":"Answer","text":7>,<"@type":"Answer","text":"Ask twice">]>]>,<"@type":"Course","name":"Course ', n, '","description":"', CASE WHEN page_id % 5 = 0 THEN repeat('long words ', 5000) ELSE 'Short words' END, '","duration":"P', n, 'W","provider":<"@type":"Organization","name":"School ', n, '">,"offers":[<"@type":"Offer","price":"', n, '0","priceCurrency":"USD">,<"@type":"Offer","price":30,"priceCurrency":"usd">]>,<"@type":"Organization","name":"ask TWICE">]>"""
VIEWS["ld_pages"] = f"""SELECT page_id, url, replace(html, '</head>', CASE page_id % 3 WHEN 0 THEN '<!-- <script type="application/ld+json">["no"]</script> --></head>' ELSE concat('<!-- ', script, ' --><script>var s = 1;</script>', CASE page_id % 3 WHEN 1 THEN script ELSE concat('<script type=''application/ld+json''>no json</script>', replace(script, '"application/ld+json"', 'application/ld+json id="x"')) END, '</head>') END) AS html
FROM (SELECT page_id, concat('https://ld.example.org/p', n) AS url, html, concat('<script type="application/ld+json">', translate(concat('{_GRAPH}'), '<>', concat(chr(123), chr(125))), '</script>') AS script FROM (SELECT page_id, CAST(page_id AS STRING) AS n, html FROM pages) AS p) AS q"""


@query("txt_03_json_ld", "ld_pages", sql="""+ b AS (SELECT 'page-' || substr(sha256('https://ld.example.org/p' || page_id), 1, 16) AS page_id, page_id % 5 = 0 AS big, page_id::VARCHAR AS n FROM pages WHERE page_id % 3 > 0),
t AS (SELECT page_id, unnest([{'i': 0, 'kind': 'heading', 'text': 'Question ' || n}, {'i': 1, 'kind': 'paragraph', 'text': 'Answer at /' || n}, {'i': 2, 'kind': 'paragraph', 'text': 'Ask twice'}, {'i': 3, 'kind': 'heading', 'text': 'Course ' || n}, {'i': 4, 'kind': 'paragraph', 'text': CASE WHEN big THEN NULL ELSE 'Short words' END}, {'i': 5, 'kind': 'definition', 'text': 'P' || n || 'W'}, {'i': 6, 'kind': 'definition', 'text': 'School ' || n}, {'i': 7, 'kind': 'definition', 'text': n || '0'}, {'i': 8, 'kind': 'definition', 'text': 'USD'}]) AS x FROM b)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY x.i) - 1)::INT AS place, x.kind AS kind, x.text AS text FROM t WHERE x.text IS NOT NULL""")
def _(pages):
    return M.json_ld_blocks(pages)


@query("txt_08_page_text", "ld_pages")
def _(pages):
    opened = html.parse_pages(pages).select("page_id", F.posexplode("blocks").alias("block_index", "b")).select("page_id", "block_index", "b.*")
    return html.cap_characters(M.with_metadata(html.first_prose(opened), M.json_ld_blocks(pages)))


_WITHHOLDABLE = ["operating_organization", "organization_type", "institution_relationship", "relationship_explanation", "location", "cancellation_policy", "data_sharing", "mentorship", "grade_levels", "cash_award", "estimated_total_mandatory_cost", "duration", *W.CYCLE_FIELDS]
_SAID = [
    "The challenge is run by Acme", "Acme is a great place", "Our founders studied at Lake College", "The program has a partner among alumni of Lake College", "Our headquarters are in Boston", "The office is open and the event is held online",
    "The sponsor may amend the rules", "The organizer may cancel; a participant gets a refund", "We may expel a student at any time", "We may remove a student who withdrawal rules cover", "Data go to a judge and a consultant", "Volunteer to judge or mentor teams",
    "Volunteer mentors: every student is matched with support", "Our programs serve middle school youth", "Programs for middle school; eligibility is open", "The top three teams win", "Several prizes are given", "It starts in June 2027", "Last year 40 were admitted", "Applications close in 2026",
]
VIEWS["context_facts"] = f"SELECT slug, {_case('(slug * 3 + n)', _WITHHOLDABLE)} AS field_id, CASE WHEN q % 7 = 0 THEN 'conflicting' WHEN q % 11 = 0 THEN 'unclear' ELSE 'disclosed' END AS status, CASE WHEN q % 2 = 0 THEN 'Shared with judges' ELSE 'Service providers only' END AS value, CASE WHEN pk % 13 = 0 THEN 'the number is not in it' END AS failure, CASE WHEN pk % 17 = 0 THEN 'The excerpt is on another subject.' END AS scope, CASE WHEN sk % 3 = 0 THEN 'As seen.' END AS note, {_case('pk', _SAID)} AS first_said, {_case('(pk + sk * 7)', _SAID)} AS then_said, sk % 9 > 0 AS fits, q % 5 AS n_said FROM {{}}"
VIEWS["context_facts"] = VIEWS["context_facts"].format(_LINES)
VIEWS["context_cards"] = "SELECT o_orderkey AS slug, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 'Summer 2026' END AS cycle_label, o_orderkey % 5 > 0 AS cycle_modeled, o_orderkey % 2 = 0 AS extended, o_orderkey % 3 = 0 AS variants_modeled, o_orderkey % 7 < 4 AS costs_complete, CAST(o_orderkey % 3 AS INT) AS cash_outcomes FROM orders"
VIEWS["fee_candidates"] = f"SELECT slug, n AS place, CASE WHEN q % 6 = 0 THEN NULL WHEN n % 2 = 0 THEN '50' ELSE '1,075' END AS value, CASE WHEN n % 2 = 0 THEN 'USD 50 early action' WHEN q % 9 = 0 THEN 'EUR or USD' ELSE 'USD 1,075 regular decision' END AS display, CASE WHEN q % 4 = 0 THEN CASE WHEN n % 2 = 0 THEN 50 ELSE 1075 END END AS amount, CASE WHEN q % 4 = 0 THEN 'USD' END AS currency, CASE WHEN q = 7 THEN 'q' ELSE 'p' END AS id, CASE slug % 4 WHEN 0 THEN 'Pay USD 50 for early action or USD 1,075 for regular decision.' WHEN 1 THEN 'Pay  USD 50 for tier one or  USD 1,075 for tier two' WHEN 2 THEN 'Pay USD 50 and USD 1,075 for the track' ELSE 'The fee varies by cohort: USD 50, USD 1,000' END AS excerpt, pk % 23 = 0 AS twice FROM {_LINES}"


def _withhold_sql() -> str:
    """A fact's first rule by number; the explanation goes at the affiliation's turn, if both are still there."""
    m = lambda p: "regexp_matches(said, '{}')".format(p.replace("'", "''").replace(r"’", "’"))
    fields = ", ".join(repr(f) for f in W.CYCLE_FIELDS)
    off = "regexp_matches(x, '(?i)\\b(last year|previous year|prior year|historical|earlier cohort|past cohort)\\b') OR len(list_filter(regexp_extract_all(x, '\\b20\\d{2}\\b'), lambda y: y <> '2026')) > 0"
    cases = [
        ("typed_value", "failure IS NOT NULL"), ("subject_scope", "scope IS NOT NULL"), ("other_opportunity", "NOT fits AND n > 0 AND field_id NOT IN ('operating_organization', 'organization_type')"),
        ("other_year", f"field_id IN ({fields}) AND cycle_label IS NOT NULL AND len(list_filter(excerpts, lambda x: {off})) > 0"),
        ("operator", f"d AND field_id = 'operating_organization' AND NOT {m(W.OPERATES)}"),
        ("affiliation", f"d AND field_id = 'institution_relationship' AND {m(W.PERSONS)} AND len(list_filter(excerpts, lambda x: regexp_matches(lower(x), '{W.PROGRAM_TIE}'))) = 0"),
        ("office", f"d AND field_id = 'location' AND {m(W.OFFICE)} AND NOT {m(W.TAKES_PART)}"),
        ("organizer_cancels", f"d AND field_id = 'cancellation_policy' AND {m(W.ORGANIZER_CANCELS)} AND NOT {m(W.PARTICIPANT_CANCELS)}"),
        ("removal", f"d AND field_id = 'cancellation_policy' AND {m(W.REMOVAL)} AND NOT {m(W.REFUND)}"),
        ("sharing", "d AND field_id = 'data_sharing' AND CASE WHEN value LIKE '%judge%' THEN NOT contains(said, 'judge') ELSE NOT contains(said, 'service provider') END"),
        ("volunteers", f"d AND field_id = 'mentorship' AND {m(W.VOLUNTEERS)} AND NOT {m(W.MENTORED)}"),
        ("broad_audience", f"d AND field_id = 'grade_levels' AND {m(W.BROAD_AUDIENCE)} AND NOT {m(W.ELIGIBLE)}"),
        ("no_cycle", f"field_id IN ({fields}) AND NOT cycle_modeled"), ("no_variant", "field_id = 'duration' AND extended AND NOT variants_modeled"),
        ("no_inventory", "d AND field_id = 'estimated_total_mandatory_cost' AND NOT costs_complete"), ("prize_matrix", f"d AND field_id = 'cash_award' AND cash_outcomes < 2 AND ({m(W.PRIZE_MATRIX)})"),
    ]
    chain = "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in cases) + " END"
    return f"""+ e AS (SELECT *, CASE n_said WHEN 0 THEN [] WHEN 1 THEN [first_said] ELSE [first_said, then_said] END AS excerpts FROM context_facts),
f AS (SELECT e.*, c.* EXCLUDE (slug), len(excerpts) AS n, lower(array_to_string(excerpts, ' ')) AS said, status = 'disclosed' AS d FROM e JOIN context_cards c ON e.slug = c.slug),
h AS (SELECT *, CASE WHEN status IN ('disclosed', 'conflicting') THEN {chain} END AS own FROM f),
r AS (SELECT h.*, CASE WHEN own IS NOT NULL THEN own WHEN field_id = 'relationship_explanation' AND status IN ('disclosed', 'conflicting') AND EXISTS (SELECT 1 FROM h x WHERE x.slug = h.slug AND x.own = 'affiliation') THEN 'affiliation' END AS rule FROM h)
SELECT slug, field_id, CASE WHEN rule IS NULL THEN status WHEN n > 0 THEN 'unclear' ELSE 'not_found' END AS status, rule, rule IS NOT NULL AND n > 0 AS noted FROM r"""


@query("pipe_04_withheld_facts", "context_facts", "context_cards", sql=_withhold_sql())
def _(facts, cards):
    said = F.when(F.col("n_said") == 0, F.array().cast("array<string>")).when(F.col("n_said") == 1, F.array("first_said")).otherwise(F.array("first_said", "then_said"))
    facts = facts.withColumn("display", F.lit(None).cast("string")).withColumn("evidence", F.transform(said, lambda x: F.struct(x.alias("excerpt"), F.col("fits").alias("fits"))))
    left = W.withhold(facts, cards.withColumn("years", F.array(F.lit(2026))))
    return left.select("slug", "field_id", "status", "rule", (F.col("rule").isNotNull() & F.col("note").isNotNull()).alias("noted"))


@query("pipe_05_collapsed_fees", "fee_candidates", sql="""+ c AS (SELECT *, coalesce(amount, CASE WHEN value IS NOT NULL AND display NOT LIKE 'EUR or%' THEN replace(value, ',', '')::DOUBLE END) AS a FROM fee_candidates)
SELECT slug, 'Multiple application fees — see cost details' AS display, 'The source states plan-specific alternatives: ' || string_agg(display, '; ' ORDER BY place) || '.' AS note FROM c GROUP BY slug
HAVING count(*) >= 2 AND bool_and(a IS NOT NULL AND NOT twice) AND count(DISTINCT id) = 1 AND count(DISTINCT a) = 2 AND slug % 4 < 2""")
def _(candidates):
    source = F.struct("id", F.lit("https://example.org/").alias("url"), "excerpt")
    return W.collapsed_fees(candidates.withColumn("sources", F.when(F.col("twice"), F.array(source, source)).otherwise(F.array(source))))
