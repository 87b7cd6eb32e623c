"""Structured-record projections and marker functions on the driver's tables: a Spark query and independent SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import markers as M
from claimloom.operators import projection as P
from claimloom.plans.carriers import VIEWS, query

_TYPES = [t for listed in P.OUTCOME_FIELDS.values() for t in listed] + P.EDUCATOR_TYPES + ["travel", "network"]
_RELATIONS = [*P.RELATIONSHIPS, "alumni_run"]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


VIEWS |= {
    "oprole": "SELECT l_orderkey AS slug, l_linenumber AS role_id, l_suppkey AS org_id, CASE WHEN l_returnflag = 'A' THEN 'operator' WHEN l_returnflag = 'R' THEN 'fiscal_sponsor' ELSE 'media_partner' END AS role FROM lineitem",
    "outcome_rows": f"SELECT l_orderkey AS slug, l_linenumber AS outcome_id, {_case('l_partkey', _TYPES)} AS type, concat('Prize ', CAST(l_partkey AS STRING)) AS label, CASE l_suppkey % 5 WHEN 0 THEN 'individual' WHEN 1 THEN 'team' WHEN 2 THEN 'project' WHEN 3 THEN 'educator' END AS recipient, "
    "CASE WHEN l_returnflag = 'A' THEN 'cash' WHEN l_returnflag = 'R' THEN 'in_kind' END AS nature, CASE WHEN l_linenumber % 3 > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS amount, concat('$', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) AS amount_display FROM lineitem",
    "relation_rows": f"SELECT l_orderkey AS slug, l_linenumber AS relation_id, CASE WHEN l_quantity < 40 THEN 'disclosed' ELSE 'unclear' END AS status, {_case('l_partkey', _RELATIONS)} AS type, CASE WHEN l_partkey % 3 = 0 THEN concat('School ', CAST(l_partkey % 50 AS STRING)) END AS target_name, l_suppkey AS org_id, concat('Tie ', CAST(l_partkey AS STRING)) AS display, concat('Why ', CAST(l_linenumber AS STRING)) AS description FROM lineitem",
    "scoped_claims": "SELECT l_orderkey AS slug, CAST(l_partkey % 3 AS INT) AS field_id, l_linenumber AS claim_id, concat(l_returnflag, l_linestatus) AS display, l_quantity < 8 AS by_variant, l_quantity > 42 AS by_process FROM lineitem",
    "coverage": "SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE o_orderpriority END AS text, o_orderkey % 5 = 0 AS truncated FROM orders",
}
_ORG = "(SELECT s_suppkey AS org_id, s_name AS name, CASE WHEN s_nationkey % 4 > 0 THEN concat('kind ', CAST(s_nationkey AS VARCHAR)) END AS kind FROM supplier WHERE s_suppkey % 7 > 0)"


def _organizations(supplier):
    kind = F.when(F.col("s_nationkey") % 4 > 0, F.concat(F.lit("kind "), F.col("s_nationkey").cast("string")))
    return supplier.filter("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("name"), kind.alias("kind"))


@query("prj_01_primary_operator", "oprole", "supplier", sql=f"""SELECT slug, CASE WHEN n > 0 THEN ops ELSE others END AS operating_organization, CASE WHEN n = 1 THEN kind END AS organization_type FROM (
SELECT slug, count(*) FILTER (role = 'operator') AS n, string_agg(name, '; ' ORDER BY role_id, name) FILTER (role = 'operator') AS ops, string_agg(name || ' (' || replace(role, '_', ' ') || ')', '; ' ORDER BY role_id, name, role) AS others, max(kind) FILTER (role = 'operator') AS kind
FROM oprole LEFT JOIN {_ORG} o USING (org_id) GROUP BY slug) WHERE CASE WHEN n > 0 THEN ops ELSE others END IS NOT NULL""")  # fmt: skip
def _(roles, supplier):
    return P.primary_operator(roles, _organizations(supplier))


@query("prj_03_relationships", "relation_rows", "supplier", sql=f"""+ k AS (SELECT r.*, coalesce(target_name, name) AS target FROM relation_rows r LEFT JOIN {_ORG} o USING (org_id) WHERE status = 'disclosed'),
t AS (SELECT slug, string_agg(target, '; ' ORDER BY pos, target) AS named_institution FROM (SELECT slug, target, min(relation_id) AS pos FROM k WHERE target IS NOT NULL GROUP BY ALL) GROUP BY slug)
SELECT k.slug, any_value(named_institution) AS named_institution, CASE WHEN count(*) = 1 THEN min(display) ELSE 'Multiple institution relationships — see details' END AS institution_relationship,
CASE WHEN count(*) = 1 THEN CASE min(type) WHEN 'founders_affiliated_with' THEN 'founded_by_affiliates' WHEN 'alumni_run' THEN NULL ELSE min(type) END END AS relationship, string_agg(description, '; ' ORDER BY relation_id) AS relationship_explanation
FROM k LEFT JOIN t ON k.slug = t.slug GROUP BY k.slug""")  # fmt: skip
def _(records, supplier):
    return P.relationships(records, _organizations(supplier))


@query("prj_08_scoped_claims", "scoped_claims", sql="""+ d AS (SELECT slug, field_id, string_agg(display, '; ' ORDER BY pos, display) AS note, count(*) AS n FROM (SELECT slug, field_id, display, min(claim_id) AS pos FROM scoped_claims GROUP BY ALL) GROUP BY ALL),
s AS (SELECT slug, field_id, bool_or(by_variant) AS v, bool_or(by_process) AS p, CASE WHEN v AND p THEN 'program/cohort and stage/pathway' WHEN v THEN 'program/cohort' WHEN p THEN 'stage/pathway' ELSE 'source record' END AS dim FROM scoped_claims GROUP BY ALL)
SELECT slug, field_id, CASE WHEN n > 1 THEN 'Varies by ' || dim WHEN v OR p THEN 'Scoped by ' || dim || ' — see details' ELSE note END AS display, CASE WHEN n > 1 OR v OR p THEN note END AS note FROM d JOIN s USING (slug, field_id)""")  # fmt: skip
def _(claims):
    return P.scoped_projection(claims)


_FIELD = "CASE " + " ".join(f"WHEN type IN ({', '.join(map(repr, listed))}) THEN '{field}'" for field, listed in P.OUTCOME_FIELDS.items()) + " ELSE 'other_benefits' END"


@query("prj_16_outcomes", "outcome_rows", sql=f"""+ s AS (SELECT *, {_FIELD} AS field_id FROM outcome_rows WHERE recipient IN ('individual', 'team', 'project') AND type <> 'educator_cash_prize'),
g AS (SELECT slug, field_id, count(*) AS n, any_value(label) AS label, any_value(recipient) AS recipient, any_value(amount) AS a, any_value(amount_display) AS shown, string_agg(label, '; ' ORDER BY outcome_id, label) AS labels FROM s WHERE field_id NOT IN ('cash_award', 'stipend') OR nature = 'cash' GROUP BY ALL)
SELECT slug, field_id, CASE WHEN field_id = 'other_benefits' THEN labels WHEN n > 1 THEN CASE WHEN field_id = 'cash_award' THEN 'Multiple cash awards — see prize details' ELSE 'Multiple outcomes — see details' END WHEN a IS NULL THEN label ELSE label || ' — ' || shown || '/' || recipient END AS display,
CASE WHEN n = 1 AND field_id <> 'other_benefits' THEN a END AS amount, CASE WHEN n > 1 AND field_id <> 'other_benefits' THEN labels END AS note FROM g""")  # fmt: skip
def _(outcomes):
    return P.project_outcomes(outcomes)


@query("prj_19_reset", "facts", sql="SELECT slug, field_id, CASE WHEN value = 'F' THEN 'not_found' ELSE status END AS status, CASE WHEN value <> 'F' THEN value END AS value FROM facts")
def _(facts):
    return P.reset_projected(facts.withColumn("rule", F.when(F.col("value") == "F", "costs.total")))


@query("prj_20_drift", "facts", sql="""+ c AS (SELECT slug, field_id + field_id // 6 AS field_id, CASE WHEN field_id = 2 THEN 'unclear' ELSE status END AS status, value FROM facts)
SELECT slug, field_id, f.status AS stored, c.status AS computed FROM facts f FULL JOIN c USING (slug, field_id) WHERE f.status IS DISTINCT FROM c.status OR f.value IS DISTINCT FROM c.value""")
def _(facts):
    computed = facts.select("slug", (F.col("field_id") + F.floor(F.col("field_id") / 6)).cast("int").alias("field_id"), F.when(F.col("field_id") == 2, "unclear").otherwise(F.col("status")).alias("status"), "value")
    return P.drift(facts, computed)


@query("pipe_06_coverage", "facts", "coverage", sql="""SELECT slug, field_id, CASE WHEN status = 'not_found' AND (blank OR truncated) THEN 'unclear' ELSE status END AS status, CASE WHEN status = 'not_found' AND blank THEN 'no_text' WHEN status = 'not_found' AND truncated THEN 'truncated' END AS reason
FROM facts JOIN (SELECT slug, truncated, trim(text) = '' AS blank FROM coverage) USING (slug)""")
def _(facts, sources):
    return P.limit_coverage(facts, sources)


@query("jn_01_metadata_mismatch", "pages", sql="SELECT e AS evidence_id, CASE WHEN p.page_id IS NULL THEN 'unknown page' ELSE 'different page' END AS problem FROM (SELECT page_id AS e, CASE WHEN page_id % 10 = 3 THEN -page_id ELSE page_id END AS k, page_id % 7 = 1 AS other FROM pages) LEFT JOIN pages p ON k = p.page_id WHERE p.page_id IS NULL OR other")
def _(pages):
    titled = pages.select("page_id", "url", F.substring("html", 1, 20).alias("title"))
    k = F.col("page_id")
    cited = titled.select(k.alias("evidence_id"), F.when(k % 10 == 3, -k).otherwise(k).alias("page_id"), F.when(k % 7 == 1, F.concat("url", F.lit("x"))).otherwise(F.col("url")).alias("url"), "title")
    return P.metadata_mismatches(cited, titled)


_MARKED = ", ".join(f"CASE WHEN regexp_matches(action, '(?i){pattern}') THEN '{name}' END" for name, pattern in M.PROCESS.items())


@query("fn_28_process_markers", "documents", sql=f"SELECT doc_id, concat_ws(',', {_MARKED}) AS markers FROM (SELECT doc_id, regexp_replace(text, '(?i){M.NO_STEP}', '', 'g') AS action FROM documents)")
def _(docs):
    return docs.select("doc_id", F.coalesce(F.array_join(M.process_markers(F.col("text")), ","), F.lit("")).alias("markers"))


_STATE = " ".join(f"WHEN regexp_matches(text, '(?i){pattern}') THEN '{name}'" for name, pattern in M.CYCLE.items())


@query("fn_37_cycle_status", "documents", sql=f"SELECT doc_id, CASE {_STATE} END AS state FROM documents")
def _(docs):
    return docs.select("doc_id", M.cycle_status(F.col("text")).alias("state"))


@query("fn_30_small_numbers", "documents", sql=r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(replace(text, ',', ''), '[0-9]+'), lambda x: length(x) <= 2), lambda x: x::INT), lambda n: n <= 25))), ',') AS numbers FROM documents WHERE text IS NOT NULL")
def _(docs):
    return docs.filter("text IS NOT NULL").select("doc_id", F.array_join(M.small_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@query("fn_10_money_display", "orders", sql="SELECT o_orderkey, '$' || CASE WHEN a = floor(a) THEN format('{:,.0f}', a) ELSE format('{:,.2f}', a) END AS shown, '€' || format('{:,.0f}', floor(a)) || '–' || '€' || format('{:,.0f}', floor(a) + 5) AS span FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS a FROM orders)")
def _(orders):
    a = F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice"))
    low = F.floor(a).cast("double")
    return orders.select("o_orderkey", M.money_display(a, F.lit("USD")).alias("shown"), M.money_range(low, low + 5, F.lit("EUR")).alias("span"))


@query("fn_09_value_display", "lineitem", sql="SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%b %-d, %Y') AS day, CASE WHEN l_linenumber = 1 THEN q || ' hours total' ELSE q || '–' || (l_quantity::BIGINT + 1)::VARCHAR || ' hours per week' END AS hours FROM (SELECT *, l_quantity::BIGINT::VARCHAR AS q FROM lineitem)")
def _(li):
    first = F.col("l_linenumber") == 1
    hours = M.hours_display(F.col("l_quantity"), F.when(~first, F.col("l_quantity") + 1), F.when(first, "total").otherwise("week"))
    return li.select("l_orderkey", "l_linenumber", M.date_display(F.col("l_shipdate")).alias("day"), hours.alias("hours"))


@query("fn_17_searchable_url", "pages", sql=r"SELECT page_id, regexp_replace(url_decode(split_part(r, '?', 1) || ' ' || CASE WHEN contains(r, '?') THEN regexp_replace(r, '^[^?]*', '') ELSE '' END), '[-_+/?.=&]+', ' ', 'g') AS words FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^\w+://[^/?]*', '') AS r FROM pages)")
def _(pages):
    return pages.select("page_id", M.searchable_url(F.col("url")).alias("words"))
