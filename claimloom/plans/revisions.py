"""Linked pages, imported cards and review records on the driver's tables: a Spark query and independent SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import crawl as C
from claimloom.operators import revisions as R
from claimloom.plans.carriers import VIEWS, query
from claimloom.plans.statements import _case

_PATHS = ["", "faq", "apply", "rules", "refund", "about", "schedule", "awards"]
_LINKS = [("faq", "FAQ"), ("apply", "Apply"), ("rules", "Rules"), ("refund", "Refund"), ("cost", "Tuition"), ("schedule", "Schedule"), ("news", "News")]
_SITE = "CAST((page_id - page_id % 8) / 8 AS BIGINT)"
_MENU = "".join(f'<p><a href="/{path}">{text}</a></p>' for path, text in _LINKS)

VIEWS |= {
    # sites of eight of the driver's pages, with links to each other put before their own, which become news
    "site_pages": f"SELECT page_id, {_SITE} AS site, page_id % 8 AS slot, concat('https://s', CAST({_SITE} AS STRING), '.example.org/', {_case('page_id', _PATHS)}) AS url, CASE WHEN page_id % 11 <> 5 THEN concat('{_MENU}', replace(html, 'href=\"/', 'href=\"/news/')) END AS html, CASE WHEN page_id % 8 = 2 AND {_SITE} % 3 = 1 THEN concat('https://forms', CAST({_SITE} AS STRING), '.example.net/f') WHEN page_id % 8 = 3 AND {_SITE} % 4 = 1 THEN 'https://rules.example.net/' WHEN page_id % 8 = 1 AND {_SITE} % 5 = 2 THEN concat('https://s', CAST({_SITE} AS STRING), '.example.org/refund') END AS final_url FROM pages",
}

#: Path, topic and score of the links, in the order that the ranking gives them.
_RANKED = [("refund", "refund", 31), ("rules", "rules", 25), ("cost", "cost", 25), ("faq", "faq", 23), ("apply", "application", 17), ("schedule", "schedule", 15)]
_LISTED = "(VALUES " + ", ".join(f"({i}, '{path}', '{topic}')" for i, (path, topic, _) in enumerate(_RANKED)) + ") v(nth, path, topic)"


@query("src_08_crawl", "site_pages", sql=f"""+ a AS (SELECT *, coalesce(final_url, url) AS dest, split_part(coalesce(final_url, url), '/', 3) AS host FROM site_pages),
f AS (SELECT dest, max(html IS NOT NULL) AS is_read, any_value(host) AS host FROM a GROUP BY dest),
l AS (SELECT f.dest AS page, f.host, concat('https://', f.host, '/', path) AS url, topic, nth FROM f, {_LISTED} WHERE is_read),
p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY nth) AS place FROM l WHERE url <> page),
j AS (SELECT p.*, a.dest AS goal, f.is_read, f.host <> p.host AND p.topic <> 'application' AS abroad FROM p LEFT JOIN a ON a.url = p.url LEFT JOIN f ON f.dest = a.dest),
o AS (SELECT *, CASE WHEN goal IS NULL THEN 'FETCH_FAILED' WHEN abroad THEN 'CROSS_ORIGIN_REDIRECT' WHEN NOT is_read THEN 'no_html' END AS failure FROM j)
SELECT 'page-' || substr(sha256(page), 1, 16) AS page_id, place, url, topic, goal AS final_url, 'page-' || substr(sha256(goal), 1, 16) AS target_id, coalesce(failure, CASE WHEN goal = page OR row_number() OVER (PARTITION BY page, failure, goal ORDER BY place) > 1 THEN 'duplicate' ELSE 'reviewed' END) AS outcome FROM o""")
def _(pages):
    return C.crawl(pages.select("url", "html", "final_url"))


_VERSION = _case("c_custkey", ['"schemaVersion":"1.0.0",', '"schemaVersion":"2.0.0",', '"schemaVersion":"2.1.0",', '"schemaVersion":"2.2.0",', '"schemaVersion":"3.0.0",', "", '"schemaVersion":"2.0.0",'])
_OUTCOMES = _case("o_orderkey", ["", '<"definition":<"value":<"outcomeType":"educator_cash_prize">>>', '<"recipientScope":<"conflictingValues":[<"value":"team">,<"value":"educator">]>>', '<"distribution":<"value":[<"payee":"team">,<"payee":"school">]>>', '<"definition":<"value":<"outcomeType":"stipend">>,"recipientScope":<"value":"school">>', "3"])
_PROJECTED = _case("o_custkey", ["null", '<"rule":1,"schemaVersion":"2.0.0">', '<"rule":2,"schemaVersion":"2.1.0">', '<"rule":1,"schemaVersion":"2.0.0">', "null"])
_FIRST_STATES = ["demo", "draft", "ai_audited", "human_reviewed", "organizer_confirmed", "automated_draft", "draft", "draft"]

VIEWS |= {
    "versioned_cards": f"""SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 37 = 0 THEN 'no card' ELSE translate(concat('<"cardVersion":', CAST(1 + o_orderkey % 9 AS STRING), ',"facts":<"cost":<"projection":', {_PROJECTED}, ',"status":"disclosed">>,"outcomes":<"records":[', {_OUTCOMES}, ']>,"reviewedAt":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '"1998-01-02"' END, ',"reviewState":"', {_case('floor(o_totalprice)', _FIRST_STATES)}, '",', {_VERSION}, '"slug":"', CAST(o_orderkey AS STRING), '","summary":"', c_name, '">'), '<>', concat(chr(123), chr(125))) END AS card FROM orders JOIN customer ON o_custkey = c_custkey""",
    "review_cards": "SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 29 > 0 THEN concat('o-', CAST(o_custkey AS STRING)) END AS opportunity_id, CAST(2 + o_orderkey % 3 AS BIGINT) AS card_version, CASE WHEN o_orderkey % 9 = 0 THEN 'ai_audited' ELSE 'human_reviewed' END AS review_state, substr(CAST(o_orderdate AS STRING), 1, 10) AS reviewed_at FROM orders",
    "review_items": """SELECT l_orderkey AS slug, 'source-inventory' AS section, 0 AS section_no, CAST(l_linenumber AS INT) AS place, concat('source:', CAST(l_suppkey AS STRING), '-', CAST(l_partkey % 20 AS STRING)) AS item_id, CAST(l_partkey AS STRING) AS content, l_partkey AS k FROM lineitem
        UNION ALL SELECT l_orderkey, 'facts', 1, CAST(l_linenumber AS INT), concat('fact:', CAST(l_linenumber AS STRING)), concat(l_returnflag, '"', l_linestatus), l_partkey + 1 FROM lineitem
        UNION ALL SELECT o_orderkey, 'final-sign-off', 2, CAST(r_regionkey AS INT), concat('final:', r_name), 'required', o_orderkey * 7 + CAST(r_regionkey AS BIGINT) FROM orders JOIN region ON true""",
}


@query("pipe_12_migrations", "versioned_cards", sql="""+ j AS (SELECT slug, try_cast(card AS JSON) AS c FROM versioned_cards),
s AS (SELECT *, c->>'$.schemaVersion' AS v, c->>'$.reviewState' AS state, (c->>'$.cardVersion')::BIGINT AS n, c->>'$.facts.cost.projection.schemaVersion' AS pv,
 list_contains(c->>'$.outcomes.records[*].definition.value.outcomeType', 'educator_cash_prize') OR list_contains(c->>'$.outcomes.records[*].recipientScope.conflictingValues[*].value', 'educator') OR list_contains(c->>'$.outcomes.records[*].distribution.value[*].payee', 'school') AS later FROM j),
f AS (SELECT *, CASE WHEN c IS NULL THEN 'not_json' WHEN v IS NULL THEN 'undeclared' WHEN v = '3.0.0' THEN 'unsupported' WHEN v IN ('2.0.0', '2.1.0') AND state IN ('ai_audited', 'automated_draft') THEN 'later_state' WHEN v = '2.0.0' AND later THEN 'later_word' WHEN v IN ('2.0.0', '2.1.0') AND pv <> v THEN 'projection_version' END AS fault FROM s)
SELECT slug, v AS from_version, fault, CASE WHEN fault IS NULL THEN '2.2.0' END AS version, CASE WHEN fault IS NULL THEN n + (v = '1.0.0' OR state IN ('ai_audited', 'human_reviewed', 'organizer_confirmed'))::BIGINT END AS card_version, CASE WHEN fault IS NULL THEN CASE WHEN v = '1.0.0' OR state IN ('ai_audited', 'human_reviewed', 'organizer_confirmed') THEN 'draft' ELSE state END END AS state,
CASE WHEN fault IS NULL THEN CASE WHEN v IN ('2.0.0', '2.1.0') AND pv IS NOT NULL THEN '2.2.0' ELSE pv END END AS projected, CASE WHEN fault IS NULL AND v = '1.0.0' THEN sha256(c::VARCHAR) END AS digest, CASE WHEN fault IS NULL THEN CASE WHEN v = '1.0.0' THEN 19 ELSE 8 END END AS n_keys FROM f""")
def _(cards):
    got = R.migrate(cards).withColumn("v", F.parse_json("card"))
    text = lambda path: F.try_variant_get("v", path, "string")
    keys = F.size(F.map_keys(F.try_variant_get("v", "$", "map<string, variant>")))
    return got.select("slug", "from_version", "fault", text("$.schemaVersion").alias("version"), F.try_variant_get("v", "$.cardVersion", "long").alias("card_version"), text("$.reviewState").alias("state"), text("$.facts.cost.projection.schemaVersion").alias("projected"), text("$.migratedFrom.cardSha256").alias("digest"), F.when(F.col("card").isNotNull(), keys).cast("long").alias("n_keys"))


#: When the records were made: some contents were others, some items weren't ticked, some were twice, some are no items.
_THEN = "CASE WHEN k % 23 = 11 THEN 'before' ELSE content END"


def _digests(of: str) -> str:
    rows = f"(SELECT slug, section_no, section, list(item_id ORDER BY place, item_id) AS ids, list(struct_pack(content := {of}, id := item_id) ORDER BY place, item_id) AS held FROM review_items GROUP BY slug, section_no, section)"
    return f"(SELECT slug, sha256(to_json(list(struct_pack(id := section, itemIds := ids) ORDER BY section_no))::VARCHAR) AS manifest, sha256(to_json(flatten(list(held ORDER BY section_no)))::VARCHAR) AS held, flatten(list(ids ORDER BY section_no)) AS ids FROM {rows} GROUP BY slug)"


@query("pipe_14_review_records", "review_cards", "review_items", sql=f"""+ now AS {_digests('content')}, past AS {_digests(_THEN)},
r AS (SELECT slug, opportunity_id, card_version - (slug % 13 = 5)::BIGINT AS card_version, reviewed_at FROM review_cards WHERE slug % 17 > 0),
d AS (SELECT slug, CASE WHEN k % 43 = 1 THEN 'other' ELSE item_id END AS item_id, CASE WHEN k % 31 = 7 THEN 2 ELSE 1 END AS n FROM review_items WHERE k % 41 <> 3 AND slug % 17 > 0),
e AS (SELECT DISTINCT slug, item_id FROM review_items), t AS (SELECT slug, item_id, sum(n) AS times FROM d GROUP BY ALL),
y AS (SELECT slug, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.slug = e.slug AND t.item_id = e.item_id)) AS a FROM e GROUP BY slug),
z AS (SELECT slug, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE t.slug = e.slug AND t.item_id = e.item_id)) AS b, count(*) FILTER (times > 1) AS c FROM t GROUP BY slug)
SELECT k.slug, CASE WHEN r.slug IS NOT NULL THEN coalesce(y.a, 0) END AS n_missing, CASE WHEN r.slug IS NOT NULL THEN coalesce(z.b, 0) END AS n_unexpected, CASE WHEN r.slug IS NOT NULL THEN coalesce(z.c, 0) END AS n_repeated,
CASE WHEN r.slug IS NULL THEN 'no_record' WHEN k.review_state <> 'human_reviewed' THEN 'other_state' WHEN k.opportunity_id IS NULL THEN 'no_identity' WHEN len(list_distinct(now.ids)) < len(now.ids) THEN 'repeated_items' WHEN r.card_version <> k.card_version OR now.manifest <> past.manifest OR now.held <> past.held THEN 'stale' WHEN y.a > 0 OR z.b > 0 OR z.c > 0 THEN 'items' END AS verdict
FROM review_cards k LEFT JOIN r ON r.slug = k.slug LEFT JOIN now ON now.slug = k.slug LEFT JOIN past ON past.slug = k.slug LEFT JOIN y ON y.slug = k.slug LEFT JOIN z ON z.slug = k.slug WHERE r.slug IS NOT NULL OR k.review_state = 'human_reviewed'""")
def _(cards, items):
    then = R.manifests(items.withColumn("content", F.expr(_THEN))).select("slug", "manifest_sha256", "content_sha256")
    made = cards.filter("slug % 17 > 0").select("slug", "opportunity_id", (F.col("card_version") - (F.col("slug") % 13 == 5).cast("long")).alias("card_version"), "reviewed_at").join(then, "slug")
    done = items.filter("k % 41 <> 3 AND slug % 17 > 0").select("slug", F.when(F.col("k") % 43 == 1, "other").otherwise(F.col("item_id")).alias("item_id"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") % 31 == 7, 2).otherwise(1))).alias("one"))
    return R.check_attestations(cards, items, made, done)
