"""Repository, reader and link operators on the driver's tables: a Spark query and independent SQL for each."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators import facts as O
from claimloom.operators import library as L
from claimloom.operators import links as K
from claimloom.plans.carriers import VIEWS, query
from claimloom.plans.ledgers import _LINES, _STATUS, _WORDS, _listed
from claimloom.plans.statements import _case
from claimloom.streaming import admission

_STATES = ["demo", "human_reviewed", "ai_audited", "draft"]
_LINK_TEXTS = ["Apply now", "FAQ", "Privacy Policy", "Tuition and fees", "Refund policy", "News", "Log in", "Terms and Conditions", "Robotics Challenge rules", "Poetry Contest", "About us", "Download", "Admissions results", "Schedule of dates", "Awards and prizes", "Contact", "Financial aid for robotics"]
_PATHS = ["/programs/robotics/faq", "/programs/poetry/apply", "/privacy", "/files/guide.pdf", "/rules?x=1", "/donate/tuition", "/challenge", "", "/programs/robotics/cancel#top", "/a/deadlines", "/about", "/signin/now"]

VIEWS |= {
    "choices": "SELECT o_orderkey AS slug, " + ", ".join(f"CASE o_orderkey % {m} WHEN 0 THEN 'all' WHEN 1 THEN '' ELSE 'x' END AS c{m}" for m in range(2, 10)) + " FROM orders",
    "worded_facts": f"SELECT slug, n AS field_id, n AS place, CASE WHEN pk % 11 = 0 THEN 'unassessed' ELSE {_STATUS.format('pk')} END AS status, concat({_case('sk', ['Refund', 'Tuition cost', 'Deadline'])}, ' ', CAST(n AS STRING)) AS words FROM {_LINES}",
    "demo_cards": f"SELECT o_orderkey AS slug, {_case('o_custkey', _STATES)} AS review_state, concat('c', CAST(o_custkey AS STRING), CASE WHEN o_custkey % 3 = 0 THEN '.example' ELSE '.org' END) AS host, CASE WHEN o_custkey % 2 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) END AS reviewed_at FROM orders WHERE o_orderkey % 2 = 0",
    "other_cards": f"SELECT o_orderkey AS slug, {_case('o_custkey', _STATES)} AS review_state FROM orders WHERE o_orderkey % 3 = 0",
    "sidecars": "SELECT o_orderkey AS slug FROM orders WHERE o_orderkey % 5 > 0",
    "stored_cards": f"SELECT slug AS owner, n AS place, pk % 2 AS slug, sk % 5 > 0 AS readable, CASE WHEN q % 2 = 0 THEN day END AS note FROM {_LINES}",
    "entries": "SELECT event_id AS entry_id, user_id AS key, ts, date_part('day', ts) AS dom FROM events",
    "link_rows": f"SELECT slug AS page_id, 'https://acme.org/programs/robotics' AS page_url, CASE WHEN slug % 4 = 0 THEN '' ELSE 'Robotics Challenge | Acme' END AS title, n AS document_order, concat(CASE WHEN sk % 7 = 0 THEN 'https://other.org' ELSE 'https://acme.org' END, {_case('sk', _PATHS)}) AS url, {_case('pk', _LINK_TEXTS)} AS text FROM {_LINES}",
    "attention_refs": f"SELECT slug, q % 2 AS item, CASE WHEN pk % 3 > 0 THEN n END AS field_id, CASE WHEN sk % 2 = 0 THEN n END AS claim_id, pk % 4 AS old_fact, CASE WHEN sk % 5 = 0 THEN 9 ELSE pk % 4 END AS new_fact FROM {_LINES}",
    "proposals": f"SELECT slug, n % 3 AS field_id, n AS place, pk % 2 = 0 AS valid, {_STATUS.format('sk')} AS status, q % 2 AS n_sources, CASE WHEN sk % 3 = 0 THEN 'organizer_stated' END AS claim_kind, CASE WHEN q % 5 = 0 THEN 'n' END AS note FROM {_LINES}",
    "needy": f"SELECT slug, n AS id, CASE WHEN n > 1 THEN n - 1 - pk % 2 END AS needs FROM {_LINES}",
    "quotes": f"SELECT slug, n AS block, concat('Intro  text. ', {_case('pk', ['The program  costs nothing', 'Winners are told in July', 'We ask and we ask again'])}, ' End.', CASE WHEN sk % 4 = 0 THEN ' Winners are told in July' ELSE '' END) AS text, {_case('sk', ['the program costs nothing', 'winners aretold in july', 'we ask'])} AS quote FROM {_LINES}",
    "typed_json": "SELECT o_orderkey AS slug, concat(chr(123), '\"b\": ', CAST(o_custkey AS STRING), '.0, \"apple\": [1.50, null], \"Zed\": ', chr(123), '\"y\": \"é\", \"X1\": true', chr(125), ', \"cardSha256\": \"q\"', chr(125)) AS doc FROM orders",
    "tokens": f"SELECT slug, n AS place, {_case('pk', ['applications_open', 'in_person', 'not_found', 'x'])} AS token, concat('10.0.', CAST(sk AS STRING), '.1, 8.8.8.8') AS address FROM {_LINES}",
}


@query("flt_08_active_filters", "choices", sql="SELECT slug, " + " + ".join(f"(c{m} NOT IN ('', 'all'))::INT" for m in range(2, 10)) + " AS n FROM choices")
def _(rows):
    return rows.select("slug", L.active_filters(*(F.col(f"c{m}") for m in range(2, 10))).alias("n"))


@query("flt_09_fact_filter", "worded_facts", sql="SELECT slug, field_id FROM worded_facts WHERE contains(lower(words), 'cost') AND status IN ('not_found', 'unclear', 'conflicting', 'unassessed')")
def _(facts):
    return L.fact_filter(facts, " COST ", "unresolved").select("slug", "field_id")


@query("flt_10_comparison_mode", "facts", sql="""+ c AS (SELECT field_id, count(DISTINCT s) > 1 AS differs FROM (SELECT f.field_id, k.slug, coalesce(max(concat_ws('|', status, coalesce(value, ''))), '') AS s FROM (SELECT DISTINCT field_id FROM facts WHERE slug IN (1, 2)) f CROSS JOIN (SELECT unnest([1, 2]) AS slug) k LEFT JOIN facts x ON x.slug = k.slug AND x.field_id = f.field_id GROUP BY ALL) GROUP BY field_id)
SELECT 'core' AS mode, field_id FROM c WHERE field_id IN (1, 2) UNION ALL SELECT 'differences' AS mode, field_id FROM c WHERE differs AND field_id IN (1, 3, 5) UNION ALL SELECT 'full' AS mode, field_id FROM c""")
def _(facts):
    rows = O.compare(facts, [1, 2])
    modes = [L.comparison_rows(rows, m, [1, 2], [1, 3, 5]).select(F.lit(m).alias("mode"), "field_id") for m in ("core", "differences", "full")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("flt_12_overview_tiles", "worded_facts", sql="""+ a AS (SELECT *, status IN ('disclosed', 'conflicting') AS s, field_id IN (2, 4) AS w FROM worded_facts), b AS (SELECT *, bool_or(s AND NOT w) OVER (PARTITION BY slug) AS any_s, min(place) FILTER (NOT w) OVER (PARTITION BY slug) AS f FROM a),
c AS (SELECT *, NOT any_s AND coalesce(place = f, false) AS lead_tile FROM b) SELECT slug, field_id, row_number() OVER (PARTITION BY slug ORDER BY NOT lead_tile, place) AS tile FROM c WHERE s OR w OR lead_tile""")
def _(facts):
    return L.overview_tiles(facts, [2, 4])


@query("flt_13_public_cards", "demo_cards", sql="SELECT slug, review_state FROM demo_cards WHERE review_state IN ('demo', 'human_reviewed', 'ai_audited')")
def _(cards):
    return cards.filter(F.col("review_state").isin(L.PUBLIC_STATES)).select("slug", "review_state")


@query("src_02_repository_union", "demo_cards", "other_cards", "sidecars", sql="+ u AS (SELECT slug, review_state FROM demo_cards UNION ALL SELECT slug, review_state FROM other_cards) SELECT u.slug, review_state, CASE WHEN count(*) OVER (PARTITION BY u.slug) > 1 THEN 'duplicate slug' WHEN review_state IN ('human_reviewed', 'ai_audited') AND u.slug NOT IN (SELECT slug FROM sidecars) THEN 'attestation missing' END AS problem FROM u")
def _(demo, other, sidecars):
    return L.repository(demo, other, sidecars)


@query("src_03_drafts", "other_cards", sql="SELECT slug FROM other_cards WHERE review_state = 'draft'")
def _(cards):
    return cards.filter("review_state = 'draft'").select("slug")


@query("src_06_demo_cards", "demo_cards", sql="SELECT slug, host FROM demo_cards WHERE review_state = 'demo'")
def _(cards):
    return cards.filter("review_state = 'demo'").select("slug", "host")


@query("src_09_pasted_sources", "documents", sql="SELECT owner, CASE WHEN n > 7 THEN 'too many sources' WHEN urls < n THEN 'repeated address' WHEN longest > 4000 THEN 'source too long' WHEN total > 9000 THEN 'sources too long together' END AS problem FROM (SELECT doc_id // 5 AS owner, count(*) AS n, count(DISTINCT CASE WHEN doc_id % 23 = 0 THEN 'a' ELSE doc_id::VARCHAR END) AS urls, max(length(text)) AS longest, sum(length(text)) AS total FROM (SELECT *, CASE WHEN doc_id % 46 = 1 THEN 'a' END AS u FROM documents) GROUP BY 1)")
def _(docs):
    rows = docs.select(F.expr("doc_id DIV 5").alias("owner"), F.when(F.col("doc_id") % 23 == 0, "a").otherwise(F.col("doc_id").cast("string")).alias("url"), "text")
    return L.pasted_sources(rows, 7, 4000, 9000)


@query("src_11_restored_selection", "stored_cards", sql="SELECT owner, slug, min(place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY place) AS n FROM stored_cards WHERE readable) WHERE n <= 3 GROUP BY ALL")
def _(stored):
    return L.restored_selection(stored)


@query("src_12_batch_manifest", "pages", sql="""+ k AS (SELECT page_id // 8 * 2 + CASE WHEN page_id % 8 < 3 THEN 0 ELSE 1 END AS batch, page_id AS place, CASE WHEN page_id % 16 > 2 THEN lower(url) END AS url FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS url FROM pages) WHERE page_id % 24 <> 3),
b AS (SELECT batch, count(url) AS n FROM k GROUP BY batch), c AS (SELECT batch, url, min(place) AS place, count(*) AS own FROM k JOIN b USING (batch) WHERE url IS NOT NULL AND n <= 4 GROUP BY ALL)
SELECT batch, url, place, (sum(own) OVER (PARTITION BY batch) - count(*) OVER (PARTITION BY batch))::BIGINT AS duplicates, NULL AS problem FROM c
UNION ALL SELECT batch, NULL, NULL, NULL, CASE WHEN n > 4 THEN 'too many addresses' ELSE 'no address' END FROM b WHERE n > 4 OR n = 0""")
def _(pages):
    """Batches of up to three and up to five addresses, under a limit of four; every other one of the small ones has none that is valid."""
    rows = pages.filter("page_id % 24 <> 3").select(F.expr("page_id DIV 8 * 2 + CASE WHEN page_id % 8 < 3 THEN 0 ELSE 1 END").alias("batch"), F.col("page_id").alias("place"), "url")
    canonical = F.lower(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", ""))
    return L.batch_manifest(rows, F.when(F.col("place") % 16 > 2, canonical), most=4)


@query("src_13_latest_entries", "entries", sql="SELECT key, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, entry_id DESC) AS n FROM entries) WHERE n = 1 AND dom > 20")
def _(entries):
    return L.latest(entries.withColumn("expires", F.col("dom")), F.lit(20))


@query("jn_16_carried_attention", "attention_refs", sql="SELECT slug, item FROM attention_refs GROUP BY ALL HAVING bool_and((field_id IS NULL OR old_fact = new_fact) AND (claim_id IS NULL OR claim_id % 3 > 0))")
def _(refs):
    side = lambda c: refs.filter("field_id IS NOT NULL").select("slug", "field_id", F.col(c).alias("fact"))
    claims = refs.filter("claim_id % 3 > 0").select("slug", "claim_id")
    return L.carried_attention(refs.select("slug", "item", "field_id", "claim_id"), side("old_fact"), side("new_fact"), claims)


@query("win_13_first_valid", "proposals", sql="SELECT slug, field_id, min(place) AS place FROM proposals WHERE valid GROUP BY ALL")
def _(rows):
    return L.first_valid(rows)


@query("pipe_03_sanitized_facts", "proposals", sql="""SELECT slug, place AS field_id, s AS status, CASE WHEN valid THEN claim_kind WHEN s = 'unclear' THEN 'source_stated' END AS claim_kind, CASE WHEN valid THEN note WHEN status = 'not_applicable' THEN coalesce(note, 'The model proposed that this field does not apply; human review is required.') WHEN s = 'unclear' THEN 'The model returned an internally inconsistent claim; its cited text requires human review.' END AS note
FROM (SELECT *, CASE WHEN valid OR status IN ('not_found', 'not_applicable') THEN status WHEN n_sources > 0 THEN 'unclear' ELSE 'not_found' END AS s FROM proposals)""")
def _(rows):
    return L.sanitized(rows.withColumn("field_id", F.col("place")))


@query("pipe_13_import_invalidation", "demo_cards", sql="SELECT slug, CASE WHEN a THEN 'draft' ELSE review_state END AS review_state, CASE WHEN NOT a THEN reviewed_at END AS reviewed_at, a AS invalidated FROM (SELECT *, review_state IN ('human_reviewed', 'ai_audited') AS a FROM demo_cards)")
def _(cards):
    return L.invalidated(cards)


@query("pipe_16_dataset_problems", "demo_cards", sql="SELECT slug, 'demo host must end in .example' AS problem FROM demo_cards WHERE review_state = 'demo' AND host NOT LIKE '%.example' UNION ALL SELECT NULL, 'too few demo cards' FROM (SELECT count(*) AS n FROM demo_cards WHERE review_state = 'demo') WHERE n < 1000000")
def _(cards):
    return L.dataset_problems(cards, 1_000_000)


@query("win_15_salvaged_records", "needy", sql="+R s AS (SELECT DISTINCT slug, id FROM needy WHERE needs IS NULL UNION SELECT n.slug, n.id FROM needy n JOIN s ON n.slug = s.slug AND n.needs = s.id) SELECT slug, id FROM s")
def _(rows):
    return L.salvaged(rows)


@query("jn_09_unique_match", "quotes", sql=r"+ c AS (SELECT *, regexp_replace(lower(text), '\s+', '', 'g') AS t, regexp_replace(lower(quote), '\s+', '', 'g') AS k FROM quotes) SELECT slug, block, CASE WHEN k LIKE 'the%' THEN 'The program  costs nothing' ELSE 'Winners are told in July' END AS excerpt FROM c WHERE length(k) >= 16 AND instr(t, k) > 0 AND instr(substr(t, instr(t, k) + 1), k) = 0")
def _(rows):
    return L.unique_match(rows)


@query("jn_14_unchanged_cards", "stored_cards", sql="SELECT owner, place FROM stored_cards WHERE slug = 1 AND note IS NULL")
def _(stored):
    """A stored card counts only where it equals the repository's, nulls included."""
    repository = stored.select("owner", "place", F.lit(1).cast("long").alias("slug"), F.lit(None).cast("string").alias("note"))
    doc = lambda: F.to_json(F.struct(F.col("slug").cast("long").alias("slug"), "note"))
    return stored.select("owner", "place", doc().alias("own")).join(repository.select("owner", "place", doc().alias("theirs")), ["owner", "place"]).filter("own = theirs").select("owner", "place")


@query("set_05_distinct_lines", "worded_facts", sql="SELECT slug, string_agg(words, '|' ORDER BY place) AS lines FROM (SELECT slug, words, min(place) AS place FROM (SELECT slug, place, split_part(words, ' ', 1) AS words FROM worded_facts) GROUP BY ALL) GROUP BY slug")
def _(facts):
    first = F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring_index("words", " ", 1).alias("w")))), lambda x: x["w"])
    return facts.groupBy("slug").agg(F.array_join(F.array_distinct(first), "|").alias("lines"))


@query("set_09_assessed_union", "area_checks", sql="SELECT slug, list_sort(list_distinct(list_concat(list(field_id) FILTER (proposed <> 'not_found'), list(field_id) FILTER (now <> 'not_found')))) AS fields FROM area_checks GROUP BY slug")
def _(rows):
    side = lambda c: F.collect_set(F.when(F.col(c) != "not_found", F.col("field_id")))
    return rows.groupBy("slug").agg(F.array_sort(F.array_union(side("proposed"), side("now"))).alias("fields"))


@query("agg_08_evidence_union", "worded_facts", sql="SELECT slug, string_agg(id || ':' || excerpt, '|' ORDER BY place) AS sources FROM (SELECT slug, field_id % 3 AS id, split_part(words, ' ', 1) AS excerpt, min(place) AS place FROM worded_facts GROUP BY ALL) GROUP BY slug")
def _(facts):
    once = facts.groupBy("slug", (F.col("field_id") % 3).alias("id"), F.substring_index("words", " ", 1).alias("excerpt")).agg(F.min("place").alias("place"))
    return once.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "excerpt"))), lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["excerpt"])), "|").alias("sources"))


@query("agg_18_family_counts", "process_stages", "process_steps", "timings", sql="SELECT slug, family, count(*) AS n FROM (SELECT slug, 'stages' AS family FROM process_stages UNION ALL SELECT slug, 'pathways' FROM process_steps UNION ALL SELECT slug, 'timings' FROM timings) GROUP BY ALL")
def _(stages, steps, timings):
    named = [f.select("slug", F.lit(name).alias("family")) for f, name in ((stages, "stages"), (steps, "pathways"), (timings, "timings"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("slug", "family").agg(F.count("*").alias("n"))


_SECRET = "a secret of at least thirty-two characters"


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in _SECRET.encode().ljust(64, b"\0"))


@query("fn_40_anonymous_identifier", "tokens", sql=f"SELECT slug, place, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(split_part(address, ',', 1))))) AS identifier FROM tokens")
def _(rows):
    return rows.select("slug", "place", L.anonymous_identifier(F.col("address"), _SECRET).alias("identifier"))


assert len(hmac.new(_SECRET.encode(), b"", hashlib.sha256).digest()) == 32


@query("fn_11_token_words", "tokens", sql="SELECT slug, place, CASE token WHEN 'applications_open' THEN 'Applications Open' WHEN 'in_person' THEN 'In Person' WHEN 'not_found' THEN 'Not Found' ELSE 'X' END AS words FROM tokens")
def _(rows):
    return rows.select("slug", "place", L.words(F.col("token")).alias("words"))


@query("fn_12_canonical_digest", "typed_json", sql="""SELECT slug, sha256(concat('{"apple":[1.5,null],"b":', regexp_extract(doc, '[0-9]+'), ',"cardSha256":"q","Zed":{"X1":true,"y":"é"}}')) AS digest FROM typed_json""")
def _(rows):
    return rows.select("slug", F.sha2(L.canonical_json("doc"), 256).alias("digest"))


@query("fn_39_comparable_facts", "fact_rows", sql="SELECT slug, count(DISTINCT concat(status, '|', coalesce(normalized, value))) AS n FROM fact_rows GROUP BY slug")
def _(facts):
    return facts.groupBy("slug").agg(F.count_distinct(L.comparable(F.col("status"), F.col("normalized"), F.col("value"))).alias("n"))


def _worth(text: str, path: str):
    each = {t: " + ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN {w} ELSE 0 END + CASE WHEN regexp_matches({path}, '(?i){p}') THEN {max(2, w - 3)} ELSE 0 END" for p in ps) for t, w, ps in K.TOPICS}
    lost = " + ".join(f"CASE WHEN regexp_matches({text} || ' ' || {path}, '(?i){p}') THEN {n} ELSE 0 END" for listed, n in ((K.NEGATIVE, 10), (K.STRONG_NEGATIVE, 25)) for p in listed)
    return each, lost


_EACH, _LOST = _worth("text", "path")
_SAME = "(len(list_filter(named, lambda w: w = 'robotics')) > 0 OR len(named) = 0)"


@query("txt_06_link_ranking", "link_rows", sql=rf"""+ a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^\w+://[^/?]*', ''), '[-_+/?.=&]+', ' ', 'g') || CASE WHEN contains(url, '?') THEN '' ELSE ' ' END AS path, list_distinct({_WORDS.format('text')}) AS named, CASE WHEN title = '' THEN [] ELSE ['robotics', 'challenge'] END AS target, regexp_replace(url, '#.*$', '') AS resource FROM link_rows),
b AS (SELECT *, [{", ".join(f"({e})" for e in _EACH.values())}] AS own, list_sum(own) - ({_LOST}) + 5 * len(list_intersect(named, target)) AS score FROM a
WHERE url LIKE 'https://acme.org%' AND NOT regexp_matches(resource, '\.pdf$') AND NOT contains(url, 'poetry') AND NOT regexp_matches(text || ' ' || path, '{K.ACTIONS}') AND NOT (title <> '' AND NOT contains(url, '/programs/robotics') AND text = 'Poetry Contest')),
c AS (SELECT *, CASE WHEN list_max(own) > 0 THEN [{", ".join(f"'{t}'" for t in _EACH)}][list_position(own, list_max(own))] ELSE 'other' END AS topic, row_number() OVER (PARTITION BY page_id, resource ORDER BY score DESC, document_order) AS best FROM b WHERE score > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, topic ORDER BY score DESC, document_order, url) AS nth FROM c WHERE best = 1)
SELECT page_id, place, url, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY nth > 1, score DESC, document_order, url) AS place FROM d) WHERE place <= 6""")
def _(links):
    return K.rank_links(links)


@query("sta_02_concurrent_leases", "events", sql="""WITH e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS s, 1 + (event_type = 'purchase')::INT AS w FROM events)
SELECT a.event_id, coalesce(sum(b.w), 0)::BIGINT AS held FROM e a LEFT JOIN e b ON b.s + 30000 > a.s AND (b.s < a.s OR b.s = a.s AND b.event_id < a.event_id) GROUP BY a.event_id""")
def _(events):
    rows = events.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), (F.when(F.col("event_type") == "purchase", 2).otherwise(1)).cast("long").alias("weight"))
    return admission.concurrent(rows, 30_000)


@query("sta_08_late_progress", "requests", sql="SELECT identifier, max(elapsed) > 864000000 AS late, count(*) AS n FROM (SELECT identifier, greatest(0, (epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY identifier))) AS elapsed FROM requests) GROUP BY identifier")
def _(requests):
    """STA-08, STA-09: runs whose last event lies beyond the total deadline."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return requests.groupBy("identifier").agg((F.max(ms) - F.min(ms) > 864_000_000).alias("late"), F.count("*").alias("n"))
