"""The reference's operators on the driver's tables: a Spark query and independent SQL for each.

Cards, facts, costs and claims are read off orders and line items by plain SQL that Spark and DuckDB
share (``VIEWS``); what each operator does with them is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.functions import text as T
from claimloom.operators import facts as O
from claimloom.operators import html
from claimloom.streaming import admission

_STATUS = "CASE WHEN l_returnflag = 'A' THEN 'disclosed' WHEN l_returnflag = 'R' THEN 'conflicting' WHEN l_quantity < 15 THEN 'not_applicable' WHEN l_quantity < 30 THEN 'unclear' ELSE 'not_found' END"
#: Carrier tables, in SQL that both engines take.
VIEWS = {
    "facts": f"SELECT l_orderkey AS slug, l_linenumber AS field_id, {_STATUS} AS status, l_linestatus AS value FROM lineitem",
    "costs": "SELECT l_orderkey AS slug, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS record_id, p_brand AS kind, CASE WHEN l_quantity < 10 THEN 'optional' ELSE 'required' END AS requirement, " + _STATUS.replace("l_quantity < 15", "l_quantity < 5").replace("l_quantity < 30", "l_quantity < 12").replace("ELSE 'not_found'", "WHEN l_quantity < 14 THEN 'not_found' ELSE 'disclosed'").replace("l_returnflag = 'R'", "l_quantity < 3") + " AS status, l_extendedprice AS amount, l_tax > 0.07 AS conditional, l_discount > 0.09 AS scoped, l_discount < 0.01 AS credited, CASE WHEN l_quantity > 48 THEN 'EUR' ELSE 'USD' END AS currency, l_quantity < 47 AS complete FROM lineitem JOIN part ON l_partkey = p_partkey",
    "fee_records": "SELECT *, CASE WHEN amount IS NULL THEN concat(currency, ' ', CAST(CAST(minimum AS BIGINT) AS STRING), ' to ', CAST(CAST(maximum AS BIGINT) AS STRING)) ELSE concat(currency, ' ', CAST(CAST(amount AS BIGINT) AS STRING)) END AS display, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('Seen at ', CAST(l_suppkey AS STRING)) END AS note FROM (SELECT l_orderkey AS slug, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS position, CASE l_partkey % 8 WHEN 0 THEN 'application_fee' WHEN 1 THEN 'deposit' WHEN 2 THEN 'tuition' WHEN 3 THEN 'materials' WHEN 4 THEN 'other' WHEN 5 THEN 'travel' ELSE 'application_fee' END AS kind, concat('Item ', CAST(l_linenumber AS STRING)) AS label, CASE WHEN l_quantity > 46 THEN 'optional' WHEN l_suppkey % 9 = 0 THEN 'conditional' ELSE 'required' END AS requirement, CASE WHEN l_quantity < 3 THEN 'not_found' WHEN l_quantity < 5 THEN 'conflicting' WHEN l_quantity < 6 THEN 'not_applicable' WHEN l_quantity < 8 THEN 'unclear' ELSE 'disclosed' END AS status, l_suppkey % 4 = 0 AS scoped, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_quantity < 25 THEN CAST(100 AS DOUBLE) ELSE CAST(250 AS DOUBLE) END AS amount, CASE WHEN l_partkey % 5 = 0 THEN CAST(100 AS DOUBLE) END AS minimum, CASE WHEN l_partkey % 5 = 0 THEN CAST(300 AS DOUBLE) END AS maximum, CASE WHEN l_suppkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, l_suppkey FROM lineitem) AS r",
    "cards": "SELECT o_orderkey AS slug, o_orderpriority AS category, o_orderstatus AS review_state, CASE WHEN o_orderkey % 5 = 0 THEN 'unclear' ELSE 'disclosed' END AS deadline_status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS iso_date, CASE WHEN o_orderkey % 7 = 0 THEN 'Open until filled' ELSE 'See site' END AS wording, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'online' ELSE 'residential' END AS format, concat(o_orderpriority, ' ', c_name, ' ', c_mktsegment) AS searchable, o_totalprice AS price, o_custkey AS operator_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "requests": "SELECT event_id, ts, user_id AS identifier, event_type AS operation, CAST(1 + event_id % 5 AS BIGINT) AS cost FROM events",
    "variants": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey / 2 AS BIGINT) + (p_partkey * 7) % 400 END AS parent_id FROM part WHERE p_size > 10",
}
TODAY = "1996-06-01"
FIELDS = 7


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _open(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Carrier tables, or tables as they are; nothing stays registered under a common name."""
    return [_with(spark, sf_dir, VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def _with(spark, sf_dir, sql):
    tables = [t for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql)
    return spark.sql(sql.replace("p_partkey / 2", "p_partkey DIV 2"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _sql(body: str) -> str:
    """DuckDB's text: the carriers a query names, then its body."""
    used = [k for k in VIEWS if re.search(rf"\b{k}\b", body)]
    views = ", ".join(f"{k} AS ({VIEWS[k].replace('p_partkey / 2', 'p_partkey // 2')})" for k in used)
    if body.startswith("+R"):
        return f"WITH RECURSIVE {views}, {body[2:]}"
    return f"WITH {views}{', ' if body.startswith('+') and used else ''}{body[1:]}" if body.startswith("+") else f"{'WITH ' + views + ' ' if used else ''}{body}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*_open(spark, sf_dir, *tables))
        if sql:
            SQL[name] = _sql(sql)
        return f

    return add


@query("src_pages_to_blocks", "pages")
def _(pages):
    return html.page_blocks(pages)


@query("txt_05_links", "pages")
def _(pages):
    return html.page_links(pages)


@query("txt_06_link_scores", "pages")
def _(pages):
    rules = [("about", 1, "^a", 9), ("faq", 2, "[eo]s?$", 13), ("other", 3, ".", 5)]
    return O.link_scores(html.page_links(pages), rules, ["login"])


_CANON = r"lower(regexp_extract(b, '^(\w+://[^/?]*)', 1)) || regexp_replace(split_part(b, '?', 1), '^\w+://[^/]*', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END"


@query("fn_15_canonical_url", "pages", sql=rf"""SELECT page_id, {_CANON} AS url, 'page-' || substr(sha256({_CANON}), 1, 16) AS stable_id
FROM (SELECT *, list_filter(CASE WHEN contains(b, '?') THEN string_split(regexp_replace(b, '^[^?]*\?', ''), '&') ELSE [] END, lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=&]*|{'|'.join(T.TRACKING_KEYS)})(=|$)')) AS q FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages))""")
def _(pages):
    url = T.canonical_url(F.col("url"))
    return pages.select("page_id", url.alias("url"), T.stable_page_id(url).alias("stable_id"))


@query("src_07_page_status", "pages", sql=rf"""SELECT 'page-' || substr(sha256({_CANON}), 1, 16) AS page_id, {_CANON} AS url, strlen(html) AS n_bytes, CASE WHEN b IS NULL THEN 'no_url' WHEN html IS NULL THEN 'no_html' WHEN strlen(html) > 1500000 THEN 'too_large' ELSE 'read' END AS status
FROM (SELECT *, list_filter(CASE WHEN contains(b, '?') THEN string_split(regexp_replace(b, '^[^?]*\?', ''), '&') ELSE [] END, lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=&]*|{'|'.join(T.TRACKING_KEYS)})(=|$)')) AS q FROM (SELECT html, regexp_replace(url, '#.*$', '') AS b FROM pages))""")
def _(pages):
    return html.page_status(pages)


@query("fn_14_fingerprint", "documents", sql=r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fingerprint FROM documents")
def _(docs):
    return docs.select("doc_id", T.text_fingerprint(F.col("text")).alias("fingerprint"))


@query("set_06_duplicate_texts", "documents", sql=r"SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(docs):
    return docs.groupBy(T.text_fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("jn_08_containment", "documents", "benchmark", sql=r"""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(regexp_replace(d.text, '\s+', ' ', 'g')), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))))""")
def _(docs, items):
    """Excerpts meet texts on the hash of inner words, which any text that holds them has whole; then the test itself.

    These are words 2 to 4 of five or more, both inner words of four and the one of three. Excerpts of one
    or two words have none, and are tried on every text.
    """
    words = lambda c: F.split(F.lower(T.normalize_whitespace(F.col(c))), " ")
    docs, items = (x.withColumn("text", T.compatible(F.col("text"))) for x in (docs, items))
    items = items.select("item_id", F.col("text").alias("excerpt"), words("text").alias("own")).withColumn("n", F.size("own"))
    tokens = docs.select("doc_id", words("text").alias("w"))
    texts = docs.select("doc_id", "text")
    found = texts.join(F.broadcast(items.filter("n < 3").select("item_id", "excerpt")), T.excerpt_in(F.col("text"), F.col("excerpt"))).select("item_id", "doc_id")
    for size, chosen in ((3, "n >= 5"), (2, "n = 4"), (1, "n = 3")):
        keyed = items.filter(chosen).select("item_id", "excerpt", F.xxhash64(F.array_join(F.slice("own", 2, size), " ")).alias("key"))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, size), " "))))  # noqa: B023
        met = tokens.select("doc_id", F.explode(grams).alias("key")).join(keyed, "key")
        found = found.unionByName(met.join(texts, "doc_id").filter(T.excerpt_in(F.col("text"), F.col("excerpt"))).select("item_id", "doc_id"))
    return found.distinct()


@query("fn_18_tokens", "documents", sql=r"SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3))) AS n_tokens FROM documents")
def _(docs):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))
    return docs.select("doc_id", F.size(w).cast("long").alias("n_tokens"))


@query("fn_33_slug", "documents", sql=r"SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100), '-+$', '') AS slug FROM documents")
def _(docs):
    return docs.select("doc_id", T.slug(F.col("text")).alias("slug"))


#: As ``normalize_whitespace``, in DuckDB.
PLAIN = r"""trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '\s+', ' ', 'g'))"""


@query("fn_22_money_mentions", "documents", sql=f"SELECT doc_id, coalesce(len(regexp_extract_all({PLAIN}, '{E.MONEY}')), 0) AS n_mentions FROM documents")
def _(docs):
    return docs.select("doc_id", F.coalesce(F.size(E.money_mentions(F.col("text"))), F.lit(0)).cast("long").alias("n_mentions"))


@query("fn_21_number_appears", "documents", sql=r"SELECT doc_id, regexp_matches(' ' || text || ' ', '[^0-9.]' || (doc_id % 100) || '[^0-9.]') AS appears FROM documents")
def _(docs):
    return docs.select("doc_id", T.number_appears(F.col("text"), (F.col("doc_id") % 100).cast("string")).alias("appears"))


@query("agg_19_acceptance_rate", "lineitem", sql="SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 AND b >= 0 AND b <= a THEN floor(b::DOUBLE / a * 10000 + 0.5) / 100 END AS rate FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS a, (l_linenumber * 7)::BIGINT AS b FROM lineitem)")
def _(li):
    return li.select("l_orderkey", "l_linenumber", T.acceptance_rate(F.col("l_quantity").cast("long"), (F.col("l_linenumber") * 7).cast("long")).alias("rate"))


@query("flt_01_library_filter", "cards", sql=f"SELECT slug, category FROM cards WHERE contains(lower(searchable), 'building') AND category = '1-URGENT' AND review_state = 'F' AND format = 'online'")
def _(cards):
    return cards.filter(F.contains(F.lower("searchable"), F.lit("building")) & (F.col("category") == "1-URGENT") & (F.col("review_state") == "F") & (F.col("format") == "online")).select("slug", "category")


@query("flt_02_search", "cards", sql="SELECT slug FROM cards WHERE contains(lower(searchable), lower(trim(' MACHINERY ')))")
def _(cards):
    return cards.filter(F.contains(F.lower("searchable"), F.lower(F.trim(F.lit(" MACHINERY "))))).select("slug")


@query("flt_03_status_bucket", "facts", sql="SELECT field_id, count(*) AS n FROM facts WHERE status IN ('not_found', 'unclear', 'conflicting') GROUP BY field_id")
def _(facts):
    return facts.filter(O.matches_disclosure(F.col("status"), "unresolved")).groupBy("field_id").agg(F.count("*").alias("n"))


@query("flt_04_format_family", "cards", sql="SELECT CASE WHEN format IS NULL THEN 'missing' WHEN format = 'online' THEN 'online' ELSE 'in_person' END AS family, count(*) AS n FROM cards GROUP BY 1")
def _(cards):
    family = F.when(F.col("format").isNull(), "missing").when(F.col("format") == "online", "online").otherwise("in_person")
    return cards.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query("flt_05_deadline_state", "cards", sql=f"SELECT slug, CASE WHEN deadline_status <> 'disclosed' THEN 'missing' WHEN iso_date IS NOT NULL THEN CASE WHEN iso_date < '{TODAY}' THEN 'past' ELSE 'upcoming' END WHEN regexp_matches(wording, '(?i)\\b(rolling|open until filled|applications? (are )?open)\\b') THEN 'upcoming' ELSE 'missing' END AS state FROM cards")
def _(cards):
    return cards.select("slug", O.deadline_state(F.col("deadline_status"), F.col("iso_date"), F.col("wording"), TODAY).alias("state"))


@query("flt_06_categories", "cards", sql="SELECT DISTINCT category FROM cards WHERE category <> ''")
def _(cards):
    return cards.filter("category <> ''").select("category").distinct().orderBy("category")


@query("flt_07_review_groups", "cards", sql="SELECT review_state, count(*) AS n FROM cards WHERE review_state IN ('F', 'O') GROUP BY 1")
def _(cards):
    return cards.filter(F.col("review_state").isin("F", "O")).groupBy("review_state").agg(F.count("*").alias("n"))


@query("src_05_point_lookup", "cards", sql="SELECT slug, category, price FROM cards WHERE slug = 33")
def _(cards):
    return cards.filter("slug = 33").select("slug", "category", "price").limit(1)


@query("agg_01_disclosure_count", "facts", sql=f"""SELECT *, disclosed || ' of ' || applicable || ' applicable core facts disclosed' AS label, concat_ws(' · ', assessed || ' of {FIELDS} core areas assessed', CASE WHEN not_found > 0 THEN not_found || ' not found' END, CASE WHEN unclear > 0 THEN unclear || ' unclear' END, CASE WHEN conflicting > 0 THEN conflicting || ' conflicting' END, CASE WHEN not_applicable > 0 THEN not_applicable || ' not applicable' END, CASE WHEN unassessed > 0 THEN unassessed || ' unassessed' END) AS detail_label
FROM (SELECT *, assessed - not_applicable AS applicable, {FIELDS} - assessed AS unassessed FROM (SELECT slug, count(*) FILTER (status = 'disclosed') AS disclosed, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status = 'unclear') AS unclear, count(*) FILTER (status = 'conflicting') AS conflicting, count(*) FILTER (status = 'not_applicable') AS not_applicable, count(*) AS assessed FROM facts GROUP BY slug))""")
def _(facts):
    return O.disclosure_counts(facts, FIELDS)


@query("agg_02_quality_signals", "facts", sql="SELECT slug, count(*) FILTER (status IN ('disclosed', 'conflicting')) AS supported, count(*) FILTER (status <> 'not_applicable') AS applicable, count(*) FILTER (status IN ('not_found', 'unclear')) AS unresolved FROM facts GROUP BY slug")
def _(facts):
    return O.quality_signals(facts)


@query("agg_05_withheld", "facts", sql="SELECT slug, greatest(0, a - r) AS withheld, CASE WHEN a = 0 THEN 0 ELSE greatest(0, a - r)::DOUBLE / a END AS share FROM (SELECT slug, count(*) AS a, count(*) FILTER (status = 'disclosed') AS r FROM facts GROUP BY slug)")
def _(facts):
    g = facts.groupBy("slug").agg(F.count("*").alias("a"), F.count_if(F.col("status") == "disclosed").alias("r"))
    withheld = F.greatest(F.lit(0), F.col("a") - F.col("r"))
    return g.select("slug", withheld.alias("withheld"), F.coalesce(O.ratio(withheld, F.col("a")), F.lit(0.0)).alias("share"))


@query("agg_06_totals", "costs", sql="SELECT slug, round(sum(amount), 2) AS exact_total, sum(floor(amount)::BIGINT)::BIGINT AS minimum_total FROM costs WHERE requirement <> 'optional' GROUP BY slug")
def _(costs):
    return costs.filter("requirement <> 'optional'").groupBy("slug").agg(F.round(F.sum("amount"), 2).alias("exact_total"), F.sum(F.floor("amount").cast("long")).alias("minimum_total"))


@query("agg_07_distinct_counts", "costs", sql="SELECT slug, count(DISTINCT currency) AS currencies, count(DISTINCT kind) AS kinds FROM costs GROUP BY slug")
def _(costs):
    return costs.groupBy("slug").agg(F.count_distinct("currency").alias("currencies"), F.count_distinct("kind").alias("kinds"))


@query("agg_09_ordered_join", "costs", sql="SELECT slug, string_agg(kind, '; ' ORDER BY record_id, kind) AS kinds FROM costs GROUP BY slug")
def _(costs):
    return costs.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "kind"))), lambda x: x["kind"]), "; ").alias("kinds"))


@query("agg_12_micro_average", "documents", "labels", sql="SELECT lang, sum(hit) AS numerator, count(*) AS denominator, sum(hit)::DOUBLE / count(*) AS ratio FROM (SELECT lang, CASE WHEN (n_chars > 1000) = (quality = 1) THEN 1 ELSE 0 END AS hit FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def _(docs, labels):
    hit = ((F.col("n_chars") > 1000) == (F.col("quality") == 1)).cast("long")
    g = docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id").groupBy("lang").agg(F.sum(hit).alias("numerator"), F.count("*").alias("denominator"))
    return g.withColumn("ratio", O.ratio(F.col("numerator"), F.col("denominator")))


@query("agg_13_keyed_burden", "facts", sql="SELECT field_id, status, count(*) AS n FROM facts WHERE status <> 'disclosed' GROUP BY 1, 2 UNION ALL SELECT NULL, 'total', count(*) FROM facts WHERE status <> 'disclosed'")
def _(facts):
    keyed = facts.filter("status <> 'disclosed'").groupBy("field_id", "status").agg(F.count("*").alias("n"))
    return keyed.unionByName(keyed.agg(F.sum("n").alias("n")).select(F.lit(None).cast("int").alias("field_id"), F.lit("total").alias("status"), "n"))


@query("agg_15_token_cost", "orders", sql="SELECT o_orderkey, ((i - c) * 2.0 + c * 0.2 + o * 12.0)::DOUBLE AS micro_usd, ceil((greatest(i - c, 0) * 2.0 + c * 0.2 + o * 12.0) / 1000)::BIGINT AS milli_usd FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS i, (o_custkey * 10)::BIGINT AS c, (o_orderkey % 1000)::BIGINT AS o FROM orders)")
def _(orders):
    i, c, o = F.floor("o_totalprice").cast("long"), F.col("o_custkey") * 10, F.col("o_orderkey") % 1000
    return orders.select("o_orderkey", O.micro_usd(i, c, o).alias("micro_usd"), O.milli_usd(i, c, o).cast("long").alias("milli_usd"))


@query("agg_16_generated_at", "cards", sql="SELECT coalesce(max(iso_date), '1970-01-01T00:00:00.000Z') AS generated_at FROM cards")
def _(cards):
    return cards.agg(F.coalesce(F.max("iso_date"), F.lit("1970-01-01T00:00:00.000Z")).alias("generated_at"))


@query("agg_20_folds", "costs", sql="SELECT slug, bool_and(complete) AS all_complete, bool_or(conditional) AS any_conditional FROM costs GROUP BY slug")
def _(costs):
    return costs.groupBy("slug").agg(F.bool_and("complete").alias("all_complete"), F.bool_or("conditional").alias("any_conditional"))


@query("jn_02_foreign_keys", "variants", sql="SELECT id, parent_id FROM variants v WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM variants p WHERE p.id = v.parent_id)")
def _(variants):
    return variants.filter("parent_id IS NOT NULL").join(variants.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


@query("jn_06_operator_names", "cards", "customer", sql="SELECT slug, c_name AS operator FROM cards JOIN customer ON operator_id = c_custkey")
def _(cards, customer):
    return cards.join(customer, cards.operator_id == customer.c_custkey).select("slug", F.col("c_name").alias("operator"))


@query("jn_07_two_key_lookup", "orders", "customer", "supplier", sql="SELECT o_orderkey, coalesce(c_name, s_name) AS found FROM orders LEFT JOIN customer ON o_custkey * 3 = c_custkey LEFT JOIN supplier ON o_custkey = s_suppkey")
def _(orders, customer, supplier):
    by_id, by_url = customer.select((F.col("c_custkey")).alias("k1"), "c_name"), supplier.select(F.col("s_suppkey").alias("k2"), "s_name")
    return orders.join(by_id, F.col("o_custkey") * 3 == F.col("k1"), "left").join(by_url, F.col("o_custkey") == F.col("k2"), "left").select("o_orderkey", F.coalesce("c_name", "s_name").alias("found"))


@query("jn_10_all_or_nothing", "lineitem", "part", sql="SELECT l_orderkey AS slug, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1 HAVING bool_and(p_partkey IS NOT NULL)")
def _(li, part):
    known = part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    return li.join(known, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("slug")).agg(F.count("*").alias("n"), F.bool_and(F.col("known").isNotNull()).alias("ok")).filter("ok").drop("ok")


@query("jn_11_compare", "facts", sql="SELECT field_id, coalesce(max(c) FILTER (slug = 1), '') AS card_1, coalesce(max(c) FILTER (slug = 2), '') AS card_2, coalesce(max(c) FILTER (slug = 3), '') AS card_3, len(list_distinct([card_1, card_2, card_3])) > 1 AS differs FROM (SELECT slug, field_id, status || '|' || coalesce(value, '') AS c FROM facts WHERE slug IN (1, 2, 3)) GROUP BY field_id")
def _(facts):
    return O.compare(facts, [1, 2, 3])


@query("jn_12_semi_anti", "customer", "orders", sql="SELECT c_custkey, 'kept' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'clash' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(customer, orders):
    key = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    kept = customer.join(key, "c_custkey", "left_anti").select("c_custkey", F.lit("kept").alias("side"))
    return kept.unionByName(customer.join(key.filter("o_orderstatus = 'P'"), "c_custkey", "left_semi").select("c_custkey", F.lit("clash").alias("side")))


@query("jn_15_baseline_wins", "facts", sql="SELECT b.slug, b.field_id, CASE WHEN b.status IN ('disclosed', 'conflicting', 'not_applicable') THEN b.status ELSE coalesce(e.status, b.status) END AS status, CASE WHEN b.status IN ('disclosed', 'conflicting', 'not_applicable') THEN b.value ELSE coalesce(e.value, b.value) END AS value FROM facts b LEFT JOIN (SELECT slug, field_id, 'disclosed' AS status, 'X' AS value FROM facts WHERE field_id % 2 = 0) e ON b.slug = e.slug AND b.field_id = e.field_id")
def _(facts):
    return O.keep_baseline(facts, facts.filter("field_id % 2 = 0").select("slug", "field_id", F.lit("disclosed").alias("status"), F.lit("X").alias("value")))


@query("jn_17_status_agreement", "facts", sql="SELECT t.slug, count(*) AS n, count(*) FILTER (t.status = d.status) AS agreed FROM facts t LEFT JOIN (SELECT slug, field_id, CASE WHEN field_id = 3 THEN 'unclear' ELSE status END AS status FROM facts WHERE field_id < 6) d ON t.slug = d.slug AND t.field_id = d.field_id GROUP BY t.slug")
def _(facts):
    draft = facts.filter("field_id < 6").select("slug", "field_id", F.when(F.col("field_id") == 3, "unclear").otherwise(F.col("status")).alias("draft"))
    return facts.join(draft, ["slug", "field_id"], "left").groupBy("slug").agg(F.count("*").alias("n"), F.count_if(F.col("status") == F.col("draft")).alias("agreed"))


@query("jn_19_two_pass_prune", "variants", sql="+ a AS (SELECT * FROM variants v WHERE parent_id IS NULL OR EXISTS (SELECT 1 FROM variants p WHERE p.id = v.parent_id)) SELECT * FROM a v WHERE parent_id IS NULL OR EXISTS (SELECT 1 FROM a p WHERE p.id = v.parent_id)")
def _(variants):
    return O.prune_orphans(variants)


@query("win_01_progress", "requests", sql="SELECT event_id, row_number() OVER (PARTITION BY identifier ORDER BY ts, event_id) AS sequence, greatest(0, epoch(ts)::BIGINT - min(epoch(ts)::BIGINT) OVER (PARTITION BY identifier)) AS elapsed FROM (SELECT event_id, identifier, date_trunc('second', ts) AS ts FROM requests)")
def _(r):
    r = r.withColumn("ts", F.date_trunc("second", "ts"))
    by = Window.partitionBy("identifier")
    return r.select("event_id", F.row_number().over(by.orderBy("ts", "event_id")).cast("long").alias("sequence"), F.greatest(F.lit(0), F.unix_timestamp("ts") - F.min(F.unix_timestamp("ts")).over(by)).alias("elapsed"))


@query("win_03_runner_up", "costs", sql="SELECT slug, kind, amount FROM (SELECT *, row_number() OVER w AS n, lead(amount) OVER w AS second FROM costs WINDOW w AS (PARTITION BY slug ORDER BY amount DESC, record_id)) WHERE n = 1 AND amount >= 4000 AND (second IS NULL OR second < amount - 1000)")
def _(costs):
    w = Window.partitionBy("slug").orderBy(F.desc("amount"), "record_id")
    top = costs.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("amount").over(w))
    return top.filter("n = 1 AND amount >= 4000 AND (second IS NULL OR second < amount - 1000)").select("slug", "kind", "amount")


@query("win_04_neighbours", "conversations", sql="SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations) WHERE near = 1 OR turn < 2")
def _(conv):
    near = F.max(F.contains(F.lower("text"), F.lit("tion")).cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1))
    return conv.withColumn("near", near).filter("near = 1 OR turn < 2").select("conv_id", "turn")


@query("win_05_running_cap", "conversations", sql="SELECT page_id, block_index, text FROM (SELECT conv_id AS page_id, turn AS block_index, rtrim(CASE WHEN e <= 300 THEN text ELSE substr(text, 1, (300 - (e - length(text)))::BIGINT) END) AS text, e - length(text) AS before FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations)) WHERE before < 300 AND text <> ''")
def _(conv):
    return html.cap_characters(conv.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("block_index"), "text"), 300).withColumn("text", F.rtrim("text"))


@query("win_06_first_prose", "conversations", sql="SELECT page_id, block_index FROM (SELECT conv_id AS page_id, turn AS block_index, length(text) >= 32 AS prose, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS n FROM conversations) WHERE n = 1 OR NOT prose")
def _(conv):
    return html.first_prose(conv.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("block_index"), F.lit("paragraph").alias("kind"), "text")).select("page_id", "block_index")


@query("win_14_first_writer", "costs", sql="SELECT slug, field_id, amount FROM (SELECT slug, kind AS field_id, amount, row_number() OVER (PARTITION BY slug, kind ORDER BY record_id) AS n FROM costs) WHERE n = 1")
def _(costs):
    return O.first_writer(costs.select("slug", F.col("kind").alias("field_id"), F.col("record_id").alias("rule_priority"), "amount")).select("slug", "field_id", "amount")


@query("ord_06_top_per_group", "cards", sql="SELECT category, slug FROM (SELECT category, slug, row_number() OVER (PARTITION BY category ORDER BY price DESC, slug) AS n FROM cards) WHERE n <= 3")
def _(cards):
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("price"), "slug"))
    return cards.withColumn("n", n).filter("n <= 3").select("category", "slug")


@query("set_02_except", "nation", "customer", "supplier", sql="SELECT c_nationkey AS k, 'missing' AS side FROM (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20) UNION ALL SELECT s_nationkey, 'unexpected' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey < 20)")
def _(nation, customer, supplier):
    c, s = customer.select(F.col("c_nationkey").alias("k"), "c_custkey"), supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    missing = c.filter("c_custkey % 2 = 0").select("k").subtract(s.filter("s_suppkey < 20").select("k")).withColumn("side", F.lit("missing"))
    return missing.unionByName(s.select("k").subtract(c.filter("c_custkey < 20").select("k")).withColumn("side", F.lit("unexpected")))


@query("prj_14_cost_fields", "costs", sql="""SELECT slug, kind, CASE WHEN n = d THEN 'disclosed' ELSE first_open END AS status, label, CASE WHEN label = 'scalar' THEN first_amount END AS amount FROM (SELECT *, CASE WHEN n <> d THEN NULL WHEN n = 1 AND NOT sc AND NOT co THEN 'scalar' WHEN co THEN 'Conditional' WHEN amounts = 1 AND NOT sc THEN 'same' ELSE 'Varies by program/cohort' END AS label FROM (SELECT slug, kind, count(*) AS n, count(*) FILTER (status = 'disclosed') AS d, count(DISTINCT (amount, currency)) AS amounts, bool_or(conditional) AS co, bool_or(scoped) AS sc, arg_min(amount, record_id) AS first_amount, arg_min(status, record_id) FILTER (status <> 'disclosed') AS first_open FROM costs WHERE requirement <> 'optional' GROUP BY slug, kind))""")
def _(costs):
    return O.project_costs(costs)


@query("prj_14_four_fields", "fee_records", sql="""+ m AS (SELECT *, CASE WHEN kind IN ('materials', 'other') THEN 'other_mandatory_costs' ELSE kind END AS field_id FROM fee_records WHERE requirement <> 'optional' AND kind <> 'travel'),
w AS (SELECT * FROM m QUALIFY kind = max(kind) OVER (PARTITION BY slug, field_id)),
g AS (SELECT slug, field_id, max(kind) AS kind, count(*) AS n, count(*) FILTER (status = 'disclosed') AS d, bool_or(requirement = 'conditional') AS co, bool_or(scoped) AS sc, count(DISTINCT concat_ws('|', coalesce(amount, -1), coalesce(minimum, -1), coalesce(maximum, -1), currency)) FILTER (status = 'disclosed') AS u, list(amount ORDER BY position)[1] AS a, arg_min(display, position) AS t, string_agg(label || ': ' || display, '; ' ORDER BY position) AS every, arg_min(status, position) FILTER (status <> 'disclosed') AS os, (list(note ORDER BY position) FILTER (status <> 'disclosed'))[1] AS onote FROM w GROUP BY slug, field_id)
SELECT slug, field_id, kind, CASE WHEN n = d THEN 'disclosed' ELSE os END AS status, CASE WHEN n = 1 AND d = 1 AND NOT sc AND NOT co THEN a END AS amount,
CASE WHEN n > d THEN NULL WHEN n = 1 AND NOT sc AND NOT co THEN t WHEN co THEN 'Conditional — see cost details' WHEN u = 1 AND NOT sc THEN t WHEN NOT sc AND kind = 'application_fee' THEN 'Multiple application fees — see cost details' ELSE 'Varies by program/cohort' END AS display,
CASE WHEN n = 1 AND d = 1 AND NOT sc AND NOT co THEN NULL WHEN n = d THEN every WHEN os = 'conflicting' THEN 'Reviewed sources support different amounts for this structured cost; no value was selected.' ELSE onote END AS note,
'costs.' || kind || CASE WHEN n = 1 AND d = 1 AND NOT sc AND NOT co THEN '' WHEN n = d THEN '-matrix' WHEN os = 'conflicting' THEN '-conflicting' ELSE '-unresolved' END AS rule FROM g""")
def _(records):
    return O.project_cost_fields(records)


@query("prj_15_total_cost", "costs", sql="""SELECT slug, rule, CASE WHEN rule = 'sum' THEN round(total, 2) END AS total FROM (SELECT *, CASE WHEN first_open IS NOT NULL THEN 'open:' || first_open WHEN NOT complete THEN 'incomplete' WHEN co THEN 'conditional' WHEN sc THEN 'scoped' WHEN currencies = 1 AND mapped AND kinds = n THEN 'sum' ELSE 'incompatible' END AS rule FROM (SELECT slug, arg_min(status, record_id) FILTER (status <> 'disclosed') AS first_open, bool_and(complete) AS complete, bool_or(conditional) AS co, bool_or(scoped) AS sc, count(DISTINCT currency) AS currencies, bool_and(kind <> 'Brand#11') AS mapped, count(DISTINCT kind) AS kinds, count(*) AS n, sum(amount) AS total FROM costs WHERE requirement <> 'optional' AND NOT credited GROUP BY slug))""")
def _(costs):
    return O.project_total(costs, [f"Brand#{i}" for i in range(100) if i != 11])


@query("pipe_01_evidence", "documents", "benchmark", sql=r"""WITH t AS (SELECT doc_id AS slug, text FROM documents), f AS (SELECT doc_id AS slug, 1 AS field_id, CASE doc_id % 3 WHEN 0 THEN 'disclosed' WHEN 1 THEN 'conflicting' ELSE 'not_found' END AS status FROM documents),
e AS (SELECT doc_id AS slug, k AS candidate, CASE WHEN (doc_id + k) % 4 = 0 THEN 'never in a text' ELSE substr(text, 5 * k, 20) END AS excerpt FROM documents, (SELECT unnest([1, 2]) AS k)),
c AS (SELECT e.slug, candidate, length(lower(trim(regexp_replace(excerpt, '\s+', ' ', 'g')))) > 0 AND contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(excerpt, '\s+', ' ', 'g')))) AS ok FROM e JOIN t ON e.slug = t.slug),
g AS (SELECT slug, count(*) FILTER (ok) AS supported, count(*) FILTER (NOT ok) AS errors, count(DISTINCT candidate) FILTER (ok) AS n FROM c GROUP BY slug)
SELECT f.slug, f.field_id, CASE WHEN status = 'disclosed' AND supported = 0 THEN 'unclear' WHEN status = 'conflicting' AND n < 2 THEN 'unclear' ELSE status END AS status, supported, errors FROM f JOIN g ON f.slug = g.slug""")
def _(docs, _items):
    facts = docs.select(F.col("doc_id").alias("slug"), F.lit(1).alias("field_id"), F.when(F.col("doc_id") % 3 == 0, "disclosed").when(F.col("doc_id") % 3 == 1, "conflicting").otherwise("not_found").alias("status"))
    cut = F.when((F.col("doc_id") + F.col("candidate")) % 4 == 0, "never in a text").otherwise(F.substring("text", 5 * F.col("candidate"), F.lit(20)))
    evidence = docs.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("candidate")).select(F.col("doc_id").alias("slug"), F.lit(1).alias("field_id"), "candidate", F.col("doc_id").alias("source_id"), cut.alias("excerpt"))
    evidence = evidence.withColumn("excerpt", T.compatible(F.col("excerpt")))
    texts = docs.select(F.col("doc_id").alias("source_id"), T.compatible(F.col("text")).alias("text"))
    return O.validate_evidence(facts, evidence, texts, T.excerpt_in(F.col("text"), F.col("excerpt")))


@query("pipe_10_quality_gate", "facts", sql="""+ s AS (SELECT slug, min(CASE WHEN field_id = 1 THEN status END) AS name_status, count(*) FILTER (status IN ('disclosed', 'conflicting')) AS supported, count(*) AS practical_areas, count(*) FILTER (status = 'unclear') AS unresolved_primary, count(*) FILTER (status = 'not_found') AS withheld_areas FROM facts GROUP BY slug),
h AS (SELECT *, list_filter([CASE WHEN name_status <> 'disclosed' THEN 'TARGET_IDENTITY_UNRESOLVED' END, CASE WHEN supported < 5 OR practical_areas < 3 THEN 'TOO_FEW_SUPPORTED_FACTS' END], lambda x: x IS NOT NULL) AS high, list_filter([CASE WHEN withheld_areas > 0 THEN 'CORE_CLAIMS_WITHHELD' END, CASE WHEN unresolved_primary >= 3 THEN 'PRIMARY_COVERAGE_GAPS' END], lambda x: x IS NOT NULL) AS medium FROM s)
SELECT slug, array_to_string(CASE WHEN len(high) > 0 THEN high ELSE medium END, ',') AS reasons, CASE WHEN len(high) > 0 THEN 'insufficient' WHEN practical_areas >= 7 AND withheld_areas = 0 AND unresolved_primary < 3 THEN 'good' ELSE 'usable_with_caveats' END AS outcome, len(high) > 0 AS cache_eligible FROM h""")
def _(facts):
    of = lambda s: F.count_if(F.col("status") == s)
    signals = facts.groupBy("slug").agg(F.min(F.when(F.col("field_id") == 1, F.col("status"))).alias("name_status"), F.count_if(F.col("status").isin("disclosed", "conflicting")).alias("supported"), F.count("*").alias("practical_areas"), of("unclear").alias("unresolved_primary"), of("not_found").alias("withheld_areas"))
    none = {k: F.lit(0) for k in ("attempted", "rejected_ratio", "pages", "important_failures", "high_attention")} | {k: F.lit(False) for k in ("cycle_material", "cycle_modeled", "transient_failure")}
    return O.quality_gate(signals.withColumns(none)).withColumn("reasons", F.array_join("reasons", ","))


@query("sta_01_rate_limit", "requests", sql="SELECT event_id, floor(epoch(ts) / 864000)::BIGINT AS bucket, row_number() OVER (PARTITION BY identifier, operation, floor(epoch(ts) / 864000) ORDER BY ts, event_id) AS place, row_number() OVER (PARTITION BY identifier, operation, floor(epoch(ts) / 864000) ORDER BY ts, event_id) <= 3 AS allowed FROM requests")
def _(r):
    return admission.window_counts(r, 864_000, 3)


@query("sta_03_running_spend", "requests", sql="SELECT event_id, sum(cost) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS day_spend, sum(cost) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total_spend FROM requests")
def _(r):
    return admission.running_spend(r)


@query("sta_04_admission", "requests")
def _(r):
    return admission.admit(r, 3600, 3, 300, 2, 60)


@query("sta_05_failure_cache", "requests", sql="SELECT p.event_id AS probe_id, CASE WHEN e.ts + INTERVAL 3 DAY > p.ts THEN e.event_id END AS entry_id FROM (SELECT * FROM requests WHERE event_id % 3 <> 0) p ASOF LEFT JOIN (SELECT identifier, ts, max(event_id) AS event_id FROM requests WHERE event_id % 3 = 0 GROUP BY 1, 2) e ON p.identifier = e.identifier AND p.ts >= e.ts")
def _(r):
    keyed = r.select(F.col("identifier").alias("key"), "ts", "event_id")
    return admission.latest_valid(keyed.filter("event_id % 3 = 0").withColumnRenamed("event_id", "entry_id"), keyed.filter("event_id % 3 <> 0").withColumnRenamed("event_id", "probe_id"), 3)
