"""Literal cases of the reference's operators, and every registered query against its SQL."""

import hmac
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom import registry
from claimloom.functions import evidence as E
from claimloom.functions import identity as I
from claimloom.functions import markers as M
from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import cycles, html, library, passages, scoring
from claimloom.operators import facts as O
from claimloom.operators import library as L
from claimloom.operators import links as library_links
from claimloom.operators import projection as P
from claimloom.streaming import admission

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "[" + ",".join(map(_plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def same_rows(spark, query, sql, sf):
    df, con = query(spark, sf), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    same_rows(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, want", [("2027-02-12", "2027-02-12"), ("February 12, 2027", "2027-02-12"), ("2027-02-30", None), ("February 30, 2027", None), ("02/12/27", None)])
def test_dates(spark, value, want):
    assert one(spark, value, T.parse_date) == want


def test_values(spark):
    assert one(spark, "$2,500", lambda x: F.struct(*T.parse_money(x))) == (2500.0, "USD")
    assert one(spark, "a valuable prize", lambda x: F.struct(*T.parse_money(x))) == (None, None)
    assert one(spark, "4 weeks", lambda x: F.struct(*T.parse_duration(x))) == (4.0, "weeks")
    assert one(spark, "6–8 hours per week", lambda x: F.struct(*T.parse_weekly_hours(x))) == (6.0, 8.0)
    assert one(spark, "1,200", T.parse_count) == 1200
    assert one(spark, "", T.parse_count) == 0
    assert one(spark, "in-person", lambda x: T.enum_token(x, ["in_person"])) == "in_person"
    rate = lambda n, a: spark.range(1).select(T.acceptance_rate(F.lit(n), F.lit(a)).alias("r")).first().r
    assert [rate(240, 48), rate(3, 1), rate(0, 0), rate(10, 11)] == [20.0, 33.33, None, None]


def test_slug_of_the_whole_text(spark, tmp_path):
    rows = [(1, "!" * 300 + "Late Words"), (2, "Early " + "日" * 250 + " Late"), (3, None), (4, "x" * 150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.slug for r in registry.queries()["fn_33_slug"](spark, str(tmp_path)).collect()}
    assert got == {1: "late-words", 2: "early-late", 3: None, 4: "x" * 100}


def test_short_excerpts(spark, tmp_path):
    texts = [(1, "The quick brown fox jumps over"), (2, "a red\n foxglove"), (3, "quick"), (4, None)]
    items = ["x", "ick", "k BRO", "ick brown fo", "uick brown fox ju", "he quick brown fox ju", "red fox", "a red fox", "fox red", "brown quick fox", None]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["jn_08_containment"](spark, str(tmp_path)).collect()
    plain = lambda t: " ".join(t.lower().split())
    assert sorted(tuple(r) for r in got) == sorted((i, d) for i, x in enumerate(items) for d, t in texts if x and t and plain(x) in plain(t))


def test_deadline_states(spark):
    state = lambda status, iso, words: spark.range(1).select(O.deadline_state(F.lit(status), F.lit(iso).cast("string"), F.lit(words), "2026-08-12").alias("s")).first().s
    assert [state("disclosed", "2026-08-12", ""), state("disclosed", "2026-08-11", ""), state("disclosed", None, "Open until filled"), state("disclosed", None, "soon"), state("unclear", "2027-01-01", "")] == ["upcoming", "past", "upcoming", "missing", "missing"]


def test_disclosure_label(spark):
    rows = [("c", k, "disclosed" if k == 0 else "conflicting" if k == 1 else "not_found") for k in range(13)]
    got = O.disclosure_counts(spark.createDataFrame(rows, "slug string, field_id int, status string"), 13).first()
    assert got.label == "1 of 13 applicable core facts disclosed"
    assert got.detail_label == "13 of 13 core areas assessed · 11 not found · 1 conflicting"
    with pytest.raises(ValueError):
        O.compare(None, ["one"])


PAGE = """<html><head><title>A — B</title><style>.gone{display:none}</style><script>x</script></head><body><nav><a href="/nav">Nav</a></nav>
<h1>Head</h1><p>First <b>bold</p><p hidden>no</p><p class="gone">no</p><p style="opacity:0.5">half</p><p style="opacity:0">no</p>
<ul><li>one<ul><li>inner</li></ul></li></ul><table><tr><td>a<td>b</tr></table><p>The same prose stands here twice, long enough.</p><p>The SAME prose stands here twice, long enough.</p>
<footer><a href="mailto:x">m</a><a href="https://e.org/f#x">F</a></footer></body></html>"""


def test_pages(spark):
    title, blocks, links = html.read_page("https://e.org/a", PAGE)
    assert title == "A — B"
    assert [(b["kind"], b["text"]) for b in blocks][:6] == [("heading", "Head"), ("paragraph", "First bold"), ("paragraph", "half"), ("list_item", "one"), ("list_item", "inner"), ("table_row", "a | b")]
    assert [x["url"] for x in links] == ["https://e.org/nav", "https://e.org/f"]
    pages = spark.createDataFrame([(1, "https://E.org/a?utm_source=x&k=1#z", PAGE)], "page_id long, url string, html string")
    got = html.page_blocks(pages, 40).orderBy("block_index").collect()
    assert sum(len(r.text) + 1 for r in got) - 1 <= 40 and got[0].page_id.startswith("page-")
    assert html.page_blocks(pages).filter("lower(text) LIKE 'the same%'").count() == 1
    assert one(spark, "https://E.org/a?utm_source=x&k=1#z", T.canonical_url) == "https://e.org/a?k=1"
    deep = "<div>" * 5000 + "<p>x</p>"
    assert html.read_page("https://e.org/", deep)[1][0]["text"] == "x"


def test_admission_order(spark):
    rows = [("u", k, k, c) for k, c in [(0, 1), (1, 1), (2, 1), (400, 100), (401, 1), (402, 1)]]
    events = spark.createDataFrame(rows, "identifier string, event_id long, s long, cost long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.decision for r in admission.admit(events, 3600, 3, 300, 2, 50).collect()}
    assert got == {0: "OK", 1: "OK", 2: "BUSY", 400: "BUDGET", 401: "OK", 402: "RATE"}


def test_admission_state_across_batches(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(200_000), rng.randrange(1, 9), rng.choice("xy"), rng.choice([1, 1, 2])) for k in range(400)]
    events = spark.createDataFrame(rows, "identifier string, event_id long, s long, cost long, operation string, weight int").withColumn("ts", F.timestamp_seconds("s"))
    want, admitted = {}, []
    for who, k, s, cost, operation, weight in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = [r for r in admitted if r[0] == who]
        rate = sum(r[2] // 3600 == s // 3600 and r[4] == operation for r in mine)
        busy = sum(r[5] for r in mine if r[2] + 900 > s)
        today, total = sum(r[3] for r in mine if r[2] // 86_400 == s // 86_400), sum(r[3] for r in mine)
        want[k] = "RATE" if rate >= 2 else "BUSY" if busy + weight > 2 else "BUDGET" if total + cost > 300 or today + cost > 150 else "OK"
        if want[k] == "OK":
            admitted.append((who, k, s, cost, operation, weight))
    assert {"RATE", "BUSY", "BUDGET", "OK"} == set(want.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.event_id: r.decision for r in admission.admit(events, 3600, 2, 900, 2, 300, 150).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert admission.admit(events.limit(0), 3600, 2, 900, 2, 300).count() == 0


def test_page_status(spark):
    pages = spark.createDataFrame([(1, "https://e.org/1", "<p>x"), (2, "https://e.org/2", None), (3, None, "<p>x"), (4, "https://e.org/4", "<p>" + "x" * 100)], "page_id long, url string, html string")
    assert [r.status for r in html.page_status(pages, 50).collect()] == ["read", "no_html", "no_url", "too_large"]
    assert [r.url for r in html.parse_pages(pages, 50).collect()] == ["https://e.org/1"]


def test_compatible_excerpts(spark, tmp_path):
    texts, items = [(1, "The ﬁnal round of ２０２７ pays ＄５００ each"), (2, "plain")], ["the final round of 2027 pays", "$500 each", "pays $50", "ﬁnal round ｏｆ", "pláin"]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["jn_08_containment"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_streaming_counts(spark, tmp_path):
    path = f"{SF}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(SF, pathGlobFilter="events.parquet").select("ts", F.col("user_id").alias("identifier"), F.col("event_type").alias("operation"))
    q = admission.streaming_counts(stream, 86_400).writeStream.outputMode("complete").format("memory").queryName("admission").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM admission").first().n == spark.read.parquet(path).count()


def test_markers(spark):
    one_of = lambda text, f: one(spark, text, f)
    assert one_of("Early decision aside, apply; interviews follow, then semi-finalists.", M.process_markers) == ["application", "interview", "finalist", "semifinal"]
    assert [one_of(x, M.cycle_status) for x in ("Applications are now open", "deadline has passed", "will open", "underway", "has ended", "soon")] == ["applications_open", "applications_closed", "announced", "active", "complete", None]
    assert one_of("Ages 14-18, grades 9 and 10, 2027, 26 of 1,2", M.small_numbers) == [9, 10, 12, 14, 18]
    assert [one_of(x, lambda c: M.age_range(c)) for x in ("between the ages of 14 and 18", "14 to 18 years old", "ages 18-14", "none")] == [(14, 18), (14, 18), None, None]
    assert one_of("https://e.org/a-b_c?x=1&y=caf%C3%A9#z", M.searchable_url) == " a b c  x 1 y café"
    assert one_of("x", lambda c: M.money_range(F.lit(1000.0), F.lit(2500.5), F.lit("USD"))) == "$1,000–$2,500.50"


def test_structured_records(spark):
    roles = spark.createDataFrame([("a", 2, 1, "operator"), ("a", 1, 2, "operator"), ("b", 1, 1, "fiscal_sponsor"), ("c", 1, 9, "operator"), ("d", 1, 1, "operator")], "slug string, role_id int, org_id int, role string")
    orgs = spark.createDataFrame([(1, "One", "nonprofit"), (2, "Two", None)], "org_id int, name string, kind string")
    got = {r.slug: (r.operating_organization, r.organization_type) for r in P.primary_operator(roles, orgs).collect()}
    assert got == {"a": ("Two; One", None), "b": ("One (fiscal sponsor)", None), "d": ("One", "nonprofit")}
    claims = spark.createDataFrame([("a", 1, 1, "x", False, False), ("b", 1, 1, "x", True, False), ("c", 1, 1, "y", False, True), ("c", 1, 2, "x", True, False), ("c", 1, 3, "y", True, False)], "slug string, field_id int, claim_id int, display string, by_variant boolean, by_process boolean")
    got = {r.slug: (r.display, r.note) for r in P.scoped_projection(claims).collect()}
    assert got == {"a": ("x", None), "b": ("Scoped by program/cohort — see details", "x"), "c": ("Varies by program/cohort and stage/pathway", "y; x")}
    outcomes = spark.createDataFrame(
        [("a", 1, "stipend", "S", "team", "cash", 5, "$5"), ("a", 2, "stipend", "T", "team", "in_kind", 5, "$5"), ("a", 3, "team_cash_prize", "P", "team", "cash", 1, "$1"), ("a", 4, "personal_cash_prize", "Q", "individual", "cash", None, None), ("a", 5, "travel", "Trip", "project", None, None, None), ("a", 6, "travel", "No", "educator", None, None, None), ("a", 7, "educator_cash_prize", "E", "team", "cash", 1, "$1")],
        "slug string, outcome_id int, type string, label string, recipient string, nature string, amount long, amount_display string",
    )
    got = {r.field_id: (r.display, r.amount, r.note) for r in P.project_outcomes(outcomes).collect()}
    assert got == {"stipend": ("S — $5/team", 5, None), "cash_award": ("Multiple cash awards — see prize details", None, "P; Q"), "other_benefits": ("Trip", None, None)}


def test_addresses(spark):
    public = lambda u: one(spark, u, U.is_public)
    assert [public(u) for u in ("https://example.org/a", "http://8.8.8.8/", "https://example.org:443/")] == [True] * 3
    refused = ["http://127.0.0.1/", "http://10.1.2.3/", "http://172.31.0.1/", "http://169.254.169.254/", "http://168.63.129.16/", "http://[::1]/", "http://[fd00::1]/", "https://localhost/", "https://a.internal/", "https://intranet/", "https://u:p@example.org/", "https://example.org:8443/", "ftp://example.org/", "https://example.org/" + "a" * 2048, "x"]
    assert [public(u) for u in refused] == [False] * len(refused)
    sensitive = lambda u: one(spark, u, U.is_sensitive)
    assert [sensitive("https://e.org/?" + q) for q in ("accessToken=1", "X-Amz-Signature=1", "api_key=1", "code=2", "#session=3", "#id_token=x&a=1")] == [True] * 6
    assert [sensitive("https://e.org/?" + q) for q in ("monkey=1", "keyboard=2", "source=3", "#section-2", "")] == [False] * 5
    clean = lambda u: one(spark, u, U.canonical)
    assert clean("https://E.org/a?utm_source=x&TTCLID=2&li_fat_id=3&ref=k#z") == "https://e.org/a?ref=k" and clean("https://e.org/?token=1") is None
    assert one(spark, "example.org/x", U.typed_address) == "https://example.org/x" and one(spark, "no dots", U.typed_address) is None


def test_stated_values(spark):
    got = one(spark, "€500, 500 EUR; $ 20; USD 1,250.50 and 7 dollars", E.money_mentions)
    assert [(m.amount, m.currency) for m in got] == [(500.0, "EUR"), (500.0, "EUR"), (20.0, "USD"), (1250.5, "USD")]
    assert one(spark, "Grades 9–12, 7th graders, high school", E.grade_markers) == ["grade-10", "grade-11", "grade-12", "grade-7", "grade-9", "high-school", "middle-school"]
    assert one(spark, "Due February 12, 2027 or 2027-02-30 or 2027-03-01", E.date_mentions) == ["2027-02-12", "2027-03-01"]
    assert one(spark, "Summer Fellowship for Young Scholars at Acme", I.words) == ["summer", "fellow", "young", "scholars", "acme"]
    assert one(spark, "FAQ | QuestBridge National College Match", I.title_words) == ["questbridge", "national", "college", "match"]
    assert one(spark, "https://e.org/programs/alpha-x/apply", I.path_identity) == "alpha-x"
    assert one(spark, '{"Zed": 1.0, "apple": {"b": 2, "B": 1}, "cardSha256": null}', L.canonical_json) == '{"apple":{"b":2,"B":1},"cardSha256":null,"Zed":1}'
    assert one(spark, "1.2.3.4, 5.6.7.8", lambda c: L.anonymous_identifier(c, "s" * 40)) == hmac.new(b"s" * 40, b"1.2.3.4", "sha256").hexdigest()


def test_sources_of_a_target(spark):
    rows = [("a", 0, "https://o.org/p", "QuestBridge National College Match", []), ("a", 1, "https://o.org/q", "National College Admissions Conference | QuestBridge", []), ("a", 2, "https://o.org/r", "FAQ | QuestBridge National College Match", []), ("a", 3, "https://o.org/about", "Who we are", [])]
    got = passages.source_relevance(spark.createDataFrame(rows, "slug string, source_index int, url string, title string, headings array<string>")).orderBy("source_index").collect()
    assert [r.relevance for r in got][::2] == ["target", "target"] and got[3].relevance == "organization_level"
    paths = [("b", 0, "https://o.org/programs/x/a", "X", []), ("b", 1, "https://o.org/programs/y/a", "X", [])]
    assert passages.source_relevance(spark.createDataFrame(paths, "slug string, source_index int, url string, title string, headings array<string>")).filter("source_index = 1").first().relevance == "sibling"


def test_cycles(spark):
    def cycle(*texts):
        rows = [("c", 0, k, "paragraph", t, "Home") for k, t in enumerate(texts)]
        r = cycles.resolve(cycles.candidates(spark.createDataFrame(rows, "slug string, source_index int, block_index int, kind string, text string, title string"))).first()
        return None if r is None else (r.label, r.years, r.season, r.cycle_type)

    assert cycle("Apply for Summer 2027") == ("Summer 2027", [2027], "summer", "seasonal")
    assert cycle("Apply for the 2026-2027 program") == ("2026–2027", [2026, 2027], None, "academic_year")
    assert cycle("Apply for Summer 2027", "Apply for Fall 2028") is None
    assert cycle("no year here") is None
    assert cycle("2026 application for Fall 2027 entry")[0] == "2026 application / Fall 2027 entry"
    assert cycle("Autumn 2027 dates for applications")[2] == "fall"


def test_out_of_sample_totals(spark):
    """The published totals follow from summed counts."""
    s = spark.createDataFrame([(100, 50, 100, 90, 200, 100, 70), (54, 32, 103, 98, 213, 98, 76)], "claims long, correct long, evidence long, evidence_correct long, fields long, agreed long, supported long")
    r = scoring.report(s).first()
    assert (r.precision, r.recall, r.status_agreement, r.evidence_correctness) == (82 / 154, 82 / 146, 198 / 413, 188 / 203)


def test_salvage_has_no_limit(spark):
    chain = spark.createDataFrame([("a", k, k - 1 if k else None) for k in range(12)] + [("b", 1, 0)], "slug string, id int, needs int")
    assert sorted(r.id for r in library.salvaged(chain).filter("slug = 'a'").collect()) == list(range(12)) and library.salvaged(chain).filter("slug = 'b'").isEmpty()


def test_cost_fields(spark):
    """Tiers scoped to programs vary; equal amounts of other currencies aren't one price; the later kind writes the shared field."""
    schema = "slug string, position int, kind string, label string, requirement string, status string, scoped boolean, amount double, minimum double, maximum double, currency string, display string, note string"
    cost = lambda slug, n, kind, amount, scoped=False, currency="USD", requirement="required", status="disclosed", low=None, high=None: (slug, n, kind, f"c{n}", requirement, status, scoped, amount, low, high, currency, f"{currency} {amount or low}", None)
    rows = [
        cost("tiers", 1, "tuition", 3000.0, True), cost("tiers", 2, "tuition", 6000.0, True), cost("scoped_equal", 1, "tuition", 5.0, True), cost("scoped_equal", 2, "tuition", 5.0),
        cost("currencies", 1, "application_fee", 5.0), cost("currencies", 2, "application_fee", 5.0, currency="EUR"), cost("equal", 1, "deposit", 5.0), cost("equal", 2, "deposit", 5.0),
        cost("range", 1, "tuition", None, low=1.0, high=2.0), cost("later", 1, "other", 7.0), cost("later", 2, "materials", 9.0), cost("skip", 1, "tuition", 7.0, requirement="optional"), cost("skip", 2, "travel", 7.0),
        cost("open", 1, "tuition", 1.0), cost("open", 2, "tuition", None, status="conflicting"), cost("if", 1, "deposit", 2.0, requirement="conditional"),
    ]
    got = {r.slug: (r.field_id, r.status, r.amount, r.display, r.rule) for r in O.project_cost_fields(spark.createDataFrame(rows, schema)).collect()}
    varies = "Varies by program/cohort"
    assert got == {
        "tiers": ("tuition", "disclosed", None, varies, "costs.tuition-matrix"), "scoped_equal": ("tuition", "disclosed", None, varies, "costs.tuition-matrix"),
        "currencies": ("application_fee", "disclosed", None, "Multiple application fees — see cost details", "costs.application_fee-matrix"), "equal": ("deposit", "disclosed", None, "USD 5.0", "costs.deposit-matrix"),
        "range": ("tuition", "disclosed", None, "USD 1.0", "costs.tuition"), "later": ("other_mandatory_costs", "disclosed", 7.0, "USD 7.0", "costs.other"),
        "open": ("tuition", "conflicting", None, None, "costs.tuition-conflicting"), "if": ("deposit", "disclosed", None, "Conditional — see cost details", "costs.deposit-matrix"),
    }
    assert O.project_cost_fields(spark.createDataFrame([], schema)).count() == 0


def test_batches_that_are_rejected_have_a_row(spark):
    rows = [(1, i, f"https://a.example.org/{i % 4}") for i in range(5)] + [(2, i, f"https://a.example.org/{i}") for i in range(6)] + [(3, 0, None), (4, 0, "https://b.example.org/"), (4, 1, None)]
    got = L.batch_manifest(spark.createDataFrame(rows, "batch long, place int, url string"), F.col("url")).collect()
    assert sorted((r.batch, r.place) for r in got if r.problem is None) == [(1, 0), (1, 1), (1, 2), (1, 3), (4, 0)]
    assert {r.duplicates for r in got if r.batch == 1} == {1}
    assert sorted((r.batch, r.problem) for r in got if r.problem) == [(2, "too many addresses"), (3, "no address")]


def test_a_quote_that_stands_twice_across_itself_is_left(spark):
    rows = [(1, "a" * 20, "a" * 16), (2, "x a b" + "c" * 16, "ab" + "c" * 16), (3, "abab abababababababab", "abababababababab"), (4, "nothing here at all", "something that is not there"), (5, "short", "short")]
    got = L.unique_match(spark.createDataFrame([(i, 0, t, q) for i, t, q in rows], "slug long, block int, text string, quote string"))
    assert [(r.slug, r.excerpt) for r in got.collect()] == [(2, "a b" + "c" * 16)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[1e-7, 1e-6, 123456789012345680000, 1e21, 1.5e300, -0.0, 0.1, 100, 1.0]", "[1e-7,0.000001,123456789012345680000,1e+21,1.5e+300,0,0.1,100,1]"),
        ("[9007199254740993, 1152921504606846976, -12.50, 1e400]", "[9007199254740992,1152921504606847000,-12.5,null]"),
        ('{"f": 1, "é": 2, "e": 3, "E": 4, "ef": 5}', '{"e":3,"E":4,"é":2,"ef":5,"f":1}'),
        ('{"b": 1, "10": 2, "9": 3, "a_b": 4, "ab": 5, "a1": 6}', '{"9":3,"10":2,"a_b":4,"a1":6,"ab":5,"b":1}'),
        ('["\\u001f\\u007f\\ud800\\"\\\\/é", true, null]', '["\\u001f\x7f\\ud800\\"\\\\/é",true,null]'),
        ("[NaN]", None),
        ("no json", None),
    ],
)
def test_canonical_json_as_a_browser_writes_it(spark, text, want):
    assert one(spark, text, L.canonical_json) == want


def test_a_repeated_passage_is_read_once_for_cycles(spark, capsys):
    """blocks meet what their texts name; no pattern is matched block by block."""
    rows = [(slug, 0, n, "paragraph", text, "T") for slug in range(40) for n, text in enumerate(["Apply for Summer 2027", "nothing here", None])]
    found = cycles.candidates(spark.createDataFrame(rows, "slug long, source_index int, block_index int, kind string, text string, title string"))
    found.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out
    assert {(r.slug, r.block_index, r.label, r.score) for r in found.collect()} == {(slug, 0, label, score) for slug in range(40) for label, score in (("Summer 2027", 15), ("2027", 12))}


def _long_pages(at):
    """Tables whose cards have up to 280 lines, in place of seven at most."""
    at.mkdir(exist_ok=True)
    for t in TABLES:
        if t != "lineitem":
            (at / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.execute(f"COPY (SELECT * REPLACE (CAST(l_linenumber + 7 * k AS INT) AS l_linenumber) FROM '{SF}/lineitem.parquet', range(40) r(k) WHERE l_orderkey < 60) TO '{at}/lineitem.parquet'")
    return str(at)


def test_all_blocks_of_a_page_name_cycles(spark, tmp_path):
    """no block is left for standing late on its page."""
    rows = [(1, 0, n, "paragraph", "Apply for Summer 2027", "T") for n in (0, 79, 80, 81, 5000)]
    found = cycles.candidates(spark.createDataFrame(rows, "slug long, source_index int, block_index int, kind string, text string, title string"))
    assert sorted(r.block_index for r in found.filter("label = 'Summer 2027'").collect()) == [0, 79, 80, 81, 5000]
    same_rows(spark, registry.queries()["fn_36_cycle_candidates"], registry.oracle_sql()["fn_36_cycle_candidates"], _long_pages(tmp_path))


def test_a_late_block_settles_or_contests_a_cycle(spark, tmp_path):
    """as for the first blocks, a later one gives the cycle, its years, or another that is as good."""
    texts = {"late": [(200, "Apply for Summer 2027")], "contested": [(0, "Apply for Summer 2027"), (80, "Apply for Fall 2028")], "continued": [(0, "The application deadline is in Spring 2027"), (300, "Fall 2028 entry")]}
    rows = [(slug, 0, n, "paragraph", text, "Home") for slug, blocks in texts.items() for n, text in blocks]
    got = cycles.resolve(cycles.candidates(spark.createDataFrame(rows, "slug string, source_index int, block_index int, kind string, text string, title string"))).collect()
    assert {r.slug: (r.label, r.years) for r in got} == {"late": ("Summer 2027", [2027]), "continued": ("Spring 2027 / Fall 2028 entry", [2027, 2028])}
    for name in ("win_02_best_by_label", "pipe_02_resolved_cycle"):
        same_rows(spark, registry.queries()[name], registry.oracle_sql()[name], _long_pages(tmp_path / name))


def test_repeated_links_and_passages_are_read_once(spark, capsys):
    """rows meet what their texts say; no pattern is matched row by row."""
    links = spark.createDataFrame([(page, "https://a.org/x", "Robotics", n, "https://a.org/fees", text) for page in range(40) for n, text in enumerate(["Tuition", "Refunds", None])], "page_id long, page_url string, title string, document_order int, url string, text string")
    blocks = spark.createDataFrame([(slug, n % 2, n, text) for slug in range(40) for n, text in enumerate(["It costs $5", "nothing", None, "It costs $5"])], "slug long, source_index int, block_index int, text string")
    ranking, topics = library_links.rank_links(links), passages.topic_passages(blocks)
    ranking.explain()
    topics.explain()
    assert "RLIKE" not in capsys.readouterr().out
    assert {(r.page_id, r.place, r.topic) for r in ranking.collect()} == {(page, 1, "refund") for page in range(40)}
    got = [(r.slug, r.place, r.source_index, r.block_index) for r in topics.filter("topic = 'cost'").collect()]
    assert sorted(got) == [x for slug in range(40) for x in ((slug, 1, 0, 0), (slug, 2, 1, 3))]


def test_records_are_read_once_for_all_passes(spark, capsys):
    """passes read the written records, not what they are made of."""
    made = spark.createDataFrame([(1, 1, "x"), (1, 2, "1"), (1, 3, "2"), (1, 4, "9"), (2, 1, "x")], "slug long, id int, said string").selectExpr("slug", "id", "int(nullif(said, 'x')) AS needs")
    got = L.salvaged(made)
    got.explain()
    assert "LocalTableScan" not in (out := capsys.readouterr().out) and "cast(" not in out
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_costs_of_a_card_are_dealt_once(spark, capsys):
    """distinct amounts, kinds and fields are all settled behind one shuffle by card."""
    kind = "slug long, position long, kind string, label string, requirement string, status string, scoped boolean, amount double, minimum double, maximum double, currency string, display string, note string"
    costs = [(1, 1, "tuition", "A", "required", "disclosed", False, 5.0, None, None, "USD", "USD 5", None), (1, 2, "tuition", "B", "required", "disclosed", False, 5.0, None, None, "USD", "USD 5", None), (1, 3, "deposit", "C", "required", "disclosed", False, 7.0, None, None, "USD", "USD 7", None)]
    got = O.project_cost_fields(spark.createDataFrame(costs, kind))
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert sorted((r.field_id, r.amount, r.display, r.note) for r in got.collect()) == [("deposit", 7.0, "USD 7", None), ("tuition", None, "USD 5", "A: USD 5; B: USD 5")]


def test_material_items_keep_few_maps_at_once(spark):
    """cards are made distinct once, not three times over in one task."""
    from claimloom import registry

    got = registry.queries()["flt_22_material_items"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") <= 6
