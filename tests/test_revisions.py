"""Literal cases of linked pages, imported cards and review records."""

import hashlib
import json
import os

from claimloom.operators import crawl as C
from claimloom.operators import html
from claimloom.operators import revisions as R


def test_crawl(spark):
    body = "<title>Home</title><p><a href=\'/refund#a\'>Refund</a> <a href=\'/rules\'>Rules</a> <a href=\'/apply\'>Apply</a> <a href=\'/apply2\'>Application</a> <a href=\'/faq\'>FAQ</a> <a href=\'/faq?x=1\'>Questions and answers</a></p>"
    rows = [
        ("https://a.example.org/?utm_source=x", body, None), ("https://a.example.org/refund", "<p>Refunds</p>", None), ("https://a.example.org/refund", "<p>Refunds again</p>", None),
        ("https://a.example.org/rules", None, "https://a.example.org/refund"), ("https://a.example.org/apply", "<p>Form</p>", "https://forms.example.net/1"), ("https://a.example.org/apply2", "<p>Form</p>", "https://forms.example.net/2"),
        ("https://a.example.org/faq", None, None), (None, body, None), ("https://b.example.org/", None, None),
    ]
    pages = spark.createDataFrame(rows, "url string, html string, final_url string")
    got = {r.url.split("/", 3)[3]: r.outcome for r in C.crawl(pages).collect()}
    # the redirected rules end where the refund page, ranked before, has ended; only the first application may leave the site
    assert got == {"refund": "reviewed", "rules": "duplicate", "apply": "reviewed", "faq": "no_html", "apply2": C.OTHER_ORIGIN, "faq?x=1": C.NOT_FOUND}
    assert [r.outcome for r in C.crawl(pages.drop("final_url"), 1).collect()] == ["reviewed"]
    assert C.crawl(pages.limit(0)).count() == 0


def test_one_page_of_an_address_gives_the_links_in_whatever_order_rows_come(spark):
    """rows come in another order each time they are read, as from a shuffle of several executors."""
    made = [(f"https://s{n}.example.org/", f"<title>{title}</title><p><a href='/{path}'>{text}</a></p>", None) for n in range(40) for title, path, text in (("Alpha", "fees", "Tuition"), ("Beta", "refund", "Refund"))]
    lost = [(f"https://s{n}.example.org/fees", *gone, None) for n in range(4) for gone in ((None,), ("x" * (html.MOST_BYTES + 1),))]

    def shuffled(frames):
        for pdf in frames:
            yield pdf.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big"))

    schema = "url string, html string, final_url string"
    rows = spark.createDataFrame(made, schema).unionByName(spark.createDataFrame(lost, schema)).coalesce(1)
    got = C.crawl(rows.mapInPandas(shuffled, schema)).select("url", "topic", "outcome").collect()
    assert sorted(map(tuple, got)) == sorted((f"https://s{n}.example.org/fees", "cost", "too_large" if n < 4 else C.NOT_FOUND) for n in range(40))


def test_migrations(spark):
    fact = {"status": "disclosed", "value": "x", "projection": {"schemaVersion": "2.0.0", "rule": 3}}
    old = {"schemaVersion": "2.0.0", "slug": "s", "cardVersion": 4, "reviewState": "human_reviewed", "reviewedAt": "2026-01-01", "facts": {"a": fact, "b": {"status": "unclear", "projection": None}}, "outcomes": {"status": "modeled", "records": []}}
    mid = json.loads(json.dumps(old).replace("2.0.0", "2.1.0"))
    paid = {"records": [{"definition": {"value": {"outcomeType": "stipend"}}, "recipientScope": {"value": "team", "conflictingValues": [{"value": "educator"}]}}]}
    payee = {"records": [{"distribution": {"value": [{"payee": "team"}, {"payee": "school"}]}}]}
    cases = [
        ({"slug": "v1", "schemaVersion": "1.0.0", "cardVersion": 2, "reviewState": "demo", "reviewedAt": None, "facts": {}, "conflicts": [], "summary": "é", "extra": 1}, None),
        (old, None), (mid, None), (mid | {"schemaVersion": "2.2.0", "reviewState": "demo"}, None), (old | {"reviewState": "automated_draft"}, "later_state"), (mid | {"reviewState": "ai_audited"}, "later_state"),
        (old | {"outcomes": paid}, "later_word"), (mid | {"outcomes": paid}, None), (old | {"outcomes": payee}, "later_word"), (mid | {"schemaVersion": "2.0.0"}, "projection_version"), ({"schemaVersion": "3.0.0"}, "unsupported"), ({"slug": "x"}, "undeclared"), ({"schemaVersion": None}, "undeclared"), ([1], "not_json"), ("{", "not_json"), (None, "not_json"), (old | {"facts": None}, None),
    ]
    texts = [(i, c if isinstance(c, str) or c is None else json.dumps(c, ensure_ascii=False)) for i, (c, _) in enumerate(cases)]
    got = {r.slug: r for r in R.migrate(spark.createDataFrame(texts, "slug long, card string")).collect()}
    assert [got[i].fault for i in range(len(cases))] == [f for _, f in cases]
    assert all((got[i].card is None) == (f is not None) for i, (_, f) in enumerate(cases))
    card = lambda i: json.loads(got[i].card)
    digest = hashlib.sha256('{"cardVersion":2,"conflicts":[],"extra":1,"facts":{},"reviewedAt":null,"reviewState":"demo","schemaVersion":"1.0.0","slug":"v1","summary":"é"}'.encode()).hexdigest()
    none = {"status": "unassessed", "records": [], "note": None}
    assert card(0) == {"slug": "v1", "summary": "é", "conflicts": [], "facts": {}, "schemaVersion": "2.2.0", "opportunityId": None, "cycle": {"status": "unassessed", "value": None}, "cardVersion": 3, "reviewState": "draft", "reviewedAt": None, "projectionRefs": {}, "migratedFrom": {"schemaVersion": "1.0.0", "cardVersion": 2, "reviewedAt": None, "cardSha256": digest}, **dict.fromkeys(R.FAMILIES, none)}
    now = {"a": fact | {"projection": {"schemaVersion": "2.2.0", "rule": 3}}, "b": {"status": "unclear", "projection": None}}
    assert card(1) == old | {"schemaVersion": "2.2.0", "cardVersion": 5, "reviewState": "draft", "reviewedAt": None, "facts": now} and card(2) == card(1)
    assert card(3) == cases[3][0] and card(16)["facts"] is None


def test_review_records(spark):
    items = [(s, sec, n, p, f"{sec}:{p}", f"{s}{p}") for s in range(9) for n, sec in enumerate(("source", "final")) for p in range(2)] + [(8, "final", 1, 2, "source:0", None)]
    items = spark.createDataFrame(items, "slug long, section string, section_no int, place int, item_id string, content string")
    own = {r.slug: r for r in R.manifests(items).collect()}
    listed = '[{"id":"source","itemIds":["source:0","source:1"]},{"id":"final","itemIds":["final:0","final:1"]}]'
    assert own[0].manifest_sha256 == own[1].manifest_sha256 == hashlib.sha256(listed.encode()).hexdigest() and own[0].content_sha256 != own[1].content_sha256 and own[8].repeated and own[8].n_items == 5
    cards = [(s, None if s == 6 else "o", 3, "draft" if s == 1 else "human_reviewed", "now") for s in range(9)]
    records = [(s, None if s == 6 else "o", 2 if s == 2 else 3, "now", own[s].manifest_sha256, own[3].content_sha256 if s == 4 else own[s].content_sha256) for s in range(9) if s != 7]
    ticks = [(s, i) for s in range(9) if s != 7 for i in ("source:0", "source:1", "final:0", "final:1")] + [(0, "other"), (3, "final:0")]
    got = R.check_attestations(spark.createDataFrame(cards, "slug long, opportunity_id string, card_version long, review_state string, reviewed_at string"), items, spark.createDataFrame(records, "slug long, opportunity_id string, card_version long, reviewed_at string, manifest_sha256 string, content_sha256 string"), spark.createDataFrame([t for t in ticks if t != (5, "final:1")], "slug long, item_id string"))
    found = {r.slug: (r.verdict, r.n_missing, r.n_unexpected, r.n_repeated) for r in got.collect()}
    assert found == {0: ("items", 0, 1, 0), 1: ("other_state", 0, 0, 0), 2: ("stale", 0, 0, 0), 3: ("items", 0, 0, 1), 4: ("stale", 0, 0, 0), 5: ("items", 1, 0, 0), 6: ("no_identity", 0, 0, 0), 7: ("no_record", None, None, None), 8: ("repeated_items", 0, 0, 0)}


def test_contents_of_a_card_are_dealt_once(spark, capsys):
    """F16: one shuffle brings a card's items together, whatever its sections."""
    items = [(1, "facts", 2, 1, "b", "two"), (1, "sources", 1, 2, "s2", None), (1, "sources", 1, 1, "s1", ""), (1, "facts", 2, 0, "a", "one"), (2, "facts", 2, 0, "a", "one"), (2, "records", 3, 0, "a", "x")]
    got = R.manifests(spark.createDataFrame(items, "slug long, section string, section_no int, place int, item_id string, content string"))
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    listed = '[{"id":"sources","itemIds":["s1","s2"]},{"id":"facts","itemIds":["a","b"]}]'
    held = '[{"content":"","id":"s1"},{"content":null,"id":"s2"},{"content":"one","id":"a"},{"content":"two","id":"b"}]'
    one, two = sorted(got.collect())
    assert one == (1, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(held.encode()).hexdigest(), 4, False)
    assert (two.n_items, two.repeated) == (2, True)
