"""Literal cases of structured records: counting, evidence, pruning and salvage."""

import hashlib
import json
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import html
from claimloom.operators import metadata as M
from claimloom.operators import structures as R


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in (columns or frame.columns)) for r in frame.collect()), key=str)


def test_claims_of_nested_cards(spark):
    claim = {"claimId": "c", "status": "disclosed"}
    cards = [
        (1, json.dumps(claim)),
        (2, json.dumps({"facts": {"a": claim, "b": {"status": "conflicting", "sources": None}}, "x": [claim, [claim], {"y": {"z": claim}}]})),
        (3, json.dumps({**claim, "sources": [claim], "conflictingValues": [claim], "value": {"claimId": None, "status": "disclosed"}})),
        (4, json.dumps([{"claimId": 7, "status": "disclosed"}, {"status": "disclosed"}, {"claimId": "c", "status": "unclear"}, "claimId", None, 5])),
        (5, "no json"),
        (6, None),
        (7, "{}"),
        (8, json.dumps({"facts": [{"stages": claim}]})),
    ]
    assert rows(R.claim_counts(spark.createDataFrame(cards, "slug long, card string"))) == [(1, 1, 1), (2, 3, 5), (3, 1, 2), (4, 0, 1), (5, 0, 0), (6, 0, 0), (7, 0, 0), (8, 0, 1)]
    deep = json.dumps({"a": {"b": {"c": {"d": claim}}}})
    with pytest.raises(ValueError):
        R.claim_counts(spark.createDataFrame([(1, deep)], "slug long, card string"), most_depth=3)
    assert R.claim_counts(spark.createDataFrame([], "slug long, card string")).count() == 0


def test_a_card_is_read_once(spark, monkeypatch):
    """of a card only its counts are written, once; text counts as JSON where ``try_parse_json`` takes it."""
    written, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: written.append(df.columns) or cut(df))
    claim = '{"claimId": "a", "status": "disclosed"}'
    cards = [f" [{claim}] rest", f'[{claim}, {{"k": 1, "k": 2}}]', f"[{claim}, NaN]", f"[{claim}, {'[' * 1001}{']' * 1001}]", f"[{claim}, {'9' * 900}]", f'[{claim}, "\t"]', f"[{claim}, 01]", f"[{claim}", f'{{"facts": [{claim}], "x": [[{claim}]], "sources": {"[" * 150}{"]" * 150}}}', None, "7", claim]
    data = spark.createDataFrame(list(enumerate(cards)), "slug long, card string")
    got = {s: (c, d) for s, c, d in rows(R.claim_counts(data))}
    taken = {r.slug for r in data.filter(F.try_parse_json("card").isNotNull()).collect()}
    assert got == {n: (1, 2) if n == 8 else (1, 1) if n in {0, 4, 11} else (0, 0) for n in range(12)}
    assert taken == {0, 4, 8, 10, 11} and written == [["slug", "c", "d", "depth"]]


def test_evidence_rules(spark):
    claims = spark.createDataFrame(
        [(1, "cycle", "a", "disclosed", None), (1, "organizations", "b", "disclosed", None), (1, "stages", "c", "not_applicable", None), (1, "stages", "d", "conflicting", "of its scope"), (1, "stages", "e", "disclosed", None)],
        "slug long, family string, claim_id string, status string, failure string",
    )
    sources = spark.createDataFrame(
        [(1, "a", 0, "p", "opened in 2025"), (1, "b", 0, "q", "An ACME  program"), (1, "d", 0, "p", "Opens in 2026"), (1, "d", 1, "p", "nowhere"), (1, "d", 2, "lost", "Opens"), (1, "e", 0, "q", "")],
        "slug long, claim_id string, candidate int, source_id string, excerpt string",
    )
    texts = spark.createDataFrame([("p", "It opened in 2025. Opens in 2026.", 2026, True), ("q", "an Acme program", 2026, False)], "source_id string, text string, year int, fits boolean")
    got = rows(R.evidence_warnings(claims, sources, texts, F.col("fits")), "claim_id", "source_id", "rule")
    want = [("a", None, "outside_cycle"), ("c", None, "not_applicable"), ("d", "lost", "excerpt_not_found"), ("d", "p", "excerpt_not_found"), ("d", None, "of its scope"), ("e", "q", "excerpt_not_found"), ("e", None, "other_opportunity")]
    assert got == sorted(want, key=str)


def pruned(spark, records, claims, refs, invalid):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    left = R.prune(
        frame([(1, *r) for r in records], "slug long, family string, record_id string"),
        frame([(1, *c) for c in claims], "slug long, family string, record_id string, slot string, claim_id string, status string"),
        frame([(1, *r) for r in refs], "slug long, record_id string, claim_id string, edge string, target string"),
        frame([(1, i) for i in invalid], "slug long, claim_id string"),
    )
    return {r for (r,) in rows(left.records, "record_id")}, {c for (c,) in rows(left.claims, "claim_id")}, {t for (t,) in rows(left.timings, "target")}


def test_every_edge_prunes(spark):
    of = {"o1": "organizations", "o2": "organizations", "r1": "organizationRoles", "i1": "institutionRelationships", "i2": "institutionRelationships", "v1": "variants", "v2": "variants", "v3": "variants", "v4": "variants", "s1": "stages", "s2": "stages", "p1": "pathways", "p2": "pathways", "c1": "costItems", "c2": "costItems", "u1": "outcomes", "y": "cycle"}
    claims = [(f, r, slot, f"{r}.{slot}", "disclosed") for r, f in of.items() for slot in R.REQUIRED[f]]
    claims += [("stages", "s1", "timings", "t1", "disclosed"), ("stages", "s2", "timings", "t2", "disclosed"), ("pathways", "p1", "steps", "p1s1", "disclosed"), ("pathways", "p1", "steps", "p1s2", "disclosed"), ("pathways", "p2", "steps", "p2s2", "disclosed"), ("costItems", "c1", "treatment", "tr1", "disclosed"), ("costItems", "c2", "treatment", "tr2", "unclear"), ("outcomes", "u1", "amount", "a1", "disclosed")]
    refs = [("r1", None, "role", "o1"), ("i1", None, "relationship", "o2"), ("i2", None, "relationship", None), ("v2", None, "parent", "v1"), ("v3", None, "parent", "v2"), ("v4", None, "parent", "v3"), ("p1", None, "pathway_variant", "v1"), ("p1", "p1s1", "step", "s1"), ("p1", "p1s2", "step", "s2"), ("p2", "p2s2", "step", "s2"), ("c1", "tr1", "treatment", "c2"), ("y", None, "timing", "t1"), ("y", None, "timing", "t2")]
    records = [(f, r) for r, f in of.items()]
    kept, stay, timed = pruned(spark, records, claims, refs, [])
    assert set(of) - kept == {"i2"} and {c[3] for c in claims} - stay == {"i2.assertion", "tr2"} and timed == {"t1", "t2"}
    assert set(of) - pruned(spark, records, claims, refs, ["o1.kind"])[0] == {"i2", "o1", "r1"}
    # parents are looked up twice: the fourth of a chain stays
    assert set(of) - pruned(spark, records, claims, refs, ["v1.definition"])[0] == {"i2", "v1", "v2", "v3", "p1"}
    kept, stay, timed = pruned(spark, records, claims, refs, ["s2.definition", "a1"])
    assert set(of) - kept == {"i2", "s2", "p2"} and "p1s1" in stay and not stay & {"p1s2", "a1", "t2"} and timed == {"t1"}
    kept, stay, timed = pruned(spark, records, claims, refs, ["c2.amount", "t1"])
    assert "c2" not in kept and "c1" in kept and "tr1" not in stay and timed == {"t2"}
    assert "u1" not in pruned(spark, records, claims, refs, ["u1.recipientScope"])[0]
    assert pruned(spark, records, claims, refs, ["y.cycleType"])[2] == set()


def test_salvage(spark):
    records = [
        *[(1, f, i, f"{f}-{i}") for f in ("organizations", "organizationRoles") for i in (0, 1)],  # valid: whole
        (2, "organizations", 0, "a"), (2, "organizations", 1, "b"), (2, "organizationRoles", 0, "ra"), (2, "organizationRoles", 1, "rb"),  # a is faulty, ra hangs on it
        *[(3, "variants", i, f"v{i}") for i in range(6)], (3, "pathways", 0, "p"), (3, "cycle", 0, "y"),  # v0 <- v1 <- v2; v3 <-> v4; v5 has no parent that exists
        (4, "variants", 0, "x"), (4, "variants", 1, "x"), (4, "stages", 0, "s"), (4, "organizations", 0, "late"),  # repeated id; late needs s, which comes later
    ]
    refs = [(1, "organizationRoles-0", "organizations-1"), (2, "ra", "a"), (2, "rb", "b"), (3, "v1", "v0"), (3, "v2", "v1"), (3, "v3", "v4"), (3, "v4", "v3"), (3, "v5", "none"), (3, "p", "v2"), (4, "late", "s")]
    faulty = [(2, "a"), (3, "y")]
    taken, warnings = R.salvage(spark.createDataFrame(records, "slug long, family string, place int, record_id string"), spark.createDataFrame(refs, "slug long, record_id string, target string"), spark.createDataFrame(faulty, "slug long, record_id string"))
    got = {(r.slug, r.place, r.record_id) for r in taken.collect()}
    assert {(s, p, r) for s, _, p, r in records} - got == {(2, 0, "a"), (2, 0, "ra"), (3, 3, "v3"), (3, 4, "v4"), (3, 5, "v5"), (3, 0, "y"), (4, 1, "x"), (4, 0, "late")}
    problems = {(r.slug, r.family, r.record_id, r.problem) for r in warnings.collect()}
    assert (3, "cycle", "y", "family withheld") in problems and (4, "organizations", None, "family withheld") in problems and (4, "variants", "x", "record withheld") in problems
    assert (2, "organizations", None, "family withheld") not in problems and len(problems) == 9
    # whole families of a card without a fault elsewhere may hold mutual references
    both, none = R.salvage(spark.createDataFrame([(1, "variants", 0, "m"), (1, "variants", 1, "n")], "slug long, family string, place int, record_id string"), spark.createDataFrame([(1, "m", "n"), (1, "n", "m")], "slug long, record_id string, target string"), spark.createDataFrame([], "slug long, record_id string"))
    assert both.count() == 2 and none.count() == 0


def test_roles_and_relationships_are_bound_by_their_evidence(spark):
    names = spark.createDataFrame([(1, "o", "The Acme Robotics Foundation")], "slug long, organization_id string, name string")
    roles = [("a", "sponsor", "o", "Sponsored by Acme Robotics."), ("b", "sponsor", "o", "Hosted by Acme Robotics."), ("c", "sponsor", "o", "Sponsored by Northern Poetry."), ("d", "other", "o", "acme robotics"), ("e", "host", "gone", "Hosted by Acme Robotics")]
    frame = spark.createDataFrame([(1, *r) for r in roles], "slug long, claim_id string, role string, organization_id string, evidence string")
    assert rows(R.unbound_roles(frame, names), "claim_id") == [("b",), ("c",), ("e",)]
    ties = [("a", "institution_partnered", "o", None, "A partner of Acme Robotics"), ("b", "institution_partnered", "o", None, "There is no partnership with Acme Robotics"), ("c", "credit_partnership", None, "Lake College", "Credit from partner Lake College"), ("d", "credit_partnership", None, "Lake College", "No credit from partner Lake College"), ("e", "independent", None, None, "independent"), ("f", "mentors_affiliated_with", None, "Lake College", "Mentors of Lake College")]
    frame = spark.createDataFrame([(1, *t) for t in ties], "slug long, claim_id string, type string, organization_id string, institution string, evidence string")
    assert rows(R.unbound_relationships(frame, names), "claim_id") == [("b",), ("d",), ("e",)]


def test_faults_of_outcomes_and_relationships(spark):
    outcomes = [("a", "stipend", "cash", None, None), ("b", "stipend", None, None, None), ("c", "project_budget", "cash", None, "team"), ("d", "team_cash_prize", "cash", None, "individual"), ("e", "mentorship", None, None, "team"), ("f", None, None, None, None)]
    got = rows(R.outcome_faults(spark.createDataFrame([(1, *o) for o in outcomes], "slug long, record_id string, type string, nature string, restriction string, recipient string")), "record_id", "message")
    assert [r for r, _ in got] == ["b", "c", "c", "d"] and got[3][1] == "team_cash_prize needs recipient team"
    ties = [("a", "founders_affiliated_with", "founders"), ("b", "founders_affiliated_with", "opportunity"), ("c", "institution_operated", "staff"), ("d", "unclear", "mentors"), ("e", "mentors_affiliated_with", "staff")]
    got = rows(R.relationship_faults(spark.createDataFrame([(1, *t) for t in ties], "slug long, record_id string, type string, subject string")), "record_id")
    assert [r for (r,) in got] == ["b", "c", "e", "e"]


def walk(scripts):
    """The rule by an explicit stack, for pages of any JSON-LD."""
    blocks, seen, used = [], set(), 0
    for script in scripts[:20]:
        try:
            stack = [json.loads(script)] if 0 < len(script) <= 250_000 else []
        except ValueError:
            continue
        n = 0
        while stack and n < M.MOST_NODES:
            value, n = stack.pop(), n + 1
            if isinstance(value, list):
                stack += reversed(value)
            if not isinstance(value, dict):
                continue
            types = value.get("@type")
            types = [types] if isinstance(types, str) else types if isinstance(types, list) else []
            for t, key, kind in M.TEXTS:
                text = value.get(key) if t in types else None
                text = " ".join(text.split()) if isinstance(text, str) else ""
                if text and text.lower() not in seen and used + len(text) <= M.MOST_CHARACTERS:
                    seen.add(text.lower())
                    used += len(text)
                    blocks.append((kind, text))
            children = [value["@graph"]] if isinstance(value.get("@graph"), list) else []
            stack += reversed(children + [value.get(key) for t, key in M.CHILDREN if t in types])
    return blocks


def test_json_ld_against_a_stack(spark, monkeypatch):
    rng = random.Random(8)

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.15:
            return rng.choice([None, 7, "text", True, [], {}])
        if kind < 0.4:
            return [node(depth - 1) for _ in range(rng.randrange(4))]
        types = rng.choice(["Question", "Answer", "Course", "Offer", "Organization", "FAQPage", "Other", ["Question", "FAQPage"], ["Course", 3], None])
        keys = ["name", "text", "description", "duration", "price", "@graph", "mainEntity", "acceptedAnswer", "provider", "offers", "hidden"]
        own = {k: (node(depth - 1) if k in keys[5:] else rng.choice(["Alpha", "alpha", " two  words ", "b" * 40, "", 5, None, "c" * 90])) for k in rng.sample(keys, rng.randrange(2, 9))}
        return {"@type": types, **own} if types else own

    scripts = {i: [rng.choice(["{bad", "", json.dumps(node(5)), json.dumps([node(6), node(6)])]) for _ in range(rng.choice((1, 2, 25)))] for i in range(60)}
    tag = lambda s: f"<script type=\"application/ld+json\">{s}</script>"
    rows_ = [(f"https://a.example.org/{i}", f"<head><!-- {tag('[1]')} -->{''.join(map(tag, own))}</head><p>x</p>") for i, own in scripts.items()]
    pages = spark.createDataFrame([*rows_, ("https://a.example.org/none", "<p>y</p>"), (None, tag("{}")), ("https://a.example.org/null", None)], "url string, html string")
    for nodes, characters in ((10_000, 50_000), (12, 150)):
        monkeypatch.setattr(M, "MOST_NODES", nodes)
        monkeypatch.setattr(M, "MOST_CHARACTERS", characters)
        got = {}
        for r in M.json_ld_blocks(pages).orderBy("page_id", "place").collect():
            got.setdefault(r.page_id, []).append((r.kind, r.text))
        want = {"page-" + hashlib.sha256(f"https://a.example.org/{i}".encode()).hexdigest()[:16]: walk(own) for i, own in scripts.items()}
        assert got == {k: v for k, v in want.items() if v}
    assert M.json_ld_blocks(pages.limit(0)).count() == 0


def test_metadata_follows_the_visible_blocks(spark):
    blocks = spark.createDataFrame([("p", 0, "heading", 1, "Course One"), ("p", 3, "paragraph", None, "Text")], "page_id string, block_index int, kind string, heading_level int, text string")
    extra = spark.createDataFrame([("p", 0, "heading", "COURSE one"), ("p", 1, "definition", "USD"), ("q", 0, "paragraph", "alone")], "page_id string, place int, kind string, text string")
    assert rows(M.with_metadata(blocks, extra), "page_id", "block_index", "text") == [("p", 0, "Course One"), ("p", 3, "Text"), ("p", 5, "USD"), ("q", 0, "alone")]


def test_no_text_leaves_the_join_with_its_excerpts(spark, capsys):
    """texts are dealt once, by their id; the join with claims moves only what was found of them."""
    claims = spark.createDataFrame([(1, "cycle", "c", "disclosed", None), (1, "stages", "d", "disclosed", None)], "slug long, family string, claim_id string, status string, failure string")
    sources = spark.createDataFrame([(1, "c", 0, 5, "Gone"), (1, "c", 1, 5, "gone"), (1, "d", 0, 5, "here"), (1, "d", 1, 5, "gone"), (1, "d", 2, 5, "gone")], "slug long, claim_id string, candidate long, source_id long, excerpt string")
    texts = spark.createDataFrame([(5, "It is Here", 2026, "target")], "source_id long, text string, year int, relevance string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.evidence_warnings(claims, sources, texts, F.col("relevance") == "sibling")
        want = [("c", 5, "excerpt_not_found")] * 2 + [("d", 5, "excerpt_not_found")] * 2 + [("c", None, "other_opportunity"), ("d", None, "other_opportunity")]
        assert sorted(map(str, want)) == sorted(str((r.claim_id, r.source_id, r.rule)) for r in found.collect())
        capsys.readouterr()
        found.explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = capsys.readouterr().out.split("\n\n")
    moved = {n.split("\n")[1].split("#")[0] for n in nodes if ") Exchange" in n.split("\n")[0] and "plain#" in n}
    assert moved == {"Input [4]: [source_id"}


def test_pages_and_scripts_are_parsed_once(spark, monkeypatch, capsys):
    """A script is parsed for its blocks alone, and the visible blocks are those already read."""
    plans, cut = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    pages = spark.createDataFrame([("https://a.example.org/1", '<script type="application/ld+json">{"@type": "Course", "name": " A  course "}</script><p>Some text</p>')], "url string, html string")
    metadata = M.json_ld_blocks(pages)
    assert plans[0].count("parseJson") == 1 and plans[0].count("regexp_extract_all") == 1
    opened = html.parse_pages(pages).select("page_id", F.posexplode("blocks").alias("block_index", "b")).select("page_id", "block_index", "b.*")
    got = M.with_metadata(opened, metadata)
    got.explain()
    assert "MapInPandas" not in capsys.readouterr().out
    assert [(r.block_index, r.kind, r.text) for r in got.orderBy("block_index").collect()] == [(0, "paragraph", "Some text"), (1, "heading", "A course")]


def test_cards_taken_whole_are_not_written_again(spark, monkeypatch):
    """the families of cards at fault are taken up without the rows of the others."""
    records = spark.createDataFrame([(slug, family, n, slug * 10 + n) for slug in (1, 2) for n, family in enumerate(["organizations", "organizationRoles", "stages"])], "slug long, family string, place int, record_id long")
    refs = spark.createDataFrame([(1, 11, 10), (2, 21, 20)], "slug long, record_id long, target long")
    faulty = spark.createDataFrame([(1, 10)], "slug long, record_id long")
    written, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: written.append(df) or cut(df))
    taken, warnings = R.salvage(records, refs, faulty)
    assert rows(taken, "slug", "record_id") == [(1, 12), (2, 20), (2, 21), (2, 22)]
    assert rows(warnings.filter("record_id IS NOT NULL"), "slug", "record_id") == [(1, 10), (1, 11)]
    again = [df for df in written if df.columns == ["slug", "family", "place", "record_id"]]
    assert len(again) > 9 and reduce(DataFrame.unionByName, again).filter("slug = 2").isEmpty()


def test_references_meet_their_records_once(spark, monkeypatch):
    """a reference meets the records it comes from and goes to in one plan, and both lookups share one shuffle of the records."""
    records = spark.createDataFrame([(1, family, n, n) for n, family in enumerate(R.FAMILIES)], "slug long, family string, place int, record_id long")
    refs = spark.createDataFrame([(1, n, n - 1) for n in range(1, 9)] + [(1, 3, 3)], "slug long, record_id long, target long")
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan()) or cut(df))
    taken, warnings = R.salvage(records, refs, spark.createDataFrame([(1, 2)], "slug long, record_id long"))
    assert rows(taken, "record_id") == [(0,), (1,)] and warnings.filter("record_id IS NULL").count() == 6
    lookup = next(p for p in plans if "target_rank" in p.output().toString())
    assert lookup.toString().count("ReusedExchange") == 1


def test_salvage_of_odd_rows(spark):
    """Null cards are whole; a row without place is taken and named; a copy of a row that stays isn't named; no known family never stays in a broken card."""
    records = [(None, "variants", 0, "n"), (None, "variants", 0, "n"), (1, "variants", None, "a"), (1, "variants", 1, "b"), (1, "variants", 1, "b"), (1, "variants", 2, "b"), (1, "other", 0, "o"), (1, None, 0, "z"), (2, "other", 0, "o"), (2, "stages", None, "s"), (3, "cycle", 0, "y"), (3, "cycle", 1, None)]
    refs = [(1, "a", "b"), (1, "gone", "b"), (None, "n", "m"), (3, "y", None), (2, "s", "o"), (2, "s", "o")]
    faulty = [(None, "n"), (1, None), (1, "nobody")]
    taken, warnings = R.salvage(spark.createDataFrame(records, "slug long, family string, place int, record_id string"), spark.createDataFrame(refs, "slug long, record_id string, target string"), spark.createDataFrame(faulty, "slug long, record_id string"))
    assert Counter(map(tuple, taken.collect())) == Counter([(None, "variants", 0, "n")] * 2 + [(1, "variants", None, "a"), (1, "variants", 1, "b"), (2, "other", 0, "o"), (2, "stages", None, "s")])
    named = [(1, "variants", None, "a"), (1, "variants", 2, "b"), (1, "other", 0, "o"), (1, None, 0, "z"), (3, "cycle", 0, "y"), (3, "cycle", 1, None)]
    assert Counter(map(tuple, warnings.collect())) == Counter([(*r, "family withheld" if r[1] == "cycle" else "record withheld") for r in named] + [(1, "other", None, None, "family withheld")])
