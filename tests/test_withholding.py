"""Literal cases of withheld facts and collapsed fees."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import withholding as W

FACTS = "slug long, field_id string, status string, value string, display string, failure string, scope string, note string, evidence array<struct<excerpt: string, fits: boolean>>"
CARDS = "slug long, cycle_label string, years array<int>, cycle_modeled boolean, extended boolean, variants_modeled boolean, costs_complete boolean, cash_outcomes int"


def withheld(spark, facts, card=(None, [2026], True, False, True, True, 2)):
    rows = [(1, field, status, value, None, failure, scope, "own", [(e, fits) for e in evidence]) for field, status, value, failure, scope, evidence, fits in facts]
    got = W.withhold(spark.createDataFrame(rows, FACTS), spark.createDataFrame([(1, *card)], CARDS))
    return {r.field_id: (r.status, r.rule, r.note) for r in got.collect()}


def fact(field, *evidence, status="disclosed", value=None, failure=None, scope=None, fits=True):
    return (field, status, value, failure, scope, evidence, fits)


def test_earlier_rules_count(spark):
    affiliation = ("Our founders studied at Lake College",)
    got = withheld(spark, [fact("institution_relationship", *affiliation), fact("relationship_explanation", "Whatever", status="conflicting"), fact("location", "Online")])
    assert got["institution_relationship"][:2] == got["relationship_explanation"][:2] == ("unclear", "affiliation") and got["location"] == ("disclosed", None, "own")
    # a relationship that an earlier rule withheld takes no explanation with it
    got = withheld(spark, [fact("institution_relationship", *affiliation, failure="it is not typed"), fact("relationship_explanation", "Whatever")])
    assert got["institution_relationship"] == ("unclear", "typed_value", "The displayed typed value was withheld because it is not typed.") and got["relationship_explanation"][0] == "disclosed"
    # nor does a conflicting one
    got = withheld(spark, [fact("institution_relationship", *affiliation, status="conflicting"), fact("relationship_explanation", "Whatever")])
    assert got["relationship_explanation"][1] is got["institution_relationship"][1] is None
    both = "The sponsor may cancel or we expel any entrant"
    assert withheld(spark, [fact("cancellation_policy", both)])["cancellation_policy"][1] == "organizer_cancels"
    assert withheld(spark, [fact("cancellation_policy", "We expel a student")])["cancellation_policy"][1] == "removal"
    assert withheld(spark, [fact("start_date", "In 2025", scope="other")], ("Summer 2026", [2026], False, False, True, True, 2))["start_date"][1] == "subject_scope"
    assert withheld(spark, [fact("start_date", "In 2025")], ("Summer 2026", [2026], False, False, True, True, 2))["start_date"][1] == "other_year"


def test_each_rule_and_what_it_spares(spark):
    bare = (None, [2026], False, True, False, False, 1)
    got = withheld(
        spark,
        [fact("operating_organization", "Acme is great"), fact("organization_type", "Acme", fits=False), fact("location", "Our headquarters are in Boston"), fact("data_sharing", "We tell a judge", value="Judges and consultants"), fact("mentorship", "Volunteer to mentor"), fact("grade_levels", "Our programs reach middle school"), fact("duration"), fact("estimated_total_mandatory_cost", "10", status="conflicting"), fact("cash_award", "The top 3 teams"), fact("end_date", "July", status="unclear"), fact("decision_date", "July", status="conflicting")],
        bare,
    )
    assert {k: v[:2] for k, v in got.items()} == {
        "operating_organization": ("unclear", "operator"), "organization_type": ("disclosed", None), "location": ("unclear", "office"), "data_sharing": ("unclear", "sharing"), "mentorship": ("unclear", "volunteers"), "grade_levels": ("unclear", "broad_audience"),
        "duration": ("not_found", "no_variant"), "estimated_total_mandatory_cost": ("conflicting", None), "cash_award": ("unclear", "prize_matrix"), "end_date": ("unclear", None), "decision_date": ("unclear", "no_cycle"),
    }
    assert got["duration"][2] is None
    spared = [fact("operating_organization", "Run by Acme"), fact("institution_relationship", "The program has mentors and is sponsored by Lake College"), fact("location", "At our office; students attend"), fact("mentorship", "Volunteer mentors: students are matched with support"), fact("grade_levels", "Programs for middle school; eligibility is open"), fact("cash_award", "The top 3 teams"), fact("duration", "six weeks"), fact("estimated_total_mandatory_cost", "10"), fact("end_date", "2026")]
    assert {v[1] for v in withheld(spark, spared, ("Summer 2026", [2026], True, True, True, True, 2)).values()} == {None}
    assert withheld(spark, [fact("end_date", "x", fits=False)])["end_date"][1] == "other_opportunity"


@pytest.mark.parametrize(
    ("candidates", "collapses"),
    [
        ([("50", "USD 50", None, None), ("75", "USD 75", None, None)], True),
        ([(None, "fifty", 50.0, "USD"), ("75", "USD 75", None, None)], True),
        ([("50", "USD 50", None, None)], False),
        ([("50", "USD 50", None, None), ("50", "USD 50", None, None)], False),
        ([("50", "USD 50", None, None), ("75", "EUR 75", None, None)], False),
        ([("50", "USD 50", None, None), ("80", "USD 80", None, None)], False),
        ([("50", "EUR or USD 50", None, None), ("75", "USD 75", None, None)], False),
    ],
)
def test_fee_alternatives(spark, candidates, collapses):
    schema = "slug long, place int, value string, display string, amount double, currency string, sources array<struct<id: string, url: string, excerpt: string>>"
    make = lambda excerpt, more=(): spark.createDataFrame([(1, i, *c, [("p", "u", excerpt), *more]) for i, c in enumerate(candidates)], schema)
    got = W.collapsed_fees(make("USD 50 for early action or USD 75 for regular decision")).collect()
    assert [r.note for r in got] == (["The source states plan-specific alternatives: " + "; ".join(c[1] for c in candidates) + "."] if collapses else [])
    assert W.collapsed_fees(make("USD 50 and USD 75 for the track")).count() == 0
    assert W.collapsed_fees(make("USD 50 or USD 75")).count() == 0
    assert W.collapsed_fees(make("USD 50 or USD 75 by cohort", [("q", "u", "x")])).count() == 0
    assert W.collapsed_fees(make("USD 50 or USD 75 by cohort").filter(F.lit(False))).count() == 0


def test_repeated_fees_are_read_once(spark, capsys):
    """candidates meet what their wording says; no amount is looked for card by card."""
    excerpt = "Pay USD 50 for early action or USD 75 for regular decision"
    kind = "slug long, place int, value string, display string, amount double, currency string, sources array<struct<id:string,url:string,excerpt:string>>"
    fees = spark.createDataFrame([(slug, n, str(v), f"USD {v}", None, None, [("p", "u", excerpt)]) for slug in range(30) for n, v in enumerate((50, 75))], kind)
    got = W.collapsed_fees(fees)
    got.explain()
    assert "RLIKE" not in capsys.readouterr().out
    assert [(r.slug, r.note) for r in got.orderBy("slug").collect()] == [(slug, "The source states plan-specific alternatives: USD 50; USD 75.") for slug in range(30)]


def test_repeated_excerpts_are_read_once_for_rules(spark, capsys):
    """facts meet what their excerpts say; no pattern is matched fact by fact."""
    card = ("Summer 2026", [2026], True, False, False, True, 2)
    facts = [(slug, field, "disclosed", "x", None, None, None, None, [(said, True)] if said else None) for slug in range(20) for field, said in (("location", "Our office is in Boston"), ("operating_organization", "Run by us"), ("start_date", "Starts in 2025"), ("mentorship", None))]
    got = W.withhold(spark.createDataFrame(facts, FACTS), spark.createDataFrame([(slug, *card) for slug in range(20)], CARDS))
    got.explain()
    assert "RLIKE" not in capsys.readouterr().out
    found = {(r.slug, r.field_id): r.rule for r in got.collect()}
    assert found == {(slug, field): rule for slug in range(20) for field, rule in (("location", "office"), ("operating_organization", None), ("start_date", "other_year"), ("mentorship", None))}


def test_fees_are_gathered_without_copies(spark, capsys):
    """what a card's fees have in common is told by least and greatest, so no row is multiplied before the shuffle; odd rows."""
    said = [("p", "u", "Pay USD 50 for early action or USD 75 for regular decision")]
    kind = "slug long, place int, value string, display string, amount double, currency string, sources array<struct<id:string,url:string,excerpt:string>>"
    fee = lambda slug, place, v, sources=said, display=None, **more: (slug, place, str(v), display or f"USD {v}", more.get("amount"), more.get("currency"), sources)
    fees = [
        fee(1, 0, 50), fee(1, 1, 75), fee(1, 1, 75),  # a row twice is named twice
        fee(2, None, 50, [(None, None, said[0][2])]), fee(2, 1, 75, [(None, None, said[0][2])]),  # no place, source without id
        fee(3, 0, 50, [("p", None, said[0][2])]), fee(3, 1, 75, [(None, None, said[0][2])]),  # null is another id than p
        fee(4, 0, 50), fee(4, 1, 75, [("p", "u", None)]), fee(5, 0, 50), fee(5, 1, 75, None), fee(6, 0, 50), fee(6, 1, 75, [None]), fee(7, 0, 50), fee(7, 1, 75, []),
        fee(8, 0, 50), fee(8, 1, 75, display="USD or EUR 75"), fee(9, 0, 50), fee(9, 1, 50), fee(10, 0, 50), fee(None, 0, 50), fee(None, 1, 75), fee(11, 0, 50), fee(11, 1, 75, amount=75.0),
    ]
    got = W.collapsed_fees(spark.createDataFrame(fees, kind))
    got.explain()
    assert "Expand" not in capsys.readouterr().out
    start = "The source states plan-specific alternatives: "
    assert sorted((str(r.slug), r.note) for r in got.collect()) == [("1", start + "USD 50; USD 75; USD 75."), ("2", start + "USD 50; USD 75."), ("None", start + "USD 50; USD 75.")]
