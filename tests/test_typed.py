"""Literal cases of typed values and the passages they are read from."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import alignment as A
from claimloom.functions import text as T

CLAIM = f"slug long, path_key string, display string, excerpts array<string>, source_ids array<long>, value struct<{', '.join(f'{n}: {k}' for n, k in (f.split() for f in A.VALUE.split(', ')))}>, cycle struct<{', '.join(f'{n}: {k}' for n, k in (f.split() for f in A.CYCLE.split(', ')))}>"
REASON = {v: k for k, v in A.FAILURES.items()}


def failures(spark, *cases):
    lines = [json.dumps({"slug": i, "path_key": key, "excerpts": [evidence] if isinstance(evidence, str) else evidence, "display": display, "source_ids": [1], "value": value, "cycle": cycle}) for i, (key, value, evidence, display, cycle) in enumerate(cases)]
    rows = spark.createDataFrame([(line,) for line in lines], "j string").select(F.from_json("j", CLAIM).alias("c")).select("c.*")
    got = {r.slug: REASON.get(r.failure) for r in A.typed_failures(rows).collect()}
    assert len(got) == len(cases)
    return [got[i] for i in range(len(cases))]


def case(value, evidence, display=None, key="amount", cycle=None):
    return key, value, evidence, evidence if display is None else display, cycle


def test_first_reason_of_typed_values(spark):
    usd = {"kind": "exact", "amount": 250, "currency": "USD"}
    span = {"kind": "range", "minimum": 1000, "maximum": 2500.5, "currency": "EUR"}
    day = {"precision": "date", "date": "2027-06-15", "certainty": "stated"}
    time = {"precision": "date_time", "date_time": "2027-06-15T17:00:00-04:00", "certainty": "stated"}
    cycle = {"years": [2027], "source_id": 1, "label": "2027"}
    two = {"years": [2028, 2027], "source_id": 9, "label": "Cycle"}
    cases = {
        "money": [case(usd, "$250", "EUR 250"), case(usd, "250"), case(usd | {"amount": 0}, "no  fee"), case(span, "1000 to 2500.50 dollars"), case(usd, None, ""), case(usd, [], "$250")],
        None: [case(usd, "It costs $250.00", "USD 250"), case(usd | {"amount": 0}, "free of charge"), case(span, "€1,000 or €2500.50"), case(span, "from 1,000 to 2500.5 EUR"), case(None, "anything", key="amount"), case(day, "June 15, 2027"), case(day, "June 15", "June 15, 2027", cycle=cycle), case(day, "Application by June 15", "2027-06-15", cycle=two), case(time, "2027-06-15 5 PM EDT"), case(time, "June 15, 2027, 17:00 -0400"), case({"precision": "month", "year": 2027, "month": 6}, "june 2027"), case(day | {"event": "starts"}, "June 15 – 20", "June 15, 2027", cycle=cycle), case(day | {"event": "ends"}, "May 3 through June 15", "June 15, 2027", cycle=cycle), case(day | {"event": "deadline"}, "Submit it by June 15", "June 15, 2027", cycle=cycle), case(day | {"event": "parade"}, "June 15, 2027"), case({"count": 3, "unit": "weeks", "low": 3}, "3 week"), case({"enums": ["online", "hybrid"]}, "a virtual or hybrid camp", key="formats"), case({"enums": ["levitating"]}, "x", key="formats"), case({"enums": []}, "x", key="formats"), case(None, "Winners are selected", key="advancement"), case({"enter_when": "apply"}, "Apply for a review", "a review", key="steps")],
        "date": [case(day, "June 15"), case(day, "June 16, 2027"), case(day, "June 15", cycle=cycle), case(day, "Last year: June 15", "June 15, 2027", cycle=cycle), case(day, "June 15 of 2026", "June 15, 2027", cycle=cycle), case(day, "Attendance June 15", "June 15, 2027", cycle=two), case(time, "June 15, 2027 at 5 PM EST"), case(time, "June 15, 2027 at 5 PM"), case(time, "June 15, 2027 at 5 AM EDT"), case(time | {"date_time": "2027-06-15"}, "June 15, 2027"), case({"precision": "month", "year": 2027, "month": 13}, "June 2027"), case({"precision": "century"}, "June 2027"), case(day | {"date": None}, "June 15, 2027")],
        "expected": [case(day | {"certainty": "expected"}, "June 15, 2027")],
        "event": [case(day | {"event": "opens"}, "June 15, 2027")],
        "number": [case({"count": 3}, "30"), case({"count": 3}, "3.5"), case({"low": 2, "unit": "weeks"}, "2 days"), case({"minimum_hours": 4}, "4 days"), case({"minimum_hours": 4, "maximum_hours": 6}, "4 hours")],
        "number_display": [case({"count": 3}, "3 teams", "two")],
        "enum": [case({"enums": ["online", "hybrid"]}, "a virtual camp", key="formats")],
        "enum_display": [case({"enums": ["team"]}, "teams", "pairs", key="recipientScope")],
        "advancement": [case(None, "A pitch and an interview", key="advancement")],
        "step": [case({"enter_when": "if finalists"}, "Apply", key="steps"), case({}, "Early decision", "A decision", key="steps")],
    }
    flat = [c for listed in cases.values() for c in listed]
    assert failures(spark, *flat) == [why for why, listed in cases.items() for _ in listed]


@pytest.mark.parametrize("text, minutes, want", [("5 PM UTC-5", -300, False), ("5 PM UTC-5", 0, True), ("at +05:30", 330, True), ("at -0530", -330, True), ("2027-01-15", -1, False), ("noon", 0, False), (None, 0, False)])
def test_offsets(spark, text, minutes, want):
    assert spark.createDataFrame([(text,)], "x string").select(A.offset_appears(F.lit(minutes), F.col("x")).alias("y")).first().y is want


def test_ranges_and_numbers(spark):
    ranges = lambda t: [tuple(r) for r in spark.createDataFrame([(t,)], "x string").select(A.day_ranges(T.normalize_whitespace(F.col("x"))).alias("y")).first().y]
    assert ranges("June 15 – July 4, then may 1 through 9 and June 3") == [(6, 15, 7, 4), (5, 1, 5, 9)] and ranges("") == []
    shown = spark.createDataFrame([(2500.0,), (12.5,), (0.0,), (100.25,), (1e7,)], "n double").select(A.number_text(F.col("n")).alias("s")).collect()
    assert [r.s for r in shown] == ["2500", "12.5", "0", "100.25", "10000000"]


FACT = f"slug long, field_id string, normalized struct<{', '.join(f'{n}: {k}' for n, k in (f.split() for f in A.NORMALIZED.split(', ')))}>, raw string, money_field boolean, display string, excerpts array<string>, source_ids array<long>, cycle struct<years: array<int>, source_id: long, label: string>"
FLAT_REASON = {v: k for k, v in A.FLAT_FAILURES.items()}


def test_first_reason_of_summary_facts(spark):
    of = lambda kind, **given: {"kind": kind} | given
    text = lambda field, own, said: (field, of("text", text=own), None, False, "", [said])
    cases = [
        (("cost", of("money", amount=5, currency="EUR"), None, True, "€5", ["5 EUR"]), None), (("cost", of("money", amount=5, currency="EUR"), None, True, "5", ["5 EUR"]), "money"),
        (("weekly_hours", of("hours", minimum=2, maximum=4), None, False, "2-4 hours", ["2 to 4 hrs weekly"]), None), (("weekly_hours", of("hours", minimum=2, maximum=4), None, False, "2-4 hours", ["2 to 4 hrs"]), "hours"), (("x", of("hours"), None, False, "2 hours", ["2 hours"]), "hours"),
        (("x", of("percentage", number=12.5), None, False, "12.5%", ["12.5 percent"]), None), (("x", of("percentage", number=12.5), None, False, "12.5%", ["12.5 of 100"]), "percentage"),
        (("meals_included", of("boolean", flag=False), None, False, None, ["Food is at your expense"]), None), (("meals_included", of("boolean", flag=True), None, False, None, ["Lodging is included"]), "boolean"), (("certificate", of("boolean", flag=False), None, False, None, ["The certificate isn't given"]), None),
        (("x", of("participation_format", text="hybrid"), None, False, "Hybrid", ["hybrid"]), None), (("x", of("participation_format", text="floating"), None, False, "floating", ["floating"]), "participation_format"),
        (text("ages", "14 to 18", "Ages 14 to 18"), None), (text("ages", "15", "Ages 14 to 18"), "ages"), (text("ages", "ages 14 to 16", "16, ages 14 to 18"), "age_range"), (text("sponsor_requirement", "A teacher must sign", "A teacher must sign; optional"), "required"), (text("entry_format", "solo", "one team"), "alone"), (text("other", "anything", ""), None), (("ages", of("text_list", texts=["9", "10"]), None, False, "", ["9"]), "ages"),
        (("cost", None, "$1,000.5", True, "1000.5", ["1000.5 a year"]), None), (("cost", None, "1000", True, None, ["1000.5"]), "raw_money"), (("cost", None, "free", True, None, ["paid"]), "raw_free"), (("cost", None, None, True, None, None), None), (("cost", None, "1000", False, None, []), None), (("x", of("relationship", text="y"), None, False, "", [None]), None),
    ]
    lines = [(json.dumps(dict(zip(("field_id", "normalized", "raw", "money_field", "display", "excerpts"), c, strict=True)) | {"slug": i, "source_ids": [1], "cycle": None}),) for i, (c, _) in enumerate(cases)]
    rows = spark.createDataFrame(lines, "j string").select(F.from_json("j", FACT).alias("c")).select("c.*")
    got = {r.slug: FLAT_REASON.get(r.failure, r.failure) for r in A.flat_failures(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


@pytest.mark.parametrize(
    "kind, value, want",
    [
        ("money", "USD 1,250.50", {"amount": 1250.5, "currency": "USD"}), ("money", "1250", None), ("money", "€5 USD", None), ("money", "$5 CAD", {"amount": 5.0, "currency": "CAD"}), ("money", "USD 5 USD", None), ("money", 5.0, None),
        ("percentage", "", {"number": 0.0}), ("percentage", "12 %", {"number": 12.0}), ("percentage", "1e1%", {"number": 10.0}), ("percentage", 101.0, None), ("percentage", "many", None), ("number", "1,200", {"number": 1200.0}), ("number", 1.5, None), ("number", 7.0, {"number": 7.0}),
        ("boolean", " YES ", {"flag": True}), ("boolean", "maybe", None), ("duration", "6 Weeks", {"amount": 6.0, "unit": "weeks"}), ("hours", "4-2 hours", None), ("hours", 3.0, {"minimum": 3.0}), ("date", "February 30, 2027", None), ("text", 4.0, None), ("text", " a  b ", {"text": "a b"}),
        ("text_list", ["a ", " "], {"texts": ["a"]}), ("relationship", "hosted at-institution", {"text": "hosted_at_institution"}), ("participation_format", "underwater", None), ("other", "x", None), ("text", None, None),
    ],
)
def test_coercion(spark, kind, value, want):
    row = (kind, value if isinstance(value, str) else None, value if isinstance(value, float) else None, value if isinstance(value, list) else None)
    rows = spark.createDataFrame([row], "kind string, text string, number double, items array<string>")
    got = rows.select(A.normalized_value(F.col("kind"), F.lit(True), F.col("text"), F.col("number"), F.lit(None).cast("boolean"), F.col("items")).alias("v")).first().v
    assert (None if got is None else {k: v for k, v in got.asDict().items() if v is not None and k != "kind"}) == want
