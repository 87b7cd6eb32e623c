"""Literal cases of subjects and of admissions, the latter against a search by offsets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions import scope as X


def elsewhere(text):
    """By offsets of matches."""
    low = text.lower()
    for act in re.finditer(X.ADMISSION, low):
        before, after = low[max(0, act.start() - 80) : act.start()], low[act.end() : act.end() + 180]
        other, own = re.search(X.ELSEWHERE, after), re.search(X.HERE, after)
        last = [m.end() for m in re.finditer(X.ELSEWHERE, before)]
        near = bool(last) and len(before) - last[-1] <= 40
        direct = bool(own and own.start() <= 100 and (not other or own.start() < other.start())) or re.search(X.HERE[:-2] + r"\s*$", before)
        if (other or near) and not direct:
            return True
    return False


def test_admissions_against_offsets(spark):
    rng = random.Random(9)
    parts = ["admission", "accepted", "seats", "college", "University", "employer", "program", "Cohort", "academy", "to the", "x" * 35, "y" * 60, "\n", ".", "of our", "the schools"]
    texts = ["They win admission to college.", "Admission to the program.", "The program helps students win admission to college.", "College program admission", "", "Program seats", "Admission " + "z" * 101 + " program", "college" + " " * 40 + "admission", "college" + " " * 41 + "admission"]
    texts += [" ".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(600)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.admits_elsewhere(F.col("t")).alias("e")).collect()
    assert {r.i: r.e for r in got} == {i: elsewhere(t) for i, t in enumerate(texts)}
    assert [elsewhere(t) for t in texts[:6]] == [True, False, True, False, False, False]


@pytest.mark.parametrize(
    ("field", "passage", "off"),
    [
        ("ages", "Users of the website must be at least 13.", True), ("ages", "Participants must be at least 13.", False), ("ages", "At least 13.", True), ("ages", "Ages 13 to 18", False),
        ("geographic_restrictions", "These terms are governed by the laws of Ohio.", True), ("geographic_restrictions", "A global network.", True), ("geographic_restrictions", "Open to anyone worldwide.", False), ("citizenship_restrictions", "A global network.", False),
        ("sponsor_requirement", "A parent must consent to the account terms.", True), ("sponsor_requirement", "A parent must consent for each student.", False),
        ("location", "Our headquarters are in Boston.", True), ("location", "Sessions take place at our office campus.", False), ("location", "Applicants must attend school in Ohio.", True),
        ("mentorship", "Teachers receive a kit.", True), ("mentorship", "Students receive a kit; teachers receive one.", False), ("certificate", "The student's teacher is awarded a certificate.", True),
        ("cash_award", "The winner gets $500 cash.", False), ("cash_award", "A trip.", True), ("cash_award", "A cash grant to fund your project.", True), ("cash_award", "A $500 prize.", False),
        ("stipend", "A stipend.", False), ("stipend", "Pay.", True), ("program_seat", "Admission to college.", True), ("program_seat", "Accepted students enroll.", True), ("program_seat", "A free seat in the program.", False),
        ("tuition", "An optional fee.", True), ("tuition", "A fee.", False), ("duration", "Finalists stay a week.", True), ("duration", "All participants stay, finalists too.", False), ("material_terms", "Opt in to SMS.", True), ("material_terms", "You are required to opt in.", False),
        ("selection_process", "A summer of fun.", True), ("selection_process", "Judges review it.", False), ("data_sharing", "We share users' data.", True), ("data_sharing", "Users' quiz results are shared.", False), ("project_license", "User content is ours.", True),
        ("refund_policy", "Our services have no refunds.", True), ("refund_policy", "Services: tuition is refunded.", False), ("cancellation_rights", "We may suspend our services.", True), ("cancellation_rights", "Safety protocol.", True), ("cancellation_rights", "We may cancel for safety.", False), ("unheard_of", "Users.", False),
    ],
)
def test_subjects(spark, field, passage, off):
    assert spark.range(1).select(X.off_subject(F.lit(field), F.lit(passage))).first()[0] is off


def test_facts_and_records(spark):
    fact = lambda status, shown, *passages, field="other_benefits": spark.range(1).select(X.scope_failure(F.lit(field), F.lit(status), F.lit(shown), F.array(*map(F.lit, passages)))).first()[0]
    assert fact("disclosed", "A prize for the winning school", "x") and not fact("unclear", "A prize for the winning school", "x") and not fact("disclosed", None, "x")
    assert fact("conflicting", "10", "A fee.", "An optional fee.", field="tuition") and not fact("disclosed", "10", field="tuition")

    def record(family, slot, kind, passage, requirement=None, scoped=False):
        return spark.range(1).select(X.record_failure(F.lit(family), F.lit(slot), F.lit(kind).cast("string"), F.lit(requirement).cast("string"), F.lit(scoped), F.array(F.lit(passage)))).first()[0]

    assert "kind is not stated" in record("costItems", "definition", "meals", "A fee.", "required") and "kind is not stated" in record("costItems", "definition", None, "A fee.", "required")
    assert "optional charge" in record("costItems", "definition", "other", "An optional fee.", None) and record("costItems", "definition", "other", "An optional fee.", "optional") is None
    assert "universally" in record("costItems", "definition", "other", "A fee, if applicable.", "required") and "conditional cost" in record("costItems", "definition", "other", "A fee.", "conditional")
    assert "cash" in record("outcomes", "definition", "team_cash_prize", "A trip.") and record("outcomes", "definition", "team_cash_prize", "A cash prize.") is None and "educator" in record("outcomes", "definition", "educator_cash_prize", "A cash prize.")
    assert "external" in record("outcomes", "definition", "program_seat", "Admission to college.") and "reimbursement" in record("outcomes", "definition", "reimbursement", "Paid.")
    assert "office" in record("stages", "locations", None, "Our office.") and "finalist" in record("stages", "durations", None, "Winners stay a week.") and record("stages", "durations", None, "Winners stay a week.", scoped=True) is None
    assert "recipient scope" in record("outcomes", "recipientScope", "individual", "For teachers.") and "platform" in record("institutionRelationships", "assertion", None, "Our website.")
    assert "optional platform" in record("stages", "requirements", None, "Opt in to SMS.") and record("stages", "travelRequirements", None, "Opt in to SMS.") is None
