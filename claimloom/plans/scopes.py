"""Subjects of passages on the driver's documents: a Spark query and independent SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import scope as X
from claimloom.plans.carriers import VIEWS, query
from claimloom.plans.statements import _case

_FIELDS = list(dict.fromkeys(f for fields, _, _ in X.SCOPE_RULES for f in fields))
#: Sentences that stand among the words of a document, so that distances differ.
_SAID = [
    "Account holders must be at least 13.", "Students must be at least 13.", "Governed by the laws of Ohio.", "It is open to students from Ohio.", "A global platform for visitors.", "A parent must supervise the account.", "Our office is in Boston.", "The event is held at our office.", "They live in Ohio and attend school there.",
    "Teachers receive a prize of $500.", "Students receive a cash award.", "A winner’s teacher is awarded $50.", "Funding for a project to build.", "A stipend is provided.", "Accepted students enroll in the program.", "A free seat is awarded.", "This fee is optional.", "Finalists travel to Boston.", "All participants travel if selected.",
    "You may opt in to text messages.", "You are required to submit.", "The jury selects by criteria.", "We collect quiz results of users.", "User content is yours.", "User content of a project is yours.", "The platform has no refunds.", "Tuition is refunded.", "We may suspend our services.", "The program may cancel for safety.", "Masks and distancing are asked for.",
    "They win admission to college.", "Admission to the program, then to a university.", "A college gives the cohort placement at once.", "The application fee is paid once.", "Materials and meals cost $20, depending on need.", "We reimburse the airfare.", "Enrollment in the academy.", "Employer acceptance.",
]
_STRUCTURES = ["costItems.definition", "outcomes.definition", "stages.locations", "stages.travelRequirements", "outcomes.recipientScope", "institutionRelationships.assertion", "stages.requirements", "stages.durations"]
_KINDS = [*X.COST_KINDS, "raffle", "personal_cash_prize", "team_cash_prize", "educator_cash_prize", "stipend", "program_seat", "project_budget", "reimbursement", "individual", "school"]
VIEWS["passages"] = f"SELECT doc_id AS slug, CAST(n_nationkey AS BIGINT) AS n, {_case('n_nationkey', _FIELDS)} AS field_id, CASE doc_id % 9 WHEN 0 THEN 'unclear' WHEN 1 THEN 'conflicting' ELSE 'disclosed' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'A prize for the winning school' ELSE 'A prize' END AS shown, concat(substr(text, 1, CAST(doc_id % 97 AS INT)), ' ', {_case('(doc_id * 7 + n_nationkey * 3)', _SAID)}, ' ', substr(text, 50, CAST((doc_id * n_nationkey) % 60 AS INT)), ' ', {_case('(doc_id + n_nationkey * 11)', _SAID)}) AS passage, {_case('(doc_id * 5 + n_nationkey)', _SAID)} AS second, {_case('(doc_id + n_nationkey)', _STRUCTURES)} AS place, {_case('(doc_id * 3 + n_nationkey)', _KINDS)} AS kind, {_case('(doc_id + n_nationkey * 2)', ['required', 'optional', 'conditional', 'unknown'])} AS requirement, doc_id % 3 = 0 AS scoped FROM documents JOIN nation ON n_nationkey < 25"

_ADMITS = """(SELECT coalesce(bool_or((other > 0 OR near) AND NOT direct), false) FROM (SELECT *, regexp_matches(before, '{else_}') AND len(string_split_regex(before, '{else_}')[-1]) <= 40 AS near, (own > 0 AND own <= 101 AND (other = 0 OR own < other)) OR regexp_matches(before, '{here}\\s*$') AS direct
FROM (SELECT before, CASE WHEN regexp_matches(after, '{else_}') THEN len(string_split_regex(after, '{else_}')[1]) + 1 ELSE 0 END AS other, CASE WHEN regexp_matches(after, '{here_}') THEN len(string_split_regex(after, '{here_}')[1]) + 1 ELSE 0 END AS own
FROM (SELECT right(substr(t, 1, pos), 80) AS before, substr(t, pos + 1 + len(act), 180) AS after FROM (SELECT t, acts[i] AS act, (list_sum(list_transform(rest[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(acts[1:i - 1], lambda x: len(x))), 0))::INT AS pos
FROM (SELECT t, acts, rest, unnest(range(1, len(acts) + 1)) AS i FROM (SELECT {text} AS t, regexp_extract_all({text}, '{act}') AS acts, string_split_regex({text}, '{act}') AS rest))))))
"""


def _says(name: str, text: str) -> str:
    quoted = lambda p: p.replace("'", "''")
    if name == "elsewhere":
        return _ADMITS.format(text=text, act=X.ADMISSION, else_=X.ELSEWHERE, here_=X.HERE, here=X.HERE.removesuffix(r"\b")) + ")"
    source = f"regexp_replace({text}, '{quoted(X.CUTS[name])}', '', 'g')" if name in X.CUTS else text
    return f"regexp_matches({source}, '{quoted(X.PATTERNS[name])}')"


def _off(text: str, elsewhere: str) -> str:
    says = lambda name: elsewhere if name == "elsewhere" else _says(name, text)
    return " OR ".join("(field_id IN ({}) AND {})".format(", ".join(map(repr, fields)), " AND ".join([*map(says, yes), *(f"NOT {says(n)}" for n in no)])) for fields, yes, no in X.SCOPE_RULES)


@query("fn_34_admission_elsewhere", "passages", sql=f"+ p AS (SELECT slug, n, lower(passage) AS low FROM passages WHERE passage IS NOT NULL) SELECT slug, n, {_says('elsewhere', 'p.low')} AS elsewhere, {_says('cash', 'low')} AS cash FROM p")
def _(passages):
    return passages.filter("passage IS NOT NULL").select("slug", "n", X.admits_elsewhere(F.col("passage")).alias("elsewhere"), X.says(F.lower("passage"), "cash").alias("cash"))


@query("flt_17_subject_scope", "passages", sql=f"""+ p AS (SELECT slug, n, field_id, status, shown, lower(passage) AS a, lower(second) AS b FROM passages WHERE passage IS NOT NULL),
q AS (SELECT *, {_says('elsewhere', 'p.a')} AS ea, {_says('elsewhere', 'p.b')} AS eb FROM p)
SELECT slug, n, field_id, status <> 'unclear' AND ((field_id = 'other_benefits' AND shown LIKE '%winning school%') OR {_off('a', 'ea')} OR {_off('b', 'eb')}) AS withheld FROM q""")
def _(passages):
    failed = X.scope_failure(F.col("field_id"), F.col("status"), F.col("shown"), F.array("passage", "second"))
    return passages.filter("passage IS NOT NULL").select("slug", "n", "field_id", failed.alias("withheld"))


def _record_sql() -> str:
    s = lambda name: _says(name, "t")
    stated = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_matches(t, '{v}')" for k, v in X.COST_KINDS.items()) + " ELSE false END"
    cases = [
        (f"place = 'costItems.definition' AND NOT {stated}", "the proposed cost kind is not stated by the cited excerpt"),
        (f"place = 'costItems.definition' AND {s('optional')} AND requirement <> 'optional'", "an optional charge was proposed as a required or conditional participant cost"),
        (f"place = 'costItems.definition' AND {s('conditional')} AND requirement = 'required'", "a conditional charge was proposed as universally required"),
        (f"place = 'costItems.definition' AND requirement = 'optional' AND NOT {s('optional')}", "optional cost treatment is not stated by the cited excerpt"),
        (f"place = 'costItems.definition' AND requirement = 'conditional' AND NOT {s('conditional')}", "conditional cost treatment is not stated by the cited excerpt"),
        (f"place = 'outcomes.definition' AND kind IN ('personal_cash_prize', 'team_cash_prize') AND ({s('project_funding')} OR NOT {s('cash')} OR {s('educators')})", "the cited excerpt does not establish unrestricted participant or team cash"),
        (f"place = 'outcomes.definition' AND kind = 'educator_cash_prize' AND (NOT {s('cash')} OR NOT {s('educators')})", "the cited excerpt does not establish a cash prize for an educator, teacher, or adviser"),
        (f"place = 'outcomes.definition' AND kind = 'stipend' AND NOT {s('stipend')}", "the cited excerpt does not state a stipend"),
        ("place = 'outcomes.definition' AND kind = 'program_seat' AND e", "the cited admission or enrollment targets an external college, university, school, institution, or employer rather than this opportunity"),
        (f"place = 'outcomes.definition' AND kind = 'project_budget' AND NOT {s('project_funding')}", "the cited excerpt does not state restricted project, experiment, build, or venture funding"),
        (f"place = 'outcomes.definition' AND kind = 'reimbursement' AND NOT {s('reimbursed')}", "the cited excerpt does not state reimbursement"),
        (f"place LIKE '%.locations' AND {s('office')} AND NOT {s('taking_part_there')}", "an organizer or office address was proposed as a participant stage location"),
        (f"place LIKE '%.locations' AND {s('residence')} AND NOT {s('taking_part')}", "eligibility geography was proposed as a participant stage location"),
        (f"place IN ('stages.travelRequirements', 'stages.locations', 'stages.durations') AND {s('finalists')} AND NOT {s('everyone')} AND NOT scoped", "a finalist- or winner-only requirement lacked stage or pathway scope"),
        (f"place = 'outcomes.recipientScope' AND {s('educators_or_schools')} AND kind <> 'school'", "the recipient scope conflicts with the teacher or school recipient named in the excerpt"),
        (f"place LIKE 'institution%' AND {s('platform')} AND NOT {s('participants')}", "platform-use language cannot establish an opportunity institution relationship"),
        (f"place = 'stages.requirements' AND {s('optional_messages')} AND NOT {s('requirement')}", "an optional platform or communications service was proposed as an opportunity requirement"),
    ]
    return f"+ p AS (SELECT *, lower(passage || ' ' || second) AS t FROM passages WHERE passage IS NOT NULL), q AS (SELECT *, {_says('elsewhere', 'p.t')} AS e FROM p) SELECT slug, n, CASE " + " ".join(f"WHEN {c} THEN '{m}'" for c, m in cases) + " END AS failure FROM q"


@query("flt_18_record_scope", "passages", sql=_record_sql())
def _(passages):
    place = F.split("place", r"\.")
    failure = X.record_failure(place[0], place[1], F.col("kind"), F.col("requirement"), F.col("scoped"), F.array("passage", "second"))
    return passages.filter("passage IS NOT NULL").select("slug", "n", failure.alias("failure"))
