"""FLT-17, FLT-18, FN-34: whether a passage speaks of what a field or a record is about, as a table of patterns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of lower-cased passages.
PATTERNS = {
    "participants": r"\b(applicants?|participants?|entrants?|students?|teams?|finalists?|winners?|eligible|eligibility|who can apply|program participants?)\b",
    "platform": r"\b(account(?: holder| creation| access)?s?|platform|website|site|services?|users?|visitor(?:s)?)\b",
    "legal": r"\b(governed by|jurisdiction|venue|choice of law|laws? of|services? (?:are|is) available|access to (?:our|the) services?)\b",
    "requirement": r"\b(eligible|eligibility|must (?:be|have|submit|attend|participate)|required to|requirement|who can apply|applicants? must|participants? must|teams? must)\b",
    "taking_part": r"\b(participat|attend|held at|takes place|session|event|campus|online|virtual|remote|residential|in[ -]person)\b",
    "open_to": r"\b(eligible|eligibility|open to|may apply|who can apply|can join from|must (?:live|reside|attend school|be based)|residents? of|students? from|based in)\b",
    "selection": r"\b(apply|application|review(?:ed)?|interview|select(?:ed|ion)?|judg(?:e|ed|ing)|criteria|decision|shortlist|semifinal|finalist|advance|matching|lottery|first[ -]come|admission)\b",
    "optional": r"\b(optional|elective|add[ -]?on|not required)\b",
    "project_funding": r"\b(project|experiment|build|venture)\b.{0,100}\b(fund|funding|budget|grant)\b|\b(fund|funding|budget|grant)\b.{0,100}\b(project|experiment|build|venture)\b|\b(?:money|funds?|award)\b.{0,80}\bto (?:build|develop|conduct|complete)\b|\b(?:receive(?:s|d)?|provid(?:e|es|ed))\b.{0,50}[$£€]\s?\d[\d,.]*.{0,80}\bto (?:build|develop|conduct|complete)\b",
    "cash": r"\b(cash|prize money|cash award|monetary award|prize funds?)\b|\b(?:prize|award)\s+of\s+[$£€]|\p{Sc}\s?\d[\d,.]*(?:\s+(?:cash|monetary))?\s+(?:prize|award)\b",
    "age": r"\b(?:at least|minimum age|under)\s+\d{1,2}\b",
    "worldwide": r"\b(national|global|international|worldwide|anywhere in the world)\b",
    "guardian": r"\b(parent|guardian)\b.{0,120}\b(supervis|consent|account|terms|services?)\b|\b(supervis|consent|account|terms|services?)\b.{0,120}\b(parent|guardian)\b",
    "office": r"\b(office|headquarters|headquartered|mailing address|contact us|located at)\b",
    "residence": r"\b(reside|residence|live|attend school|school district|congressional district|eligible|eligibility)\b",
    "others_receive": r"\b(teachers?|advisers?|educators?|schools?|mentors?|employees?)\b.{0,60}\b(receive|receives|awarded|provided|eligible for)\b|\b(receive|receives|awarded|provided)\b.{0,60}\b(teachers?|advisers?|educators?|schools?|mentors?|employees?)\b",
    "participants_receive": r"\b(participants?|students?|entrants?|teams?|finalists?|winners?)\b.{0,60}\b(receive|receives|awarded|provided|eligible for)\b|\b(receive|receives|awarded|provided)\b.{0,60}\b(participants?|students?|entrants?|teams?|finalists?|winners?)\b",
    "stipend": r"\bstipend\b",
    "admitted": r"\b(accept(?:ed|ance)|admission)\b.{0,100}\b(enroll|enrollment|program)\b",
    "awarded": r"\b(award(?:ed)?|prize|scholarship|waiv(?:e|ed)|free|complimentary|receive(?:s|d)?)\b",
    "finalists": r"\b(finalists?|winners?|semifinalists?|selected teams?|advancing teams?)\b",
    "everyone": r"\b(all|every)\s+(?:applicants?|participants?|teams?)\b",
    "if_selected": r"\bapplicants? who (?:advance|are selected)|if selected\b",
    "optional_service": r"\b(optional|opt(?:ing)? in|text messages?|sms|notifications?|account feature)\b",
    "optional_messages": r"\b(optional|opt(?:ing)? in|sms|text messages?|account feature)\b",
    "program_data": r"\b(program (?:projects?|submissions?|progress|communications?|staff|instructors?|delivery)|delivering the program|projects? and submissions?|modules? completed|quiz results?)\b",
    "applicant_data": r"\b(applicant|participant|student|program application|mentor matching)\b",
    "user_content": r"\buser content\b",
    "work": r"\b(project|submission|entry|experiment|research|work product)\b",
    "a_service": r"\bplatform|services?\b",
    "a_payment": r"\b(tuition|program fee|deposit|payment|purchase|enrollment)\b",
    "stops_services": r"\b(alter|suspend|discontinue|terminate)\b.{0,80}\b(?:our|the) services?\b",
    "program": r"\b(program|competition|challenge|cohort|participation)\b",
    "health": r"\b(health|safety|mask|distancing|protocol|protective measure)\b",
    "changes": r"\b(cancel|postpone|suspend|terminate|discontinue|change (?:the )?(?:program|competition|challenge|schedule|rules|format))\b",
    "educators": r"\b(teachers?|educators?|advisers?|advisors?)\b",
    "educators_or_schools": r"\b(teachers?|schools?|educators?|advisers?|advisors?)\b",
    "conditional": r"\b(conditional|depending on|depends on|varies by|only if|if selected|if applicable|scholarship[- ]adjusted)\b",
    "reimbursed": r"\breimburs(?:e|ed|ement)\b",
    "taking_part_there": r"\b(participat|attend|held at|takes place|session|event|campus)\b",
}
#: What is cut from a passage before these patterns are looked for.
CUTS = {
    "taking_part": r"\battend school\b",
    "participants_receive": r"\b(?:student|participant|entrant|finalist|winner)(?:'s|’s)\s+(?:teacher|adviser|educator|school|mentor)\b",
}
BENEFITS = ["cash_award", "stipend", "tuition_waiver", "program_seat", "in_kind_value", "certificate", "college_credit", "mentorship", "other_benefits"]
COSTS = ["application_fee", "tuition", "deposit", "other_mandatory_costs", "estimated_total_mandatory_cost"]
#: Fields, what a passage says, and what it doesn't, for it to be on another subject.
SCOPE_RULES = [
    (["ages"], ["platform"], ["participants"]),
    (["ages"], ["age"], ["participants", "requirement"]),
    (["geographic_restrictions", "citizenship_restrictions"], ["legal"], ["participants"]),
    (["geographic_restrictions"], ["worldwide"], ["open_to"]),
    (["sponsor_requirement"], ["guardian", "platform"], ["participants"]),
    (["location"], ["office"], ["taking_part"]),
    (["location"], ["residence"], ["taking_part"]),
    (BENEFITS, ["others_receive"], ["participants_receive"]),
    (["cash_award"], ["project_funding"], []),
    (["cash_award"], [], ["cash"]),
    (["stipend"], [], ["stipend"]),
    (["program_seat"], ["elsewhere"], []),
    (["program_seat"], ["admitted"], ["awarded"]),
    (COSTS, ["optional"], []),
    (["travel_requirements", "location", "duration", "required_live_hours", "weekly_hours"], ["finalists"], ["everyone", "if_selected"]),
    (["cancellation_policy", "cancellation_rights", "material_terms", "sponsor_requirement"], ["optional_service"], ["requirement"]),
    (["selection_process"], [], ["selection"]),
    (["personal_information", "data_sharing"], ["platform"], ["participants", "program_data", "applicant_data"]),
    (["project_ownership", "project_license"], ["user_content"], ["work"]),
    (["refund_policy"], ["a_service"], ["a_payment"]),
    (["cancellation_rights"], ["stops_services"], ["program"]),
    (["cancellation_rights"], ["health"], ["changes"]),
]
#: Wording of a benefit for others than participants, and the evidence that a kind of cost needs.
FOR_OTHERS = r"\b(?:for|to)\s+(?:the\s+)?(?:winning\s+|winner['’]s\s+)?(?:school|teacher|educator|adviser|advisor)\b|\b(?:school|teacher|educator|adviser|advisor)\s+(?:benefit|prize|award|receives?|is awarded)\b"
COST_KINDS = {
    "application_fee": r"\bapplication\b.{0,50}\b(fee|cost|payment)\b|\b(fee|cost|payment)\b.{0,50}\bapplication\b",
    "tuition": r"\b(tuition|program fees?|program costs?|participation fees?|enrollment fees?)\b",
    "deposit": r"\bdeposit\b",
    "travel": r"\b(travel|transportation|airfare|flight)\b",
    "lodging": r"\b(lodging|housing|accommodation|hotel)\b",
    "meals": r"\b(meals?|food)\b",
    "materials": r"\b(materials?|supplies|equipment)\b",
    "other": r"\b(costs?|fees?|charges?|payments?|expenses?|prices?)\b",
}
#: Acts of admission, and what one can be admitted to.
ADMISSION = r"\b(?:admi(?:t(?:ted|s|ting)?|ssion)|accept(?:ed|ance|s|ing)?|enroll(?:ed|ing|ment|s)?|seats?|places?|placement)\b"
ELSEWHERE = r"\b(?:college|university|school|institution|employer|company)\b"
HERE = r"\b(?:opportunity|program|fellowship|course|cohort|session|academy|camp|challenge|competition)\b"
BEFORE, AFTER = 80, 180


def admits_elsewhere(text: Column) -> Column:
    """FN-34: some admission of the text is to another institution, not to the opportunity.

    Each act is read with the 80 characters before it and the 180 after it. An institution counts if it stands
    behind, or ends at most 40 characters before the act; the opportunity, if it is the first of the two
    behind the act, within 100 characters, or stands right before it.
    """
    low = F.lower(text)
    around = F.lit(rf"(?s)(?={ADMISSION})(?<=(^.{{0,{BEFORE}}}|.{{{BEFORE}}})){ADMISSION}(?=(.{{0,{AFTER}}}))")  # looks back only where an act begins
    sides = F.arrays_zip(F.regexp_extract_all(low, around, 1).alias("before"), F.regexp_extract_all(low, around, 2).alias("after"))

    def elsewhere(side: Column) -> Column:
        before, after = side["before"], side["after"]
        other, own = F.regexp_instr(after, F.lit(ELSEWHERE)), F.regexp_instr(after, F.lit(HERE))
        near = before.rlike(ELSEWHERE) & (F.length(F.element_at(F.split(before, ELSEWHERE), -1)) <= 40)
        direct = ((own > 0) & (own <= 101) & ((other == 0) | (own < other))) | before.rlike(HERE.removesuffix(r"\b") + r"\s*$")
        return ((other > 0) | near) & ~direct

    return F.exists(sides, elsewhere)


def says(text: Column, name: str) -> Column:
    """A pattern of the table in a lower-cased passage, which loses what the pattern must not see."""
    if name == "elsewhere":
        return admits_elsewhere(text)
    return (F.regexp_replace(text, CUTS[name], "") if name in CUTS else text).rlike(PATTERNS[name])


def off_subject(field: Column, passage: Column) -> Column:
    """FLT-17: the passage speaks of another subject than the field; false for fields without a rule. One branch a field, so only its own patterns are looked for."""
    text = F.lower(passage)
    found = F.lit(False)
    for name in dict.fromkeys(f for fields, _, _ in SCOPE_RULES for f in fields):
        own = [reduce(lambda a, b: a & b, [*(says(text, y) for y in yes), *(~says(text, n) for n in no)]) for fields, yes, no in SCOPE_RULES if name in fields]
        found = F.when(field == name, reduce(or_, own)).otherwise(found)
    return found


def scope_failure(field: Column, status: Column, shown: Column, passages: Column) -> Column:
    """FLT-17: true for a disclosed or conflicting fact of which a passage is off its subject, or a benefit shown that is for others than participants."""
    others = (field == "other_benefits") & F.lower(F.coalesce(shown, F.lit(""))).rlike(FOR_OTHERS)
    return status.isin("disclosed", "conflicting") & (others | F.exists(passages, lambda p: off_subject(field, p)))


def record_failure(family: Column, slot: Column, kind: Column, requirement: Column, scoped: Column, passages: Column) -> Column:
    """FLT-18: why a structured claim's passages don't establish it, the first reason that holds; null if they do.

    ``kind``: a cost's kind, an outcome's type or a recipient; ``scoped``: the claim names a stage or pathway.
    """
    text = F.lower(F.array_join(passages, " "))
    said = lambda name: says(text, name)
    cost, outcome = (family == "costItems") & (slot == "definition"), (family == "outcomes") & (slot == "definition")
    stated = F.lit(False)
    for name, pattern in COST_KINDS.items():
        stated = F.when(kind == name, text.rlike(pattern)).otherwise(stated)
    reasons = [
        (cost & ~F.coalesce(stated, F.lit(False)), "the proposed cost kind is not stated by the cited excerpt"),
        (cost & said("optional") & ~requirement.eqNullSafe("optional"), "an optional charge was proposed as a required or conditional participant cost"),
        (cost & said("conditional") & (requirement == "required"), "a conditional charge was proposed as universally required"),
        (cost & (requirement == "optional") & ~said("optional"), "optional cost treatment is not stated by the cited excerpt"),
        (cost & (requirement == "conditional") & ~said("conditional"), "conditional cost treatment is not stated by the cited excerpt"),
        (outcome & kind.isin("personal_cash_prize", "team_cash_prize") & (said("project_funding") | ~said("cash") | said("educators")), "the cited excerpt does not establish unrestricted participant or team cash"),
        (outcome & (kind == "educator_cash_prize") & ~(said("cash") & said("educators")), "the cited excerpt does not establish a cash prize for an educator, teacher, or adviser"),
        (outcome & (kind == "stipend") & ~said("stipend"), "the cited excerpt does not state a stipend"),
        (outcome & (kind == "program_seat") & admits_elsewhere(text), "the cited admission or enrollment targets an external college, university, school, institution, or employer rather than this opportunity"),
        (outcome & (kind == "project_budget") & ~said("project_funding"), "the cited excerpt does not state restricted project, experiment, build, or venture funding"),
        (outcome & (kind == "reimbursement") & ~said("reimbursed"), "the cited excerpt does not state reimbursement"),
        ((slot == "locations") & said("office") & ~said("taking_part_there"), "an organizer or office address was proposed as a participant stage location"),
        ((slot == "locations") & said("residence") & ~said("taking_part"), "eligibility geography was proposed as a participant stage location"),
        (slot.isin("travelRequirements", "locations", "timeCommitments", "durations") & said("finalists") & ~said("everyone") & ~scoped, "a finalist- or winner-only requirement lacked stage or pathway scope"),
        ((family == "outcomes") & (slot == "recipientScope") & said("educators_or_schools") & ~kind.isin("school", "organization", "educator"), "the recipient scope conflicts with the teacher or school recipient named in the excerpt"),
        ((family == "institutionRelationships") & said("platform") & ~said("participants"), "platform-use language cannot establish an opportunity institution relationship"),
        ((slot == "requirements") & said("optional_messages") & ~said("requirement"), "an optional platform or communications service was proposed as an opportunity requirement"),
    ]
    return F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) for cond, reason in reasons))
