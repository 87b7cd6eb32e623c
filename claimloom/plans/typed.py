"""Typed values and the passages they are read from, on the driver's line items: a Spark query and independent SQL for each.

Days, amounts and quantities are the line items' own; wording, zones and faults follow their keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import alignment as A
from claimloom.functions import evidence as E
from claimloom.functions import markers as M
from claimloom.functions import text as T
from claimloom.plans.carriers import VIEWS, query
from claimloom.plans.statements import _MONEY_SQL, _PLACES_SQL, _case, _grades_sql, _named

_MONTHS = T.MONTHS.replace("|", ",")
_DAY = "concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(d AS STRING), 2, '0'))"
_BASE = f"(SELECT l_orderkey AS slug, CAST(l_linenumber AS BIGINT) AS claim_id, CAST(l_partkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p, CAST(month(l_shipdate) AS INT) AS m, CAST(day(l_shipdate) AS INT) AS d, CAST(year(l_shipdate) + 30 AS INT) AS y, split_part('{_MONTHS}', ',', CAST(month(l_shipdate) AS INT)) AS mn FROM lineitem) AS r"
_S = lambda x: f"CAST({x} AS STRING)"
_FULL = f"concat(mn, ' ', {_S('d')}, ', ', {_S('y')})"
_SHORT = f"concat(mn, ' ', {_S('d')})"
_HALF = f"concat({_S('CASE WHEN q % 12 = 0 THEN 12 ELSE q % 12 END')}, CASE WHEN p % 3 = 0 THEN '' ELSE concat(':', lpad({_S('p % 60')}, 2, '0')) END, CASE WHEN q % 24 >= 12 THEN ' PM' ELSE ' AM' END)"


def _choose(key: str, texts: list[str]) -> str:
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


def _line(*parts: str) -> str:
    return "concat(" + ", ".join(p if p.startswith(("concat", "CAST", "mn", "lpad", "CASE")) else f"'{p}'" for p in parts) + ")"


_KINDS = ["exact", "range", "date", "month", "date_time", "quantity", "enum", "path"]
_MONEY_TEXTS = [_line("The fee is $", _S("p"), "."), _line("The fee is EUR ", _S("p"), " in all"), _line(_S("p"), ".50 USD"), _line("Free of charge"), _line("£ ", _S("p"), " or $", _S("p + 500"), " a week"), _line("From ", _S("p"), " to ", _S("p + 500"), " dollars, paid in USD"), _line("Costs $", _S("p"), " - $", _S("p + 500"))]
_DAY_TEXTS = [_line("The deadline is ", _FULL, "."), _line("It starts on ", _SHORT), _line("Held ", _SHORT, " to ", _S("d + 1"), " on campus"), _line("Applications must be submitted by ", _SHORT), _line("It is expected to close on ", _FULL), _line("Results are announced in ", "mn", " ", _S("y")), _line("Open ", "mn", " 1 – ", _SHORT), _line("Last year it ended on ", _SHORT), _line("Entry and enrollment: ", _SHORT, " through ", "mn", " 28"), _line("Forms are due ", _DAY)]
_TIME_TEXTS = [_line(_FULL, " at ", _HALF, " EST"), _line(_FULL, ", ", f"lpad({_S('q % 24')}, 2, '0')", ":", f"lpad({_S('p % 60')}, 2, '0')", " UTC"), _line("Due ", _SHORT, ", ", _HALF, " GMT"), _line(_DAY, " ", _HALF, " +05:30"), _line(_FULL, " ", _HALF)]
_AMOUNT_TEXTS = [_line(_S("q"), " weeks of work"), _line("Between ", _S("q"), " and ", _S("q + 2"), " hours a week"), _line("Up to ", _S("q"), ".5 days"), _line("Teams of ", _S("q"), ", ", _S("p"), " in all"), _line("1", _S("q"), " week")]
_ENUM_TEXTS = [_line(t) for t in ("Applications are now open", "Online and in person", "A hybrid day program", "Paid as a stipend to each student", "Teams of teachers", "The cohort is underway")]
_PATH_TEXTS = [_line(t) for t in ("Apply, then an interview", "Semifinalists pitch and winners are announced", "Early decision", "A review of requirements", "Ranked finalists move forward")]
_TEXT = lambda shift: f"CASE a % 8 WHEN 0 THEN {_choose(f'(b + {shift})', _MONEY_TEXTS)} WHEN 1 THEN {_choose(f'(b + {shift})', _MONEY_TEXTS)} WHEN 2 THEN {_choose(f'(b + {shift})', _DAY_TEXTS)} WHEN 3 THEN {_choose(f'(b + {shift})', _DAY_TEXTS)} WHEN 4 THEN {_choose(f'(b + {shift})', _TIME_TEXTS)} WHEN 5 THEN {_choose(f'(b + {shift})', _AMOUNT_TEXTS)} WHEN 6 THEN {_choose(f'(b + {shift})', _ENUM_TEXTS)} ELSE {_choose(f'(b + {shift})', _PATH_TEXTS)} END"
_OF = lambda k, x: f"CASE WHEN a % 8 IN ({k}) THEN {x} END"

VIEWS |= {
    "typed_values": f"SELECT slug, claim_id, {_OF('0, 1', 'CASE a % 8 WHEN 0 THEN ' + repr('exact') + ' ELSE ' + repr('range') + ' END')} AS kind, {_OF('0', 'CAST(CASE WHEN b % 7 = 3 THEN 0 WHEN b % 7 = 2 THEN p + 0.5 ELSE p END AS DOUBLE)')} AS amount, {_OF('1', 'CAST(p AS DOUBLE)')} AS minimum, {_OF('1', 'CAST(p + 500 AS DOUBLE)')} AS maximum, {_OF('0, 1', _case('b', ['USD', 'EUR', 'USD', 'USD', 'GBP', 'USD', 'USD']))} AS currency, "
    f"{_OF('2, 3, 4', 'CASE a % 8 WHEN 2 THEN ' + repr('date') + ' WHEN 3 THEN ' + repr('month') + ' ELSE ' + repr('date_time') + ' END')} AS precision, {_OF('2', _DAY)} AS day, {_OF('3', 'y')} AS year, {_OF('3', 'm')} AS month, {_OF('4', 'concat(' + _DAY + ', ' + repr('T') + ', lpad(' + _S('q % 24') + ', 2, ' + repr('0') + '), ' + repr(':') + ', CASE WHEN p % 3 = 0 THEN ' + repr('00') + ' ELSE lpad(' + _S('p % 60') + ', 2, ' + repr('0') + ') END, ' + repr(':00') + ', ' + _case('p', ['Z', '-05:00', '+05:30', 'Z', '-05:00']) + ')')} AS date_time, "
    f"{_OF('2, 3', 'CASE WHEN q % 5 = 0 THEN ' + repr('expected') + ' ELSE ' + repr('stated') + ' END')} AS certainty, {_OF('2, 3', 'CASE WHEN p % 8 < 6 THEN ' + _case('p', [*A.EVENTS]) + ' WHEN p % 8 = 6 THEN ' + repr('other') + ' END')} AS event, "
    f"{_OF('5', 'CASE WHEN b % 5 = 3 THEN CAST(q AS DOUBLE) END')} AS n, {_OF('5', 'CASE WHEN b % 5 = 1 THEN CAST(q AS DOUBLE) END')} AS minimum_hours, {_OF('5', 'CASE WHEN b % 5 = 1 AND p % 2 = 0 THEN CAST(q + 2 AS DOUBLE) END')} AS maximum_hours, {_OF('5', 'CASE WHEN b % 5 IN (0, 2, 4) THEN CAST(CASE WHEN b % 5 = 2 THEN q + 0.5 ELSE q END AS DOUBLE) END')} AS low, {_OF('5', 'CASE WHEN b % 5 = 0 THEN ' + repr('weeks') + ' WHEN b % 5 = 2 THEN ' + repr('days') + ' WHEN b % 5 = 4 THEN ' + repr('week') + ' END')} AS unit, "
    f"{_OF('6', _case('b', ['applications_open', 'online', 'hybrid', 'cash', 'team', 'active']))} AS enum, {_OF('7', 'CASE WHEN q % 4 = 0 THEN ' + repr('If you submit') + ' END')} AS enter_when, CASE WHEN a % 8 = 6 THEN {_case('b', ['status', 'formats', 'formats', 'monetaryNature', 'recipientScope', 'status'])} WHEN a % 8 = 7 AND q % 3 = 0 THEN 'advancement' WHEN a % 8 = 7 THEN 'steps' ELSE 'amount' END AS path_key, "
    f"{_TEXT('CASE WHEN q % 11 = 0 THEN 1 ELSE 0 END')} AS evidence, {_TEXT('CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END')} AS display, CASE WHEN p % 4 > 0 THEN y - CASE WHEN p % 4 = 3 THEN 1 ELSE 0 END END AS first_year, CASE WHEN p % 4 > 1 THEN y + CASE WHEN p % 4 = 3 THEN 0 ELSE 1 END END AS second_year, CASE WHEN q % 13 = 0 THEN concat({_S('y')}, '-27') ELSE 'Cycle' END AS label, slug + CASE WHEN q % 9 = 0 THEN 1 ELSE 0 END AS source_id FROM {_BASE}",
}


def _claims(t):
    """The carrier's columns as claims: one struct a value."""
    names = {"date": "day", "count": "n"}
    known = set(t.columns)
    field = {f.split()[0]: f.split()[1] for f in A.VALUE.split(", ")}
    parts = [F.array_compact(F.array("enum")).alias("enums") if f == "enums" else (F.col(names.get(f, f)) if names.get(f, f) in known else F.lit(None)).cast(kind).alias(f) for f, kind in field.items()]
    cycle = F.when(F.col("first_year").isNotNull(), F.struct(F.array_compact(F.array("first_year", "second_year")).alias("years"), F.col("slug").alias("source_id"), "label"))
    return t.select("slug", "claim_id", "path_key", "display", F.struct(*parts).alias("value"), F.array("evidence").alias("excerpts"), F.array("source_id").alias("source_ids"), cycle.alias("cycle"))


_PLAIN = "trim(regexp_replace(translate({}, '‘’“”–—', concat(chr(39), chr(39), '\"\"--')), '\\s+', ' ', 'g'))"
_ESCAPED = "replace(regexp_replace(CAST({} AS VARCHAR), '\\.0$', ''), '.', '\\.')"


def _number(n: str, x: str) -> str:
    return f"regexp_matches(replace({x}, ',', ''), concat('(?:^|[^0-9.])', {_ESCAPED.format(n)}, '(?:[^0-9.]|$)'))"


def _money(text: str, x: str) -> str:
    listed = _MONEY_SQL.replace("(text,", f"({x},")
    states = lambda amount: f"len(list_filter({listed}, lambda m: m.a = {amount} AND m.k = currency)) > 0"
    symbol = "CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' END"
    loose = f"(regexp_matches(upper({x}), concat('\\b', currency, '\\b')) OR contains({x}, {symbol})) AND {_number('minimum', x)} AND {_number('maximum', x)}"
    return f"coalesce(CASE WHEN kind = 'exact' THEN (amount = 0 AND regexp_matches({text}, '{E.FREE}')) OR {states('amount')} ELSE ({states('minimum')} AND {states('maximum')}) OR ({loose}) END, false)"


_NO = f"list_position(string_split(lower('{_MONTHS}'), ','), lower({{}}))"
_CROSS, _SAME = (r.replace("()", "") for r in A.RANGES)


def _ranges(x: str) -> str:
    pick = lambda rule, g: f"regexp_extract(z, '{rule}', {g})"
    cross = f"list_transform(regexp_extract_all({x}, '{_CROSS}'), lambda z: [{_NO.format(pick(_CROSS, 1))}, {pick(_CROSS, 2)}::INT, {_NO.format(pick(_CROSS, 3))}, {pick(_CROSS, 4)}::INT])"
    same = f"list_transform(regexp_extract_all({x}, '{_SAME}'), lambda z: [{_NO.format(pick(_SAME, 1))}, {pick(_SAME, 2)}::INT, {_NO.format(pick(_SAME, 1))}, {pick(_SAME, 3)}::INT])"
    return f"list_concat({cross}, {same})"


_days = lambda x: f"list_transform(regexp_extract_all({x}, '{E.DATES}'), lambda z: strftime(coalesce(try_strptime(z, '%Y-%m-%d'), try_strptime(z, '%B %d, %Y')), '%Y-%m-%d'))"
_NAME = f"split_part('{_MONTHS}', ',', {{}}::INT)"


def _month_day(day: str, x: str) -> str:
    month, number = f"substr({day}, 6, 2)::INT", f"substr({day}, 9, 2)::INT"
    return f"(regexp_matches({x}, concat('(?i)\\b', {_NAME.format(month)}, '\\s+', {number}, '\\b')) OR len(list_filter({_ranges(x)}, lambda r: r[3] = {month} AND r[4] = {number})) > 0)"


def _time(x: str) -> str:
    hour, minute = "substr(date_time, 12, 2)", "substr(date_time, 15, 2)"
    twelve, half = f"CASE WHEN {hour}::INT % 12 = 0 THEN 12 ELSE {hour}::INT % 12 END", f"CASE WHEN {hour}::INT >= 12 THEN 'PM' ELSE 'AM' END"
    return f"(regexp_matches({x}, concat('\\b', {hour}, ':', {minute}, '(:00)?\\b')) OR regexp_matches({x}, concat('(?i)\\b', {twelve}, ':', {minute}, '(:00)?\\s*', {half}, '\\b')) OR ({minute} = '00' AND regexp_matches({x}, concat('(?i)\\b', {twelve}, '\\s*', {half}, '\\b'))))"


def _offset(x: str) -> str:
    named = f"regexp_extract_all(upper({x}), '{A.ZONE}')"
    own = "CASE WHEN right(date_time, 1) = 'Z' THEN 0 ELSE (substr(right(date_time, 6), 1, 1) || '1')::INT * (substr(right(date_time, 6), 2, 2)::INT * 60 + right(date_time, 2)::INT) END"
    of_zone = "CASE z " + " ".join(f"WHEN '{z}' THEN {m}" for z, m in A.ZONES.items()) + " END"
    sums = rf"list_transform(regexp_extract_all({x}, '[+-]\d{{1,2}}:?\d{{2}}\b'), lambda z: (left(z, 1) || '1')::INT * (regexp_extract(z, '^.(\d{{1,2}}?):?\d{{2}}$', 1)::INT * 60 + right(z, 2)::INT))"
    return f"CASE WHEN len({named}) > 0 THEN list_contains(list_transform({named}, lambda z: {of_zone}), {own}) ELSE list_contains({sums}, {own}) END"


def _temporal(x: str, year: str) -> str:
    states = lambda day: f"(list_contains({_days(x)}, {day}) OR coalesce(left({day}, 4) = CAST({year} AS VARCHAR) AND {_month_day(day, x)}, false))"
    month = f"len(list_filter({_days(x)}, lambda z: starts_with(z, concat(lpad(year::VARCHAR, 4, '0'), '-', lpad(month::VARCHAR, 2, '0'))))) > 0 OR regexp_matches({x}, concat('(?i)\\b', {_NAME.format('month')}, '\\s+', year, '\\b'))"
    return f"coalesce(CASE precision WHEN 'date' THEN {states('day')} WHEN 'month' THEN {month} ELSE {states('left(date_time, 10)')} AND {_time(x)} AND {_offset(x)} END, false)"


_IMPLICIT = f"CASE WHEN first_year IS NULL OR regexp_matches(evidence, '\\b20\\d{{2}}\\b') OR regexp_matches(evidence, '{A.EARLIER}') THEN NULL WHEN second_year IS NULL THEN CASE WHEN source_id = slug THEN first_year END WHEN second_year <> first_year + 1 OR regexp_matches(label, '{A.TWO_YEARS}') THEN NULL WHEN proposed = first_year AND regexp_matches(evidence, '{A.FIRST_YEAR}') THEN first_year WHEN proposed = second_year AND regexp_matches(evidence, '{A.SECOND_YEAR}') THEN second_year END"
_READ = f"s AS (SELECT *, {_PLAIN.format('evidence')} AS x, {_PLAIN.format('display')} AS yx, coalesce(left(coalesce(day, date_time), 4)::INT, year) AS proposed FROM typed_values), t AS (SELECT *, {_IMPLICIT} AS implied FROM s)"


@query("fn_22_money_ranges", "typed_values", sql=f"+ {_READ} SELECT slug, claim_id, {_money('evidence', 'x')} AS in_evidence, {_money('display', 'yx')} AS in_display FROM t WHERE kind IS NOT NULL")
def _(t):
    c = _claims(t.filter("kind IS NOT NULL")).withColumns({"e": F.col("excerpts")[0], "x": T.normalize_whitespace(F.col("excerpts")[0]), "y": T.normalize_whitespace(F.col("display"))})
    v = F.col("value")
    return c.select("slug", "claim_id", A.money_value_appears(v, F.col("e"), F.col("x")).alias("in_evidence"), A.money_value_appears(v, F.col("display"), F.col("y")).alias("in_display"))


@query("fn_23_day_ranges", "typed_values", sql=f"+ {_READ} SELECT slug, claim_id, array_to_string(list_transform({_ranges('x')}, lambda r: concat(r[1], '/', r[2], '-', r[3], '/', r[4])), ',') AS ranges, coalesce({_month_day('day', 'x')}, false) AS month_day FROM t WHERE day IS NOT NULL")
def _(t):
    x = T.normalize_whitespace(F.col("evidence"))
    shown = F.transform(A.day_ranges(x), lambda r: F.concat(r["start_month"].cast("string"), F.lit("/"), r["start_day"].cast("string"), F.lit("-"), r["end_month"].cast("string"), F.lit("/"), r["end_day"].cast("string")))
    return t.filter("day IS NOT NULL").select("slug", "claim_id", F.array_join(shown, ",").alias("ranges"), A.month_day_appears(F.col("day"), x).alias("month_day"))


@query("fn_24_times", "typed_values", sql=f"+ {_READ} SELECT slug, claim_id, {_time('x')} AS time, {_offset('x')} AS zone FROM t WHERE date_time IS NOT NULL")
def _(t):
    x, at = T.normalize_whitespace(F.col("evidence")), A.parse_date_time(F.col("date_time"))
    return t.filter("date_time IS NOT NULL").select("slug", "claim_id", A.time_appears(at, x).alias("time"), A.offset_appears(at["offset"], x).alias("zone"))


@query("fn_25_temporal_values", "typed_values", sql=f"+ {_READ} SELECT slug, claim_id, implied, {_temporal('x', 'implied')} AS in_evidence, {_temporal('yx', 'NULL')} AS in_display FROM t WHERE precision IS NOT NULL")
def _(t):
    c = _claims(t.filter("precision IS NOT NULL")).withColumns({"x": T.normalize_whitespace(F.col("excerpts")[0]), "y": T.normalize_whitespace(F.col("display"))})
    v = F.col("value")
    c = c.withColumn("implied", A.implicit_year(F.col("cycle"), F.col("source_ids"), F.col("excerpts")[0], v))
    return c.select("slug", "claim_id", "implied", A.temporal_appears(v, F.col("x"), F.col("implied")).alias("in_evidence"), A.temporal_appears(v, F.col("y"), F.lit(None).cast("int")).alias("in_display"))


def _quantity(x: str) -> str:
    unit = f"regexp_matches({x}, concat('(?i)\\b', regexp_replace(unit, 's$', ''), 's?\\b'))"
    checks = [f"CASE WHEN {n} IS NOT NULL THEN {_number(n, x)} END" for n in ("n", "minimum_hours", "maximum_hours", "low")] + [f"CASE WHEN minimum_hours IS NOT NULL THEN regexp_matches({x}, '{A.HOURS}') END", f"CASE WHEN unit IS NOT NULL THEN {unit} END"]
    return f"list_bool_and([{', '.join(checks)}])"


@query("fn_26_quantities", "typed_values", sql=f"+ {_READ} SELECT slug, claim_id, {_quantity('x')} AS in_evidence, {_quantity('yx')} AS in_display FROM t")
def _(t):
    c, v = _claims(t), F.col("value")
    return c.select("slug", "claim_id", A.quantity_appears(v, T.normalize_whitespace(F.col("excerpts")[0])).alias("in_evidence"), A.quantity_appears(v, T.normalize_whitespace(F.col("display"))).alias("in_display"))


def _enum(text: str) -> str:
    rules = " ".join(f"WHEN '{g}:{value}' THEN regexp_matches({text}, '(?i){p}')" for g, of in E.ENUMS.items() for value, p in of.items())
    return f"CASE concat(path_key, ':', enum) {rules} END"


_marks = lambda text: _named(f"regexp_replace({text}, '(?i){M.NO_STEP}', '', 'g')", M.PROCESS)
_EVENT = "CASE event " + " ".join(f"WHEN '{event}' THEN regexp_matches(evidence, '{rule}')" for event, rule in A.EVENTS.items()) + " ELSE true END"
_AT = lambda a, b: f"len(list_filter({_ranges('x')}, lambda r: r[{a}] = substr(day, 6, 2)::INT AND r[{b}] = substr(day, 9, 2)::INT)) > 0"
_SUPPORTED = f"({_EVENT} OR coalesce(CASE event WHEN 'starts' THEN {_AT(1, 2)} WHEN 'ends' THEN {_AT(3, 4)} WHEN 'deadline' THEN {_month_day('day', 'x')} AND regexp_matches(evidence, '{A.DUE_BY}') END, false))"
_WHY = {k: f"'{v}'" for k, v in A.FAILURES.items()}
_CHAIN = f"""CASE WHEN kind IS NOT NULL THEN CASE WHEN NOT ({_money('evidence', 'x')} AND {_money('display', 'yx')}) THEN {_WHY['money']} END
WHEN precision IS NOT NULL THEN CASE WHEN NOT ({_temporal('x', 'implied')} AND {_temporal('yx', 'NULL')}) THEN {_WHY['date']} WHEN certainty = 'expected' AND NOT regexp_matches(evidence, '{A.EXPECTED}') THEN {_WHY['expected']} WHEN event IS NOT NULL AND NOT {_SUPPORTED} THEN {_WHY['event']} END
WHEN NOT {_quantity('x')} THEN {_WHY['number']} WHEN NOT {_quantity('yx')} THEN {_WHY['number_display']} WHEN NOT {_enum('evidence')} THEN {_WHY['enum']} WHEN NOT {_enum('display')} THEN {_WHY['enum_display']}
WHEN path_key = 'advancement' AND NOT list_has_any({_marks('evidence')}, {A.ADVANCING}) THEN {_WHY['advancement']} WHEN path_key = 'steps' AND NOT list_has_all({_marks('evidence')}, {_marks("concat(display, ' ', coalesce(enter_when, ''))")}) THEN {_WHY['step']} END"""


@query("fn_29_typed_failures", "typed_values", sql=f"+ {_READ} SELECT slug, claim_id, {_CHAIN} AS failure FROM t")
def _(t):
    return A.typed_failures(_claims(t)).select("slug", "claim_id", "failure")


_FIELDS = ["ages", "grade_levels", "geographic_restrictions", "citizenship_restrictions", "entry_format", "sponsor_requirement"]
_WORDS = [_line(t) for t in ("Ages 14 to 18", "Open to grades 9 through 12", "Juniors of any high school", "Citizens of Canada and Mexico", "Students worldwide", "No geographic restrictions", "Teams of 3 or alone", "A group entry", "A parent must sign", "A teacher is required, two at most", "A school counselor may optionally help", "Ages 13 to 18 in Norway", "Permanent residents with visas", "")]
_FLAT_KINDS = ["money", "date", "number", "percentage", "duration", "hours", "boolean", "participation_format", "text", "text_list", "text", "raw"]
_FLAGS = [_line(t) for t in ("Travel is included", "Meals are not covered", "You earn a certificate", "There is no certificate", "Housing at your expense", "Food is provided")]
_FLAT = lambda shift: f"CASE kind WHEN 'money' THEN {_choose(f'(b + {shift})', _MONEY_TEXTS)} WHEN 'date' THEN {_choose(f'(b + {shift})', _DAY_TEXTS)} WHEN 'number' THEN {_choose(f'(b + {shift})', _AMOUNT_TEXTS)} WHEN 'percentage' THEN {_choose(f'(b + {shift})', [_line(_S('q'), '% of them'), _line(_S('q'), ' percent'), _line(_S('q'), ' of a hundred')])} WHEN 'duration' THEN {_choose(f'(b + {shift})', _AMOUNT_TEXTS)} WHEN 'hours' THEN {_choose(f'(b + {shift})', _AMOUNT_TEXTS)} WHEN 'boolean' THEN {_choose(f'(b + {shift})', _FLAGS)} WHEN 'participation_format' THEN {_choose(f'(b + {shift})', _ENUM_TEXTS)} WHEN 'raw' THEN {_choose(f'(b + {shift})', _MONEY_TEXTS)} ELSE {_choose(f'(b + {shift})', _WORDS)} END"

VIEWS |= {
    "flat_facts": f"SELECT slug, claim_id, kind, CASE WHEN kind IN ('text', 'text_list') THEN {_case('p', _FIELDS)} WHEN kind = 'boolean' THEN {_case('p', [*A.FLAG_SUBJECTS])} WHEN kind = 'hours' AND p % 2 = 0 THEN 'weekly_hours' ELSE 'other' END AS field_id, CAST(CASE WHEN b % 7 = 3 THEN 0 WHEN kind = 'duration' THEN q ELSE p END AS DOUBLE) AS amount, {_case('b', ['USD', 'EUR', 'USD', 'USD', 'GBP', 'USD', 'USD'])} AS currency, {_DAY} AS day, CAST(q AS DOUBLE) AS n, 'weeks' AS unit, CAST(q AS DOUBLE) AS minimum_hours, CASE WHEN p % 3 = 0 THEN CAST(q + 2 AS DOUBLE) END AS maximum_hours, p % 2 = 0 AS flag, CASE WHEN kind = 'participation_format' THEN {_case('p', [*E.ENUMS['formats']])} WHEN p % 5 = 0 THEN '' ELSE {_choose('b', _WORDS)} END AS words, {_FLAT('CASE WHEN q % 5 = 0 THEN 1 ELSE 0 END')} AS evidence, {_FLAT('CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END')} AS display, CASE WHEN p % 4 > 0 THEN y END AS first_year, CAST(NULL AS INT) AS second_year, 'Cycle' AS label, slug + CASE WHEN q % 9 = 0 THEN 1 ELSE 0 END AS source_id FROM (SELECT *, {_case('a', _FLAT_KINDS)} AS kind FROM {_BASE}) AS k",
}


def _small(text: str) -> str:
    return f"list_distinct([z::INT for z in regexp_extract_all(replace({text}, ',', ''), '[0-9]+') if len(z) <= 2 and z::INT <= 25])"


def _age(text: str) -> str:
    of = lambda p: f"CASE WHEN try_cast(regexp_extract(lower({text}), '{p}', 1) AS INT) <= try_cast(regexp_extract(lower({text}), '{p}', 2) AS INT) AND try_cast(regexp_extract(lower({text}), '{p}', 2) AS INT) <= 25 THEN regexp_extract(lower({text}), '{p}', 1) || '-' || regexp_extract(lower({text}), '{p}', 2) END"
    return f"coalesce({', '.join(map(of, M.AGES))})"


def _text_sql() -> str:
    says = lambda rule: f"regexp_matches(o, '{rule}') AND NOT regexp_matches(evidence, '{rule}')"
    why = {k: f"'{v}'" for k, v in A.FLAT_FAILURES.items()}
    places = lambda c: _PLACES_SQL.replace("(text,", f"({c},")
    citizens = lambda c: f"list_concat({places(c)}, {_named(c, E.CITIZENSHIP)})"
    more = lambda of: f"NOT list_has_all({of('evidence')}, {of('o')})"
    sponsors = " ".join(f"WHEN {says(rule)} THEN 'its {who} requirement is not stated by the cited excerpt'" for who, rule in A.SPONSORS.items())
    return f"""CASE field_id WHEN 'ages' THEN CASE WHEN {more(_small)} THEN {why['ages']} WHEN {_age('o')} <> {_age('evidence')} THEN {why['age_range']} END
WHEN 'grade_levels' THEN CASE WHEN {more(_grades_sql)} THEN {why['grades']} END
WHEN 'geographic_restrictions' THEN CASE WHEN {more(places)} THEN {why['places']} WHEN regexp_matches(o, '{A.ANYWHERE}') AND NOT regexp_matches(evidence, '{A.ANYWHERE_STATED}') THEN {why['anywhere']} END
WHEN 'citizenship_restrictions' THEN CASE WHEN {more(citizens)} THEN {why['citizens']} END
WHEN 'entry_format' THEN CASE WHEN {says(A.ALONE)} THEN {why['alone']} WHEN {says(A.TOGETHER)} THEN {why['together']} WHEN regexp_matches(o, '{A.TOGETHER}') AND {more(_small)} THEN {why['team_size']} END
WHEN 'sponsor_requirement' THEN CASE WHEN regexp_matches(o, '{A.REQUIRED}') AND (NOT regexp_matches(evidence, '{A.REQUIRED}') OR regexp_matches(evidence, '{A.OPTIONAL}')) THEN {why['required']} {sponsors} WHEN {more(_small)} THEN {why['sponsors']} END END"""


def _quote(rule: str) -> str:
    return rule.replace("'", "''")


_FLAG_SQL = "(CASE field_id " + " ".join(f"WHEN '{f}' THEN regexp_matches(evidence, '{rule}')" for f, rule in A.FLAG_SUBJECTS.items()) + f" ELSE true END AND CASE WHEN field_id = 'certificate' THEN CASE WHEN flag THEN regexp_matches(evidence, '{A.CERTIFICATE_YES}') ELSE regexp_matches(evidence, '{_quote(A.CERTIFICATE_NO)}') END WHEN flag THEN regexp_matches(evidence, '{A.YES}') ELSE regexp_matches(evidence, '{_quote(A.NO)}') END)"
_BOTH = lambda of: f"({of('x')} AND {of('yx')})"
_SPAN = lambda x: f"({_number('amount', x)} AND regexp_matches({x}, '(?i)\\bweeks?\\b'))"
_HOURS_SQL = lambda x: f"({_number('minimum_hours', x)} AND regexp_matches({x}, '{A.HOURS}') AND coalesce({_number('maximum_hours', x)}, true))"
_FORMAT = lambda text: "CASE words " + " ".join(f"WHEN '{v}' THEN regexp_matches({text}, '(?i){p}')" for v, p in E.ENUMS["formats"].items()) + " END"
_RAW = r"regexp_extract_all(replace(rx, ',', ''), '(?:^|[^\d.])(\d+(?:\.\d{1,2})?)(?:$|[^\d.])', 1)"
_FLAT_SQL = f"""CASE kind WHEN 'money' THEN CASE WHEN NOT ({_money('evidence', 'x')} AND {_money('display', 'yx')}) THEN '{A.FLAT_FAILURES['money']}' END
WHEN 'date' THEN CASE WHEN NOT ({_temporal('x', 'implied')} AND {_temporal('yx', 'NULL')}) THEN '{A.FLAT_FAILURES['date']}' END
WHEN 'number' THEN CASE WHEN NOT {_BOTH(lambda x: _number('n', x))} THEN '{A.FLAT_FAILURES['number']}' END
WHEN 'percentage' THEN CASE WHEN NOT ({_BOTH(lambda x: _number('n', x))} AND regexp_matches(evidence, '{A.PERCENT}')) THEN '{A.FLAT_FAILURES['percentage']}' END
WHEN 'duration' THEN CASE WHEN NOT {_BOTH(_SPAN)} THEN '{A.FLAT_FAILURES['duration']}' END
WHEN 'hours' THEN CASE WHEN NOT ({_BOTH(_HOURS_SQL)} AND (field_id <> 'weekly_hours' OR regexp_matches(evidence, '{A.WEEKLY}'))) THEN '{A.FLAT_FAILURES['hours']}' END
WHEN 'boolean' THEN CASE WHEN NOT {_FLAG_SQL} THEN '{A.FLAT_FAILURES['boolean']}' END
WHEN 'participation_format' THEN CASE WHEN NOT ({_FORMAT('evidence')} AND {_FORMAT('display')}) THEN '{A.FLAT_FAILURES['participation_format']}' END
WHEN 'raw' THEN CASE WHEN len({_RAW}) > 0 THEN CASE WHEN len(list_filter({_RAW}, lambda z: NOT ({_number('z::DOUBLE', 'x')} AND {_number('z::DOUBLE', 'yx')}))) > 0 THEN '{A.FLAT_FAILURES['raw_money']}' END WHEN (regexp_matches(words, '{E.FREE}') OR regexp_matches(display, '{E.FREE}')) AND NOT regexp_matches(evidence, '{E.FREE}') THEN '{A.FLAT_FAILURES['raw_free']}' END
ELSE {_text_sql()} END"""


@query("fn_31_flat_failures", "flat_facts", sql=f"+ s AS (SELECT * REPLACE (CASE WHEN kind = 'money' THEN 'exact' ELSE kind END AS kind), kind AS k, {_PLAIN.format('evidence')} AS x, {_PLAIN.format('display')} AS yx, {_PLAIN.format('words')} AS rx, concat(words, ' ', display) AS o, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum, 'date' AS precision, NULL::INT AS year, NULL::INT AS month, NULL::VARCHAR AS date_time, left(day, 4)::INT AS proposed FROM flat_facts), t AS (SELECT *, {_IMPLICIT} AS implied FROM s) SELECT slug, claim_id, {_FLAT_SQL.replace('CASE kind WHEN', 'CASE k WHEN', 1)} AS failure FROM t")
def _(t):
    names = {"number": "n", "minimum": "minimum_hours", "maximum": "maximum_hours", "text": "words"}
    field = {f.split()[0]: f.split()[1] for f in A.NORMALIZED.split(", ")}
    value = F.struct(*((F.lit(None) if f == "texts" else F.col(names.get(f, f))).cast(kind).alias(f) for f, kind in field.items()))
    value = value.withField("texts", F.when(F.col("kind") == "text_list", F.array("words"))).withField("text", F.when(F.col("kind") != "text_list", F.col("words")))
    cycle = F.when(F.col("first_year").isNotNull(), F.struct(F.array("first_year").alias("years"), F.col("slug").alias("source_id"), "label"))
    facts = t.select("slug", "claim_id", "field_id", F.when(F.col("kind") != "raw", value).alias("normalized"), F.when(F.col("kind") == "raw", F.col("words")).alias("raw"), (F.col("kind") == "raw").alias("money_field"), "display", F.array("evidence").alias("excerpts"), F.array("source_id").alias("source_ids"), cycle.alias("cycle"))
    return A.flat_failures(facts).select("slug", "claim_id", "failure")


_PROPOSED = [_line(_S("q"), " weeks"), _line(_S("q"), " - ", _S("q + 3"), " hrs per week"), _line("$", _S("p"), " USD"), _line("EUR ", _S("p")), _line("€", _S("p"), " USD"), _line(_S("p")), _line(_S("q"), "%"), _line("Hosted at  institution"), _line("In-Person"), _line(" Yes "), _DAY, _FULL, _line("USD ", _S("p"), " USD"), _line(_S("p"), ".25 GBP"), _line("no")]
VIEWS |= {"proposed_values": f"SELECT slug, claim_id, {_case('a', ['text', 'date', 'money', 'number', 'boolean', 'percentage', 'duration', 'hours', 'relationship', 'participation_format', 'money', 'money', 'money'])} AS value_type, {_choose('b', _PROPOSED)} AS text, CASE WHEN q % 3 = 0 THEN {_choose('(b + p)', _PROPOSED)} END AS display, CAST(CASE WHEN q % 6 = 0 THEN 0 ELSE p END AS DOUBLE) AS amount, CASE WHEN q % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN q % 4 = 0 THEN 'in usd' WHEN q % 6 = 1 THEN 'free of charge' ELSE 'a eur fee' END AS excerpt FROM {_BASE}"}


def _normalized_sql(x: str) -> str:
    """``kind:value`` by DuckDB."""
    part = lambda g: f"regexp_extract({x}, '{A.CODED_AMOUNT}', {g})"
    code = f"concat({part(1)}, {part(4)})"
    hours = r"(?i)^(\d+(?:\.\d+)?)\s*(?:-|to)?\s*(\d+(?:\.\d+)?)?\s*(?:hours?|hrs?)(?:\s*per\s*week|/week)?$"
    token = f"regexp_replace(lower({x}), '[\\s-]+', '_', 'g')"
    return f"""CASE WHEN value_type = 'text' THEN 'text:' || {x} WHEN value_type = 'date' THEN 'date:' || strftime(coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%B %d, %Y')), '%Y-%m-%d')
WHEN value_type = 'money' AND regexp_matches({x}, '{A.CODED_AMOUNT}') AND length({code}) = 3 AND NOT ({part(2)} = '€' AND {code} <> 'EUR') AND NOT ({part(2)} = '£' AND {code} <> 'GBP') AND NOT ({part(2)} = '$' AND {code} NOT IN ('USD', 'CAD', 'AUD')) THEN 'money:' || (replace({part(3)}, ',', '')::DECIMAL(18, 2))::VARCHAR || {code}
WHEN value_type = 'number' AND regexp_matches({x}, '^[0-9,]+$') THEN 'number:' || (replace({x}, ',', '')::DECIMAL(18, 2))::VARCHAR WHEN value_type = 'boolean' AND lower({x}) IN ('yes', 'true', 'no', 'false') THEN 'boolean:' || (lower({x}) IN ('yes', 'true'))::VARCHAR
WHEN value_type = 'percentage' AND try_cast(regexp_replace({x}, '%$', '') AS DOUBLE) BETWEEN 0 AND 100 THEN 'percentage:' || (regexp_replace({x}, '%$', '')::DECIMAL(18, 2))::VARCHAR
WHEN value_type = 'duration' AND regexp_matches({x}, '(?i)^\\d+(\\.\\d+)?\\s*(hour|day|week|month)s?$') THEN 'duration:' || (regexp_extract({x}, '^[0-9.]+')::DECIMAL(18, 2))::VARCHAR || regexp_extract(lower({x}), '[a-z]+')
WHEN value_type = 'hours' AND regexp_matches({x}, '{hours}') THEN 'hours:' || (regexp_extract({x}, '{hours}', 1)::DECIMAL(18, 2))::VARCHAR || (nullif(regexp_extract({x}, '{hours}', 2), '')::DECIMAL(18, 2))::VARCHAR
WHEN value_type = 'relationship' AND {token} IN ({', '.join(f"'{r}'" for r in A.RELATIONSHIPS)}) THEN 'relationship:' || {token} WHEN value_type = 'participation_format' AND {token} IN ({', '.join(f"'{r}'" for r in A.FORMATS)}) THEN 'participation_format:' || {token} END"""


@query("fn_32_normalized_values", "proposed_values", sql=f"""+ s AS (SELECT *, {_PLAIN.format('text')} AS x, {_PLAIN.format('display')} AS yx, concat(text, ' ', coalesce(display, ''), ' ', excerpt) AS said FROM proposed_values)
SELECT slug, claim_id, coalesce({_normalized_sql('x')}, {_normalized_sql('yx')}, CASE WHEN value_type = 'money' AND {_number('amount', 'x')} AND (regexp_matches(said, concat('(?i)\\b', currency, '\\b')) OR (amount = 0 AND regexp_matches(said, '{E.FREE}'))) THEN 'money:' || (amount::DECIMAL(18, 2))::VARCHAR || currency END) AS shown FROM s""")
def _(t):
    none = [F.lit(None).cast(kind) for kind in ("double", "boolean", "array<string>")]
    field = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in A.NORMALIZED.split(", ")} | {"kind": F.lit("money"), "amount": F.col("amount"), "currency": F.col("currency")}
    proposed = F.struct(*(c.alias(f) for f, c in field.items()))
    got = t.withColumn("v", A.sanitized_value(F.col("value_type"), F.col("value_type") == "money", F.col("text"), *none, F.col("display"), proposed, F.array("excerpt")))
    v, two = F.col("v"), lambda c: c.cast("decimal(18,2)").cast("string")
    shown = F.coalesce(v["day"], v["text"], F.concat(two(v["amount"]), F.coalesce(v["currency"], v["unit"])), two(v["number"]), v["flag"].cast("string"), F.concat(two(v["minimum"]), two(v["maximum"])))
    return got.select("slug", "claim_id", F.concat(v["kind"], F.lit(":"), shown).alias("shown"))
