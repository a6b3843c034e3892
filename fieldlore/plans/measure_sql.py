"""SQL of the measurements that a sentence states (X14 to X18): places of matches from what lies between them."""

from __future__ import annotations

from fieldlore.operators.extraction import MONTHS, MeasurementKernel, MeasurementRules


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def places(text: str, pattern: str) -> str:
    """A list of {s, e, m}: start, end and text of all matches of a pattern (without groups that capture)."""
    gaps, found = f"string_split_regex({text}, {_q(pattern)})", f"regexp_extract_all({text}, {_q(pattern)})"
    before = f"list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(({found})[1:i - 1], lambda g: length(g))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': ({before})::bigint, 'm': ({found})[i]}})"


def measurements(claims: str, rules: MeasurementRules = MeasurementRules()) -> str:
    """The query over a table of claims (claim_id, claim_type, sentence)."""
    number = r"\d+(?:\.\d+)?"
    k = MeasurementKernel(rules)
    flat = lambda p: p.replace("(\\d+(?:\\.\\d+)?)", f"(?:{number})")
    spans = [(kind, ("(?i)" if pattern.flags & 2 else "") + flat(pattern.pattern)) for kind, pattern in k.spans]
    num = lambda m, i: f"regexp_extract_all({m}, '{number}')[{i}]::double"
    after = lambda x, n: f"substr(sentence, ({x}.s + length({x}.m) + 1)::int, {n})"
    usual = [(u, name, unit) for u, name, unit in rules.units if not u.startswith("farmers")]
    first_unit = lambda text, what: "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q('(?i)^\\s*(?:' + u + ')\\b')}) THEN '{name if what else unit}'" for u, name, unit in usual) + " END"
    counting = "claim_type IN (" + ", ".join(f"'{c}'" for c in sorted(rules.counting)) + ")"
    special = lambda c: f"CASE WHEN {c} <> 'acres' THEN {c} WHEN claim_type = 'fire_incident' THEN 'acres_burned' WHEN claim_type = 'economic_use' OR contains(lower(sentence), 'cut') THEN 'land_area' ELSE {c} END"
    animal = lambda text: f"nullif(regexp_extract({text}, {_q('(?i)^\\s*(' + rules.animals + ')\\b')}, 1), '')"
    notes = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '(?i)\\b({p})\\b') THEN '{w}'" for w, p in (("estimated", "estimated|approximately|approx|about|around"), ("counted", "counted|tallied|enumerated"), ("surveyed", "surveyed|censused|banded"), ("reported", "reported|observed|recorded|noted"))) + " END"
    inside = lambda x, table: f"EXISTS (SELECT 1 FROM {table} u WHERE u.claim_id = {x}.claim_id AND {x}.s >= u.s AND {x}.s < u.s + length(u.m))"
    context = _q(f"(?i)\\b(?:{rules.animals}|{rules.verbs})\\b")
    months = "|".join(sorted(MONTHS, key=len, reverse=True))
    hits = lambda i, pattern: f"SELECT claim_id, claim_type, sentence, {i} AS rank, unnest({places('sentence', pattern)}, recursive := true) FROM c"
    ctes = [f"c AS (SELECT * FROM {claims} WHERE sentence IS NOT NULL)", f"ranges AS ({hits(0, spans[0][1])} UNION ALL {hits(1, spans[1][1])})"]
    ctes += [f"lows AS (SELECT * FROM ({hits(2, spans[2][1])}) x WHERE NOT {inside('x', 'ranges')})", "used0 AS (SELECT * FROM ranges UNION ALL SELECT * FROM lows)", f"highs AS (SELECT * FROM ({hits(3, spans[3][1])}) x WHERE NOT {inside('x', 'used0')})", "used AS (SELECT * FROM used0 UNION ALL SELECT * FROM highs)"]
    right = after("x", 25)
    ctes.append(
        f"span AS (SELECT claim_id, x.rank AS rank, x.s AS s, CASE WHEN {first_unit(right, 1)} IS NOT NULL THEN {special(first_unit(right, 1))} ELSE 'individual_count' END AS name, x.m AS raw_value, NULL::double AS numeric_value, coalesce({first_unit(right, 0)}, 'individuals') AS unit, true AS approximate, "
        f"CASE WHEN x.rank < 2 THEN {num('x.m', 1)} WHEN x.rank = 2 THEN {num('x.m', 1)} END AS lower_bound, CASE WHEN x.rank < 2 THEN {num('x.m', 2)} WHEN x.rank = 3 THEN {num('x.m', 1)} END AS upper_bound, CASE WHEN {first_unit(right, 1)} IS NULL AND {counting} THEN {animal(right)} END AS target FROM used x)"
    )
    about = "regexp_matches(sentence, '(?i)\\b(about|around|approx|approximately|estimated)\\b')"
    units = " UNION ALL ".join(f"SELECT claim_id, {10 + i} AS rank, x.s AS s, {special(repr(name))} AS name, x.m AS raw_value, {num('x.m', 1)} AS numeric_value, '{unit}' AS unit, {about} AS approximate, NULL::double AS lower_bound, NULL::double AS upper_bound, NULL AS target FROM ({hits(10 + i, f'(?i){number}\\s*(?:{u})\\b')}) x WHERE NOT {inside('x', 'used')}" for i, (u, name, unit) in enumerate(rules.units))
    ctes.append(f"by_unit AS ({units})")
    money = rf"(?:(?:USD|usd)\s*)?\$?\s*{number}\s*(?:dollars?|USD|usd)?"
    ctes.append(f"money AS (SELECT claim_id, 30 AS rank, x.s AS s, CASE WHEN claim_type = 'fire_incident' THEN 'suppression_cost' ELSE 'revenue' END AS name, trim(x.m) AS raw_value, {num('x.m', 1)} AS numeric_value, 'USD' AS unit, {about} AS approximate, NULL::double AS lower_bound, NULL::double AS upper_bound, NULL AS target FROM ({hits(30, money)}) x WHERE regexp_matches(x.m, '(?i)\\$|usd|dollar'))")
    ctes.append("stated AS (SELECT * FROM span UNION ALL SELECT * FROM by_unit UNION ALL SELECT * FROM money)")
    left, tail = "substr(sentence, 1, x.s::int)", "substr(sentence, (x.s + length(x.m) + 1)::int)"
    last = lambda n: f"right({left}, {n})"
    ahead = lambda n: f"left({tail}, {n})"
    role = (
        f"CASE WHEN x.m::double = floor(x.m::double) AND x.m::double BETWEEN 1800 AND 2100 THEN 'year' WHEN regexp_matches({last(20)}, '(?i)\\b(permit|serial|lot|parcel|tract|block|chapter|exhibit|appendix|ref\\.?)\\s*$') THEN 'serial' WHEN regexp_matches({ahead(20)}, '(?i)^\\s*(years?|months?|weeks?|decades?|centur(?:y|ies))\\b') THEN 'time' "
        f"WHEN {animal(ahead(20))} IS NOT NULL THEN 'count' WHEN regexp_matches({last(30)}, '(?i)\\b(pages?|tables?|figures?|fig\\.?|sections?|sec\\.?|no\\.|number|item)\\s*$') THEN 'reference' WHEN regexp_matches({ahead(30)}, '(?i)^\\s*(%|percent)') THEN 'percent' WHEN regexp_matches({ahead(30)}, '(?i)^\\s*acres?\\b') THEN 'area' "
        f"WHEN regexp_matches({last(15)}, '(?i)\\b(?:{months})\\.?\\s*$') THEN 'day' WHEN regexp_matches({last(50)} || ' ' || {ahead(50)}, {context}) THEN 'count' ELSE 'other' END"
    )
    ctes.append(f"bare AS (SELECT claim_id, 40 AS rank, x.s AS s, 'individual_count' AS name, x.m AS raw_value, x.m::double AS numeric_value, 'individuals' AS unit, {about} AS approximate, NULL::double AS lower_bound, NULL::double AS upper_bound, {animal(ahead(25))} AS target FROM ({hits(40, f'\\b{number}\\b')}) x WHERE {counting} AND regexp_matches(sentence, {context}) AND claim_id NOT IN (SELECT claim_id FROM stated) AND NOT {inside('x', 'used')} AND {role} = 'count')")
    ctes.append("found AS (SELECT * FROM stated UNION ALL SELECT * FROM bare)")
    # a measurement stated twice counts where it stands first
    ctes.append("once AS (SELECT *, row_number() OVER (PARTITION BY claim_id, name, raw_value, numeric_value, unit ORDER BY rank, s) AS again FROM found)")
    return "WITH " + ", ".join(ctes) + f" SELECT claim_id, (row_number() OVER (PARTITION BY claim_id ORDER BY rank, s) - 1)::int AS position, name, raw_value, numeric_value, unit, approximate, lower_bound, upper_bound, {notes} AS methodology_note, target FROM once JOIN (SELECT claim_id, sentence FROM c) USING (claim_id) WHERE again = 1"
