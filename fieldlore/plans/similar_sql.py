"""SQL for what rests on the similarity of names: the matching-blocks ratio as a recursion over the regions of two strings."""

from __future__ import annotations

from fieldlore.operators import resolution
from fieldlore.plans.graph import OTHER_RELATION, ROLE_POLICY
from fieldlore.plans.retrieval import _WITH

#: Characters that are counted to leave few pairs for the recursion.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 -"


def _counts(column: str) -> str:
    return ", ".join(f"(length({column}) - length(replace({column}, '{c}', '')))::int AS c{i}" for i, c in enumerate(LETTERS))


def counted(table: str, column: str) -> str:
    """Distinct strings with their counted letters; what is no such letter counts together."""
    return f"(SELECT *, length(w) - ({' + '.join(f'c{i}' for i in range(len(LETTERS)))}) AS rest FROM (SELECT {column} AS w, {_counts(column)} FROM (SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL)))"


def bound(a: str, b: str) -> str:
    common = " + ".join([*(f"least({a}.c{i}, {b}.c{i})" for i in range(len(LETTERS))), f"least({a}.rest, {b}.rest)"])
    return f"2.0 * ({common}) / greatest(length({a}.w) + length({b}.w), 1)"


def rated(want: str) -> str:
    """CTEs blk and rated(a, b, ratio) for the pairs a, b of a CTE: the longest common part of a region, the earliest in a and
    then in b, counts, and the regions before and behind it are gone through in turn."""
    sa, sb = "substr(a, r.al + 1, r.ah - r.al)", "substr(b, r.bl + 1, r.bh - r.bl)"
    return (
        f"blk AS (SELECT a, b, [{{'al': 0::bigint, 'ah': length(a), 'bl': 0::bigint, 'bh': length(b)}}] AS todo, 0::bigint AS m FROM {want} UNION ALL "
        "SELECT a, b, list_concat(rest, CASE WHEN best.n > 0 THEN list_filter([{'al': r.al, 'ah': r.al - best.i, 'bl': r.bl, 'bh': r.bl + best.j}, {'al': r.al - best.i + best.n, 'ah': r.ah, 'bl': r.bl + best.j + best.n, 'bh': r.bh}], lambda x: x.ah > x.al AND x.bh > x.bl) ELSE [] END), m + greatest(best.n, 0) FROM ("
        f"SELECT a, b, m, r, rest, {{'n': best0.n, 'i': best0.i, 'j': (strpos({sb}, substr({sa}, -best0.i + 1, best0.n)) - 1)::bigint}} AS best FROM ("
        f"SELECT a, b, m, r, rest, coalesce(list_max(list_transform(range(r.ah - r.al), lambda i: {{'n': len(list_filter(range(1, r.ah - r.al - i + 1), lambda l: contains({sb}, substr({sa}, i + 1, l)))), 'i': -i}})), {{'n': 0::bigint, 'i': 0::bigint}}) AS best0 FROM (SELECT a, b, m, todo[1] AS r, todo[2:] AS rest FROM blk WHERE len(todo) > 0)))), "
        "rated AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * m / (length(a) + length(b)) END AS ratio FROM blk WHERE len(todo) = 0)"
    )


def similar(forms: str, names: str, least: float) -> str:
    """CTEs up to alike(form, name_form, score): D1 over all pairs at or above the threshold. forms(form), names(name_form)."""
    shared = "len(list_intersect(list_filter(string_split(f.w, ' '), lambda x: x <> ''), list_filter(string_split(n.w, ' '), lambda x: x <> '')))"
    return (
        f"f AS {counted(forms, 'form')}, n AS {counted(names, 'name_form')}, "
        f"want AS (SELECT f.w AS a, n.w AS b FROM f, n WHERE {bound('f', 'n')} >= {least - 1e-4} OR contains(f.w, n.w) OR contains(n.w, f.w) OR {shared} > 0), "
        + rated("want")
        + ", words AS (SELECT a, b, ratio, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS y FROM rated), "
        f"alike AS (SELECT a AS form, b AS name_form, score FROM (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(greatest(ratio, CASE WHEN contains(a, b) OR contains(b, a) THEN 0.88 ELSE 0.0 END, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / greatest(len(x), len(y)) ELSE 0.0 END), 4) END::double AS score FROM words) WHERE score >= {least})"
    )


_NORMAL = r"regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9\s\-]', '', 'g'), '\s+', ' ', 'g')"
_R = _WITH.replace("WITH docs", "WITH RECURSIVE docs", 1).rstrip()


def _best(source: str) -> str:
    """D4 over a CTE of scored candidates."""
    rank = "OVER (PARTITION BY mention_id ORDER BY score DESC, seed_order, entity_id)"
    return f"(SELECT mention_id, paragraph_id, entity_id, entity_type, CASE WHEN score >= {resolution.REFERS} AND score - second >= {resolution.GAP} THEN 'REFERS_TO' ELSE 'POSSIBLY_REFERS_TO' END AS relation_type, round(score, 4) AS match_score FROM (SELECT *, row_number() {rank} AS place, coalesce(lead(score) {rank}, 0.0) AS second FROM {source}) WHERE place = 1 AND score >= {resolution.MAYBE})"


def resolved(preferred: dict[str, tuple[str, ...]]) -> str:
    """All mentions with the types that their paragraph's claims prefer, then with the type that its sure
    mentions mostly have."""
    boosts = " ".join(f"WHEN t = '{c}' THEN CASE entity_type " + " ".join(f"WHEN '{e}' THEN {b}" for e, b in zip(es, resolution.BOOSTS)) + " " + " ".join(f"WHEN '{e}' THEN 0.0" for e in es[len(resolution.BOOSTS) :]) + f" ELSE {resolution.ABSENT} END" for c, es in preferred.items())
    return (
        _R + f", asked AS (SELECT mention_id, paragraph_id, {_NORMAL.format('surface_form')} AS form FROM mention WHERE mention_id IS NOT NULL AND surface_form IS NOT NULL AND {_NORMAL.format('surface_form')} <> ''), "
        f"vocabulary AS (SELECT lower(entity_type) || ':' || lower(name) AS entity_id, entity_type, {_NORMAL.format('name')} AS name_form, seed_order FROM (SELECT entity_type, name, min(seed_row) AS seed_order FROM seed_entities WHERE entity_type IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)), "
        + similar("asked", "vocabulary", resolution.MAYBE)
        + ", context AS (SELECT paragraph_id, list_distinct(list(claim_type)) AS types FROM claim GROUP BY 1), "
        f"moved AS (SELECT mention_id, a.paragraph_id, entity_id, entity_type, seed_order, score, types, list_filter(list_transform(types, lambda t: CASE {boosts} END), lambda v: v IS NOT NULL) AS vs FROM asked a JOIN alike USING (form) JOIN vocabulary USING (name_form) LEFT JOIN context c ON c.paragraph_id = a.paragraph_id), "
        f"scored AS (SELECT mention_id, paragraph_id, entity_id, entity_type, seed_order, CASE WHEN len(types) > 0 THEN greatest(least(score + CASE WHEN len(vs) = 0 THEN 0.0 WHEN list_max(vs) > 0 THEN list_max(vs) ELSE list_min(vs) END::double, 1.0), {resolution.MAYBE}) ELSE score END AS score FROM moved), "
        f"sure AS (SELECT * FROM {_best('scored')} WHERE relation_type = 'REFERS_TO'), "
        "mostly AS (SELECT paragraph_id, arg_max(entity_type, (n, seen)) AS most FROM (SELECT paragraph_id, entity_type, count(*) AS n, min(mention_id) AS seen FROM sure GROUP BY 1, 2) GROUP BY 1), "
        f"helped AS (SELECT mention_id, s.paragraph_id, entity_id, entity_type, seed_order, CASE WHEN entity_type = most THEN least(score + {resolution.TOGETHER}, 1.0) ELSE score END AS score FROM scored s LEFT JOIN mostly m ON m.paragraph_id = s.paragraph_id WHERE mention_id NOT IN (SELECT mention_id FROM sure)) "
        f"SELECT mention_id, entity_id, relation_type, match_score FROM sure UNION ALL SELECT mention_id, entity_id, relation_type, match_score FROM {_best('helped')}"
    )


def targeted() -> str:
    """D22."""
    policy = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE_POLICY.items())
    return (
        _R + f", asked AS (SELECT mention_id, run_id, paragraph_id, {_NORMAL.format('normalized_form')} AS form FROM mention WHERE normalized_form IS NOT NULL AND mention_id IS NOT NULL AND normalized_form NOT IN (SELECT lower(name) FROM entity) AND {_NORMAL.format('normalized_form')} <> ''), "
        f"vocabulary AS (SELECT entity_id, entity_type, {_NORMAL.format('name')} AS name_form, ('0x' || substr(md5(entity_id), 1, 8))::bigint AS seed_order FROM entity), "
        + similar("asked", "vocabulary", resolution.MAYBE)
        + ", scored AS (SELECT mention_id, paragraph_id, entity_id, entity_type, seed_order, score FROM asked JOIN alike USING (form) JOIN vocabulary USING (name_form)), "
        f"sure AS (SELECT mention_id, entity_id, entity_type FROM {_best('scored')} WHERE relation_type = 'REFERS_TO') "
        f"SELECT DISTINCT claim_id, entity_id, coalesce(CASE entity_type {policy} END, '{OTHER_RELATION}') AS relation_type FROM asked JOIN sure USING (mention_id) JOIN claim USING (run_id, paragraph_id) WHERE (claim_id, entity_id) NOT IN (SELECT (claim_id, entity_id) FROM edge)"
    )


def entity_groups(least: float) -> str:
    """Pairs of one type that are alike, then the names in order: a free one becomes an anchor and takes the free
    ones alike."""
    return (
        _R + ", form AS (SELECT entity_type, entity_id, lower(name) AS w FROM entity WHERE name <> ''), "
        f"c AS {counted('form', 'w')}, want AS (SELECT DISTINCT x.w AS a, y.w AS b FROM form x JOIN form y ON x.entity_type = y.entity_type AND x.entity_id < y.entity_id JOIN c f ON f.w = x.w JOIN c n ON n.w = y.w WHERE {bound('f', 'n')} >= {least - 1e-4}), "
        + rated("want")
        + f", pair AS (SELECT x.entity_type, x.entity_id AS a, y.entity_id AS b, ratio AS score FROM form x JOIN form y ON x.entity_type = y.entity_type AND x.entity_id < y.entity_id JOIN rated r ON r.a = x.w AND r.b = y.w WHERE ratio >= {least}), "
        "name AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT a AS x FROM pair UNION SELECT b FROM pair)), "
        "near AS (SELECT i, x, coalesce(list(b ORDER BY b) FILTER (b IS NOT NULL), []) AS bs FROM name LEFT JOIN pair ON a = x GROUP BY 1, 2), "
        "walk AS (SELECT 0::bigint AS i, []::varchar[] AS taken, []::struct(anchor varchar, member varchar)[] AS got UNION ALL "
        "SELECT n.i, CASE WHEN list_contains(taken, n.x) THEN taken ELSE list_concat(taken, list_filter(bs, lambda y: NOT list_contains(taken, y)), [n.x]) END, CASE WHEN list_contains(taken, n.x) THEN got ELSE list_concat(got, list_transform(list_filter(bs, lambda y: NOT list_contains(taken, y)), lambda y: {'anchor': n.x, 'member': y})) END FROM walk w JOIN near n ON n.i = w.i + 1), "
        "link AS (SELECT unnest(got) AS g FROM walk WHERE i = (SELECT max(i) FROM walk)), grouped AS (SELECT g.anchor AS anchor, g.member AS member, score FROM link JOIN pair ON a = g.anchor AND b = g.member) "
        "SELECT entity_type, anchor, entity_id, round(score, 6) AS score FROM (SELECT anchor, member AS entity_id, score FROM grouped UNION ALL SELECT DISTINCT anchor, anchor, 1.0 FROM grouped) JOIN (SELECT DISTINCT entity_id, entity_type FROM entity) USING (entity_id)"
    )


def spelling(least: float = 0.84) -> str:
    """R14."""
    terms = r"SELECT unnest(regexp_extract_all(lower({c}), '([a-z][a-z0-9''-]*)', 1)) AS term FROM {t}"
    return (
        _R + f", term AS (SELECT DISTINCT term FROM (SELECT term, count(*) AS n FROM ({terms.format(c='name', t='entity')}) GROUP BY 1 UNION ALL SELECT term, count(*) FROM ({terms.format(c='source_sentence', t='claim')}) GROUP BY 1 HAVING count(*) >= 5) WHERE length(term) >= 4), "
        r"tok AS (SELECT claim_id, surface, lower(surface) AS token FROM (SELECT claim_id, unnest(regexp_extract_all(source_sentence, '([A-Za-z][A-Za-z0-9''-]*)', 1)) AS surface FROM claim) WHERE length(surface) >= 4 AND lower(surface) NOT IN (SELECT term FROM term)), "
        f"f AS {counted('tok', 'token')}, n AS {counted('term', 'term')}, want AS (SELECT f.w AS a, n.w AS b FROM f JOIN n ON substr(f.w, 1, 1) = substr(n.w, 1, 1) AND abs(length(f.w) - length(n.w)) <= 2 WHERE f.w <> n.w AND {bound('f', 'n')} >= {least - 1e-9}), "
        + rated("want")
        + f", top_one AS (SELECT a AS token, arg_max(b, (ratio, b)) AS suggestion FROM rated WHERE ratio >= {least} GROUP BY 1), "
        r"seen AS (SELECT claim_id, tok.token, surface, suggestion, regexp_matches(tok.token, '[a-z][0-9]|[0-9][a-z]') AS digit, contains(tok.token, 'rn') AND NOT contains(tok.token, 'm') AS confused FROM tok LEFT JOIN top_one USING (token)) "
        "SELECT claim_id, token, min(surface) AS suspect_text, max(suggestion) AS suggested_correction, min(CASE WHEN suggestion IS NOT NULL AND digit THEN 'high' WHEN digit OR confused THEN 'medium' ELSE 'low' END) AS severity FROM seen WHERE digit OR suggestion IS NOT NULL GROUP BY 1, 2"
    )
