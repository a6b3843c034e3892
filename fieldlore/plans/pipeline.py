"""Queries of the text pipeline: structure, claims, measurements, mentions, resolution, derivation, review."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlore.functions.text import normalize_name
from fieldlore.operators import derivation, extraction, resolution, structure
from fieldlore.plans import planner
from fieldlore.plans.audits import claim_links
from fieldlore.plans.graph import EVENTS, OBSERVED, Access, Graph
from fieldlore.review import detectors
from fieldlore.session import cut, small_or_plain, table

PREFERRED = {"population_estimate": ("Species", "Place", "SurveyMethod"), "fire_incident": ("Place", "Habitat"), "weather_observation": ("Place",), "economic_use": ("Organization", "Place", "Activity")}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The pages' paragraphs without their sections."""
    return structure.paragraphs(structure.pages(table(spark, d, "report_pages")))


def _structure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # pages are shuffled with their texts once, and read by three steps
    pages = cut(structure.pages(table(spark, d, "report_pages")))
    sections = structure.sections(pages)
    return pages, sections, structure.paragraphs(pages, sections)


def sections(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[1]


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[2]


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    pages, found, _ = _structure(spark, d)
    return structure.page_sections(pages, found)


def rule_claims(spark: SparkSession, d: str) -> DataFrame:
    """X1 to X4 and X12 over the pages' paragraphs: valid claims."""
    rows = extraction.sentences(_texts(spark, d))
    valid = rows.where(extraction.reject_reason(F.col("sentence")).isNull())
    return extraction.classified(valid).select("paragraph_id", "position", "claim_type", F.round("score", 6).alias("score"), "extraction_confidence", "epistemic_status")


def classified(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return extraction.classified(g.claims.select("claim_id", "source_sentence"), "source_sentence").select("claim_id", "claim_type", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "secondary", "epistemic_status", "extraction_confidence")


def validated(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return g.claims.select("claim_id", extraction.reject_reason(F.col("source_sentence")).alias("reason"))


def claim_dates(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    at = g.runs.select("run_id", "doc_id").join(g.docs.select("doc_id", "report_year"), "doc_id")
    return g.claims.select("claim_id", "run_id", "source_sentence").join(at, "run_id").select("claim_id", extraction.claim_date(F.col("source_sentence"), F.col("report_year")).alias("inferred_date"))


def measurements(spark: SparkSession, d: str) -> DataFrame:
    return extraction.measurements(Graph(spark, d).claims.select("claim_id", "claim_type", F.col("source_sentence").alias("sentence")))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.mentions(_texts(spark, d), Graph(spark, d).entities)
    return found.withColumn("ocr_flags", F.array_join("ocr_flags", "|")).withColumn("entity_type_hints", F.array_join("entity_type_hints", "|"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    asked = g.mentions.where("mention_id IS NOT NULL AND surface_form IS NOT NULL").select("mention_id", "run_id", "paragraph_id", "start_offset", "end_offset", normalize_name(F.col("surface_form")).alias("normalized_form")).where("normalized_form <> ''")
    names = g._table("seed_entities").where("entity_type IS NOT NULL AND name IS NOT NULL").groupBy("entity_type", "name").agg(F.min("seed_row").alias("seed_order")).select(F.concat_ws(":", F.lower("entity_type"), F.lower("name")).alias("entity_id"), "entity_type", normalize_name(F.col("name")).alias("normalized_form"), "seed_order")
    found = resolution.resolve(asked, names, resolution.contexts(g.claims), PREFERRED)
    return asked.join(found.drop("paragraph_id"), "mention_id")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("mention_id", "entity_id", "relation_type", "match_score")


def _dated_claims(g: Graph) -> DataFrame:
    at = g.runs.select("run_id", "doc_id").join(g.docs.select("doc_id", "date_start", "date_end", "report_year"), "doc_id")
    rows = g.claims.join(at, "run_id")
    year, source = derivation.year_of(F.col("claim_date"), F.col("report_year"))
    return derivation.plausible(rows.withColumn("year", year).withColumn("year_source", source))


def claim_years(spark: SparkSession, d: str) -> DataFrame:
    return _dated_claims(Graph(spark, d)).select("claim_id", "year", "year_source")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return derivation.observations(_dated_claims(Graph(spark, d)), OBSERVED)


def events(spark: SparkSession, d: str) -> DataFrame:
    return derivation.events(_dated_claims(Graph(spark, d)), EVENTS)


def document_years(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return derivation.document_years(g.docs, _dated_claims(g))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    return derivation.concepts(Graph(spark, d).claims)


def penalised(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    links = derivation.tiered(g.edges.join(g.claims.select("claim_id", "claim_type"), "claim_id"))
    return derivation.penalised(g.claims.select("claim_id", "extraction_confidence"), links)


def roles(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    links = g.edges.withColumn("link_order", F.col("entity_id"))
    out = derivation.roles(g.claims.select("claim_id", "claim_type"), links, {"population_estimate": ("Species",), "fire_incident": ("Place",)})
    return out.select("claim_id", "place_id", F.array_join("missing", "|").alias("missing"), F.coalesce(F.size("role_entities"), F.lit(0)).alias("roles"))


def junk(spark: SparkSession, d: str) -> DataFrame:
    return detectors.junk_mentions(Graph(spark, d).mentions).select("target_id", "issue_class", "group_key", "confidence", "reason")


def junk_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """R3 with paragraphs: the mentions found in the pages' own ones, judged by where they stand too."""
    text = cut(_texts(spark, d))
    found = extraction.mentions(text, Graph(spark, d).entities)
    rows = found.select("paragraph_id", "surface_form", normalize_name(F.col("surface_form")).alias("normalized_form"), F.concat_ws("|", "paragraph_id", F.col("start_offset").cast("string")).alias("mention_id"))
    return detectors.junk_mentions(rows, text).groupBy("issue_class", "reason").agg(F.count("target_id").alias("mentions"))


def sensitive_texts(spark: SparkSession, d: str) -> DataFrame:
    """R5 over the transcripts of documents, which hold personal data."""
    rows = table(spark, d, "document_records").select(F.col("doc_id").alias("claim_id"), F.col("clean_text").alias("source_sentence")).where("clean_text IS NOT NULL").distinct()
    return detectors.sensitive(rows).select("target_id", "group_key", "confidence")


def sensitive(spark: SparkSession, d: str) -> DataFrame:
    return detectors.sensitive(Graph(spark, d).claims).select("target_id", "group_key", "confidence")


def _targets(spark: SparkSession, d: str, this_year: int | None = None) -> DataFrame:
    """All detectors' findings; this_year is that of today unless another one is asked for."""
    this_year = this_year or datetime.date.today().year
    g = Graph(spark, d)
    # both are small and read by several detectors
    edges = cut(g.edges.select("claim_id", "entity_id", "entity_type", "relation_type"))
    near = cut(_resolved(spark, d).where("entity_type IN ('Species', 'Place', 'Refuge')").select("run_id", "paragraph_id", "start_offset", "entity_id", "entity_type"))
    counts = edges.groupBy("entity_id").agg(F.count("claim_id").alias("n"))
    told = claim_links(g.claims, g.entities).where("relation_type = 'METHOD_FOCUS'").select("claim_id", F.concat_ws(":", F.lit("surveymethod"), "normalized_form").alias("entity_id"), "relation_type")
    methods = edges.select("claim_id", "entity_id", "relation_type").unionByName(told)
    found = [detectors.ocr_entities(g.entities, counts), detectors.junk_mentions(g.mentions), detectors.missing_links(g.claims, edges, near), detectors.method_overtrigger(g.claims, methods), detectors.sensitive(g.claims), detectors.living_people(g.claims, edges, this_year)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _exact_targets(spark: SparkSession, d: str) -> DataFrame:
    """The detectors that no similarity of names enters: mentions count for links where they equal a name."""
    g = Graph(spark, d)
    edges = cut(g.edges.select("claim_id", "entity_id", "entity_type", "relation_type"))
    near = g.mentions.where("normalized_form IS NOT NULL").select("run_id", "paragraph_id", "start_offset", "normalized_form").join(small_or_plain(g.entities.where("entity_type IN ('Species', 'Place', 'Refuge')").select("entity_id", "entity_type", F.lower("name").alias("normalized_form"))), "normalized_form")
    texts = table(spark, d, "document_records").select(F.col("doc_id").alias("claim_id"), F.col("clean_text").alias("source_sentence")).where("clean_text IS NOT NULL").distinct()
    # an edge needs the mention's paragraph, a far place only its run: claims that lack one are found all the same
    found = [detectors.junk_mentions(g.mentions), detectors.sensitive(texts), detectors.living_people(g.claims, edges, THIS_YEAR), detectors.method_overtrigger(g.claims, edges), detectors.missing_links(g.claims, edges, near)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: The year in which the exact review is done: with it people of the tables' last years count as living.
THIS_YEAR = 2060


def exact_proposals(spark: SparkSession, d: str) -> DataFrame:
    """R4, R5, R7 to R9."""
    return detectors.routed(_exact_targets(spark, d))


def exact_queue(spark: SparkSession, d: str) -> DataFrame:
    """The second page of what is queued."""
    return detectors.queue(exact_proposals(spark, d), 50, 50)


def exact_tiers(spark: SparkSession, d: str) -> DataFrame:
    """G16 and G17."""
    return batch_stats(exact_proposals(spark, d))


def batch_stats(proposals_: DataFrame, shown: int = 5) -> DataFrame:
    """By tier and class the proposals, least, most and mean confidence, and the first few by priority."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("priority_score")).alias("p"), F.col("proposal_id").alias("i")))), 1, shown)
    # of each class only a few of every part are gathered
    ranked = proposals_.withColumn("place", F.row_number().over(Window.partitionBy("review_tier", "issue_class", F.pmod(F.hash("proposal_id"), F.lit(64))).orderBy(F.desc("priority_score"), "proposal_id"))).where(F.col("place") <= shown)
    shown_rows = ranked.groupBy("review_tier", "issue_class").agg(F.array_join(F.transform(first, lambda x: x["i"]), "|").alias("first"))
    by = proposals_.groupBy("review_tier", "issue_class").agg(F.count("proposal_id").alias("proposals"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.round(F.avg("confidence"), 6).alias("mean"))
    return by.join(shown_rows, ["review_tier", "issue_class"])


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return detectors.routed(_targets(spark, d))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return detectors.queue(proposals(spark, d))


def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    """G16 and G17."""
    return batch_stats(proposals(spark, d))


def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    return detectors.entity_groups(Graph(spark, d).entities).withColumn("score", F.round("score", 6))


def group_contexts(spark: SparkSession, d: str) -> DataFrame:
    """R2, with the mentions found in the pages' own paragraphs: those of mention_drafts are numbered otherwise."""
    g = Graph(spark, d)
    text = cut(_texts(spark, d))
    named = small_or_plain(g.entities.select("entity_id", normalize_name(F.col("name")).alias("form")))
    found = extraction.mentions(text, g.entities).withColumn("form", normalize_name(F.col("surface_form"))).join(named, "form")
    counts = g.edges.groupBy("entity_id").agg(F.count("claim_id").alias("n"))
    return detectors.context_paragraphs(detectors.entity_groups(g.entities), found, text, counts).withColumn("surface_forms", F.array_join("surface_forms", "|"))


def spelling(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    words = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9'-]*)"), F.lit(1))).alias("term"))
    terms = words(g.entities, "name").groupBy("term").agg(F.count("term").alias("n")).unionByName(words(g.claims, "source_sentence").groupBy("term").agg(F.count("term").alias("n")).where("n >= 5")).where("length(term) >= 4").select("term").distinct()
    return detectors.spelling_queue(g.claims, terms)


QUESTIONS = ("How many fires burned between 1940 and 1950?", "What did observers report about the blue-wing teal?", "Describe the rain at Corvale Meadow", "total hay cost per year")


def answers(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d, Access())
    rows = [planner.answer(g, q).withColumn("question", F.lit(q)) for q in QUESTIONS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("question", "claim_id", "claim_type", "tier", "text")


def classified_log(spark: SparkSession, d: str) -> DataFrame:
    return planner.classified_log(Graph(spark, d).claims.select("claim_id", "source_sentence"), "source_sentence").select("claim_id", "bucket", "confidence")


QUERIES = {
    "p_structure_sections": sections, "p_structure_paragraphs": paragraphs, "j5_page_sections": page_sections, "x1_rule_claims": rule_claims, "x2_classified": classified, "x12_validated": validated, "x13_claim_dates": claim_dates, "x14_measurements": measurements, "x19_mentions": mentions,
    "d5_resolved": resolved, "d14_roles": roles, "d15_claim_years": claim_years, "d16_observations": observations, "d17_events": events, "d18_document_years": document_years, "d20_concepts": concepts, "d12_penalised": penalised, "r1_entity_groups": entity_groups, "r2_contexts": group_contexts, "r3_junk": junk, "r5_sensitive": sensitive, "r5_sensitive_texts": sensitive_texts, "r3_junk_in_pages": junk_in_pages,
    "r7_proposals": proposals, "r7_exact": exact_proposals, "t3_exact": exact_queue, "g17_exact": exact_tiers, "t3_review_queue": review_queue, "g17_tiers": tier_counts, "r14_spelling": spelling, "q5_answers": answers, "q1_classified_log": classified_log,
}

from fieldlore.plans.retrieval import _WITH  # noqa: E402

_C = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM claims)"
_D = f"(SELECT c.*, d.date_start, d.date_end, d.report_year, d.doc_id FROM {_C} c JOIN (SELECT DISTINCT * FROM extraction_runs) r USING (run_id) JOIN (SELECT DISTINCT doc_id, date_start, date_end, report_year FROM document_records) d ON d.doc_id = r.doc_id)"
_Y = r"\b(1[89]\d{2}|20[0-2]\d)\b"
_YEARS = f"(SELECT *, CASE WHEN lo IS NOT NULL AND year IS NOT NULL AND NOT year BETWEEN lo - 5 AND hi + 5 THEN 'suspect' ELSE source END AS year_source FROM (SELECT *, coalesce(a, b) AS lo, coalesce(b, a) AS hi FROM (SELECT *, coalesce(try_cast(nullif(regexp_extract(coalesce(claim_date, ''), '{_Y}', 1), '') AS int), report_year) AS year, CASE WHEN regexp_matches(coalesce(claim_date, ''), '{_Y}') THEN 'claim_date' WHEN report_year IS NOT NULL THEN 'document_primary_year' ELSE 'unknown' END AS source, CASE WHEN coalesce(date_start, '') <> '' THEN try_cast(nullif(regexp_extract(date_start, '{_Y}', 1), '') AS int) ELSE report_year END AS a, CASE WHEN coalesce(date_end, '') <> '' THEN try_cast(nullif(regexp_extract(date_end, '{_Y}', 1), '') AS int) ELSE report_year END AS b FROM {_D})))"
from fieldlore.plans.audits import SCORES as _scores  # noqa: E402

_junk = f"CASE WHEN t = '' OR regexp_matches(t, '^[^a-zA-Z]*$') OR regexp_matches(t, '^\\d{{2,}}[a-zA-Z]{{0,2}}$') OR (length(t) > 2 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / length(t) < 0.4) THEN 'ocr_garbage' WHEN length(f) < 4 OR f IN {detectors.GENERIC} THEN 'short_generic_token' END"
_pii = [f"CASE WHEN regexp_matches(source_sentence, '{p}') THEN {{'confidence': {c}::double, 'ord': {-i}, 'label': '{label}'}} END" for i, (label, p, c) in enumerate(detectors.SENSITIVE)]
ORACLES = {
    "x2_classified": f"SELECT claim_id, best.type AS claim_type, round(best.score, 6) AS score, round(best.score - second.score, 6) AS margin, CASE WHEN best.score - second.score < 0.35 AND second.score > 0 THEN second.type END AS secondary, status AS epistemic_status, round(greatest(0.0, least(1.0, 0.6 + 0.32 * (0.65 * least((best.score - 0.85) / 1.65, 1.0) + 0.35 * least((best.score - second.score) / 0.35, 1.0)) - CASE status WHEN 'uncertain' THEN 0.08 ELSE 0 END)), 4) AS extraction_confidence FROM (SELECT claim_id, r[1] AS best, r[2] AS second, CASE WHEN regexp_matches(source_sentence, '{extraction.UNCERTAIN_WORDS}') THEN 'uncertain' ELSE 'certain' END AS status FROM (SELECT claim_id, source_sentence, list_reverse_sort([{_scores}]) AS r FROM {_C})) WHERE best.score >= 0.85",
    "x12_validated": f"SELECT claim_id, CASE WHEN length(t) < 20 THEN 'too_short' WHEN len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) < 3 THEN 'too_few_words' WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / length(t) < 0.5 THEN 'low_alpha_density' WHEN NOT regexp_matches(t, '{extraction.FINITE_VERB}') AND regexp_matches(t, '^(?:(?:[A-Z]{{2,}}(?:\\s+[A-Z]{{2,}}){{0,4}})|(?:[A-Z][a-z]+(?:\\s+(?:[A-Z][a-z]+|and|of|the|for|in|on|at|to|by)){{0,3}}))[:.]?\\s*$') THEN 'section_heading' WHEN regexp_matches(t, '^[A-Z\\-•*\\d][\\-.)]\\s{{0,3}}\\w{{0,15}}\\.?\\s*$') THEN 'list_artifact' WHEN NOT regexp_matches(t, '{extraction.FINITE_VERB}') THEN 'no_finite_verb' WHEN regexp_matches(t, '(?i)\\b(Mr|Mrs|Dr|Gov|Col|Lt|Sgt|St|Jr|Sr|Mgr|Dept|Approx|Oct|Nov|Dec|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?)\\.\\s*$') THEN 'truncated_at_honorific' END AS reason FROM (SELECT claim_id, trim(source_sentence) AS t FROM {_C})",
    "d15_claim_years": f"SELECT claim_id, year, year_source FROM {_YEARS}",
    "d18_document_years": f"SELECT DISTINCT doc_id, year, 'year_' || year AS year_id FROM (SELECT DISTINCT doc_id, report_year AS year FROM document_records UNION SELECT doc_id, year FROM {_YEARS}) WHERE year IS NOT NULL",
    "d20_concepts": " UNION ALL ".join(f"SELECT claim_id, '{c}' AS concept_id, {conf}::double AS confidence, substr('{p}', 1, 60) AS matched_rule FROM {_C} WHERE claim_type IN ({', '.join(map(repr, ts))}) AND regexp_matches(source_sentence, '(?i){p}')" for c, ts, p, conf in derivation.CONCEPTS),
    "r3_junk": f"SELECT mention_id AS target_id, CASE reason WHEN 'ocr_garbage' THEN 'ocr_garbage_mention' ELSE reason END AS issue_class, split_part(paragraph_id, ':', 1) || '|' || reason AS group_key, 0.7::double AS confidence, reason FROM (SELECT *, {_junk} AS reason FROM (SELECT DISTINCT mention_id, paragraph_id, trim(surface_form) AS t, lower(trim(coalesce(normalized_form, ''))) AS f FROM mention_drafts WHERE surface_form IS NOT NULL)) WHERE reason IS NOT NULL",
    "r5_sensitive": f"SELECT claim_id AS target_id, hit.label AS group_key, hit.confidence AS confidence FROM (SELECT claim_id, list_max([{', '.join(_pii)}]) AS hit FROM {_C}) WHERE hit IS NOT NULL",
    "r5_sensitive_texts": f"SELECT claim_id AS target_id, hit.label AS group_key, hit.confidence AS confidence FROM (SELECT claim_id, list_max([{', '.join(_pii)}]) AS hit FROM (SELECT DISTINCT doc_id AS claim_id, clean_text AS source_sentence FROM document_records WHERE clean_text IS NOT NULL)) WHERE hit IS NOT NULL",
    "q1_classified_log": f"SELECT claim_id, CASE WHEN a > 0 AND c > 0 THEN 'hybrid' WHEN a > 0 THEN 'analytical' ELSE 'conversational' END AS bucket, round(CASE WHEN a > 0 AND c > 0 THEN greatest(a, c) / (a + c) WHEN a > 0 OR c > 0 THEN 1.0 ELSE 0.5 END, 6) AS confidence FROM (SELECT claim_id, {' + '.join(f'contains(lower(source_sentence), {w!r})::int' for w in planner.ANALYTICAL)} AS a, {' + '.join(f'contains(lower(source_sentence), {w!r})::int' for w in planner.CONVERSATIONAL)} AS c FROM {_C})",
    "x13_claim_dates": "SELECT claim_id, CASE WHEN m IS NOT NULL AND y <> 0 THEN printf('%04d-%02d-%02d', y, m, d) END AS inferred_date FROM (SELECT claim_id, CASE lower(regexp_extract(source_sentence, '{p}', 1)) {months} END AS m, try_cast(regexp_extract(source_sentence, '{p}', 2) AS int) AS d, coalesce(try_cast(nullif(regexp_extract(source_sentence, '{p}', 3), '') AS int), report_year) AS y FROM {rows})".replace("{p}", r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:,\s*(\d{4}))?\b").replace("{months}", " ".join(f"WHEN '{k}' THEN {v}" for k, v in extraction.MONTHS.items())).replace("{rows}", _D),
    "d12_penalised": _WITH + "SELECT claim_id, round(greatest(0.0, extraction_confidence - 0.1 * coalesce(n, 0)), 4) AS extraction_confidence FROM claim LEFT JOIN (SELECT claim_id, count(*) AS n FROM edge JOIN claim USING (claim_id) WHERE claim_type || '|' || relation_type NOT IN (" + ", ".join(f"'{c}|{r}'" for c, r in derivation.TIERS) + ") GROUP BY 1) USING (claim_id)",
    "d14_roles": _WITH + "SELECT claim_id, place_id, CASE WHEN claim_type = 'population_estimate' AND coalesce(species, 0) = 0 THEN 'Species' WHEN claim_type = 'fire_incident' AND coalesce(places, 0) = 0 THEN 'Place' ELSE '' END AS missing, coalesce(n, 0) AS roles FROM claim LEFT JOIN (SELECT claim_id, count(DISTINCT entity_type)::int AS n, count(*) FILTER (entity_type = 'Species') AS species, count(*) FILTER (entity_type = 'Place') AS places, arg_min(entity_id, (CASE entity_type WHEN 'Place' THEN 0 ELSE 1 END, entity_id)) FILTER (relation_type = 'OCCURRED_AT') AS place_id FROM edge GROUP BY 1) USING (claim_id)",
}


def _derived_sql(prefix: str, kinds: dict[str, str]) -> str:
    """Numbered within the run, with the year and where it comes from."""
    kind = "CASE claim_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " END"
    rows = f"(SELECT *, {kind} AS kind, row_number() OVER (PARTITION BY run_id ORDER BY paragraph_id, claim_id) AS n FROM {_YEARS} WHERE claim_type IN ({', '.join(map(repr, kinds))}))"
    name = f"run_id || printf(':{prefix}:%03d:', n) || substr(sha1(regexp_replace(trim(lower(claim_id)), '\\s+', ' ', 'g') || '||' || lower(kind)), 1, 16)"
    return f"SELECT {name} AS {prefix}_id, run_id, claim_id, paragraph_id, kind AS {prefix}_type, year, year_source, extraction_confidence AS confidence, epistemic_status = 'uncertain' AS is_estimate FROM {rows}"


#: The lines that are headings, the sections that they begin, and those that pages without one open.
_SECTIONS = (
    r"WITH page AS (SELECT doc_id, page_number, min(page_id) AS page_id, coalesce(max(raw_ocr_text), '') AS text FROM report_pages WHERE doc_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2), "
    r"split AS (SELECT doc_id, page_number, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS line_no FROM page), "
    r"line AS (SELECT doc_id, page_number, line_no, regexp_replace(raw, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS line FROM split), "
    r"head AS (SELECT doc_id, page_number, line_no, try_cast(nullif(regexp_extract(line, '^\s*(\d{1,2})[.)]\s+(.+?)\s*$', 1), '') AS int) AS number, CASE WHEN NOT regexp_matches(line, '^\s*(\d{1,2})[.)]\s+(.+?)\s*$') THEN regexp_extract(line, '^\s*([A-Z])[.)]\s+(.+?)\s*$', 1) END AS letter, CASE WHEN regexp_matches(line, '^\s*(\d{1,2})[.)]\s+(.+?)\s*$') THEN regexp_extract(line, '^\s*(\d{1,2})[.)]\s+(.+?)\s*$', 2) ELSE regexp_extract(line, '^\s*([A-Z])[.)]\s+(.+?)\s*$', 2) END AS heading FROM line WHERE regexp_matches(line, '^\s*(\d{1,2})[.)]\s+(.+?)\s*$') OR regexp_matches(line, '^\s*([A-Z])[.)]\s+(.+?)\s*$')), "
    r"named AS (SELECT *, regexp_replace(lower(trim(heading)), '\s+', ' ', 'g') AS normalized_heading FROM head), "
    r"opened AS (SELECT doc_id, first_page AS page_number, -1 AS line_no, 1 AS number, NULL AS letter, 'Page ' || first_page AS heading, 'page ' || first_page AS normalized_heading FROM (SELECT doc_id, min(page_number) AS first_page FROM page GROUP BY 1) p LEFT JOIN (SELECT doc_id, min(page_number) AS first_headed FROM named GROUP BY 1) h USING (doc_id) WHERE first_headed IS NULL OR first_headed > first_page), "
    r"both_kinds AS (SELECT * FROM named UNION ALL SELECT * FROM opened), "
    r"marked AS (SELECT *, (line_no < 0 OR normalized_heading IS DISTINCT FROM last_value(CASE WHEN line_no >= 0 THEN normalized_heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::int AS new_one FROM both_kinds), "
    r"indexed AS (SELECT *, sum(new_one) OVER (PARTITION BY doc_id ORDER BY page_number, line_no)::bigint AS section_index FROM marked), "
    r"section AS (SELECT doc_id, section_index, arg_min(heading, (page_number, line_no)) AS heading, (list(number ORDER BY page_number, line_no))[1] AS number, (list(letter ORDER BY page_number, line_no))[1] AS letter, arg_min(normalized_heading, (page_number, line_no)) AS normalized_heading, min(page_number) AS page_start, max(page_number) AS page_end FROM indexed GROUP BY 1, 2), "
    r"known AS (SELECT doc_id || printf(':section:%03d:', section_index) || substr(sha1(regexp_replace(trim(lower(heading)), '\s+', ' ', 'g')), 1, 8) AS section_id, * FROM section) "
)
ORACLES |= {
    "d16_observations": _derived_sql("observation", OBSERVED), "d17_events": _derived_sql("event", EVENTS),
    "p_structure_sections": _SECTIONS + "SELECT section_id, doc_id, heading, number AS section_number, letter AS section_letter, normalized_heading, page_start, page_end, section_index FROM known",
    "j5_page_sections": _SECTIONS + "SELECT doc_id, page_id, section_id FROM page JOIN known USING (doc_id) WHERE page_number BETWEEN page_start AND page_end",
}

_link = lambda kinds: ", ".join(map(repr, kinds))
_first = "arg_min(entity_id, (length(paragraph_id), paragraph_id, start_offset, entity_id))"
def _targets_sql(near: str, pii: str, year: int, methods: str, more: str = "") -> str:
    """CTEs up to target: what the detectors find; more is a query of further targets."""
    return (
    _WITH.replace("WITH docs", "WITH RECURSIVE docs", 1).rstrip() + f", junk AS ({ORACLES['r3_junk']}), pii AS ({pii}), "
    "named AS (SELECT claim_id, entity_id, try_cast(substr(claim_date, 1, 4) AS int) AS year FROM edge JOIN claim USING (claim_id) WHERE entity_type = 'Person'), "
    f"recent AS (SELECT entity_id, max(year) AS last_year FROM named GROUP BY 1 HAVING max(year) >= {year - 100}), "
    f"near AS ({near}), "
    f"kind AS (SELECT run_id, paragraph_id, {_first} AS candidate FROM near WHERE entity_type = 'Species' GROUP BY 1, 2), close_by AS (SELECT run_id, paragraph_id, {_first} AS candidate FROM near WHERE entity_type <> 'Species' GROUP BY 1, 2), far_off AS (SELECT run_id, {_first} AS candidate FROM near WHERE entity_type <> 'Species' GROUP BY 1), "
    "target AS (SELECT issue_class, 'suppress_mention' AS proposal_type, 'mention' AS target_kind, target_id, group_key, confidence, reason FROM junk "
    "UNION ALL SELECT 'pii', 'quarantine_claim', 'claim', target_id, group_key, confidence, group_key FROM pii "
    "UNION ALL SELECT DISTINCT 'living_person', 'quarantine_claim', 'claim', claim_id, entity_id, 0.7::double, last_year::varchar FROM named JOIN recent USING (entity_id) "
    f"UNION ALL SELECT DISTINCT 'method_overtrigger', 'exclude_claim_from_derivation', 'claim', claim_id, claim_id || '|' || entity_id, 0.8::double, entity_id FROM ({methods}) JOIN claim USING (claim_id) WHERE claim_type IN ({_link(detectors.WITHOUT_METHOD)}) "
    f"UNION ALL SELECT 'missing_species_focus', 'add_claim_entity_link', 'claim', claim_id, claim_id || '|' || candidate, 0.65::double, candidate FROM claim JOIN kind USING (run_id, paragraph_id) WHERE claim_type IN ({_link(detectors.WITH_SPECIES)}) AND claim_id NOT IN (SELECT claim_id FROM edge WHERE relation_type = 'SPECIES_FOCUS') "
    f"UNION ALL SELECT 'missing_event_location', 'add_claim_location_link', 'claim', claim_id, claim_id || '|' || candidate, 0.6::double, candidate FROM (SELECT claim_id, coalesce(n.candidate, f.candidate) AS candidate FROM claim LEFT JOIN close_by n USING (run_id, paragraph_id) LEFT JOIN far_off f USING (run_id) WHERE claim_type IN ({_link(detectors.WITH_PLACE)}) AND claim_id NOT IN (SELECT claim_id FROM edge WHERE relation_type = 'OCCURRED_AT')) WHERE candidate IS NOT NULL{more}), "
    )


_NEAR = "SELECT run_id, paragraph_id, start_offset, entity_id, entity_type FROM mention JOIN entity ON lower(name) = normalized_form WHERE entity_type IN ('Species', 'Place', 'Refuge')"
_METHODS = "SELECT claim_id, entity_id FROM edge WHERE relation_type = 'METHOD_FOCUS'"
#: R7 to R9 over a CTE target.
_ROUTED = (
    "grouped AS (SELECT issue_class, proposal_type, target_kind, group_key, count(DISTINCT target_id) AS impact_size, max(confidence) AS confidence, min(target_id) AS first_target, min(reason) AS reason FROM target GROUP BY 1, 2, 3, 4), "
    "routed AS (SELECT 'proposal_' || substr(sha1('snapshot' || '||' || " + " || '||' || ".join(f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))" for c in ("issue_class", "proposal_type", "target_kind", "group_key")) + "), 1, 16) AS proposal_id, *, confidence >= 0.9 AND proposal_type = 'suppress_mention' AND reason IN ('ocr_garbage', 'short_generic_token') AS auto, "
    "round(least(1.0, CASE WHEN proposal_type IN ('merge_entities', 'create_alias') THEN 0.5 * confidence + 0.5 * least(1.0, impact_size / 5.0) WHEN issue_class IN ('missing_species_focus', 'missing_event_location') THEN 0.7 * confidence + 0.3 * least(1.0, impact_size / 10.0) + 0.1 WHEN issue_class IN ('header_contamination', 'boilerplate_contamination') THEN 0.4 * confidence + 0.2 * least(1.0, impact_size / 10.0) ELSE 0.7 * confidence + 0.3 * least(1.0, impact_size / 10.0) END), 6) AS priority_score FROM grouped), "
    "done AS (SELECT proposal_id, issue_class, proposal_type, target_kind, group_key, impact_size, confidence, first_target, reason, priority_score, CASE WHEN confidence < 0.5 THEN 'rejected' WHEN auto THEN 'accepted_pending_apply' ELSE 'queued' END AS status, CASE WHEN confidence < 0.5 THEN 'auto_suppressed' WHEN auto THEN 'auto_accepted' ELSE 'needs_review' END AS review_tier FROM routed) "
)
_EXACT = _targets_sql(_NEAR, ORACLES["r5_sensitive_texts"], THIS_YEAR, _METHODS) + _ROUTED
ORACLES |= {
    "r7_exact": _EXACT + "SELECT * FROM done", "t3_exact": _EXACT + "SELECT * FROM done WHERE status = 'queued' ORDER BY priority_score DESC, impact_size DESC, confidence DESC, proposal_id LIMIT 50 OFFSET 50",
    "g17_exact": _EXACT + "SELECT review_tier, issue_class, count(*) AS proposals, min(confidence) AS least, max(confidence) AS most, round(avg(confidence), 6) AS mean, array_to_string(list_slice(list(proposal_id ORDER BY priority_score DESC, proposal_id), 1, 5), '|') AS first FROM done GROUP BY 1, 2",
}

#: P4 to P6 as recursion: sentences packed into pieces up to the limit, then pieces joined until they are long enough.
_PARAGRAPHS = _SECTIONS + (
    r", chunked AS (SELECT doc_id, page_number, page_id, unnest(string_split_regex(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), '\n[\s\x0b]*\n+')) AS raw, generate_subscripts(string_split_regex(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), '\n[\s\x0b]*\n+'), 1) AS c FROM page), "
    r"chunk AS (SELECT * FROM (SELECT doc_id, page_number, page_id, c, regexp_replace(raw, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t FROM chunked) WHERE t <> '' AND NOT ((regexp_matches(t, '^\s*(\d{1,2})[.)]\s+(.+?)\s*$') OR regexp_matches(t, '^\s*([A-Z])[.)]\s+(.+?)\s*$')) AND NOT contains(t, chr(10)))), "
    r"long_one AS (SELECT doc_id, page_number, c, string_split(regexp_replace(t, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM chunk WHERE length(t) > 600), "
    r"packed AS (SELECT doc_id, page_number, c, ss, 1 AS i, 1 AS piece, ss[1] AS open FROM long_one UNION ALL SELECT doc_id, page_number, c, ss, i + 1, CASE WHEN open = '' OR length(open) + 1 + length(ss[i + 1]) <= 600 THEN piece ELSE piece + 1 END, CASE WHEN open = '' THEN ss[i + 1] WHEN length(open) + 1 + length(ss[i + 1]) <= 600 THEN open || ' ' || ss[i + 1] ELSE ss[i + 1] END FROM packed WHERE i < len(ss)), "
    r"piece AS (SELECT doc_id, page_number, c, piece, arg_max(open, i) AS t FROM packed GROUP BY 1, 2, 3, 4 HAVING arg_max(open, i) <> '' UNION ALL SELECT doc_id, page_number, c, 1, t FROM chunk WHERE length(t) <= 600), "
    r"listed AS (SELECT doc_id, page_number, list(t ORDER BY c, piece) AS ts FROM piece GROUP BY 1, 2), "
    r"joined AS (SELECT doc_id, page_number, ts, 1 AS i, 1 AS part, ts[1] AS grown FROM listed UNION ALL SELECT doc_id, page_number, ts, i + 1, CASE WHEN length(grown) >= 150 THEN part + 1 ELSE part END, CASE WHEN length(grown) >= 150 THEN ts[i + 1] ELSE grown || ' ' || ts[i + 1] END FROM joined WHERE i < len(ts)), "
    r"parts AS (SELECT doc_id, page_number, part, arg_max(grown, i) AS t FROM joined GROUP BY 1, 2, 3), "
    r"at_end AS (SELECT page.doc_id, page.page_number, page.page_id, arg_max(section_id, section_index) AS section_id FROM page LEFT JOIN known ON known.doc_id = page.doc_id AND known.page_start <= page.page_number GROUP BY 1, 2, 3), "
    r"numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, part)::int AS n FROM parts), "
    r"clean AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '\r\n', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> ''), chr(10)), '[ \t]+', ' ', 'g'), ' ') AS k FROM numbered) "
)
ORACLES["p_structure_paragraphs"] = _PARAGRAPHS.replace("WITH page AS", "WITH RECURSIVE page AS", 1) + "SELECT doc_id || printf(':paragraph:%05d:p%04d', n, page_number) AS paragraph_id, doc_id, page_id, section_id, n AS paragraph_index, page_number, t AS raw_ocr_text, k AS clean_text, length(k)::int AS char_count FROM clean JOIN at_end USING (doc_id, page_number)"

from fieldlore.plans import similar_sql  # noqa: E402

ORACLES |= {"d5_resolved": similar_sql.resolved(PREFERRED), "r1_entity_groups": similar_sql.entity_groups(detectors.SIMILAR), "r14_spelling": similar_sql.spelling()}
_folded = "replace(replace(replace(replace(lower(name), 'rn', 'm'), 'li', 'h'), '0', 'o'), '1', 'l')"
_GROUPS = (
    f" UNION ALL SELECT 'ocr_spelling_variant', CASE WHEN size = 2 AND folds = 2 THEN 'create_alias' ELSE 'merge_entities' END, 'entity', c.entity_id, anchor, round(coalesce(confidence, 1.0), 4), c.name FROM (SELECT entity_type, anchor, arg_max({{'entity_id': entity_id, 'name': name}}, (coalesce(n, 0), length(name), name)) AS c, count(*) AS size, avg(score) FILTER (score < 1) AS confidence, count(DISTINCT {_folded}) AS folds "
    f"FROM ({similar_sql.entity_groups(detectors.SIMILAR).replace('round(score, 6) AS score', 'score')}) JOIN (SELECT entity_id, name FROM entity) USING (entity_id) LEFT JOIN (SELECT entity_id, count(claim_id) AS n FROM edge GROUP BY 1) USING (entity_id) GROUP BY 1, 2)"
)
_FOUND_NEAR = f"SELECT run_id, paragraph_id, start_offset, r.entity_id, e.entity_type FROM ({ORACLES['d5_resolved']}) r JOIN mention USING (mention_id) JOIN (SELECT DISTINCT entity_id, entity_type FROM entity) e ON e.entity_id = r.entity_id WHERE e.entity_type IN ('Species', 'Place', 'Refuge')"


def _review_sql() -> str:
    """All detectors, with the year of today."""
    from fieldlore.plans.audits import ORACLES as links

    told = f"{_METHODS} UNION SELECT claim_id, 'surveymethod:' || normalized_form FROM ({links['x6_claim_links']}) WHERE relation_type = 'METHOD_FOCUS'"
    pii = ORACLES["r5_sensitive"]
    return _targets_sql(_FOUND_NEAR, pii, datetime.date.today().year, told, _GROUPS) + _ROUTED


_REVIEW = _review_sql()
ORACLES |= {name: _REVIEW + ORACLES[of].removeprefix(_EXACT) for name, of in (("r7_proposals", "r7_exact"), ("g17_tiers", "g17_exact"))}
ORACLES["t3_review_queue"] = _REVIEW + "SELECT * FROM done WHERE status = 'queued' ORDER BY priority_score DESC, impact_size DESC, confidence DESC, proposal_id LIMIT 50"

#: Lines that go on are joined, so all of them are; a mark before a capital ends a sentence, but not behind the period of
#: an abbreviation.
_short = "|".join(sorted(extraction.ABBREVIATIONS))
_SENTENCES = (
    _PARAGRAPHS.replace("WITH page AS", "WITH RECURSIVE page AS", 1)
    + r", whole AS (SELECT doc_id || printf(':paragraph:%05d:p%04d', n, page_number) AS paragraph_id, array_to_string(list_filter(list_transform(string_split(k, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS w FROM clean), "
    + rf"kept AS (SELECT paragraph_id, regexp_replace(w, '(?i)\b({_short})\.([.!?])(\s+)', '\1.\2' || chr(2), 'g') AS w FROM whole), "
    + r"cut_up AS (SELECT paragraph_id, list_filter(list_transform(string_split(regexp_replace(w, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(2), ' '))), lambda x: x <> '') AS ss FROM kept), "
    + r"sent AS (SELECT paragraph_id, generate_subscripts(ss, 1) - 1 AS position, unnest(ss) AS sentence FROM cut_up) "
)
_OF_SENTENCES = "(SELECT paragraph_id || '#' || position AS claim_id, sentence AS source_sentence FROM sent)"
ORACLES["x1_rule_claims"] = (
    _SENTENCES
    + "SELECT string_split(claim_id, '#')[1] AS paragraph_id, string_split(claim_id, '#')[2]::int AS position, claim_type, score, extraction_confidence, epistemic_status FROM ("
    + ORACLES["x2_classified"].replace(_C, _OF_SENTENCES)
    + ") JOIN ("
    + ORACLES["x12_validated"].replace(_C, _OF_SENTENCES)
    + ") USING (claim_id) WHERE reason IS NULL"
)

from fieldlore.plans import measure_sql  # noqa: E402

ORACLES["x14_measurements"] = measure_sql.measurements(f"(SELECT claim_id, claim_type, source_sentence AS sentence FROM {_C})")
