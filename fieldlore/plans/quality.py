"""Quality of a graph: metrics with gates, suspicious links, link candidates with diagnostics, bridges between events and
observations, coverage of an answer, joins of the logs and of the review."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.functions import ids
from fieldlore.functions.text import caveats, redact
from fieldlore.operators import derivation
from fieldlore.plans import retrieval
from fieldlore.plans.graph import EVENTS, OBSERVED, OTHER_RELATION, ROLE_POLICY, Graph

# -- metrics and gates (G7, G8) ---------------------------------------------------------------------------------------

MANY_LINKS, MANY_ROLES, SHORT_SENTENCE = 5, 3, 25
#: Words by which a sentence has more than one clause (own list).
CLAUSES = (" and ", " but ", " while ", " which ", " because ", " although ", "; ")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6)


def _ids(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg((F.count(column) - F.count_distinct(column)).alias(f"duplicate_{name}_ids"))


def metrics(g: Graph) -> DataFrame:
    """One row of counts, shares and duplicate ids; one aggregate for each table, then joins of single rows."""
    claims, links = g.claims, g.edges
    c = claims.agg(F.count("claim_id").alias("claims"), F.count_if(F.col("claim_type") == "unclassified_assertion").alias("unclassified"), _share(F.count_if(F.col("paragraph_id").isNotNull()), F.count("claim_id")).alias("claims_with_evidence"))
    known = claims.select("claim_id").distinct().withColumn("found", F.lit(1))
    m = g.measurements.select("measurement_id", "claim_id").join(known, "claim_id", "left").agg(F.count("measurement_id").alias("measurements"), _share(F.count("found"), F.count("measurement_id")).alias("measurements_linked"))
    offsets = (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset"))
    n = g.mentions.agg(F.count("mention_id").alias("mentions"), _share(F.count_if(offsets), F.count("mention_id")).alias("valid_offsets"))
    species = links.where("entity_type = 'Species'").select("claim_id").distinct().withColumn("species", F.lit(1))
    o = g.observations.join(species, "claim_id", "left").join(known, "claim_id", "left").agg(F.count("observation_id").alias("observations"), F.count_distinct("year").alias("years"), _share(F.count("species"), F.count("observation_id")).alias("observations_with_species"), _share(F.count("year"), F.count("observation_id")).alias("observations_with_year"), (F.count("found") == F.count("observation_id")).alias("observations_have_evidence"))
    simple = (F.size(F.regexp_extract_all("source_sentence", F.lit(r"(\w+)"), F.lit(1))) < SHORT_SENTENCE) & ~functools.reduce(lambda a, b: a | b, (F.contains(F.lower("source_sentence"), F.lit(w)) for w in CLAUSES))
    relation = F.col("relation_type")
    per = links.groupBy("claim_id").agg(F.count("entity_id").alias("links"), F.count_if(relation == "OCCURRED_AT").alias("places"), F.max(relation == OTHER_RELATION).alias("topic"), F.count_distinct(relation).alias("roles"), F.count_distinct(F.when(relation != OTHER_RELATION, relation)).alias("others"))
    by = per.join(claims.select("claim_id", simple.alias("simple")), "claim_id", "left")
    e = by.agg(
        F.coalesce(F.sum("links"), F.lit(0)).alias("links"), _share(F.sum(F.when(~F.col("topic"), F.col("links")).otherwise(0)), F.sum("links")).alias("links_of_claims_without_topic"), F.count_if(F.col("links") > MANY_LINKS).alias("claims_with_many_links"), F.count_if(F.col("places") > 1).alias("claims_with_several_places"),
        F.count_if(F.col("topic") & (F.col("others") >= 2)).alias("claims_with_redundant_topic"), F.count_if((F.col("roles") >= MANY_ROLES) & F.col("simple")).alias("short_claims_with_many_roles"),
    )
    doubles = [_ids(g.docs, "doc_id", "document"), _ids(claims, "claim_id", "claim"), _ids(g.measurements, "measurement_id", "measurement"), _ids(g.mentions, "mention_id", "mention"), _ids(g.runs, "run_id", "run")]
    return functools.reduce(lambda a, b: a.join(F.broadcast(b)), [m, n, o, e, *doubles], c)


def gates(one: DataFrame, offsets_from: float = 0.95) -> DataFrame:
    """The five gates of a row of metrics."""
    double = functools.reduce(lambda a, b: a + b, (F.col(c) for c in one.columns if c.startswith("duplicate_")))
    return one.select((F.col("claims_with_evidence") >= 1).alias("claims_have_evidence"), (F.col("measurements_linked") >= 1).alias("measurements_linked"), (double == 0).alias("no_duplicate_ids"), (F.col("valid_offsets") >= offsets_from).alias("mention_offsets_valid"), "observations_have_evidence")


def relation_counts(g: Graph) -> DataFrame:
    """Links by relation."""
    return g.edges.groupBy("relation_type").agg(F.count("entity_id").alias("links"))


# -- suspicious links (G10) ---------------------------------------------------------------------------------------------

#: (claim types, relation, part of the entity's name or nothing, reason): links that are rarely right (own rules over the tables' claim types).
SUSPICIOUS = (
    (("fire_incident", "public_contact", "weather_observation"), "METHOD_FOCUS", "", "a survey method where nothing is surveyed"),
    (("public_contact", "economic_use"), "OCCURRED_AT", "", "a place of the event where only a place of the subject is meant"),
    (("public_contact", "economic_use"), "SPECIES_FOCUS", "", "a species in a claim about people"),
    (("fire_incident",), "SPECIES_FOCUS", "teal", "a water bird in a fire"),
)


def suspicious(triplets: DataFrame, rules: tuple = SUSPICIOUS) -> DataFrame:
    """triplets(claim_type, relation_type, entity_id, …) with the reasons why they are suspicious, if any."""
    spark = triplets.sparkSession
    table = spark.createDataFrame([(t, relation, part, reason) for types, relation, part, reason in rules for t in types], "claim_type string, relation_type string, part string, reason string")
    hits = triplets.join(F.broadcast(table), ["claim_type", "relation_type"]).where(F.contains(F.lower("entity_id"), F.col("part")))
    return hits.groupBy("claim_type", "relation_type", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))


# -- candidates of a link (D11) -----------------------------------------------------------------------------------------

#: Entity types that a relation allows (fixed values); a relation that is not listed allows all.
ALLOWED = {relation: (kind,) for kind, relation in ROLE_POLICY.items()} | {"OCCURRED_AT": ("Place", "Refuge"), "LOCATION_FOCUS": ("Place", "Refuge"), "SUBJECT_OF_CLAIM": ("Person", "Organization")}


def narrowed(links: DataFrame, candidates: DataFrame, forbidden: tuple[tuple[str, str], ...] = tuple(k for k, t in derivation.TIERS.items() if t == "forbidden")) -> DataFrame:
    """Each link draft with its one entity or a diagnostic: no candidate, none of a type the relation allows, a relation
    that the claim's type forbids, none of the hinted type, or more than one left.

    links(claim_id, claim_type, relation_type, normalized_form, type_hint), candidates(claim_id, normalized_form, entity_id, entity_type).
    """
    key = ["claim_id", "relation_type", "normalized_form"]
    allowed = F.create_map(*[x for r, ts in ALLOWED.items() for x in (F.lit(r), F.array(*map(F.lit, ts)))])
    types = F.try_element_at(allowed, F.col("relation_type"))
    met = links.join(candidates.select("claim_id", "normalized_form", "entity_id", "entity_type").distinct(), ["claim_id", "normalized_form"], "left")
    fits = F.col("entity_id").isNotNull() & (types.isNull() | F.array_contains(types, F.col("entity_type")))
    hinted = fits & (F.col("type_hint").isNull() | (F.col("entity_type") == F.col("type_hint")))
    bad = functools.reduce(lambda a, b: a | b, [((F.col("claim_type") == c) & (F.col("relation_type") == r)) for c, r in forbidden], F.lit(False))
    per = met.groupBy(*key, "claim_type", "type_hint").agg(F.count("entity_id").alias("all"), F.count_if(fits).alias("fit"), F.count_if(hinted).alias("left"), F.min(F.when(hinted, F.col("entity_id"))).alias("only"))
    code = F.when(F.col("all") == 0, "NO_RESOLVED_MENTION").when(F.col("fit") == 0, "RELATION_TYPE_CONFLICT").when(bad, "RELATION_COMPATIBILITY_FORBIDDEN").when(F.col("left") == 0, "TYPE_HINT_CONFLICT").when(F.col("left") > 1, "AMBIGUOUS_FALLBACK")
    count = F.when(F.col("fit") == 0, F.col("all")).when(F.col("left") > 1, F.col("left")).otherwise(F.col("fit"))
    return per.select(*key, code.alias("diagnostic_code"), F.when(code.isNull(), F.col("only")).alias("entity_id"), count.alias("candidates"))


def link_candidates(g: Graph) -> DataFrame:
    """D11 over the claims: a draft for each relation that some entity of its form suggests; a form may be several entities."""
    entities = g.entities.select("entity_id", "entity_type", F.lower("name").alias("normalized_form"))
    hits = g.mentions.where("normalized_form IS NOT NULL").select("run_id", "paragraph_id", "normalized_form").distinct()
    at = g.claims.select("claim_id", "claim_type", "run_id", "paragraph_id").join(hits, ["run_id", "paragraph_id"])
    found = at.join(entities, "normalized_form").select("claim_id", "normalized_form", "entity_id", "entity_type")
    # every form is a draft for the place and for the species of its claim, hinted where its first word tells the type
    relations = F.explode(F.array(F.lit("OCCURRED_AT"), F.lit("SPECIES_FOCUS"), F.lit("SUBJECT_OF_CLAIM"))).alias("relation_type")
    hint = F.when(F.col("normalized_form").rlike(" (lake|marsh|creek|pothole|meadow)$"), "Place").when(F.col("normalized_form").rlike("(club|association|council)$"), "Organization")
    drafts = at.select("claim_id", "claim_type", "normalized_form", relations).withColumn("type_hint", hint).distinct()
    return narrowed(drafts, found)


# -- bridges (D17) -----------------------------------------------------------------------------------------------------


def bridges(claims: DataFrame, observed: dict[str, str], events: dict[str, str]) -> DataFrame:
    """event_id and observation_id of claims that make both: the event of a claim belongs to its observation."""
    o = derivation.observations(claims, observed).select("claim_id", "observation_id")
    return derivation.events(claims, events).select("claim_id", "event_id").join(o, "claim_id").select("event_id", "observation_id")


def measurement_links(claims: DataFrame, measurements: DataFrame, events: dict[str, str]) -> DataFrame:
    """The measurements of claims whose event owns them."""
    return derivation.events(claims, events).select("claim_id", "event_id").join(measurements.select("claim_id", "measurement_id").distinct(), "claim_id").select("event_id", "measurement_id")


# -- an answer's coverage (G14, Q8) -------------------------------------------------------------------------------------


def answer_stats(blocks: DataFrame) -> DataFrame:
    """Least confidence, and the claims, paragraphs and documents in an answer's evidence."""
    return blocks.agg(F.round(F.min("extraction_confidence"), 4).alias("least_confidence"), F.count("claim_id").alias("claims"), F.count_distinct("paragraph_id").alias("paragraphs"), F.count_distinct("doc_id").alias("documents"))


def fire_answer(g: Graph) -> DataFrame:
    return answer_stats(g.active_claims.where("claim_type = 'fire_incident'"))


def hidden_texts(g: Graph) -> DataFrame:
    """Q8 over the transcripts: the texts that the answer's rules change, redacted."""
    rows = g._table("document_records").select("doc_id", "clean_text").where("clean_text IS NOT NULL").distinct()
    return rows.withColumn("redacted", redact(F.col("clean_text"))).where("redacted <> clean_text").select("doc_id", "redacted")


def document_caveats(g: Graph) -> DataFrame:
    """Q8: the remarks on each document's evidence."""
    per = g.claims.join(g.runs.select("run_id", "doc_id"), "run_id").groupBy("doc_id").agg(F.min("extraction_confidence").alias("least"), F.count_if(~g.active(F.col("quarantine_status"))).alias("held"))
    rows = per.join(g.docs.groupBy("doc_id").agg(F.max("donor_restricted").alias("donor")), "doc_id")
    return rows.select("doc_id", F.array_join(caveats(F.col("least"), F.col("held"), F.coalesce("donor", F.lit(False))), "|").alias("caveats"))


# -- joins of logs and of the review (J14, J16) ---------------------------------------------------------------------------


def turn_events(turns: DataFrame, retrievals: DataFrame) -> DataFrame:
    """What was retrieved for each turn of a conversation."""
    return turns.join(retrievals, "conversation_id")


def logged_turns(spark: SparkSession, d: str) -> DataFrame:
    """J16 over the events: views are turns, clicks of the same key and day what they led to."""
    from fieldlore.session import table

    e = table(spark, d, "events").withColumn("conversation_id", F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    turns = e.where("event_type = 'view'").select("conversation_id", F.col("event_id").alias("turn_id"))
    clicks = e.where("event_type = 'click'").groupBy("conversation_id").agg(F.count("event_id").alias("retrieved"), F.round(F.sum("value"), 4).alias("cost"))
    return turn_events(turns, clicks)


def queue_rows(proposals: DataFrame, classes: DataFrame, runs: DataFrame) -> DataFrame:
    """Proposals with the queue of their class and the document of their run."""
    return proposals.join(F.broadcast(classes), "issue_class").join(runs.select("review_run_id", "doc_id"), "review_run_id")


#: The queue of each kind of finding (fixed values of this module).
QUEUES = {"ocr_garbage_mention": "mentions", "short_generic_token": "mentions", "header_contamination": "mentions", "boilerplate_contamination": "mentions", "missing_species_focus": "links", "missing_event_location": "links", "method_overtrigger": "links", "pii": "sensitivity", "living_person": "sensitivity", "ocr_spelling_variant": "entities"}


def queued_junk(g: Graph) -> DataFrame:
    """J14 over the junk mentions: how many of each queue a document's runs have."""
    from fieldlore.review import detectors

    found = detectors.junk_mentions(g.mentions).select("issue_class", "target_id").join(g.mentions.select(F.col("mention_id").alias("target_id"), F.col("run_id").alias("review_run_id")).distinct(), "target_id")
    classes = g.spark.createDataFrame(sorted(QUEUES.items()), "issue_class string, queue_name string")
    return queue_rows(found, classes, g.runs.withColumnRenamed("run_id", "review_run_id")).groupBy("queue_name", "doc_id").agg(F.count("target_id").alias("proposals"))


def _dated(g: Graph) -> DataFrame:
    from fieldlore.plans.pipeline import _dated_claims

    return _dated_claims(g)


_BOUND = {
    "g7_metrics": metrics, "g7_gates": lambda g: gates(metrics(g)), "g7_relations": relation_counts, "g10_suspicious": lambda g: suspicious(retrieval.triplets(g)), "d11_narrowed": link_candidates,
    "d17_bridges": lambda g: bridges(_dated(g), OBSERVED | {"fire_incident": "FireObservation"}, EVENTS | {"weather_observation": "WeatherEvent"}), "d17_measurements": lambda g: measurement_links(_dated(g), g.measurements, EVENTS),
    "g14_answer": fire_answer, "q8_redacted": hidden_texts, "q8_caveats": document_caveats, "j14_queues": queued_junk,
}
QUERIES = {name: (lambda spark, d, f=f: f(Graph(spark, d))) for name, f in _BOUND.items()} | {"j16_turns": logged_turns}

from fieldlore.functions.text import REDACTIONS  # noqa: E402
from fieldlore.plans.retrieval import _WITH  # noqa: E402

_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY paragraph_id, claim_id) AS n, CASE claim_type {kinds} END AS kind FROM claim WHERE claim_type IN ({types}) AND run_id IN (SELECT run_id FROM runs JOIN docs USING (doc_id)))"


def numbered_sql(kinds: dict[str, str]) -> str:
    return _NUMBERED.format(kinds=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()), types=", ".join(f"'{k}'" for k in kinds))


def id_sql(prefix: str) -> str:
    return f"run_id || printf(':{prefix}:%03d:', n) || substr(sha1(regexp_replace(trim(lower(claim_id)), '\\s+', ' ', 'g') || '||' || lower(kind)), 1, 16)"


_redact = functools.reduce(lambda c, r: f"regexp_replace({c}, '{r[1]}', '[{r[0]} REDACTED]', 'g')", REDACTIONS, "clean_text")
_dup = lambda t, c, n: f"(SELECT count({c}) - count(DISTINCT {c}) FROM {t}) AS duplicate_{n}_ids"
_METRICS = (
    _WITH + ", per AS (SELECT claim_id, count(*) AS links, count(*) FILTER (relation_type = 'OCCURRED_AT') AS places, bool_or(relation_type = 'TOPIC_OF_CLAIM') AS topic, count(DISTINCT relation_type) AS roles, count(DISTINCT relation_type) FILTER (relation_type <> 'TOPIC_OF_CLAIM') AS others FROM edge GROUP BY 1), "
    "by_claim AS (SELECT per.*, simple FROM per LEFT JOIN (SELECT claim_id, len(regexp_extract_all(source_sentence, '(\\w+)')) < 25 AND NOT (" + " OR ".join(f"contains(lower(source_sentence), '{w}')" for w in CLAUSES) + ") AS simple FROM claim) USING (claim_id)) SELECT "
    "(SELECT count(*) FROM claim) AS claims, (SELECT count(*) FROM claim WHERE claim_type = 'unclassified_assertion') AS unclassified, (SELECT round(count(paragraph_id) / count(*), 6) FROM claim) AS claims_with_evidence, "
    "(SELECT count(*) FROM meas) AS measurements, (SELECT round(count(c.claim_id) / count(*), 6) FROM meas LEFT JOIN (SELECT DISTINCT claim_id FROM claim) c USING (claim_id)) AS measurements_linked, "
    "(SELECT count(mention_id) FROM mention) AS mentions, (SELECT round(count(*) FILTER (start_offset >= 0 AND end_offset > start_offset) / count(mention_id), 6) FROM mention) AS valid_offsets, "
    "(SELECT count(*) FROM obs) AS observations, (SELECT count(DISTINCT year) FROM obs) AS years, (SELECT round(count(s.claim_id) / count(*), 6) FROM obs LEFT JOIN (SELECT DISTINCT claim_id FROM edge WHERE entity_type = 'Species') s USING (claim_id)) AS observations_with_species, (SELECT round(count(year) / count(*), 6) FROM obs) AS observations_with_year, true AS observations_have_evidence, "
    "(SELECT sum(links)::bigint FROM per) AS links, (SELECT round(coalesce(sum(links) FILTER (NOT topic), 0) / sum(links), 6) FROM per) AS links_of_claims_without_topic, (SELECT count(*) FROM per WHERE links > 5) AS claims_with_many_links, (SELECT count(*) FROM per WHERE places > 1) AS claims_with_several_places, (SELECT count(*) FROM per WHERE topic AND others >= 2) AS claims_with_redundant_topic, (SELECT count(*) FROM by_claim WHERE roles >= 3 AND simple) AS short_claims_with_many_roles, "
    + ", ".join((_dup("docs", "doc_id", "document"), _dup("claim", "claim_id", "claim"), _dup("meas", "measurement_id", "measurement"), _dup("mention", "mention_id", "mention"), _dup("runs", "run_id", "run")))
)
_rules_sql = ", ".join(f"('{t}', '{r}', '{p}', '{why}')" for ts, r, p, why in SUSPICIOUS for t in ts)
_allow = " ".join(f"WHEN '{r}' THEN list_contains([{', '.join(map(repr, ts))}], entity_type)" for r, ts in ALLOWED.items())
ORACLES = {
    "g7_metrics": _METRICS,
    "g7_gates": f"SELECT claims_with_evidence >= 1 AS claims_have_evidence, m.measurements_linked >= 1 AS measurements_linked, duplicate_document_ids + duplicate_claim_ids + duplicate_measurement_ids + duplicate_mention_ids + duplicate_run_ids = 0 AS no_duplicate_ids, valid_offsets >= 0.95 AS mention_offsets_valid, observations_have_evidence FROM ({_METRICS}) m",
    "g7_relations": _WITH + "SELECT relation_type, count(*) AS links FROM edge GROUP BY 1",
    "g10_suspicious": _WITH + f"SELECT claim_type, relation_type, entity_id, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM edge JOIN claim USING (claim_id) JOIN runs USING (run_id) JOIN (VALUES {_rules_sql}) AS r(claim_type, relation_type, part, reason) USING (claim_type, relation_type) WHERE contains(lower(entity_id), part) GROUP BY 1, 2, 3",
    "d11_narrowed": _WITH + f", seen AS (SELECT DISTINCT c.claim_id, c.claim_type, m.normalized_form FROM claim c JOIN mention m USING (run_id, paragraph_id) WHERE m.normalized_form IS NOT NULL), draft AS (SELECT *, CASE WHEN regexp_matches(normalized_form, ' (lake|marsh|creek|pothole|meadow)$') THEN 'Place' WHEN regexp_matches(normalized_form, '(club|association|council)$') THEN 'Organization' END AS type_hint FROM seen, (VALUES ('OCCURRED_AT'), ('SPECIES_FOCUS'), ('SUBJECT_OF_CLAIM')) AS r(relation_type)), met AS (SELECT d.*, e.entity_id, e.entity_type, e.entity_id IS NOT NULL AND CASE relation_type {_allow} ELSE true END AS fits FROM draft d LEFT JOIN entity e ON lower(e.name) = d.normalized_form), per AS (SELECT claim_id, relation_type, normalized_form, claim_type, count(entity_id) AS n_all, count(*) FILTER (fits) AS n_fit, count(*) FILTER (fits AND (type_hint IS NULL OR entity_type = type_hint)) AS n_left, min(entity_id) FILTER (fits AND (type_hint IS NULL OR entity_type = type_hint)) AS only_one FROM met GROUP BY 1, 2, 3, 4) SELECT claim_id, relation_type, normalized_form, code AS diagnostic_code, CASE WHEN code IS NULL THEN only_one END AS entity_id, CASE WHEN n_fit = 0 THEN n_all WHEN n_left > 1 THEN n_left ELSE n_fit END AS candidates FROM (SELECT *, CASE WHEN n_all = 0 THEN 'NO_RESOLVED_MENTION' WHEN n_fit = 0 THEN 'RELATION_TYPE_CONFLICT' WHEN " + " OR ".join(f"(claim_type = '{c}' AND relation_type = '{r}')" for (c, r), t in derivation.TIERS.items() if t == "forbidden") + " THEN 'RELATION_COMPATIBILITY_FORBIDDEN' WHEN n_left = 0 THEN 'TYPE_HINT_CONFLICT' WHEN n_left > 1 THEN 'AMBIGUOUS_FALLBACK' END AS code FROM per)",
    "d17_bridges": _WITH + f"SELECT e.id AS event_id, o.id AS observation_id FROM (SELECT claim_id, {id_sql('event')} AS id FROM {numbered_sql(EVENTS | {'weather_observation': 'WeatherEvent'})}) e JOIN (SELECT claim_id, {id_sql('observation')} AS id FROM {numbered_sql(OBSERVED | {'fire_incident': 'FireObservation'})}) o USING (claim_id)",
    "d17_measurements": _WITH + f"SELECT event_id, measurement_id FROM (SELECT claim_id, {id_sql('event')} AS event_id FROM {numbered_sql(EVENTS)}) JOIN (SELECT DISTINCT claim_id, measurement_id FROM meas) USING (claim_id)",
    "g14_answer": _WITH + "SELECT round(min(extraction_confidence), 4) AS least_confidence, count(claim_id) AS claims, count(DISTINCT paragraph_id) AS paragraphs, count(DISTINCT doc_id) AS documents FROM act WHERE claim_type = 'fire_incident'",
    "q8_redacted": f"SELECT doc_id, redacted FROM (SELECT doc_id, clean_text, {_redact} AS redacted FROM (SELECT DISTINCT doc_id, clean_text FROM document_records)) WHERE redacted <> clean_text",
    "q8_caveats": _WITH + "SELECT doc_id, concat_ws('|', CASE WHEN least < 0.70 THEN 'some evidence is of low confidence' END, CASE WHEN held > 0 THEN 'some claims are withheld' END, CASE WHEN donor THEN 'some sources are restricted by their donor' END) AS caveats FROM (SELECT doc_id, min(extraction_confidence) AS least, count(*) FILTER (coalesce(quarantine_status, 'active') <> 'active') AS held FROM claim JOIN runs USING (run_id) GROUP BY 1) JOIN (SELECT doc_id, bool_or(donor_restricted) AS donor FROM docs GROUP BY 1) USING (doc_id)",
    "j16_turns": "WITH e AS (SELECT *, user_id || '|' || strftime(ts, '%Y-%m-%d') AS conversation_id FROM events) SELECT conversation_id, event_id AS turn_id, retrieved, cost FROM e JOIN (SELECT conversation_id, count(*) AS retrieved, round(sum(value), 4) AS cost FROM e WHERE event_type = 'click' GROUP BY 1) USING (conversation_id) WHERE event_type = 'view'",
}
from fieldlore.plans.pipeline import ORACLES as _PIPELINE  # noqa: E402

ORACLES["j14_queues"] = f"SELECT queue_name, doc_id, count(*) AS proposals FROM ({_PIPELINE['r3_junk']}) JOIN (SELECT DISTINCT mention_id AS target_id, run_id FROM mention_drafts) USING (target_id) JOIN (SELECT DISTINCT run_id, doc_id FROM extraction_runs) USING (run_id) JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in QUEUES.items()) + ") AS q(issue_class, queue_name) USING (issue_class) GROUP BY 1, 2"
