"""Observations, events, years, concepts and links that follow from claims."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlore.functions import ids

YEAR = r"\b(1[89]\d{2}|20[0-2]\d)\b"
#: (concept, claim types, pattern, confidence)
CONCEPTS = (
    ("drought", ("weather_observation", "economic_use"), r"\b(dry|drought|dried)\b", 0.8), ("fire_damage", ("fire_incident",), r"\b(burned|went up in smoke|took)\b", 0.85), ("haying_program", ("economic_use",), r"\bhay\b", 0.9),
    ("fence_work", ("economic_use", "general_observation"), r"\bfence\b", 0.75), ("bird_numbers", ("population_estimate",), r"\b(counted|there were|taken)\b", 0.8),
)


def year_of(claim_date: Column, report_year: Column) -> tuple[Column, Column]:
    """The year and where it comes from."""
    own = F.regexp_extract(F.coalesce(claim_date, F.lit("")), YEAR, 1)
    year = F.when(own != "", own.cast("int")).otherwise(report_year)
    return year, F.when(own != "", "claim_date").when(report_year.isNotNull(), "document_primary_year").otherwise("unknown")


def plausible(rows: DataFrame, tolerance: int = 5, exclude: bool = False) -> DataFrame:
    """Rows with year and year_source checked against the span of their document (date_start, date_end, report_year)."""
    bound = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.nullif(F.regexp_extract(c, YEAR, 1), F.lit("")).cast("int")).otherwise(F.col("report_year"))
    low, high = bound("date_start"), bound("date_end")
    inside = F.col("year").between(F.coalesce(low, high) - tolerance, F.coalesce(high, low) + tolerance)
    bad = F.coalesce(low, high).isNotNull() & F.col("year").isNotNull() & ~inside
    if exclude:
        return rows.withColumn("year_source", F.when(bad, "unknown").otherwise(F.col("year_source"))).withColumn("year", F.when(~F.coalesce(bad, F.lit(False)), F.col("year")))
    return rows.withColumn("year_source", F.when(bad, "suspect").otherwise(F.col("year_source")))


def roles(claims: DataFrame, links: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """claim_id with the first entity of each role, the place, and the required roles it lacks.

    links(claim_id, link_order, entity_id, entity_type, relation_type).
    """
    first = links.groupBy("claim_id", "entity_type").agg(F.min_by("entity_id", F.struct("link_order", "entity_id")).alias("entity_id"))
    by = first.groupBy("claim_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "entity_id")))).alias("role_entities"))
    place = links.where("relation_type = 'OCCURRED_AT'").groupBy("claim_id").agg(F.min_by("entity_id", F.struct(F.when(F.col("entity_type") == "Place", 0).otherwise(1), "link_order", "entity_id")).alias("place_id"))
    need = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if required else F.create_map(F.lit(""), F.array().cast("array<string>"))
    have = F.coalesce(F.map_keys("role_entities"), F.array().cast("array<string>"))
    return claims.join(by, "claim_id", "left").join(place, "claim_id", "left").withColumn("missing", F.array_except(F.coalesce(F.try_element_at(need, F.col("claim_type")), F.array().cast("array<string>")), have)).select("claim_id", "role_entities", "place_id", "missing")


def observations(claims: DataFrame, kinds: dict[str, str], id_of=ids.observation_id, prefix: str = "observation") -> DataFrame:
    """D16, and with other kinds D17: one per claim of a registered type, numbered within its run."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("claim_type"))
    rows = claims.where(F.col("claim_type").isin(list(kinds))).withColumn("kind", kind)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("paragraph_id", "claim_id")))
    return rows.select(id_of("run_id", "claim_id", "n", "kind").alias(f"{prefix}_id"), "run_id", "claim_id", "paragraph_id", F.col("kind").alias(f"{prefix}_type"), "year", "year_source", F.col("extraction_confidence").alias("confidence"), (F.col("epistemic_status") == "uncertain").alias("is_estimate"))


def events(claims: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return observations(claims, kinds, ids.event_id, "event")


def document_years(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Years of documents and of their claims, once each."""
    rows = docs.select("doc_id", F.col("report_year").alias("year")).union(claims.select("doc_id", "year"))
    return rows.where("year IS NOT NULL").distinct().select("doc_id", "year", ids.year_id("year").alias("year_id"))


def concepts(claims: DataFrame, rules=CONCEPTS, text: str = "source_sentence") -> DataFrame:
    """claim_id, concept_id, confidence, matched_rule for every rule that fits; rules are an array of the row."""
    table = F.array(*[F.struct(F.lit(c).alias("concept_id"), F.array(*map(F.lit, ts)).alias("types"), F.lit(p).alias("pattern"), F.lit(conf).alias("confidence"), F.col(text).rlike("(?i)" + p).alias("hit")) for c, ts, p, conf in rules])
    hits = claims.select("claim_id", "claim_type", F.explode(F.filter(table, lambda r: r["hit"])).alias("r")).where(F.array_contains("r.types", F.col("claim_type")))
    return hits.select("claim_id", "r.concept_id", "r.confidence", F.substring("r.pattern", 1, 60).alias("matched_rule"))


#: How well a relation goes with a claim type; pairs that are not listed are weak.
TIERS = {
    ("population_estimate", "SPECIES_FOCUS"): "strong", ("population_estimate", "OCCURRED_AT"): "strong", ("fire_incident", "OCCURRED_AT"): "strong", ("weather_observation", "OCCURRED_AT"): "strong", ("economic_use", "OCCURRED_AT"): "strong", ("economic_use", "ORGANIZATION_FOCUS"): "strong",
    ("fire_incident", "SPECIES_FOCUS"): "forbidden", ("weather_observation", "ORGANIZATION_FOCUS"): "forbidden",
}


def tiered(links: DataFrame) -> DataFrame:
    """links with their tier; forbidden ones carry a diagnostic instead of an edge."""
    table = F.create_map(*[x for (c, r), t in TIERS.items() for x in (F.lit(f"{c}|{r}"), F.lit(t))])
    tier = F.coalesce(F.try_element_at(table, F.concat_ws("|", "claim_type", "relation_type")), F.lit("weak"))
    return links.withColumn("tier", tier).withColumn("diagnostic_code", F.when(tier == "forbidden", "RELATION_COMPATIBILITY_FORBIDDEN").when(tier == "weak", "RELATION_COMPATIBILITY_WEAK"))


#: Claim types of older rules and their names now; types, relations and entity types that are known (values of the tables).
RENAMES = {"population_count": "population_estimate", "burn": "fire_incident", "weather": "weather_observation"}
UNCLASSIFIED = "unclassified_assertion"


def contracted(rows: DataFrame, claim_types: tuple[str, ...], relations: tuple[str, ...], entity_types: tuple[str, ...], fallback: str = "TOPIC_OF_CLAIM", renames: dict[str, str] = RENAMES) -> DataFrame:
    """links(claim_type, relation_type, entity_type, …) as the contract allows them: older claim types under their new
    name, unknown ones unclassified, unknown relations as the fallback, links to entity types that are not allowed left out."""
    new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]), F.col("claim_type")), F.col("claim_type"))
    claim_type = F.when(new.isin(*claim_types), new).otherwise(UNCLASSIFIED)
    relation = F.when(F.col("relation_type").isin(*relations), F.col("relation_type")).otherwise(fallback)
    return rows.where(F.col("entity_type").isin(*entity_types)).withColumn("claim_type", claim_type).withColumn("relation_type", relation)


def penalised(claims: DataFrame, links: DataFrame) -> DataFrame:
    """A tenth off the confidence for every weak link, not below zero."""
    weak = links.where("tier = 'weak'").groupBy("claim_id").agg(F.count("entity_id").alias("weak"))
    return claims.join(weak, "claim_id", "left").withColumn("extraction_confidence", F.round(F.greatest(F.lit(0.0), F.col("extraction_confidence") - 0.1 * F.coalesce("weak", F.lit(0))), 4)).drop("weak")


def cascade(links: DataFrame, found: DataFrame) -> DataFrame:
    """For each link draft the entity of the nearest tier that has exactly one.

    links(claim_id, start_offset, end_offset, normalized_form, type_hint, evidence_start, evidence_end, paragraph_id) and
    found(paragraph_id, start_offset, end_offset, normalized_form, entity_id, entity_type): resolved mentions.
    Tiers: the same span, the same form, the claim's span, the paragraph.
    """
    l, m = links.alias("l"), found.alias("m")
    same_span = (F.col("l.start_offset") == F.col("m.start_offset")) & (F.col("l.end_offset") == F.col("m.end_offset"))
    same_form = F.col("l.normalized_form") == F.col("m.normalized_form")
    inside = (F.col("m.start_offset") >= F.col("l.evidence_start")) & (F.col("m.end_offset") <= F.col("l.evidence_end"))
    key = ["claim_id", "start_offset", "end_offset", "normalized_form"]
    met = l.join(m, F.col("l.paragraph_id") == F.col("m.paragraph_id"), "left").select(*[F.col(f"l.{c}") for c in [*key, "type_hint"]], F.col("m.entity_id"), F.col("m.entity_type"), F.when(same_span, 1).when(same_form, 2).when(inside, 3).otherwise(4).alias("tier"))
    fits = met.where(F.col("entity_id").isNull() | F.col("type_hint").isNull() | (F.col("entity_type") == F.col("type_hint")))
    per = fits.groupBy(*key, "tier").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    nearest = per.where("n > 0").groupBy(*key).agg(F.min_by(F.struct("n", "entity_id", "tier"), "tier").alias("at"))
    drafts = links.select(*key).distinct().join(nearest, key, "left")
    code = F.when(F.col("at").isNull(), "NO_RESOLVED_MENTION").when(F.col("at.n") > 1, "AMBIGUOUS_FALLBACK")
    return drafts.select(*key, F.when(code.isNull(), F.col("at.entity_id")).alias("entity_id"), F.col("at.tier").alias("tier"), code.alias("diagnostic_code"))


def hierarchy(entities: DataFrame, parent: Column, relation: str = "PART_OF") -> DataFrame:
    """D19."""
    return entities.select(F.col("entity_id").alias("child_entity_id"), parent.alias("parent_entity_id"), F.lit(relation).alias("relation_type")).where("parent_entity_id IS NOT NULL AND child_entity_id <> parent_entity_id")


def gated(claims: DataFrame, detect, threshold: float = 0.85) -> DataFrame:
    """Claims with those quarantined that a detector rates at or above the threshold; if it fails, all of them.

    The detector's result is written before it is used, so that a failure shows here and not later.
    """
    from fieldlore.session import cut

    try:
        rated = cut(detect(claims).groupBy("claim_id").agg(F.max("confidence").alias("confidence")))
    except Exception as e:
        logging.getLogger(__name__).warning("the gate failed, all claims are quarantined: %s", e)
        return claims.withColumn("quarantine_status", F.lit("quarantined")).withColumn("quarantine_reason", F.lit("gate_error"))
    hit = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return claims.join(rated, "claim_id", "left").withColumn("quarantine_status", F.when(hit, "quarantined").otherwise(F.col("quarantine_status"))).withColumn("quarantine_reason", F.when(hit, "sensitivity")).drop("confidence")
