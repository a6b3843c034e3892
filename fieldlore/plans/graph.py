"""The property graph as node and edge tables, and the sub-plans that every query shares.

Nodes: documents, runs, claims, measurements, mentions, entities. Edges from claims to entities come from the mentions
of the claim's paragraph and run whose normalized form is the entity's name. Access, deletion and quarantine are
checked in ``visible_docs`` and ``active`` only, so that no query can forget them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlore.session import small_or_plain, table

#: Relation of a claim to an entity by the entity's type; types without an entry have the last.
ROLE_POLICY = {"Species": "SPECIES_FOCUS", "Place": "OCCURRED_AT", "Person": "SUBJECT_OF_CLAIM", "Organization": "ORGANIZATION_FOCUS", "Habitat": "HABITAT_FOCUS", "SurveyMethod": "METHOD_FOCUS", "Refuge": "MANAGEMENT_TARGET"}
OTHER_RELATION = "TOPIC_OF_CLAIM"
#: Claim types that make an observation, and those that make an event.
OBSERVED = {"population_estimate": "PopulationObservation", "weather_observation": "WeatherObservation", "economic_use": "EconomicObservation"}
EVENTS = {"fire_incident": "FireEvent"}
LEVELS_OF_ROLE = {"reader": ("public",), "staff": ("public", "staff_only"), "archivist": ("public", "staff_only", "restricted"), "admin": ("public", "staff_only", "restricted", "indigenous_restricted")}


@dataclass(frozen=True)
class Access:
    institutions: tuple[str, ...] = ("inst_kessock", "inst_tamarn")
    levels: tuple[str, ...] = LEVELS_OF_ROLE["staff"]


def distinct_rows(df: DataFrame) -> DataFrame:
    """Records that arrived twice count once: they differ in loaded_at only."""
    return df.drop("loaded_at").distinct() if "loaded_at" in df.columns else df.distinct()


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    folder: str
    access: Access = Access()

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def docs(self) -> DataFrame:
        return distinct_rows(self._table("document_records").drop("clean_text"))

    @cached_property
    def runs(self) -> DataFrame:
        return self._table("extraction_runs").distinct()

    @cached_property
    def claims(self) -> DataFrame:
        return distinct_rows(self._table("claims"))

    @cached_property
    def measurements(self) -> DataFrame:
        return distinct_rows(self._table("measurements"))

    @cached_property
    def mentions(self) -> DataFrame:
        return distinct_rows(self._table("mention_drafts").select("mention_id", "run_id", "paragraph_id", "surface_form", "normalized_form", "start_offset", "end_offset", "detection_confidence", "detection_source", "loaded_at"))

    @cached_property
    def entities(self) -> DataFrame:
        named = self._table("seed_entities").where("entity_type IS NOT NULL AND name IS NOT NULL").select("entity_type", "name").distinct()
        return named.withColumn("entity_id", F.concat_ws(":", F.lower("entity_type"), F.lower("name")))

    @cached_property
    def visible_docs(self) -> DataFrame:
        """Tenant, access level and soft deletion; no institution means no rows."""
        a = self.access
        return self.docs.where(F.col("institution_id").isin(list(a.institutions)) & F.col("access_level").isin(list(a.levels)) & F.col("deleted_at").isNull())

    @cached_property
    def latest_runs(self) -> DataFrame:
        """run_id, doc_id, run_timestamp of the newest run of each document; ties are all kept."""
        newest = Window.partitionBy("doc_id").orderBy(F.desc("run_timestamp"))
        return self.runs.select("run_id", "doc_id", "run_timestamp").withColumn("r", F.rank().over(newest)).where("r = 1").drop("r")

    @staticmethod
    def active(status: Column) -> Column:
        return F.coalesce(status, F.lit("active")) == "active"

    @cached_property
    def active_claims(self) -> DataFrame:
        """Active claims of the latest runs of visible documents, with doc_id, title, report_year and the claim's year."""
        docs = self.visible_docs.select("doc_id", "title", "institution_id", "report_year")
        at = self.latest_runs.join(docs, "doc_id")
        return self.claims.where(self.active(F.col("quarantine_status"))).join(at, "run_id").withColumn("year", F.substring("claim_date", 1, 4).try_cast("int"))

    @cached_property
    def edges(self) -> DataFrame:
        """claim_id, entity_id, entity_type, name, relation_type."""
        policy = F.create_map(*[x for k, v in ROLE_POLICY.items() for x in (F.lit(k), F.lit(v))])
        named = small_or_plain(self.entities.withColumn("normalized_form", F.lower("name")))
        hits = self.mentions.where("normalized_form IS NOT NULL").select("run_id", "paragraph_id", "normalized_form").distinct().join(named, "normalized_form")
        claims = self.claims.select("claim_id", "run_id", "paragraph_id")
        return claims.join(hits, ["run_id", "paragraph_id"]).select("claim_id", "entity_id", "entity_type", "name", F.coalesce(F.try_element_at(policy, F.col("entity_type")), F.lit(OTHER_RELATION)).alias("relation_type")).distinct()

    @cached_property
    def observations(self) -> DataFrame:
        """One observation per claim of an observed type: observation_id, claim_id, observation_type, year."""
        kinds = F.create_map(*[x for k, v in OBSERVED.items() for x in (F.lit(k), F.lit(v))])
        return self.claims.where(F.col("claim_type").isin(list(OBSERVED))).select(F.concat(F.lit("obs:"), "claim_id").alias("observation_id"), "claim_id", F.try_element_at(kinds, F.col("claim_type")).alias("observation_type"), F.substring("claim_date", 1, 4).try_cast("int").alias("year"))
