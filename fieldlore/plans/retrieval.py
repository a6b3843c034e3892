"""The closed set of graph queries: provenance, retrieval templates, statistics, coverage gaps, graph maintenance.

Each function takes a Graph and parameters and returns a DataFrame. QUERIES binds them to the driver's tables;
ORACLES has the same in SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlore.plans.graph import LEVELS_OF_ROLE, OTHER_RELATION, ROLE_POLICY, Access, Graph
from fieldlore.session import small_or_plain

BLOCK = ["claim_id", "doc_id", "claim_type", "source_sentence", "extraction_confidence", "epistemic_status", "year"]


def top(df: DataFrame, k: int, *keys) -> DataFrame:
    return df.orderBy(*keys).limit(k)


# -- retrieval templates ---------------------------------------------------------------------------------------


def latest_view(g: Graph) -> DataFrame:
    """A1: one row per claim of the latest runs with its measurements, entities and years; no access filter."""
    c = g.claims.join(g.latest_runs, "run_id")
    m = g.measurements.groupBy("claim_id").agg(F.count("measurement_id").alias("measurements"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("measured"))
    e = g.edges.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), "|").alias("entities"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("entity_type") == "Species", F.col("name")))), "|").alias("species"))
    o = g.observations.select("claim_id", "observation_id", "year")
    return c.join(m, "claim_id", "left").join(e, "claim_id", "left").join(o, "claim_id", "left").select("doc_id", "run_id", "claim_id", "claim_type", "paragraph_id", "observation_id", F.coalesce("measurements", F.lit(0)).alias("measurements"), "measured", "entities", "species", "year")


def audit_view(g: Graph) -> DataFrame:
    """A2: every run with its claims and their observations."""
    return g.runs.select("doc_id", "run_id", "run_timestamp").join(g.claims.select("run_id", "claim_id"), "run_id").join(g.observations.select("claim_id", "observation_id"), "claim_id", "left").select("doc_id", "run_timestamp", "run_id", "claim_id", "observation_id")


def provenance(g: Graph, claim_ids: DataFrame | None = None) -> DataFrame:
    """A3: claim, paragraph, page, document and run of visible claims (of the given ones)."""
    c = g.active_claims if claim_ids is None else g.active_claims.join(claim_ids.select("claim_id").distinct(), "claim_id", "left_semi")
    page = F.concat(F.col("doc_id"), F.lit(":page:"), F.lpad(F.regexp_extract("paragraph_id", r":p(\d+):", 1), 3, "0"))
    return c.select("claim_id", "run_id", "paragraph_id", page.alias("page_id"), "doc_id", "title", "claim_type", "source_sentence")


def entity_anchored(g: Graph, entity_id: str, first: int | None = None, last: int | None = None, limit: int = 40) -> DataFrame:
    """A4: claims of one entity, a row per relation, best confidence first; a claim without year passes the bounds."""
    rows = g.active_claims.join(g.edges.where(F.col("entity_id") == entity_id).select("claim_id", "relation_type"), "claim_id")
    rows = between(rows, first, last)
    return top(rows.select(*BLOCK, "relation_type"), limit, F.desc("extraction_confidence"), "claim_id", "relation_type")


def between(rows: DataFrame, first: int | None, last: int | None, keep_null: bool = True) -> DataFrame:
    if first is not None:
        rows = rows.where((F.col("year") >= first) | (F.col("year").isNull() if keep_null else F.lit(False)))
    if last is not None:
        rows = rows.where((F.col("year") <= last) | (F.col("year").isNull() if keep_null else F.lit(False)))
    return rows


K1, B = 1.2, 0.75


def fulltext(g: Graph, text: str, limit: int = 25) -> DataFrame:
    """A5: BM25 over the words of the active claims' sentences, by an inverted index."""
    import re

    words = sorted(set(re.findall(r"[a-z]+", text.lower())))
    docs = g.active_claims.select("claim_id", "source_sentence", F.regexp_extract_all(F.lower("source_sentence"), F.lit(r"([a-z]+)"), F.lit(1)).alias("w"))
    size = docs.agg(F.count("claim_id").alias("total"), F.avg(F.size("w")).alias("mean"))
    index = docs.select("claim_id", F.size("w").alias("length"), F.explode(F.filter("w", lambda x: x.isin(words))).alias("word")).groupBy("claim_id", "length", "word").agg(F.count("word").alias("tf"))
    df = index.groupBy("word").agg(F.count("claim_id").alias("df"))
    rated = index.join(F.broadcast(df), "word").join(F.broadcast(size))
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    return top(rated.groupBy("claim_id").agg(F.round(score, 5).alias("score")), limit, F.desc("score"), "claim_id")


def contains(g: Graph, text: str, limit: int = 25) -> DataFrame:
    """A5 in substring mode."""
    return top(g.active_claims.where(F.lower("source_sentence").contains(text.lower())).select("claim_id", "doc_id", "source_sentence"), limit, "claim_id")


def temporal(g: Graph, first: int, last: int, claim_types: tuple[str, ...] | None = None, limit: int = 60, docs: DataFrame | None = None) -> DataFrame:
    """A6, and with docs A7: observed claims with a year in the bounds, by year, then confidence."""
    rows = g.active_claims.drop("year").join(g.observations, "claim_id").where(F.col("year").between(first, last))
    if claim_types:
        rows = rows.where(F.col("claim_type").isin(list(claim_types)))
    if docs is not None:
        rows = rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return top(rows.select(*BLOCK, "observation_id"), limit, "year", F.desc("extraction_confidence"), "claim_id")


def anchors(g: Graph, label: str = "Place") -> DataFrame:
    """Edges from documents to the entities of a type whose name the title holds."""
    named = g.entities.where(F.col("entity_type") == label).select("entity_id", "name")
    # the place stands after "at" and before the comma, so that an equi-join finds it
    at = F.regexp_extract("title", r" at ([^,]+),", 1)
    return g.docs.select("doc_id", at.alias("name")).where("name <> ''").join(small_or_plain(named), "name").select("doc_id", "entity_id", F.lit(f"ABOUT_{label.upper()}").alias("relation_type")).distinct()


def document_anchor(g: Graph, entity_id: str, first: int | None = None, last: int | None = None, limit: int = 60) -> DataFrame:
    """Claims of the documents about one entity; an observation is optional."""
    docs = anchors(g).where(F.col("entity_id") == entity_id).select("doc_id")
    rows = g.active_claims.join(docs, "doc_id", "left_semi").join(g.observations.select("claim_id", "observation_id"), "claim_id", "left")
    return top(between(rows, first, last).select(*BLOCK, "observation_id"), limit, F.desc("extraction_confidence"), "claim_id")


def multi_entity(g: Graph, entity_ids: tuple[str, ...], limit: int = 40) -> DataFrame:
    """Claims by how many of the entities they touch."""
    hits = g.edges.where(F.col("entity_id").isin(list(entity_ids))).groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), "|").alias("matched_entity_ids"), F.count_distinct("entity_id").alias("matched"))
    return top(g.active_claims.join(hits, "claim_id").select(*BLOCK, "matched_entity_ids", "matched"), limit, F.desc("matched"), F.desc("extraction_confidence"), "claim_id")


def claim_type_scoped(g: Graph, claim_types: tuple[str, ...], entity_ids: tuple[str, ...] | None = None, first: int | None = None, last: int | None = None, limit: int = 40) -> DataFrame:
    """A10: claims of some types, of some entities if any are given."""
    rows = g.active_claims.where(F.col("claim_type").isin(list(claim_types)))
    if entity_ids:
        rows = rows.join(g.edges.where(F.col("entity_id").isin(list(entity_ids))).select("claim_id").distinct(), "claim_id", "left_semi")
    return top(between(rows, first, last).select(*BLOCK), limit, F.desc("extraction_confidence"), "claim_id")


def role_trend(g: Graph, entity_type: str = "Species", entity_id: str | None = None, literal: bool = True) -> DataFrame:
    """Observations of each entity by year; counts and means are weighted by measurements if literal."""
    e = g.edges.where(F.col("entity_type") == entity_type)
    if entity_id:
        e = e.where(F.col("entity_id") == entity_id)
    rows = g.active_claims.select("claim_id", "extraction_confidence").join(g.observations.where("year IS NOT NULL"), "claim_id").join(e.select("claim_id", "entity_id", "name"), "claim_id")
    if literal:
        rows = rows.join(g.measurements.select("claim_id", "measurement_id", F.col("name").alias("measure")), "claim_id", "left")
        listed = F.array_join(F.array_sort(F.collect_set("measure")), "|").alias("measured")
        return rows.groupBy("name", "year").agg(F.count("observation_id").alias("observation_count"), F.round(F.avg("extraction_confidence"), 6).alias("avg_confidence"), listed)
    return rows.groupBy("name", "year").agg(F.count_distinct("observation_id").alias("observation_count"), F.round(F.avg("extraction_confidence"), 6).alias("avg_confidence"))


def scope_condition(g: Graph, scope: str = "Habitat") -> DataFrame:
    """Habitats (or entities of another type) by year and species."""
    h = g.edges.where(F.col("entity_type") == scope).select("claim_id", F.col("name").alias("habitat"))
    s = g.edges.where("entity_type = 'Species'").select("claim_id", F.col("name").alias("species"))
    rows = g.active_claims.select("claim_id", "extraction_confidence").join(g.observations.where("year IS NOT NULL"), "claim_id").join(h, "claim_id").join(s, "claim_id", "left")
    return rows.groupBy("habitat", "year", "species").agg(F.count("observation_id").alias("observation_count"), F.round(F.avg("extraction_confidence"), 6).alias("avg_confidence"))


# -- statistics ------------------------------------------------------------------------------------------------


def corpus_stats(g: Graph) -> DataFrame:
    """Documents, and paragraphs that hold claims or mentions."""
    seen = g.claims.select("paragraph_id").union(g.mentions.select("paragraph_id"))
    docs = g.docs.agg(F.count_distinct("doc_id").alias("total_documents"))
    return docs.join(F.broadcast(seen.agg(F.count_distinct("paragraph_id").alias("total_paragraphs"))))


def list_documents(g: Graph, institution: str = "inst_tamarn") -> DataFrame:
    """All documents of an institution, the deleted ones too."""
    return g.docs.where(F.col("institution_id") == institution).select("doc_id", "title", "access_level", "deleted_at", "page_count").orderBy("title", "doc_id")


def integrity(g: Graph) -> DataFrame:
    """A hash of every record against the first one of its document: status and count."""
    known = g.docs.groupBy("doc_id").agg(F.min("file_hash").alias("stored"), F.count_distinct("file_hash").alias("hashes"), F.max("source_file").alias("source_file"))
    status = F.when(F.col("stored").isNull(), "no_hash").when(F.col("hashes") > 1, "changed").when(F.col("source_file").isNull(), "missing").otherwise("ok")
    return known.groupBy(status.alias("status")).agg(F.count("doc_id").alias("documents"))


def rehashed(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Key and status of each stored hash against the content that is there now: ok, changed, missing (no content) or
    no_hash. stored(key, file_hash), now(key, content as binary); contents are hashed where they lie."""
    fresh = now.groupBy("key").agg(F.max(F.sha1("content")).alias("fresh"))
    status = F.when(F.col("file_hash").isNull(), "no_hash").when(F.col("fresh").isNull(), "missing").when(F.col("fresh") == F.lower("file_hash"), "ok").otherwise("changed")
    return stored.join(fresh, "key", "left").select("key", status.alias("status"))


def files_integrity(spark: SparkSession, stored: DataFrame, folder: str, pattern: str = "*") -> DataFrame:
    """A15 over the files of a folder: stored(source_file, file_hash); only the hash of a file leaves its task."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rehashed(stored.withColumnRenamed("source_file", "key"), found.select(F.regexp_replace("path", r"^.*/", "").alias("key"), "content"))


def corpus_integrity(g: Graph) -> DataFrame:
    """A15 over the corpus of texts: the hash of each text with plain line ends, as a registry would hold it, against its
    content as it is stored: statuses by source."""
    docs = g._table("documents").select(F.col("doc_id").cast("string").alias("key"), "source", "text")
    stored = docs.select("key", F.when(F.col("text").isNotNull(), F.sha1(F.regexp_replace("text", "\r\n", "\n").cast("binary"))).alias("file_hash"))
    status = rehashed(stored, docs.where("text IS NOT NULL").select("key", F.col("text").cast("binary").alias("content")))
    return status.join(docs.select("key", "source"), "key").groupBy("source", "status").agg(F.count("key").alias("documents"))


def duplicate_texts(g: Graph) -> DataFrame:
    """A16 over the corpus of texts: hashes that several documents share."""
    docs = g._table("documents").where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("file_hash"))
    return docs.groupBy("file_hash").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc_id")).where("documents > 1")


def duplicate_hashes(g: Graph) -> DataFrame:
    """Hashes that several documents share."""
    return g.docs.where("file_hash IS NOT NULL").groupBy("file_hash").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc_id")).where("documents > 1")


def entity_fetch(g: Graph) -> DataFrame:
    """Entities in use, by name."""
    return g.entities.join(g.edges.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "entity_type", "name").orderBy("name", "entity_id")


def count_quarantined(g: Graph) -> DataFrame:
    """Claims that are not active, by status, of visible documents."""
    runs = g.runs.select("run_id", "doc_id").join(g.visible_docs.select("doc_id"), "doc_id", "left_semi")
    return g.claims.where(~g.active(F.col("quarantine_status"))).join(runs, "run_id", "left_semi").groupBy("quarantine_status").agg(F.count("claim_id").alias("claims"))


def doc_overview(g: Graph) -> DataFrame:
    """A20."""
    return g.docs.agg(F.count_distinct("doc_id").alias("documents"), F.min("report_year").alias("first_year"), F.max("report_year").alias("last_year"), F.sum("page_count").alias("pages"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


def doc_types(g: Graph) -> DataFrame:
    """A21."""
    return g.docs.groupBy("doc_type").agg(F.count("doc_id").alias("documents"))


def temporal_coverage(g: Graph) -> DataFrame:
    """A21."""
    return g.docs.where("report_year IS NOT NULL").groupBy("report_year").agg(F.count("doc_id").alias("documents"))


def claim_types(g: Graph) -> DataFrame:
    """All runs."""
    return g.claims.groupBy("claim_type").agg(F.count("claim_id").alias("claims"), F.round(F.avg("extraction_confidence"), 6).alias("avg_confidence"))


def claim_types_by_institution(g: Graph) -> DataFrame:
    """A22 blended and by institution in one pass over grouping sets; the total of all institutions has none."""
    docs = g.docs.select("doc_id", "institution_id").distinct()
    rows = g.claims.select("run_id", "claim_id", "claim_type").join(g.runs.select("run_id", "doc_id"), "run_id").join(docs, "doc_id").withColumn("institution", F.coalesce("institution_id", F.lit("?")))
    return rows.groupingSets([["institution", "claim_type"], ["claim_type"]], "institution", "claim_type").agg(F.count("claim_id").alias("claims"))


def entity_types(g: Graph) -> DataFrame:
    """A23."""
    return g.edges.groupBy("entity_type").agg(F.count_distinct("entity_id").alias("entities"))


def confidence_distribution(g: Graph) -> DataFrame:
    """A24."""
    c = F.col("extraction_confidence")
    return g.claims.agg(F.count_if(c >= 0.85).alias("high"), F.count_if((c >= 0.7) & (c < 0.85)).alias("medium"), F.count_if(c < 0.7).alias("low"), F.count_if(F.col("epistemic_status") == "uncertain").alias("uncertain"))


def temporal_density(g: Graph) -> DataFrame:
    """Documents and active claims by report year; documents without claims stay."""
    c = g.claims.where(g.active(F.col("quarantine_status"))).join(g.runs.select("run_id", "doc_id"), "run_id").groupBy("doc_id").agg(F.count("claim_id").alias("n"))
    return g.visible_docs.where("report_year IS NOT NULL").join(c, "doc_id", "left").groupBy("report_year").agg(F.count_distinct("doc_id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims"))


def entity_depth(g: Graph, entity_type: str | None = None, threshold: int = 20, limit: int = 50) -> DataFrame:
    """Entities with few claims, the poorest first."""
    e = g.edges if entity_type is None else g.edges.where(F.col("entity_type") == entity_type)
    return top(e.groupBy("entity_id", "entity_type", "name").agg(F.count_distinct("claim_id").alias("claims")).where(F.col("claims") <= threshold), limit, "claims", "entity_id")


def paragraph_mentions(g: Graph) -> DataFrame:
    """Mentions of a paragraph in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_offset", "mention_id", F.coalesce("normalized_form", F.lit("")).alias("form")))), lambda x: x["form"])
    return g.mentions.groupBy("paragraph_id").agg(F.count("mention_id").alias("mentions"), F.array_join(ordered, "|").alias("forms"))


def entity_search(g: Graph, text: str, limit: int = 20) -> DataFrame:
    """A28."""
    return top(g.entities.where(F.lower("name").contains(text.lower())).select("entity_id", "entity_type", "name"), limit, "name", "entity_id")


def entity_detail(g: Graph) -> DataFrame:
    """Every entity with its claims; entities without claims stay."""
    return g.entities.join(g.edges.select("entity_id", "claim_id"), "entity_id", "left").groupBy("entity_id", "entity_type", "name").agg(F.count_distinct("claim_id").alias("claims"))


def neighborhood(g: Graph, entity_id: str, limit: int = 30) -> DataFrame:
    """Entities that share active claims with one."""
    mine = g.edges.where(F.col("entity_id") == entity_id).select("claim_id").distinct()
    rows = g.edges.where(F.col("entity_id") != entity_id).join(mine, "claim_id", "left_semi").join(g.active_claims.select("claim_id", "institution_id"), "claim_id")
    out = rows.groupBy("entity_id", "entity_type", "name").agg(
        F.count_distinct("claim_id").alias("shared"), F.array_join(F.array_sort(F.collect_set("relation_type")), "|").alias("relations"),
        F.array_join(F.slice(F.array_sort(F.collect_set("claim_id")), 1, 5), "|").alias("claim_ids"), F.array_join(F.array_sort(F.collect_set("institution_id")), "|").alias("institutions"),
    )
    return top(out, limit, F.desc("shared"), "entity_id")


def diagnostics(g: Graph) -> DataFrame:
    """Counts of nodes by label and of edges by relation."""
    nodes = [("Document", g.docs, "doc_id"), ("ExtractionRun", g.runs, "run_id"), ("Claim", g.claims, "claim_id"), ("Measurement", g.measurements, "measurement_id"), ("Mention", g.mentions, "mention_id")]
    rows = [df.agg(F.lit("node").alias("kind"), F.lit(label).alias("label"), F.count_distinct(key).alias("n")) for label, df, key in nodes]
    rows.append(g.entities.groupBy(F.lit("node").alias("kind"), F.col("entity_type").alias("label")).agg(F.count("entity_id").alias("n")))
    rows.append(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("relation_type").alias("label")).agg(F.count("claim_id").alias("n")))
    return functools.reduce(DataFrame.unionByName, rows)


def institution_counts(g: Graph) -> DataFrame:
    """A32."""
    return g.docs.groupBy("institution_id").agg(F.count("doc_id").alias("documents"))


def anchor_lookup(g: Graph, label: str = "Place") -> DataFrame:
    """The entity that most documents are about."""
    return top(anchors(g, label).groupBy("entity_id").agg(F.count("doc_id").alias("documents")), 1, F.desc("documents"), "entity_id")


# -- plans over several templates --------------------------------------------------------------------------------


def combined(g: Graph, entity_id: str, claim_types: tuple[str, ...], budget: int = 20) -> DataFrame:
    """Two plans united, a claim once under its first plan, relations gathered, the best of all kept."""
    a = entity_anchored(g, entity_id, limit=3 * budget).withColumn("plan", F.lit(1))
    b = claim_type_scoped(g, claim_types, limit=2 * budget).withColumn("plan", F.lit(2)).withColumn("relation_type", F.lit(None).cast("string"))
    rows = a.unionByName(b).groupBy(*[c for c in BLOCK]).agg(F.min("plan").alias("plan"), F.array_join(F.array_sort(F.collect_set("relation_type")), "|").alias("relations"))
    return top(rows, budget, F.desc("extraction_confidence"), "claim_id")


def sparse_runs(g: Graph, part: float = 0.2) -> DataFrame:
    """Runs of years whose documents are at most a part of the median (at least 1), with the years around them."""
    counts = g.docs.where("report_year BETWEEN 1800 AND 2026").groupBy(F.col("report_year").alias("year")).agg(F.count("doc_id").alias("documents"))
    edge = counts.agg(F.min("year").alias("first"), F.max("year").alias("last"), F.percentile("documents", 0.5).alias("median"))
    years = edge.select("median", F.explode(F.sequence("first", "last")).alias("year"))
    dense = years.join(counts, "year", "left").withColumn("documents", F.coalesce("documents", F.lit(0))).where(F.col("documents") <= F.greatest(F.lit(1.0), part * F.col("median")))
    # the calendar bounds the window's single group
    island = dense.withColumn("island", F.col("year") - F.row_number().over(Window.orderBy("year")))
    return island.groupBy("island").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("year").alias("years"), F.sum("documents").alias("documents")).drop("island")


def dense_decades(g: Graph) -> DataFrame:
    """Documents by decade, empty decades filled."""
    counts = g.docs.where("report_year BETWEEN 1800 AND 2026").groupBy((F.floor(F.col("report_year") / 10) * 10).cast("int").alias("decade")).agg(F.count("doc_id").alias("documents"))
    span = counts.agg(F.min("decade").alias("a"), F.max("decade").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(10))).alias("decade"))
    return span.join(counts, "decade", "left").select("decade", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("documents").isNull().alias("is_gap"))


def quality_report(g: Graph) -> DataFrame:
    """Counts, duplicate ids, and the gates."""
    c = g.claims.agg(F.count("claim_id").alias("claims"), (F.count("claim_id") - F.count_distinct("claim_id")).alias("duplicate_claims"), F.round(F.count_if(F.col("paragraph_id").isNotNull()) / F.count("claim_id"), 6).alias("with_evidence"))
    m = g.measurements.join(g.claims.select("claim_id").distinct().withColumn("found", F.lit(1)), "claim_id", "left").agg(F.count("measurement_id").alias("measurements"), F.round(F.count("found") / F.count("measurement_id"), 6).alias("linked"))
    n = g.mentions.agg(F.count("mention_id").alias("mentions"), F.round(F.count_if((F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset"))) / F.count("mention_id"), 6).alias("valid_offsets"))
    return c.join(F.broadcast(m)).join(F.broadcast(n)).select("*", ((F.col("with_evidence") == 1) & (F.col("linked") == 1) & (F.col("duplicate_claims") == 0) & (F.col("valid_offsets") >= 0.95)).alias("all_gates"))


def triplets(g: Graph) -> DataFrame:
    """Claim type, relation and entity with claims, documents and the first sentence."""
    rows = g.edges.join(g.claims.select("claim_id", "run_id", "claim_type", "source_sentence"), "claim_id").join(g.runs.select("run_id", "doc_id"), "run_id")
    return rows.groupBy("claim_type", "relation_type", "entity_id").agg(F.count_distinct("claim_id").alias("claims"), F.count_distinct("doc_id").alias("documents"), F.min("source_sentence").alias("sample"))


def coverage(g: Graph, expected: dict[str, float]) -> DataFrame:
    """The share of each expected claim type against its target: gap below a quarter, thin below half."""
    want = g.spark.createDataFrame(sorted(expected.items()), "claim_type string, expected double")
    total = g.claims.agg(F.count("claim_id").alias("total"))
    have = g.claims.groupBy("claim_type").agg(F.count("claim_id").alias("claims"))
    share = F.coalesce(F.col("claims"), F.lit(0)) / F.col("total")
    status = F.when(share < 0.25 * F.col("expected"), "gap").when(share < 0.5 * F.col("expected"), "thin").otherwise("ok")
    return F.broadcast(want).join(have, "claim_type", "left").join(F.broadcast(total)).select("claim_type", F.round(share, 6).alias("share"), status.alias("status"))


# -- graph maintenance -------------------------------------------------------------------------------------------


def merge_nodes(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Later values overwrite, column by column; a column that the newer record lacks keeps the older value."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in rows.columns if c != key])


def merged_documents(g: Graph) -> DataFrame:
    """U1 over the records as they arrived: the newest non-null value of each property."""
    t = g._table("document_records").select("doc_id", "title", "doc_type", "report_year", "page_count", "loaded_at")
    cut = F.to_timestamp(F.lit("2024-02-01 00:00:00")).cast("timestamp_ntz")
    return merge_nodes(t.where(F.col("loaded_at") < cut), t.where(F.col("loaded_at") >= cut).drop("page_count"), "doc_id", "loaded_at").drop("loaded_at")


def merge_edges(g: Graph) -> DataFrame:
    """Edges of all kinds once per start, type, end and run."""
    processed = g.runs.select(F.lit("Document").alias("src_label"), F.col("doc_id").alias("src_id"), F.lit("PROCESSED_BY").alias("rel_type"), F.lit("ExtractionRun").alias("dst_label"), F.col("run_id").alias("dst_id"), "run_id")
    claims = g.claims.select(F.lit("ExtractionRun").alias("src_label"), F.col("run_id").alias("src_id"), F.lit("PRODUCED").alias("rel_type"), F.lit("Claim").alias("dst_label"), F.col("claim_id").alias("dst_id"), "run_id")
    paragraphs = g.claims.select(F.lit("Paragraph").alias("src_label"), F.col("paragraph_id").alias("src_id"), F.lit("HAS_CLAIM").alias("rel_type"), F.lit("Claim").alias("dst_label"), F.col("claim_id").alias("dst_id"), "run_id")
    mentions = g.mentions.select(F.lit("Paragraph").alias("src_label"), F.col("paragraph_id").alias("src_id"), F.lit("CONTAINS_MENTION").alias("rel_type"), F.lit("Mention").alias("dst_label"), F.col("mention_id").alias("dst_id"), "run_id")
    linked = g.edges.join(g.claims.select("claim_id", "run_id"), "claim_id").select(F.lit("Claim").alias("src_label"), F.col("claim_id").alias("src_id"), F.col("relation_type").alias("rel_type"), F.col("entity_type").alias("dst_label"), F.col("entity_id").alias("dst_id"), "run_id")
    return functools.reduce(DataFrame.unionByName, [processed, claims, paragraphs, mentions, linked]).distinct()


def edge_counts(g: Graph) -> DataFrame:
    return merge_edges(g).groupBy("src_label", "rel_type", "dst_label").agg(F.count("dst_id").alias("edges"))


def labels(g: Graph) -> DataFrame:
    """Labels of entities; a refuge is a place too."""
    own = F.array("entity_type", F.lit("Entity"))
    return g.entities.select("entity_id", F.array_join(F.array_sort(F.when(F.col("entity_type") == "Refuge", F.array_union(own, F.array(F.lit("Place")))).otherwise(own)), "|").alias("labels"))


def soft_delete(g: Graph, doc_ids: DataFrame, by: str, at: str) -> DataFrame:
    """U4: documents with the given ones marked as deleted."""
    hit = doc_ids.select("doc_id").distinct().withColumn("hit", F.lit(True))
    out = g.docs.join(hit, "doc_id", "left")
    now = F.col("hit") & F.col("deleted_at").isNull()
    return out.withColumn("deleted_by", F.when(now, by).otherwise(F.col("deleted_by"))).withColumn("deleted_at", F.when(now, at).otherwise(F.col("deleted_at"))).drop("hit")


def quarantine(g: Graph, at_least: float) -> DataFrame:
    """Claims with the doubtful ones quarantined and the rest as they were."""
    doubtful = (F.col("extraction_confidence") < at_least) & Graph.active(F.col("quarantine_status")) & (F.col("epistemic_status") == "uncertain")
    return g.claims.withColumn("quarantine_status", F.when(doubtful, "quarantined").otherwise(F.col("quarantine_status")))


def orphans(g: Graph) -> DataFrame:
    """Entities without an edge."""
    return g.entities.join(g.edges.select("entity_id").distinct(), "entity_id", "left_anti").select("entity_id")


def unresolved_mentions(g: Graph) -> DataFrame:
    """Normalized forms of mentions without an entity, with their number."""
    known = g.entities.select(F.lower("name").alias("normalized_form")).distinct()
    return g.mentions.where("normalized_form IS NOT NULL").groupBy("normalized_form").agg(F.count("mention_id").alias("mentions")).join(small_or_plain(known), "normalized_form", "left_anti")


def unclaimed_measurements(g: Graph) -> DataFrame:
    """Measurements whose claim has no observation, so that they stay with the claim."""
    return g.measurements.join(g.observations.select("claim_id"), "claim_id", "left_anti").groupBy("name").agg(F.count("measurement_id").alias("measurements"))


def next_edges(g: Graph) -> DataFrame:
    """Consecutive paragraphs of a document that hold mentions."""
    p = g.mentions.select("paragraph_id").distinct().withColumn("doc_id", F.substring_index("paragraph_id", ":", 1))
    order = Window.partitionBy("doc_id").orderBy(F.regexp_extract("paragraph_id", r":p(\d+):", 1).cast("int"), "paragraph_id")
    return p.withColumn("previous", F.lag("paragraph_id").over(order)).where("previous IS NOT NULL").select(F.col("previous").alias("src_id"), F.col("paragraph_id").alias("dst_id"))


def running_index(g: Graph) -> DataFrame:
    """Claims numbered within their run."""
    return g.claims.withColumn("claim_index", F.row_number().over(Window.partitionBy("run_id").orderBy("paragraph_id", "claim_id"))).select("claim_id", "run_id", "claim_index")


def top_claims(g: Graph, k: int = 5) -> DataFrame:
    """T4: the best claims of each visible document."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("extraction_confidence"), "claim_id")
    return g.active_claims.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("doc_id", "place", "claim_id", "extraction_confidence")


def role_levels(g: Graph) -> DataFrame:
    """documents that each role may see."""
    rows = [(role, level) for role, levels in LEVELS_OF_ROLE.items() for level in levels]
    roles = g.spark.createDataFrame(rows, "role string, access_level string")
    return g.docs.where("deleted_at IS NULL").join(F.broadcast(roles), "access_level").groupBy("role").agg(F.count("doc_id").alias("documents"))


# -- bindings and SQL --------------------------------------------------------------------------------------------

TEAL, LAKE, TYPES = "species:blue-wing teal", "place:corvale meadow", ("fire_incident", "weather_observation")
EXPECTED = {"economic_use": 0.4, "fire_incident": 0.3, "population_estimate": 0.4, "weather_observation": 0.8, "law_enforcement": 0.1}

_BOUND = {
    "a1_latest_view": latest_view, "a2_audit_view": audit_view, "a3_provenance_chain": provenance, "a4_entity_anchored": lambda g: entity_anchored(g, TEAL, 1935, 1970), "a5_fulltext": lambda g: fulltext(g, "fire burned the lower marsh"),
    "a5_contains": lambda g: contains(g, "cattail belt"), "a6_temporal": lambda g: temporal(g, 1940, 1950), "a7_temporal_anchor": lambda g: temporal(g, 1930, 1980, docs=anchors(g)), "a8_document_anchor": lambda g: document_anchor(g, LAKE),
    "a9_multi_entity": lambda g: multi_entity(g, (TEAL, LAKE, "species:mallard")), "a10_type_scoped": lambda g: claim_type_scoped(g, TYPES, None, 1940, 1960), "a11_role_trend": role_trend, "a11_role_trend_rows": lambda g: role_trend(g, literal=False), "a12_scope_condition": scope_condition, "a12_scope_places": lambda g: scope_condition(g, "Place"), "a15_texts": corpus_integrity, "a16_texts": duplicate_texts, "w5_sparse_wide": lambda g: sparse_runs(g, 0.95),
    "a13_corpus_stats": corpus_stats, "a14_list_documents": list_documents, "a15_integrity": integrity, "a16_duplicate_hashes": duplicate_hashes, "a17_entity_fetch": entity_fetch, "a18_quarantined": count_quarantined, "a20_doc_overview": doc_overview, "a21_doc_types": doc_types, "a21_coverage": temporal_coverage,
    "a22_claim_types": claim_types, "a22_by_institution": claim_types_by_institution, "a23_entity_types": entity_types, "a24_confidence": confidence_distribution, "a25_density": temporal_density, "a26_entity_depth": entity_depth, "a26_geographic": lambda g: entity_depth(g, "Place"), "a27_paragraph_mentions": paragraph_mentions,
    "a28_entity_search": lambda g: entity_search(g, "teal"), "a29_entity_detail": entity_detail, "a30_neighborhood": lambda g: neighborhood(g, TEAL), "a31_diagnostics": diagnostics, "a32_institutions": institution_counts, "a33_anchor_lookup": anchor_lookup, "o3_combined": lambda g: combined(g, TEAL, TYPES),
    "w5_sparse_runs": sparse_runs, "w6_decades": dense_decades, "g7_quality": quality_report, "g10_triplets": triplets, "g13_coverage": lambda g: coverage(g, EXPECTED), "u1_merge_nodes": merged_documents, "u2_edge_counts": edge_counts, "u3_labels": labels,
    "u4_soft_delete": lambda g: soft_delete(g, g.docs.where("report_year < 1935").select("doc_id"), "curator", "2025-01-01").select("doc_id", "deleted_at", "deleted_by"), "u5_quarantine": lambda g: quarantine(g, 0.7).groupBy("quarantine_status").agg(F.count("claim_id").alias("claims")),
    "u6_orphans": orphans, "j12_unclaimed": unclaimed_measurements, "j13_unresolved": unresolved_mentions, "w2_next": next_edges, "w3_claim_index": running_index, "t4_top_claims": top_claims, "f2_role_levels": role_levels,
}
QUERIES = {name: (lambda spark, d, f=f: f(Graph(spark, d, Access()))) for name, f in _BOUND.items()}

_ROLE = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_POLICY.items()) + f" ELSE '{OTHER_RELATION}' END"
_WITH = f"""WITH docs AS (SELECT DISTINCT * EXCLUDE (loaded_at, clean_text) FROM document_records), runs AS (SELECT DISTINCT * FROM extraction_runs), claim AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM claims),
meas AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM measurements), mention AS (SELECT DISTINCT mention_id, run_id, paragraph_id, surface_form, normalized_form, start_offset, end_offset, detection_confidence, detection_source FROM mention_drafts),
entity AS (SELECT DISTINCT entity_type, name, lower(entity_type) || ':' || lower(name) AS entity_id FROM seed_entities WHERE entity_type IS NOT NULL AND name IS NOT NULL),
visible AS (SELECT * FROM docs WHERE institution_id IN ('inst_kessock', 'inst_tamarn') AND access_level IN ('public', 'staff_only') AND deleted_at IS NULL),
latest AS (SELECT run_id, doc_id, run_timestamp FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY run_timestamp DESC) AS r FROM runs) WHERE r = 1),
act AS (SELECT c.*, v.doc_id, v.title, v.institution_id, v.report_year, try_cast(substr(c.claim_date, 1, 4) AS int) AS year FROM claim c JOIN latest l USING (run_id) JOIN visible v ON v.doc_id = l.doc_id WHERE coalesce(quarantine_status, 'active') = 'active'),
edge AS (SELECT DISTINCT c.claim_id, e.entity_id, e.entity_type, e.name, {_ROLE} AS relation_type FROM claim c JOIN mention m ON m.run_id = c.run_id AND m.paragraph_id = c.paragraph_id JOIN entity e ON lower(e.name) = m.normalized_form),
obs AS (SELECT 'obs:' || claim_id AS observation_id, claim_id, CASE claim_type WHEN 'population_estimate' THEN 'PopulationObservation' WHEN 'weather_observation' THEN 'WeatherObservation' ELSE 'EconomicObservation' END AS observation_type, try_cast(substr(claim_date, 1, 4) AS int) AS year FROM claim WHERE claim_type IN ('population_estimate', 'weather_observation', 'economic_use')),
anchor AS (SELECT DISTINCT d.doc_id, e.entity_id FROM docs d JOIN entity e ON e.entity_type = 'Place' AND regexp_extract(d.title, ' at ([^,]+),', 1) = e.name)
"""
_B = "claim_id, doc_id, claim_type, source_sentence, extraction_confidence, epistemic_status, year"
_A = ", ".join("a." + c.strip() for c in _B.split(","))
_list = lambda x: f"array_to_string(list_sort(list_distinct(list({x}) FILTER ({x} IS NOT NULL))), '|')"
_SQL = {
    "a1_latest_view": f"SELECT l.doc_id, l.run_id, c.claim_id, c.claim_type, c.paragraph_id, o.observation_id, coalesce(m.n, 0) AS measurements, m.measured, e.entities, e.species, o.year FROM claim c JOIN latest l USING (run_id) LEFT JOIN (SELECT claim_id, count(*) AS n, {_list('name')} AS measured FROM meas GROUP BY 1) m USING (claim_id) LEFT JOIN (SELECT claim_id, {_list('entity_id')} AS entities, coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (entity_type = 'Species'))), '|'), '') AS species FROM edge GROUP BY 1) e USING (claim_id) LEFT JOIN obs o USING (claim_id)",
    "a2_audit_view": "SELECT r.doc_id, r.run_timestamp, r.run_id, c.claim_id, o.observation_id FROM runs r JOIN claim c USING (run_id) LEFT JOIN obs o USING (claim_id)",
    "a3_provenance_chain": "SELECT claim_id, run_id, paragraph_id, doc_id || ':page:' || lpad(regexp_extract(paragraph_id, ':p(\\d+):', 1), 3, '0') AS page_id, doc_id, title, claim_type, source_sentence FROM act",
    "a4_entity_anchored": f"SELECT {_A}, e.relation_type FROM act a JOIN edge e USING (claim_id) WHERE e.entity_id = '{TEAL}' AND (year IS NULL OR year BETWEEN 1935 AND 1970) ORDER BY extraction_confidence DESC, claim_id, relation_type LIMIT 40",
    "a5_fulltext": "SELECT claim_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 5) AS score FROM (SELECT claim_id, length, word, count(*) AS tf, count(*) OVER (PARTITION BY word) AS df FROM (SELECT claim_id, len(w) AS length, unnest(w) AS word FROM (SELECT claim_id, regexp_extract_all(lower(source_sentence), '[a-z]+') AS w FROM act)) WHERE word IN ('fire', 'burned', 'the', 'lower', 'marsh') GROUP BY 1, 2, 3), (SELECT count(*) AS total, avg(len(regexp_extract_all(lower(source_sentence), '[a-z]+'))) AS mean FROM act) GROUP BY 1 ORDER BY score DESC, claim_id LIMIT 25",
    "a5_contains": "SELECT claim_id, doc_id, source_sentence FROM act WHERE contains(lower(source_sentence), 'cattail belt') ORDER BY claim_id LIMIT 25",
    "a6_temporal": f"SELECT {_A.replace('a.year', 'o.year')}, o.observation_id FROM act a JOIN obs o USING (claim_id) WHERE o.year BETWEEN 1940 AND 1950 ORDER BY o.year, extraction_confidence DESC, claim_id LIMIT 60",
    "a7_temporal_anchor": f"SELECT {_A.replace('a.year', 'o.year')}, o.observation_id FROM act a JOIN obs o USING (claim_id) WHERE o.year BETWEEN 1930 AND 1980 AND a.doc_id IN (SELECT doc_id FROM anchor) ORDER BY o.year, extraction_confidence DESC, claim_id LIMIT 60",
    "a8_document_anchor": f"SELECT {_A}, o.observation_id FROM act a LEFT JOIN obs o USING (claim_id) WHERE a.doc_id IN (SELECT doc_id FROM anchor WHERE entity_id = '{LAKE}') ORDER BY extraction_confidence DESC, claim_id LIMIT 60",
    "a9_multi_entity": f"SELECT {_A}, e.ids AS matched_entity_ids, e.n AS matched FROM act a JOIN (SELECT claim_id, {_list('entity_id')} AS ids, count(DISTINCT entity_id) AS n FROM edge WHERE entity_id IN ('{TEAL}', '{LAKE}', 'species:mallard') GROUP BY 1) e USING (claim_id) ORDER BY matched DESC, extraction_confidence DESC, claim_id LIMIT 40",
    "a10_type_scoped": f"SELECT {_B} FROM act WHERE claim_type IN {TYPES} AND (year IS NULL OR year BETWEEN 1940 AND 1960) ORDER BY extraction_confidence DESC, claim_id LIMIT 40",
    "a11_role_trend": f"SELECT e.name, o.year, count(o.observation_id) AS observation_count, round(avg(extraction_confidence), 6) AS avg_confidence, coalesce({_list('m.name')}, '') AS measured FROM act a JOIN obs o USING (claim_id) JOIN edge e USING (claim_id) LEFT JOIN meas m USING (claim_id) WHERE o.year IS NOT NULL AND e.entity_type = 'Species' GROUP BY 1, 2",
    "a11_role_trend_rows": "SELECT e.name, o.year, count(DISTINCT o.observation_id) AS observation_count, round(avg(extraction_confidence), 6) AS avg_confidence FROM act a JOIN obs o USING (claim_id) JOIN edge e USING (claim_id) WHERE o.year IS NOT NULL AND e.entity_type = 'Species' GROUP BY 1, 2",
    "a12_scope_condition": "SELECT h.name AS habitat, o.year, s.name AS species, count(o.observation_id) AS observation_count, round(avg(extraction_confidence), 6) AS avg_confidence FROM act a JOIN obs o USING (claim_id) JOIN edge h ON h.claim_id = a.claim_id AND h.entity_type = 'Habitat' LEFT JOIN edge s ON s.claim_id = a.claim_id AND s.entity_type = 'Species' WHERE o.year IS NOT NULL GROUP BY 1, 2, 3",
    "a13_corpus_stats": "SELECT (SELECT count(DISTINCT doc_id) FROM docs) AS total_documents, (SELECT count(DISTINCT paragraph_id) FROM (SELECT paragraph_id FROM claim UNION ALL SELECT paragraph_id FROM mention)) AS total_paragraphs",
    "a14_list_documents": "SELECT doc_id, title, access_level, deleted_at, page_count FROM docs WHERE institution_id = 'inst_tamarn'",
    "a15_integrity": "SELECT CASE WHEN stored IS NULL THEN 'no_hash' WHEN hashes > 1 THEN 'changed' WHEN source_file IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS documents FROM (SELECT doc_id, min(file_hash) AS stored, count(DISTINCT file_hash) AS hashes, max(source_file) AS source_file FROM docs GROUP BY 1) GROUP BY 1",
    "a16_duplicate_hashes": "SELECT file_hash, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc_id FROM docs WHERE file_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "a17_entity_fetch": "SELECT entity_id, entity_type, name FROM entity WHERE entity_id IN (SELECT entity_id FROM edge)",
    "a18_quarantined": "SELECT quarantine_status, count(*) AS claims FROM claim WHERE coalesce(quarantine_status, 'active') <> 'active' AND run_id IN (SELECT run_id FROM runs WHERE doc_id IN (SELECT doc_id FROM visible)) GROUP BY 1",
    "a20_doc_overview": "SELECT count(DISTINCT doc_id) AS documents, min(report_year) AS first_year, max(report_year) AS last_year, sum(page_count)::bigint AS pages, count(deleted_at) AS deleted FROM docs",
    "a21_doc_types": "SELECT doc_type, count(doc_id) AS documents FROM docs GROUP BY 1",
    "a21_coverage": "SELECT report_year, count(doc_id) AS documents FROM docs WHERE report_year IS NOT NULL GROUP BY 1",
    "a22_claim_types": "SELECT claim_type, count(*) AS claims, round(avg(extraction_confidence), 6) AS avg_confidence FROM claim GROUP BY 1",
    "a22_by_institution": "SELECT institution, claim_type, count(*) AS claims FROM (SELECT c.claim_id, c.claim_type, coalesce(d.institution_id, '?') AS institution FROM claim c JOIN runs r USING (run_id) JOIN (SELECT DISTINCT doc_id, institution_id FROM docs) d ON d.doc_id = r.doc_id) GROUP BY GROUPING SETS ((institution, claim_type), (claim_type))",
    "a23_entity_types": "SELECT entity_type, count(DISTINCT entity_id) AS entities FROM edge GROUP BY 1",
    "a24_confidence": "SELECT count(*) FILTER (extraction_confidence >= 0.85) AS high, count(*) FILTER (extraction_confidence >= 0.7 AND extraction_confidence < 0.85) AS medium, count(*) FILTER (extraction_confidence < 0.7) AS low, count(*) FILTER (epistemic_status = 'uncertain') AS uncertain FROM claim",
    "a25_density": "SELECT report_year, count(DISTINCT v.doc_id) AS documents, coalesce(sum(n), 0)::bigint AS claims FROM visible v LEFT JOIN (SELECT doc_id, count(*) AS n FROM claim JOIN runs USING (run_id) WHERE coalesce(quarantine_status, 'active') = 'active' GROUP BY 1) c USING (doc_id) WHERE report_year IS NOT NULL GROUP BY 1",
    "a26_entity_depth": "SELECT entity_id, entity_type, name, count(DISTINCT claim_id) AS claims FROM edge GROUP BY 1, 2, 3 HAVING count(DISTINCT claim_id) <= 20 ORDER BY claims, entity_id LIMIT 50",
    "a26_geographic": "SELECT entity_id, entity_type, name, count(DISTINCT claim_id) AS claims FROM edge WHERE entity_type = 'Place' GROUP BY 1, 2, 3 HAVING count(DISTINCT claim_id) <= 20 ORDER BY claims, entity_id LIMIT 50",
    "a27_paragraph_mentions": "SELECT paragraph_id, count(*) AS mentions, string_agg(coalesce(normalized_form, ''), '|' ORDER BY start_offset, mention_id) AS forms FROM mention GROUP BY 1",
    "a28_entity_search": "SELECT entity_id, entity_type, name FROM entity WHERE contains(lower(name), 'teal') ORDER BY name, entity_id LIMIT 20",
    "a29_entity_detail": "SELECT e.entity_id, e.entity_type, e.name, count(DISTINCT g.claim_id) AS claims FROM entity e LEFT JOIN edge g ON g.entity_id = e.entity_id GROUP BY 1, 2, 3",
    "a30_neighborhood": f"SELECT e.entity_id, e.entity_type, e.name, count(DISTINCT e.claim_id) AS shared, {_list('e.relation_type')} AS relations, array_to_string(list_sort(list_distinct(list(e.claim_id)))[1:5], '|') AS claim_ids, {_list('a.institution_id')} AS institutions FROM edge e JOIN act a USING (claim_id) WHERE e.entity_id <> '{TEAL}' AND e.claim_id IN (SELECT claim_id FROM edge WHERE entity_id = '{TEAL}') GROUP BY 1, 2, 3 ORDER BY shared DESC, entity_id LIMIT 30",
    "a31_diagnostics": "SELECT 'node' AS kind, 'Document' AS label, count(DISTINCT doc_id) AS n FROM docs UNION ALL SELECT 'node', 'ExtractionRun', count(DISTINCT run_id) FROM runs UNION ALL SELECT 'node', 'Claim', count(DISTINCT claim_id) FROM claim UNION ALL SELECT 'node', 'Measurement', count(DISTINCT measurement_id) FROM meas UNION ALL SELECT 'node', 'Mention', count(DISTINCT mention_id) FROM mention UNION ALL SELECT 'node', entity_type, count(*) FROM entity GROUP BY 2 UNION ALL SELECT 'edge', relation_type, count(*) FROM edge GROUP BY 2",
    "a32_institutions": "SELECT institution_id, count(doc_id) AS documents FROM docs GROUP BY 1",
    "a33_anchor_lookup": "SELECT entity_id, count(*) AS documents FROM anchor GROUP BY 1 ORDER BY documents DESC, entity_id LIMIT 1",
    "o3_combined": f"SELECT {_B}, min(plan) AS plan, coalesce({_list('relation_type')}, '') AS relations FROM (SELECT * FROM (SELECT {_A}, e.relation_type, 1 AS plan FROM act a JOIN edge e USING (claim_id) WHERE e.entity_id = '{TEAL}' ORDER BY extraction_confidence DESC, claim_id, relation_type LIMIT 60) UNION ALL SELECT * FROM (SELECT {_B}, NULL, 2 FROM act WHERE claim_type IN {TYPES} ORDER BY extraction_confidence DESC, claim_id LIMIT 40)) GROUP BY {_B} ORDER BY extraction_confidence DESC, claim_id LIMIT 20",
    "w5_sparse_runs": "SELECT min(year)::int AS first_year, max(year)::int AS last_year, count(*) AS years, sum(documents)::bigint AS documents FROM (SELECT year, documents, year - row_number() OVER (ORDER BY year) AS island FROM (SELECT y.year, coalesce(c.n, 0) AS documents, m.median FROM (SELECT unnest(range(min(report_year)::bigint, max(report_year)::bigint + 1)) AS year FROM docs WHERE report_year BETWEEN 1800 AND 2026) y LEFT JOIN (SELECT report_year, count(doc_id) AS n FROM docs WHERE report_year BETWEEN 1800 AND 2026 GROUP BY 1) c ON c.report_year = y.year, (SELECT quantile_cont(n, 0.5) AS median FROM (SELECT count(doc_id) AS n FROM docs WHERE report_year BETWEEN 1800 AND 2026 GROUP BY report_year)) m) WHERE documents <= greatest(1.0, 0.2 * median)) GROUP BY island",
    "w6_decades": "SELECT s.decade::int AS decade, coalesce(n, 0) AS documents, n IS NULL AS is_gap FROM (SELECT unnest(range(min(report_year // 10 * 10)::bigint, max(report_year // 10 * 10)::bigint + 1, 10)) AS decade FROM docs WHERE report_year BETWEEN 1800 AND 2026) s LEFT JOIN (SELECT report_year // 10 * 10 AS decade, count(doc_id) AS n FROM docs WHERE report_year BETWEEN 1800 AND 2026 GROUP BY 1) c USING (decade)",
    "g7_quality": "SELECT *, with_evidence = 1 AND linked = 1 AND duplicate_claims = 0 AND valid_offsets >= 0.95 AS all_gates FROM (SELECT count(*) AS claims, count(*) - count(DISTINCT claim_id) AS duplicate_claims, round(count(paragraph_id) / count(*), 6) AS with_evidence FROM claim), (SELECT count(*) AS measurements, round(count(*) FILTER (claim_id IN (SELECT claim_id FROM claim)) / count(*), 6) AS linked FROM meas), (SELECT count(*) AS mentions, round(count(*) FILTER (start_offset >= 0 AND end_offset > start_offset) / count(*), 6) AS valid_offsets FROM mention)",
    "g10_triplets": "SELECT c.claim_type, e.relation_type, e.entity_id, count(DISTINCT c.claim_id) AS claims, count(DISTINCT r.doc_id) AS documents, min(c.source_sentence) AS sample FROM edge e JOIN claim c USING (claim_id) JOIN runs r USING (run_id) GROUP BY 1, 2, 3",
    "g13_coverage": "SELECT claim_type, round(coalesce(n, 0) / total, 6) AS share, CASE WHEN coalesce(n, 0) / total < 0.25 * expected THEN 'gap' WHEN coalesce(n, 0) / total < 0.5 * expected THEN 'thin' ELSE 'ok' END AS status FROM (VALUES " + ", ".join(f"('{k}', {v}::double)" for k, v in EXPECTED.items()) + ") w(claim_type, expected) LEFT JOIN (SELECT claim_type, count(*) AS n FROM claim GROUP BY 1) USING (claim_type), (SELECT count(*) AS total FROM claim)",
    "u1_merge_nodes": "SELECT doc_id, arg_max(title, loaded_at) FILTER (title IS NOT NULL) AS title, arg_max(doc_type, loaded_at) FILTER (doc_type IS NOT NULL) AS doc_type, arg_max(report_year, loaded_at) FILTER (report_year IS NOT NULL) AS report_year, arg_max(page_count, loaded_at) FILTER (page_count IS NOT NULL AND loaded_at < TIMESTAMP '2024-02-01') AS page_count FROM document_records GROUP BY 1",
    "u2_edge_counts": "SELECT src_label, rel_type, dst_label, count(*) AS edges FROM (SELECT DISTINCT 'Document' AS src_label, doc_id AS src_id, 'PROCESSED_BY' AS rel_type, 'ExtractionRun' AS dst_label, run_id AS dst_id, run_id FROM runs UNION SELECT 'ExtractionRun', run_id, 'PRODUCED', 'Claim', claim_id, run_id FROM claim UNION SELECT 'Paragraph', paragraph_id, 'HAS_CLAIM', 'Claim', claim_id, run_id FROM claim UNION SELECT 'Paragraph', paragraph_id, 'CONTAINS_MENTION', 'Mention', mention_id, run_id FROM mention UNION SELECT 'Claim', e.claim_id, relation_type, entity_type, entity_id, run_id FROM edge e JOIN claim USING (claim_id)) GROUP BY 1, 2, 3",
    "u3_labels": "SELECT entity_id, array_to_string(list_sort(CASE WHEN entity_type = 'Refuge' THEN ['Refuge', 'Entity', 'Place'] ELSE [entity_type, 'Entity'] END), '|') AS labels FROM entity",
    "u4_soft_delete": "SELECT doc_id, CASE WHEN report_year < 1935 AND deleted_at IS NULL THEN '2025-01-01' ELSE deleted_at END AS deleted_at, CASE WHEN report_year < 1935 AND deleted_at IS NULL THEN 'curator' ELSE deleted_by END AS deleted_by FROM docs",
    "u5_quarantine": "SELECT CASE WHEN extraction_confidence < 0.7 AND coalesce(quarantine_status, 'active') = 'active' AND epistemic_status = 'uncertain' THEN 'quarantined' ELSE quarantine_status END AS quarantine_status, count(*) AS claims FROM claim GROUP BY 1",
    "u6_orphans": "SELECT entity_id FROM entity WHERE entity_id NOT IN (SELECT entity_id FROM edge)",
    "j12_unclaimed": "SELECT name, count(*) AS measurements FROM meas WHERE claim_id NOT IN (SELECT claim_id FROM obs) GROUP BY 1",
    "j13_unresolved": "SELECT normalized_form, count(*) AS mentions FROM mention WHERE normalized_form IS NOT NULL AND normalized_form NOT IN (SELECT lower(name) FROM entity) GROUP BY 1",
    "w2_next": "SELECT previous AS src_id, paragraph_id AS dst_id FROM (SELECT paragraph_id, lag(paragraph_id) OVER (PARTITION BY split_part(paragraph_id, ':', 1) ORDER BY try_cast(regexp_extract(paragraph_id, ':p(\\d+):', 1) AS int), paragraph_id) AS previous FROM (SELECT DISTINCT paragraph_id FROM mention)) WHERE previous IS NOT NULL",
    "w3_claim_index": "SELECT claim_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY paragraph_id, claim_id)::int AS claim_index FROM claim",
    "t4_top_claims": "SELECT doc_id, place::int AS place, claim_id, extraction_confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY extraction_confidence DESC, claim_id) AS place FROM act) WHERE place <= 5",
    "f2_role_levels": "SELECT role, count(*) AS documents FROM docs JOIN (VALUES " + ", ".join(f"('{r}', '{x}')" for r, xs in LEVELS_OF_ROLE.items() for x in xs) + ") l(role, access_level) USING (access_level) WHERE deleted_at IS NULL GROUP BY 1",
}
_SQL |= {
    "a12_scope_places": _SQL["a12_scope_condition"].replace("h.entity_type = 'Habitat'", "h.entity_type = 'Place'"),
    "a15_texts": "SELECT source, CASE WHEN text IS NULL THEN 'no_hash' WHEN sha1(replace(text, chr(13) || chr(10), chr(10))) = sha1(text) THEN 'ok' ELSE 'changed' END AS status, count(*) AS documents FROM documents GROUP BY 1, 2",
    "a16_texts": "SELECT md5(text) AS file_hash, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "w5_sparse_wide": _SQL["w5_sparse_runs"].replace("0.2 * median", "0.95 * median"),
}
ORACLES = {name: _WITH + sql for name, sql in _SQL.items()}
