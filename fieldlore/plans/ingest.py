"""Runs and their identity, flags of new documents, guards of names, extraction by a model, scans of all claims."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlore.functions import ids
from fieldlore.plans.graph import Access, Graph
from fieldlore.review import detectors

# -- runs (P13, P14) ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RunSettings:
    """What an extraction was done with."""

    ocr_engine: str = "unknown"
    ocr_version: str = "unknown"
    normalizer_version: str = "v1"
    ner_model: str = "hybrid-rules-llm"
    relation_model: str = "hybrid-rules-llm"

    def fingerprint(self) -> Column:
        return ids.stable_hash(*(ids.text_part(F.lit(v)) for v in (self.ocr_engine, self.ocr_version, self.normalizer_version, self.ner_model, self.relation_model)))


def document_runs(docs: DataFrame, at: Column, settings: RunSettings | None = None) -> DataFrame:
    """Docs (with source_file and optionally settings as columns) with run_id and config_fingerprint. The run's
    name holds the time and a hash of the file, so that files read at the same moment by many tasks never share one."""
    s = settings or RunSettings()
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return docs.withColumn("run_id", F.concat(F.lit("run_"), stamp, F.lit("_"), ids.stable_hash(ids.text_part("source_file"), size=8))).withColumn("config_fingerprint", s.fingerprint())


def fingerprints(runs: DataFrame, models: tuple[str, str] = ("hybrid-rules-llm", "hybrid-rules-llm")) -> DataFrame:
    """P13 over stored runs: the fingerprint that each run's settings give."""
    parts = [ids.text_part(F.coalesce(c, F.lit(d))) for c, d in (("ocr_engine", "unknown"), ("ocr_version", "unknown"), ("normalizer_version", "v1"))]
    return runs.select("run_id", ids.stable_hash(*parts, *(ids.text_part(F.lit(m)) for m in models)).alias("config_fingerprint"))


# -- flags of documents (D23) and guards (P11, F16) -------------------------------------------------------------------

ACCESS_LEVELS = ("public", "staff_only", "restricted", "indigenous_restricted")
#: The level that no document may get before those it concerns were asked.
CONSULTED_LEVEL = "indigenous_restricted"


def flagged(docs: DataFrame, access_level: str, institution_id: str, donor_restricted: bool = False, consulted: bool = False) -> DataFrame:
    """Documents with the level, institution and donor mark they are read in with."""
    if access_level not in ACCESS_LEVELS:
        raise ValueError(f"no access level {access_level!r}: one of {', '.join(ACCESS_LEVELS)}")
    if access_level == CONSULTED_LEVEL and not consulted:
        raise PermissionError(f"{CONSULTED_LEVEL} asks for a consultation that is confirmed")
    return docs.withColumn("access_level", F.lit(access_level)).withColumn("institution_id", F.lit(institution_id)).withColumn("donor_restricted", F.lit(donor_restricted))


def inside(root: str | Path, path: str | Path) -> Path:
    """The path, resolved, if it lies in the folder; links and steps upwards do not lead out of it."""
    base, found = Path(root).resolve(), (Path(root) / path).resolve()
    if found != base and base not in found.parents:
        raise PermissionError(f"{path} lies outside of {root}")
    return found


#: What names of documents, runs and corpora are made of.
SAFE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}")


def safe_id(text: str) -> str:
    """F16: the text, if it can be an id: no path, no step upwards, no blank."""
    if not SAFE_ID.fullmatch(text) or ".." in text:
        raise ValueError(f"no id: {text!r}")
    return text


def safe_ids(rows: DataFrame, column: str) -> DataFrame:
    """F16 over a table: rows whose id is one."""
    return rows.where(F.col(column).rlike(rf"^{SAFE_ID.pattern}$") & ~F.contains(F.col(column), F.lit("..")))


# -- a model's claims and mentions (X9, X11, X22) ----------------------------------------------------------------------

#: A model: a paragraph's text to its claims. The one that is not there finds none.
ClaimModel = Callable[[str], list[dict]]
CLAIM = "paragraph_id string, position int, claim_type string, sentence string, epistemic_status string, extraction_confidence double"


def no_model(text: str) -> list[dict]:
    return []


def read_answer(text: str | list | None) -> list[dict]:
    """A model's answer as claims: a JSON list, alone, within a fence or within an object; anything else is no claim."""
    if not isinstance(text, str):
        found = text or []
    else:
        body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
        try:
            found = json.loads(body)
        except ValueError:
            m = re.search(r"\[.*\]", body, re.S)
            try:
                found = json.loads(m[0]) if m else []
            except ValueError:
                found = []
        if isinstance(found, dict):
            found = next((v for v in found.values() if isinstance(v, list)), [])
    return [c for c in found if isinstance(c, dict) and str(c.get("source_sentence") or c.get("sentence") or "").strip()]


def cache_key(model: str, prompt: str, text: Column) -> Column:
    """X11: what makes an answer reusable: the model, its prompt and the trimmed text."""
    return F.sha2(F.concat_ws("||", F.lit(model), F.lit(prompt), F.trim(text)), 256)


def model_answers(paragraphs: DataFrame, model: ClaimModel = no_model, name: str = "", prompt: str = "", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, answers). Each distinct text that the cache (key, answer) lacks is asked once, however many
    paragraphs hold it; answers are the cache's new rows, to be appended to it."""
    from fieldlore.session import cut

    keyed = paragraphs.where("clean_text IS NOT NULL AND trim(clean_text) <> ''").withColumn("key", cache_key(name, prompt, F.col("clean_text")))
    asked = keyed.select("key", F.trim("clean_text").alias("text")).dropDuplicates(["key"])
    if cache is not None:
        asked = asked.join(cache.select("key"), "key", "left_anti")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "answer": [json.dumps(read_answer(model(t))) for t in b["text"]]})

    # a model answers once: what it said is written before it is used
    new = cut(asked.mapInPandas(kernel, "key string, answer string"))
    answers = new if cache is None else new.unionByName(cache.select("key", "answer"))
    # the texts of one form letter may be many paragraphs: their answer is small
    entry = "array<struct<claim_type: string, source_sentence: string, sentence: string, epistemic_status: string, extraction_confidence: double>>"
    found = keyed.select("paragraph_id", "key").join(answers, "key").select("paragraph_id", F.posexplode(F.from_json("answer", entry)).alias("position", "c"))
    claims = found.select("paragraph_id", "position", F.coalesce("c.claim_type", F.lit("unclassified_assertion")).alias("claim_type"), F.coalesce("c.source_sentence", "c.sentence").alias("sentence"), F.coalesce("c.epistemic_status", F.lit("certain")).alias("epistemic_status"), F.coalesce("c.extraction_confidence", F.lit(0.5)).alias("extraction_confidence"))
    return claims, new


def hybrid_mentions(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Mentions of rules and of a model by their span: of one span the more confident, rules in a tie; a model's mention
    that wins takes over flags and hints that it lacks."""
    key = ["paragraph_id", "start_offset", "end_offset"]
    once = lambda df, p: df.groupBy(*key).agg(F.max_by(F.struct("surface_form", "detection_confidence", "detection_source", "ocr_flags", "entity_type_hints"), "detection_confidence").alias(p))
    both = once(rules, "r").join(once(model, "m"), key, "full")
    wins = F.col("r").isNull() | (F.col("m.detection_confidence") > F.col("r.detection_confidence"))
    pick = lambda c: F.when(wins, F.col(f"m.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    kept = lambda c: F.when(wins & (F.coalesce(F.size(f"m.{c}"), F.lit(0)) > 0), F.col(f"m.{c}")).otherwise(F.coalesce(f"r.{c}", f"m.{c}")).alias(c)
    source = F.when(F.col("r").isNotNull() & F.col("m").isNotNull(), "hybrid").when(F.col("r").isNull(), F.col("m.detection_source")).otherwise(F.col("r.detection_source"))
    return both.select(*key, pick("surface_form"), pick("detection_confidence"), source.alias("detection_source"), kept("ocr_flags"), kept("entity_type_hints"))


# -- scans of all claims (A19, R6) -------------------------------------------------------------------------------------


def scan_batch(g: Graph, institution: str | None = None) -> DataFrame:
    """Active claims, of one institution's documents if one is asked for, in a single distributed pass instead of pages."""
    rows = g.claims.where(g.active(F.col("quarantine_status")))
    if institution is not None:
        own = g.runs.join(g.docs.where(F.col("institution_id") == institution).select("doc_id"), "doc_id", "left_semi").select("run_id")
        rows = rows.join(own, "run_id", "left_semi")
    return rows.select("claim_id", "source_sentence", "claim_type")


def scanned(claims: DataFrame, vocabulary: tuple[str, ...] = (), pii_from: float = 0.85, words_from: float = 0.90, text: str = "source_sentence") -> DataFrame:
    """A proposal for every flag of a claim, with whether it is sure enough to quarantine the claim at once. All kinds
    of personal data of a sentence count, not only the surest."""
    kinds = F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit("pii_exposure").alias("issue_class"), F.concat(F.lit("pii_exposure:"), F.lit(label)).alias("reason"), F.lit(sure).alias("confidence"), F.lit(pii_from).alias("least"))) for label, p, sure in detectors.SENSITIVE])
    if vocabulary:
        words = "(?i)\\b(" + "|".join(map(re.escape, vocabulary)) + ")\\b"
        kinds = F.concat(kinds, F.array(F.when(F.col(text).rlike(words), F.struct(F.lit("protected_vocabulary").alias("issue_class"), F.concat(F.lit("protected_vocabulary:"), F.lower(F.regexp_extract(text, words, 1))).alias("reason"), F.lit(0.90).alias("confidence"), F.lit(words_from).alias("least")))))
    flags = claims.select("claim_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("f"))
    return flags.select("claim_id", "f.issue_class", "f.reason", "f.confidence", (F.col("f.confidence") >= F.col("f.least")).alias("quarantine"), F.round(F.least(F.lit(1.0), 0.7 * F.col("f.confidence") + 0.3), 6).alias("priority_score"))


def scan_summary(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Scanned, flagged, quarantined (flags) and proposals_created."""
    flags = found.agg(F.count_distinct("claim_id").alias("flagged"), F.count_if("quarantine").alias("quarantined"), F.count("claim_id").alias("proposals_created"))
    return claims.agg(F.count("claim_id").alias("scanned")).join(F.broadcast(flags))


def after_scan(claims: DataFrame, found: DataFrame) -> DataFrame:
    """The claims with those quarantined that a scan was sure of."""
    hit = found.where("quarantine").groupBy("claim_id").agg(F.min("reason").alias("quarantine_reason"))
    return claims.drop("quarantine_reason").join(hit, "claim_id", "left").withColumn("quarantine_status", F.when(F.col("quarantine_reason").isNotNull(), "quarantined").otherwise(F.col("quarantine_status")))


# -- scope of an administrator (Q7) ------------------------------------------------------------------------------------


def rebound(access: Access, role: str, institutions: tuple[str, ...] | None, admin_only: bool = True) -> Access:
    """Q7: an administrator's access widened to the institutions of all corpora; others keep their own."""
    if institutions is None or (admin_only and role != "admin"):
        return access
    return Access(tuple(institutions), access.levels)


def all_institutions(spark: SparkSession, d: str, role: str = "admin") -> DataFrame:
    """Q7 as a query: visible documents by institution with an administrator's scope."""
    g = Graph(spark, d)
    known = tuple(r.institution_id for r in g.docs.where("institution_id IS NOT NULL").select("institution_id").distinct().orderBy("institution_id").toLocalIterator())
    wide = Graph(spark, d, rebound(g.access, role, known))
    return wide.visible_docs.groupBy("institution_id").agg(F.count_distinct("doc_id").alias("documents"))


# -- queries -----------------------------------------------------------------------------------------------------------


def _texts(g: Graph) -> DataFrame:
    """Running texts as claims, for scans: the records' transcripts hold personal data, the claims' sentences none."""
    return g._table("document_records").select(F.col("doc_id").alias("claim_id"), F.col("clean_text").alias("source_sentence")).where("doc_id IS NOT NULL AND clean_text IS NOT NULL").dropDuplicates(["claim_id"])


def _wood_model(text: str) -> list[dict]:
    """A model for the query: sentences about fire, as a rule finds them."""
    return [{"claim_type": "fire_incident", "source_sentence": s, "extraction_confidence": 0.8} for s in re.split(r"(?<=[.!?]) ", text) if re.search(r"\b(?:fire|burned)\b", s, re.I)]


def _model_claims(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    rows = g.claims.select(F.col("claim_id").alias("paragraph_id"), F.col("source_sentence").alias("clean_text"))
    return model_answers(rows, _wood_model, "rules", "fires")[0].select("paragraph_id", "claim_type", "sentence", "extraction_confidence")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of one detection source against those of the others."""
    g = Graph(spark, d)
    rows = g.mentions.where("surface_form IS NOT NULL AND start_offset IS NOT NULL").select("paragraph_id", "start_offset", "end_offset", "surface_form", "detection_confidence", "detection_source", F.array().cast("array<string>").alias("ocr_flags"), F.array().cast("array<string>").alias("entity_type_hints"))
    sure = rows.where("detection_source = 'seed_lexicon'")
    return hybrid_mentions(sure, rows.where("detection_source <> 'seed_lexicon'")).groupBy("detection_source").agg(F.count("surface_form").alias("mentions"), F.round(F.sum("detection_confidence"), 4).alias("confidence"))


_BOUND = {
    "p13_fingerprints": lambda g: fingerprints(g.runs), "p14_run_ids": lambda g: document_runs(g.docs.select("doc_id", "source_file").distinct(), F.to_timestamp(F.lit("2024-03-01 12:00:00"))).select("doc_id", "run_id", "config_fingerprint"),
    "d23_flagged": lambda g: flagged(g.docs.select("doc_id", "access_level", "institution_id"), "restricted", "inst_kessock", True), "f16_safe_ids": lambda g: safe_ids(g.docs.select("archive_ref").where("archive_ref IS NOT NULL").distinct(), "archive_ref"),
    "a19_scan_batch": lambda g: scan_batch(g, "inst_tamarn").select("claim_id", "claim_type"), "r6_scan": lambda g: scanned(_texts(g)), "r6_summary": lambda g: scan_summary(_texts(g), scanned(_texts(g))), "r6_after": lambda g: after_scan(_texts(g).withColumn("quarantine_status", F.lit("active")), scanned(_texts(g))).groupBy("quarantine_status", "quarantine_reason").agg(F.count("claim_id").alias("texts")),
}
QUERIES = {name: (lambda spark, d, f=f: f(Graph(spark, d))) for name, f in _BOUND.items()} | {"x9_model_claims": _model_claims, "x22_hybrid_mentions": _hybrid, "q7_admin_scope": all_institutions}
from fieldlore.plans.retrieval import _WITH  # noqa: E402

_TEXTS = "(SELECT doc_id AS claim_id, any_value(clean_text) AS source_sentence FROM document_records WHERE doc_id IS NOT NULL AND clean_text IS NOT NULL GROUP BY 1)"
_FLAGS = " UNION ALL ".join(f"SELECT claim_id, 'pii_exposure' AS issue_class, 'pii_exposure:{label}' AS reason, {sure}::double AS confidence, {sure} >= 0.85 AS quarantine, round(least(1.0, 0.7 * {sure} + 0.3), 6)::double AS priority_score FROM {_TEXTS} WHERE regexp_matches(source_sentence, '{p}')" for label, p, sure in detectors.SENSITIVE)
_norm = lambda c: f"regexp_replace(trim(lower(coalesce({c}, ''))), '\\s+', ' ', 'g')"
ORACLES = {
    "p13_fingerprints": _WITH + "SELECT run_id, substr(sha1(" + " || '||' || ".join(f"regexp_replace(trim(lower(coalesce({c}, '{d}'))), '\\s+', ' ', 'g')" for c, d in (("ocr_engine", "unknown"), ("ocr_version", "unknown"), ("normalizer_version", "v1"))) + " || '||hybrid-rules-llm||hybrid-rules-llm'), 1, 16) AS config_fingerprint FROM runs",
    "p14_run_ids": _WITH + f"SELECT doc_id, 'run_20240301T120000Z_' || substr(sha1({_norm('source_file')}), 1, 8) AS run_id, substr(sha1('unknown||unknown||v1||hybrid-rules-llm||hybrid-rules-llm'), 1, 16) AS config_fingerprint FROM (SELECT DISTINCT doc_id, source_file FROM docs)",
    "d23_flagged": _WITH + "SELECT doc_id, 'restricted' AS access_level, 'inst_kessock' AS institution_id, true AS donor_restricted FROM docs",
    "f16_safe_ids": _WITH + "SELECT DISTINCT archive_ref FROM docs WHERE regexp_full_match(archive_ref, '[A-Za-z0-9][A-Za-z0-9_.:-]*') AND length(archive_ref) <= 128 AND NOT contains(archive_ref, '..')",
    "a19_scan_batch": _WITH + "SELECT claim_id, claim_type FROM claim WHERE coalesce(quarantine_status, 'active') = 'active' AND run_id IN (SELECT run_id FROM runs JOIN docs USING (doc_id) WHERE institution_id = 'inst_tamarn')",
    "r6_scan": _FLAGS,
    "r6_summary": f"SELECT (SELECT count(*) FROM {_TEXTS}) AS scanned, count(DISTINCT claim_id) AS flagged, count(*) FILTER (quarantine) AS quarantined, count(*) AS proposals_created FROM ({_FLAGS})",
    "r6_after": f"SELECT CASE WHEN reason IS NULL THEN 'active' ELSE 'quarantined' END AS quarantine_status, reason AS quarantine_reason, count(*) AS texts FROM {_TEXTS} LEFT JOIN (SELECT claim_id, min(reason) AS reason FROM ({_FLAGS}) WHERE quarantine GROUP BY 1) USING (claim_id) GROUP BY 1, 2",
    "x9_model_claims": _WITH + "SELECT claim_id AS paragraph_id, 'fire_incident' AS claim_type, s AS sentence, 0.8::double AS extraction_confidence FROM (SELECT claim_id, unnest(string_split_regex(regexp_replace(trim(source_sentence), '([.!?]) ', '\\1\x01', 'g'), '\x01')) AS s FROM claim) WHERE regexp_matches(s, '(?i)\\b(fire|burned)\\b')",
    "x22_hybrid_mentions": _WITH + "SELECT CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 'hybrid' WHEN r IS NULL THEN m.src ELSE r.src END AS detection_source, count(*) AS mentions, round(sum(CASE WHEN r IS NULL OR m.conf > r.conf THEN m.conf ELSE r.conf END), 4) AS confidence FROM (SELECT paragraph_id, start_offset, end_offset, arg_max({'conf': detection_confidence, 'src': detection_source}, detection_confidence) FILTER (detection_source = 'seed_lexicon') AS r, arg_max({'conf': detection_confidence, 'src': detection_source}, detection_confidence) FILTER (detection_source <> 'seed_lexicon') AS m FROM mention WHERE surface_form IS NOT NULL AND start_offset IS NOT NULL AND detection_source IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1",
    "q7_admin_scope": _WITH + "SELECT institution_id, count(DISTINCT doc_id) AS documents FROM docs WHERE institution_id IS NOT NULL AND access_level IN ('public', 'staff_only') AND deleted_at IS NULL GROUP BY 1",
}
