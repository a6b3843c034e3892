"""Queries of the small operators, each over whole tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.functions import text
from fieldlore.operators import derivation, extraction, resolution
from fieldlore.plans import planner
from fieldlore.plans.graph import Graph
from fieldlore.review import detectors, store
from fieldlore.session import scratch
from fieldlore.sources import files, warehouse

# -- text functions (P1, P2, P7, P8, F13 to F15, Q6, X24) ------------------------------------------------------------------


def normalized_pages(g: Graph) -> DataFrame:
    return g._table("report_pages").select("page_id", text.normalize_text(F.col("raw_ocr_text")).alias("clean_text")).where("clean_text IS NOT NULL").distinct()


def headings(g: Graph) -> DataFrame:
    return g.docs.select("doc_id", text.normalize_heading(F.col("title")).alias("heading")).distinct()


def file_years(g: Graph) -> DataFrame:
    return g.docs.select("doc_id", text.year_in_filename(F.col("source_file")).alias("year"), text.report_year(F.lit(None).cast("int"), F.col("date_start"), F.col("source_file")).alias("report_year")).distinct()


def garbage(g: Graph) -> DataFrame:
    return g._table("report_pages").select("page_id", text.is_garbage(F.col("raw_ocr_text")).alias("garbage")).distinct()


def contexts_safe(g: Graph) -> DataFrame:
    return g._table("documents").select("doc_id", text.safe_context(F.col("text")).alias("safe"))


def queries_escaped(g: Graph) -> DataFrame:
    return g.claims.select("claim_id", text.escape_query(F.col("source_sentence"), 60).alias("query"))


def blocks(g: Graph) -> DataFrame:
    at = g.active_claims.select("claim_id", "claim_type", "doc_id", "extraction_confidence", F.col("source_sentence").alias("text"))
    return planner.rendered(at.withColumn("tier", planner.tier(F.col("extraction_confidence"))))


#: Confusions of the query for variants of names: what stands, what a scan shows, how often (values of this module).
SHOWN = (("m", "rn", 0.3), ("l", "1", 0.2), ("o", "0", 0.2), ("h", "li", 0.1), ("e", "c", 0.15))


def variants(g: Graph) -> DataFrame:
    return extraction.ocr_variants(g.entities.where("entity_type = 'Species'"), SHOWN)


# -- claims of rules and of a model (X10, J10, J11) --------------------------------------------------------------------------


def hybrid_claims(g: Graph) -> DataFrame:
    """The certain claims as those of rules, the uncertain ones with another confidence as those of a model."""
    rows = g.claims.select("paragraph_id", F.col("source_sentence").alias("sentence"), "claim_type", "extraction_confidence").groupBy("paragraph_id", "sentence").agg(F.min("claim_type").alias("claim_type"), F.max("extraction_confidence").alias("extraction_confidence"))
    rules = rows.where("claim_type <> 'fire_incident'")
    model = rows.where("claim_type <> 'economic_use'").withColumn("extraction_confidence", 1 - F.col("extraction_confidence") / 2).withColumn("claim_type", F.lit("told"))
    return extraction.hybrid(rules, model)


def unseen(g: Graph) -> DataFrame:
    """The documents that no run has read."""
    return files.not_yet(g.docs.select("doc_id"), g.runs.where("ocr_version LIKE '%1%'").select("doc_id"), "doc_id").distinct()


# -- resolution and derivation (D6 to D8, D10, D19, D21, J6, F17) ---------------------------------------------------------------


def supplemented(g: Graph) -> DataFrame:
    """The people of the vocabulary, then everything else as what a graph adds."""
    names = g.entities.select("entity_type", text.normalize_name(F.col("name")).alias("normalized_form"), F.length("name").cast("bigint").alias("seed_order")).groupBy("entity_type", "normalized_form").agg(F.min("seed_order").alias("seed_order"))
    return resolution.supplemented(names.where("entity_type = 'Person'"), names)


def priors(g: Graph) -> DataFrame:
    """Exact mentions as resolutions, in the order of the documents' years."""
    named = g.entities.select("entity_id", F.lower("name").alias("normalized_form"))
    at = g.runs.select("run_id", "doc_id").join(g.docs.select("doc_id", "report_year").where("report_year IS NOT NULL").distinct(), "doc_id")
    found = g.mentions.where("normalized_form IS NOT NULL AND mention_id IS NOT NULL").select("mention_id", "run_id", "normalized_form").join(named, "normalized_form").join(at, "run_id").withColumn("relation_type", F.lit("REFERS_TO"))
    return resolution.frequency_prior(found, "report_year")


def paragraph_contexts(g: Graph) -> DataFrame:
    return resolution.contexts(g.claims).select("paragraph_id", F.array_join("claim_types", "|").alias("claim_types"))


def links_in_spans(g: Graph) -> DataFrame:
    """Every mention's form as a link of its paragraph's claims, settled by the nearest mention that is an entity."""
    named = g.entities.select("entity_id", "entity_type", F.lower("name").alias("normalized_form"))
    hits = g.mentions.where("normalized_form IS NOT NULL AND start_offset IS NOT NULL").select("paragraph_id", "start_offset", "end_offset", "normalized_form").distinct()
    found = hits.join(named, "normalized_form")
    claims = g.claims.select("claim_id", "paragraph_id", F.lit(0).alias("evidence_start"), F.length("source_sentence").alias("evidence_end"))
    links = claims.join(hits, "paragraph_id").withColumn("type_hint", F.when(F.col("normalized_form").endswith("lake"), "Place"))
    return derivation.cascade(links, found)


def within(g: Graph) -> DataFrame:
    """Places whose name holds another place's first word belong to the county of that word."""
    places = g.entities.where("entity_type = 'Place'")
    return derivation.hierarchy(places, F.concat(F.lit("county:"), F.lower(F.regexp_extract("name", r"^(\w+)", 1))))


def gated_texts(g: Graph) -> DataFrame:
    """Transcripts with personal data that is sure, quarantined."""
    rows = g._table("document_records").where("doc_id IS NOT NULL AND clean_text IS NOT NULL").groupBy("doc_id").agg(F.min("clean_text").alias("source_sentence")).withColumnRenamed("doc_id", "claim_id").withColumn("quarantine_status", F.lit("active"))
    detect = lambda claims: detectors.sensitive(claims).select(F.col("target_id").alias("claim_id"), "confidence")
    return derivation.gated(rows, detect, 0.9).select("claim_id", "quarantine_status", "quarantine_reason")


def contracted(g: Graph) -> DataFrame:
    """edges under a contract that knows no weather, renames fires and allows three types of entities."""
    rows = g.edges.join(g.claims.select("claim_id", "claim_type"), "claim_id").select("claim_id", "entity_id", "entity_type", "claim_type", "relation_type")
    out = derivation.contracted(rows, ("population_estimate", "economic_use", "burning"), ("SPECIES_FOCUS", "OCCURRED_AT"), ("Species", "Place", "Person"), renames={"fire_incident": "burning"})
    return out.groupBy("claim_type", "relation_type").agg(F.count("entity_id").alias("links"))


# -- the store of the review (R11 to R13, R16, W9, J15, S18) ----------------------------------------------------------------------


def _proposals(g: Graph) -> DataFrame:
    """Events of the log as proposals: a key's calls with their last state."""
    e = g._table("events")
    return e.groupBy("user_id").agg(F.min("event_id").alias("n"), F.round(F.max("value"), 4).alias("confidence")).select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("proposal_id"), F.lit("queued").alias("status"), F.lit("2024-01-01").alias("created_at"), "confidence")


def _actions(g: Graph) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "defer").when(F.col("event_type") == "view", "edit")
    rows = g._table("events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("proposal_id"), action.alias("action"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "event_id", F.col("props").alias("patch"))
    return rows.where("action IS NOT NULL")


def upserted(g: Graph) -> DataFrame:
    """Half of the proposals are stored under another status, the others are new."""
    p = _proposals(g)
    stored = p.where("confidence >= 98").withColumn("status", F.lit("deferred")).withColumn("created_at", F.lit("2023-01-01"))
    return store.upsert(stored, p.where("confidence < 99")).select("proposal_id", "status", "created_at", "confidence")


def after_actions(g: Graph) -> DataFrame:
    """R12."""
    return store.applied(_proposals(g), _actions(g)).select("proposal_id", "status")


def revised(g: Graph) -> DataFrame:
    """W9."""
    return store.revisions(_actions(g))


def overridden(g: Graph) -> DataFrame:
    """Calls as targets, the newest error or view of each decides whether it stays."""
    e = g._table("events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("proposal_id"), F.col("event_type").alias("target_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "event_id", "value")
    return store.included(e.select("proposal_id", "target_id").distinct(), e.select("proposal_id", "target_id", "created_at", "event_id", (F.col("value") >= 50).alias("included")).where("target_id <> 'click'"))


def training(g: Graph) -> DataFrame:
    """Decided proposals with their newest patch's number."""
    newest = store.revisions(_actions(g)).select("proposal_id", "patch")
    rows = store.training_rows(_proposals(g).join(newest, "proposal_id", "left"), _actions(g))
    return rows.select("proposal_id", "action", F.variant_get("patch", "$.k", "int").alias("k"))


# -- files (S1, S3 to S6, S10, S19) ---------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark, 'files')}/data"


def reports_read(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pages written as reports of one JSON each and read again."""
    g = Graph(spark, d)
    once = g._table("report_pages").where("doc_id IS NOT NULL AND page_number IS NOT NULL").groupBy("doc_id", "page_number").agg(F.max("raw_ocr_text").alias("raw_ocr_text"), F.max("ocr_confidence").alias("ocr_confidence"))
    pages = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "raw_ocr_text", "ocr_confidence"))).alias("pages"))
    meta = g.docs.groupBy("doc_id").agg(F.max("title").alias("title"), F.max("report_year").alias("report_year"))
    out = _folder(spark)
    meta.join(pages, "doc_id").select(F.to_json(F.struct(F.struct("doc_id", "title", "report_year").alias("metadata"), "pages")).alias("value")).write.text(out)
    raw = spark.read.schema(files.REPORT).json(out).withColumn("path", F.lit("x.json"))
    return files.pages(files.documents(raw)).select("doc_id", "page_number", F.length("raw_ocr_text").alias("characters"), "ocr_confidence")


def bundled(spark: SparkSession, d: str) -> DataFrame:
    """Claims and measurements nested by run, written, read and taken apart."""
    g = Graph(spark, d)
    out = _folder(spark)
    files.bundles({"claims": g.claims.select("run_id", "claim_id", "claim_type"), "measurements": g.measurements.select("run_id", "measurement_id")}, "run_id").write.json(out)
    again = spark.read.schema("run_id string, claims array<struct<claim_id: string, claim_type: string>>, measurements array<struct<measurement_id: string>>").json(out)
    return files.unbundled(again, "run_id", "claims")


def as_csv(spark: SparkSession, d: str) -> DataFrame:
    """Mentions (with lists) and claims (without) under one header, read again."""
    g = Graph(spark, d)
    m = g._table("mention_drafts").where("surface_form IS NOT NULL AND surface_form <> ''").select("mention_id", "surface_form", "entity_type_hints").distinct()
    c = g.claims.select("claim_id", F.struct("claim_type", "epistemic_status").alias("kind"))
    out = _folder(spark)
    files.write_csv([m, files.flattened(c)], out)
    return spark.read.csv(out, header=True, escape='"', multiLine=True).select("mention_id", "claim_id", "`kind.claim_type`", F.size(F.from_json("entity_type_hints", "array<string>")).alias("hints")).withColumnRenamed("kind.claim_type", "claim_type")


def vocabulary_read(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary as one CSV in its order, read as entities with their properties."""
    g = Graph(spark, d)
    rows = g._table("seed_entities").where("entity_type IS NOT NULL AND name IS NOT NULL AND trim(name) = name AND prop_key IS NOT NULL AND trim(prop_key) = prop_key AND prop_key <> '' AND prop_value IS NOT NULL AND trim(prop_value) = prop_value AND prop_value <> ''")
    out = _folder(spark)
    # the file is small and in order: one part
    rows.orderBy("seed_row").select("entity_type", "name", "prop_key", "prop_value").coalesce(1).write.csv(out, header=True, escape='"')
    read = files.vocabulary(spark, out)
    return read.select("entity_type", "name", F.size("properties").alias("properties"))


def lines_read(spark: SparkSession, d: str) -> DataFrame:
    """Keys appended twice as lines, broken ones between them skipped."""
    g = Graph(spark, d)
    out = _folder(spark)
    for kind in ("fire_incident", "economic_use"):
        warehouse.append_lines(g.claims.where(F.col("claim_type") == kind).select("claim_id", "claim_type"), out)
    g.claims.where("claim_type = 'economic_use'").select(F.concat(F.lit("{broken "), "claim_id").alias("value")).write.mode("append").text(out)
    return files.lines(spark, out, "claim_id string, claim_type string")


def exported(g: Graph) -> DataFrame:
    """The newest patches of what is accepted, with the number of revisions and events of each."""
    p = store.applied(_proposals(g), _actions(g)).withColumn("issue_class", F.lit("c")).withColumn("proposal_type", F.lit("t")).withColumn("priority_score", F.col("confidence") / 200)
    edits = _actions(g).where("action = 'edit'").select("proposal_id", F.col("event_id").alias("revision_number"), F.lit("edited").alias("revision_kind"), "patch")
    patches = warehouse.accepted_patches(p, edits)
    full = warehouse.revision_history(p.select("proposal_id"), edits, _actions(g)).select("proposal_id", F.size("revisions").alias("revisions"), F.size("correction_events").alias("events"))
    return patches.join(full, "proposal_id").select("proposal_id", "patch_spec", "revisions", "events")


_BOUND = {
    "text_normalized": normalized_pages, "text_headings": headings, "text_file_years": file_years, "f13_garbage": garbage, "f14_safe": contexts_safe, "f15_escaped": queries_escaped, "q6_blocks": blocks, "x24_variants": variants, "x10_hybrid": hybrid_claims, "j11_unseen": unseen,
    "d6_supplemented": supplemented, "d7_priors": priors, "d8_contexts": paragraph_contexts, "d10_cascade": links_in_spans, "d19_hierarchy": within, "d21_gated": gated_texts, "f17_contracted": contracted,
    "r11_upserted": upserted, "r12_applied": after_actions, "w9_revisions": revised, "r16_included": overridden, "r13_training": training, "s18_exported": exported,
}
QUERIES = {name: (lambda spark, d, f=f: f(Graph(spark, d))) for name, f in _BOUND.items()} | {"s1_reports": reports_read, "s4_bundles": bundled, "s5_csv": as_csv, "s10_vocabulary": vocabulary_read, "s19_lines": lines_read}
from fieldlore.plans.retrieval import _WITH  # noqa: E402

_trimmed = r"regexp_replace({}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_clean = r"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace({}, '\r\n', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> ''), chr(10)), '[ \t]+', ' ', 'g'), ' ')"
_stem = r"regexp_replace(regexp_replace(source_file, '^.*/', ''), '(.)\.[^.]*$', '\1')"
# DuckDB's patterns look at nothing around them: runs of digits are taken out whole and their length is checked
_runs = rf"list_filter(regexp_extract_all({_stem}, '\d+'), lambda x: regexp_full_match(x, '{{}}'))"
_year = rf"coalesce(try_cast(substr({_runs.format('(1[89][0-9][0-9]|20[0-2][0-9])[0-9][0-9]')}[1], 1, 4) AS int), list_min(list_transform({_runs.format('(1[89][0-9][0-9]|20[0-2][0-9])')}, lambda x: x::int)))"
_ORDER = "(created_at, event_id)"
_ACT = "act AS (SELECT 'p' || user_id AS proposal_id, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'defer' WHEN 'view' THEN 'edit' END AS action, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, event_id, props AS patch FROM events WHERE event_type IN ('purchase', 'error', 'signup', 'view')), prop AS (SELECT 'p' || user_id AS proposal_id, round(max(value), 4) AS confidence FROM events GROUP BY 1)"
_moves = " ".join(f"WHEN '{s}|{a}' THEN '{t}'" for (s, a), t in store.MOVES.items())
_APPLIED = f"numbered AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY created_at, event_id) AS n FROM act), walk AS (SELECT proposal_id, 0::bigint AS n, 'queued' AS status FROM prop UNION ALL SELECT w.proposal_id, w.n + 1, CASE w.status || '|' || a.action {_moves} ELSE w.status END FROM walk w JOIN numbered a ON a.proposal_id = w.proposal_id AND a.n = w.n + 1), state AS (SELECT proposal_id, arg_max(status, n) AS status FROM walk GROUP BY 1)"
ORACLES = {
    "text_normalized": f"SELECT DISTINCT page_id, {_clean.format('raw_ocr_text')} AS clean_text FROM report_pages WHERE raw_ocr_text IS NOT NULL",
    "text_headings": _WITH + f"SELECT DISTINCT doc_id, regexp_replace(lower({_trimmed.format('title')}), '\\s+', ' ', 'g') AS heading FROM docs",
    "text_file_years": _WITH + f"SELECT DISTINCT doc_id, {_year} AS year, coalesce(CASE WHEN regexp_matches(date_start, '^[0-9]{{4}}') THEN substr(date_start, 1, 4)::int END, {_year}) AS report_year FROM docs",
    "f13_garbage": "SELECT DISTINCT page_id, regexp_matches(raw_ocr_text, '[\\^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS garbage FROM report_pages",
    "f14_safe": f"SELECT doc_id, CASE WHEN regexp_matches(text, '{text.INJECTION}') THEN '[content withheld]' ELSE replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') END AS safe FROM documents",
    "f15_escaped": _WITH + "SELECT claim_id, regexp_replace(substr(trim(source_sentence), 1, 60), '([+\\-!(){}\\[\\]^\"~*?:\\\\/]|&&|\\|\\|)', '\\\\\\1', 'g') AS query FROM claim",
    "q6_blocks": _WITH + "SELECT claim_id, '[' || CASE WHEN extraction_confidence >= 0.85 THEN 'HIGH' WHEN extraction_confidence >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END || '] ' || claim_type || chr(10) || source_sentence || chr(10) || 'source: ' || doc_id AS block FROM act",
    "x24_variants": _WITH + "SELECT name, variant, max(p) AS probability FROM (SELECT name, substr(name, 1, i::int - 1) || shown || substr(name, i::int + length(original)) AS variant, p FROM (SELECT DISTINCT name FROM entity WHERE entity_type = 'Species'), range(1, 200) r(i), (VALUES " + ", ".join(f"('{a}', '{b}', {p}::double)" for a, b, p in SHOWN) + ") AS c(original, shown, p) WHERE i <= length(name) AND substr(name, i::int, length(original)) = original) GROUP BY 1, 2",
    "x10_hybrid": _WITH + ", once AS (SELECT paragraph_id, source_sentence AS sentence, min(claim_type) AS claim_type, max(extraction_confidence) AS extraction_confidence FROM claim GROUP BY 1, 2), a AS (SELECT * FROM once WHERE claim_type <> 'fire_incident'), b AS (SELECT paragraph_id, sentence, 'told' AS claim_type, 1 - extraction_confidence / 2 AS extraction_confidence FROM once WHERE claim_type <> 'economic_use') SELECT coalesce(a.paragraph_id, b.paragraph_id) AS paragraph_id, coalesce(a.sentence, b.sentence) AS sentence, CASE WHEN a.sentence IS NULL OR b.extraction_confidence > a.extraction_confidence THEN b.claim_type ELSE a.claim_type END AS claim_type, CASE WHEN a.sentence IS NULL OR b.extraction_confidence > a.extraction_confidence THEN b.extraction_confidence ELSE a.extraction_confidence END AS extraction_confidence, CASE WHEN a.sentence IS NULL THEN 'model' WHEN b.sentence IS NULL THEN 'rules' WHEN b.extraction_confidence > a.extraction_confidence THEN 'model_over_rules' ELSE 'rules_over_model' END AS extraction_source FROM a FULL JOIN b ON a.paragraph_id = b.paragraph_id AND a.sentence = b.sentence",
    "j11_unseen": _WITH + "SELECT DISTINCT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM runs WHERE ocr_version LIKE '%1%' AND doc_id IS NOT NULL)",
    "d6_supplemented": _WITH + ", n AS (SELECT entity_type, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9\\s\\-]', '', 'g'), '\\s+', ' ', 'g') AS normalized_form, min(length(name))::bigint AS seed_order FROM entity GROUP BY 1, 2) SELECT entity_type, normalized_form, CASE WHEN entity_type = 'Person' THEN seed_order ELSE seed_order + 1099511627776 END AS seed_order FROM n",
    "d7_priors": _WITH + ", own AS (SELECT entity_id, doc_id, report_year, count(mention_id) AS own FROM mention JOIN entity ON lower(name) = normalized_form JOIN runs USING (run_id) JOIN (SELECT DISTINCT doc_id, report_year FROM docs WHERE report_year IS NOT NULL) USING (doc_id) WHERE mention_id IS NOT NULL GROUP BY 1, 2, 3) SELECT doc_id, entity_id, coalesce(sum(own) OVER (PARTITION BY entity_id ORDER BY report_year, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS n FROM own",
    "d8_contexts": _WITH + "SELECT paragraph_id, string_agg(DISTINCT claim_type, '|' ORDER BY claim_type) AS claim_types FROM claim GROUP BY 1",
    "d10_cascade": _WITH + ", hit AS (SELECT DISTINCT paragraph_id, start_offset, end_offset, normalized_form FROM mention WHERE normalized_form IS NOT NULL AND start_offset IS NOT NULL), found AS (SELECT hit.*, entity_id, entity_type FROM hit JOIN entity ON lower(name) = normalized_form), link AS (SELECT claim_id, c.paragraph_id, length(source_sentence) AS till, start_offset, end_offset, normalized_form, CASE WHEN suffix(normalized_form, 'lake') THEN 'Place' END AS hint FROM claim c JOIN hit USING (paragraph_id)), met AS (SELECT l.*, m.entity_id, CASE WHEN l.start_offset = m.start_offset AND l.end_offset = m.end_offset THEN 1 WHEN l.normalized_form = m.normalized_form THEN 2 WHEN m.start_offset >= 0 AND m.end_offset <= till THEN 3 ELSE 4 END AS tier FROM link l LEFT JOIN found m ON m.paragraph_id = l.paragraph_id WHERE m.entity_id IS NULL OR hint IS NULL OR m.entity_type = hint), per AS (SELECT claim_id, start_offset, end_offset, normalized_form, tier, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM met GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT entity_id) > 0), near AS (SELECT claim_id, start_offset, end_offset, normalized_form, min(tier) AS tier, arg_min(n, tier) AS n, arg_min(entity_id, tier) AS entity_id FROM per GROUP BY 1, 2, 3, 4) SELECT claim_id, start_offset, end_offset, normalized_form, CASE WHEN n = 1 THEN entity_id END AS entity_id, tier, CASE WHEN n IS NULL THEN 'NO_RESOLVED_MENTION' WHEN n > 1 THEN 'AMBIGUOUS_FALLBACK' END AS diagnostic_code FROM (SELECT DISTINCT claim_id, start_offset, end_offset, normalized_form FROM link) LEFT JOIN near USING (claim_id, start_offset, end_offset, normalized_form)",
    "d19_hierarchy": _WITH + "SELECT entity_id AS child_entity_id, 'county:' || lower(regexp_extract(name, '^(\\w+)', 1)) AS parent_entity_id, 'PART_OF' AS relation_type FROM entity WHERE entity_type = 'Place'",
    "d21_gated": "SELECT claim_id, CASE WHEN sure THEN 'quarantined' ELSE 'active' END AS quarantine_status, CASE WHEN sure THEN 'sensitivity' END AS quarantine_reason FROM (SELECT claim_id, " + " OR ".join(f"regexp_matches(t, '{p}')" for _, p, c in detectors.SENSITIVE if c >= 0.9) + " AS sure FROM (SELECT doc_id AS claim_id, min(clean_text) AS t FROM document_records WHERE doc_id IS NOT NULL AND clean_text IS NOT NULL GROUP BY 1))",
    "f17_contracted": _WITH + "SELECT CASE claim_type WHEN 'fire_incident' THEN 'burning' WHEN 'population_estimate' THEN claim_type WHEN 'economic_use' THEN claim_type ELSE 'unclassified_assertion' END AS claim_type, CASE WHEN relation_type IN ('SPECIES_FOCUS', 'OCCURRED_AT') THEN relation_type ELSE 'TOPIC_OF_CLAIM' END AS relation_type, count(*) AS links FROM edge JOIN claim USING (claim_id) WHERE entity_type IN ('Species', 'Place', 'Person') GROUP BY 1, 2",
    "r11_upserted": f"WITH {_ACT} SELECT proposal_id, CASE WHEN confidence >= 98 THEN 'deferred' ELSE 'queued' END AS status, CASE WHEN confidence >= 98 THEN '2023-01-01' ELSE '2024-01-01' END AS created_at, confidence FROM prop",
    "r12_applied": f"WITH RECURSIVE {_ACT}, {_APPLIED} SELECT proposal_id, status FROM state",
    "w9_revisions": f"WITH {_ACT} SELECT proposal_id, arg_max(patch, {_ORDER}) AS patch, count(*) + 1 AS next_revision FROM act WHERE action = 'edit' GROUP BY 1",
    "r16_included": "SELECT proposal_id, target_id FROM (SELECT 'p' || user_id AS proposal_id, event_type AS target_id, arg_max(value >= 50, (strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_id)) AS included FROM events GROUP BY 1, 2) WHERE target_id = 'click' OR included",
    "r13_training": f"WITH {_ACT} SELECT proposal_id, action, k FROM (SELECT proposal_id, arg_max(action, {_ORDER}) AS action FROM act WHERE action IN ('accept', 'reject') GROUP BY 1) LEFT JOIN (SELECT proposal_id, try_cast(json_extract_string(arg_max(patch, {_ORDER}), '$.k') AS int) AS k FROM act WHERE action = 'edit' GROUP BY 1) USING (proposal_id)",
    "s18_exported": f"WITH RECURSIVE {_ACT}, {_APPLIED} SELECT proposal_id, patch_spec, revisions, events FROM (SELECT proposal_id FROM state WHERE status = 'accepted_pending_apply') JOIN (SELECT proposal_id, arg_max(patch, event_id) AS patch_spec, count(*)::int AS revisions FROM act WHERE action = 'edit' GROUP BY 1) USING (proposal_id) JOIN (SELECT proposal_id, count(*)::int AS events FROM act GROUP BY 1) USING (proposal_id)",
    "s1_reports": "SELECT doc_id, page_number, length(max(raw_ocr_text))::int AS characters, max(ocr_confidence) AS ocr_confidence FROM report_pages WHERE page_number IS NOT NULL AND doc_id IN (SELECT doc_id FROM document_records) GROUP BY 1, 2",
    "s4_bundles": _WITH + "SELECT run_id, claim_id, claim_type FROM claim",
    "s5_csv": _WITH + "SELECT mention_id, NULL AS claim_id, NULL AS claim_type, len(entity_type_hints)::int AS hints FROM (SELECT DISTINCT mention_id, surface_form, entity_type_hints FROM mention_drafts WHERE surface_form IS NOT NULL AND surface_form <> '') UNION ALL SELECT NULL, claim_id, claim_type, NULL FROM claim",
    "s10_vocabulary": "SELECT entity_type, name, count(DISTINCT prop_key)::int AS properties FROM seed_entities WHERE entity_type IS NOT NULL AND trim(name) = name AND trim(prop_key) = prop_key AND prop_key <> '' AND trim(prop_value) = prop_value AND prop_value <> '' GROUP BY 1, 2",
    "s19_lines": _WITH + "SELECT claim_id, claim_type FROM claim WHERE claim_type IN ('fire_incident', 'economic_use')",
}
