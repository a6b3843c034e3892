"""Detectors of defects in the graph, and the routing of what they propose.

Every detector returns proposals: issue_class, proposal_type, target_kind, target_id, group_key, confidence, reason.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldlore.functions import ids
from fieldlore.functions.text import PERSONAL


PROPOSAL = ["issue_class", "proposal_type", "target_kind", "target_id", "group_key", "confidence", "reason"]
SIMILAR = 0.82
#: How a running head looks: a page number alone or with its word, or a line without any small letter.
HEADER = r"^(?i:page|p\.|sheet)?\s*[-–(]?\s*\d{1,4}\s*[-–)]?\s*$|^[^a-z]{4,60}$"
#: What forms print around a report (own list of this operator).
FORM_WORDS = ("signed by", "filed by", "received by", "prepared by", "submitted by", "approved by", "copy to", "copies to", "carbon copy", "enclosure", "attachment", "contents", "index of", "form no", "signature", "date filed")
BOILERPLATE = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in FORM_WORDS) + r")\b\s*[:.]?"
#: Words that name nothing (own list of this operator).
GENERIC = (
    "this", "that", "these", "those", "such", "what", "which", "they", "them", "their", "there", "here",
    "have", "been", "were", "will", "would", "could", "should", "does", "made", "used", "seen",
    "with", "from", "into", "onto", "over", "under", "near", "after", "before", "about", "during", "between",
    "each", "every", "both", "some", "many", "much", "more", "most", "only", "also", "very", "well", "same", "other",
    "time", "year", "month", "week", "area", "work", "page", "note", "number", "total", "good", "high", "last",
)
#: How sure each kind of personal data is (fixed values); the patterns are those of functions.text.
SURE = {"ssn": 0.92, "date_of_birth": 0.92, "phone": 0.85, "email": 0.85, "address": 0.85}
SENSITIVE = tuple((label, PERSONAL[label], sure) for label, sure in SURE.items())


def _proposal(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*[(columns[c] if isinstance(columns.get(c), Column) else F.lit(columns[c]) if c in columns else F.col(c)).alias(c) for c in PROPOSAL])


def ocr_fold(name: Column) -> Column:
    return functools.reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (("rn", "m"), ("li", "h"), ("0", "o"), ("1", "l")), F.lower(name))


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """anchor, member, score: what taking the names in order gives, each free name becoming an anchor that takes the
    free names similar to it (pairs: a < b, score). Done in rounds: a name without a smaller free neighbour is an
    anchor and frees its neighbours from being one; each round decides all names whose turn is known."""
    from fieldlore.session import cut

    pairs = cut(pairs.select("a", "b", "score"))
    free, taken = pairs, None
    while free.limit(1).count():
        now = free.select(F.col("a").alias("x")).distinct().join(free.select(F.col("b").alias("x")).distinct(), "x", "left_anti")
        mine = cut(free.join(now, F.col("a") == F.col("x")).select("x", "b"))
        lost = mine.select(F.col("b").alias("x")).distinct()
        taken = lost if taken is None else taken.unionByName(lost)
        gone = lost.union(mine.select("x").distinct())
        free = cut(free.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"))
    if taken is None:
        return pairs.selectExpr("a AS anchor", "b AS member", "score")
    # what no anchor took is an anchor itself
    anchors = pairs.select(F.col("a").alias("x")).distinct().join(taken, "x", "left_anti")
    # no two anchors are neighbours, and a name goes to the first of the anchors before it
    return pairs.join(anchors, F.col("a") == F.col("x")).groupBy(F.col("b").alias("member")).agg(F.min("a").alias("anchor"), F.min_by("score", "a").alias("score")).select("anchor", "member", "score")


def entity_groups(entities: DataFrame, least: float = SIMILAR) -> DataFrame:
    """entity_type, anchor, entity_id, score. Pairs are sought among names of one type and near length that
    share three letters in a row (short names two): with 82 % of the letters in matching blocks some block is that long."""
    base = entities.select("entity_type", "entity_id", F.lower("name").alias("form")).where("form <> ''")
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("form") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("form"), i, F.lit(n)))
    grams = F.array_distinct(F.when(F.length("form") <= 7, F.concat(of_size(3), of_size(2))).otherwise(of_size(3)))
    keyed = base.withColumn("gram", F.explode(grams))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.abs(F.length("a.form") - F.length("b.form")) <= 0.36 * F.greatest(F.length("a.form"), F.length("b.form"))
    met = a.join(b, (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.entity_id") < F.col("b.entity_id")) & near)
    pairs = met.select(F.col("a.entity_type").alias("entity_type"), F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), F.col("a.form").alias("fa"), F.col("b.form").alias("fb")).distinct()
    rated = pairs.withColumn("score", ratio_udf("fa", "fb")).where(F.col("score") >= least)
    groups = greedy_groups(rated.select("a", "b", "score"))
    members = groups.select("anchor", F.col("member").alias("entity_id"), "score").unionByName(groups.select("anchor", F.col("anchor").alias("entity_id"), F.lit(1.0).alias("score")).distinct())
    return members.join(entities.select("entity_id", "entity_type").distinct(), "entity_id").select("entity_type", "anchor", "entity_id", "score")


@F.pandas_udf(DoubleType())
def ratio_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    import difflib

    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ocr_entities(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """A proposal per group: an alias for a pair that scans don't confuse, else a merge into the canonical entity."""
    g = entity_groups(entities).join(entities.select("entity_id", "name"), "entity_id").join(counts.select("entity_id", "n"), "entity_id", "left")
    canonical = F.max_by(F.struct("entity_id", "name"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.length("name").alias("l"), F.col("name").alias("s")))
    by = g.groupBy("entity_type", "anchor").agg(canonical.alias("c"), F.count("entity_id").alias("size"), F.avg(F.when(F.col("score") < 1, F.col("score"))).alias("confidence"), F.count_distinct(ocr_fold(F.col("name"))).alias("folds"))
    alias = (F.col("size") == 2) & (F.col("folds") == 2)
    return _proposal(by, issue_class="ocr_spelling_variant", proposal_type=F.when(alias, "create_alias").otherwise("merge_entities"), target_kind="entity", target_id=F.col("c.entity_id"), group_key=F.col("anchor"), confidence=F.round(F.coalesce("confidence", F.lit(1.0)), 4), reason=F.col("c.name"))


def junk_reason(surface: Column, normalized: Column, paragraph: Column | None = None, edge: Column | None = None) -> Column:
    """The first reason that holds: header, boilerplate, garbage, short or generic."""
    t, f = F.trim(surface), F.lower(F.trim(normalized))
    share = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
    ladder = F.when(F.lit(False), "")
    if paragraph is not None:
        p = F.trim(paragraph)
        ladder = ladder.when((F.length(p) < 10) | (edge & p.rlike(HEADER)), "header_contamination").when(p.rlike(BOILERPLATE), "boilerplate_contamination")
    return ladder.when((t == "") | t.rlike(r"^[^a-zA-Z]*$") | t.rlike(r"^\d{2,}[a-zA-Z]{0,2}$") | ((F.length(t) > 2) & (share < 0.4)), "ocr_garbage").when((F.length(f) < 4) | f.isin(*GENERIC), "short_generic_token")


def junk_mentions(mentions: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """One proposal target per mention that is junk, grouped by reason and document."""
    rows = mentions.where("surface_form IS NOT NULL")
    if paragraphs is not None:
        page = Window.partitionBy("page_id")
        edge = (F.col("paragraph_index") == F.min("paragraph_index").over(page)) | (F.col("paragraph_index") == F.max("paragraph_index").over(page))
        rows = rows.join(paragraphs.withColumn("edge", edge).select("paragraph_id", "clean_text", "edge"), "paragraph_id")
        reason = junk_reason(F.col("surface_form"), F.coalesce("normalized_form", F.lit("")), F.col("clean_text"), F.col("edge"))
    else:
        reason = junk_reason(F.col("surface_form"), F.coalesce("normalized_form", F.lit("")))
    rows = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    low = F.col("reason").isin("header_contamination", "boilerplate_contamination")
    return _proposal(rows, issue_class=F.when(F.col("reason") == "ocr_garbage", "ocr_garbage_mention").otherwise(F.col("reason")), proposal_type="suppress_mention", target_kind="mention", target_id=F.col("mention_id"), group_key=F.concat_ws("|", F.substring_index("paragraph_id", ":", 1), "reason"), confidence=F.when(low, 0.85).otherwise(0.70))


#: Claim types that imply a species, those that imply a place, and those that no survey method belongs to (fixed values).
WITH_SPECIES = ("population_estimate", "species_presence", "species_absence", "breeding_activity", "migration_timing", "predator_control")
WITH_PLACE = ("population_estimate", "species_presence", "species_absence", "breeding_activity", "fire_incident", "habitat_condition", "management_action", "predator_control")
WITHOUT_METHOD = ("fire_incident", "public_contact", "economic_use", "development_activity")


def missing_links(claims: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Claims that lack a species or a place, each with the first candidate: a species of the claim's paragraph; a
    place or refuge of the paragraph, else of the run, which is one document.

    mentions(run_id, paragraph_id, start_offset, entity_id, entity_type): resolved ones, near names included.
    """
    at = ["run_id", "paragraph_id"]
    # numbers of pages have no leading zeros
    first = F.min_by("entity_id", F.struct(F.length("paragraph_id"), "paragraph_id", "start_offset", "entity_id"))
    of = lambda kinds, by, name: mentions.where(F.col("entity_type").isin(*kinds)).groupBy(*by).agg(first.alias(name))
    lacks = lambda types, relation: claims.where(F.col("claim_type").isin(*types)).join(edges.where(F.col("relation_type") == relation).select("claim_id"), "claim_id", "left_anti")
    species = lacks(WITH_SPECIES, "SPECIES_FOCUS").join(of(("Species",), at, "candidate"), at)
    places = ("Place", "Refuge")
    located = lacks(WITH_PLACE, "OCCURRED_AT").join(of(places, at, "near"), at, "left").join(of(places, at[:1], "far"), "run_id", "left").withColumn("candidate", F.coalesce("near", "far")).where("candidate IS NOT NULL")
    link = {"target_kind": "claim", "target_id": F.col("claim_id"), "group_key": F.concat_ws("|", "claim_id", "candidate"), "reason": F.col("candidate")}
    return _proposal(species, issue_class="missing_species_focus", proposal_type="add_claim_entity_link", confidence=0.65, **link).unionByName(_proposal(located, issue_class="missing_event_location", proposal_type="add_claim_location_link", confidence=0.60, **link))


def method_overtrigger(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims of a type that no survey method belongs to but with one; links(claim_id, entity_id, relation_type)."""
    methods = links.where("relation_type = 'METHOD_FOCUS'").select("claim_id", "entity_id").distinct()
    rows = claims.where(F.col("claim_type").isin(*WITHOUT_METHOD)).select("claim_id", "claim_type").join(methods, "claim_id")
    return _proposal(rows, issue_class="method_overtrigger", proposal_type="exclude_claim_from_derivation", target_kind="claim", target_id=F.col("claim_id"), group_key=F.concat_ws("|", "claim_id", "entity_id"), confidence=0.80, reason=F.col("entity_id"))


def context_paragraphs(groups: DataFrame, mentions: DataFrame, paragraphs: DataFrame, counts: DataFrame, most: int = 3, size: int = 2000) -> DataFrame:
    """R2: anchor, place, paragraph_id, raw_ocr_text, clean_text, surface_forms: the first paragraphs that mention the
    entities of a group, the most mentioned entity's before the others', with all surface forms of the group in them.

    groups(anchor, entity_id), mentions(entity_id, paragraph_id, start_offset, surface_form), counts(entity_id, n).
    """
    rows = groups.select("anchor", "entity_id").join(mentions.select("entity_id", "paragraph_id", "start_offset", "surface_form"), "entity_id").join(counts.select("entity_id", "n"), "entity_id", "left")
    order = F.struct(-F.coalesce("n", F.lit(0)), F.col("entity_id"), F.col("paragraph_id"), F.col("start_offset"))
    per = rows.groupBy("anchor", "paragraph_id").agg(F.min(order).alias("order"), F.sort_array(F.collect_set("surface_form")).alias("surface_forms"))
    known = per.join(paragraphs.select("paragraph_id"), "paragraph_id", "left_semi")
    kept = known.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("order"))).where(F.col("place") <= most)
    text = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, size).alias(c)
    return kept.join(paragraphs.select("paragraph_id", text("raw_ocr_text"), text("clean_text")), "paragraph_id").select("anchor", "place", "paragraph_id", "raw_ocr_text", "clean_text", "surface_forms")


def sensitive(claims: DataFrame, vocabulary: tuple[str, ...] = (), text: str = "source_sentence") -> DataFrame:
    """Personal data by its most confident label, and words of a protected vocabulary."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(conf).alias("confidence"), F.lit(-i).alias("order"), F.lit(label).alias("label"))) for i, (label, p, conf) in enumerate(SENSITIVE)]), lambda h: h.isNotNull())
    rows = claims.withColumn("hit", F.array_max(hits)).where("hit IS NOT NULL")
    found = _proposal(rows, issue_class="pii", proposal_type="quarantine_claim", target_kind="claim", target_id=F.col("claim_id"), group_key=F.col("hit.label"), confidence=F.col("hit.confidence"), reason=F.col("hit.label"))
    if not vocabulary:
        return found
    import re

    words = "(?i)\\b(" + "|".join(map(re.escape, vocabulary)) + ")\\b"
    cultural = claims.withColumn("word", F.lower(F.regexp_extract(text, words, 1))).where("word <> ''")
    return found.unionByName(_proposal(cultural, issue_class="protected_vocabulary", proposal_type="quarantine_claim", target_kind="claim", target_id=F.col("claim_id"), group_key=F.col("word"), confidence=0.90, reason=F.col("word")))


def living_people(claims: DataFrame, edges: DataFrame, this_year: int, span: int = 100) -> DataFrame:
    """Claims about people whose latest year is within the span."""
    named = edges.where("entity_type = 'Person'").select("claim_id", "entity_id")
    dated = named.join(claims.select("claim_id", F.substring("claim_date", 1, 4).try_cast("int").alias("year")), "claim_id")
    recent = dated.groupBy("entity_id").agg(F.max("year").alias("last")).where(F.col("last") >= this_year - span)
    rows = dated.join(recent, "entity_id").select("claim_id", "entity_id", "last").distinct()
    return _proposal(rows, issue_class="living_person", proposal_type="quarantine_claim", target_kind="claim", target_id=F.col("claim_id"), group_key=F.col("entity_id"), confidence=0.70, reason=F.col("last").cast("string"))


def priority(confidence: Column, impact: Column, proposal_type: Column, issue_class: Column) -> Column:
    """R8."""
    fifth, tenth = F.least(F.lit(1.0), impact / 5.0), F.least(F.lit(1.0), impact / 10.0)
    score = (
        F.when(proposal_type.isin("merge_entities", "create_alias"), 0.5 * confidence + 0.5 * fifth)
        .when(issue_class.isin("missing_species_focus", "missing_event_location"), 0.7 * confidence + 0.3 * tenth + 0.1)
        .when((proposal_type == "suppress_mention") & issue_class.isin("header_contamination", "boilerplate_contamination"), 0.4 * confidence + 0.2 * tenth)
        .otherwise(0.7 * confidence + 0.3 * tenth)
    )
    return F.round(F.least(F.lit(1.0), score), 6)


def routed(targets: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Targets grouped into proposals with id, impact, priority, status and tier."""
    key = ["issue_class", "proposal_type", "target_kind", "group_key"]
    p = targets.groupBy(*key).agg(F.count_distinct("target_id").alias("impact_size"), F.max("confidence").alias("confidence"), F.min("target_id").alias("first_target"), F.min("reason").alias("reason"))
    auto = (F.col("confidence") >= 0.9) & (F.col("proposal_type") == "suppress_mention") & F.col("reason").isin("ocr_garbage", "short_generic_token")
    status = F.when(F.col("confidence") < 0.5, "rejected").when(auto, "accepted_pending_apply").otherwise("queued")
    tier = F.when(F.col("confidence") < 0.5, "auto_suppressed").when(auto, "auto_accepted").otherwise("needs_review")
    name = F.concat(F.lit("proposal_"), ids.stable_hash(ids.text_part(F.lit(snapshot)), *[ids.text_part(c) for c in key]))
    return p.select(name.alias("proposal_id"), *key, "impact_size", "confidence", "first_target", "reason", priority(F.col("confidence"), F.col("impact_size"), F.col("proposal_type"), F.col("issue_class")).alias("priority_score"), status.alias("status"), tier.alias("review_tier"))


def queue(proposals: DataFrame, offset: int = 0, limit: int = 50, **filters: str) -> DataFrame:
    """Queued proposals by priority, impact and confidence, a page of them."""
    rows = proposals.where("status = 'queued'")
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("priority_score"), F.desc("impact_size"), F.desc("confidence"), "proposal_id").offset(offset).limit(limit)


def similar_terms(tokens: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """For each token the best term of the same initial and near length at or above the threshold."""
    a = tokens.select("token").distinct().withColumn("initial", F.substring("token", 1, 1)).withColumn("size", F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2)))
    b = terms.select("term").distinct().withColumn("initial", F.substring("term", 1, 1)).withColumn("size", F.length("term"))
    met = a.join(b, ["initial", "size"]).where("token <> term").withColumn("ratio", ratio_udf("token", "term")).where(F.col("ratio") >= least)
    return met.groupBy("token").agg(F.max_by("term", F.struct("ratio", "term")).alias("suggestion"), F.max("ratio").alias("ratio"))


def spelling_queue(claims: DataFrame, terms: DataFrame, least: float = 0.84) -> DataFrame:
    """Tokens of claims' sentences that look misspelled, with a suggestion and a severity."""
    words = F.regexp_extract_all("source_sentence", F.lit(r"([A-Za-z][A-Za-z0-9'-]*)"), F.lit(1))
    tokens = claims.select("claim_id", F.explode(words).alias("surface")).withColumn("token", F.lower("surface")).where("length(token) >= 4")
    known = terms.select(F.col("term").alias("token")).distinct()
    unknown = tokens.join(known, "token", "left_anti")
    digit = F.col("token").rlike(r"(?<=[a-z])[0-9]|[0-9](?=[a-z])")
    confused = F.col("token").contains("rn") & ~F.col("token").contains("m")
    suggested = unknown.join(similar_terms(unknown, terms, least), "token", "left")
    rows = suggested.withColumn("digit", digit).withColumn("confused", confused).where("digit OR suggestion IS NOT NULL")
    severity = F.when(F.col("suggestion").isNotNull() & F.col("digit"), "high").when(F.col("digit") | F.col("confused"), "medium").otherwise("low")
    return rows.groupBy("claim_id", "token").agg(F.min("surface").alias("suspect_text"), F.max("suggestion").alias("suggested_correction"), F.min(severity).alias("severity"))


