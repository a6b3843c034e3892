"""Links from claims' sentences, audits, samples, validation of rules, planning of model calls, calibration."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlore.functions import ids
from fieldlore.functions.text import normalize_name
from fieldlore.operators import extraction, resolution
from fieldlore.plans.graph import OTHER_RELATION, ROLE_POLICY, Graph
from fieldlore.session import small_or_plain

# -- links of claims (X6 to X8) ----------------------------------------------------------------------------------

#: Verbs and prepositions before a place where something happened (fixed values).
HAPPENED_VERBS = ("observed", "found", "seen", "collected", "taken", "trapped", "nested", "wintered", "came", "arrived", "occurred", "burned", "happened", "departed")
HAPPENED_AT = ("into", "in", "at", "near", "on", "within", "around", "from")
HAPPENED = re.compile(rf"\b(?:{'|'.join(HAPPENED_VERBS)})\s+(?:{'|'.join(HAPPENED_AT)})\s*$", re.I)
#: Verbs by which the one who leads a sentence is its subject (fixed values).
SAID_VERBS = ("recommended", "reported", "noted", "managed", "authorized", "requested", "directed", "approved", "announced", "said", "wrote")
SAID = rf"(?i)\b({'|'.join(SAID_VERBS)})\b"
SUBJECT = r"^\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z.]+){0,3})"
PRECEDENCE = ("OCCURRED_AT", "SUBJECT_OF_CLAIM", "SPECIES_FOCUS", "HABITAT_FOCUS", "METHOD_FOCUS", "MANAGEMENT_TARGET", "ORGANIZATION_FOCUS", "LOCATION_FOCUS", OTHER_RELATION)
LINKS = "claim_id string, surface_form string, normalized_form string, relation_type string, start_offset int, end_offset int, entity_type_hint string"


def subject_links(claims: DataFrame, text: str = "source_sentence") -> DataFrame:
    """The leading capitalised words of a sentence that reports."""
    surface = F.trim(F.regexp_extract(text, SUBJECT, 1))
    rows = claims.where(F.col(text).rlike(SAID)).withColumn("surface_form", surface).where("surface_form <> ''")
    hint = F.when(F.col("surface_form").rlike("Club|Council|Assn|Association|WPA"), "Organization").otherwise("Person")
    start = F.length(F.regexp_extract(text, r"^(\s*)", 1))
    return rows.select("claim_id", "surface_form", F.lower(F.regexp_replace("surface_form", r"\s+", " ")).alias("normalized_form"), F.lit("SUBJECT_OF_CLAIM").alias("relation_type"), start.alias("start_offset"), (start + F.length("surface_form")).alias("end_offset"), hint.alias("entity_type_hint"))


def claim_links(claims: DataFrame, entities: DataFrame, text: str = "source_sentence") -> DataFrame:
    """Vocabulary terms of each type in a sentence, with the relation of the policy; a place after a verb of
    occurrence is where it happened."""
    scanned = entities.where("entity_type IN ('Species', 'Habitat', 'SurveyMethod', 'Activity', 'Place', 'Refuge')").select(F.when(F.col("entity_type") == "Refuge", "Place").otherwise(F.col("entity_type")).alias("entity_type"), "name")
    parts = extraction.vocabulary_parts(scanned)

    def linked(claim: str, sentence: str, kind: str, s: int, e: int) -> tuple:
        surface = sentence[s:e]
        relation, hint = ROLE_POLICY.get(kind, "MANAGEMENT_TARGET"), kind
        if kind == "Place":
            relation = "OCCURRED_AT" if HAPPENED.search(sentence[:s].rstrip()) else "LOCATION_FOCUS"
            hint = "Refuge" if "refuge" in surface.lower() else "Place"
        return (claim, surface, " ".join(surface.lower().split()), relation, s, e, hint)

    def by_kind(hits) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {}
        for kind, s, e in hits:
            out.setdefault(kind, []).append((s, e))
        return out

    def hits_of(terms, types, sentence: str) -> list[tuple[str, int, int]]:
        return [(kind, s, e) for s, e in terms.hits(sentence) for kind in types.get(sentence[s:e].lower(), ())]

    columns = [c.split()[0] for c in LINKS.split(", ")]
    rows = claims.select("claim_id", text).where(F.col(text).isNotNull())
    if len(parts) == 1:

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            terms, types = extraction.Terms(parts[0].value), parts[0].value
            for b in batches:
                out = [linked(c, t, kind, s, e) for c, t in zip(b["claim_id"], b[text]) for kind, spans in by_kind(hits_of(terms, types, t)).items() for s, e in extraction.longest(t, spans)]
                yield pd.DataFrame(out, columns=columns)

        found = rows.mapInPandas(kernel, LINKS)
    else:
        # each part of a large vocabulary tells where its terms stand; the longest are chosen from all of them
        def of_part(shared):
            def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                terms, types = extraction.Terms(shared.value), shared.value
                for b in batches:
                    out = [(c, *h) for c, t in zip(b["claim_id"], b[text]) for h in hits_of(terms, types, t)]
                    yield pd.DataFrame(out, columns=["claim_id", "kind", "s", "e"])

            return kernel

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [linked(c, t, kind, s, e) for c, t, hits in zip(b["claim_id"], b[text], b["hits"]) for kind, spans in by_kind((h["kind"], int(h["s"]), int(h["e"])) for h in hits).items() for s, e in extraction.longest(t, spans)]
                yield pd.DataFrame(out, columns=columns)

        hits = functools.reduce(lambda a, b: a.unionByName(b), [rows.mapInPandas(of_part(p), "claim_id string, kind string, s int, e int") for p in parts])
        found = rows.join(hits.groupBy("claim_id").agg(F.collect_list(F.struct("kind", "s", "e")).alias("hits")), "claim_id").mapInPandas(choose, LINKS)
    return extraction.best_links(found.unionByName(subject_links(claims, text)), PRECEDENCE)


# -- maintenance and audits -----------------------------------------------------------------------------------


def link_audit(g: Graph) -> DataFrame:
    """Edges with their claim's sentence; an edge whose claim is missing has an empty one."""
    return g.edges.select("claim_id", "entity_id", "relation_type").join(g.claims.select("claim_id", F.col("source_sentence").alias("sentence"), F.lit(1).alias("found")), "claim_id", "left").groupBy("relation_type", F.coalesce(F.col("found") == 1, F.lit(False)).alias("has_claim")).agg(F.count("entity_id").alias("links"), F.count_distinct("sentence").alias("sentences"))


def successors(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """All (ancestor, descendant, steps) over edges src, dst, each once with the fewest steps. A round joins the
    newest frontier with the edges; it ends when a round finds nothing new, or after ``most`` rounds if only chains up to
    that length are asked for."""
    from fieldlore.session import cut

    edges = cut(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    known = cut(edges.select("src", "dst", F.lit(1).alias("steps")))
    frontier, step = known, 1
    while most is None or step < most:
        step += 1
        reached = frontier.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = cut(reached.join(known, ["src", "dst"], "left_anti").withColumn("steps", F.lit(step)))
        if not frontier.limit(1).count():
            return known
        known = cut(known.unionByName(frontier))
    return known


def paragraph_chains(g: Graph) -> DataFrame:
    """J19 over consecutive years that a document series reports: how far each run of years reaches."""
    years = g.docs.where("series IS NOT NULL AND report_year IS NOT NULL").select("series", "report_year").distinct()
    key = lambda c: F.concat_ws("|", "series", c.cast("string"))
    follow = years.alias("a").join(years.alias("b"), (F.col("a.series") == F.col("b.series")) & (F.col("b.report_year") == F.col("a.report_year") + 1)).select(F.col("a.series").alias("series"), F.col("a.report_year").alias("y"))
    return successors(follow.select(key(F.col("y")).alias("src"), key(F.col("y") + 1).alias("dst"))).groupBy("src").agg(F.max("steps").alias("reach"))


def backfill(docs: DataFrame, anchor_id: str, keywords: tuple[str, ...], existing: DataFrame, relation: str = "ABOUT_REFUGE") -> DataFrame:
    """Edges from documents whose title holds a keyword to an anchor, without those that exist."""
    hit = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("title"), k))
    rows = docs.where("title IS NOT NULL").where(hit).select("doc_id", F.lit(anchor_id).alias("entity_id"), F.lit(relation).alias("relation_type"))
    return rows.join(existing.select("doc_id", "entity_id", "relation_type"), ["doc_id", "entity_id", "relation_type"], "left_anti")


def periods(g: Graph) -> DataFrame:
    """The period of each dated document and the number of its claims that get a link."""
    dated = g.docs.where("date_start IS NOT NULL OR date_end IS NOT NULL").select("doc_id", "title", "date_start", "date_end")
    n = g.claims.join(g.runs.select("run_id", "doc_id"), "run_id").groupBy("doc_id").agg(F.count("claim_id").alias("n"))
    return dated.join(n, "doc_id", "left").select(ids.period_id("date_start", "date_end", "title").alias("period_id"), "doc_id", F.coalesce("n", F.lit(0)).alias("claims"))


def targeted(g: Graph) -> DataFrame:
    """Entities for the mentions that no name equals: forms resolved once, joined to the claims of their paragraph,
    the first relation of the precedence, without edges that exist."""
    lacking = g.mentions.where("normalized_form IS NOT NULL AND mention_id IS NOT NULL").join(small_or_plain(g.entities.select(F.lower("name").alias("normalized_form")).distinct()), "normalized_form", "left_anti")
    asked = lacking.select("mention_id", "run_id", "paragraph_id", normalize_name(F.col("normalized_form")).alias("normalized_form")).where("normalized_form <> ''")
    names = g.entities.select("entity_id", "entity_type", normalize_name(F.col("name")).alias("normalized_form"), _chance(F.col("entity_id")).alias("seed_order"))
    sure = resolution.resolve(asked, names).where("relation_type = 'REFERS_TO'").select("mention_id", "entity_id", "entity_type")
    policy = F.create_map(*[F.lit(x) for kv in ROLE_POLICY.items() for x in kv])
    found = asked.join(sure, "mention_id").join(g.claims.select("claim_id", "run_id", "paragraph_id"), ["run_id", "paragraph_id"])
    rows = found.select("claim_id", "entity_id", F.coalesce(F.try_element_at(policy, F.col("entity_type")), F.lit(OTHER_RELATION)).alias("relation_type")).distinct()
    return rows.join(g.edges.select("claim_id", "entity_id"), ["claim_id", "entity_id"], "left_anti")


def contrast(g: Graph) -> DataFrame:
    """T5: each surface form with its mentions and the longest sentence of a claim in a paragraph that holds it."""
    text = g.claims.groupBy("run_id", "paragraph_id").agg(F.max_by("source_sentence", F.struct(F.length("source_sentence"), "source_sentence")).alias("sentence"))
    rows = g.mentions.where("surface_form IS NOT NULL").select("surface_form", "mention_id", "run_id", "paragraph_id").join(text, ["run_id", "paragraph_id"], "left")
    return rows.groupBy("surface_form").agg(F.count_distinct("mention_id").alias("mentions"), F.max_by("sentence", F.struct(F.length("sentence"), "sentence")).alias("longest"))


def _chance(*parts: Column) -> Column:
    """A number of 32 bits that follows from the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def stratified(g: Graph, more: int = 2, seed: int = 7) -> DataFrame:
    """Of each series the first, middle and last document by year, and some by a hash of their id.

    No window holds a whole series: documents are counted by series and year, running counts (bounded by the calendar)
    tell the year of the middle one, and only that year's documents are numbered; the least hashes are kept by parts of a
    series before they are compared.
    """
    rows = g.docs.where("series IS NOT NULL").select("series", "doc_id", "report_year")
    at = F.coalesce("report_year", F.lit(1 << 30)).alias("at")
    per = rows.groupBy("series", at).agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    order = Window.partitionBy("series").orderBy("at")
    placed = per.withColumn("upto", F.sum("n").over(order)).withColumn("whole", F.sum("n").over(Window.partitionBy("series"))).withColumn("middle", F.floor(F.col("whole") / 2) + 1)
    ends = placed.withColumn("first", F.col("upto") == F.col("n")).withColumn("last", F.col("upto") == F.col("whole"))
    by_place = ends.where("first").select("series", F.col("low").alias("doc_id")).unionByName(ends.where("last").select("series", F.col("high").alias("doc_id")))
    wanted = placed.where("middle > upto - n AND middle <= upto").select("series", "at", (F.col("middle") - (F.col("upto") - F.col("n"))).alias("place"))
    in_year = rows.select("series", "doc_id", at).join(F.broadcast(wanted), ["series", "at"]).withColumn("i", F.row_number().over(Window.partitionBy("series", "at").orderBy("doc_id")))
    fixed = by_place.unionByName(in_year.where("i = place").select("series", "doc_id")).distinct().withColumn("by_place", F.lit(True))
    least = rows.select("series", "doc_id", _chance(F.lit(str(seed)), F.col("doc_id")).alias("c")).withColumn("part", F.pmod(F.hash("doc_id"), F.lit(64)))
    few = least.withColumn("i", F.row_number().over(Window.partitionBy("series", "part").orderBy("c", "doc_id"))).where(F.col("i") <= more)
    drawn = few.withColumn("j", F.row_number().over(Window.partitionBy("series").orderBy("c", "doc_id"))).where(F.col("j") <= more).select("series", "doc_id", F.lit(False).alias("by_place"))
    chosen = fixed.unionByName(drawn).groupBy("series", "doc_id").agg(F.max("by_place").alias("by_place"))
    return rows.join(chosen, ["series", "doc_id"]).select("series", "doc_id", "report_year", "by_place")


def unclassified_rate(g: Graph, most: float = 0.2) -> DataFrame:
    """By series the share of claims that no rule classifies, and whether it is within the limit."""
    hit = extraction.classified(g.claims.select("claim_id", "source_sentence"), "source_sentence").select("claim_id", F.lit(1).alias("hit"))
    at = g.runs.select("run_id", "doc_id").join(g.docs.select("doc_id", "series"), "doc_id")
    rows = g.claims.select("claim_id", "run_id").join(at, "run_id").join(hit, "claim_id", "left")
    rate = F.round(1 - F.count("hit") / F.count("claim_id"), 4)
    return rows.groupBy("series").agg(F.count("claim_id").alias("claims"), rate.alias("rate")).withColumn("passes", F.col("rate") <= most)


@dataclass(frozen=True)
class Domain:
    """The rules of a domain, as far as they refer to each other."""

    rules: tuple = extraction.CLAIM_RULES
    policy: dict[tuple[str, str], str] = field(default_factory=dict)
    preferred: dict[str, tuple[str, ...]] = field(default_factory=dict)
    derived: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] = ()
    anchor: dict[str, str] = field(default_factory=dict)
    institution_id: str = ""
    context: str = ""
    vocabulary_file: str = ""


#: A type of claims that no rule finds, and a label that no vocabulary has (fixed values).
UNCLASSIFIED, MADE_LABEL = "unclassified_assertion", "Period"


def rule_problems(d: Domain, entity_types: set[str], exists=os.path.exists) -> list[str]:
    """What is wrong with the rules of a domain: patterns and weights, and whatever refers to what is not there."""
    out: list[str] = []
    types = {t for t, _, _ in d.rules}
    free = types | set(d.renames) | {UNCLASSIFIED}
    for i, (kind, pattern, weight) in enumerate(d.rules):
        try:
            re.compile(pattern)
        except re.error as e:
            out.append(f"rule {i} ({kind}): {e}")
        if weight <= 0:
            out.append(f"rule {i} ({kind}): weight {weight}")
    out += [f"derivation of unknown claim type {c}" for c in d.derived if c not in free]
    out += [f"claim type {c} has no derivation" for c in sorted(types - set(d.derived) - set(d.renames) - {UNCLASSIFIED}) if d.derived]
    out += [f"policy of unknown claim type {c}" for c, _ in d.policy if c not in free] + [f"policy of unknown entity type {e}" for _, e in d.policy if e not in entity_types]
    out += [f"preference of unknown entity type {e}" for es in d.preferred.values() for e in es if e not in entity_types]
    out += [f"rename to unknown claim type {new}" for new in d.renames.values() if new not in types]
    if d.labels:
        out += [f"label {x} has no entity" for x in sorted(set(d.labels) - entity_types - {MADE_LABEL})] + [f"entities of type {x} have no label" for x in sorted(entity_types - set(d.labels))]
    if d.anchor:
        out += [f"anchor of unknown entity type {d.anchor['entity_type']}"] if d.anchor.get("entity_type") not in (None, *entity_types) else []
        out += ["anchor without a relation"] if not d.anchor.get("relation") else []
    out += [f"no {name}" for name, value in (("institution_id", d.institution_id), ("context", d.context)) if not value]
    return out + ([f"no file {d.vocabulary_file}"] if d.vocabulary_file and not exists(d.vocabulary_file) else [])


def converged(rates: list[float], unclassified: list[frozenset[str]], target: float = 0.2, most: int = 5, least_gain: float = 0.02) -> str | None:
    """Why a loop of refining rules ends after these rounds, or None."""
    if rates and rates[-1] < target:
        return "target"
    if len(rates) >= most:
        return "rounds"
    if len(rates) > 1 and rates[-2] - rates[-1] < least_gain:
        return "no_gain"
    return "same_rest" if len(unclassified) > 1 and unclassified[-1] == unclassified[-2] else None


def bootstrap(claims: DataFrame, draft: tuple, refine, entity_types: set[str], text: str = "source_sentence", shown: int = 50, **limits) -> tuple[tuple, list[float], str]:
    """Rules, rate of each round and why it ended. A round validates the rules, rates them over all claims and gives
    ``refine(rules, sentences)`` some sentences that none of them finds (the first by a hash, for a person or a model to
    read), whose answer are the rules of the next round. Rules that do not hold end the loop before they are used."""
    rules, rates, rests = draft, [], []
    while True:
        if problems := [p for p in rule_problems(Domain(rules=rules, institution_id="-", context="-"), entity_types) if p.startswith("rule ")]:
            return rules, rates, "; ".join(problems)
        hit = extraction.classified(claims.select("claim_id", text), text, rules).select("claim_id", F.lit(1).alias("hit"))
        rated = claims.select("claim_id", text).join(hit, "claim_id", "left")
        rate = rated.agg((1 - F.count("hit") / F.count("claim_id")).alias("rate")).first().rate
        rest = [r[text] for r in rated.where("hit IS NULL").select(text, F.md5(F.col(text).cast("binary")).alias("h")).distinct().orderBy("h", text).limit(shown).collect()]
        rates.append(float(rate or 0.0))
        rests.append(frozenset(rest))
        if why := converged(rates, rests, **limits):
            return rules, rates, why
        rules = refine(rules, rest)


def prewarm(g: Graph, cached: DataFrame | None = None, least: int = 40, chunk: int = 10_000, price: float = 3.0) -> DataFrame:
    """Distinct texts that a model still has to see, in chunks of ``chunk`` in the order of their keys, with a
    cost. Texts are numbered within 256 ranges of keys, and each range begins where the ones before it end, so that no
    single sort orders all keys."""
    texts = g.claims.where(F.length("source_sentence") >= least).select(F.sha2("source_sentence", 256).alias("key"), F.length("source_sentence").alias("size")).distinct()
    if cached is not None:
        texts = texts.join(cached.select("key").distinct(), "key", "left_anti")
    ranged = texts.withColumn("range", F.substring("key", 1, 2))
    # at most 256 rows
    starts = ranged.groupBy("range").agg(F.count("key").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    chunked = ranged.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("chunk", F.floor((F.col("before") + F.col("place")) / chunk))
    return chunked.groupBy("chunk").agg(F.count("key").alias("requests"), F.sum("size").alias("characters"), F.round(F.sum("size") / 4 / 1e6 * price, 8).alias("cost"))


def calibration(g: Graph, resamples: int = 200, seed: int = 11) -> DataFrame:
    """By claim type the mean confidence with the 2.5 and 97.5 percentiles of resampled means. Each record draws a
    Poisson weight for every resample from a hash, so that one pass over the records serves all of them."""
    unit = lambda i: (_chance(F.lit(str(seed)), i.cast("string"), F.col("claim_id")).cast("double") + 0.5) / (1 << 32)
    # inverse of the Poisson(1) distribution function
    steps = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518)
    rows = g.claims.select("claim_id", "claim_type", "extraction_confidence", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("i")).withColumn("u", unit(F.col("i")))
    weight: Column = sum(((F.col("u") >= s).cast("int") for s in steps), F.lit(0))
    means = rows.withColumn("w", weight).groupBy("claim_type", "i").agg((F.sum(F.col("w") * F.col("extraction_confidence")) / F.sum("w")).alias("mean"))
    low_high = means.groupBy("claim_type").agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))
    return g.claims.groupBy("claim_type").agg(F.round(F.avg("extraction_confidence"), 6).alias("mean")).join(low_high, "claim_type")


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """O2: the union of frames with each key once, from the first frame that has it."""
    rows = frames[0].withColumn("_n", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        rows = rows.unionByName(f.withColumn("_n", F.lit(i)), allowMissingColumns=True)
    others = [c for c in frames[0].columns if c != key]
    return rows.groupBy(key).agg(*[F.min_by(c, "_n").alias(c) for c in others])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def _claim_links(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return claim_links(g.claims, g.entities)


_BOUND = {
    "x7_subject_links": lambda g: subject_links(g.claims).select("claim_id", "surface_form", "relation_type", "entity_type_hint"), "j17_link_audit": link_audit, "j19_year_chains": paragraph_chains, "d9_backfill": lambda g: backfill(g.docs, "refuge:kessock flats refuge", ("kessock", "tamarn"), g.docs.limit(0).selectExpr("doc_id", "'x' AS entity_id", "'x' AS relation_type")),
    "d13_periods": periods, "d22_targeted": targeted, "t5_contrast": contrast, "t6_stratified": stratified, "g9_unclassified": unclassified_rate, "r19_prewarm": lambda g: prewarm(g, chunk=500), "g15_calibration": calibration, "o2_first_wins": lambda g: first_wins([g.entities.where("entity_type = 'Person'").select("name", "entity_type"), g.entities.select("name", "entity_type")], "name").groupBy("entity_type").agg(F.count("name").alias("names")),
}
QUERIES = {name: (lambda spark, d, f=f: f(Graph(spark, d))) for name, f in _BOUND.items()} | {"x6_claim_links": _claim_links}
from fieldlore.plans.retrieval import _WITH  # noqa: E402

ORACLES = {
    "x7_subject_links": _WITH + f"SELECT claim_id, surface_form, 'SUBJECT_OF_CLAIM' AS relation_type, CASE WHEN regexp_matches(surface_form, 'Club|Council|Assn|Association|WPA') THEN 'Organization' ELSE 'Person' END AS entity_type_hint FROM (SELECT claim_id, trim(regexp_extract(source_sentence, '{SUBJECT}', 1)) AS surface_form FROM claim WHERE regexp_matches(source_sentence, '{SAID}')) WHERE surface_form <> ''",
    "j17_link_audit": _WITH + "SELECT relation_type, c.claim_id IS NOT NULL AS has_claim, count(*) AS links, count(DISTINCT source_sentence) AS sentences FROM edge LEFT JOIN claim c USING (claim_id) GROUP BY 1, 2",
    "j19_year_chains": _WITH.replace("WITH docs", "WITH RECURSIVE docs", 1).rstrip() + ", y AS (SELECT DISTINCT series, report_year FROM docs WHERE series IS NOT NULL AND report_year IS NOT NULL), walk AS (SELECT series, a.report_year AS first, a.report_year + 1 AS last FROM y a JOIN y b USING (series) WHERE b.report_year = a.report_year + 1 UNION SELECT w.series, w.first, w.last + 1 FROM walk w JOIN y b ON b.series = w.series AND b.report_year = w.last + 1) SELECT series || '|' || first AS src, max(last - first)::int AS reach FROM walk GROUP BY 1",
    "d9_backfill": _WITH + "SELECT doc_id, 'refuge:kessock flats refuge' AS entity_id, 'ABOUT_REFUGE' AS relation_type FROM docs WHERE contains(lower(title), 'kessock') OR contains(lower(title), 'tamarn')",
    "t5_contrast": _WITH + "SELECT surface_form, count(DISTINCT mention_id) AS mentions, arg_max(source_sentence, (length(source_sentence), source_sentence)) AS longest FROM mention m LEFT JOIN (SELECT run_id, paragraph_id, source_sentence FROM claim) c USING (run_id, paragraph_id) WHERE surface_form IS NOT NULL GROUP BY 1",
    "o2_first_wins": _WITH + "SELECT entity_type, count(*) AS names FROM (SELECT name, arg_min(entity_type, CASE entity_type WHEN 'Person' THEN 0 ELSE 1 END) AS entity_type FROM entity GROUP BY 1) GROUP BY 1",
    "r19_prewarm": _WITH + "SELECT floor((r - 1) / 500)::bigint AS chunk, count(*) AS requests, sum(size)::bigint AS characters, round(sum(size) / 4 / 1e6 * 3.0, 8) AS cost FROM (SELECT size, row_number() OVER (ORDER BY key) AS r FROM (SELECT DISTINCT sha256(source_sentence) AS key, length(source_sentence) AS size FROM claim WHERE length(source_sentence) >= 40)) GROUP BY 1",
    "d13_periods": _WITH + "SELECT 'period_' || substr(sha1(lower(trim(coalesce(date_start, ''))) || '||' || lower(trim(coalesce(date_end, ''))) || '||' || regexp_replace(lower(trim(coalesce(title, ''))), '\\s+', ' ', 'g')), 1, 16) AS period_id, doc_id, coalesce(n, 0) AS claims FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM claim JOIN runs USING (run_id) GROUP BY 1) c USING (doc_id) WHERE date_start IS NOT NULL OR date_end IS NOT NULL",
}

#: Scores of the claim types of a sentence as DuckDB structs.
SCORES = ", ".join("{'score': " + " + ".join(f"len(regexp_extract_all(source_sentence, '(?i){p}')) * {w}::double" for k, p, w in extraction.CLAIM_RULES if k == t) + f", 'ord': {-i}, 'type': '{t}'}}" for i, t in enumerate(dict.fromkeys(t for t, _, _ in extraction.CLAIM_RULES)))

ORACLES |= {
    "g9_unclassified": _WITH + f"SELECT series, count(*) AS claims, round(1 - count(hit) / count(*), 4) AS rate, round(1 - count(hit) / count(*), 4) <= 0.2 AS passes FROM (SELECT claim_id, series, CASE WHEN list_max([{SCORES}]).score >= {extraction.THRESHOLD} THEN 1 END AS hit FROM claim JOIN runs USING (run_id) JOIN docs USING (doc_id)) GROUP BY 1",
    "t6_stratified": _WITH + "SELECT series, doc_id, report_year, by_place FROM (SELECT *, i = 1 OR i = n OR i = n // 2 + 1 AS by_place FROM (SELECT series, doc_id, report_year, row_number() OVER (PARTITION BY series ORDER BY report_year NULLS LAST, doc_id) AS i, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY ('0x' || substr(md5('7|' || doc_id), 1, 8))::bigint, doc_id) AS c FROM docs WHERE series IS NOT NULL)) WHERE by_place OR c <= 2",
    "g15_calibration": _WITH + ", weighed AS (SELECT claim_type, extraction_confidence, i, (u >= 0.36787944117)::int + (u >= 0.73575888234)::int + (u >= 0.91969860293)::int + (u >= 0.98101184312)::int + (u >= 0.99634015317)::int + (u >= 0.99940581518)::int AS w FROM (SELECT claim_type, extraction_confidence, i, (('0x' || substr(md5('11|' || i || '|' || claim_id), 1, 8))::bigint + 0.5) / 4294967296 AS u FROM claim, range(1, 201) r(i))), mean AS (SELECT claim_type, i, sum(w * extraction_confidence) / sum(w) AS mean FROM weighed GROUP BY 1, 2) SELECT claim_type, m.mean, low, high FROM (SELECT claim_type, round(avg(extraction_confidence), 6) AS mean FROM claim GROUP BY 1) m JOIN (SELECT claim_type, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM mean GROUP BY 1) USING (claim_type)",
}

#: Where terms stand as whole words, the longest first and none overlapping a longer one (a recursion over
#: the hits of a sentence and a kind), the place of an event by the words before it, the first relation of a span.
_verbs, _preps = "|".join(HAPPENED_VERBS), "|".join(HAPPENED_AT)
_hints = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE_POLICY.items() if k != "Place")
_order = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(PRECEDENCE, 1))
ORACLES["x6_claim_links"] = (
    _WITH.replace("WITH docs", "WITH RECURSIVE docs", 1).rstrip()
    + r""", term AS (SELECT DISTINCT CASE entity_type WHEN 'Refuge' THEN 'Place' ELSE entity_type END AS kind, lower(name) AS t FROM entity WHERE name <> '' AND entity_type IN ('Species', 'Habitat', 'SurveyMethod', 'Activity', 'Place', 'Refuge')),
hit AS (SELECT DISTINCT claim_id, source_sentence AS x, kind, t, (i - 1)::int AS s, (i - 1 + length(t))::int AS e FROM claim JOIN term ON contains(lower(source_sentence), t), range(1, 2000) r(i) WHERE i <= length(source_sentence) AND substr(lower(source_sentence), i::int, length(t)) = t
AND regexp_matches(substr(' ' || source_sentence, i::int, 1), '[\p{L}\p{N}_]') <> regexp_matches(substr(source_sentence, i::int, 1), '[\p{L}\p{N}_]') AND regexp_matches(substr(source_sentence, (i + length(t) - 1)::int, 1), '[\p{L}\p{N}_]') <> regexp_matches(substr(source_sentence || ' ', (i + length(t))::int, 1), '[\p{L}\p{N}_]')),
listed AS (SELECT claim_id, x, kind, list({'s': s, 'e': e} ORDER BY e - s DESC, t, s) AS hits FROM hit GROUP BY 1, 2, 3),
walk AS (SELECT claim_id, x, kind, hits, 1 AS i, [hits[1]] AS kept FROM listed UNION ALL SELECT claim_id, x, kind, hits, i + 1, CASE WHEN len(list_filter(kept, lambda k: hits[i + 1].s < k.e AND hits[i + 1].e > k.s)) = 0 THEN list_append(kept, hits[i + 1]) ELSE kept END FROM walk WHERE i < len(hits)),
span AS (SELECT claim_id, x, kind, unnest(kept) AS k FROM walk WHERE i = len(hits)),
link AS (SELECT claim_id, substr(x, k.s + 1, k.e - k.s) AS surface_form, CASE WHEN kind <> 'Place' THEN coalesce(CASE kind """
    + _hints
    + r""" END, 'MANAGEMENT_TARGET') WHEN regexp_matches(regexp_replace(substr(x, 1, k.s), '\s+$', ''), '(?i)\b("""
    + _verbs
    + r""")\s+("""
    + _preps
    + r""")\s*$') THEN 'OCCURRED_AT' ELSE 'LOCATION_FOCUS' END AS relation_type, k.s AS start_offset, k.e AS end_offset, CASE WHEN kind <> 'Place' THEN kind WHEN contains(lower(substr(x, k.s + 1, k.e - k.s)), 'refuge') THEN 'Refuge' ELSE 'Place' END AS entity_type_hint FROM span
UNION ALL SELECT claim_id, f, 'SUBJECT_OF_CLAIM', b, b + length(f), CASE WHEN regexp_matches(f, 'Club|Council|Assn|Association|WPA') THEN 'Organization' ELSE 'Person' END FROM (SELECT claim_id, trim(regexp_extract(source_sentence, '"""
    + SUBJECT
    + r"""', 1)) AS f, length(regexp_extract(source_sentence, '^(\s*)', 1))::int AS b FROM claim WHERE regexp_matches(source_sentence, '"""
    + SAID
    + r"""')) WHERE f <> ''),
named AS (SELECT *, regexp_replace(trim(lower(surface_form)), '\s+', ' ', 'g') AS normalized_form FROM link)
SELECT claim_id, surface_form, normalized_form, relation_type, start_offset, end_offset, entity_type_hint FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, start_offset, end_offset, normalized_form ORDER BY CASE relation_type """
    + _order
    + """ END, relation_type) AS r FROM named) WHERE r = 1"""
)

from fieldlore.plans import similar_sql  # noqa: E402

ORACLES["d22_targeted"] = similar_sql.targeted()
