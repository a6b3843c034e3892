"""Exports of the graph: tables for spreadsheets, finding aids, a statistics page, review files."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.plans import retrieval
from fieldlore.plans.graph import Graph


def claim_rows(g: Graph, quarantined: bool = False) -> DataFrame:
    """Claims with their document; quarantined ones only if asked for."""
    c = g.claims if quarantined else g.claims.where(g.active(F.col("quarantine_status")))
    at = g.runs.select("run_id", "doc_id").join(g.docs.select("doc_id", "title", "series", "report_year"), "doc_id")
    return c.join(at, "run_id", "left").select("claim_id", "doc_id", "title", "series", "report_year", "claim_type", "source_sentence", "epistemic_status", "extraction_confidence", "claim_date")


def entity_rows(g: Graph) -> DataFrame:
    """Entities once each, the first of an id."""
    return g.entities.groupBy("entity_id").agg(F.min_by("entity_type", F.struct("entity_type", "name")).alias("entity_type"), F.min_by("name", F.struct("entity_type", "name")).alias("name"))


def relationship_rows(g: Graph) -> DataFrame:
    """Claim-entity and document-entity links in one list."""
    claims = g.edges.select(F.col("claim_id").alias("source_id"), F.col("relation_type"), F.col("entity_id").alias("target_id"))
    return claims.unionByName(retrieval.anchors(g).select(F.col("doc_id").alias("source_id"), "relation_type", F.col("entity_id").alias("target_id")))


def finding_aid_rows(g: Graph, levels: tuple[str, ...] = ("public",)) -> DataFrame:
    """Each series with its span of dates, extent, documents, best claims and access points."""
    docs = g.visible_docs.where(F.col("access_level").isin(list(levels)) & F.col("series").isNotNull())
    runs = g.latest_runs.join(docs.select("doc_id", "series"), "doc_id")
    claims = g.claims.where(g.active(F.col("quarantine_status"))).join(runs, "run_id")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("extraction_confidence", "claim_id", "source_sentence")))), 1, 5)
    # five of each document before the series gathers them
    from pyspark.sql import Window

    ranked = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("extraction_confidence"), F.desc("claim_id")))).where("place <= 5")
    few = ranked(ranked(claims, "series", "doc_id"), "series").groupBy("series").agg(F.transform(best, lambda x: x["source_sentence"]).alias("claims"))
    points = g.edges.join(claims.select("claim_id", "series"), "claim_id").groupBy("series").agg(F.array_sort(F.collect_set("name")).alias("access_points"))
    base = docs.groupBy("series").agg(F.min("date_start").alias("first"), F.max(F.coalesce("date_end", "date_start")).alias("last"), F.sum("page_count").alias("pages"), F.count("doc_id").alias("documents"))
    return base.join(few, "series", "left").join(points, "series", "left")


def finding_aids(rows: DataFrame) -> DataFrame:
    """Series and its description as EAD XML, one row each, so that any number of series is written in parallel."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    many = lambda name, c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: tag(name, esc(x))), "")
    did = tag("did", F.concat(tag("unittitle", esc(F.col("series"))), tag("unitdate", F.concat_ws("/", esc(F.col("first")), esc(F.col("last")))), tag("physdesc", F.concat(esc(F.col("pages")), F.lit(" pages, "), esc(F.col("documents")), F.lit(" documents")))))
    body = F.concat(did, tag("scopecontent", many("p", F.col("claims"))), tag("controlaccess", many("name", F.col("access_points"))))
    return rows.select("series", F.concat(F.lit('<ead><archdesc level="series">'), body, F.lit("</archdesc></ead>")).alias("xml"))


#: The statistics of the page by title.
STATISTICS = (("Documents", retrieval.doc_overview), ("Document types", retrieval.doc_types), ("Claim types", retrieval.claim_types), ("Entity types", retrieval.entity_types), ("Coverage", retrieval.temporal_coverage), ("Confidence", retrieval.confidence_distribution))


def statistics_rows(g: Graph) -> DataFrame:
    """Section, title, key and html of every row of the page, however many there are; the head of a section has no key."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = []
    for i, (title, of) in enumerate(STATISTICS):
        rows = of(g)
        head = g.spark.createDataFrame([(i, title, None, "<tr>" + "".join(f"<th>{escape(c)}</th>" for c in rows.columns) + "</tr>")], "section int, title string, key string, html string")
        cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), esc(F.col(c)), F.lit("</td>")) for c in rows.columns], F.lit("</tr>"))
        parts += [head, rows.select(F.lit(i).alias("section"), F.lit(title).alias("title"), F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit("")).alias("key"), cells.alias("html"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statistics_page(g: Graph, path: str, title: str = "Statistics") -> None:
    """The statistics as one HTML file, written row by row as they come in order: none is cut, none are held."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>")
        section = None
        for r in statistics_rows(g).orderBy("section", F.col("key").asc_nulls_first(), "html").toLocalIterator():
            if r.section != section:
                f.write(("" if section is None else "</table>") + f"<h2>{escape(r.title)}</h2><table>")
                section = r.section
            f.write(r.html)
        f.write(("" if section is None else "</table>") + "</body></html>")


def nested_proposals(proposals: DataFrame, targets: DataFrame) -> DataFrame:
    """Proposals with their targets nested, as JSON text."""
    t = targets.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in targets.columns if c != "proposal_id"]))).alias("targets"))
    rows = proposals.join(t, "proposal_id", "left")
    return rows.select("proposal_id", F.to_json(F.struct(*rows.columns)).alias("json"))


_BOUND = {"s7_claims": lambda g: claim_rows(g), "s7_entities": entity_rows, "s7_relationships": relationship_rows, "s9_statistics": lambda g: statistics_rows(g).groupBy("section", "title").agg(F.count("html").alias("rows")), "s8_finding_aids": lambda g: finding_aids(finding_aid_rows(g))}
QUERIES = {name: (lambda spark, d, f=f: f(Graph(spark, d))) for name, f in _BOUND.items()}
def _body(name: str) -> str:
    """A query's SQL without the tables that all share."""
    return retrieval.ORACLES[name].removeprefix(retrieval._WITH)


ORACLES = {
    "s8_finding_aids": retrieval._WITH + ", open AS (SELECT * FROM visible WHERE access_level = 'public' AND series IS NOT NULL), c AS (SELECT claim.*, series FROM claim JOIN latest USING (run_id) JOIN open USING (doc_id) WHERE coalesce(quarantine_status, 'active') = 'active'), best AS (SELECT series, string_agg('<p>' || replace(replace(replace(coalesce(source_sentence, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY extraction_confidence DESC, claim_id DESC) AS claims FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY extraction_confidence DESC, claim_id DESC) AS r FROM c) WHERE r <= 5 GROUP BY 1), points AS (SELECT series, string_agg('<name>' || replace(replace(replace(coalesce(name, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name>', '' ORDER BY name) AS points FROM (SELECT DISTINCT series, name FROM edge JOIN c USING (claim_id)) GROUP BY 1), base AS (SELECT series, min(date_start) AS first_date, max(coalesce(date_end, date_start)) AS last_date, sum(page_count) AS pages, count(*) AS documents FROM open GROUP BY 1) SELECT series, '<ead><archdesc level=\"series\"><did><unittitle>' || replace(replace(replace(coalesce(series, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</unittitle><unitdate>' || replace(replace(replace(coalesce(first_date, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '/' || replace(replace(replace(coalesce(last_date, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</unitdate><physdesc>' || coalesce(pages::varchar, '') || ' pages, ' || documents || ' documents</physdesc></did><scopecontent>' || coalesce(claims, '') || '</scopecontent><controlaccess>' || coalesce(points, '') || '</controlaccess></archdesc></ead>' AS xml FROM base LEFT JOIN best USING (series) LEFT JOIN points USING (series)",
    "s9_statistics": retrieval._WITH + "SELECT section, title, n + 1 AS rows FROM (" + " UNION ALL ".join(f"SELECT {i}::int AS section, '{t}' AS title, (SELECT count(*) FROM ({_body(n)})) AS n" for i, (t, n) in enumerate(zip((t for t, _ in STATISTICS), ("a20_doc_overview", "a21_doc_types", "a22_claim_types", "a23_entity_types", "a21_coverage", "a24_confidence")))) + ")",
    "s7_claims": retrieval._WITH + "SELECT c.claim_id, d.doc_id, d.title, d.series, d.report_year, c.claim_type, c.source_sentence, c.epistemic_status, c.extraction_confidence, c.claim_date FROM claim c LEFT JOIN (SELECT r.run_id, d.* FROM runs r JOIN docs d USING (doc_id)) d USING (run_id) WHERE coalesce(quarantine_status, 'active') = 'active'",
    "s7_entities": retrieval._WITH + "SELECT entity_id, min(entity_type) AS entity_type, arg_min(name, (entity_type, name)) AS name FROM entity GROUP BY 1",
    "s7_relationships": retrieval._WITH + "SELECT claim_id AS source_id, relation_type, entity_id AS target_id FROM edge UNION ALL SELECT doc_id, 'ABOUT_PLACE', entity_id FROM anchor",
}
