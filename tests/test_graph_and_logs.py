import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldlore.plans import oplog, planner, retrieval
from fieldlore.plans.graph import Access, Graph
from fieldlore.review import detectors, store
from fieldlore.sources import exports, files
from fieldlore.streaming import logs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark, SF)


def test_no_institution_sees_nothing(spark):
    closed = Graph(spark, SF, Access(institutions=()))
    assert closed.visible_docs.count() == 0 and closed.active_claims.count() == 0


def test_access_holds_in_every_template(spark, graph):
    visible = {r.doc_id for r in graph.visible_docs.collect()}
    statuses = {r.claim_id: r.quarantine_status for r in graph.claims.collect()}
    for rows in (retrieval.temporal(graph, 1900, 2000), retrieval.claim_type_scoped(graph, ("economic_use",)), retrieval.provenance(graph), retrieval.top_claims(graph)):
        got = rows.collect()
        assert got and all(r.doc_id in visible and statuses[r.claim_id] in (None, "active") for r in got)


def test_ties_of_the_latest_run_are_kept(spark, graph, monkeypatch):
    runs = spark.createDataFrame([("r1", "d", "2020"), ("r2", "d", "2020"), ("r3", "d", "2019")], "run_id string, doc_id string, run_timestamp string")
    g = Graph(spark, SF)
    g.__dict__["runs"] = runs
    assert {r.run_id for r in g.latest_runs.collect()} == {"r1", "r2"}


def test_merge_keeps_older_values_where_newer_lack(spark):
    a = spark.createDataFrame([("x", "t1", 1, 1), ("y", "t", None, 1)], "id string, title string, n int, v int")
    b = spark.createDataFrame([("x", "t2", 2)], "id string, title string, v int")
    assert {tuple(r) for r in retrieval.merge_nodes(a, b, "id", "v").select("id", "title", "n").collect()} == {("x", "t2", 1), ("y", "t", None)}


def limiter(calls, most, period):
    kept, out = {}, {}
    for user, at, event in sorted(calls):
        times = [t for t in kept.get(user, []) if t > at - period]
        out[event] = len(times) < most
        kept[user] = times + [at] if out[event] else times
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(seconds=rng.randint(0, 5000)), rng.choice([1, 1, 1, 2, 3]), "click", 1.0, "{}") for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    want = limiter([(u, (t - base).total_seconds(), i) for i, t, u, *_ in rows], 3, 600)
    assert {r.event_id: r.allowed for r in oplog.rate_limited(df, 3, 600).collect()} == want
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = logs.read_events(spark, str(tmp_path))
    assert {r.event_id: r.allowed for r in logs.drained(logs.rate_limited(stream, 3, 600), "append").collect()} == want


def test_streams_equal_batches(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert logs.drained(logs.daily(logs.read_events(spark, SF)), "complete").exceptAll(oplog.daily_rollup(events)).count() == 0
    assert logs.drained(logs.once_each(logs.read_events(spark, SF)), "append").count() == events.select("event_id").distinct().count()


def test_greedy_groups_are_those_of_a_loop(spark):
    rng = random.Random(2)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(45)})
    got = {(r.anchor, r.member) for r in detectors.greedy_groups(spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a string, b string, score double")).collect()}
    near, taken, want = set(pairs), set(), set()
    for i, a in enumerate(names):
        if a not in taken:
            for b in names[i + 1 :]:
                if (a, b) in near and b not in taken:
                    taken.add(b)
                    want.add((a, b))
    assert got == want


def test_review_routing_and_store(spark):
    t = spark.createDataFrame([("c1", "merge_entities", "entity", "e1", "g", 0.9, "r"), ("c2", "suppress_mention", "mention", "m1", "h", 0.95, "ocr_garbage"), ("c2", "suppress_mention", "mention", "m2", "h", 0.95, "ocr_garbage"), ("c3", "x", "claim", "c", "i", 0.4, "r")], ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in detectors.PROPOSAL))
    out = {r.issue_class: r for r in detectors.routed(t).collect()}
    assert [out[c].status for c in ("c1", "c2", "c3")] == ["queued", "accepted_pending_apply", "rejected"] and out["c2"].impact_size == 2
    assert out["c1"].priority_score == pytest.approx(0.5 * 0.9 + 0.5 * 0.2) and out["c2"].priority_score == pytest.approx(0.7 * 0.95 + 0.3 * 0.2)
    stored = spark.createDataFrame([("p1", "deferred", "t0", "old"), ("p2", "queued", "t0", "old")], "proposal_id string, status string, created_at string, reason string")
    found = spark.createDataFrame([("p1", "queued", "t1", "new"), ("p3", "queued", "t1", "new")], stored.schema)
    merged = store.upsert(stored, found)
    assert {tuple(r) for r in merged.select("proposal_id", "status", "created_at", "reason").collect()} == {("p1", "deferred", "t0", "new"), ("p2", "queued", "t0", "old"), ("p3", "queued", "t1", "new")}
    acts = spark.createDataFrame([("p1", "accept", "t2", 1, None), ("p1", "reject", "t3", 2, None), ("p2", "edit", "t2", 3, "{}"), ("p2", "reject", "t3", 4, None)], "proposal_id string, action string, created_at string, event_id int, patch string")
    assert {r.proposal_id: r.status for r in store.applied(merged, acts).collect()} == {"p1": "accepted_pending_apply", "p2": "rejected", "p3": "queued"}
    assert [tuple(r) for r in store.revisions(acts).collect()] == [("p2", "{}", 2)] and store.training_rows(merged.withColumn("patch", F.lit("{}")), acts).count() == 2


def test_planner():
    i = planner.classify("How many fires burned between 1940 and 1950 near Corvale Meadow?")
    assert (i.bucket, i.first, i.last, i.claim_types) == ("analytical", 1940, 1950, ("fire_incident",)) and "Corvale Meadow" in i.entities
    steps = lambda text, ids: [s.template for s in planner.plan(planner.classify(text), ids, anchors=("a",))]
    assert steps("fires in 1940", ()) == ["temporal_anchor"] and steps("fires in 1940", ("e",)) == ["temporal"] and steps("both in 1940", ("e", "f")) == ["multi_entity"]
    assert steps("the fire", ("e",)) == ["entity_anchored"] and steps("the fire", ()) == ["claim_type_scoped"] and steps("teal", ("a",)) == ["entity_anchored", "document_anchor"] and steps("teal", ()) == ["fulltext"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "TBL_1938a.json").write_text('{"metadata": {"doc_title": "Report", "extra": 1}, "pages": [{"page_number": 1, "raw_text": "A.", "annotations": [{"kind": "note", "text": "x"}]}, {"page_number": 2, "raw_ocr_text": "B."}]}')
    docs = files.documents(files.reports(spark, str(tmp_path / "in")))
    d = docs.first()
    assert (d.title, d.report_year, d.page_count, d.language) == ("Report", 1938, 2, "en")
    assert [(r.page_number, r.raw_ocr_text) for r in files.pages(docs).orderBy("page_number").collect()] == [(1, "A."), (2, "B.")] and files.annotations(docs).count() == 1
    rows = spark.createDataFrame([("d", [1, 2], (1, "x"))], "k string, a array<int>, s struct<n: int, t: string>")
    assert files.flattened(rows).columns == ["k", "a", "s.n", "s.t"]
    files.write_csv([rows, spark.createDataFrame([("e", 3)], "k string, z int")], str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').orderBy("k").collect()
    assert [tuple(r) for r in back] == [("d", "[1,2]", '{"n":1,"t":"x"}', None), ("e", None, None, "3")]
    part = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 3, "z")], "k string, n int, t string")
    both = files.bundles({"rows": part}, "k")
    assert {tuple(r) for r in files.unbundled(both, "k", "rows").collect()} == {tuple(r) for r in part.collect()}
    (tmp_path / "done.jsonl").write_text('{"k": "d"}\nbroken\n')
    seen = files.lines(spark, str(tmp_path / "done.jsonl"), "k string").where("k IS NOT NULL")
    assert [r.k for r in files.not_yet(part.select("k").distinct(), seen, "k").collect()] == ["e"]
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("claim_id string, epistemic_status string, notes string")
    assert tuple(files.tolerant(spark.createDataFrame([("c", "certain", 1)], "claim_id string, certainty string, x int"), schema).first()) == ("c", "certain", None)


def test_exports(graph, tmp_path):
    aids = exports.finding_aids(exports.finding_aid_rows(graph)).collect()
    import xml.etree.ElementTree as ET

    assert aids and all(ET.fromstring(r.xml).find("archdesc/did/unittitle").text == r.series for r in aids)
    exports.statistics_page(graph, path := f"{tmp_path}/page.html")
    page = open(path, encoding="utf-8").read()
    assert "<h2>Claim types</h2>" in page and page.count("<tr>") == exports.statistics_rows(graph).count() and page.endswith("</html>")


def test_all_queries_run(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    for name, f in queries.items():
        if not name[:2] in ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9"):
            assert f(spark, SF).schema, name
    assert entry.entry(spark).count() >= 0
