import json

import pytest
from pyspark.sql import functions as F

from fieldlore.operators import derivation
from fieldlore.plans import audits, ingest, quality, retrieval
from fieldlore.plans.graph import Access
from fieldlore.review import detectors, store
from fieldlore.sources import files, warehouse
from fieldlore.streaming import logs

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- runs, flags, guards ----------------------------------------------------------------------------------------------


def test_runs_of_one_moment_have_names_of_their_own(spark):
    docs = spark.createDataFrame([("d1", "a/x.json"), ("d2", "a/y.json"), ("d3", None)], "doc_id string, source_file string")
    at = F.to_timestamp(F.lit("2024-03-01 12:00:00"))
    got = ingest.document_runs(docs, at).collect()
    assert len({r.run_id for r in got}) == 3 and len({r.config_fingerprint for r in got}) == 1
    other = ingest.document_runs(docs, at, ingest.RunSettings(ocr_engine="another")).first()
    assert other.config_fingerprint != got[0].config_fingerprint and other.run_id == got[0].run_id


def test_flags_of_documents(spark):
    docs = spark.createDataFrame([("d1", None)], "doc_id string, access_level string")
    assert rows(ingest.flagged(docs, "restricted", "i", True)) == [("d1", "restricted", "i", True)]
    with pytest.raises(PermissionError):
        ingest.flagged(docs, "indigenous_restricted", "i")
    assert ingest.flagged(docs, "indigenous_restricted", "i", consulted=True).count() == 1
    with pytest.raises(ValueError):
        ingest.flagged(docs, "secret", "i")


def test_guards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ingest.inside(tmp_path, "in/a.json") == (tmp_path / "in" / "a.json").resolve()
    for bad in ("../x", "in/../../x", "/etc/passwd"):
        with pytest.raises(PermissionError):
            ingest.inside(tmp_path / "in", bad)
    for bad in ("", "a b", "../x", "a..b", "/x", "x" * 200):
        with pytest.raises(ValueError):
            ingest.safe_id(bad)
    df = spark.createDataFrame([("ok:1",), ("a..b",), ("a b",), (None,)], "x string")
    assert rows(ingest.safe_ids(df, "x")) == [("ok:1",)]


# -- a model, its cache, hybrid mentions -------------------------------------------------------------------------------


def test_a_model_is_asked_once_for_each_text_that_the_cache_lacks(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def model(text):
        import os
        import uuid

        open(os.path.join(str(asked), uuid.uuid4().hex), "w").write(text)
        return [{"source_sentence": text, "claim_type": "fire_incident", "extraction_confidence": 0.9}, {"claim_type": "no sentence"}]

    df = spark.createDataFrame([("p1", "It burned."), ("p2", " It burned. "), ("p3", ""), ("p4", None), ("p5", "Rain fell.")], "paragraph_id string, clean_text string")
    claims, new = ingest.model_answers(df, model, "m", "v1")
    assert sorted((r.paragraph_id, r.sentence) for r in claims.collect()) == [("p1", "It burned."), ("p2", "It burned."), ("p5", "Rain fell.")]
    assert new.count() == 2 and len(list(asked.iterdir())) == 2
    again, more = ingest.model_answers(df, model, "m", "v1", cache=new)
    assert again.count() == 3 and more.count() == 0 and len(list(asked.iterdir())) == 2
    # another prompt is another question
    assert ingest.model_answers(df, model, "m", "v2", cache=new)[1].count() == 2
    assert ingest.model_answers(df)[0].count() == 0


@pytest.mark.parametrize("text, n", [('[{"sentence": "a"}]', 1), ('```json\n[{"sentence": "a"}]\n```', 1), ('{"claims": [{"sentence": "a"}, {"x": 1}]}', 1), ('Here: [{"sentence": "a"}] so', 1), ("no json", 0), ("[broken", 0), (None, 0), ("", 0)])
def test_answers_of_a_model(text, n):
    assert len(ingest.read_answer(text)) == n


def test_hybrid_mentions(spark):
    schema = "paragraph_id string, start_offset int, end_offset int, surface_form string, detection_confidence double, detection_source string, ocr_flags array<string>, entity_type_hints array<string>"
    rules = spark.createDataFrame([("p", 0, 4, "Teal", 0.9, "rules", ["f"], ["Species"]), ("p", 5, 9, "Lake", 0.9, "rules", [], []), ("p", 20, 25, "Marsh", 0.7, "rules", [], [])], schema)
    model = spark.createDataFrame([("p", 0, 4, "Teal", 0.95, "model", [], []), ("p", 5, 9, "Lake", 0.9, "model", ["g"], ["Place"]), ("p", 30, 33, "Ann", 0.5, "model", None, ["Person"])], schema)
    got = {r.start_offset: (r.detection_confidence, r.detection_source, r.ocr_flags, r.entity_type_hints) for r in ingest.hybrid_mentions(rules, model).collect()}
    assert got == {0: (0.95, "hybrid", ["f"], ["Species"]), 5: (0.9, "hybrid", [], []), 20: (0.7, "rules", [], []), 30: (0.5, "model", None, ["Person"])}


# -- scans ------------------------------------------------------------------------------------------------------------------


def test_scan_flags_every_kind_and_quarantines_the_sure_ones(spark):
    claims = spark.createDataFrame([("c1", "Call 208-555-0178 or a.b@mail.test", "active"), ("c2", "A burial ground lies there", "active"), ("c3", "Rain fell", None), ("c4", None, None)], "claim_id string, source_sentence string, quarantine_status string")
    found = ingest.scanned(claims, ("burial ground",))
    assert sorted((r.claim_id, r.reason, r.quarantine) for r in found.collect()) == [("c1", "pii_exposure:email", True), ("c1", "pii_exposure:phone", True), ("c2", "protected_vocabulary:burial ground", True)]
    assert ingest.scan_summary(claims, found).first().asDict() == {"scanned": 4, "flagged": 2, "quarantined": 3, "proposals_created": 3}
    assert {r.claim_id: r.quarantine_status for r in ingest.after_scan(claims, found).collect()} == {"c1": "quarantined", "c2": "quarantined", "c3": None, "c4": None}
    assert ingest.scanned(claims, pii_from=0.9).where("quarantine").count() == 0


def test_scope_of_an_administrator():
    own = Access(("a",))
    assert ingest.rebound(own, "reader", ("a", "b")) == own and ingest.rebound(own, "admin", None) == own
    assert ingest.rebound(own, "admin", ("a", "b")).institutions == ("a", "b") and ingest.rebound(own, "reader", ("b",), admin_only=False).institutions == ("b",)


# -- link candidates and contract --------------------------------------------------------------------------------------------


def test_narrowed_links(spark):
    links = spark.createDataFrame([("c", "fire_incident", "OCCURRED_AT", f, h) for f, h in (("one", None), ("none", None), ("person", None), ("two", None), ("two", "Place"), ("hinted", "Refuge"))] + [("c", "fire_incident", "SPECIES_FOCUS", "teal", None)], "claim_id string, claim_type string, relation_type string, normalized_form string, type_hint string")
    cands = spark.createDataFrame([("c", "one", "e1", "Place"), ("c", "one", "p9", "Person"), ("c", "person", "p1", "Person"), ("c", "two", "e2", "Place"), ("c", "two", "r2", "Refuge"), ("c", "hinted", "e3", "Place"), ("c", "teal", "s1", "Species")], "claim_id string, normalized_form string, entity_id string, entity_type string")
    got = sorted((r.normalized_form, r.diagnostic_code or "", r.entity_id or "", r.candidates) for r in quality.narrowed(links, cands).collect())
    assert got == [("hinted", "TYPE_HINT_CONFLICT", "", 1), ("none", "NO_RESOLVED_MENTION", "", 0), ("one", "", "e1", 1), ("person", "RELATION_TYPE_CONFLICT", "", 1), ("teal", "RELATION_COMPATIBILITY_FORBIDDEN", "", 1), ("two", "", "e2", 2), ("two", "AMBIGUOUS_FALLBACK", "", 2)]


def test_contract(spark):
    df = spark.createDataFrame([("burn", "OCCURRED_AT", "Place"), ("odd", "odd", "Place"), ("fire_incident", "OCCURRED_AT", "Robot")], "claim_type string, relation_type string, entity_type string")
    assert rows(derivation.contracted(df, ("fire_incident",), ("OCCURRED_AT",), ("Place",))) == [("fire_incident", "OCCURRED_AT", "Place"), ("unclassified_assertion", "TOPIC_OF_CLAIM", "Place")]


def test_gate_names_its_error(spark, caplog):
    claims = spark.createDataFrame([("c", "active")], "claim_id string, quarantine_status string")
    out = derivation.gated(claims, lambda c: c.select("no_such_column"))
    assert out.first().quarantine_reason == "gate_error" and "no_such_column" in caplog.text


# -- review store -----------------------------------------------------------------------------------------------------------------

BASE = {"schema_version": "v1"}
PATCHES = [
    ("merge_entities", {"canonical_entity_id": "a", "canonical_name": "A", "merge_entity_ids": ["b", "c"]}, []),
    ("merge_entities", {"canonical_entity_id": "b", "canonical_name": "A", "merge_entity_ids": ["c", "b", "b"]}, ["not_sorted:merge_entity_ids", "merged_into_itself"]),
    ("merge_entities", {"canonical_entity_id": 7, "canonical_name": "A", "merge_entity_ids": "b"}, ["no_list:merge_entity_ids", "no_text:canonical_entity_id"]),
    ("create_alias", {"canonical_entity_id": "a", "alias_entity_id": "a", "canonical_name": "A", "x": 1}, ["unknown:x", "equal:canonical_entity_id"]),
    ("suppress_mention", {"mention_ids": [], "suppression_reason": "odd", "scope": "mention"}, ["not_allowed:suppression_reason", "empty:mention_ids"]),
    ("add_claim_location_link", {"claim_id": "c", "entity_id": "e", "relation_type": "LOCATION_FOCUS", "evidence_basis": "text"}, ["not_allowed:relation_type"]),
    ("relabel_claim_link", {"claim_id": "c", "entity_id": "e", "old_relation_type": "X", "new_relation_type": "X", "evidence_basis": "t"}, ["equal:old_relation_type"]),
    ("exclude_claim_from_derivation", {"claim_id": "c", "derivation_kind": "event", "reason": "r"}, []),
    ("quarantine_claim", {"claim_id": "c"}, ["missing:reason"]), ("quarantine_document", {"doc_id": "d", "reason": "r"}, []), ("restrict_permanently", {"target_id": "t", "target_kind": "claim", "reason": "r"}, []), ("odd", {}, ["unknown_type"]),
]


def test_patches(spark):
    data = [(f"p{i}", kind, json.dumps(BASE | {"proposal_type": kind} | patch)) for i, (kind, patch, _) in enumerate(PATCHES)]
    data += [("q1", "quarantine_claim", "[]"), ("q2", "quarantine_claim", None), ("q3", "quarantine_claim", json.dumps({"schema_version": "v2", "proposal_type": "quarantine_document", "claim_id": "c", "reason": "r"}))]
    got = {r.proposal_id: sorted(r.errors) for r in store.patch_errors(spark.createDataFrame(data, "proposal_id string, proposal_type string, patch string")).collect()}
    assert got == {f"p{i}": sorted(e) for i, (_, _, e) in enumerate(PATCHES)} | {"q1": ["not_an_object"], "q2": ["not_an_object"], "q3": ["other_type", "version"]}


def test_split_makes_children(spark):
    proposals = spark.createDataFrame([("p", "queued", 3, 0.8)], "proposal_id string, status string, impact_size int, confidence double")
    targets = spark.createDataFrame([("p", t) for t in "abc"], "proposal_id string, target_id string")
    groups = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", 2, "c"), ("p", 2, "c")], "proposal_id string, group_no int, target_id string")
    children, own = store.split(proposals, targets, groups)
    got = children.collect()
    assert len({r.proposal_id for r in got}) == 2 and sorted(r.impact_size for r in got) == [1, 2] and {r.parent_id for r in got} == {"p"} and {r.status for r in got} == {"queued"}
    assert own.count() == 3 and {r.proposal_id for r in own.collect()} == {r.proposal_id for r in got}
    events = store.batch_actions(spark.createDataFrame([], "proposal_id string, action string, created_at timestamp, event_id string"), proposals, "accept", "me", F.to_timestamp(F.lit("2024-01-01")), status="queued")
    assert store.applied(proposals, events).first().status == "accepted_pending_apply"


def test_exports_of_the_review(spark):
    proposals = spark.createDataFrame([("p", "c", "t", "accepted_pending_apply", 0.9, 0.5), ("q", "c", "t", "queued", 0.9, 0.5)], "proposal_id string, issue_class string, proposal_type string, status string, confidence double, priority_score double")
    revisions = spark.createDataFrame([("p", 1, "generated", "old"), ("p", 2, "edited", "new")], "proposal_id string, revision_number int, revision_kind string, patch string")
    events = spark.createDataFrame([("p", "2024-01-02", "e2", "accept"), ("p", "2024-01-01", "e1", "edit")], "proposal_id string, created_at string, event_id string, action string")
    assert [(r.proposal_id, r.patch_spec) for r in warehouse.accepted_patches(proposals, revisions).collect()] == [("p", "new")]
    got = {r.proposal_id: r for r in warehouse.revision_history(proposals, revisions, events).collect()}
    assert [x.patch for x in got["p"].revisions] == ["old", "new"] and [x.action for x in got["p"].correction_events] == ["edit", "accept"] and got["q"].revisions is None


# -- rules of a domain -----------------------------------------------------------------------------------------------------------


def test_rule_problems():
    good = audits.Domain(rules=(("fire", "burn", 1.0),), derived=("fire",), labels=("Place", "Period"), anchor={"entity_type": "Place", "relation": "ABOUT"}, institution_id="i", context="c")
    assert audits.rule_problems(good, {"Place"}) == []
    bad = audits.Domain(rules=(("fire", "(", 1.0), ("rain", "x", 0.0)), policy={("odd", "Robot"): "X"}, preferred={"fire": ("Robot",)}, derived=("fire", "odd"), renames={"old": "gone"}, labels=("Robot",), anchor={"entity_type": "Robot"}, vocabulary_file="/no/such/file")
    text = " | ".join(audits.rule_problems(bad, {"Place"}))
    for part in ("rule 0", "weight 0.0", "derivation of unknown claim type odd", "claim type rain has no derivation", "policy of unknown claim type odd", "policy of unknown entity type Robot", "preference of unknown entity type Robot", "rename to unknown claim type gone", "label Robot has no entity", "entities of type Place have no label", "anchor of unknown entity type Robot", "anchor without a relation", "no institution_id", "no context", "no file /no/such/file"):
        assert part in text, part


def test_bootstrap_ends(spark):
    claims = spark.createDataFrame([("1", "It burned"), ("2", "Rain fell"), ("3", "Snow fell"), ("4", "Nothing")], "claim_id string, source_sentence string")
    more = lambda rules, rest: rules + (("weather", r"\b(rain|snow)\b", 1.0),)
    rules, rates, why = audits.bootstrap(claims, (("fire", r"\bburned\b", 1.0),), more, {"Place"}, target=0.3)
    assert rates == [0.75, 0.25] and why == "target" and len(rules) == 2
    assert audits.bootstrap(claims, (("fire", r"\bburned\b", 1.0),), lambda r, rest: r, {"Place"})[2] == "no_gain"
    assert audits.bootstrap(claims, (("fire", "(", 1.0),), more, set())[2].startswith("rule 0")


def test_chunks_hold_what_they_are_asked_to(spark):
    from fieldlore.plans.graph import Graph

    got = sorted(audits.prewarm(Graph(spark, DATA), chunk=50).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in got] == list(range(len(got))) and all(r.requests == 50 for r in got[:-1]) and 0 < got[-1].requests <= 50


# -- sinks and registries ----------------------------------------------------------------------------------------------------------


def test_warehouse_and_sink(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, n int, t string")
    w.write("t", df)
    w.upsert("t", spark.createDataFrame([("b", 3, "y"), ("c", 4, "z")], "id string, n int, t string"), "id")
    assert rows(w.read("t").select("id", "n")) == [("a", 1), ("b", 3), ("c", 4)]
    w.append("t", df.limit(0))
    with pytest.raises(KeyError):
        w.read("other")
    with pytest.raises(ValueError):
        w.write("../t", df)
    ran = []
    steps = [("one", lambda x: ran.append(1)), ("two", lambda x: ran.append(2))]
    assert w.migrate(steps[:1]) == ["one"] and w.migrate(steps) == ["two"] and ran == [1, 2]
    sink = warehouse.GraphSink(w)
    for _ in range(2):
        sink.nodes("X", df, "id")
        sink.edges("R", spark.createDataFrame([("a", "b"), ("a", "b"), (None, "b")], "s string, t string"), "s", "t")
    sink.nodes("X", spark.createDataFrame([("a", None, "late", 1.0)], "id string, n int, t string, extra double"), "id")
    assert {r.id: (r.n, r.t, r.extra) for r in w.read("node.X").collect()} == {"a": (1, "late", 1.0), "b": (2, "x", None)} and w.read("edge.R").count() == 1
    run = warehouse.connected(w, ["node.X"])
    assert run("SELECT id FROM node_X WHERE t = :t", t="x' OR '1'='1").count() == 0 and run("SELECT id FROM node_X WHERE t = :t", t="x").count() == 1


def test_templates():
    t = warehouse.Templates({"a": lambda x: x + 1})
    t.register("b", lambda x: x)
    assert t.run("a", 1) == 2 and t.run("b", x=5) == 5
    with pytest.raises(ValueError):
        t.register("a", None)
    with pytest.raises(KeyError, match="a, b"):
        t.run("c")


def test_registry(spark, tmp_path):
    r = warehouse.CorpusRegistry(spark, str(tmp_path / "corpora.json"))
    with pytest.raises(KeyError):
        r.default()
    for c in "ab":
        r.register(warehouse.Corpus(c, c.upper(), "res", institutions=("i",)))
    with pytest.raises(ValueError):
        r.register(warehouse.Corpus("a", "A", "res"))
    assert r.default().corpus_id == "a" and r.get("b").institutions == ("i",)
    r.set_default("b")
    assert r.default().corpus_id == "b" and [c.is_default for c in r.all()] == [False, True]
    with pytest.raises(KeyError):
        r.set_default("c")


def test_lines_and_integrity(spark, tmp_path):
    folder = str(tmp_path / "lines")
    for i in range(2):
        warehouse.append_lines(spark.createDataFrame([(f"k{i}",)], "key string"), folder)
    assert rows(files.lines(spark, folder, "key string")) == [("k0",), ("k1",)]
    import hashlib

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    (tmp_path / "f" / "b.txt").write_bytes(b"changed")
    stored = spark.createDataFrame([("a.txt", hashlib.sha1(b"abc").hexdigest()), ("b.txt", "0" * 40), ("c.txt", "1"), ("d.txt", None)], "source_file string, file_hash string")
    assert rows(retrieval.files_integrity(spark, stored, str(tmp_path / "f"))) == [("a.txt", "ok"), ("b.txt", "changed"), ("c.txt", "missing"), ("d.txt", "no_hash")]


# -- streams -----------------------------------------------------------------------------------------------------------------------------


def test_a_replayed_batch_writes_its_rows_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(i, None, i % 3, "click", 1.0, None) for i in range(10)], schema).withColumn("ts", F.current_timestamp()).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    out = str(tmp_path / "out")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    batch = spark.read.parquet(str(source))
    write(batch, 0), write(batch, 0)
    assert spark.read.parquet(out).count() == 10
    assert logs.drained(logs.once_each(stream), "append").count() == 10
    prior = {r.event_id: r.before for r in logs.drained(logs.rolling_prior(stream), "append").collect()}
    assert prior == {i: i // 3 for i in range(10)}


def test_alerts(spark):
    spent = spark.createDataFrame([("click", "2024-01-01", 3.0), ("click", "2024-01-02", 1.0), ("view", "2024-01-01", 9.0)], "event_type string, day string, spent double").withColumn("day", F.to_date("day"))
    got = rows(logs.alerts(spent, {("click", "daily"): (3.0, 0.9), ("click", "monthly"): (5.0, 0.8)}))
    assert got == [("click", "daily", "2024-01-01", 3.0, 3.0), ("click", "monthly", "2024-01", 4.0, 5.0)]


def test_jobs_are_sealed_when_all_items_are_done(spark):
    items = spark.createDataFrame([(1, "purchase"), (2, "error"), (11, "view"), (12, "purchase")], "user_id bigint, state string")
    assert rows(logs.jobs(items).select("job_id", "completed", "failed", "status")) == [(0, 1, 1, "completed"), (1, 1, 0, "running")]


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as N

    from fieldlore import session

    cluster = N(sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None), conf=N(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(cluster)


def test_broadcasts_are_checked_by_bytes(spark):
    from fieldlore import session

    df = spark.createDataFrame([("x" * 1000, ["y" * 100], 1)] * 5, "s string, a array<string>, n int")
    assert session.small_or_plain(df, most=20_000) is not df and session.small_or_plain(df, most=3_000) is df and session.small_or_plain(df, limit=4) is df
    left, right = spark.createDataFrame([(i % 2, i) for i in range(100)], "k int, v int"), spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k int, t string")
    assert rows(session.salted(left, right, "k", limit=0).select("k", "v", "t")) == rows(left.join(right, "k").select("k", "v", "t"))


def test_own_patterns_of_personal_data(spark):
    df = spark.createDataFrame([("Born on March 3, 1936 he rang (208) 555-0178",), ("dob: 3/3/1936, 12 Mill Rd. and 123-45-6789",), ("100 Mallards near Dr. Low",)], "t string")
    from fieldlore.functions import text

    assert [r.x for r in df.select(text.redact(F.col("t")).alias("x")).collect()] == ["Born on March 3, 1936 he rang [PHONE REDACTED]", "[DOB REDACTED], [ADDRESS REDACTED] and [SSN REDACTED]", "100 Mallards near Dr. Low"]
    claims = df.withColumn("claim_id", F.monotonically_increasing_id().cast("string")).withColumnRenamed("t", "source_sentence")
    assert sorted(r.group_key for r in detectors.sensitive(claims).collect()) == ["date_of_birth", "ssn"]
    bad = ["please ignore previous notes", "New instructions follow", "system : do", "<assistant>", "The system worked"]
    assert [r.x == "[content withheld]" for r in spark.createDataFrame([(b,) for b in bad], "t string").select(text.safe_context(F.col("t")).alias("x")).collect()] == [True, True, True, True, False]


def test_saved_searches(spark, tmp_path):
    s = warehouse.SavedSearches(warehouse.Warehouse(spark, str(tmp_path / "w")))
    assert s.of("a").count() == 0 and not s.delete("a", "x")
    s.save("a", "x", "teal"), s.save("a", "x", "blue teal"), s.save("b", "x", "fire"), s.save("a", "y", "rain")
    assert sorted((r.name, r.query) for r in s.of("a").collect()) == [("x", "blue teal"), ("y", "rain")]
    assert s.delete("a", "x") and [r.name for r in s.of("a").collect()] == ["y"] and [r.query for r in s.of("b").collect()] == ["fire"]


def test_payload_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text('{"b": [1, 2],\n "a": "é"}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"a":"é","b":[1,2]}', encoding="utf-8")
    (tmp_path / "c.json").write_text("{broken")
    got = {r.path.rsplit("/", 1)[1]: r.file_hash for r in files.payload_hashes(spark, str(tmp_path)).collect()}
    want = hashlib.sha1(json.dumps({"b": [1, 2], "a": "é"}, sort_keys=True).encode()).hexdigest()
    assert got == {"a.json": want, "b.json": want, "c.json": None}
