from fieldlore.review import detectors

CLAIM = "claim_id string, run_id string, paragraph_id string, claim_type string"
MENTION = "run_id string, paragraph_id string, start_offset int, entity_id string, entity_type string"
EDGE = "claim_id string, entity_id string, relation_type string"


def test_missing_links(spark):
    types = ["population_estimate", "breeding_activity", "habitat_condition", "migration_timing", "fire_incident", "economic_use"]
    claims = spark.createDataFrame([(f"c{i}", "r", "d:p2:para:001", t) for i, t in enumerate(types)] + [("far", "r", "d:p9:para:001", "fire_incident"), ("none", "s", "e:p1:para:001", "fire_incident")], CLAIM)
    edges = spark.createDataFrame([("c0", "species:teal", "SPECIES_FOCUS"), ("c4", "place:fen", "OCCURRED_AT")], EDGE)
    near = spark.createDataFrame([("r", "d:p2:para:001", 9, "species:swan", "Species"), ("r", "d:p2:para:001", 4, "species:teal", "Species"), ("r", "d:p2:para:001", 1, "refuge:hollin", "Refuge"), ("r", "d:p10:para:001", 0, "place:fen", "Place")], MENTION)
    got = {(r.target_id, r.issue_class, r.proposal_type, r.reason) for r in detectors.missing_links(claims, edges, near).collect()}
    species = {(c, "missing_species_focus", "add_claim_entity_link", "species:teal") for c in ("c1", "c3")}
    located = {(c, "missing_event_location", "add_claim_location_link", "refuge:hollin") for c in ("c0", "c1", "c2", "far")}
    assert got == species | located


def test_method_overtrigger(spark):
    claims = spark.createDataFrame([("a", "r", "p", "fire_incident"), ("b", "r", "p", "population_estimate"), ("c", "r", "p", "economic_use")], CLAIM)
    edges = spark.createDataFrame([(c, "surveymethod:aerial count", "METHOD_FOCUS") for c in "aab"] + [("c", "place:fen", "OCCURRED_AT")], EDGE)
    got = [(r.target_id, r.issue_class, r.proposal_type, r.confidence) for r in detectors.method_overtrigger(claims, edges).collect()]
    assert got == [("a", "method_overtrigger", "exclude_claim_from_derivation", 0.8)]


def test_context_paragraphs(spark):
    groups = spark.createDataFrame([("x", "x"), ("x", "y")], "anchor string, entity_id string")
    rows = [("x", f"p{i}", 0, "Xa") for i in range(3)] + [("y", "p9", 5, "Ya"), ("y", "p9", 0, "Yb"), ("x", "p9", 7, "Xa"), ("y", "lost", 0, "Ya")]
    mentions = spark.createDataFrame(rows, "entity_id string, paragraph_id string, start_offset int, surface_form string")
    texts = spark.createDataFrame([(f"p{i}", "r" * 3000, None) for i in range(10)], "paragraph_id string, raw_ocr_text string, clean_text string")
    counts = spark.createDataFrame([("y", 5)], "entity_id string, n int")
    got = detectors.context_paragraphs(groups, mentions, texts, counts).orderBy("place").collect()
    assert [(r.paragraph_id, r.surface_forms, len(r.raw_ocr_text), r.clean_text) for r in got] == [("p9", ["Xa", "Ya", "Yb"], 2000, ""), ("p0", ["Xa"], 2000, ""), ("p1", ["Xa"], 2000, "")]


def test_r7_finds_missing_links_of_tables(spark):
    import __spark_entry__

    found = {r.issue_class for r in __spark_entry__.queries()["r7_proposals"](spark, "/root/testdata/sf0.001").select("issue_class").distinct().collect()}
    assert "missing_event_location" in found
