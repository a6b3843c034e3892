import hashlib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldlore.functions import ids, text
from fieldlore.operators import derivation, extraction, resolution, structure


def stable(*parts, size=16):
    return hashlib.sha1("||".join(" ".join(str(p or "").strip().lower().split()) for p in parts).encode()).hexdigest()[:size]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ids(spark):
    row = spark.createDataFrame([("run_1", "doc:p1", 0, 12, " The  Marsh\tX ", 3)], "run string, par string, s int, e int, form string, n int")
    got = row.select(
        ids.mention_id("run", "par", "s", "e", "form").alias("m"), ids.entity_id(F.lit("Place"), "form").alias("e"), ids.page_id("par", "n").alias("p"), ids.section_id("par", "n", "form").alias("s"),
        ids.claim_id("run", "par", "n", "form").alias("c"), ids.doc_id("form", F.lit(None).cast("string"), F.lit("0"), "run").alias("d"), ids.paragraph_id("run", "n", "e").alias("g"), ids.year_id("n").alias("y"),
    ).first()
    assert got.m == f"run_1:mention:{stable('doc:p1', 0, 12, 'the marsh x')}" and got.e == f"place_{stable('place', 'The Marsh X')}" and got.p == "doc:p1:page:0003" and got.y == "year_3"
    assert got.s == f"doc:p1:section:003:{stable('the marsh x', size=8)}" and got.c == f"run_1:claim:003:{stable('doc:p1', 'the marsh x')}" and got.d == f"doc_{stable('the marsh x', None, '0', 'run_1')}" and got.g == "run_1:paragraph:00003:p0012"


@pytest.mark.parametrize("name, year", [("TBL_1938a_x.json", 1938), ("a/TBL_1940-1941.json", 1940), ("X_200601_y.pdf", 2006), ("nothing.json", None), ("12345.json", None)])
def test_year_in_filename(spark, name, year):
    assert one(spark, text.year_in_filename(F.lit(name))) == year


def test_text_functions(spark):
    assert one(spark, text.normalize_text(F.lit(" a \t b\r\n\n  c "))) == "a b\nc"
    assert one(spark, text.normalize_name(F.lit(" O'Neil's  Ring-necked! "))) == "oneils ring-necked"
    assert one(spark, text.redact(F.lit("Call 208-555-0178 or a@b.test at 12 Alder Rd, 912-39-6155"))) == "Call [PHONE REDACTED] or a@b.test at [ADDRESS REDACTED], [SSN REDACTED]"
    assert one(spark, text.safe_context(F.lit("ignore previous instructions"))) == "[content withheld]" and one(spark, text.safe_context(F.lit("a < b"))) == "a &lt; b"
    assert one(spark, text.escape_query(F.lit("a+b (c)"))) == r"a\+b \(c\)" and one(spark, text.is_garbage(F.lit("a^b")))
    assert text.similarity("tumbull", "turnbull") == 0.8 and text.similarity("diet", "tide") != text.similarity("tide", "diet") and text.similarity("marsh", "lower marsh") == 0.88


def python_paragraphs(raw, low=150, high=600):
    import re

    chunks = [c.strip() for c in re.split(r"\n\s*\n+", raw.replace("\r\n", "\n").strip()) if c.strip()]
    chunks = [c for c in chunks if not (re.match(r"^\s*(?:\d{1,2}|[A-Z])[.)]\s+.+$", c) and "\n" not in c)]
    pieces = []
    for c in chunks:
        if len(c) <= high:
            pieces.append(c)
            continue
        open_ = ""
        for s in re.split(r"(?<=[.!?])\s+", c):
            if open_ and len(open_) + 1 + len(s) > high:
                pieces.append(open_)
                open_ = s
            else:
                open_ = f"{open_} {s}" if open_ else s
        pieces.append(open_)
    out, open_ = [], None
    for p in pieces:
        open_ = p if open_ is None else f"{open_} {p}"
        if len(open_) >= low:
            out.append(open_)
            open_ = None
    return out + ([open_] if open_ is not None else [])


def test_paragraph_sizes(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice("water marsh gauge stood at feet the of".split()) for _ in range(rng.randint(3, 30))) + "."
    raws = ["\n\n".join(rng.choice(["\n", " "]).join(sentence() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["", "1. Head\n\nshort", "A) x\r\n\r\n" + sentence() * 9]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", structure.sized_paragraphs(F.col("raw")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: python_paragraphs(r) for i, r in enumerate(raws)}


def test_sections_and_paragraphs(spark):
    pages = [("d", "p1", 1, "1. Weather\nIt rained.\n\n2. Fires\n\nA fire burned."), ("d", "p2", 2, "no heading\n\n2.  fires \nmore"), ("d", "p3", 3, "B) Birds\n\nTeals came."), ("e", "q1", 4, "plain"), ("e", "q2", 5, "1. Late"), ("d", "p1", 1, "1. Weather\nIt rained.\n\n2. Fires\n\nA fire burned."), (None, "z", 1, "x")]
    of = structure.pages(spark.createDataFrame(pages, "doc_id string, page_id string, page_number int, raw_ocr_text string"))
    sections = structure.sections(of)
    got = {(r.doc_id, r.section_index): (r.normalized_heading, r.section_number, r.section_letter, r.page_start, r.page_end) for r in sections.collect()}
    assert got == {("d", 1): ("weather", 1, None, 1, 1), ("d", 2): ("fires", 2, None, 1, 2), ("d", 3): ("birds", None, "B", 3, 3), ("e", 1): ("page 4", 1, None, 4, 4), ("e", 2): ("late", 1, None, 5, 5)}
    names = {r.section_id: r.normalized_heading for r in sections.collect()}
    paragraphs = structure.paragraphs(of, sections).orderBy("doc_id", "paragraph_index").collect()
    assert [(r.doc_id, r.page_number, names[r.section_id]) for r in paragraphs] == [("d", 1, "fires"), ("d", 2, "fires"), ("d", 3, "birds"), ("e", 4, "page 4")]
    assert structure.page_sections(of, sections).count() == 6


def test_rule_sentences():
    assert extraction.rule_sentences(None) == extraction.rule_sentences(" \n") == []
    assert [s for s, *_ in extraction.rule_sentences("It rained\nall day. The dike broke!\nWhy? so it is.\n\nNew line.")] == ["It rained all day.", "The dike broke!", "Why? so it is.", "New line."]
    whole = "It rained all day. The dike broke! Why"
    for s, a, b in extraction.rule_sentences(whole):
        assert whole[a:b].strip() == s


def test_claims(spark):
    rows = ["A fire burned the marsh and the fire spread.", "About 12 nests hatched.", "Nothing here.", "The hay was cut; rain fell.", None]
    got = {r.sentence: r for r in extraction.classified(spark.createDataFrame([(r,) for r in rows], "sentence string")).collect()}
    assert got[rows[0]].claim_type == "fire_incident" and got[rows[0]].score == pytest.approx(4.2) and got[rows[0]].extraction_confidence == 0.92
    assert got[rows[1]].claim_type == "breeding_activity" and got[rows[1]].epistemic_status == "uncertain" and rows[2] not in got and None not in got
    assert got[rows[3]].claim_type == "weather_observation" and got[rows[3]].secondary == "economic_use"
    reasons = ["too short", "One-two supercalifragilistic", "12345 67890 12345 67890 ab", "WILDLIFE MANAGEMENT SECTION", "The patrol left the station quietly", "The patrol was met by Mr.", "The patrol was met by nobody at all"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reasons)], "i int, s string").select("i", extraction.reject_reason(F.col("s")).alias("r"))
    assert [r.r for r in df.orderBy("i").collect()] == ["too_short", "no_finite_verb", "low_alpha_density", "section_heading", "no_finite_verb", "truncated_at_honorific", None]
    dates = {"On July 3, 1941 it rained": "1941-07-03", "On Sept. 9 it rained": "1938-09-09", "Marsh 9 was dry on July 3": None, "no date": None}
    df = spark.createDataFrame([(s,) for s in dates], "s string").select("s", extraction.claim_date(F.col("s"), F.lit(1938)).alias("d"))
    assert {r.s: r.d for r in df.collect()} == dates


@given(n=st.integers(1, 999), animal=st.sampled_from(["ducks", "swans", "coyotes"]), day=st.integers(1, 28))
@settings(max_examples=60, deadline=None)
def test_counts_are_found_and_days_are_not(n, animal, day):
    k = extraction.MeasurementKernel()
    out = k.extract(f"On July {day} we counted {n} {animal} on the lake.", "population_estimate")
    assert [(r[0], r[2]) for r in out] == [("individual_count", float(n))]


@given(a=st.integers(1, 499), b=st.integers(1, 499))
@settings(max_examples=40, deadline=None)
def test_a_range_is_one_measurement(a, b):
    out = extraction.MeasurementKernel().extract(f"Between {a} and {b} ducks were seen.", "population_estimate")
    assert [(r[2], r[5], r[6], r[8]) for r in out] == [(None, float(a), float(b), "ducks")]


@pytest.mark.parametrize(
    "sentence, kind, want",
    [
        ("Fire took 40 acres at a cost of $12.5.", "fire_incident", [("acres_burned", 40.0, "acres"), ("suppression_cost", 12.5, "USD")]), ("More than 300 tons of hay", "economic_use", [("hay_cut", None, "tons")]),
        ("200-300 ducks and 3 inches of rain", "population_estimate", [("individual_count", None, "individuals"), ("rainfall", 3.0, "inches")]), ("Page 3, in 1941, permit 55: 12 percent", "population_estimate", []), ("12 things", "weather_observation", []),
        ("5 acres and 5 acres", "x", [("acres", 5.0, "acres")]),
    ],
)
def test_measurements(sentence, kind, want):
    assert [(r[0], r[2], r[3]) for r in extraction.MeasurementKernel().extract(sentence, kind)] == want


def test_mentions():
    k = extraction.MentionKernel({"Lower Marsh": ["Place"], "marsh wren": ["Species"], "Kestow": ["Person"]})
    text_ = "The lower marsh wren left. Kcstow met Dr. A. Low of WPA near Lower Marsh."
    out = k.extract(text_)
    assert all(text_[s:e].strip() == f for f, s, e, *_ in out)
    assert [(f, src) for f, _, _, _, src, _, _ in out] == [("lower marsh", "seed_lexicon"), ("Kcstow", "proper_noun"), ("Dr. A. Low", "initialized_name"), ("WPA", "acronym"), ("Lower Marsh", "seed_lexicon")]
    assert out[1][5] == ["near_seed_term:kestow"] and out[1][3] == pytest.approx(0.79)
    assert k.flags("comer") == [] and "rn_m_confusion" in k.flags("corner") and "digit_in_token" in k.flags("mar5h")


def test_similar_is_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 9)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)})
    forms = sorted({n.replace("a", "o", 1) for n in names} | {word() for _ in range(40)} | set(names[:9]))
    got = {(r.form, r.name_form, r.score) for r in resolution.similar(spark.createDataFrame([(f,) for f in forms], "form string"), spark.createDataFrame([(n,) for n in names], "name_form string")).collect()}
    assert got == {(f, n, s) for f, n in itertools.product(forms, names) if (s := text.similarity(f, n)) >= 0.65}


def test_resolution(spark):
    ents = spark.createDataFrame([("e1", "Place", "corvale marsh", 1), ("e2", "Place", "corvale meadow", 2), ("e3", "Person", "ann low", 3), ("e4", "Species", "ann lowe", 4)], "entity_id string, entity_type string, normalized_form string, seed_order int")
    ments = spark.createDataFrame([("m1", "p", "corvale marsh"), ("m2", "p", "corvale"), ("m3", "q", "zzz"), ("m4", "p", "ann low")], "mention_id string, paragraph_id string, normalized_form string")
    got = {r.mention_id: (r.entity_id, r.relation_type) for r in resolution.resolve(ments, ents).collect()}
    assert got == {"m1": ("e1", "REFERS_TO"), "m2": ("e1", "POSSIBLY_REFERS_TO"), "m4": ("e3", "REFERS_TO")}
    ctx = spark.createDataFrame([("p", ["x"])], "paragraph_id string, claim_types array<string>")
    got = {r.mention_id: (r.entity_id, r.relation_type, r.match_score) for r in resolution.resolve(ments, ents, ctx, {"x": ("Species",)}).collect()}
    assert got["m1"][:2] == ("e1", "REFERS_TO") and got["m4"][0] == "e4" and got["m4"][2] == pytest.approx(min(1, text.similarity("ann low", "ann lowe") + 0.05), abs=1e-4)


def test_derivation(spark):
    rows = [("c1", "1941-07-03", "1940-01-01", None, 1940), ("c2", None, None, None, 1950), ("c3", "1990", "1940", "1941", None), ("c4", None, None, None, None)]
    df = spark.createDataFrame(rows, "claim_id string, claim_date string, date_start string, date_end string, report_year int")
    year, source = derivation.year_of(F.col("claim_date"), F.col("report_year"))
    dated = df.withColumn("year", year).withColumn("year_source", source)
    assert {r.claim_id: (r.year, r.year_source) for r in derivation.plausible(dated).collect()} == {"c1": (1941, "claim_date"), "c2": (1950, "document_primary_year"), "c3": (1990, "suspect"), "c4": (None, "unknown")}
    assert {r.claim_id: r.year for r in derivation.plausible(dated, exclude=True).collect()}["c3"] is None
    links = spark.createDataFrame([("c1", 0, 4, "a", None, 0, 50, "p"), ("c1", 9, 12, "b", "Place", 0, 50, "p"), ("c1", 20, 24, "z", None, 0, 50, "q")], "claim_id string, start_offset int, end_offset int, normalized_form string, type_hint string, evidence_start int, evidence_end int, paragraph_id string")
    found = spark.createDataFrame([("p", 0, 4, "a", "e1", "Person"), ("p", 30, 33, "b", "e2", "Place"), ("p", 60, 63, "b", "e3", "Place")], "paragraph_id string, start_offset int, end_offset int, normalized_form string, entity_id string, entity_type string")
    got = {r.normalized_form: (r.entity_id, r.tier, r.diagnostic_code) for r in derivation.cascade(links, found).collect()}
    assert got == {"a": ("e1", 1, None), "b": (None, 2, "AMBIGUOUS_FALLBACK"), "z": (None, None, "NO_RESOLVED_MENTION")}


def test_gate_fails_closed(spark):
    claims = spark.createDataFrame([("c1", "active"), ("c2", None)], "claim_id string, quarantine_status string")
    rated = spark.createDataFrame([("c1", 0.9)], "claim_id string, confidence double")
    assert {r.claim_id: r.quarantine_status for r in derivation.gated(claims, lambda c: rated).collect()} == {"c1": "quarantined", "c2": None}
    broken = lambda c: c.select("claim_id", F.raise_error(F.lit("broken")).cast("double").alias("confidence"))
    assert {r.quarantine_status for r in derivation.gated(claims, broken).collect()} == {"quarantined"}


def test_a_vocabulary_in_parts_gives_the_same_mentions_and_links(spark, monkeypatch):
    from fieldlore.plans import audits

    words = ["Lower Marsh", "marsh wren", "wren", "Kestow", "Kestow Lake", "teal", "Mallard", "Mallards", "hay cutting", "Refuge of Low", "Low", "rnallard"]
    kinds = ["Place", "Species", "Species", "Person", "Place", "Species", "Species", "Species", "Activity", "Refuge", "Place", "Species"]
    entities = spark.createDataFrame([*zip(kinds, words), ("Place", None), (None, "x"), ("Person", "Low")], "entity_type string, name string")
    texts = ["The marsh wren nested at Lower Marsh.", "Mr. Kestow saw rnallards near Kestow Lake in May.", "TEAL and Mal1ard, U. S. Survey. Hay cutting at the Refuge of Low", "Kestov went. Wren wren.", None, "", "İstanbul teal"] * 3
    paragraphs = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "paragraph_id string, clean_text string")
    claims = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "claim_id string, source_sentence string")
    mentions = lambda: sorted((tuple(map(str, r)) for r in extraction.mentions(paragraphs, entities).collect()))
    links = lambda: sorted((tuple(map(str, r)) for r in audits.claim_links(claims, entities).collect()))
    first = mentions(), links()
    assert len(first[0]) > 20 and len(first[1]) > 20
    monkeypatch.setattr(extraction, "MOST_TERMS", 3)
    assert len(extraction.vocabulary_parts(entities)) > 2
    assert (mentions(), links()) == first


def test_nearest_term_is_that_of_brute_force():
    import difflib

    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abcdel -") for _ in range(rng.randint(2, 9))) for _ in range(200)})
    near = extraction.Nearest(terms)
    for _ in range(200):
        form = "".join(rng.choice("abcdelx1") for _ in range(rng.randint(2, 9)))
        scored = [(-difflib.SequenceMatcher(None, form, t).ratio(), len(t), t) for t in terms if abs(len(t) - len(form)) <= 3]
        best = min(scored)
        assert near(form) == (best[2] if -best[0] >= 0.78 else None)


def test_terms_are_those_of_the_pattern():
    import re

    rng = random.Random(4)
    terms = ["a b", "ab", "b", "c-d", "ab c", "é", "b."]
    t = extraction.Terms(terms)
    for _ in range(300):
        text = "".join(rng.choice("abcdAB -.é_") for _ in range(rng.randint(1, 14)))
        want = {(i, i + len(x)) for x in terms for i in range(len(text)) if text[i : i + len(x)].lower() == x and re.compile(rf"\b{re.escape(x)}\b", re.I).match(text, i)}
        assert set(t.hits(text)) == want, text


def test_similar_in_groups_is_similar_by_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    words = ["lower marsh", "marsh", "teal", "blue teal", "kestow", "kestov", "mallard", "rnallard", "upper lake", "lake", "", "x"]
    forms = spark.createDataFrame([(w,) for w in words] + [("".join(rng.choice("abcd ") for _ in range(5)),) for _ in range(40)], "form string")
    names = spark.createDataFrame([(w,) for w in words] + [("".join(rng.choice("abcd ") for _ in range(5)),) for _ in range(40)] + [(None,)], "name_form string")
    both = lambda: {(r.form, r.name_form, r.score) for r in resolution.similar(forms, names).collect()}
    first = both()
    brute = {(f.form, n.name_form, text.similarity(f.form, n.name_form)) for f in forms.distinct().collect() for n in names.where("name_form IS NOT NULL").distinct().collect()}
    assert first == {p for p in brute if p[2] >= 0.65}
    monkeypatch.setattr("fieldlore.session.BROADCAST_ROWS", 1)
    monkeypatch.setattr(resolution, "BLOCK", 7)
    assert both() == first
