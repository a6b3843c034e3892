import pytest

from fieldlore.llm import names

PEOPLE = ["Edward Gribelquist", "Winifred Irvovane", "W. Irvovane", "Leonard C. Irvovane", "Robert A. Quillbury", "Florence Quillbury", "Harlan Wickelow", "Dorothy A. Yarrorigg"]
GROUPS = ["Rushford Valley Sportsmen's Association", "Historical Society of Selwick Township", "Hollin County Grange", "Hollin Valley Irrigation Company", "Tamarn Township Farmers' Cooperative"]
FORMS = {
    "GRIBELQUIST, Edward": ["Edward Gribelquist"], "Girbelquist, Ed": ["Edward Gribelquist"], "Mr. Gribelquist": ["Edward Gribelquist"], "Edward  Gribel- quist": ["Edward Gribelquist"], "Ambrose Gribelquist": [],
    "Winnie Irvovane": ["W. Irvovane", "Winifred Irvovane"], "Len Irvvoane": ["Leonard C. Irvovane"], "Capt. Irvovane": [], "Quillbury": [], "F. Qui11bury": ["Florence Quillbury"], "R.A. Quillbury": ["Robert A. Quillbury"], "R. B. Quillbury": [],
    "H. Wickelwo": ["Harlan Wickelow"], "Dot Yarrorigg": ["Dorothy A. Yarrorigg"], "R.V.S.A.": ["Rushford Valley Sportsmen's Association"], "Rushford Vly. Sptsmns Assn.": ["Rushford Valley Sportsmen's Association"],
    "The Selwick Twp. Historical Soc.": ["Historical Society of Selwick Township"], "HOLLIN COUNTY GRANGE": ["Hollin County Grange"], "HoUin Co. Grange": ["Hollin County Grange"], "Hollin County Grnage": ["Hollin County Grange"], "Tamaru Township Farmers Cooperative": ["Tamarn Township Farmers' Cooperative"], "Tamam Township Farmers’ Co-op": ["Tamarn Township Farmers' Cooperative"],
    "Hollin Valley": [], "Dunmarsh County Grange": [], "x": [], "  ": [], None: [], "Winifred " * 400: [],
}


@pytest.fixture(scope="module")
def frames(spark):
    mentions = spark.createDataFrame([(f"m{i}", f, "clash") for i, f in enumerate(FORMS)] + [("m0", "GRIBELQUIST, Edward", "clash"), (None, "Mr. Gribelquist", None)], "mention_id string, surface_form string, name string")
    entities = spark.createDataFrame([("Person", n) for n in PEOPLE] * 2 + [("Organization", n) for n in GROUPS] + [("Place", "Girbelquist"), ("Person", None), (None, "Mr. Gribelquist")], "entity_type string, name string")
    return mentions, entities


def test_links(frames):
    got = {(r.key_a, r.key_b) for r in names.link(*frames).collect()}
    want = {tuple(sorted((f"m{i}", n))) for i, (f, ns) in enumerate(FORMS.items()) for n in ns} | {("W. Irvovane", "Winifred Irvovane")}
    assert got == want


def test_blocking_loses_nothing(frames, spark, monkeypatch):
    """The same links as comparing every spelling with every name, also when most keys are common."""
    forms = [f for f in FORMS if f and f.strip()]
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    got = {(r.form, r.name) for r in names.form_links(df, frames[1].where("entity_type IN ('Person','Organization') AND name IS NOT NULL")).collect()}
    import pandas as pd

    everything = [{"entity_type": t, "name": n} for t, ns in (("Person", PEOPLE), ("Organization", GROUPS)) for n in ns]
    brute = next(names._decide([pd.DataFrame({"form": forms, "names": [everything] * len(forms)})]))
    assert got == set(zip(brute["form"], brute["name"]))


def test_empty(frames):
    assert names.link(frames[0].limit(0), frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("abc", "abc", 3), ("abcbdab", "bdcaba", 4), ("xay", "bac", 1)])
def test_common_subsequence(a, b, n):
    assert names.common(a, b) == n


SHORT_NAMES = ["Amy Lee", "Kim Ng", "Wu Li", "Frank Orr", "Ann Lees", "Tom Smith"]
SHORT_FORMS = {"Lee, Amy": "Amy Lee", "A. Lee": "Amy Lee", "Ng, Kim": "Kim Ng", "K. Ng": "Kim Ng", "Li, Wu": "Wu Li", "F. Orr": "Frank Orr", "Orr, F.": "Frank Orr", "T. Smih": "Tom Smith", "T. Smitth": "Tom Smith", "Ng": None, "Jo Ng": None, "Lees, Ann": "Ann Lees"}


def test_short_names_meet(spark):
    mentions = spark.createDataFrame([(f"m{i}", f) for i, f in enumerate(SHORT_FORMS)], "mention_id string, surface_form string")
    entities = spark.createDataFrame([("Person", n) for n in SHORT_NAMES], "entity_type string, name string")
    got = {(r.key_a, r.key_b) for r in names.link(mentions, entities).collect()}
    assert got == {tuple(sorted((f"m{i}", n))) for i, n in enumerate(SHORT_FORMS.values()) if n}


def test_keys_lose_no_candidate():
    """Whatever scores against a name shares a key with it, for one error anywhere in surnames of all lengths."""
    import itertools

    for n in range(3, 12):
        surname = "abcdefghijkl"[:n]
        for i, change in itertools.product(range(n), ("x", "")):
            wrong = surname[:i] + change + surname[i + 1 :]
            form, name = f"Q. {wrong.title()}", f"Quentin {surname.title()}"
            if names.person_score(form, name):
                assert names.keys(form) & names.keys(name), (form, name)


def test_common_keys_are_refined(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 1)
    people = ["Edward Marsh", "Emil Marsh", "Walter Marsh", "Edwin Tarsh"]
    df = spark.createDataFrame([("Walter Marrsh",), ("Emil Mrsh",), ("W. Marsh",)], "form string")
    vocabulary = spark.createDataFrame([("Person", n) for n in people], "entity_type string, name string")
    assert {(r.form, r.name) for r in names.form_links(df, vocabulary).collect()} == {("Walter Marrsh", "Walter Marsh"), ("Emil Mrsh", "Emil Marsh"), ("W. Marsh", "Walter Marsh")}
