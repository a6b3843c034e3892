import pytest

from fieldlore.llm import pii

SURNAMES = frozenset(("thorlegard", "druskstead", "umberander", "orvelbrook"))
CASES = [
    ("Dr. Thorlegard of Hollin", [("name", "Thorlegard")]), ("the crew of A. J. Orvelbrook cleared", [("name", "A. J. Orvelbrook")]), ("by Liz\nUmberander near Druskstead Ridge", [("name", "Liz\nUmberander")]),
    ("ROSALIND ORVELBROOK and Mrs. Unheard spoke", [("name", "ROSALIND ORVELBROOK"), ("name", "Unheard")]), ("schrieb Umberander im Juni", [("name", "Umberander")]), ("M. Thorlegard a visité", [("name", "Thorlegard")]), ("Thor-\nlegard came", [("name", "Thor-\nlegard")]), ("ROSALIND ORVEL-\nBROOK came", [("name", "ROSALIND ORVEL-\nBROOK")]),
    ("The U.S. Marsh Survey at St. Ilvan's school, Druskstead Crcek", []), ("Write to r.thorlegard@marsh-survey.example or jo+records (at) a-b (dot) example.", [("email", "r.thorlegard@marsh-survey.example"), ("email", "jo+records (at) a-b (dot) example")]),
    ("the tr@pped hare c@me. Then", []), ("tel. (208) 555-0178, +44 1632 960117, 701 5550158, 509/555-0143 ext. 4, 1-406-555-0199, +1 701\n555 0131 or 555-0126.", [("phone", x) for x in ("(208) 555-0178", "+44 1632 960117", "701 5550158", "509/555-0143", "1-406-555-0199", "+1 701\n555 0131", "555-0126")]),
    ("Identity card B930 329283, social security no. 912-39-6155, passport X9675544, 956 17 6609 and KS-6124-996-23; 913144601", [("id_number", x) for x in ("B930 329283", "912-39-6155", "X9675544", "956 17 6609", "KS-6124-996-23", "913144601")]),
    ("Permit 22-8816, Band no. 524-60278, plates 7844 to 6052 in 1936-1940 for $1,234,567", []),
    ("at 1148 Depot Rd., Garrowby; P.O. Box 123; R.F.D. 2, 1898 Mill Road; Rural Route 1,\nBox 304, Quarley; 314 N. Alder Road, Apt. 18", [("address", x) for x in ("1148 Depot Rd.", "P.O. Box 123", "R.F.D. 2, 1898 Mill Road", "Rural Route 1,\nBox 304", "314 N. Alder Road")]),
    ("Two roads, Highway 16 and 40 Mallards near", []), ("", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_items_of_a_text(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.find(text, SURNAMES)] == want


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000])
def test_permutation(size):
    key = b"k"
    image = [pii.permute(v, size, key) for v in range(size)]
    assert sorted(image) == list(range(size))
    assert [pii.permute(v, size, key, inverse=True) for v in image] == list(range(size))


def test_pseudonyms_keep_format_and_come_back():
    key = b"secret"
    for n in ("(208) 555-0178", "KS-6124-996-23", "X9675544", "000-00-0000", "no digits"):
        p = pii.pseudonym(n, key)
        assert [c if not c.isdigit() else "9" for c in p] == [c if not c.isdigit() else "9" for c in n] and pii.pseudonym(p, key, inverse=True) == n
    assert pii.pseudonym("208-555-0178", key)[:3] != "208" or pii.pseudonym("208-555-0178", key) != "208-555-0178"
    assert pii.date_pseudonym(pii.date_pseudonym("1936-02-29", key), key, inverse=True) == "1936-02-29" and pii.date_pseudonym("2036-02-29", key) == "2036-02-29"


def test_frames(spark):
    text = "Dr. Quarrobury left. Mr. Quarrobury came. Then Quarrobury rang 208-555-0178."
    rows = [("a", text, "x"), ("a", text, "x"), ("b", None, "x"), ("c", "", "x"), (None, text, "x"), ("d", "Call 208-555-0178. " * 3000, "x")]
    df = spark.createDataFrame(rows, "record_id string, text string, kind string")
    got = {tuple(r) for r in pii.items(df).where("record_id <> 'd'").collect()}
    assert got == {("a", "name", text.index("Quarrobury")), ("a", "name", 25), ("a", "name", 47), ("a", "phone", 63)}
    assert pii.items(df).where("record_id = 'd'").count() == 3000
    out = {r.record_id: r.text for r in pii.masked(df, b'0123456789abcdef').collect()}
    assert out["b"] is None and out["c"] == "" and "Quarrobury" not in out["a"] and "[NAME " in out["a"] and out["a"].count("[PHONE ") == 1
    assert out["a"].split("[PHONE ")[1][:12] == out["d"].split("[PHONE ")[1][:12]
    assert pii.items(df.limit(0)).count() == 0
    # every row is masked, repeated ones and those without a key too
    assert pii.masked(df, b"0123456789abcdef").count() == len(rows)
    with pytest.raises(ValueError):
        pii.masked(df, b"short")


def test_a_lexicon_too_large_for_a_worker_gives_the_same(spark, monkeypatch):
    text = "Dr. Quarrobury left. Mr. Quarrobury came. Then Quarrobury and Quarroburv rang 208-555-0178."
    rows = [("a", text), ("a", text), ("b", "Quarrobury came"), ("c", "nobody"), (None, "Quarrobury"), ("d", None)]
    df = spark.createDataFrame(rows, "record_id string, text string")
    key = b"0123456789abcdef"
    first = sorted(map(tuple, pii.items(df).collect())), sorted(map(str, pii.masked(df, key).collect()))
    monkeypatch.setattr(pii, "MOST_SURNAMES", 0)
    assert first == (sorted(map(tuple, pii.items(df).collect())), sorted(map(str, pii.masked(df, key).collect()))) and len(first[0]) == 6


def test_names_reach_as_far_as_they_do():
    long = " ".join(["Edward"] * 40)
    assert pii.find(f"by {long} Thorlegard.", SURNAMES) == [(3, 3 + len(long) + 11, "name")]


@pytest.mark.parametrize("number, code", [("+1 208 555 0178", "+1"), ("+44 1632 960117", "+44"), ("+12085550178", "+1"), ("1-406-555-0199", "1"), ("208-555-0178", ""), ("+4930123456", "+49")])
def test_the_country_code_stays(number, code):
    assert pii.country_code(number) == code and pii.placeholder("phone", number, b"k")[7:].startswith(code)


@pytest.mark.parametrize("text, shape", [
    ("seen May 27, 1936 and May\n10, Sept. 3", r"seen \[DATE [A-Z][a-z]+ \d{1,2}, 19\d\d\] and \[DATE [A-Z][a-z]+\n\d{1,2}\], \[DATE [A-Z][a-z]+\. \d{1,2}\]"),
    ("el 7 de octubre de 1950. Am 3. März 1941, le 1er août 1888", r"el \[DATE \d{1,2} de [a-z]+ de 19\d\d\]\. Am \[DATE \d{1,2}\. [A-Z]\w+ 19\d\d\], le \[DATE \d{1,2}er \w+ 18\d\d\]"),
    ("on 12 October 1950, 1936-02-29; Octobcr l2", r"on \[DATE \d{1,2} [A-Z][a-z]+ 19\d\d\], \[DATE 19\d\d-\d\d-\d\d\]; \[DATE [A-Z][a-z]+ \d{1,2}\]"),
    ("June 31, May 1951, it may 5 times, 12 may go, permit 22, Page 3, 40 Mallards", r"June 31, May 1951, it may 5 times, 12 may go, permit 22, Page 3, 40 Mallards"),
])
def test_dates_are_masked_in_their_format(text, shape):
    import re

    assert re.fullmatch(shape, out := pii.mask(text, SURNAMES, b"k")), out
    for d in pii.dates(text):
        new = pii.date_placeholder(text, d, b"k")[6:-1]
        back = pii.dates(new)[0]
        assert pii.dates(pii.date_placeholder(new, back, b"k", inverse=True)[6:-1])[0][4] == d[4]


def test_equal_dates_stay_equal_in_all_forms():
    day = lambda t: pii.dates(pii.mask(t, SURNAMES, b"k"))[0][4]
    assert day("May 27, 1936") == day("27 de mayo de 1936") == day("1936-05-27") == day("27. Mai 1936") != day("May 28, 1936")


def test_numbers_are_validated_and_stay_valid():
    assert pii.is_number("phone", "208-555-0178", "2085550178") and not pii.is_number("phone", "108-555-0178", "1085550178") and not pii.is_number("id_number", "000-12-3456", "000123456")
    for i in range(300):
        out = pii.placeholder("phone", f"208-555-{i:04d}", b"k")[7:-1]
        assert pii.is_number("phone", out, out.replace("-", ""))
    assert pii.placeholder("phone", "2O8-555-0l78", b"k") == pii.placeholder("phone", "208-555-0178", b"k")
    assert "-" not in pii.placeholder("id_number", "666-12-3456", b"k")
    assert pii.placeholder("id_number", "KS-6l24-996-23", b"k") == pii.placeholder("id_number", "KS-6124-996-23", b"k")


@pytest.mark.parametrize("text, item", [
    ("write jo [ at ] marsh.example now", "jo [ at ] marsh.example"), ("write jo at\nmarsh dot\nexample now", "jo at\nmarsh dot\nexample"), ("to P. O. B0x 12 there", "P. O. B0x 12"), ("to RFD 2 there", "RFD 2"),
    ("SOCIAL SECURITY NO. 12 34 56 78", "12 34 56 78"), ("IDENTITY CARD 12 34 56 78", "12 34 56 78"),
])
def test_no_item_is_skipped_for_lack_of_a_usual_mark(text, item):
    assert item in [text[s:e] for s, e, _ in pii.find(text, SURNAMES)]
