import random

import pytest

from fieldlore.llm import boilerplate as b

PAGE = "page_id string, doc_id string, raw_ocr_text string, series string"
RECORD = "doc_id string, series string, key string"
NOTICE = "Printed at the press on paper saved from 1931 forms."


def test_folding_joins_misread_lines_and_keeps_numbers_apart():
    same = ["Printed at the press on paper", "  PRlNTED at the prcss on paper ~", "Printed attbe press on pa per.", "Príntcd at thc press 0n paper"]
    assert len({b.fold_page(x)[0] for x in same}) == 1
    assert b.fold_page("report of 1906 here")[0] != b.fold_page("report of 1908 here")[0]


def test_bytes_fold_as_characters_do():
    for t in ("It was 1906 – “so” µ", "El niño «bajó» ¬ 3º ß½ • x", "Пожар №7 rn", "Straße Œ ﬁ", "".join(map(chr, range(32, 400)))):
        assert b.fold_text(t) == t.lower().translate(b.folding()).replace("rn", "m").replace("nn", "m")


@pytest.mark.parametrize("limit", [None, -1])
def test_lines_of_a_source(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr("fieldlore.session.BROADCAST_ROWS", limit)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("gauge marsh heron ditch willow crossing tower October warden sack".split()) + str(rng.randint(0, 999)) for _ in range(8))
    writings = [NOTICE, NOTICE.upper(), "Printed at the press 0n papcr saved from 1931 forms", "Prinxed at the prewss on paper saved from 1931 forms.", NOTICE]
    records = [(f"d{i}", "A" if i < 20 else None if i == 20 else "B", "x") for i in range(31)] + [("d0", "A", "x"), (None, "A", None)]
    pages, want = [], set()
    for i in range(31):
        lines = [text(), "", text()]
        if i < 5 or 20 <= i < 23:
            lines.insert(1, writings[i % 5])
            if i < 5:
                want.add((f"p{i}", 2))
        if 5 <= i < 12:
            lines.append(NOTICE.replace("1931", str(1940 + i)))  # another number each: no repeated line
        if i < 8:
            lines.append("short 12 line")
        pages.append((f"p{i}", f"d{i}", "\n".join(lines), "clash"))
    pages += [pages[0], ("q1", "d1", None, None), ("q2", "d1", "", None), ("q3", None, NOTICE, None), ("q4", "d4", " \n" + NOTICE, None)]
    want.add(("q4", 2))
    found = b.repeated_lines(spark.createDataFrame(pages, PAGE), spark.createDataFrame(records, RECORD))
    assert {(r.page_id, r.line_no) for r in found.collect()} == want
    clean = {r.page_id: r.text for r in b.without_lines(spark.createDataFrame(pages, PAGE), found).collect()}
    assert clean["p0"] == pages[0][2].replace(NOTICE + "\n", "") and clean["p30"] == pages[30][2] and clean["q1"] is None and clean["q4"] == " "


def test_empty(spark):
    assert b.repeated_lines(spark.createDataFrame([], PAGE), spark.createDataFrame([], RECORD)).count() == 0


def spoiled(rng: random.Random, text: str, spots: list[int]) -> str:
    """Other letters at some places, of another class each."""
    wrong = {c for c in "kpwmxé"}
    return "".join(rng.choice(sorted(wrong - {c.lower()})) if i in spots else c for i, c in enumerate(text))


@pytest.mark.parametrize("size", [9, 150])
def test_no_writing_of_a_cluster_is_frequent(spark, size):
    # each document misreads the line elsewhere: no folded writing stands in two documents
    rng, share = random.Random(5), -(-size // 5) if size > 20 else 4
    text = lambda: "".join(rng.choice("bcdghklmprtuwxy") for _ in range(45))
    pages, want, seen = [], set(), set()
    for i in range(size):
        lines = [text(), text()]
        while i < share and len(lines) == 2:
            line = spoiled(rng, NOTICE, rng.sample([3, 8, 16, 27, 33, 36, 47], 2))
            if b.fold_page(line)[0] not in seen:
                seen.add(b.fold_page(line)[0])
                lines.append(line)
                want.add((f"p{i}", 3))
            elif len(seen) >= 50:
                break
        pages.append((f"p{i}", f"d{i}", "\n".join(lines), None))
    records = spark.createDataFrame([(f"d{i}", "A", "x") for i in range(size)], RECORD)
    found = b.repeated_lines(spark.createDataFrame(pages, PAGE), records).collect()
    assert {(r.page_id, r.line_no) for r in found} == want and {r.documents for r in found} == {share}
    # one document less: no cluster
    fewer = spark.createDataFrame(pages[1:], PAGE)
    assert b.repeated_lines(fewer, records).count() == 0


def test_short_lines_and_lines_that_folding_shortens(spark):
    short = ["Record of marsh bird counts", "Recxrd of marsx bird counts"]  # no ten characters from the start, nor the last, are right
    folds = ["Nanna Minna Hannnn", "Nanna Minna Hannnm"]
    assert len(b.fold_page(folds[0])[0]) < 13
    pages = [(f"p{i}", f"d{i}", f"{short[i // 3]}\n{folds[i // 3]}", None) for i in range(4)]
    records = spark.createDataFrame([(f"d{i}", "A", "x") for i in range(20)], RECORD)
    found = b.repeated_lines(spark.createDataFrame(pages, PAGE), records)
    assert {(r.page_id, r.line_no) for r in found.collect()} == {(f"p{i}", n) for i in range(4) for n in (1, 2)}


def test_bounds_leave_out_no_pair():
    from fieldlore.llm.names import ratio

    rng = random.Random(6)
    lines = {"", "k", "kk"}
    for n in (3, 15, 16, 30, 63, 64, 65, 90):
        for _ in range(6):
            line = "".join(rng.choice("oooiiinnbgpwmkr367é漢") for _ in range(n))
            lines.add(line)
            for _ in range(8):
                near = list(line)
                for _ in range(rng.randint(0, max(1, n // 7))):
                    at = rng.randrange(len(near) + 1)
                    near[at : at + rng.randint(0, 1)] = rng.choice(["", "o", "x", "n"])
                lines.add("".join(near))
    folded = sorted(lines)
    everything = [(x, y) for y in range(len(folded)) for x in range(y)]
    want = {(x, y) for x, y in everything if abs(len(folded[x]) - len(folded[y])) <= 0.2 * max(len(folded[x]), len(folded[y])) and ratio(folded[x], folded[y]) >= b.NEAR}
    assert set(b.Lines(folded).linked(b._within(b.np.arange(len(folded))))) == want and len(want) > 200


def test_parts_of_a_source_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("gauge marsh heron ditch willow crossing tower October warden sack".split()) + str(rng.randint(0, 999)) for _ in range(6))
    other = "Carbon copies go to the field office and the file."
    pages = []
    for i in range(60):
        lines = [text(), text()]
        if i < 14:
            lines.append(spoiled(rng, NOTICE, rng.sample(range(20), 1)))
        if 20 <= i < 31:
            lines.append(spoiled(rng, other, rng.sample(range(20), 1)))  # eleven of sixty: too few
        pages.append((f"p{i}", f"d{i}", "\n".join(lines), None))
    tables = spark.createDataFrame(pages, PAGE), spark.createDataFrame([(f"d{i}", "A", "x") for i in range(60)], RECORD)
    for part in (64, 8, 2):
        monkeypatch.setattr(b, "PART", part)
        found = b.repeated_lines(*tables).collect()
        assert {(r.page_id, r.line_no, r.documents) for r in found} == {(f"p{i}", 3, 14) for i in range(14)}
