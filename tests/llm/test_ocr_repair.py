import itertools
import random

import pytest

from fieldlore.llm import ocr_repair as o

PAGE = "page_id string, doc_id string, page_number int, raw_ocr_text string, title string"
RECORD = "doc_id string, title string, page_number int"
CLEAN = "the patrol left the lower marsh and the water gauge stood at seven feet with the short-eared owls counted under the tower before october"


def brute(form, word, budget=o.BUDGET):
    """Cheapest way to read the form as the word, by trying every reading of every place."""
    if abs(len(form) - len(word)) > 4:
        return float("inf")
    if not form or not word:
        return 0.0 if form == word else float("inf")
    best = brute(form[1:], word[1:], budget) if form[0] == word[0] else float("inf")
    if budget >= o.PAIR_COST:
        for true, shown in o.CONFUSIONS:
            if form.startswith(shown) and word.startswith(true):
                best = min(best, o.PAIR_COST + brute(form[len(shown) :], word[len(true) :], budget - o.PAIR_COST))
    return best if best <= budget + 1e-9 else float("inf")


@pytest.mark.parametrize("form, word, cost", [("vvere", "were", 0.3), ("aiid", "and", 0.3), ("opiiiions", "opinions", 0.3), ("squirrcls", "squirrels", 0.3), ("frorn", "from", 0.3), ("fhcrc", "there", float("inf")), ("tlieir", "their", 0.3), ("0ct0ber", "october", 0.6), ("ridge", "bridge", float("inf"))])
def test_distance(form, word, cost):
    assert o.distance(form, word) == pytest.approx(cost)


def test_distance_is_that_of_brute_force():
    rng = random.Random(2)
    words = CLEAN.split()
    for w, v in itertools.product(words[:10], words):
        assert o.distance(w, v) == pytest.approx(brute(w, v))
    for _ in range(300):
        w = rng.choice(words)
        true, shown = rng.choice(o.CONFUSIONS)
        f = w.replace(true, shown, 1)
        assert o.distance(f, w) == pytest.approx(brute(f, w)), (f, w)
        assert o.deletes(w) & set().union(*map(o.deletes, o.readings(f))), (f, w)


def test_defects_and_paragraphs(spark):
    body = [(f"b{i}", f"body{i}", 1, CLEAN, "clash") for i in range(30)]
    one = "FIRES AT HOLLIN, MAY 1931 -- page 1\n\nThe patrol left the lovver marsh and the wat-\ner gauge stood at seven * feet.\n\nWith the short-\neared owls counted un¬\ndcr the tower bef0re\n\n- 1 -"
    two = "Fires at Hollin, May 1931   2\noctober the patrol left. Write to a.b@mail.test for the 51st gauge\r\nPage 2"
    pages = [*body, ("p1", "d", 1, one, None), ("p1", "d", 1, one, None), ("p2", "d", 2, two, None), ("p3", "d", 3, None, None), ("p4", "d", 4, " ", None), ("p5", None, 4, "x", None)]
    records = [("d", "Fires at Hollin, May 1931", 1), ("d", "Fires at Hollin, May 1931", 1), (None, "x", 1)]
    df, rec = spark.createDataFrame(pages, PAGE), spark.createDataFrame(records, RECORD)
    got = {tuple(r) for r in o.defects(df, rec).collect()}
    assert got == {("p1", 1, "furniture"), ("p1", 3, "misread"), ("p1", 3, "split"), ("p1", 4, "misread"), ("p1", 7, "split"), ("p1", 8, "misread"), ("p1", 10, "furniture"), ("p2", 1, "furniture"), ("p2", 3, "furniture")}
    text = [r.text for r in o.paragraphs(df, rec).where("doc_id = 'd'").orderBy("paragraph_no").collect()]
    assert text == ["The patrol left the lower marsh and the water gauge stood at seven feet.", "With the short-eared owls counted under the tower before october the patrol left. Write to a.b@mail.test for the 51st gauge"]


def test_empty(spark):
    assert o.defects(spark.createDataFrame([], PAGE), spark.createDataFrame([], RECORD)).count() == 0


def test_pairs_hold_the_counts_of_words(spark):
    df = spark.createDataFrame([("p", "d", 1, "the marsh the mar-\nsh a.b@mail.test 12 the", None)], PAGE)
    pairs = o.pairs(df)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == {("the", "marsh"): 2, ("marsh", "the"): 1, ("marsh", ""): 1, ("the", ""): 1}
    assert {r.word: r.n for r in o.lexicon(pairs).collect()} == {"the": 3, "marsh": 2}


def test_a_lexicon_too_large_for_a_worker_gives_the_same(spark, monkeypatch):
    body = [(f"b{i}", f"body{i}", 1, CLEAN, "clash") for i in range(30)]
    one = "FIRES AT HOLLIN, MAY 1931 -- page 1\n\nThe patrol left the lovver marsh and the wat-\ner gauge stood at seven * feet.\n\nWith the short-\neared owls counted un¬\ndcr the tower bef0re\n\n- 1 -"
    df = spark.createDataFrame([*body, ("p1", "d", 1, one, None), ("p2", "d", 2, "Fires at Hollin, May 1931   2\noctober the patr0l left the lovver marsh", None), ("p3", "e", 1, "thc patrol", None)], PAGE)
    rec = spark.createDataFrame([("d", "Fires at Hollin, May 1931", 1)], RECORD)
    first = sorted(map(tuple, o.defects(df, rec).collect())), sorted(map(tuple, o.paragraphs(df, rec).collect()))
    monkeypatch.setattr(o, "MOST_WORDS", 0)
    assert first == (sorted(map(tuple, o.defects(df, rec).collect())), sorted(map(tuple, o.paragraphs(df, rec).collect())))
    assert len(first[0]) > 6


def test_neighbours_tell_a_word_of_its_own_from_a_misread_one(spark):
    """'aud' stands for 'and' between two words that 'and' often joins, and for itself before 'plain'."""
    pages = [(f"b{i}", f"body{i}", 1, "marsh and water stood and fell", None) for i in range(60)]
    pages += [(f"c{i}", f"c{i}", 1, "the aud plain", None) for i in range(2)] + [("p", "p", 1, "marsh aud water", None)]
    got = {(r.page_id, r.kind) for r in o.defects(spark.createDataFrame(pages, PAGE), spark.createDataFrame([], RECORD)).collect()}
    assert got == {("p", "misread")}


def test_the_sixth_of_equally_cheap_words_can_be_chosen(spark):
    form = "laltlolelul"
    words = sorted(form[:i] + "i" + form[i + 1 :] for i in range(0, 11, 2))
    pages = [(f"b{k}{i}", f"body{k}{i}", 1, f"gauge{k} {w} tower{k}", None) for k, w in zip("abcdef", words) for i in range(20)]
    df = spark.createDataFrame([*pages, ("p", "d", 1, f"gaugef {form} towerf", None)], PAGE)
    got = [r.text for r in o.paragraphs(df, spark.createDataFrame([], RECORD)).where("doc_id = 'd'").collect()]
    assert got == [f"gaugef {words[5]} towerf"]
