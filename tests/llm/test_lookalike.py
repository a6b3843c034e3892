import itertools

from fieldlore.llm import lookalike

TEXTS = [
    "The lake is all but dry.", "Тhe lake is аll but dry.", "Ｔｈｅ　lake is all but dry．", "The lake is all but dry.", "The la​ke is­ all but dry.﻿", "the lake is all but dry.",
    "Jessaström café ﬁre", "Jessaström café fire", "озеро сор", "oзеро cop", "blue-wing", "blue‑wing", "blue–wing", None, "", " ", "​", "1 l I", "a\r\nb", "a\nb", "𝓐lder", "Alder", "Alder", "½", "1/2", "池塘" * 400 + "！", "池塘" * 400 + "!",
]


def expected(texts):
    look = lambda t: lookalike.folded(t.replace("\r\n", "\n")) if t else ""
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] is not None and texts[j] is not None and texts[i] != texts[j] and look(texts[i]) == look(texts[j]) and look(texts[i]).strip()}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS canonical", "'y' AS look")


def test_pairs_are_those_of_brute_force(spark, monkeypatch):
    df = frame(spark, TEXTS)
    pairs = {(r.doc_id_a, r.doc_id_b) for r in lookalike.pairs(lookalike.normalized(df)).collect()}
    assert pairs == expected(TEXTS) and (0, 1) in pairs and (0, 5) not in pairs and (10, 11) in pairs and (10, 12) not in pairs and (21, 22) not in pairs
    monkeypatch.setattr("fieldlore.session.BROADCAST_ROWS", -1)
    assert {(r.doc_id_a, r.doc_id_b) for r in lookalike.pairs(lookalike.normalized(df)).collect()} == pairs


def test_canonical_is_the_most_frequent_spelling(spark):
    texts = ["озеро"] * 3 + ["oзеро", "cop сор cop", "cop"]
    out = {r.doc_id: r.canonical for r in lookalike.normalized(frame(spark, texts)).collect()}
    assert out[3] == "озеро" and out[4] == "cop cop cop"


def test_consistent_is_the_word_by_word_form():
    import random

    rng = random.Random(5)
    parts = ["vіsité", "\u2007", "le", " ", "bajó", "\u202f", "2,33", "\n", "\u200b", "cop", "сор", "\u3000", "a\u00adb", "ﬁre", "\t"]
    # canonical spellings are what the table makes of a word
    for plain, known in ((True, {"cop": "сор"}), (False, {"сор": "cop"})):
        for _ in range(500):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
            want, at = [], 0
            for m in lookalike.WORD.finditer(text):
                want += ["".join("" if c in lookalike.IGNORABLE else lookalike.unfold(c) for c in text[at : m.start()]), lookalike.spelled(m[0], known)]
                at = m.end()
            want.append("".join("" if c in lookalike.IGNORABLE else lookalike.unfold(c) for c in text[at:]))
            assert lookalike.consistent(text, known, plain) == "".join(want)


def test_prefixes_are_cut_at_any_size(spark):
    df = frame(spark, [t for t in TEXTS if t])
    first = {tuple(r) for r in lookalike.respelled(df).collect()}
    assert first == {tuple(r) for r in lookalike.respelled(df, size=1).collect()} and first


def test_trie_walks_at_no_cost():
    trie = lookalike.Trie()
    for w in ("Ossery", "Os​sery", "Оssеry", "Osseri"):
        trie.add(w, 1)
    assert {w for w, _ in trie.alike("Osse­ry")} == {"Ossery", "Os​sery", "Оssеry"}
    assert trie.alike("ossery") == []


def test_empty(spark):
    assert lookalike.pairs(lookalike.normalized(frame(spark, [""]).limit(0))).count() == 0
