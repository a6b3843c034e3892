import itertools
import random

import pytest

from fieldlore.llm import sentences as s

CASES = {
    "en": ["The U.S. survey sent Mr. A. J. Low at 5 p.m.", "No coots were seen (cf. p. 3) on Dec. 20, i.e. late.", '"Have they come?" asked Ed.', 'The sign reads "No shooting. Keep out!" and stays.', "Snow lay 3.5 in. deep until Jan.", "The end..."],
    "de": ["Am 19. Oktober regnete es nur 0,76 mm.", "Hr. Eskel kam, d. h. spät.", "„Der See ist leer“, schrieb er.", "Welch früher Frühling!"],
    "es": ["Antes de las 9 p. m.", "¡Qué primavera!", "¿Se secó la charca?", "El Sr. Low vino."],
    "fr": ["Quel printemps !", "« La mare est vide », nota M. Low.", "Les travaux (fossés, etc.) ont duré."],
    "ru": ["Упал по сравнению с 1946 г.", "Какая весна!", "Чинили рабочие, т. е. вся бригада."],
    "hi": ["वर्षा 8.83 से.मी. दर्ज की गई।", "डॉ. ने जाँच की।", "क्या तालाब सूख गया था?"],
    "ar": ["انخفض الماء 10.8 متر.", "هل جفت البركة؟", "لم تسجل أي حرائق!"],
}


@pytest.mark.parametrize("lang", CASES)
def test_sentences_of_a_language(lang):
    for order in itertools.permutations(CASES[lang]) if len(CASES[lang]) < 5 else [CASES[lang], CASES[lang][::-1]]:
        assert [x for _, x in s.spans(" ".join(order))] == list(order)


def test_scripts_without_spaces():
    assert [x for _, x in s.spans("水位下降了.57米。“池塘已经干了。”看守写道。火很快就扑灭了！围栏修好了吗？")] == ["水位下降了.57米。", "“池塘已经干了。”看守写道。", "火很快就扑灭了！", "围栏修好了吗？"]
    assert [x for _, x in s.spans("「池はもう乾いた。」と監視員は書いた。火事は消えた！")] == ["「池はもう乾いた。」と監視員は書いた。", "火事は消えた！"]
    assert [p for p, _ in s.spans("ฝนตกหนักตลอดสัปดาห์ เรานับนกได้50ตัวที่บึงใหญ่")] == [0, 20]


def test_lines_headings_and_positions():
    text = "  1. Weather\n\na) coots: 5\r\nIt rained.The dike broke. \n---\n🙂 ok"
    assert s.spans(text) == [(2, "1. Weather"), (14, "a) coots: 5"), (27, "It rained."), (37, "The dike broke."), (58, "🙂 ok")]
    assert s.starts(None) == s.starts("") == s.starts(" \n\t") == []


def test_dynamic_program_finds_the_best_chain():
    """Against all chains of places, on lines short enough for that."""
    rng = random.Random(8)
    parts = ["He left at 5 p.m.", 'She said "No. Stop!"', "Mr. X came", "(see p. 3.)", "It fell 3 in.", "Why?", "and then.", "“Yes. No.”", "A."]
    for _ in range(150):
        line = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        places = s._places(line, 0)
        if len(places) > 11:
            continue
        starts, ends, inside = [0, *[b for _, b, _ in places[:-1]]], [e for e, _, _ in places], s._inside(line)
        span = lambda i, j: places[j][2] + s.span_score(inside, starts[i], ends[j])
        value = lambda cuts: sum(span(i, j - 1) for i, j in zip(cuts, [*cuts[1:], len(places)]))
        chains = [(0, *c) for k in range(len(places)) for c in itertools.combinations(range(1, len(places)), k)]
        got = tuple(starts.index(p) for p in s.starts_in(line))
        assert value(got) == pytest.approx(max(map(value, chains)))


@pytest.mark.parametrize("k", range(2, 11))
@pytest.mark.parametrize("pair", ['""', "“”", "«»", "„“"])
def test_a_quotation_in_a_running_sentence_ends_nothing(k, pair):
    held = " ".join(["The lake is dry."] * k)
    line = f"The sign reads {pair[0]}{held}{pair[1]} and stays. We left."
    assert s.starts_in(line) == [0, line.index("We left")]
    line = f"{pair[0]}{held}{pair[1]}, wrote the warden. We left."
    assert s.starts_in(line) == [0, line.index("We left")]


def test_a_quotation_of_its_own_is_cut_and_an_open_one_holds_nothing():
    assert [x for _, x in s.spans("It ended. “The lake is dry. The ducks left.” We went home.")] == ["It ended.", "“The lake is dry.", "The ducks left.”", "We went home."]
    assert [x for _, x in s.spans('The board was 5" wide. It broke. He said "so it goes. We left.')] == ['The board was 5" wide.', "It broke.", 'He said "so it goes.', "We left."]


def test_opening_and_closing_words_count():
    assert s._closing("sent to the. X", 12, "u") < s._closing("sent to them. X", 13, "u")
    assert s._opening("The end", 0)[0] > s._opening("Xerxes came", 0)[0]


def test_long_text_and_frame(spark):
    long = "The lake is dry. " * 20000
    assert len(s.starts(long)) == 20000
    df = spark.createDataFrame([("d", "A b. C d."), ("d", "A b. C d."), ("e", None), ("f", ""), ("g", "x")], "doc_id string, clean_text string").selectExpr("*", "'c' AS sentence", "1 AS start_pos")
    assert sorted((r.doc_id, r.start_pos) for r in s.sentences(df, "doc_id", "clean_text").collect()) == [("d", 0), ("g", 0)]
    df2 = df.where("doc_id = 'z'")
    assert s.sentences(df2, "doc_id", "clean_text").count() == 0
