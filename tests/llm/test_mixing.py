import pandas as pd
import pytest

from fieldlore.llm import mixing

DOC = "doc_id bigint, text string, lang string, source string, tokens int"
TARGET = "source string, target_share double, max_repeats int, topic string"


def test_rake_meets_margins_and_caps():
    cells = pd.DataFrame([(s, lang, t, 100 + 37 * i) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in ("en", "de") for t in ("x", "y"))], columns=["source", "language", "topic", "tokens"])
    out = mixing.rake(cells, {"a": 0.7, "b": 0.3}, {"a": 2.0, "b": 1.0})
    w = out["uses"] * out["tokens"]
    assert w[out["source"] == "a"].sum() / w.sum() == pytest.approx(0.7)
    assert (out.loc[out["source"] == "a", "uses"] <= 2 + 1e-9).all() and (out.loc[out["source"] == "b", "uses"] <= 1 + 1e-9).all()


    assert out.attrs["converged"] and out.attrs["off"]["source"] < 1e-6
    # without caps in the way all three marginals are met
    free = mixing.rake(cells, {"a": 0.7, "b": 0.3}, {"a": 50.0, "b": 50.0})
    w = free["uses"] * free["tokens"]
    for d in ("language", "topic"):
        natural = cells.groupby(d)["tokens"].sum() / cells["tokens"].sum()
        assert (w.groupby(free[d]).sum() / w.sum()).to_numpy() == pytest.approx(natural.to_numpy(), abs=1e-6)
    assert free.attrs["converged"] and max(free.attrs["off"].values()) < 1e-6


def test_rake_says_where_caps_hold_it_back():
    cells = pd.DataFrame([("a", "en", "x", 1000), ("a", "de", "x", 10), ("b", "en", "x", 10), ("b", "de", "x", 1000)], columns=["source", "language", "topic", "tokens"])
    out = mixing.rake(cells, {"a": 0.9, "b": 0.1}, {"a": 1.0, "b": 1.0})
    assert out.attrs["off"]["source"] < 1e-6 and out.attrs["off"]["language"] > 0.1


def test_marginals_are_those_of_the_mixture(spark):
    texts = ["the water gauge stood at five feet in the rain", "teal nests and a brood of ducks", "nothing said"]
    rows = [(i, texts[i % 3], ["en", "de"][i // 3 % 2], ["big", "small"][i % 5 == 0], 1) for i in range(3000)]
    docs, targets = spark.createDataFrame(rows, DOC), spark.createDataFrame([("big", 0.7, 2, "x"), ("small", 0.3, 4, "x")], TARGET)
    mixture = mixing.mix(docs, targets)
    out = {(r.dimension, r.value): (r.goal_share, r.actual_share) for r in mixing.marginals(docs, mixture, targets).collect()}
    assert set(out) == {("source", "big"), ("source", "small"), ("language", "en"), ("language", "de"), ("topic", "water"), ("topic", "birds"), ("topic", "other")}
    assert all(a == pytest.approx(g, abs=0.02) for g, a in out.values())
    rest = mixture.toPandas()
    rest["used"] = rest["tokens"] * rest["repeats"]
    for d in ("language", "topic", "source"):
        for v, s in (rest.groupby(d)["used"].sum() / rest["used"].sum()).items():
            assert out[d, v][1] == pytest.approx(s)


def test_mix_reaches_shares(spark):
    rows = [(i, "the water gauge stood at five feet " * (1 + i % 7), ["en", "de", None][i % 3], "big" if i % 10 else "small", 1) for i in range(3000)]
    rows += [(9001, None, "en", "big", 1), (9002, "", "en", "big", 1), (9003, "a text", "en", None, 1), (9004, "a text", "en", "other", 1)]
    docs, targets = spark.createDataFrame(rows, DOC), spark.createDataFrame([("big", 0.6, 1, "x"), ("small", 0.4, 3, "x"), ("none", 0.0, 3, None)], TARGET)
    mixture = mixing.mix(docs, targets)
    got = {r.source: r.actual_share for r in mixing.shares(mixture, targets).collect()}
    assert got["big"] == pytest.approx(0.6, abs=0.005) and got["small"] == pytest.approx(0.4, abs=0.005) and got["none"] == 0
    caps = {"big": 1, "small": 3}
    chosen = mixture.collect()
    assert all(1 <= r.repeats <= caps[r.source] for r in chosen) and max(r.doc_id for r in chosen) < 9000
    assert {(r.doc_id, r.repeats) for r in mixing.mix(docs, targets).collect()} == {(r.doc_id, r.repeats) for r in chosen}


def test_mix_empty(spark):
    docs, targets = spark.createDataFrame([], DOC), spark.createDataFrame([("big", 1.0, 1, "x")], TARGET)
    assert mixing.mix(docs, targets).count() == 0
