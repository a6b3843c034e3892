import datetime
import itertools
import math
import random

import pytest

from fieldlore.operators import eav, units
from fieldlore.plans import prep

SEED = "seed_row bigint, entity_type string, name string, prop_key string, prop_value string, prop_key2 string"
ATTR = "entity_type string, attribute string, value_type string"
ATTRS = [("P", "tenure_start", "int"), ("P", "pay", "double"), ("P", "ok", "boolean"), ("P", "hired_on", "date"), ("P", "alias", "string list"), ("P", "role", "string"), ("Q", "role", "string")]


def test_wide_reads_types(spark):
    rows = [
        (1, "P", "Ann", "Tenure Start:", "+1944", "x"), (2, "P", "Ann", "tenureStart", "1950", "x"), (3, "P", "Ann", " PAY", "$1,234.5", None), (4, "P", "Ann", "ok", "Y", None),
        (5, "P", "Ann", "hired-on", "July 15, 1974", None), (6, "P", "Ann", "alias", "b", None), (7, "P", "Ann", "alias", "a", None), (8, "P", "Ann", "ALIAS", "b", None),
        (9, "P", "Ann", None, "5", None), (10, "P", "Ann", "note", "5", None), (11, "P", "Bob", "pay", "unknown", None), (12, "P", "Bob", "pay", None, None), (13, "P", None, "pay", "3", None),
        (14, "Q", "Ann", "role", " clerk ", None), (15, "Q", "Ann", "role", " clerk ", None), (16, "P", "Cyd", "pay", "99,41", None), (17, "P", "Cyd", "tenure_start", "1937.5", None), (18, "Z", "Cyd", "pay", "1", None),
    ]
    out = {(r.entity_type, r.name): r for r in eav.wide(spark.createDataFrame(rows, SEED), spark.createDataFrame(ATTRS, ATTR)).collect()}
    ann = out["P", "Ann"]
    assert (ann.tenure_start, ann.pay, ann.ok, ann.hired_on, ann["alias"], ann.role) == (1944, 1234.5, True, datetime.date(1974, 7, 15), ["b", "a"], None)
    assert out["Q", "Ann"].role == "clerk" and out["P", "Cyd"].pay == 99.41 and out["P", "Cyd"].tenure_start is None
    assert set(out) == {("P", "Ann"), ("P", "Bob"), ("P", "Cyd"), ("Q", "Ann"), ("Z", "Cyd")}
    cells = eav.filled(eav.wide(spark.createDataFrame(rows, SEED), spark.createDataFrame(ATTRS, ATTR)))
    assert sorted(r.attribute for r in cells.where("name='Ann' AND entity_type='P'").collect()) == ["alias", "hired_on", "ok", "pay", "tenure_start"]


@pytest.mark.parametrize("text", ["1933-04-19", "19330419", "19.04.1933", "04/19/1933", "19/04/1933", "19 April 1933", "April 19, 1933", "APRIL 19, 1933"])
def test_dates(spark, text):
    rows = spark.createDataFrame([(1, "P", "Ann", "hired_on", text, None)], SEED)
    assert eav.wide(rows, spark.createDataFrame(ATTRS, ATTR)).first().hired_on == datetime.date(1933, 4, 19)


def test_wide_reads_once_and_shuffles_once(spark):
    cells = eav.filled(eav.wide(spark.createDataFrame([(1, "P", "Ann", "pay", "5", None)], SEED), spark.createDataFrame(ATTRS, ATTR)))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    # the steps of the reading are written out once, in no join or filter, and rows move by entity alone
    assert plan.count("initcap(") == 1 and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_wide_lists_in_file_order_and_like_keys(spark):
    rows = [
        (9, "P", "Ann", "alias", "c", None), (2, "P", "Ann", "alias", "b", None), (3, "P", "Ann", "alias", "a", None), (4, "P", "Ann", "alias", "b", None), (1, "P", "Ann", "role", "x", None),
        (0, "P", "Ann", "ok", "no", None), (5, "P", "Ann", "role", "w", None), (6, "P", "Ann", "PAY", "$7", None), (8, "P", "Bob", "roleOf\n", "z", None),
    ]
    attrs = [*ATTRS, ("P", "pay_", "string"), ("P", "role_of", "string")]  # two attributes of one normal key have both its values
    out = {r.name: r for r in eav.wide(spark.createDataFrame(rows, SEED), spark.createDataFrame(attrs, ATTR)).collect()}
    ann, bob = out["Ann"], out["Bob"]
    assert (ann["alias"], ann.role, ann.ok, ann.pay, ann.pay_, ann.role_of) == (["b", "a", "c"], "x", False, 7.0, "$7", None)
    assert (bob.role_of, bob["alias"], bob.role, bob.pay) == ("z", None, None, None)


def test_wide_empty(spark):
    assert eav.filled(eav.wide(spark.createDataFrame([], SEED), spark.createDataFrame(ATTRS, ATTR))).count() == 0


@pytest.mark.parametrize(
    "row, basis, changed",
    [
        (("area_burned", "771", 771.0, " Sq Mi", None, None, None, None), "unit", True),
        (("area_burned", "5 ha", 5.0, "?", None, None, None, None), "raw_value", False),
        (("area_burned", "5", 5.0, "hectares", None, None, "figures in thousands", None), "unit", True),
        (("hay_cut", "two 1/2", None, None, None, None, None, "x"), None, False),
        (("expense", "$182", 182.0, None, None, None, None, None), "raw_value", False),
        (("expense", "88", 88.0, None, None, None, None, "88¢ went for labor."), "sentence", True),
        (("rainfall", "4.7", 4.7, None, None, None, None, "The gauge caught 4.7 of rain. It fell 14.7 in. deep."), None, False),
        (("water_level", "35", 35.0, None, None, None, None, "Water stood at 35 in Hollin Meadow."), None, False),
        (("water_level", "35", 35.0, None, None, None, None, "Water stood at 35 in in Hollin Meadow."), "sentence", True),
        (("area_burned", "18", 18.0, None, None, None, None, "18 bd. ft. were cut; fire took 18 acres."), "sentence", True),
        (("individual_count", "64", 64.0, "head", None, None, None, None), "unit", False),
        (("nothing", "64", 64.0, "head", None, None, None, None), None, False),
        ((None, None, float("nan"), None, None, None, None, None), None, False),
    ],
)
def test_convert(row, basis, changed):
    out = units.convert(*row)
    assert (out[0], out[-1]) == (basis, changed)


def test_conversion_values():
    assert math.isclose(units.convert("air_temperature", "212 F", 212.0, "F", None, None, None, None)[4], 100)
    assert math.isclose(units.convert("air_temperature", "0 K", 273.15, "K", None, None, None, None)[4], 0, abs_tol=1e-9)
    assert math.isclose(units.convert("water_level", "19 feet and 6 inches", 19.0, None, None, None, None, None)[4], 19.5 * 0.3048) and math.isclose(units.convert("water_level", "19' 6\"", None, "'", None, None, None, None)[4], 19.5 * 0.3048)
    assert units.convert("area_burned", "nine A.", None, None, None, None, None, None)[0] == "raw_value"
    assert units.convert("individual_count", "2 to 3 doz.", None, "doz.", 2.0, 3.0, None, None)[5:7] == (24.0, 36.0)
    assert math.isclose(units.convert("seed_sown", "18 1/2 lb", None, None, None, None, None, None)[4], 18.5 * units.POUND)


def test_units_frame(spark):
    m = "measurement_id string, claim_id string, run_id string, name string, raw_value string, numeric_value double, unit string, lower_bound double, upper_bound double, methodology_note string, measurement_date string, loaded_at string, basis string"
    row = ("m1", "c1", "r", "expense", "5", 5.0, None, None, None, None, None, "t", "clash")
    out = units.to_common_units(spark.createDataFrame([row, row, ("m2", None, None, None, None, None, None, None, None, None, None, None, None)], m), spark.createDataFrame([("c1", "It cost 5 cents."), ("c1", "It cost 5 cents."), (None, None)], "claim_id string, source_sentence string")).collect()
    assert {(r.measurement_id, r.basis, r.common_value) for r in out} == {("m1", "sentence", 0.05), ("m2", None, None)}


def test_segment_is_exact():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(4, 11)
        x = [rng.gauss(rng.choice([0, 3]), 0.4) for _ in range(n)]
        cost = lambda i, j: sum((v - sum(x[i:j]) / (j - i)) ** 2 for v in x[i:j])
        best = min((sum(cost(i, j) for i, j in zip((0, *cuts), (*cuts, n))) + 0.7 * len(cuts), cuts) for k in range(4) for cuts in itertools.combinations(range(1, n), k) if all(j - i >= 2 for i, j in zip((0, *cuts), (*cuts, n))))
        got = units.segment([1.0] * n, x, [v * v for v in x], 0.7, 2)
        got_cost = sum(cost(i, j) for i, j in zip(got, [*got[1:], n])) + 0.7 * (len(got) - 1)
        assert got_cost <= best[0] + 1e-9


def test_shift_is_reversed(spark):
    rng = random.Random(5)
    rows = [(f"m{i}", "r", "water_level", f"19{30 + i // 12:02d}-{i % 12 + 1:02d}-01", None, 2 * math.exp(rng.gauss(0, 0.05)) / (units.FOOT if 60 <= i < 110 else 1)) for i in range(240)]
    conv = spark.createDataFrame(rows, "measurement_id string, run_id string, name string, measurement_date string, basis string, common_value double")
    src = spark.createDataFrame([("r", "S")], "run_id string, source string")
    shifts = units.unit_shifts(conv, src)
    assert [(r.base, round(r.inferred_factor, 4)) for r in shifts.orderBy("from_date").collect()] == [(False, 1.0), (False, 0.3048), (True, 1.0)]
    assert {r.measurement_id for r in units.reverse_shifts(conv, src, shifts).collect()} == {f"m{i}" for i in range(60, 110)}


def test_queries_run(spark):
    for name, f in prep.QUERIES.items():
        assert f(spark, "/root/testdata/sf0.001").count() >= 0, name
