"""Quantities recorded in different units brought to one common unit per measurement name.

Two stages. (1) ``to_common_units`` reads the unit a record states: in its unit, in raw_value, in
methodology_note, or in the sentence of its claim beside the number, and a noted scale, and converts value and
bounds. (2) ``unit_shifts`` serves the records that state no unit: the history of a source (series and
measurement name, ordered by date) is cut by exact penalised changepoint search on log values, and a level shift
that matches the factor of a known unit marks a change of unit to reverse.

The cost of a segment is its squared error, which needs only count, sum and sum of squares per date. These are
summed before the shuffle, so a history holds one row per distinct date however many records it has, and no
record is left out.

Defined results: a record without any stated unit has basis null and is not changed; a null name, or one that
measure_units lacks, likewise; a record given twice counts once; empty tables give empty results; values that are
no finite number convert to null, and a history takes only values above zero, since others have no logarithm.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACRE, POUND, FOOT = 0.40468564224, 0.45359237, 0.3048
#: Factors to the common unit by measurement name (fixed values). One unit a line: factor, offset added before the factor, spellings.
UNITS: dict[str, list[tuple[float, float, str]]] = {
    "area_burned": [
        (1, 0, "hectare|hectares|ha|ha.|has"), (ACRE, 0, "acre|acres|ac|ac.|a.|a"), (1000 * ACRE, 0, "thousand acres|m acres|1000 acres"), (258.9988110336, 0, "square mile|square miles|sq mi|sq. mi.|sq miles|sq. miles|mi2|mi²|sections|section"),
        (100, 0, "km²|km2|sq km|sq. km|sq. km.|square kilometres|square kilometers|square kilometre"), (ACRE / 160, 0, "square rods|square rod|sq. rods|sq rods|sq. rd.|sq rd"), (1e-4, 0, "square metres|square meters|m2|m²|sq m|sq. m|sq. m."), (0.01, 0, "ares|are"),
    ],
    "hay_cut": [
        (1, 0, "tonne|tonnes|metric ton|metric tons|t|t.|mt"), (0.90718474, 0, "ton|tons|short ton|short tons|sh. tn.|sh tn|tn."), (1.0160469088, 0, "long ton|long tons|gross ton|gross tons"),
        (POUND / 1000, 0, "pound|pounds|lb|lb.|lbs|lbs.|#"), (0.001, 0, "kg|kg.|kilo|kilos|kilogram|kilograms"), (100 * POUND / 1000, 0, "cwt|cwt.|hundredweight|hundredweights"), (0.1, 0, "quintal|quintals"),
    ],
    "rainfall": [(1, 0, "millimetre|millimetres|millimeter|millimeters|mm|mm."), (10, 0, "centimetre|centimetres|centimeter|centimeters|cm|cm."), (25.4, 0, 'inch|inches|in|in.|"|″|”'), (0.254, 0, "hundredths of an inch|hundredths|points|pts.|pts|pt."), (304.8, 0, "feet|foot|ft|ft."), (1000, 0, "metres|meters|m")],
    "water_level": [(1, 0, "metre|metres|meter|meters|m|m."), (FOOT, 0, "foot|feet|ft|ft.|'|′|’"), (0.0254, 0, 'inch|inches|in|in.|"'), (0.01, 0, "centimetre|centimetres|centimeter|centimeters|cm|cm."), (1.8288, 0, "fathom|fathoms|fath.|fath|fm."), (0.001, 0, "millimetres|millimeters|mm|mm."), (0.9144, 0, "yard|yards|yd|yd.|yds")],
    "air_temperature": [
        (1, 0, "degree celsius|degrees celsius|celsius|deg. c|deg c|deg. c.|°c|º c|° c|c|c.|centigrade|degrees centigrade|cent."), (5 / 9, -32, "degree fahrenheit|degrees fahrenheit|fahrenheit|deg. f|deg f|deg. f.|°f|° f|f|f.|fahr.|fahr"),
        (1, -273.15, "k|kelvin|kelvins|degrees kelvin|°k|deg. k"), (1.25, 0, "réaumur|reaumur|degrees reaumur|°ré|deg. r"),
    ],
    "fence_built": [(1, 0, "kilometre|kilometres|kilometer|kilometers|km|km."), (1.609344, 0, "mile|miles|mi|mi."), (0.0050292, 0, "rod|rods|rd|rd.|rds|rds."), (0.0201168, 0, "chain|chains|ch.|ch"), (0.001, 0, "metre|metres|meter|meters|m|m."), (0.0009144, 0, "yard|yards|yd|yd.|yds|yds."), (FOOT / 1000, 0, "foot|feet|ft|ft.")],
    "wood_removed": [
        (1, 0, "cubic metre|cubic metres|cubic meter|cubic meters|m3|m³|cu. m|cu m|cu. m.|cbm|stere|steres"), (3.624556363776, 0, "cord|cords|cd.|cds.|cds"), (0.028316846592, 0, "cubic foot|cubic feet|cu. ft.|cu ft|ft3|ft³"),
        (0.002359737216, 0, "board foot|board feet|bd. ft.|bd ft|fbm|b.f."), (2.359737216, 0, "mbf|thousand board feet|m board feet|m bd. ft."), (0.764554857984, 0, "cubic yards|cu. yd.|yd3"),
    ],
    "seed_sown": [(1, 0, "kilogram|kilograms|kg|kg.|kilo|kilos"), (POUND, 0, "pound|pounds|lb|lb.|lbs|lbs.|#"), (0.028349523125, 0, "ounce|ounces|oz|oz."), (0.001, 0, "gram|grams|g|g.|gm|gm.|grammes"), (100 * POUND, 0, "cwt|cwt.|hundredweight|hundredweights"), (1000, 0, "tonne|tonnes|t"), (907.18474, 0, "ton|tons|short tons")],
    "individual_count": [
        (1, 0, "individual|individuals|indiv.|indiv|ind.|animal|animals|bird|birds|head|hd.|each|specimens|count"), (2, 0, "pair|pairs|pr.|pr|prs|prs.|brace|braces"), (12, 0, "dozen|dozens|doz.|doz|dz."), (20, 0, "score|scores"), (144, 0, "gross"), (1000, 0, "thousand|thousands|thous.|thous|m"), (100, 0, "hundred|hundreds"), (1e6, 0, "million|millions"),
    ],
    "expense": [(1, 0, "usd|dollar|dollars|dols.|dol.|$|u.s. dollars|us dollars|u. s. dollars|us$"), (0.01, 0, "cent|cents|ct.|cts.|cts|¢"), (0.001, 0, "mill|mills"), (1000, 0, "thousand dollars|m dollars|$000|$ 000|$1000|thousands of dollars|1000 dollars"), (1e6, 0, "million dollars")],
    "discharge": [
        (1, 0, "litre per second|litres per second|liter per second|liters per second|l/s|lps|l/sec|l/sec."), (1000, 0, "m3/s|m³/s|cumec|cumecs|cubic metres per second|cubic meters per second"), (28.316846592, 0, "cfs|cubic feet per second|ft3/s|ft³/s|cu. ft. per sec.|cu ft per sec|second-feet|second feet|second-foot|sec.-ft."),
        (0.0630901964, 0, "gpm|gallons a minute|gallons per minute|gal. per min.|gal. per minute|gal/min|gals. per min."), (1 / 60, 0, "litres per minute|l/min"),
    ],
}
SMALL = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
WORDS = "|".join(sorted(SMALL, key=len, reverse=True))
ONE = rf"(?:\d[\d,]*\s+\d+/\d+|\d+/\d+|\d[\d,]*(?:\.\d+)?\s?[½¼¾]?|\.\d+|[½¼¾]|(?:{WORDS})(?:[- ](?:{WORDS}))*(?![A-Za-z]))"
#: A number or a range as raw_value gives it, with what stands before and behind.
RAW = re.compile(rf"^\s*(?P<before>.*?)\s*(?P<number>[-−+]?{ONE}(?:\s*(?:to|-|–|and|or)\s*\$?[-−]?{ONE})?)\s*(?P<after>.*?)\s*$", re.I | re.S)
#: Feet and inches in one value.
FEET_INCHES = re.compile(r"^\D*?(\d+(?:\.\d+)?)\s*(?:feet|foot|ft\.?|['′’])\s*(?:and\s+)?(\d+(?:\.\d+)?)\s*(?:inches|inch|in\.?|[\"″”]|'')\s*$", re.I)
#: Notes that give a scale, and the power of ten of each word in them.
SCALE_WORD = re.compile(r"(?<!\w)(?:(tens?)|(hundreds?|100s?)|(thousands?|1,?000s?)|(millions?|1,?000,?000s?))(?!\w)", re.I)
SCALES = (10.0, 100.0, 1000.0, 1e6)
#: What follows "in" where it is the word and not inches.
PREPOSITION = re.compile(r"\s+(?:[A-Z\d]|the\b|spring|summer|autumn|fall|winter|all\b)")


@functools.cache
def spellings(name: str) -> dict[str, tuple[float, float]]:
    return {s: (factor, offset) for factor, offset, words in UNITS.get(name, ()) for s in words.split("|")}


@functools.cache
def unit_after(name: str) -> re.Pattern | None:
    """Matches the longest spelling of a unit of this quantity at a place in a text."""
    words = sorted(spellings(name), key=len, reverse=True)
    return re.compile("|".join(re.escape(w).replace(r"\ ", r"\s+") + (r"(?![\w])" if w[-1].isalnum() else "") for w in words), re.I) if words else None


@functools.lru_cache(100_000)
def unit_of(name: str | None, text: str | None) -> tuple[float, float] | None:
    """Factor and offset of a unit however it is spelled, or None."""
    if not name or not text:
        return None
    t, known = " ".join(text.lower().split()), spellings(name)
    return known.get(t) or known.get(t.rstrip(".")) or known.get(t + ".")


@functools.lru_cache(50_000)
def scale_of(note: str | None) -> float:
    m = SCALE_WORD.search(note or "")
    return SCALES[next(i for i, g in enumerate(m.groups()) if g)] if m else 1.0


def unit_in_raw(name: str | None, raw: str | None) -> tuple[float, float] | None:
    m = RAW.match(raw or "")
    if not m:
        return None
    return unit_of(name, m["after"]) or (unit_of(name, m["before"].split()[-1]) if m["before"] and not m["before"][-1:].isalpha() else None)


def in_note(name: str | None, note: str | None) -> tuple[float, float] | None:
    """'in acres', 'unit: sq mi', 'acres'."""
    if not note:
        return None
    t = re.sub(r"^(?:\w+\s+){0,3}?(?:in|units?:?|as)\s+", "", note.strip(), flags=re.I)
    return unit_of(name, note) or (unit_of(name, t) if scale_of(note) == 1.0 else None)


def in_sentence(name: str | None, raw: str | None, value: float | None, low: float | None, high: float | None, sentence: str | None) -> tuple[float, float] | None:
    """The unit that follows the record's number (or stands before it, like $) in the sentence."""
    after = unit_after(name) if name else None
    if after is None or not sentence:
        return None
    m = RAW.match(raw or "")
    texts = [m["number"].strip()] if m else []
    texts += [f"{v:g}" for v in (value, high, low) if v is not None and v == v]
    for text in dict.fromkeys(texts):
        pattern = r"\s+".join(map(re.escape, text.split()))
        for at in re.finditer(rf"(?<![\w.,/]){pattern}(?![\d/])(?![.,]\d)", sentence, re.I):
            if (u := after.match(sentence, at.end() + (sentence[at.end() : at.end() + 1] in (" ", "\n", "-")))) or (u := after.match(sentence, at.end())):
                if u[0].lower() != "in" or not PREPOSITION.match(sentence, u.end()):
                    return unit_of(name, u[0])
            before = sentence[: at.start()].rstrip()[-1:]
            if before and not before.isalnum() and (found := unit_of(name, before)):
                return found
    return None


@functools.lru_cache(50_000)
def number_of(text: str | None) -> float | None:
    """'18 1/2', '1,234.5', 'twenty-five' as a number."""
    if not text:
        return None
    t = text.strip().lower().replace(",", "").replace("−", "-")
    t = t.replace("½", " 1/2").replace("¼", " 1/4").replace("¾", " 3/4")
    total, seen = 0.0, False
    for part in re.split(r"[\s-]+(?=[a-z\d])", t):
        if part in SMALL:
            total = total * 100 if part == "hundred" and total else total + SMALL[part]
        elif f := re.fullmatch(r"(\d+)/(\d+)", part):
            total += int(f[1]) / int(f[2]) if int(f[2]) else 0
        elif re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)", part):
            total += float(part)
        elif part:
            return None
        seen = True
    return total if seen else None


def convert(name, raw, value, unit, low, high, note, sentence) -> tuple:
    """basis, factor, offset, scale, value, low, high in the common unit, changed."""
    scale = scale_of(note)
    basis, found = None, None
    if (both := FEET_INCHES.match(raw or "")) and (foot := unit_of(name, "foot")):
        # the recorded number may hold the feet alone
        return "raw_value", *foot, scale, (float(both[1]) + float(both[2]) / 12) * scale * foot[0], None, None, True
    for basis, found in (("unit", unit_of(name, unit)), ("raw_value", unit_in_raw(name, raw)), ("methodology_note", in_note(name, note))):
        if found:
            break
    if not found:
        basis, found = "sentence", in_sentence(name, raw, value, low, high, sentence)
    finite = lambda v: v is not None and math.isfinite(v)
    if not finite(value) and not finite(low) and not finite(high) and (m := RAW.match(raw or "")):
        value = number_of(m["number"])
    if not found:
        return None, None, None, scale, *[v if finite(v) else None for v in (value, low, high)], False
    factor, offset = found
    apply = lambda v: (v * scale + offset) * factor if finite(v) else None
    return basis, factor, offset, scale, apply(value), apply(low), apply(high), (factor, offset, scale) != (1, 0, 1.0)


SCHEMA = "measurement_id string, run_id string, name string, measurement_date string, basis string, factor double, offset double, scale double, common_value double, common_lower double, common_upper double, changed boolean"


def _kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        clean = lambda c: [None if v is None or v != v else v for v in b[c]]
        rows = [convert(*r) for r in zip(*map(clean, ("name", "raw_value", "numeric_value", "unit", "lower_bound", "upper_bound", "methodology_note", "source_sentence")))]
        out = pd.DataFrame(rows, columns=["basis", "factor", "offset", "scale", "common_value", "common_lower", "common_upper", "changed"])
        for c in ("factor", "offset", "scale", "common_value", "common_lower", "common_upper"):
            out[c] = out[c].astype("float64")
        yield pd.concat([b[["measurement_id", "run_id", "name", "measurement_date"]].reset_index(drop=True), out], axis=1)


def to_common_units(measurements: DataFrame, claims: DataFrame) -> DataFrame:
    """Each measurement once, with the stated unit's basis and its numbers in the common unit."""
    once = measurements.dropDuplicates(["measurement_id"]).select("measurement_id", "claim_id", "run_id", "name", "raw_value", "numeric_value", "unit", "lower_bound", "upper_bound", "methodology_note", "measurement_date")
    sentences = claims.where("claim_id IS NOT NULL").groupBy("claim_id").agg(F.max("source_sentence").alias("source_sentence"))
    return once.join(sentences, "claim_id", "left").drop("claim_id").mapInPandas(_kernel, SCHEMA)


# -- level shifts --------------------------------------------------------------------------------------------

#: Penalty of one more segment, in units of the residual variance times log n (the Schwarz criterion has 2).
PENALTY = 3.0
#: A shift matches a unit's factor if the logarithms differ by at most this.
SHIFT_TOLERANCE = 0.12
#: A segment shorter than this many dates carries no level.
LEAST_DATES = 5


def segment(counts: list[float], sums: list[float], squares: list[float], penalty: float, least: int = LEAST_DATES) -> list[int]:
    """Starts of the segments of the exact minimum of squared error plus penalty per segment (pruned dynamic programming)."""
    n = len(counts)
    c, s, q = [0.0], [0.0], [0.0]
    for a, b, d in zip(counts, sums, squares):
        c.append(c[-1] + a), s.append(s[-1] + b), q.append(q[-1] + d)
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (c[j] - c[i])
    best, back, live = [-penalty] + [math.inf] * n, [0] * (n + 1), [0]
    beaten: dict[int, int] = {}
    for j in range(least, n + 1):
        values = [(best[i] + cost(i, j) + penalty, i) for i in live if j - i >= least and best[i] < math.inf]
        if values:
            best[j], back[j] = min(values)
            # a start beaten at j loses to a segment that starts at j, as soon as that one may end
            for i in live:
                if j - i >= least and i not in beaten and best[i] + cost(i, j) > best[j]:
                    beaten[i] = j
            live = [i for i in live if best[i] < math.inf and (i not in beaten or j + 1 - beaten[i] < least)]
            live.append(j)
    starts, j = [], n
    while j > 0 and best[j] < math.inf:
        starts.append(back[j])
        j = back[j]
    return sorted(starts) or [0]


HISTORY = "source string, name string, from_date string, to_date string, dates int, records bigint, level double, base boolean, log_shift double, inferred_factor double"


def _segments(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("measurement_date")
    name = pdf["name"].iloc[0]
    n, s, q = (pdf[c].tolist() for c in ("n", "s", "q"))
    total, mean = sum(n), sum(s) / sum(n)
    # the noise is measured between neighbours, so that a shift doesn't hide itself
    steps = sorted(abs(b / m - a / k) for a, k, b, m in zip(s, n, s[1:], n[1:]))
    noise = (steps[len(steps) // 2] / 0.954) ** 2 if steps else 0.0
    noise = max(noise, 1e-6, 0.05 * (sum(q) / total - mean * mean))
    starts = segment(n, s, q, PENALTY * noise * math.log(max(total, 3)))
    ends = starts[1:] + [len(n)]
    level = [sum(s[i:j]) / sum(n[i:j]) for i, j in zip(starts, ends)]
    size = [sum(n[i:j]) for i, j in zip(starts, ends)]
    base = max(range(len(starts)), key=lambda k: (size[k], -k))
    factors = sorted({1.0} | {f for f, o in spellings(name).values() if o == 0})
    rows = []
    for k, (i, j) in enumerate(zip(starts, ends)):
        shift = level[k] - level[base]
        # a value written in a unit of factor f is 1/f times the value in the common unit
        near = min(factors, key=lambda f: abs(shift + math.log(f)), default=None)
        hit = near if k != base and near is not None and abs(shift + math.log(near)) <= SHIFT_TOLERANCE else 1.0
        rows.append((pdf["source"].iloc[0], name, pdf["measurement_date"].iloc[i], pdf["measurement_date"].iloc[j - 1], j - i, int(size[k]), level[k], k == base, shift, hit))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in HISTORY.split(", ")])


def unit_shifts(converted: DataFrame, sources: DataFrame) -> DataFrame:
    """Segments of each source's history of records without a stated unit, with the factor that a shift betrays.

    ``converted`` is the result of to_common_units, ``sources`` has run_id and source. A history has one row per
    distinct date before it reaches its task: its length is bounded by the calendar, not by the records.
    """
    usable = converted.where("basis IS NULL AND common_value > 0 AND measurement_date IS NOT NULL AND name IS NOT NULL").select("run_id", "name", F.substring("measurement_date", 1, 10).alias("measurement_date"), F.log("common_value").alias("x"))
    daily = usable.join(sources.select("run_id", "source").dropDuplicates(["run_id"]), "run_id").groupBy("source", "name", "measurement_date").agg(F.count("x").cast("double").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return daily.where("source IS NOT NULL").groupBy("source", "name").applyInPandas(_segments, HISTORY)


def reverse_shifts(converted: DataFrame, sources: DataFrame, shifts: DataFrame) -> DataFrame:
    """The records of segments whose shift matched a factor, multiplied by it: measurement_id, name, source, inferred_factor, common_value."""
    hits = shifts.where("inferred_factor <> 1").select("source", F.col("name"), "from_date", "to_date", "inferred_factor")
    dated = converted.where("basis IS NULL AND measurement_date IS NOT NULL").join(sources.select("run_id", "source").dropDuplicates(["run_id"]), "run_id").withColumn("day", F.substring("measurement_date", 1, 10))
    return dated.join(hits, ["source", "name"]).where("day BETWEEN from_date AND to_date").select("measurement_id", "name", "source", "inferred_factor", (F.col("common_value") * F.col("inferred_factor")).alias("common_value"))
