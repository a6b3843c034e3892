"""Claims, measurements and mentions from paragraphs by rules.

Classification, validation and dates are built-in expressions; what needs an order among overlapping matches runs in
one Arrow kernel for each kind. All rules are data: a rule table may replace each default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (claim type, pattern, weight) in order; an earlier type wins a tie.
CLAIM_RULES: tuple[tuple[str, str, float], ...] = (
    ("predator_control", r"\b(coyotes?|predators?|trapp?ed|traps?)\b", 1.5), ("fire_incident", r"\b(fires?|burned|burnt|lightning|went up in smoke)\b", 1.4), ("weather_observation", r"\b(temperatures?|rain|rainfall|snow|degrees|thermometer|gauge|ice|wind)\b", 1.3),
    ("economic_use", r"\b(hay|haying|grazing|permits?|permittees|timber|wood|cost|bill|labor|paid)\b", 1.2), ("breeding_activity", r"\b(nests?|nested|nesting|broods?|reared|hatched)\b", 1.4), ("population_estimate", r"\b(count(?:s|ed)?|estimate[ds]?|observers|were taken|population)\b", 1.3),
    ("development_activity", r"\b(fence|dike|bridge|road|graded|rebuilt|planted|seeded|sown|sowed)\b", 1.1), ("public_contact", r"\b(meeting|club|council|association|visitors|school|society)\b", 1.2),
)
THRESHOLD, MARGIN, CEILING, LOW, HIGH, UNCERTAIN = 0.85, 0.35, 2.5, 0.60, 0.92, 0.08
UNCERTAIN_WORDS = r"(?i)\b(about|approx|approximately|around|estimated|reported|possibly|likely)\b"
FINITE_VERB = r"(?i)\b(was|were|is|are|had|have|has|been|being|be|did|do|does)\b"
#: Months by name (fixed values).
MONTHS = {m: i for i, ms in enumerate(("jan january", "feb february", "mar march", "apr april", "may", "jun june", "jul july", "aug august", "sep sept september", "oct october", "nov november", "dec december"), 1) for m in ms.split()}
#: Short words whose period does not end a sentence: titles, months, and those of reports (own list).
ABBREVIATIONS = frozenset((
    "mr", "mrs", "ms", "miss", "dr", "prof", "rev", "hon", "gov", "sen", "rep", "capt", "col", "gen", "lt", "maj", "sgt", "jr", "sr", "st", "mgr", "supt", "dept",
    *(m for m in MONTHS if len(m) < 5 and m != "may"),
    "no", "nos", "vol", "vols", "fig", "figs", "p", "pp", "ca", "cf", "al", "etc", "ibid", "op", "vs", "viz", "approx", "est", "incl", "misc",
))


# -- sentences -----------------------------------------------------------------------------------------------


def rule_sentences(text: str | None) -> list[tuple[str, int, int]]:
    """Sentences of a paragraph with offsets in its rejoined text: lines that go on are joined first."""
    joined: list[str] = []
    for line in map(str.strip, (text or "").strip().split("\n")):
        if not line:
            joined.append("")
            continue
        before = joined[-1] if joined else ""
        if before and (before[-1] in ",;" or before[-1].islower() or _abbreviated(before)):
            joined[-1] = f"{before} {line}"
        elif before or not joined:
            joined.append(line)
        else:
            joined[-1] = line
    whole = " ".join(x for x in joined if x)
    if not whole:
        return []
    out, begin = [], 0
    for m in re.finditer(r"[.!?]\s+(?=[A-Z])", whole):
        # an abbreviation that has a period of its own before the mark does not end the sentence
        if _abbreviated(whole[begin : m.start()].rstrip()):
            continue
        if sentence := whole[begin : m.start() + 1].strip():
            out.append((sentence, begin, m.start() + 1))
        begin = m.end()
    if (tail := whole[begin:].strip()):
        out.append((tail, begin, len(whole)))
    return out or [(whole, 0, len(whole))]


def _abbreviated(text: str) -> bool:
    m = re.search(r"\b([A-Za-z]{1,6})\.$", text)
    return bool(m) and m[1].lower() in ABBREVIATIONS


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(*k, n, s, a, e) for *k, t in zip(b["paragraph_id"], b["doc_id"], b["clean_text"]) for n, (s, a, e) in enumerate(rule_sentences(t))]
        yield pd.DataFrame(rows, columns=["paragraph_id", "doc_id", "position", "sentence", "evidence_start", "evidence_end"])


def sentences(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("paragraph_id", "doc_id", "clean_text").mapInPandas(_sentences, "paragraph_id string, doc_id string, position int, sentence string, evidence_start int, evidence_end int")


# -- claims --------------------------------------------------------------------------------------------------


def classified(rows: DataFrame, text: str = "sentence", rules=CLAIM_RULES) -> DataFrame:
    """Adds claim_type, score, margin, secondary, epistemic_status and extraction_confidence; rows below the threshold go."""
    types = list(dict.fromkeys(t for t, _, _ in rules))
    score = {t: sum((F.regexp_count(F.col(text), F.lit("(?i)" + p)) * w for k, p, w in rules if k == t), F.lit(0.0)) for t in types}
    # sorted by score, then by the order of the rules
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(score[t].cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, t in enumerate(types)])))
    out = rows.withColumn("_ranked", ranked).withColumn("claim_type", F.col("_ranked")[0]["type"]).withColumn("score", F.col("_ranked")[0]["score"])
    out = out.where(F.col("score") >= THRESHOLD)
    second = F.col("_ranked")[1] if len(types) > 1 else F.lit(None)
    out = out.withColumn("margin", F.col("score") - (second["score"] if len(types) > 1 else 0.0))
    out = out.withColumn("secondary", F.when((F.col("margin") < MARGIN) & (second["score"] > 0), second["type"]) if len(types) > 1 else F.lit(None).cast("string"))
    status = F.when(F.col(text).rlike(UNCERTAIN_WORDS), "uncertain").otherwise("certain")
    strength = 0.65 * F.least((F.col("score") - THRESHOLD) / (CEILING - THRESHOLD), F.lit(1.0)) + 0.35 * F.least(F.col("margin") / MARGIN, F.lit(1.0))
    raw = LOW + (HIGH - LOW) * strength - F.when(F.col("epistemic_status") == "uncertain", UNCERTAIN).otherwise(0.0)
    return out.withColumn("epistemic_status", status).withColumn("extraction_confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)).drop("_ranked")


def reject_reason(sentence: Column) -> Column:
    """Why a sentence is no claim, by the first rule that holds; null if it is one."""
    t = F.trim(sentence)
    verb = t.rlike(FINITE_VERB)
    heading = r"^(?:(?:[A-Z]{2,}(?:\s+[A-Z]{2,}){0,4})|(?:[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|and|of|the|for|in|on|at|to|by)){0,3}))[:.]?\s*$"
    share = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
    return (
        F.when(F.length(t) < 20, "too_short").when(F.regexp_count(t, F.lit(r"(?U)\b\w+\b")) < 3, "too_few_words").when(share < 0.5, "low_alpha_density").when(t.rlike(heading) & ~verb, "section_heading")
        .when(t.rlike(r"^[A-Z\-•*\d][\-.)]\s{0,3}\w{0,15}\.?\s*$"), "list_artifact").when(~verb, "no_finite_verb").when(t.rlike(r"(?i)\b(Mr|Mrs|Dr|Gov|Col|Lt|Sgt|St|Jr|Sr|Mgr|Dept|Approx|Oct|Nov|Dec|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?)\.\s*$"), "truncated_at_honorific")
    )


def claim_date(sentence: Column, fallback_year: Column) -> Column:
    """The first 'Month d[, yyyy]' if it is a month; the year of the text, else the given one."""
    pattern = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:,\s*(\d{4}))?\b"
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.lower(F.regexp_extract(sentence, pattern, 1)))
    own = F.regexp_extract(sentence, pattern, 3)
    year = F.when(own != "", own.cast("int")).otherwise(fallback_year)
    return F.when(month.isNotNull() & (year != 0), F.format_string("%04d-%02d-%02d", year, month, F.regexp_extract(sentence, pattern, 2).cast("int")))


def best_links(links: DataFrame, precedence: tuple[str, ...]) -> DataFrame:
    """Of links with the same span and form the relation that comes first."""
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col("relation_type"))
    rank = Window.partitionBy("claim_id", "start_offset", "end_offset", "normalized_form").orderBy(F.when(order > 0, order).otherwise(len(precedence) + 1), "relation_type")
    return links.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r")


def hybrid(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Claims of rules and of a model by sentence; the more confident wins, rules win ties."""
    a, b = rules.select([F.col(c).alias(f"a_{c}") for c in rules.columns]), model.select([F.col(c).alias(f"b_{c}") for c in rules.columns])
    both = a.join(b, (F.col("a_paragraph_id") == F.col("b_paragraph_id")) & (F.col("a_sentence") == F.col("b_sentence")), "full")
    better = F.col("a_sentence").isNull() | (F.col("b_extraction_confidence") > F.col("a_extraction_confidence"))
    source = F.when(F.col("a_sentence").isNull(), "model").when(F.col("b_sentence").isNull(), "rules").when(better, "model_over_rules").otherwise("rules_over_model")
    return both.select(*[F.when(better, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in rules.columns], source.alias("extraction_source"))


# -- measurements --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MeasurementRules:
    """Units by word with the measurement's name, the types that count animals, and the words of animals."""

    units: tuple[tuple[str, str, str], ...] = (("days?", "days_above_threshold", "days"), ("inch(?:es)?", "rainfall", "inches"), ("acres?", "acres", "acres"), ("tons?", "hay_cut", "tons"), ("farmers?", "farmers_count", "count"), ("cords?", "wood_killed_cords", "cords"), ("cov(?:y|ies)", "coveys_count", "coveys"))
    counting: frozenset[str] = frozenset(("wildlife_count", "predator_control", "population_estimate", "species_presence", "breeding_activity"))
    animals: str = r"ducks?|geese|goose|swans?|teals?|coots?|mallards?|pintails?|coyotes?|deer|beavers?|muskrats?|nests?|broods?|birds?|head|animals?|individuals?"
    #: Words before the lowest and the highest value that a number may have.
    at_least: tuple[str, ...] = ("above", "at least", "exceeding", "greater than", "in excess of", "more than", "no fewer than", "no less than", "not fewer than", "over", "upwards of")
    at_most: tuple[str, ...] = ("at most", "below", "fewer than", "less than", "no more than", "not exceeding", "not more than", "under", "up to")
    verbs: str = r"counted|observed|seen|estimated|trapped|taken|banded|reared|hatched"


NUMBER = r"(\d+(?:\.\d+)?)"
MONTH_BEFORE = re.compile(r"\b(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?\s*$", re.I)


@dataclass
class MeasurementKernel:
    """Ranges, then bounds, then unit patterns, then money, then bare counts."""

    rules: MeasurementRules = field(default_factory=MeasurementRules)

    def __post_init__(self):
        units = "|".join(f"(?P<u{i}>{u})" for i, (u, _, _) in enumerate(self.rules.units) if not u.startswith("farmers"))
        self.unit_after = re.compile(rf"\s*(?:{units})\b", re.I)
        self.animal_after = re.compile(rf"\s*({self.rules.animals})\b", re.I)
        self.context = re.compile(rf"\b({self.rules.animals}|{self.rules.verbs})\b", re.I)
        low, high = (r"|".join(w.replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True)) for words in (self.rules.at_least, self.rules.at_most))
        self.spans = (
            ("range", re.compile(rf"\b{NUMBER}\s*[-–—]\s*{NUMBER}\b")), ("range", re.compile(rf"\bbetween\s+{NUMBER}\s+and\s+{NUMBER}\b", re.I)),
            ("lower", re.compile(rf"\b(?:{low})\s+{NUMBER}\b", re.I)), ("upper", re.compile(rf"\b(?:{high})\s+{NUMBER}\b", re.I)),
        )
        self.by_unit = [(re.compile(rf"{NUMBER}\s*({u})\b", re.I), name, unit) for u, name, unit in self.rules.units]

    def extract(self, sentence: str, claim_type: str) -> list[tuple]:
        """(name, raw_value, numeric_value, unit, approximate, lower_bound, upper_bound, methodology_note, target)."""
        note = self.note(sentence)
        approximate = bool(re.search(r"\b(about|around|approx|approximately|estimated)\b", sentence, re.I))
        out, used = [], set()
        for kind, pattern in self.spans:
            for m in pattern.finditer(sentence):
                # ranges may meet each other; a bound must begin outside of what is used
                if kind in ("lower", "upper") and m.start() in used:
                    continue
                name, unit, target = self.right_of(sentence, m.end(), claim_type)
                bounds = (float(m[1]), float(m[2])) if kind == "range" else (float(m[1]), None) if kind == "lower" else (None, float(m[1]))
                out.append((name, m[0], None, unit, True, *bounds, note, target))
                used.update(range(*m.span()))
        for pattern, name, unit in self.by_unit:
            out += [(self.special(name, claim_type, sentence), m[0], float(m[1]), unit, approximate, None, None, note, None) for m in pattern.finditer(sentence) if m.start() not in used]
        for m in re.finditer(rf"(?:(?:USD|usd)\s*)?\$?\s*{NUMBER}\s*(?:dollars?|USD|usd)?", sentence):
            if re.search(r"\$|usd|dollar", m[0], re.I):
                out.append(("suppression_cost" if claim_type == "fire_incident" else "revenue", m[0].strip(), float(m[1]), "USD", approximate, None, None, note, None))
        if not out and claim_type in self.rules.counting and self.context.search(sentence):
            for m in re.finditer(rf"\b{NUMBER}\b", sentence):
                if m.start() not in used and self.role(sentence, m) == "count":
                    animal = self.animal_after.match(sentence[m.end() : m.end() + 25])
                    out.append(("individual_count", m[1], float(m[1]), "individuals", approximate, None, None, note, animal[1] if animal else None))
        return list({(r[0], r[1], r[2], r[3]): r for r in reversed(out)}.values())[::-1]

    def right_of(self, sentence: str, end: int, claim_type: str) -> tuple[str, str, str | None]:
        right = sentence[end : end + 25]
        if m := self.unit_after.match(right):
            i = next(int(k[1:]) for k, v in m.groupdict().items() if v)
            return self.special(self.rules.units[i][1], claim_type, sentence), self.rules.units[i][2], None
        animal = self.animal_after.match(right) if claim_type in self.rules.counting else None
        return "individual_count", "individuals", animal[1] if animal else None

    @staticmethod
    def special(name: str, claim_type: str, sentence: str) -> str:
        if name != "acres":
            return name
        return "acres_burned" if claim_type == "fire_incident" else "land_area" if claim_type == "economic_use" or "cut" in sentence.lower() else name

    @staticmethod
    def note(sentence: str) -> str | None:
        for word, pattern in (("estimated", "estimated|approximately|approx|about|around"), ("counted", "counted|tallied|enumerated"), ("surveyed", "surveyed|censused|banded"), ("reported", "reported|observed|recorded|noted")):
            if re.search(rf"\b({pattern})\b", sentence, re.I):
                return word
        return None

    def role(self, sentence: str, m: re.Match) -> str:
        """What a bare number is, by its neighbours, the first rule that holds."""
        value, left, right = float(m[1]), sentence[: m.start()], sentence[m.end() :]
        if value == int(value) and 1800 <= value <= 2100:
            return "year"
        if re.search(r"\b(permit|serial|lot|parcel|tract|block|chapter|exhibit|appendix|ref\.?)\s*$", left[-20:], re.I):
            return "serial"
        if re.match(r"\s*(years?|months?|weeks?|decades?|centur(?:y|ies))\b", right[:20], re.I):
            return "time"
        if self.animal_after.match(right[:20]):
            return "count"
        if re.search(r"\b(pages?|tables?|figures?|fig\.?|sections?|sec\.?|no\.|number|item)\s*$", left[-30:], re.I):
            return "reference"
        if re.match(r"\s*(%|percent)", right[:30], re.I):
            return "percent"
        if re.match(r"\s*acres?\b", right[:30], re.I):
            return "area"
        if MONTH_BEFORE.search(left[-15:]):
            return "day"
        return "count" if self.context.search(f"{left[-50:]} {right[:50]}") else "other"


MEASURED = "claim_id string, position int, name string, raw_value string, numeric_value double, unit string, approximate boolean, lower_bound double, upper_bound double, methodology_note string, target string"


def measurements(claims: DataFrame, rules: MeasurementRules = MeasurementRules()) -> DataFrame:
    """One row per measurement of claims (claim_id, claim_type, sentence), in order."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = MeasurementKernel(rules)
        for b in batches:
            rows = [(c, i, *r) for c, t, s in zip(b["claim_id"], b["claim_type"], b["sentence"]) if isinstance(s, str) for i, r in enumerate(k.extract(s, t))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURED.split(", ")])
            yield out.astype({"numeric_value": "float64", "lower_bound": "float64", "upper_bound": "float64"})

    return claims.select("claim_id", "claim_type", "sentence").mapInPandas(kernel, MEASURED)


# -- mentions ------------------------------------------------------------------------------------------------

SMALL = frozenset("the a an in at on of for with and or but to from by about during near after before that this these those it its".split())


class Terms:
    """Finds terms in texts with an automaton over all of them, so that a text is read once however many there are."""

    def __init__(self, terms):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in terms:
            self.automaton.add_word(t, len(t))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of all terms that stand as whole words, overlapping ones too."""
        low = text.lower()
        if not len(self.automaton):
            return []
        if len(low) != len(text):
            # letters whose small form is longer: each by its own, so that offsets hold
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        out = []
        for last, size in self.automaton.iter(low):
            s, e = last + 1 - size, last + 1
            if word(s) != word(s - 1) and word(e - 1) != word(e):
                out.append((s, e))
        return out


def longest(text: str, hits) -> list[tuple[int, int]]:
    """Of spans the longest anywhere first, none overlapping a longer one; equally long ones by their text, then place."""
    kept: list[tuple[int, int]] = []
    for s, e in sorted(set(hits), key=lambda h: (h[0] - h[1], text[h[0] : h[1]].lower(), h[0])):
        if all(e <= a or s >= b for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


#: Letters and signs that are counted to bound the similarity of two terms.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 -'."


class Nearest:
    """The term most like a form, by the matching-blocks ratio: at least as good as ``least``, the shorter and then the
    smaller in a tie. Common letters, counted for all terms of a length at once, leave few terms for the ratio itself."""

    def __init__(self, terms, least: float = 0.78):
        import numpy as np

        self.least, self.known, self.by_length = least, {}, {}
        place = {c: i for i, c in enumerate(COUNTED)}
        grouped: dict[int, list[str]] = {}
        for t in terms:
            grouped.setdefault(len(t), []).append(t)
        self.place = place
        for n, own in grouped.items():
            own.sort()
            self.by_length[n] = own, np.array([self._count(t) for t in own], np.int16)

    def _count(self, text: str) -> list[int]:
        out = [0] * (len(COUNTED) + 1)
        for c in text:
            out[self.place.get(c, len(COUNTED))] += 1
        return out

    def scored(self, form: str) -> tuple[str, float] | None:
        import difflib

        import numpy as np

        if form in self.known:
            return self.known[form]
        best, score = None, 0.0
        own = np.array(self._count(form), np.int16)
        for n in range(max(1, len(form) - 3), len(form) + 4):
            terms, counts = self.by_length.get(n, ((), None))
            if not terms:
                continue
            bound = 2.0 * np.minimum(counts, own).sum(axis=1) / (n + len(form))
            floor = max(score, self.least)
            for i in np.flatnonzero(bound >= floor - 1e-9):
                if bound[i] > score and (r := difflib.SequenceMatcher(None, form, terms[i]).ratio()) > score:
                    best, score = terms[i], r
        self.known[form] = (best, score) if best is not None and score >= self.least else None
        return self.known[form]

    def __call__(self, form: str) -> str | None:
        found = self.scored(form)
        return found[0] if found else None


class MentionKernel:
    """Lexicon terms, acronyms, names with titles, capitalised words; overlaps go to the longer span.

    What needs the whole vocabulary (where terms stand, the nearest term of a form, which forms are terms) may be handed in.
    """

    def __init__(self, lexicon: dict[str, list[str]], known_errors: frozenset[str] = frozenset(), negative: frozenset[str] = frozenset(), terms: Terms | None = None, nearest=None):
        self.lexicon, self.errors, self.negative = {k.lower(): v for k, v in lexicon.items()}, known_errors, negative
        self.terms = terms or Terms(self.lexicon)
        self.nearest = nearest or Nearest(self.lexicon)
        self.known_flags: dict[str, list[str]] = {}

    def scan(self, text: str) -> list[tuple[int, int]]:
        return longest(text, self.terms.hits(text))

    def flags(self, surface: str) -> list[str]:
        """Signs of a misread form."""
        form = " ".join(surface.strip().lower().split())
        if form in self.known_flags:
            return self.known_flags[form]
        out = ["ocr_suspect_list"] if form in self.errors else []
        if re.search(r"(?<=[a-z])\d|\d(?=[a-z])", form):
            out.append("digit_in_token")
            out += [f"near_seed_term:{c}" for d, x in (("0", "o"), ("1", "l")) if (c := form.replace(d, x)) in self.lexicon]
        if "rn" in form:
            c = form.replace("rn", "m")
            out += [f"near_seed_term:{c}"] if c in self.lexicon else ["rn_m_confusion"] if "m" not in form else []
        if "li" in form and (c := form.replace("li", "h")) in self.lexicon:
            out.append(f"near_seed_term:{c}")
        if not any(f.startswith("near_seed_term") for f in out) and (c := self.nearest(form)):
            out.append(f"near_seed_term:{c}")
        self.known_flags[form] = out
        return out

    def extract(self, text: str) -> list[tuple]:
        """(surface_form, start_offset, end_offset, confidence, source, ocr_flags, type_hints)."""
        spans = [(s, e, 0.92, "seed_lexicon") for s, e in self.scan(text) if text[s:e].lower() not in self.negative]
        for pattern, source in SHAPES[:2]:
            spans += [(m.start(), m.end(), 0.82, source) for m in pattern.finditer(text) if len(m[0].strip()) > 1 and m[0].strip().lower() not in self.negative]
        for m in SHAPES[2][0].finditer(text):
            words = m[0].split()
            if words[0].lower() in SMALL or m[0].lower() in self.negative:
                continue
            begins = not text[: m.start()].rstrip() or text[: m.start()].rstrip()[-1] in ".!?"
            if len(words) == 1 and begins and words[0].lower() not in self.errors and not self.nearest(words[0].lower()):
                continue
            spans.append((m.start(), m.end(), 0.74, "proper_noun"))
        kept: list[tuple] = []
        for c in sorted(spans, key=lambda x: (x[0], x[0] - x[1])):
            at = next((i for i, k in enumerate(kept) if not (c[1] <= k[0] or c[0] >= k[1])), None)
            if at is None:
                kept.append(c)
            else:
                k = kept[at]
                longer, equal = c[1] - c[0] > k[1] - k[0], c[1] - c[0] == k[1] - k[0]
                if (longer and c[2] >= 0.6) or (equal and c[2] > k[2]):
                    kept[at] = c
        out, cap = [], {"seed_lexicon": 1.0, "acronym": 0.92, "initialized_name": 0.92, "proper_noun": 0.85}
        for s, e, conf, source in sorted(kept):
            surface = text[s:e].strip()
            flags = self.flags(surface)
            near = 0.05 if any(f.startswith("near_seed_term") for f in flags) else 0.0
            out.append((surface, s, e, min(conf + near, cap[source]), source, flags, list(self.lexicon.get(surface.lower(), [])) if source == "seed_lexicon" else []))
        return out


MENTIONED = "paragraph_id string, surface_form string, start_offset int, end_offset int, detection_confidence double, detection_source string, ocr_flags array<string>, entity_type_hints array<string>"
#: Names of a vocabulary that one worker holds at a time; a larger one is gone through in parts.
MOST_TERMS = 100_000


def vocabulary_parts(entities: DataFrame, size: int | None = None) -> list[dict[str, list[str]]]:
    """The vocabulary as broadcasts of term to types, in parts of at most about ``size`` names; a part's terms are those of a
    range of hashes, so that no order of all names is needed and only one part is on the driver at a time."""
    size = size or MOST_TERMS
    spark = entities.sparkSession
    named = entities.where("entity_type IS NOT NULL AND name IS NOT NULL AND name <> ''").select(F.lower("name").alias("term"), "entity_type").groupBy("term").agg(F.sort_array(F.collect_set("entity_type")).alias("types"))
    parts = max(1, -(-named.count() // size))
    keyed = named.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    return [spark.sparkContext.broadcast({r.term: list(r.types) for r in keyed.where(F.col("part") == i).toLocalIterator()}) for i in range(parts)]


SHAPES = (
    (re.compile(r"\b[A-Z]{2,}\b|[A-Z]\.(?:\s*[A-Z]\.)+(?:\s+[A-Z][a-z]+)*"), "acronym"), (re.compile(r"\b(?:Dr|Mr|Mrs|Prof|Col|Lt|Sgt)\.?\s+(?:[A-Z]\.\s*)*[A-Z][a-z]+"), "initialized_name"),
    (re.compile(r"\b[A-Z][a-z]{2,}(?:[ \t]+[A-Z][a-z]+)*\b"), "proper_noun"),
)


def asked_forms(text: str, hits: list[tuple[int, int]]) -> set[str]:
    """All forms whose nearest term ``extract`` may ask for, and all variants that it may look up."""
    out = {" ".join(text[s:e].strip().lower().split()) for s, e in hits}
    for pattern, _ in SHAPES:
        for m in pattern.finditer(text):
            out |= {" ".join(m[0].strip().lower().split()), m[0].split()[0].lower(), m[0].strip().lower()}
    return out


class Handed:
    """Hits, terms and nearest terms that parts of a large vocabulary gave for one paragraph."""

    def __init__(self, spans: list[tuple[int, int]], near: dict[str, str]):
        self.spans, self.near = spans, near

    def hits(self, text: str) -> list[tuple[int, int]]:
        return self.spans

    def __call__(self, form: str) -> str | None:
        return self.near.get(form)


def _variants(form: str) -> set[str]:
    """The forms that flags look up in the vocabulary."""
    return {form, *(form.replace(a, b) for a, b in (("0", "o"), ("1", "l"), ("rn", "m"), ("li", "h")))}


def mentions(paragraphs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per mention of paragraphs (paragraph_id, clean_text). A vocabulary of more than MOST_TERMS names is gone
    through in parts: each part tells where its terms stand and which of them are nearest to the paragraphs' forms, and
    these are put together for each paragraph, with the same result."""
    parts = vocabulary_parts(entities)
    rows, columns = paragraphs.select("paragraph_id", "clean_text"), [x.split()[0] for x in MENTIONED.split(", ")]
    if len(parts) == 1:
        shared = parts[0]

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k = MentionKernel(shared.value)
            for b in batches:
                out = [(p, *r) for p, t in zip(b["paragraph_id"], b["clean_text"]) if isinstance(t, str) for r in k.extract(t)]
                yield pd.DataFrame(out, columns=columns)

        return rows.mapInPandas(kernel, MENTIONED)
    from fieldlore.session import cut

    def of_part(shared):
        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            terms, near = Terms(shared.value), Nearest(shared.value)
            for b in batches:
                out = []
                for p, t in zip(b["paragraph_id"], b["clean_text"]):
                    if not isinstance(t, str):
                        continue
                    spans = terms.hits(t)
                    out += [(p, "span", t[s:e].lower(), s, e, 0.0, shared.value[t[s:e].lower()]) for s, e in spans if t[s:e].lower() in shared.value]
                    forms = asked_forms(t, spans)
                    for f in forms:
                        if found := near.scored(f):
                            out.append((p, "near", f, 0, 0, found[1], [found[0]]))
                        out += [(p, "term", v, 0, 0, 0.0, shared.value[v]) for v in _variants(f) if v in shared.value]
                yield pd.DataFrame(out, columns=["paragraph_id", "what", "form", "s", "e", "score", "terms"])

        return kernel

    found = None
    for shared in parts:
        one = rows.mapInPandas(of_part(shared), "paragraph_id string, what string, form string, s int, e int, score double, terms array<string>")
        found = one if found is None else found.unionByName(one)
    found = cut(found.distinct())
    # forms that a term of another part brings are asked of all parts: a term is its own nearest
    # the better, then the shorter, then the smaller
    least = F.min(F.struct((-F.col("score")).alias("score"), F.length(F.col("terms")[0]).alias("size"), F.col("terms")[0].alias("term")))
    near = found.where("what = 'near'").groupBy("paragraph_id", "form").agg(least.alias("best"))
    best = near.select("paragraph_id", F.struct(F.lit("near").alias("what"), "form", F.lit(0).alias("s"), F.lit(0).alias("e"), F.array("best.term").alias("terms")).alias("x"))
    rest = found.where("what <> 'near'").select("paragraph_id", F.struct("what", "form", "s", "e", "terms").alias("x"))
    own = rest.unionByName(best).groupBy("paragraph_id").agg(F.collect_list("x").alias("given"))

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, t, given in zip(b["paragraph_id"], b["clean_text"], b["given"]):
                if not isinstance(t, str):
                    continue
                given = given if given is not None else ()
                lexicon = {g["form"]: list(g["terms"]) for g in given if g["what"] != "near"}
                handed = Handed([(int(g["s"]), int(g["e"])) for g in given if g["what"] == "span"], {g["form"]: g["terms"][0] for g in given if g["what"] == "near"})
                out += [(p, *r) for r in MentionKernel(lexicon, terms=handed, nearest=handed).extract(t)]
            yield pd.DataFrame(out, columns=columns)

    return rows.join(own, "paragraph_id", "left").mapInPandas(put_together, MENTIONED)


def ocr_variants(names: DataFrame, confusions: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """Each name with one confusion at one place, and the best probability of each variant."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, n[: m.start()] + shown + n[m.end() :], p) for n in b["name"] if isinstance(n, str) for true, shown, p in confusions for m in re.finditer(re.escape(true), n)]
            yield pd.DataFrame(rows, columns=["name", "variant", "probability"])

    return names.select("name").distinct().mapInPandas(kernel, "name string, variant string, probability double").groupBy("name", "variant").agg(F.max("probability").alias("probability"))
