"""Sentence boundaries across languages and scripts.

Each line (a line break always ends a sentence) is cut by semi-Markov dynamic programming: a state is a place where a
sentence may end, and whole spans between two such places are scored jointly by the word that opens them, the word
and mark that close them, their length, and whether they cut a quotation or bracket. The best chain of spans is the
sequence of sentences. Every mark is a place, however poor; starts that can no longer be in the best chain are dropped
by a bound on what a whole span can lose, so that the search is exact and linear in practice.

Only quotations and brackets that are closed in their line count. A quotation that a sentence goes on around (words
before it that no mark ends, or a small letter after it) belongs to that sentence whole, however many sentences it
holds; one that stands alone is cut like running text.

Defined results: null, empty and blank texts have no sentences, nor has a line without a letter or digit; a heading or
list item on its own line is one sentence with its number; positions are offsets in code points of the stored text; a
document given twice counts once; texts and spans of any length are read whole.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a span loses at most by cutting a quotation, by having less than three characters, and by its length.
CUT, TINY, LENGTH = 4.0, 2.0, 0.6
#: Characters of a usual sentence, in scripts that write syllables or words as single characters, and how far (as a factor) lengths stray.
USUAL, USUAL_DENSE, STRAY = 70.0, 16.0, 3.0
ENDS, CLOSERS, OPENERS = ".!?…。！？।॥؟۔‼⁇⁈．｡", "\"'”’»)]}」』）】›＂", "\"'“‘„«([{¿¡「『（【‹‚＂"
PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "‹": "›"}
WORD = re.compile(r"[^\W\d_]+")
LINE = re.compile(r"[^\n\r  \x0b\x0c\x85]+")
ITEM = re.compile(r"\s*(?:[-*•–—]\s+)?(?:\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)])(?=\s)")
#: Abbreviations after which a sentence goes on (fixed values, lower case, without the last period).
NEVER = frozenset(
    """mr mrs ms dr prof capt lt sgt col gen rev hon messrs mgr supt asst mt ft no nos p pp fig figs vols vs cf viz i.e e.g ie eg approx abt tel ext ch dept gov sen rep st ste apt bldg rm
    sr sra srta dra ud uds núm núms pág págs aprox es gral nr nrn hr fr hrn bzw ca z b d h u a vgl abb s sog ggf str bd mme mlle env av chap pl
    г-н г-жа т п д с ст рис табл ок см им ул стр гл проф акад напр т.е т.к и.о डॉ श्री श्रीमती प्रो सं कृ से पृ د أ م ص ج พ.ศ ค.ศ ดร นพ นาย""".split()
)
#: Abbreviations that may also close a sentence.
MAYBE = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec ave rd blvd ln hwy co inc ltd corp jr bros lbs lb in ft mi yd oz gal min hr hrs sq cu km cm mm kg etc usw u.s.w ff г гг в вв р руб коп т.д т.п др см.ч से.मी मी से.मी कि.मी ध.मी".split())
STRONG = frozenset("a.m p.m am pm etc usw т.д т.п др m h".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Words that hardly close a sentence, and words that often open one (fixed values of this operator).
HARDLY_LAST = frozenset(
    """the a an of and or with into from to at by in on for der die das dem den des ein eine einer eines und oder mit von zum zur im
    el la los las un una y o de del con por para en le les des un une et ou du au aux avec dans sur pour и в на с по от до""".split()
)
OFTEN_FIRST = frozenset(
    """the it he she we they this these there in on at no after when then all our der die das er sie es wir am im ein eine nach
    el la los las se no en un una después le les il elle nous on un une des après в на мы он она это после""".split()
)
#: Chinese and Japanese words by which a quotation goes on.
SPEECH = re.compile(r"\s*(?:と|って|という|[^，。！？、\s“「]{1,9}(?:写道|寫道|说道|說道|说|說|问道|问|答道|喊道|喊|回答|道))")


def _class(c: str) -> str:
    """u upper case, l lower case, d digit, o letter of a script without case, t Thai, - other."""
    if "฀" <= c <= "๿":
        return "t"
    k = unicodedata.category(c)
    return "u" if k in ("Lu", "Lt") else "l" if k == "Ll" else "d" if k == "Nd" else "o" if k[0] == "L" or k in ("Mc", "Mn") else "-"


def _closing(line: str, end: int, nxt: str) -> float:
    """How well a sentence closes with the marks before end; nxt is the class of what follows."""
    k = end
    while k > 0 and (line[k - 1] in CLOSERS or line[k - 1].isspace()):
        k -= 1
    mark = line[k - 1] if k else ""
    if mark not in ".．":
        return 1.0 if mark == "…" else 2.0
    if line[max(0, k - 3) : k] in ("...", ". .") or line[k - 2 : k] == "..":
        return 1.0
    j = k - 1
    while j > 0 and not line[j - 1].isspace() and line[j - 1] not in "([{\"“„«'‘-–—/":
        j -= 1
    word = line[j : k - 1]
    low = word.lower()
    before = line[:j].rstrip()
    if low in ("m", "h", "п", "ч", "k", "e", "d", "п", "е") and re.search(r"(?:^|\s)[apzdutтuи]\.?$", before, re.I):
        # p. m., z. B., d. h., т. е.: only the time of day may close
        return 1.5 if low == "m" else -6.0
    if low in STRONG and len(low) > 1:
        return 1.5
    if len(word) == 1 and word.isalpha():
        if _class(word) == "u" or low in NEVER:
            return -5.0
        return 1.0 if low in MAYBE else -3.0
    if low == "st" and re.search(r"\d+\s+(?:[NSEW]\.\s+)?[A-Z]\w+$", before):
        return 0.8
    tail = word.rpartition(".")[2]
    if low in NEVER or (tail[:1].isupper() and len(tail) > 1 and tail.lower() in NEVER):
        # with or without a blank before it
        return -6.0
    if low in MAYBE:
        return 1.0
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
        return -1.5 if word.isupper() else -3.0
    if word[-1:].isdigit():
        follow = re.match(r"\s+([^\W\d_]+)", line[k:])
        if follow and follow[1].lower() in MONTHS and re.fullmatch(r"\d{1,2}", word):
            return -6.0
        return 1.5
    if word and all("ऀ" <= c <= "ॿ" or c == "." for c in word):
        return -2.0
    return 1.0 if low in HARDLY_LAST else 2.0


def _opening(line: str, start: int) -> tuple[float, str]:
    """How well a sentence opens at start, and the class of its first letter or digit."""
    k, quoted = start, False
    while k < len(line) and (line[k] in OPENERS or (quoted and line[k].isspace())):
        quoted = True
        k += 1
    c = _class(line[k]) if k < len(line) else "-"
    if c == "u":
        word = WORD.match(line, k)
        return (2.0 if word and word[0].lower() in OFTEN_FIRST else 1.5), c
    if c == "d" or (c == "-" and k + 1 < len(line) and line[k] in ".$£€№#+" and line[k + 1].isdigit()):
        return 0.7, "d"
    if c in "ot":
        return 1.0, c
    if c == "l":
        # an opening quotation with a small letter, or a word like iPhone, still is a poor opening
        return -5.0, c
    return (0.2 if quoted else -4.0), c


THAI, DENSE, MARK = re.compile("[\u0e00-\u0e7f]"), re.compile("[\u3040-\u9fff]"), re.compile(f"[{re.escape(ENDS)}]")


def _places(line: str, begin: int) -> list[tuple[int, int, float]]:
    """(end, next start, local score) of the places where a sentence may end, the end of the line last."""
    out, n, i = [], len(line), begin
    thai = THAI.search(line) is not None and sum("฀" <= c <= "๿" for c in line) * 2 > sum(c.isalpha() for c in line)
    while i < n:
        if not thai:
            # nothing happens before the next mark
            if (mark := MARK.search(line, i)) is None:
                break
            i = mark.start()
        c = line[i]
        if c in ENDS:
            k = i + 1
            while k < n and line[k] in ENDS:
                k += 1
            while k < n and (line[k] in CLOSERS or (line[k].isspace() and line[k + 1 : k + 2] == "»")):
                if line[k] in "\"'＂" and k > i + 1 and line[k - 1].isspace():
                    break
                k += 1
            s = k
            while s < n and line[s].isspace():
                s += 1
            if s < n:
                spaced, only_period = s > k, line[i:k].strip(CLOSERS) in (".", "．")
                good, kind = _opening(line, s)
                fits = spaced or not only_period or (kind == "u" and i > begin + 1 and line[i - 2].isalnum() and (line[i - 1].islower() or line[i - 1].isdigit() or line[i - 1] in CLOSERS) and (line[s + 1 : s + 2].islower() or line[s] in OPENERS)) or (kind == "o")
                if fits and not (only_period and not spaced and kind == "d"):
                    score = _closing(line, k, kind) + good - 2.0 - (0.3 if not spaced and kind in "uld" else 0.0)
                    if line[k - 1] in "”」』\"’»" and kind in "o" and SPEECH.match(line, k):
                        score -= 6.0
                    out.append((k, s, score))
            i = k
        elif thai and c.isspace():
            s = i
            while s < n and line[s].isspace():
                s += 1
            if s < n and i > begin and (_class(line[i - 1]) == "t" or line[i - 1].isdigit() or line[i - 1] in CLOSERS) and (_class(line[s]) == "t" or line[s] in OPENERS) and line[s] != "ๆ" and line[i - 1] != ".":
                out.append((i, s, 1.0))
            i = s
        else:
            i += 1
    return [*out, (n, n, 2.0)]


CLOSING = {closing: opening for opening, closing in PAIRS.items()}


def _quotations(line: str) -> list[tuple[int, int]]:
    """(place of the opening mark, place of the closing one) of the quotations and brackets that are closed in the line."""
    held: list[tuple[str, int]] = []
    out = []
    for i, c in enumerate(line):
        if c in "\"＂":
            opens = (not i or line[i - 1].isspace() or line[i - 1] in OPENERS) and i + 1 < len(line) and not line[i + 1].isspace()
            at = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] == c), None)
            if at is not None and not (opens and i and line[i - 1].isspace()):
                out.append((held[at][1], i))
                del held[at:]
            elif opens:
                held.append((c, i))
        elif c == "„":
            held.append((c, i))
        elif c in "“”" and (at := next((k for k in range(len(held) - 1, -1, -1) if held[k][0] == "„"), None)) is not None:
            out.append((held[at][1], i))
            del held[at:]
        elif c in PAIRS:
            held.append((c, i))
        elif c in CLOSING and (at := next((k for k in range(len(held) - 1, -1, -1) if held[k][0] == CLOSING[c]), None)) is not None:
            out.append((held[at][1], i))
            del held[at:]
    return out


def _inside(line: str, begin: int = 0) -> list[int] | None:
    """Before each character the number of quotations around it that a sentence goes on around; None if there are none."""
    steps: list[int] | None = None
    for a, b in _quotations(line):
        before, after = line[begin:a].rstrip(), line[b + 1 :].lstrip()
        # a comma or dash after it, a small letter, or in scripts without case a verb of speech: the sentence goes on
        on_right = bool(after) and (after[0] in ",;:،，、—–" or _class(after[0]) == "l" or SPEECH.match(line, b + 1) is not None)
        on_left = bool(before) and before[-1] not in ENDS and before[-1] not in CLOSERS
        if on_left or on_right or line[a] in "([（【":
            if steps is None:
                steps = [0] * (len(line) + 2)
            steps[a + 1] += 1
            steps[b + 1] -= 1
    if steps is not None:
        for i in range(1, len(steps)):
            steps[i] += steps[i - 1]
    return steps


@functools.lru_cache(10_000)
def _length(size: int, usual: float) -> float:
    """What a span of so many characters loses by its length: nothing at the usual one, LENGTH at most."""
    off = math.log(max(size, 1) / usual) / math.log(STRAY)
    return min(LENGTH, 0.1 * off * off)


def usual_length(line: str) -> float:
    if DENSE.search(line) is None:
        return USUAL
    return USUAL_DENSE if 2 * sum("\u3040" <= c <= "\u9fff" for c in line) > sum(map(str.isalpha, line)) else USUAL


def span_score(inside: list[int] | None, a: int, b: int, usual: float = USUAL) -> float:
    """What a whole span a to b adds to the score of its closing place: never more than 0."""
    score = -_length(b - a, usual)
    if inside is not None and (inside[a] or inside[b]):
        score -= CUT
    return score - TINY if b - a < 3 else score


def starts_in(line: str) -> list[int]:
    """Starts of the sentences of one line."""
    begin = len(line) - len(line.lstrip())
    if not any(c.isalnum() for c in line):
        return []
    item = ITEM.match(line)
    first = max(begin, item.end() if item else 0)
    places = _places(line, first)
    if len(places) == 1:
        return [begin]
    inside = _inside(line, first) if any(c in line for c in "\"＂„“«([「『（【‹") else None
    starts = [begin, *[s for _, s, _ in places[:-1]]]
    n = len(places)
    best, back, live = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0]
    most, usual = CUT + TINY + LENGTH, usual_length(line)
    for j in range(1, n + 1):
        end, local = places[j - 1][0], places[j - 1][2]
        for i in live:
            score = best[i] + local + span_score(inside, starts[i], end, usual)
            if score > best[j]:
                best[j], back[j] = score, i
        # a start that trails by more than a span can lose is never caught up with
        live = [i for i in live if best[i] > best[j] - most]
        if all(best[j] > best[i] - most for i in live):
            live.append(j)
    out, j = [], n
    while j:
        out.append(starts[back[j]])
        j = back[j]
    return out[::-1]


def starts(text: str | None) -> list[int]:
    if not text:
        return []
    return [m.start() + s for m in LINE.finditer(text) for s in starts_in(m[0])]


def spans(text: str | None) -> list[tuple[int, str]]:
    """(start, sentence) of a text; a sentence ends before the next or with its line."""
    if not text:
        return []
    out = []
    for m in LINE.finditer(text):
        at = starts_in(m[0])
        out += [(m.start() + a, m[0][a:b].rstrip()) for a, b in zip(at, [*at[1:], len(m[0])])]
    return out


def sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_pos and sentence of every row's text; repeated rows give each sentence once.

    Only the texts of repeated keys are shuffled, to find equal ones: the others go from the scan to their sentences.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, p, s) for k, t in zip(b["key"], b["text"]) if isinstance(t, str) for p, s in spans(t)]
            yield pd.DataFrame(out, columns=["key", "start_pos", "sentence"])

    from fieldlore.session import small_or_plain

    schema = "key string, start_pos int, sentence string"
    plain = rows.select(rows[key].alias("key"), rows[text].alias("text"))
    repeated = plain.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("again"))
    marked = plain.join(small_or_plain(repeated.withColumn("more", F.lit(True))), F.col("key").eqNullSafe(F.col("again")), "left")
    once = marked.where("more IS NULL").select("key", "text").mapInPandas(kernel, schema)
    more = marked.where("more").select("key", "text").distinct().mapInPandas(kernel, schema).distinct()
    return once.unionByName(more).withColumnRenamed("key", key)
