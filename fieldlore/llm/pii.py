"""Personal items in free text and their placeholders.

Patterns find mail addresses (plain and written out), phone numbers, identity numbers and postal addresses. Names of
people are found with a lexicon of surnames that the corpus itself gives: the capitalised words that follow titles and
initials. A surname counts alone, or with the given names and initials before it; a word of a place (Druskstead
Ridge) does not count.

A placeholder says what kind of item it replaces. Numbers are validated (area and range) and permuted within their
format by a keyed Feistel network on their digits, so that equal numbers stay equal in all documents and unequal ones
unequal, while country codes, signs, letters and grouping stay and valid ones stay valid. Dates (masked, but no items of
``find``) are permuted by the same network on the days of their century, without a year on those of a leap year. Names,
mail, postal addresses and impossible numbers get a keyed 64-bit hash of their folded value for the same reason. There
is no key of its own: who masks must give one, since whoever has it can undo the numbers.

Defined results: null, empty and blank texts have no items; of overlapping items the earlier, then the longer counts
(mail, identity number, phone, address, name); repeated rows give each item once; empty tables give no items; rows
with a null key have no items, but are masked like every row.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.names import formal, ratio

TITLES = "Mr|Mrs|Ms|Miss|Messrs|Dr|Dra|Prof|Capt|Captain|Lt|Sgt|Col|Maj|Rev|Warden|Ranger|Mgr|Supt|Sr|Sra|Srta|señora|señor|Señora|Señor|guarda|Guarda|gardien|Hr|Fr|Herr|Frau|Mme|Mlle|Wärter|Deputy|Officer|Agent|Judge|Sheriff"
BREAK = r"(?:[-¬­‐=]\s*\n\s*(?:[a-zà-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]{2,}))?"
CAP = rf"[A-ZÀ-ÖØ-Þ][^\W_]{{2,}}{BREAK}"
#: Between the words of a name: blanks, at most one line break, and a stray mark of the scan.
GAP = r"[^\S\n]*(?:[*¦^\\|•~][^\S\n]*)?\n?[^\S\n]*"
STREET_WORDS = "road rd street st avenue ave lane ln drive boulevard blvd court way".split()
STRONG = re.compile(rf"(?:\b(?=[A-Z]|señ|gua|gar)(?:{TITLES})\.?|(?<![\w.])[A-Z]\.){GAP}(?<=\s)({CAP})(?![^\W_])(?!\s+(?i:{'|'.join(STREET_WORDS)})\b)")
WORD = re.compile(CAP)
BEFORE_TITLE = re.compile(rf"(?:^|(?<![\w]))(?:{TITLES})\.?{GAP}(?<=\s)$")
INITIALS = re.compile(rf"(?:(?<![\w.@])(?:[A-Z]\.{GAP}){{1,3}})$")
PREVIOUS = re.compile(rf"(?<![\w.@-])([A-ZÀ-ÖØ-Þ][^\W\d_]+){GAP}(?<=\s)$")
FOLLOWING = re.compile(r"\s+(?:[*¦^\\|•~]\s+)?([^\W_]+)")
AT_PLACE = re.compile(r"\b(?:at|near|outside|below|left)\s+$")
TITLE_SET = frozenset(TITLES.split("|"))
RUN = re.compile(r"\d[\dOolI\s().,/+-]{4,}\d")
PLACE = frozenset(
    "lake creek marsh ford ridge flats slough meadow pothole dike pond river bay island point hill hills mountain valley county township refuge city road street avenue lane basin district park school station camp bridge canyon spring springs sanctuary range town grade office grange company association club council society cooperative auxiliary highway upper lower".split()
)
#: Capitalised words that are never a surname here although they follow an initial (fixed values).
NOT_NAMES = PLACE | frozenset("january february march april may june july august september october november december page box survey marsh the and with north south east west monday tuesday wednesday thursday friday saturday sunday".split())
MAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?:\s?@\s?|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+(?=[\w-]+\s+dot\s))[A-Za-z0-9](?:[\w-]|(?<=-)\s*\n)*(?:(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)[a-z][\w-]*)+", re.A)
D = r"[\dOolI]"
IDENTITY = re.compile(rf"(?<![\w-])(?:[A-Z]{{2}}-\s?{D}{{4}}-\s?{D}{{3}}-\s?{D}{{2}}|[A-Z]{D}{{3}}\s{D}{{6}}|[A-Z]{D}{{7}}|{D}{{3}}-\s?{D}{{2}}-\s?{D}{{4}}|{D}{{3}}\s{D}{{2}}\s{D}{{4}}|{D}{{9}})(?![\w-]|\.\d)")
TOLD = re.compile(r"(?:identity\s+card|social\s+security|passport|identity\s+number|licen[cs]e)\s+(?:no\.?\s+|number\s+|nr\.?\s+|#\s*)?((?:[A-Z]{1,2}-?\s?)?\d[\d -]{4,14}\d)(?![\w-])", re.I)
#: One of these is in whatever TOLD finds.
TOLD_WORDS = ("identity", "social", "passport", "licen")
PHONE = re.compile(rf"(?<![\w+(.-])(?:\+{D}{{1,3}}[\s.-]?|1[-.\s])?(?:\({D}{{3}}\)\s?|{D}{{3}}[-.\s/]\s?){D}{{3}}[-.\s]?\s?{D}{{4}}(?![\w]|-\d)|\+{D}{{1,3}}(?:[\s.-]{D}{{2,6}}){{2,4}}(?![\w])|(?<![\w+(./-])\d{{3}}-\s?\d{{4}}(?![\w-]|\.\d)")
HOUSE = r"\d{1,5}\s+(?:[NSEW]\.\s+)?(?:[A-Z][\w'’]+\s+){1,2}"
ADDRESS = re.compile(rf"(?<![\w.,-])(?:(?:R\.?\s?F\.?\s?D\.?|Rural\s+(?:Route|R[o0]ute))\s+\d+(?:,\s+(?:Box\s+\d+|{HOUSE}[A-Z][\w]*\.?))?|P\.?\s?O\.?\s+B[o0]x\s+\d+|Box\s+\d+(?=,\s+[A-Z]))")
STREET = re.compile(rf"(?<![\w.,$#-])(\d{{1,5}})\s+(?:[NSEW]\.\s+)?[A-Z][\w'’@!]*(?:\s+[A-Z][\w'’]+)?\s+([A-Z][\w@!]*)\.?")
#: What every mail address without @ and dot, and every route or box, has in it.
AT_MARK = re.compile(r"[\[(]\s*at\s*[\])]", re.A)
ROUTE_MARK = re.compile(r"B[o0]x|R(?:ural|\.?\s?F\.?\s?D)")
KINDS = ("email", "id_number", "phone", "address", "name")


@functools.lru_cache(200_000)
def fold(word: str) -> str:
    w = re.sub(r"[-¬­‐=]\s*\n\s*", "", word)
    return "".join(c for c in unicodedata.normalize("NFKD", w).lower() if not unicodedata.combining(c))


@functools.lru_cache(100_000)
def is_given(word: str) -> bool:
    w = fold(word)
    return w in formal() or (len(w) > 3 and any(g[0] == w[0] and abs(len(g) - len(w)) <= 2 and len(g) > 3 and ratio(g, w) >= 0.8 for g in formal()))


@functools.lru_cache(100_000)
def is_street(word: str) -> bool:
    from fieldlore.llm.ocr_repair import distance

    w = word.lower().rstrip(".")
    return w in STREET_WORDS or (len(w) > 3 and any(distance(w, s) <= 0.3 for s in STREET_WORDS if len(s) > 3))


@functools.lru_cache(100_000)
def is_place(word: str) -> bool:
    from fieldlore.llm.ocr_repair import distance

    w = fold(word)
    return w in PLACE or (len(w) > 3 and any(abs(len(w) - len(p)) < 3 and len(p) > 3 and distance(w, p) <= 0.3 for p in PLACE))


@functools.lru_cache(100_000)
def readings(word: str) -> tuple[str, ...]:
    """What a folded word may have been before one confusion of the scan."""
    from fieldlore.llm.ocr_repair import CONFUSIONS

    out = {word[:i] + true + word[i + len(shown) :] for true, shown in CONFUSIONS for i in range(len(word)) if word.startswith(shown, i)}
    return tuple(out)


def digits(text: str) -> int:
    return sum(map(str.isdigit, text))


def _before(left: str) -> tuple[str, str]:
    """The last character of a text without blanks and stray marks, and its last run of letters and digits."""
    tail = left.rstrip(" \t\n\r\x0b\x0c*¦^\\|•~\xa0")
    k = len(body := tail.rstrip("."))
    while k and body[k - 1].isalnum():
        k -= 1
    return tail[-1:], body[k:]


def find(text: str, surnames, judged: dict | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal items of a text, in order, without overlaps; judged remembers words between texts."""
    judged = {} if judged is None else judged
    if len(judged) > 500_000:
        judged.clear()
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if not any(start < e and s < end for s, e, _ in found):
            found.append((start, end, kind))

    if "@" in text or AT_MARK.search(text) or "dot" in text:
        for m in MAIL.finditer(text):
            add(m.start(), m.end(), "email")
    # only runs with six digits can hold a number, so the patterns look at these places alone
    runs = [(max(0, m.start() - 8), m.end() + 12) for m in RUN.finditer(text) if digits(m[0]) >= 6]
    if runs and any(w in low for low in (text.casefold(),) for w in TOLD_WORDS):
        for m in TOLD.finditer(text):
            if digits(m[1]) >= 6:
                add(m.start(1), m.end(1), "id_number")
    for pattern, kind in ((IDENTITY, "id_number"), (PHONE, "phone")):
        for a, b in runs:
            at = a
            # a number that begins in the run ends, with what must not follow it, well before this
            while m := pattern.search(text, at, b + 64):
                if m.start() > b:
                    break
                if digits(m[0]) >= 6:
                    add(m.start(), m.end(), kind)
                at = max(m.end(), at + 1)
    if ROUTE_MARK.search(text):
        for m in ADDRESS.finditer(text):
            add(m.start(), m.end(), "address")
    for m in STREET.finditer(text):
        if is_street(m[2]):
            add(m.start(), m.end(), "address")
    end = 0
    for m in WORD.finditer(text):
        begin = m.start()
        if begin < end:
            continue
        word = m[0]
        # of each word as written: its fold and whether it is a surname; None if it never is one
        if (state := judged.get(word, 0)) == 0:
            w = fold(word)
            state = judged[word] = None if w in NOT_NAMES else (w, w in surnames or (len(w) > 5 and any(r in surnames for r in readings(w))))
        if state is None:
            continue
        w, known = state
        if not known:
            last = text[max(0, begin - 16) : begin].split()[-1:]
            if not last:
                continue
            last = last[0]
            if not (len(last) == 2 and last[1] == "." and last[0].isupper() or last.rstrip(".") in TITLE_SET or (last[0].isupper() and last.isalpha() and is_given(last))):
                continue
        follow = FOLLOWING.match(text, m.end())
        if follow and is_place(follow[1]):
            continue
        window = 48
        left = text[max(0, begin - window) : begin]
        start, rest, strong = begin, left, False
        before, token = _before(rest)
        if token in TITLE_SET and BEFORE_TITLE.search(rest):
            strong = True
        else:
            while True:
                # the patterns run only where the token before allows them
                if before == "." and len(token) == 1 and (i := INITIALS.search(rest)):
                    strong = True
                elif token[:1].isupper() and len(token) > 1 and is_given(token) and (i := PREVIOUS.search(rest)) and is_given(i[1]) and not BEFORE_TITLE.search(i[0]):
                    strong = True
                else:
                    break
                rest = rest[: i.start()]
                start = begin - (len(left) - len(rest))
                if len(rest) < 24 and start > len(rest):
                    # names that reach further to the left than the window: widen it
                    window *= 2
                    left = text[max(0, begin - window) : begin]
                    rest = left[: len(left) - (begin - start)]
                before, token = _before(rest)
            if strong and not known and start < begin and re.fullmatch(r"\s*(?:[A-Z]\.\s*)+", text[start:begin]) and re.search(r"(?:U\.\s*S\.|P\.\s*O\.|D\.\s*C\.)\s*$", text[start:begin]):
                continue
            # French M. is a title where a verb of the language follows
            if start < begin and text[start:begin].strip() == "M." and re.match(r"\s+(?:a|et|est|nota|écrit|fut)\s", text[m.end() : m.end() + 12]):
                start = begin
        # a place cut off by the end of a page
        if not strong and not follow and AT_PLACE.search(left):
            continue
        if (known or strong) and not (not known and is_given(word)):
            add(start, m.end(), "name")
            end = m.end()
    return sorted(found)


# -- pseudonyms ----------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, value: int, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(tweak + value.to_bytes(16, "big"), key=key, digest_size=16).digest(), "big") % modulus


@functools.lru_cache(200_000)
def permute(value: int, size: int, key: bytes, tweak: bytes = b"", inverse: bool = False, rounds: int = 10) -> int:
    """A keyed permutation of 0 .. size-1: a Feistel network on the next larger square, walked until it falls inside."""
    half = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, half)
        for r in reversed(range(rounds)) if inverse else range(rounds):
            t = tweak + bytes([r])
            if inverse:
                a, b = (b - _round(key, t, a, half)) % half, a
            else:
                a, b = b, (a + _round(key, t, b, half)) % half
        value = a * half + b
        if value < size:
            return value


def country_code(number: str) -> str:
    """The country code of a phone number with its sign: up to the first separator, else one digit for 1 and 7 and two for others."""
    m = re.match(r"\s*(?:\+(?:[17](?=\d{10}$)|\d{1,3}(?=[^\d])|[17]|\d\d)|1(?=[-.\s(]))", number)
    return m[0] if m else ""


def pseudonym(number: str, key: bytes, inverse: bool = False, valid=lambda digits: True) -> str:
    """A number with its digits permuted, all else (grouping, letters, signs) as it was; a valid one becomes a valid one."""
    own = "".join(c for c in number if c.isdigit() and c.isascii())
    if not own:
        return number
    shape = "".join("9" if c.isdigit() and c.isascii() else c for c in number if c.isalnum()).encode()
    new, walk = own, valid(own)
    while True:
        new = f"{permute(int(new), 10 ** len(own), key, shape, inverse):0{len(own)}d}"
        if not walk or valid(new):
            break
    put = iter(new)
    return "".join(next(put) if c.isdigit() and c.isascii() else c for c in number)


MISREAD_DIGITS = str.maketrans("OolI", "0011")


def read_number(kind: str, value: str) -> str:
    """A number with the letters that a scan shows for digits as digits; the letters before an identity number stay."""
    head = 0
    if kind == "id_number" and sum(map(str.isalnum, value)) != 9:
        head = len(re.match(r"[A-Za-z]{0,2}", value)[0] if re.match(r"[A-Z]{2}-", value) else re.match(r"[A-Za-z]?", value)[0])
    return value[:head] + value[head:].translate(MISREAD_DIGITS)


def is_number(kind: str, number: str, digits_: str) -> bool:
    """Range and area check of the digits of a phone or identity number."""
    d = digits_
    american = lambda x: x[0] > "1" and x[3] > "1"  # noqa: E731 # area and exchange
    if kind == "phone":
        if number.lstrip().startswith("+"):
            return 7 <= len(d) <= 15 and d[0] != "0" and (d[0] != "1" or (len(d) == 11 and american(d[1:])))
        if len(d) == 7:
            return d[0] > "1"
        return (len(d) == 10 and american(d)) or (len(d) == 11 and d[0] == "1" and american(d[1:]))
    if len(d) == 9 and not any(map(str.isalpha, number)):
        return d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"
    return len(d) >= 6 and d.strip("0") != ""


#: Names of months, and the short ones of English (fixed values).
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
}
_M, _Y = r"[^\W\d_][^\W_]*(?:[-¬­‐=]\s*\n\s*[^\W\d_]+)?", rf"{D}{{4}}(?![\w]|,\d)"
MONTH_DAY = re.compile(rf"(?<![\w.-])(?P<m>{_M})\.?\s+(?P<d>{D}{{1,2}})(?:st|nd|rd|th)?(?![\w]|[.,/]\d)(?:,?\s+(?P<y>{_Y}))?")
DAY_MONTH = re.compile(rf"(?<![\w.,/$-])(?P<d>{D}{{1,2}})(?P<mark>st|nd|rd|th|er|º|\.)?\s+(?P<of>of\s+|de\s+)?(?P<m>{_M})\.?(?:,?\s+(?:del?\s+)?(?P<y>{_Y}))?")
ISO = re.compile(r"(?<![\w-])(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)(?![\w-])")


@functools.lru_cache(100_000)
def months(word: str) -> tuple[bool, tuple[tuple[str, int], ...]]:
    """Whether a word is a month's name as written, and the (language, number) that it may be."""
    from fieldlore.llm.ocr_repair import distance

    w = fold(word)
    names = [(k, i, fold(n)) for k, all_ in MONTHS.items() for i, n in enumerate(all_, 1)] + [("short", 9, "sep")]
    if same := tuple((k, i) for k, i, n in names if n == w):
        return True, same
    return False, tuple((k, i) for k, i, n in names if len(w) > 3 and len(n) > 2 and abs(len(n) - len(w)) < 3 and distance(w, n) <= 0.3)


#: A day of a month in figures, one misread.
SHORT = re.compile(rf"(?<![\w.,/$-])(?=\d|[OolI]\d){D}{{1,2}}(?!\d)")


def _begin(text: str, end: int) -> int:
    """Where the run without blanks that ends at a place begins."""
    return max(text.rfind(" ", 0, end), text.rfind("\n", 0, end), text.rfind("\t", 0, end), text.rfind("\r", 0, end), text.rfind("\xa0", 0, end)) + 1


def _word_before(text: str, at: int) -> int:
    """Where the word before a place begins, with its first part if it is broken at a line end; the place itself if there is none."""
    j = len(text[max(0, at - 8) : at].rstrip()) + max(0, at - 8)
    if j == at:
        return at
    k = _begin(text, j)
    while k < j and not text[k].isalpha():
        k += 1
    q = len(text[max(0, k - 8) : k].rstrip()) + max(0, k - 8)
    if 0 < q < k and text[q - 1] in "-¬­‐=" and "\n" in text[q:k]:
        k = _begin(text, q - 1)
        while k < q and not text[k].isalpha():
            k += 1
    return k


def dates(text: str) -> list[tuple[int, int, re.Match, str, datetime.date, bool]]:
    """(start, end, match, language, day, whether a year is told) of the dates of a text that are possible days, without
    overlaps; a day without a year is one of a leap year."""
    out, taken, month_first, day_first = [], [], [], []
    for s in SHORT.finditer(text):
        # the patterns look only at places where a day stands, with a blank or a mark of an ordinal beside it
        begin, end = s.span()
        if begin and text[begin - 1].isspace() and (k := _word_before(text, begin)) < begin and (m := MONTH_DAY.match(text, k)) and m.start("d") == begin:
            month_first.append(m)
        after = text[end : end + 1]
        if (after.isspace() or after in ".sntreº") and after and (m := DAY_MONTH.match(text, begin)):
            day_first.append(m)
    for pattern, found_at, order in ((ISO, ISO.finditer(text) if "-0" in text or "-1" in text else (), ()), (MONTH_DAY, month_first, ("en", "short")), (DAY_MONTH, day_first, ("en", "short", "fr", "es", "de"))):
        for m in found_at:
            language = "iso"
            if order:
                if not any(map(str.isdigit, m["d"])):
                    continue
                as_written, found = months(m["m"])
                if pattern is DAY_MONTH:
                    order = {"de ": ("es", "fr", "de"), "of ": ("en", "short")}.get((m["of"] or "").replace("\n", " ")[:3], ("de", "fr", "en", "short", "es") if m["mark"] == "." else ("en", "short", "fr", "es", "de"))
                found = [(k, i) for k, i in found if k in order and (not as_written or k in ("fr", "es") or m["m"][0].isupper())]
                if not found:
                    continue
                language, month = min(found, key=lambda x: order.index(x[0]))
            else:
                month = int(m["m"])
            year = int(m["y"].translate(MISREAD_DIGITS)) if m["y"] else 1904
            told = bool(m["y"]) and 1500 <= year < 2100
            try:
                day = datetime.date(year if told else 1904, month, int(m["d"].translate(MISREAD_DIGITS)))
            except ValueError:
                continue
            parts = "mdy" if told else "md"
            start, end = min(map(m.start, parts)), max(map(m.end, parts))
            if (language == "iso" and not told) or any(start < e and s < end for s, e in taken):
                continue
            taken.append((start, end))
            out.append((start, end, m, language, day, told))
    return sorted(out, key=lambda x: x[:2])


def moved(day: datetime.date, key: bytes, inverse: bool = False) -> datetime.date:
    """Another day of the same century."""
    century = day.year // 100
    first, last = datetime.date(century * 100, 1, 1), datetime.date(century * 100 + 99, 12, 31)
    tweak = b"date" if century == 19 else b"date%d" % century
    return first + datetime.timedelta(permute((day - first).days, (last - first).days + 1, key, tweak, inverse))


def date_placeholder(text: str, found: tuple, key: bytes, inverse: bool = False) -> str:
    start, end, m, language, day, told = found
    if told:
        new = moved(day, key, inverse)
    else:
        first = datetime.date(1904, 1, 1)
        new = first + datetime.timedelta(permute((day - first).days, 366, key, b"day", inverse))
    if language == "iso":
        return f"[DATE {new.isoformat()}]"
    name, old = MONTHS[language][new.month - 1], m["m"]
    name = name.upper() if len(old) > 1 and old.isupper() else name.capitalize() if old[0].isupper() else name
    put = {"m": name, "d": f"{new.day:02d}" if m["d"][0] in "0Oo" else str(new.day)} | ({"y": str(new.year)} if told else {})
    out, at = [], start
    for part in sorted(put, key=m.start):
        out += [text[at : m.start(part)], put[part]]
        at = m.end(part)
    return f"[DATE {''.join([*out, text[at:end]])}]"


def date_pseudonym(date: str, key: bytes, inverse: bool = False) -> str:
    """An ISO date of 1900 to 1999 as another valid date of that century; others as they are."""
    try:
        day = datetime.date.fromisoformat(date)
    except ValueError:
        return date
    return moved(day, key, inverse).isoformat() if 1900 <= day.year <= 1999 else date


def placeholder(kind: str, value: str, key: bytes) -> str:
    if kind in ("phone", "id_number"):
        number = read_number(kind, value)
        if is_number(kind, number, "".join(filter(str.isdigit, number))):
            head = country_code(number) if kind == "phone" else ""
            fixed = "".join(filter(str.isdigit, head))
            return f"[{kind.upper()} {head}{pseudonym(number[len(head):], key, valid=lambda d: is_number(kind, number, fixed + d))}]"
    same = " ".join(fold(value).split())
    return f"[{kind.upper()} {hashlib.blake2b(same.encode(), key=key, digest_size=8).hexdigest()}]"


def replacements(text: str | None, surnames, key: bytes, judged: dict | None = None, with_dates: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, placeholder) of all that is masked in a text, in order; dates have the kind 'date'."""
    if not text:
        return []
    own = find(text, surnames, judged)
    put = [(s, e, kind, placeholder(kind, text[s:e], key)) for s, e, kind in own]
    if with_dates:
        put += [(d[0], d[1], "date", date_placeholder(text, d, key)) for d in dates(text) if not any(d[0] < e and s < d[1] for s, e, _ in own)]
        put.sort()
    return put


def mask(text: str | None, surnames, key: bytes, judged: dict | None = None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s, e, _, new in replacements(text, surnames, key, judged):
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


# -- frames --------------------------------------------------------------------------------------------------

#: A surname follows a title or an initial so many times in the corpus, and in this share of its occurrences.
LEAST_STRONG, STRONG_SHARE = 2, 0.03
MOST_SURNAMES = 2_000_000


def _strong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    strong: Counter = Counter()
    total: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(fold(w), strong.get(w, 0), n) for w, n in total.items()]
        strong.clear(), total.clear()
        return pd.DataFrame(rows, columns=["surname", "strong", "total"])

    for b in batches:
        for t in b["text"]:
            strong.update(STRONG.findall(t))
            total.update(WORD.findall(t))
        if len(total) > 500_000:
            yield out()
    yield out()


def surnames_of(texts: DataFrame) -> DataFrame:
    """surname: the corpus' surnames; texts has column text."""
    counted = texts.select("text").where("text IS NOT NULL").mapInPandas(_strong, "surname string, strong bigint, total bigint").groupBy("surname").agg(F.sum("strong").alias("strong"), F.sum("total").alias("total"))
    return counted.where((F.col("strong") >= LEAST_STRONG) & (F.col("strong") >= STRONG_SHARE * F.col("total")) & ~F.col("surname").isin(*NOT_NAMES)).select("surname")


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """record_id, same (hash of the text) and every folded word that ``find`` may look up in the lexicon for a text."""
    for b in batches:
        rows = []
        for i, h, t in zip(b["record_id"], b["same"], b["text"]):
            words = {fold(w) for w in WORD.findall(t)} - NOT_NAMES
            rows += [(i, h, w) for w in words.union(*(readings(w) for w in words if len(w) > 5))]
        yield pd.DataFrame(rows, columns=["record_id", "same", "surname"])


def _with_surnames(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """rows (record_id, text) through ``kernel(batches, lexicon of a row)``. A lexicon within MOST_SURNAMES goes to every
    worker; beyond it each text meets only its own words, in a shuffled join, with the same result."""
    from fieldlore.session import cut

    surnames = cut(surnames_of(rows))
    if surnames.count() <= MOST_SURNAMES:
        every = rows.sparkSession.sparkContext.broadcast(frozenset(r.surname for r in surnames.toLocalIterator()))

        def with_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from kernel(batches, lambda b: [every.value] * len(b))

        return rows.mapInPandas(with_all, schema)
    keyed = rows.withColumn("same", F.xxhash64("text"))
    asked = keyed.where("text IS NOT NULL").select("record_id", "same", "text").mapInPandas(_asked, "record_id string, same bigint, surname string").distinct()
    own = asked.join(surnames, "surname").groupBy("record_id", "same").agg(F.collect_list("surname").alias("known"))
    met = keyed.alias("k").join(own.alias("o"), F.col("k.record_id").eqNullSafe(F.col("o.record_id")) & (F.col("k.same") == F.col("o.same")), "left").select("k.record_id", "k.text", "o.known")

    def with_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from kernel(batches, lambda b: [frozenset(k) if k is not None else frozenset() for k in b["known"]])

    return met.mapInPandas(with_own, schema)


def items(texts: DataFrame) -> DataFrame:
    """record_id, kind, start_pos of the personal items: where ``masked`` puts its placeholders, dates aside; texts has
    columns record_id and text."""
    rows = texts.where("record_id IS NOT NULL AND text IS NOT NULL").select("record_id", "text")

    def kernel(batches: Iterator[pd.DataFrame], lexicon) -> Iterator[pd.DataFrame]:
        judged: dict = {}
        for b in batches:
            # what is remembered of words holds for one lexicon
            shared = "known" not in b
            out = [(i, kind, s) for i, t, known in zip(b["record_id"], b["text"], lexicon(b)) for s, _, kind, _ in replacements(t, known, b"found", judged if shared else None, False)]
            yield pd.DataFrame(out, columns=["record_id", "kind", "start_pos"])

    return _with_surnames(rows, kernel, "record_id string, kind string, start_pos int").distinct()


def masked(texts: DataFrame, key: bytes) -> DataFrame:
    """record_id and the text with typed placeholders, for every row as often as it is given."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key has 16 to 64 bytes")

    def kernel(batches: Iterator[pd.DataFrame], lexicon) -> Iterator[pd.DataFrame]:
        judged: dict = {}
        for b in batches:
            shared = "known" not in b
            yield pd.DataFrame({"record_id": b["record_id"], "text": [mask(t, known, key, judged if shared else None) if isinstance(t, str) else None for t, known in zip(b["text"], lexicon(b))]})

    return _with_surnames(texts.select("record_id", "text"), kernel, "record_id string, text string")
