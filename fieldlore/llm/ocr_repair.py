"""Repair of text from scanned pages: line breaks inside words, misread characters, running heads and page numbers.

The corpus' own words, with their frequencies, are the lexicon. Rare forms meet frequent words through a
symmetric-delete index (both sides with one character deleted, after letters that look like two are written as one);
a weighted edit distance in which pairs of characters that scans confuse are cheap rates the candidates. A form is
misread if a word near it is many times as frequent, and the form no more frequent than its confusion is elsewhere.
Then the neighbours decide, by the counts of the bigrams with the word before and after: which of the candidates that
rate alike is meant, and whether a form that is met more than once is a word of its own where it stands. Words broken
at a line end are joined if the joined word is known more often than the hyphenated one.

One pass over the pages counts the pairs of neighbouring words; the frequencies of words are sums of these. A lexicon
within MOST_WORDS entries goes to every worker; beyond it each document meets only its own words and neighbours in
shuffled joins, with the same result.

Defined results: null, empty and blank pages have no lines; pages given twice are repaired once; a page without a document
record is repaired without a title; lines are counted from 1; a document is read in the order of its page numbers
(null first), then of the page ids.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a scan shows for what stands on the page (fixed values).
CONFUSIONS = tuple(tuple(p.split(">")) for p in "e>c c>e t>f f>t h>b b>h o>0 0>o l>1 1>l i>1 i>! l>! a>@ s>5 b>6 g>9 q>9 z>2 b>8 m>rn rn>m n>ii u>ii d>cl cl>d w>vv n>u u>n i>l l>i h>li li>h e>f y>v v>y ll>u i>j n>ri m>in in>m k>lc".split())  # pairs are true>shown
PAIRS = frozenset(CONFUSIONS)
PAIR_COST, BUDGET = 0.3, 0.7
#: A confusion's rate is measured on forms of so many letters, which are hardly words themselves; a form may be so many times as frequent as its rate says, and some more.
LONG, SLACK, MORE, RARE = 6, 8.0, 3.0, 2e-4
#: A word is this many times as frequent as its misread form, and is met at least so often.
TIMES, LEAST = 8, 4
STRAY = "*¦^\\|•~¤_<>{}`"
HYPHENS = "-‐¬­=‑"
PUNCTUATION = ".,;:!?()[]\"'“”„«»‘’…—–-‐¬­=‑/&$¿¡%#°+" + STRAY
JOINED = re.compile(rf"(?<=[^\W\d_])[{re.escape(HYPHENS)}][ \t\r]*\n\s*(?=[^\W\d_])")
ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|s|er|ère|e|è|ème|ª|º|o|a|\.)?", re.I)
MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\[at\]|\(at\)", re.I)
AS_LETTERS = str.maketrans("0156980!@", "olsbgbola")
PAGE_NUMBER = re.compile(r"[-~–—.\s(\[]*(?:(?:page|pag\.|p\.|seite|página)\s*)?[\dlIO]{1,4}(?:\s*(?:of|/|de|von|sur)\s*[\dlIO]{1,4})?[-~–—.\s)\]]*", re.I)
IN_WORD = re.compile(r"[^\W\d_][!@|][^\W\d_]")
ONE_FOR_TWO = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n"), ("li", "h"), ("ri", "n"))
REMEMBERED = 300_000


@functools.lru_cache(REMEMBERED)
def core(token: str) -> str:
    """The word of a token: lower case, without the marks around it."""
    return token.strip(PUNCTUATION).lower()


@functools.lru_cache(REMEMBERED)
def counted(token: str) -> str:
    """The word of a token if the lexicon counts it, else nothing."""
    w = core(token)
    return w if 1 < len(w) < 40 and any(c.isalpha() for c in w) and not MAIL.search(token) else ""


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b, n of words that follow each other on a page; the last one is followed by nothing."""
    pairs: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(a, b, n) for (a, b), n in pairs.items() if a]
        pairs.clear()
        return pd.DataFrame(rows, columns=["a", "b", "n"])

    for batch in batches:
        for t in batch["raw_ocr_text"]:
            words = [counted(x) for x in JOINED.sub("", t).split()]
            pairs.update(zip(words, [*words[1:], ""]))
        if len(pairs) > 3 * REMEMBERED:
            yield out()
    yield out()


def deletes(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def readings(form: str) -> set[str]:
    """A form with digits read as letters, and with any one pair of letters that looks like a single one written so, or the reverse."""
    w = form.translate(AS_LETTERS)
    out = {w}
    for two, one in ONE_FOR_TWO:
        at = w.find(two)
        while at >= 0:
            out.add(w[:at] + one + w[at + 2 :])
            at = w.find(two, at + 1)
        at = w.find(one)
        while at >= 0:
            out.add(w[:at] + two + w[at + 1 :])
            at = w.find(one, at + 1)
    return out


def _index(of_form: bool):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, k) for w, n in zip(b["word"], b["n"]) for k in (set().union(*map(deletes, readings(w))) if of_form else deletes(w))]
            yield pd.DataFrame(rows, columns=["word", "n", "key"])

    return kernel


@functools.cache
def shown_for() -> dict[str, list[str]]:
    """By what a scan shows, what may stand on the page."""
    out: dict[str, list[str]] = {}
    for true, shown in CONFUSIONS:
        out.setdefault(shown, []).append(true)
    return out


def distance(form: str, word: str, budget: float = BUDGET) -> float:
    """Cost of the scan having shown form for word; anything beyond the budget is infinite."""
    table, inf = shown_for(), float("inf")
    best = {(0, 0): 0.0}
    todo = [(0, 0)]
    final = (len(form), len(word))
    while todo:
        i, j = at = todo.pop()
        cost = best[at]
        while i < len(form) and j < len(word) and form[i] == word[j]:
            i, j = i + 1, j + 1
            if cost < best.get((i, j), inf):
                best[i, j] = cost
        # the branch may also leave the common run at any earlier place
        for x, y in [(at[0] + k, at[1] + k) for k in range(i - at[0] + 1)]:
            new = cost + PAIR_COST
            if new <= budget:
                for size in (1, 2):
                    for true in table.get(form[x : x + size], ()):
                        if len(form) - x >= size and word.startswith(true, y):
                            nxt = (x + size, y + len(true))
                            if new < best.get(nxt, inf):
                                best[nxt] = new
                                todo.append(nxt)
    return best.get(final, inf)


def change(form: str, word: str) -> str:
    """What a single confusion shows for what: 'd>cl'; empty if more than one place differs."""
    a = 0
    while a < min(len(form), len(word)) and form[a] == word[a]:
        a += 1
    b = 0
    while b < min(len(form), len(word)) - a and form[-1 - b] == word[-1 - b]:
        b += 1
    # a pair may share a letter with its neighbours: widen until it is a known one
    for left in range(a, max(-1, a - 2), -1):
        for right in range(b, max(-1, b - 2), -1):
            pair = (word[left : len(word) - right], form[left : len(form) - right])
            if pair in PAIRS:
                return ">".join(pair)
    return ""


def _rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["cost"] = [distance(f, w) for f, w in zip(b["form"], b["word"])]
        b = b[b["cost"] <= BUDGET].copy()
        b["pair"] = [change(f, w) for f, w in zip(b["form"], b["word"])]
        yield b


def pairs(pages: DataFrame) -> DataFrame:
    """a, b, n: how often word b follows word a in the corpus ('' behind the last word of a page or before what is no word)."""
    return pages.select("raw_ocr_text").mapInPandas(_pairs, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def lexicon(counted_pairs: DataFrame) -> DataFrame:
    """word and n of every word of the corpus."""
    return counted_pairs.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))


def candidates(words: DataFrame) -> DataFrame:
    """form, m, word, cost, n: for every rare form, met m times, the words, met n times, that it may be misread from."""
    from fieldlore.session import cut

    long, schema = words.where("length(word) > 2"), "word string, n bigint, key string"
    rare = long.mapInPandas(_index(True), schema).select(F.col("word").alias("form"), F.col("n").alias("m"), "key")
    known = long.where(F.col("n") >= LEAST).mapInPandas(_index(False), schema)
    met = rare.join(known, "key").where((F.col("form") != F.col("word")) & (F.col("n") >= TIMES * F.col("m")) & (F.abs(F.length("form") - F.length("word")) <= 2)).select("form", "m", "word", "n").distinct()
    rated = cut(met.mapInPandas(_rate, "form string, m bigint, word string, n bigint, cost double, pair string"))
    # a word of its own ('tell' beside 'fell') is more frequent than the confusion makes its likes
    rates = rated.where((F.length("form") >= LONG) & (F.col("pair") != "") & (F.col("n") >= 50)).groupBy("pair").agg((F.sum("m") / F.sum("n")).alias("rate"))
    return rated.join(F.broadcast(rates), "pair", "left").where(F.col("m") <= SLACK * F.coalesce("rate", F.lit(RARE)) * F.col("n") + MORE).select("form", "m", "word", "n", "cost")


def corrections(rated: DataFrame) -> DataFrame:
    """form, m, words: for each form the words of the least cost, the more frequent first."""
    order = Window.partitionBy("form").orderBy("cost", F.desc("n"), "word")
    ranked = rated.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("cost").over(Window.partitionBy("form"))).where(F.col("cost") <= F.col("least") + 0.05)
    return ranked.groupBy("form", "m").agg(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"].alias("words"))


def neighbours(fixes: DataFrame, counted_pairs: DataFrame) -> DataFrame:
    """form, side, other, words: for forms that the neighbours decide on (met more than once, or with several corrections)
    how often each correction, and the form itself besides, stands beside each of the form's own neighbours."""
    open_ = fixes.where("m > 1 OR size(words) > 1").select("form", "words")
    beside = counted_pairs.where("b <> ''")
    sides = lambda df, word, n: df.select(F.col("a").alias(word), F.lit(1).alias("side"), F.col("b").alias("other"), F.col("n").alias(n)).unionByName(df.select(F.col("b").alias(word), F.lit(0).alias("side"), F.col("a").alias("other"), F.col("n").alias(n)))
    own = sides(beside, "form", "own").join(open_, "form")
    wanted = own.select("form", "side", "other", F.explode("words").alias("word"))
    # a frequent word has many neighbours, but only those that a form has too are asked for
    met = wanted.join(sides(beside, "word", "n"), ["word", "side", "other"]).select("form", "side", "other", "word", "n")
    # the form's own count is one less: what is judged gives no evidence for itself
    return met.unionByName(own.where("own > 1").select("form", "side", "other", F.col("form").alias("word"), (F.col("own") - 1).alias("n")))


def marked(token: str) -> bool:
    """Whether a token has a mark that no word has."""
    return any(c in STRAY for c in token) or IN_WORD.search(token) is not None


class Lexicon:
    """What a worker knows: corrections by form, counts of words, and bigrams (form, side, other, word) of forms that
    neighbours decide on."""

    def __init__(self, fixes: dict, counts: dict, bigrams: dict):
        self.fixes, self.counts, self.bigrams, self.judged = fixes, counts, bigrams, {}
        self.contested = {k[0] for k in bigrams}

    def near(self, form: str, word: str, before: str, after: str) -> int:
        return self.bigrams.get((form, 0, before, word), 0) + self.bigrams.get((form, 1, after, word), 0)

    def repair(self, form: str, before: str = "", after: str = "") -> str | None:
        """The word that a form is misread from, or None if it is a word of its own there."""
        found = self.fixes.get(form)
        if found is None or form not in self.contested:
            return found and found[0]
        best = found[0] if len(found) == 1 else max(found, key=lambda w: (self.near(form, w, before, after), -found.index(w)))
        own = self.near(form, form, before, after)
        return None if own and own > self.near(form, best, before, after) else best

    def misread(self, token: str) -> bool:
        if (known := self.judged.get(token)) is None:
            if len(self.judged) > REMEMBERED:
                self.judged.clear()
            known = self.judged[token] = self._misread(token)
        return known

    def _misread(self, token: str) -> bool:
        if MAIL.search(token):
            return False
        if marked(token):
            return True
        w = core(token)
        if not w:
            return False
        if any(c.isdigit() for c in w):
            if ORDINAL.fullmatch(w) or not any(c.isalpha() for c in w):
                return False
            plain = token.strip(PUNCTUATION)
            as_word = w.translate(AS_LETTERS)
            if as_word.isalpha() and self.counts.get(as_word, 0) >= 2:
                return True
            as_word = w.replace("1", "i").translate(AS_LETTERS)
            if as_word.isalpha() and self.counts.get(as_word, 0) >= 2:
                return True
            if re.fullmatch(r"\d*[OolI]\d+|\d+[OolI]\d*", plain):
                return True
            return sum(c.islower() for c in plain) >= 3 and sum(map(str.isdigit, plain)) == 1 and re.fullmatch(r"[^\W_]+(?:['’-][^\W_]+)*", plain) is not None and self.fixes.get(w) is not None
        if w in self.fixes:
            return True
        if "-" in w or "'" in w or "’" in w:
            return any(p in self.fixes for p in re.split(r"[-'’]", w) if len(p) > 3)
        return False


def furniture(lines: list[str], title: str | None) -> set[int]:
    """Indices of running heads, running feet and page numbers."""
    from fieldlore.llm.names import ratio

    full = [i for i, line in enumerate(lines) if line.strip()]
    out = set()
    if not full:
        return out
    shrink = lambda t: re.sub(r"[\W\d_]|page", "", t.lower())
    want = shrink(title or "")
    for i in dict.fromkeys((*full[:2], *full[-2:])):
        line = lines[i].strip()
        here = shrink(line)
        if len(want) > 8 and abs(len(here) - len(want)) <= 0.25 * len(want) and ratio(here, want) >= 0.85:
            out.add(i)
        elif not want and i == full[0] and len(here) > 10 and HEAD.fullmatch(line):
            out.add(i)
    for i in dict.fromkeys((full[0], full[-1])):
        line = lines[i].strip()
        if PAGE_NUMBER.fullmatch(line) and (re.search(r"[-~]|page|p\.", line, re.I) or len(full) == 1 or (i == full[0]) or not lines[i - 1].strip() or not re.fullmatch(r"\d{1,4}\.", line)):
            out.add(i)
    return out


#: A first line that is a head by its look alone, where the title is unknown: framed, numbered at its end, or in capitals.
HEAD = re.compile(r"--\s.*\s--|.*\S\s+--\s+page\s+\d+|\d{1,3}\s{2,}\S.*|.*\S\s{2,}\d{1,3}|[^a-z]{12,}")


def document(pages: list[tuple[str, str]], title: str | None, lex: Lexicon, text_too: bool = True) -> tuple[list[tuple[str, int, str]], list[str]]:
    """(page_id, line_no, kind) findings and, if wanted, the repaired paragraphs of one document."""
    found: list[tuple[str, int, str]] = []
    flow: list[tuple[str, int, str] | None] = []
    for page_id, text in pages:
        lines = [x.rstrip("\r") for x in text.split("\n")]
        skip = furniture(lines, title)
        found += [(page_id, i + 1, "furniture") for i in skip]
        for i, line in enumerate(lines):
            if i in skip:
                continue
            flow.append((page_id, i + 1, line) if line.strip() else None)
    at = [i for i, x in enumerate(flow) if x]
    bad = set()
    words_of = {i: flow[i][2].split() for i in at}
    head_part: dict[int, str] = {}
    tail_part: dict[int, int] = {}
    for n, i in enumerate(at):
        words = words_of[i]
        last = words[-1]
        if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha() and n + 1 < len(at):
            for j in at[n + 1 : n + 4]:
                first = words_of[j][0]
                begin = re.match(r"[^\W_]+", first)
                goes_on = begin and (begin[0][0].islower() or (len(last) > 2 and last[:-1].isupper() and begin[0].isupper()))
                if not goes_on or j in tail_part:
                    # a new paragraph, a note or the like stands between: look further only past a page or blank line
                    if flow[j - 1] is None or flow[j][0] != flow[i][0]:
                        continue
                    break
                left, right = core(last), core(first)
                whole, hyphened = left + right, left + "-" + right
                known, kept = lex.counts.get(whole, 0), lex.counts.get(hyphened, 0)
                if not known and (fix := lex.repair(whole)):
                    known = lex.counts.get(fix, 1)
                if not known and kept <= 1 and last[-1] == "-" and lex.counts.get(left.split("-")[-1], 0) >= 50 and lex.counts.get(right, 0) >= 50:
                    kept = 2
                if kept <= known or last[-1] in "¬­=":
                    head_part[i], tail_part[j] = whole, i
                    found.append((flow[i][0], flow[i][1], "split"))
                    if (fix := lex.repair(whole)) is not None or lex.misread(whole):
                        fix = fix or whole.translate(AS_LETTERS)
                        if not fix.startswith(left):
                            bad.add(i)
                        if not fix.endswith(right):
                            bad.add(j)
                else:
                    tail_part[j] = -1
                    head_part[i] = ""
                break
    judged, judge, contested = lex.judged, lex.misread, lex.contested
    for i in at:
        if i in bad:
            continue
        words = words_of[i]
        first, last = int(tail_part.get(i, -1) >= 0), len(words) - bool(head_part.get(i))
        for k in range(first, last):
            w = words[k]
            if (known := judged.get(w)) is None:
                known = judge(w)
            if known and ((own := core(w)) not in contested or own not in lex.fixes or marked(w) or lex.repair(own, counted(words[k - 1]) if k else "", counted(words[k + 1]) if k + 1 < len(words) else "")):
                bad.add(i)
                break
        else:
            # of the parts of a broken word only what no letter can be tells
            for w in (*words[:first], *words[last:]):
                if marked(w):
                    bad.add(i)
                    break
    found += [(flow[i][0], flow[i][1], "misread") for i in bad]
    return found, _paragraphs(flow, at, words_of, head_part, tail_part, lex) if text_too else []


def _paragraphs(flow, at, words_of, head_part, tail_part, lex: Lexicon) -> list[str]:
    out: list[str] = []
    current: list[str] = []
    before = None
    for i in at:
        words = list(words_of[i])
        gap = before is not None and any(flow[k] is None for k in range(before + 1, i))
        if current and gap and i not in tail_part and not (flow[i][0] != flow[before][0] and not re.search(r"[.!?…»”\")]$", current[-1])):
            out.append(" ".join(current))
            current = []
        fixed: list[str] = []
        for k, w in enumerate(words):
            own = core(w)
            if own in lex.fixes:
                good = lex.repair(own, counted(words[k - 1]) if k else "", counted(words[k + 1]) if k + 1 < len(words) else "") or own
                a = w.lower().find(own)
                shown = w[a : a + len(own)]
                w = w[:a] + (good.upper() if shown.isupper() and len(shown) > 1 else good.capitalize() if shown[:1].isupper() else good) + w[a + len(own) :]
            elif w and all(c in STRAY for c in w):
                continue
            fixed.append(w)
        if i in tail_part and current and fixed:
            first = fixed.pop(0)
            current[-1] = (current[-1] if tail_part[i] < 0 else current[-1].rstrip(HYPHENS)) + first
            if tail_part[i] >= 0 and (fix := lex.repair(core(current[-1]))):
                shown = core(current[-1])
                current[-1] = re.sub(re.escape(shown), fix.capitalize() if current[-1].lstrip(PUNCTUATION)[:1].isupper() else fix, current[-1], flags=re.I)
        current += fixed
        before = i
    if current:
        out.append(" ".join(current))
    return out


def _repair(lexicon_of, text: bool):
    """lexicon_of(batch): the lexicon of each row."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, title, lex, held = None, None, None, []

        def flush() -> list:
            if not held:
                return []
            found, paragraphs = document(held, title, lex, text)
            return [(doc, i + 1, p) for i, p in enumerate(paragraphs)] if text else found

        columns = ["doc_id", "paragraph_no", "text"] if text else ["page_id", "line_no", "kind"]
        for b in batches:
            rows = []
            for d, p, name, t, known in zip(b["doc_id"], b["page_id"], b["title"], b["raw_ocr_text"], lexicon_of(b)):
                if d != doc:
                    rows += flush()
                    doc, title, lex, held = d, name if isinstance(name, str) else None, known(), []
                if not held or held[-1][0] != p:
                    held.append((p, t))
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(flush(), columns=columns)

    return kernel


#: Entries of the tables that every worker holds; beyond it documents meet their own words in joins.
MOST_WORDS = 2_000_000


def asked(pages: list[str]) -> tuple[set[str], set[tuple[str, int, str]]]:
    """All words that ``document`` may look up for these pages, and all (form, side, other) of their neighbours."""
    words, beside = set(), set()
    rows = [x.split() for t in pages for x in t.split("\n")]
    rows = [r for r in rows if r]
    for r in rows:
        own = [core(w) for w in r]
        known = [counted(w) for w in r]
        for k, w in enumerate(own):
            words.update((w, w.translate(AS_LETTERS), w.replace("1", "i").translate(AS_LETTERS), *re.split(r"[-'’]", w)))
            beside.add((w, 0, known[k - 1] if k else ""))
            beside.add((w, 1, known[k + 1] if k + 1 < len(r) else ""))
    for n, r in enumerate(rows):
        if len(r[-1]) > 1 and r[-1][-1] in HYPHENS:
            left = core(r[-1])
            # furniture between the parts is skipped: a line has two lines of it at most at each end of a page
            for s in rows[n + 1 : n + 9]:
                right = core(s[0])
                words.update((left + right, left + "-" + right, left.split("-")[-1], right, (left + right).translate(AS_LETTERS), (left + right).replace("1", "i").translate(AS_LETTERS), *re.split(r"[-'’]", left + right)))
    return words, beside


def _asked(words: bool):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, held = None, []

        def flush() -> list:
            if not held:
                return []
            found = asked(held)[0 if words else 1]
            return [(doc, w) for w in found if w] if words else [(doc, *x) for x in found if x[2]]

        columns = ["doc_id", "word"] if words else ["doc_id", "form", "side", "other"]
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["raw_ocr_text"]):
                if d != doc:
                    rows += flush()
                    doc, held = d, []
                held.append(t)
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(flush(), columns=columns)

    return kernel


def _repaired(pages: DataFrame, records: DataFrame, text: bool, schema: str) -> DataFrame:
    from fieldlore.session import cut

    read = _read(pages)
    ordered = _in_order(read, records)
    followed = cut(pairs(read))
    words = cut(lexicon(followed))
    fixes = cut(corrections(candidates(words)))
    beside = cut(neighbours(fixes, followed))
    used = words.where("n >= 2")
    if used.count() + fixes.count() + beside.count() <= MOST_WORDS:
        every = pages.sparkSession.sparkContext.broadcast(({r.form: list(r.words) for r in fixes.toLocalIterator()}, {r.word: r.n for r in used.toLocalIterator()}, {(r.form, r.side, r.other, r.word): r.n for r in beside.toLocalIterator()}))

        def shared(b: pd.DataFrame):
            lex = _lexicon_of(every)
            return [lambda: lex] * len(b)

        return ordered.mapInPandas(_repair(shared, text), schema)
    # each document with the words it may look up
    known = used.select("word", "n").join(fixes.select(F.col("form").alias("word"), "words"), "word", "full")
    of_words = ordered.mapInPandas(_asked(True), "doc_id string, word string").join(known, "word")
    # a correction is counted as well as the form it corrects
    corrected = of_words.where("words IS NOT NULL").select("doc_id", F.explode("words").alias("word")).distinct().join(used, "word").select("doc_id", "word", "n", F.lit(None).cast("array<string>").alias("words"))
    own = of_words.select("doc_id", "word", "n", "words").unionByName(corrected).groupBy("doc_id").agg(F.collect_list(F.struct("word", "n", "words")).alias("known"))
    of_sides = ordered.mapInPandas(_asked(False), "doc_id string, form string, side int, other string").join(beside, ["form", "side", "other"])
    sides = of_sides.groupBy("doc_id").agg(F.collect_list(F.struct("form", "side", "other", "word", "n")).alias("beside"))
    met = read.join(_titles(records), "doc_id", "left").join(own, "doc_id", "left").join(sides, "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "page_number", "page_id")

    def of_row(b: pd.DataFrame):
        def build(known, sides):
            known, sides = known if known is not None else (), sides if sides is not None else ()
            return Lexicon({r["word"]: list(r["words"]) for r in known if r["words"] is not None}, {r["word"]: r["n"] for r in known if r["n"] is not None and r["n"] == r["n"]}, {(r["form"], r["side"], r["other"], r["word"]): r["n"] for r in sides})

        return [functools.partial(build, k, s) for k, s in zip(b["known"], b["beside"])]

    return met.mapInPandas(_repair(of_row, text), schema)


_built: list = []


def _lexicon_of(shared) -> Lexicon:
    """The lexicon of a broadcast, built once by a worker."""
    value = shared.value
    if not _built or _built[0] is not value:
        _built[:] = [value, Lexicon(*value)]
    return _built[1]


def _read(pages: DataFrame) -> DataFrame:
    return pages.where("raw_ocr_text IS NOT NULL AND trim(raw_ocr_text) <> '' AND page_id IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "page_id", "page_number", "raw_ocr_text")


def _titles(records: DataFrame) -> DataFrame:
    return records.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("title").alias("title"))


def _in_order(read: DataFrame, records: DataFrame) -> DataFrame:
    return read.join(_titles(records), "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "page_number", "page_id")


def defects(pages: DataFrame, records: DataFrame) -> DataFrame:
    """page_id, line_no, kind (furniture, split, misread)."""
    return _repaired(pages, records, False, "page_id string, line_no int, kind string")


def paragraphs(pages: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, paragraph_no, text of the repaired documents."""
    return _repaired(pages, records, True, "doc_id string, paragraph_no int, text string")
