"""One consistent form of texts that look the same.

Words of the corpus are counted. Their spellings go into tries, and each odd spelling (one that its table form or its
fold differs from) walks a trie with a weighted edit automaton in which look-alike letters replace each other and
ignorable characters come and go at no cost; of the spellings it reaches the most frequent is the canonical one for
all of them. Words without another spelling are normalized by table: compatible forms (full width, ligatures, letters
of mathematics, presentation forms) unfold, spaces become the plain space, ignorable characters vanish, accents are
composed, and a word that mixes Latin with look-alikes of one other script is written in the script it mostly has.

The vocabulary is cut into tries by the first folded characters, which no step at no cost changes; prefixes are spread
over as many tasks as the counted vocabulary asks for, a prefix with too many words is cut further by a hash of the
fold, and prefixes without an odd word are left out. Nothing else of the fold is used: which words belong together is
found by the walk. What an edit at no cost can reach has an equal fold, so the tests use the fold as the brute form.
Only words with another spelling go back to the documents.

Defined results: null text stays null and is in no pair; a text without any visible character looks like no other
text; equal strings are no pair; line ends CR LF and LF look the same; letter case, quotation marks, dashes of other
length and digits of other scripts are visible differences.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that look like a Latin one (fixed values).
LOOKS = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "-": "‐‑",
}
TO_LATIN = {other: latin for latin, others in LOOKS.items() for other in others}
#: Characters that show nothing (fixed values): soft hyphen, joiners, marks of direction, word joiner, byte order mark, variation selectors.
IGNORABLE = frozenset(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0xFE00, 0xFE10))))
#: Folded characters by which tries are cut, and words of a trie's task.
PREFIX, TRIE_WORDS = 3, 50_000
#: Longer words (whole texts without a blank) meet by their fold, which is equal where a walk at no cost ends: the exact way for them without a path of nodes as long as a text.
LONGEST = 512
WORD, ODD = re.compile(r"\S+"), re.compile(r"[^\x00-\x7f]+")


@functools.cache
def unfolding() -> dict[int, str]:
    """What each character of a compatible form unfolds to, by the Unicode tags of its decomposition."""
    table: dict[int, str] = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if unicodedata.category(c) == "Zs":
            table[code] = " "
        elif (tag := unicodedata.decomposition(c).split(" ")[0]) in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") or 0xFB00 <= code <= 0xFB06:
            table[code] = unicodedata.normalize("NFKC", c)
        elif tag == "<noBreak>":
            table[code] = unicodedata.normalize("NFKC", c).replace("‐", "-")
    table[ord("‑")] = table[ord("‐")] = "-"
    return table


@functools.cache
def folding() -> dict[int, str]:
    """Unfolds, drops what shows nothing and writes look-alikes in Latin, in one pass."""
    return unfolding() | {ord(a): b for a, b in TO_LATIN.items()} | {ord(c): "" for c in IGNORABLE}


def unfold(text: str) -> str:
    return text.translate(unfolding())


def folded(word: str) -> str:
    """The same for all words that look the same."""
    if word.isascii():
        return word
    # accents may stand on a look-alike, and a look-alike may be composed: both orders are closed by decomposing first
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", unfold(word)).translate(folding()))


@functools.lru_cache(100_000)
def by_table(word: str) -> str:
    """A word normalized without regard to other spellings."""
    if word.isascii():
        return word
    w = unicodedata.normalize("NFC", "".join(c for c in unfold(word) if c not in IGNORABLE))
    scripts = Counter(unicodedata.name(c, "?").split()[0] for c in w if c.isalpha())
    if "LATIN" in scripts and len(scripts) == 2 and all(c in TO_LATIN for c in w if c.isalpha() and not unicodedata.name(c, "?").startswith("LATIN")):
        w = "".join(TO_LATIN.get(c, c) for c in w)
    return w


class Trie:
    """Spellings by their decomposed characters, with the counts of the corpus."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", unfold(word)):
            node = node.setdefault(c, {})
        node.setdefault("", []).append((word, count))

    def alike(self, word: str) -> list[tuple[str, int]]:
        """All spellings at edit cost 0 (look-alikes and ignorables cost nothing, anything else costs more than the budget)."""
        chars = [TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", unfold(word)) if c not in IGNORABLE]
        states, found = [self.root], []
        for want in chars:
            states = [child for node in self._reach(states) for c, child in node.items() if c and c not in IGNORABLE and TO_LATIN.get(c, c) == want]
            if not states:
                return []
        for node in self._reach(states):
            found.extend(node.get("", ()))
        return found

    @staticmethod
    def _reach(states: list[dict]) -> list[dict]:
        """The nodes and those behind them over characters that show nothing."""
        out = list(states)
        for node in out:
            out.extend(child for c, child in node.items() if c in IGNORABLE)
        return out


def canonical(found: list[tuple[str, int]]) -> str:
    """The table's form of the most frequent spelling; ties go to the one with fewer odd characters, then the smaller."""
    forms: Counter = Counter()
    for word, count in found:
        forms[by_table(word)] += count
    return min(forms, key=lambda w: (-forms[w], sum(not c.isascii() for c in w), w))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: Counter = Counter()
        for t in b["text"]:
            if isinstance(t, str):
                counts.update(t.split())
        words = list(counts)
        folds = [folded(w) for w in words]
        odd = [not w.isascii() and (w != f or w != by_table(w)) for w, f in zip(words, folds)]
        yield pd.DataFrame({"word": words, "fold": folds, "odd": odd, "n": [counts[w] for w in words]}).query("fold != ''")


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """word and canonical of the words of one task, trie by trie, whose canonical spelling is not the one the table gives."""
    rows = []
    for _, own in pdf.groupby("prefix", sort=False):
        if not own["odd"].any():
            continue
        trie, long, words = Trie(), {}, list(zip(own["word"], own["fold"], own["n"], own["odd"]))
        for word, fold, n, _ in words:
            if len(fold) > LONGEST:
                long.setdefault(fold, []).append((word, int(n)))
            else:
                trie.add(word, int(n))
        done: set[str] = set()
        for word, fold, _, odd in words:
            if odd and word not in done:
                found = long[fold] if len(fold) > LONGEST else trie.alike(word)
                best = canonical(found)
                # all that the walk meets belongs together
                for other, _ in found:
                    if other not in done and best != by_table(other):
                        rows.append((other, best))
                    done.add(other)
    return pd.DataFrame(rows, columns=["word", "canonical"])


def respelled(documents: DataFrame, size: int | None = None) -> DataFrame:
    """word and canonical for every word of the corpus whose canonical spelling is not the one the table gives."""
    from fieldlore.session import cut

    size = size or TRIE_WORDS
    counted = documents.select("text").mapInPandas(_words, "word string, fold string, odd boolean, n bigint")
    vocabulary = cut(counted.groupBy("word").agg(F.sum("n").alias("n"), F.first("fold").alias("fold"), F.first("odd").alias("odd")).withColumn("prefix", F.substring("fold", 1, PREFIX)))
    by = vocabulary.groupBy("prefix").agg(F.count("word").alias("words"), F.max("odd").alias("any_odd")).where("any_odd")
    live = cut(vocabulary.join(by.select("prefix", "words"), "prefix"))
    # a prefix too large for one trie is cut by the fold, which the words of a walk share
    parts = F.ceil(F.col("words") / size)
    keyed = live.withColumn("prefix", F.when(parts > 1, F.concat_ws("/", "prefix", F.pmod(F.xxhash64("fold"), parts))).otherwise(F.col("prefix")))
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-live.count() // size))
    spread = keyed.withColumn("task", F.pmod(F.xxhash64("prefix"), F.lit(tasks))).repartition(tasks, "task")
    return spread.groupBy("task").applyInPandas(_walk, "word string, canonical string")


def spelled(word: str, words: dict[str, str]) -> str:
    return words.get(word) or by_table(word)


def consistent(text: str | None, words: dict[str, str], plain: bool = True) -> str | None:
    """A text in its consistent form; words has the respelled ones, plain tells whether any of these is ASCII."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if plain and words:
        # a word in ASCII may have another canonical spelling: all words are looked at
        text = WORD.sub(lambda m: words.get(m[0], m[0]) if m[0].isascii() else m[0], text)
    if text.isascii():
        return text
    out, at = [], 0
    for m in ODD.finditer(text):
        if m.end() <= at:
            continue
        # the words (or blanks) around what is not ASCII
        a, b = max(m.start(), at), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        out.append(text[at:a])
        last = a
        for w in WORD.finditer(text, a, b):
            out += ["".join("" if c in IGNORABLE else unfold(c) for c in text[last : w.start()]), spelled(w[0], words)]
            last = w.end()
        out.append("".join("" if c in IGNORABLE else unfold(c) for c in text[last:b]))
        at = b
    return "".join([*out, text[at:]])


def _odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id and each distinct word that may have another spelling."""
    for b in batches:
        ids, words = [], []
        for i, t in zip(b["doc_id"], b["text"]):
            if isinstance(t, str):
                own = set(WORD.findall(t))
                ids += [i] * len(own)
                words += own
        yield pd.DataFrame({"doc_id": ids, "word": words})


def normalized(documents: DataFrame) -> DataFrame:
    """doc_id, text and canonical (the consistent form) of every row; doc_id is unique."""
    from fieldlore import session

    table = session.cut(respelled(documents))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, canonical string"
    rows = documents.select("doc_id", "text")
    if table.count() <= session.BROADCAST_ROWS:
        every = {r.word: r.canonical for r in table.toLocalIterator()}
        words, plain = documents.sparkSession.sparkContext.broadcast(every), any(w.isascii() for w in every)

        def by_dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "canonical": [consistent(t, words.value, plain) if isinstance(t, str) else None for t in b["text"]]})

        return rows.mapInPandas(by_dictionary, schema)
    # the table is large: each document meets only its own words
    own = rows.mapInPandas(_odd, f"doc_id {kind}, word string").join(table, "word").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("words"))

    def by_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "canonical": [consistent(t, dict(w) if w is not None else {}) if isinstance(t, str) else None for t, w in zip(b["text"], b["words"])]})

    return rows.join(own, "doc_id", "left").mapInPandas(by_own, schema)


def pairs(forms: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b of documents that look the same and are different strings."""
    hashed = forms.where("canonical IS NOT NULL AND trim(canonical) RLIKE '[^\\\\s]'").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("string"), F.md5(F.encode("canonical", "utf-8")).alias("look"))
    from fieldlore.session import cut

    hashed = cut(hashed)
    # first the strings of each look, so that a group of copies counts as one
    strings = hashed.select("look", "string").distinct()
    several = strings.groupBy("look").agg(F.count("string").alias("n")).where("n > 1").select("look")
    different = strings.join(several, "look", "left_semi")
    links = different.alias("a").join(different.alias("b"), F.expr("a.look = b.look AND a.string < b.string")).select(F.col("a.string").alias("string_a"), F.col("b.string").alias("string_b"))
    a = hashed.select(F.col("doc_id").alias("x"), F.col("string").alias("string_a"))
    b = hashed.select(F.col("doc_id").alias("y"), F.col("string").alias("string_b"))
    return links.join(a, "string_a").join(b, "string_b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
