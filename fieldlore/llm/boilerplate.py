"""Lines repeated across one source's documents.

Lines are folded: letter case, spacing, punctuation and stray marks go, and letters and digits that scans mistake for
each other share a class, while different digits stay different. Two lines are linked if their numbers agree and the
folded lines nearly so (``NEAR``); linked lines are one cluster, and clusters that stand in enough documents of their
source are given, however their writings are spread.

Every pair of a part is judged. A source up to twice ``PART`` documents is one part. A larger one is divided by its
documents' hash: a cluster with a share of all documents has at least that share in some part, so what has it in any part
is a candidate. Of each candidate, lines that all its lines in that part are linked to (``_cover``) go to all parts of
the source, meet every line there, and documents are counted over all parts. Lines of a large source are of a cluster
if they are linked to one of those; lines that are all linked to each other are always found whole.

Pairs are left out before their longest common subsequence is measured only by bounds on it: length, bigrams (one more
or less character changes at most three) and characters in common.

Defined results: pages that are null, empty or blank have no lines; documents with a null series have no source; a
page or document given twice counts once; line numbers count every line from 1; an empty table gives no lines.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LETTERS, LEAST_DOCUMENTS, LEAST_SHARE = 15, 4, 0.2
#: A writing that alone stands in this share of what a cluster of a part needs is a candidate too.
REPRESENTATIVE = 0.5
#: The least ratio of the folded lines' longest common subsequence.
NEAR = 0.88
#: Documents of a part of a large source (up to twice as many), pairs that are judged at once, and bits of a word.
PART, PAIRS, WORD = 64, 1 << 18, 64
#: Classes of characters that scans mistake for each other (fixed values); each has at most one digit.
CLASSES = ("il1jt!|f", "oce0aqd", "s5", "nuv", "b8h", "g9y", "z2")


@functools.cache
def folding() -> dict[int, str | None]:
    """Deletes what is no letter, digit or line break; writes the rest by its class."""
    table: dict[int, str | None] = {}
    to = {c: group[0] for group in CLASSES for c in group}
    for code in range(0x3000):
        c = chr(code)
        if c == "\n":
            continue
        base = unicodedata.normalize("NFKD", c)[0]
        if base.isalnum() or c in "!|":
            plain = to.get(base.lower(), base.lower())
            if plain != c:
                table[code] = plain
        elif not unicodedata.combining(c) or code < 0x370:
            table[code] = None
    return table


@functools.cache
def byte_folding() -> tuple[bytes, bytes, str]:
    """The same for the first 256 characters as a byte table, the bytes to delete, and the characters it can't do."""
    table, gone, other = bytearray(range(256)), bytearray(), ""
    for code in range(256):
        to = folding().get(code, chr(code))
        if to is None:
            gone.append(code)
        elif len(to) == 1 and ord(to) < 256:
            table[code] = ord(to)
        else:
            other += chr(code)
    return bytes(table), bytes(gone), other


#: Typographic marks beyond the first 256 characters; folding deletes them.
MARKS = re.compile("[\u2010-\u2015\u2018-\u201f\u2022\u2026\u2032\u2033\u2039\u203a]+")


def fold_text(text: str) -> str:
    """A page's folded text, its line breaks kept."""
    low = text.lower()
    table, gone, other = byte_folding()
    try:
        if any(c in low for c in other):
            raise UnicodeError
        t = (low if low.isascii() else MARKS.sub("", low)).encode("latin-1").translate(table, gone).decode("latin-1")
    except UnicodeError:
        t = low.translate(folding())
    # letters that look like two: after folding, m is n and n is written for r n, w for v v
    return t.replace("rn", "m").replace("nn", "m")


def fold_page(text: str) -> list[str]:
    """The folded lines of a page."""
    return fold_text(text).split("\n")


def key_of(folded: str) -> int:
    return xxhash.xxh64_intdigest(folded) - (1 << 63)


def letters(line: str) -> int:
    return sum(map(str.isalpha, line))


def numbers(line: str) -> list[str]:
    """The numbers of a line with the letters that scans put for digits read back."""
    if not DIGIT.search(line):
        return []
    runs = (w for word in line.split() if DIGIT.search(word) for w in RUN.findall(word))
    read = (w.replace(".", "").replace(",", "").translate(LIKE_DIGITS) for w in runs if DIGIT.search(w))
    return [w for w in read if w.isdigit()]


DIGIT, RUN = re.compile(r"\d"), re.compile(r"[\w.,]+")
LIKE_DIGITS = str.maketrans("lIOoSsB", "1100558")


class Lines:
    """Different folded lines, with what bounds the longest common subsequence of any two; characters count by 32 slots."""

    def __init__(self, folded: list[str]):
        self.folded, n = folded, len(folded)
        self.length = np.array([len(f) for f in folded], dtype=np.int64)
        c = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        line, slot = np.repeat(np.arange(n), self.length), c % 32
        at = np.arange(len(c)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.characters = np.bincount(line * 32 + slot, minlength=32 * n).reshape(n, 32).astype(np.int16)
        # which bigrams a line has, as bits by hash: a bigram more or less changes one bit at most
        there, whole = np.zeros((n, 256), dtype=bool), line[:-1] == line[1:]
        there[line[:-1][whole], (((c[:-1] * 1_000_003 + c[1:]) * 40_503 >> 7) % 256)[whole]] = True
        self.bigrams = np.packbits(there, axis=1).view(np.uint64)
        # the slots of a line's first WORD characters, and where it has each slot, as bits
        short = at < WORD
        self.slots = np.full((n, WORD), 32, dtype=np.uint8)
        self.slots[line[short], at[short]] = slot[short]
        self.where = np.zeros((n, 33), dtype=np.uint64)
        np.bitwise_or.at(self.where, (line[short], slot[short]), np.uint64(1) << at[short].astype(np.uint64))

    def most_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of slots, of lines up to WORD (``names.common`` for all at once)."""
        v = np.full(len(i), ~np.uint64(0))
        for at in range(int(self.length[j].max(initial=0))):
            u = v & self.where[i, self.slots[j, at]]
            v = (v + u) | (v - u)
        return np.bitwise_count(~v).astype(np.int64)

    def linked(self, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        """The pairs that are nearly equal."""
        from fieldlore.llm.names import common

        for i, j in _batches(pairs):
            a, b = self.length[i], self.length[j]
            most = (1 - NEAR) * (a + b) + 1e-9
            keep = np.abs(a - b) <= np.minimum(most, 0.2 * np.maximum(a, b))
            i, j, most = i[keep], j[keep], most[keep]
            keep = np.bitwise_count(self.bigrams[i] ^ self.bigrams[j]).sum(axis=1, dtype=np.int64) <= 3 * most
            i, j, most = i[keep], j[keep], most[keep]
            keep = np.abs(self.characters[i] - self.characters[j]).sum(axis=1) <= most
            i, j, most = i[keep], j[keep], most[keep]
            a, b = self.length[i], self.length[j]
            keep = np.maximum(a, b) > WORD
            short = np.flatnonzero(~keep)
            keep[short] = (a + b)[short] - 2 * self.most_common(i[short], j[short]) <= most[short]
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                if 2 * common(self.folded[x], self.folded[y]) >= NEAR * (len(self.folded[x]) + len(self.folded[y])):
                    yield x, y


def _batches(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of few lines are put together, those of many divided."""
    left, right, n = [], [], 0
    for i, j in pairs:
        for at in range(0, len(i), PAIRS):
            left.append(i[at : at + PAIRS])
            right.append(j[at : at + PAIRS])
            n += len(left[-1])
            if n >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _crossed(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one of the left with one of the right, some rows of them at a time."""
    rows = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        yield np.repeat(part, len(right)), np.tile(right, len(part))


def _within(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different ones, each once."""
    if len(ids) <= 256:
        i, j = _triangle(len(ids))
        yield ids[i], ids[j]
        return
    for i, j in _crossed(ids, ids):
        yield i[i < j], j[i < j]


@functools.cache
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class Part:
    """The lines of some documents of one source by their folded writing: documents, places, and numbers as written.
    Lines with too few letters link others, but have no places."""

    def __init__(self, pdf: pd.DataFrame):
        self.documents: dict[str, set[str]] = {}
        self.places: dict[str, set[tuple[str, str, int]]] = {}
        self.numbers: dict[str, set[tuple[str, ...]]] = {}
        for doc, page, t in set(zip(pdf["doc_id"], pdf["page_id"], pdf["raw_ocr_text"])):
            for n, (f, line) in enumerate(zip(fold_page(t), t.split("\n"))):
                enough = letters(line) >= LEAST_LETTERS
                if not enough and len(f) < LEAST_LETTERS - 2:
                    continue
                if f not in self.numbers:
                    self.documents[f], self.places[f], self.numbers[f] = set(), set(), set()
                self.numbers[f].add(tuple(numbers(line)))
                if enough:
                    self.documents[f].add(doc)
                    self.places[f].add((doc, page, n + 1))


def _by_numbers(written: list[Iterable]) -> dict:
    by = defaultdict(list)
    for n, own in enumerate(written):
        for x in own:
            by[x].append(n)
    return {x: np.array(ids) for x, ids in by.items()}


def _clusters(folded: list[str], written: list[Iterable]) -> tuple[list[list[int]], dict[int, set[int]]]:
    """Clusters of linked lines, and the lines that each is linked to."""
    near: dict[int, set[int]] = defaultdict(set)
    root = list(range(len(folded)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    blocks = [ids for ids in _by_numbers(written).values() if len(ids) > 1]
    for x, y in Lines(folded).linked(pair for ids in blocks for pair in _within(ids)):
        near[x].add(y)
        near[y].add(x)
        a, b = sorted((find(x), find(y)))
        root[b] = a
    out = defaultdict(list)
    for n in range(len(folded)):
        out[find(n)].append(n)
    return list(out.values()), near


def _cover(cluster: list[int], near: dict[int, set[int]], weight: list[int]) -> list[int]:
    """Lines of a cluster that all the others are linked to, the most frequent first."""
    left, out = set(cluster), []
    for n in sorted(cluster, key=lambda n: (-weight[n], -len(near[n]), n)):
        if n in left:
            out.append(n)
            left -= near[n] | {n}
    return out


#: Rows of a part: the lines of a source that is one part, or the candidates (folded, numbers) of a larger one.
FOUND = "series string, page_id string, line_no int, cluster bigint, documents bigint, folded string, numbers string"


def _found(pdf: pd.DataFrame) -> pd.DataFrame:
    part = Part(pdf)
    folded, rows = sorted(part.numbers), []
    written = [part.numbers[f] for f in folded]
    series, whole, size = pdf["series"].iloc[0], pdf["parts"].iloc[0] == 1, int(pdf["of_part"].iloc[0])
    clusters, near = _clusters(folded, written)
    least = math.ceil(LEAST_SHARE * size - 1e-9)
    weight = [len(part.documents[f]) for f in folded]
    chosen = set()
    for cluster in clusters:
        documents = len(set().union(*(part.documents[folded[n]] for n in cluster)))
        if whole and documents >= max(LEAST_DOCUMENTS, least):
            first = min(key_of(folded[n]) for n in cluster)
            rows += [(series, page, line, first, documents, None, None) for n in cluster for _, page, line in part.places[folded[n]]]
        elif not whole and documents >= least:
            chosen.update(_cover(cluster, near, weight))
    if not whole:
        chosen.update(n for n, w in enumerate(weight) if w > 1 and w >= REPRESENTATIVE * LEAST_SHARE * size)
    rows += [(series, None, None, None, None, folded[n], " ".join(x)) for n in sorted(chosen) for x in sorted(written[n])]
    return pd.DataFrame(rows, columns=["series", "page_id", "line_no", "cluster", "documents", "folded", "numbers"])


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of all parts of a source, linked ones with one cluster."""
    written: dict[str, set[str]] = defaultdict(set)
    for f, x in zip(pdf["folded"], pdf["numbers"]):
        written[f].add(x)
    folded, rows = sorted(written), []
    for cluster in _clusters(folded, [written[f] for f in folded])[0]:
        first = min(key_of(folded[n]) for n in cluster)
        rows += [(folded[n], x, first) for n in cluster for x in sorted(written[folded[n]])]
    out = pd.DataFrame(rows, columns=["folded", "numbers", "cluster"])
    out.insert(0, "series", pdf["series"].iloc[0])
    return out


def _met(pdf: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """The lines of a part that are, or are linked to, a candidate of their source."""
    rows = set()
    if len(pdf) and len(candidates):
        part, cluster = Part(pdf), dict(zip(candidates["folded"], candidates["cluster"]))
        known: dict[str, set[str]] = defaultdict(set)
        for f, x in zip(candidates["folded"], candidates["numbers"]):
            known[f].add(x)
        folded, others = sorted(f for f in part.numbers if part.places[f]), sorted(known)
        own, theirs = (_by_numbers(x) for x in ([{" ".join(x) for x in part.numbers[f]} for f in folded], [known[f] for f in others]))
        pairs = (pair for x in own.keys() & theirs.keys() for pair in _crossed(own[x], theirs[x] + len(folded)))
        hits = {(folded[i], others[j - len(folded)]) for i, j in Lines(folded + others).linked(pairs)} | {(f, f) for f in folded if f in known}
        rows = {(doc, page, line, cluster[other]) for f, other in hits for doc, page, line in part.places[f]}
    out = pd.DataFrame(sorted(rows), columns=["doc_id", "page_id", "line_no", "cluster"])
    out.insert(0, "series", pdf["series"].iloc[0] if len(pdf) else None)
    return out


def repeated_lines(pages: DataFrame, records: DataFrame) -> DataFrame:
    """page_id, line_no, series, cluster, documents of every line that a large part of its source's documents repeat."""
    from fieldlore.session import cut, small_or_plain

    read = pages.where("raw_ocr_text IS NOT NULL AND doc_id IS NOT NULL AND page_id IS NOT NULL").select("doc_id", "page_id", "raw_ocr_text")
    sources = records.where("series IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("series").alias("series"))
    sizes = sources.groupBy("series").agg(F.count("doc_id").alias("size")).withColumn("parts", F.greatest(F.lit(1), F.floor(F.col("size") / PART)).cast("int"))
    placed = cut(sources.join(sizes, "series").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    of_part = placed.groupBy("series", "part").agg(F.count("doc_id").alias("of_part"))
    texts = read.join(placed.join(of_part, ["series", "part"]), "doc_id")
    found = cut(texts.groupBy("series", "part").applyInPandas(_found, FOUND))
    candidates = cut(found.where("folded IS NOT NULL").select("series", "folded", "numbers").distinct().groupBy("series").applyInPandas(_candidates, "series string, folded string, numbers string, cluster bigint"))
    large = placed.join(candidates.select("series").distinct(), "series", "left_semi")
    for_parts = candidates.join(sizes, "series").select(*candidates.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = read.join(small_or_plain(large), "doc_id").select("doc_id", "page_id", "raw_ocr_text", "series", "part").groupBy("series", "part").cogroup(for_parts.groupBy("series", "part")).applyInPandas(_met, "series string, doc_id string, page_id string, line_no int, cluster bigint")
    lines = cut(met)
    enough = lines.groupBy("series", "cluster").agg(F.count_distinct("doc_id").alias("documents")).join(sizes.select("series", "size"), "series").where((F.col("documents") >= LEAST_DOCUMENTS) & (F.col("documents") >= LEAST_SHARE * F.col("size") - 1e-9)).select("series", "cluster", "documents")
    across = lines.join(enough, ["series", "cluster"]).select("page_id", "line_no", "series", "cluster", "documents")
    return found.where("page_id IS NOT NULL").select(*across.columns).union(across)


def without_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id and text: every page once, without the given lines (page_id, line_no)."""
    gone = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    once = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("raw_ocr_text").alias("raw_ocr_text"))
    split = once.join(gone, "page_id", "left").withColumn("rows", F.transform(F.split("raw_ocr_text", "\n"), lambda line, i: F.struct((i + 1).alias("n"), line.alias("line"))))
    kept = F.filter("rows", lambda r: F.col("gone").isNull() | ~F.array_contains("gone", r["n"]))
    return split.select("page_id", F.array_join(F.transform(kept, lambda r: r["line"]), "\n").alias("text"))
