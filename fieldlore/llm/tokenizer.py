"""Exact ids of a public byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one valid encoding, and its last token is the only vocabulary entry that ends there and
stands beside the last token of the prefix before it. An Aho-Corasick automaton (the suffix links of all entries)
lists the entries that end at each place; a compatibility test on two neighbouring tokens, which undoes their merges
from the youngest on, tells whether a merge would have crossed their border. The last tokens are stored for every
prefix, and following them back from the end gives the ids.

Defined results: null and empty text have no ids (an empty list, never null); a lone surrogate is read as U+FFFD.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

#: The split of the public vocabulary into pieces (fixed value of the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; when it is full it starts anew.
REMEMBERED = 200_000


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PrefixEncoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        if (found := self.halves.get(token)) is None:
            whole = self.tokens[token]
            parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(parts) > 2:
                rank, at = min((self.merged(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at : at + 2] = [rank]
            found = self.halves[token] = (parts[0], parts[1])
        return found

    def merged(self, left: int, right: int) -> float:
        return self.ranks.get(self.tokens[left] + self.tokens[right], float("inf"))

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens."""
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        a, b, limit = left, right, float("inf")
        while True:
            if self.merged(a, b) < limit:
                return False
            if a > b and len(self.tokens[a]) > 1:
                # the left one was made later: before that its second half stood at the border
                limit = a
                a = self.split(a)[1]
            elif len(self.tokens[b]) > 1:
                # a merge across the border as old as b starts further left and so comes first
                limit = b + 1
                b = self.split(b)[0]
            elif len(self.tokens[a]) > 1:
                limit = a
                a = self.split(a)[1]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        if (found := self.known.get(text)) is not None:
            return found
        raw = text.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None and (len(raw) < 2 or self._makes(whole)):
            ids = [whole]
        else:
            last, ends = [-1] * (len(raw) + 1), [[] for _ in raw]
            for end, hit in self.automaton.iter(raw.decode("latin-1")):
                ends[end].append(hit)
            for end, hits in enumerate(ends):
                for size, rank in sorted(hits, reverse=True):
                    start = end + 1 - size
                    if (start == 0 and (size == 1 or self._makes(rank))) or (start and last[start] >= 0 and self.compatible(last[start], rank)):
                        last[end + 1] = rank
                        break
            ids, at = [], len(raw)
            while at:
                ids.append(last[at])
                at -= len(self.tokens[last[at]])
            ids.reverse()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(text) <= 64:
            self.known[text] = ids
        return ids

    def _makes(self, rank: int) -> bool:
        """Whether merging the bytes of an entry gives the entry itself."""
        left, right = self.split(rank)
        return self.merged(left, right) == rank and self.compatible_parts(left, right)

    def compatible_parts(self, left: int, right: int) -> bool:
        return (len(self.tokens[left]) == 1 or self._makes(left)) and (len(self.tokens[right]) == 1 or self._makes(right))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for piece in self.find(text):
            out.extend(self.piece(piece))
        return out


@functools.lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every row."""
    path = path or default_path()

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "ids": [e.encode(t if isinstance(t, str) else None) for t in b["text"]]})

    plain = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return plain.mapInPandas(kernel, f"key {plain.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)
