import base64
import random

import pytest

from fieldlore.llm import tokenizer

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    path = tokenizer.default_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tokenizer.PrefixEncoder(path), tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(both):
    mine, library = both
    rng = random.Random(7)
    texts = ["", " ", "\n\n  \t x", "a" * 3000, "don't DON'T", "naïve 中文文本 ไทย हिंदी 🙂🙂", "<|endoftext|>", "ab" * 900, "0123456789" * 50, "\x00\x01"]
    texts += ["".join(rng.choice("abcdeéñ中 's1.\n\tÅthe ing🙂") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    for t in texts:
        assert mine.encode(t) == library.encode_ordinary(t), t
        assert b"".join(mine.tokens[i] for i in mine.encode(t)).decode() == t


def test_compatibility_is_that_of_the_joined_bytes(both):
    mine, library = both
    rng = random.Random(9)
    words = library.encode_ordinary("the gauge at the lower marsh stood at seventeen feet and fell during unseasonable weather") + list(range(250, 400))
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        joined = mine.tokens[a] + mine.tokens[b]
        assert mine.compatible(a, b) == (library._encode_single_piece(joined) == [a, b])


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the the", "x"), (3, "the the", "x")], "doc_id bigint, text string, ids string")
    out = tokenizer.encode(df).collect()
    assert [(r.doc_id, len(r.ids)) for r in sorted(out, key=lambda r: r.doc_id)] == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokenizer.encode(df.limit(0)).count() == 0
