"""Words, hashes and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siteloom.llm import kernel as K
from siteloom.llm.components import components

PATTERNS = [(K.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (K.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


@pytest.mark.parametrize("inside,pattern", PATTERNS)
@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_words_and_grams_at_any_block_size(monkeypatch, inside, pattern, block):
    monkeypatch.setattr(K.blocks, "__defaults__", (block,))
    rng = random.Random(block)
    parts = ["a", "Bc", "é", "日本", " ", "\n", ".", "\x00", "\x85", "x" * 40, "9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "tail"]
    seen, grams = {}, {}
    for lo, hi, data, offsets in K.groups(pa.array(texts), max_bytes=500, max_rows=9):
        assert hi - lo <= 9
        words = K.words_of(data, offsets, inside, lower=True)
        hashed, first = K.grams(words, 3)
        for d in range(hi - lo):
            expected = re.findall(pattern, lower(texts[lo + d] or ""))
            mine = np.flatnonzero(words.doc == d)
            assert [lower(bytes(data[words.start[i]:words.end[i]]).decode()) for i in mine] == expected
            for w, i in zip(expected, mine, strict=True):
                assert seen.setdefault(w, words.hash[i]) == words.hash[i]
            own = hashed[words.doc[first] == d]
            assert len(own) == max(len(expected) - 2, 0)
            for i, h in enumerate(own):
                assert grams.setdefault(tuple(expected[i:i + 3]), h) == h
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def test_whole_equals_the_gram_of_its_length():
    for _, _, data, offsets in K.groups(pa.array(["a b c", "a b", "a b c d"])):
        words = K.words_of(data, offsets, K.NOT_SPACE, lower=True)
        assert K.whole(words, np.array([0]))[0] == K.grams(words, 3)[0][0] == K.grams(words, 3)[0][1]
        assert K.whole(words, np.array([1]))[0] != K.whole(words, np.array([0]))[0]


def test_bitmap_misses_no_member(spark):
    from siteloom.llm.tables import bitmap_of

    values = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, 123456789]
    held = bitmap_of(spark.createDataFrame([(v,) for v in [*values, None]], "h long"), "h", 1 << 10)
    asked = np.array(values, dtype=np.int64).view(np.uint64)
    assert held.has(asked).all() and not held.has(asked + np.uint64(77)).any()


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(200, 220)] + [(1, 2), (2, 3), (3, 1), (7, 7), (None, 4)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 100 for i in range(100, 131)} | {i: 5 for i in [5, *range(200, 220)]} | {1: 1, 2: 1, 3: 1, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
