"""Ids against the tokenizer itself, plans against the least possible, places against gaps."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siteloom.llm import packing as P
from siteloom.llm import queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(P.TOKENIZER)
ODD = ["a", "B", "é", "É", "ß", "×", "÷", "ÿ", "1", "2", "'", "s", " ", "\n", "<|endoftext|>", "<", "|>", "日本", "é", "́", " ", "İ",
       ".", "!!", "-", "²", "ª", "Σ", "\x00", "\x1f", "\x7f", "don't", "😀", "\r", "\x0b", "\x85", " "]


def encoded(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


TOKENIZER = P.tokenizer_at(PATH)


@pytest.mark.parametrize("known", [50, 10 ** 6])
def test_ids_equal_the_tokenizer(monkeypatch, known):
    monkeypatch.setattr(P, "KNOWN", known)
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(1500)] + [None, "", "x" * 3000]
    texts += [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got, at = [], 0
    for rows, flat, begin in P.token_ids(pa.array(texts), P.Tokens(TOKENIZER)):
        got += [flat[begin[i]:begin[i + 1]].tolist() + [0] for i in range(rows)]
        at += rows
    assert at == len(texts) and got == [encoded(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.choice([16, 100, 2048]))
    lengths = np.minimum(rng.geometric(3 / limit, size=int(rng.choice([1, 40, 20000]))), limit)
    histogram = np.bincount(lengths, minlength=limit + 1)
    plan = P.plan(histogram, limit)
    used = np.zeros(limit + 1, dtype=int)
    for own, count in plan.groups:
        assert 0 < sum(own) <= limit and count > 0
        for n in own:
            used[n] += count
    assert (used == histogram).all()
    plain = sum(n for _, n in P.best_fit(histogram, limit))
    least = -(-int(lengths.sum()) // limit)
    assert least <= plan.sequences <= max(plain + 1, int(least * 1.002))
    assert P.plan(np.zeros(limit + 1, dtype=int), limit).sequences == 0


def test_fit_repeats_known_patterns():
    rows = P.patterns(10, np.ones(11, dtype=bool), step=1)
    histogram = np.zeros(11, dtype=int)
    histogram[[3, 7]] = 50
    counts = P.fitted(rows, histogram)
    assert abs(counts[[tuple(r) == (3, 7, 0) for r in rows.tolist()].index(True)] - 50) < 1


def checked(rows, documents, limit):
    """Rows hold every piece of every document once, and places without gaps."""
    expected = []
    for doc, text in documents:
        ids = encoded(text)
        for piece, start in enumerate(range(0, len(ids), limit)):
            part = ids[start:start + limit]
            expected.append((doc, piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return len(sequences), sum(e[3] for e in expected)


def test_edge_rows(spark):
    documents = [(1, None), (2, ""), (3, "word " * 300), (3, "word " * 300), (4, "one"), (None, "one"), (None, None), (5, "a b c " * 99)]
    documents += [(10 + i, "x " * (i % 23)) for i in range(200)]
    df = spark.createDataFrame([(*d, "clash", 5) for d in documents], "doc_id long, text string, ids string, length int")
    rows = P.packed(df, PATH, limit=64).collect()
    used, total = checked(rows, documents, 64)
    assert used <= total / 64 * 1.02 + 2
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert P.packed(df.limit(0), PATH).count() == 0


def test_query_on_given_tables(spark):
    documents = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    used, total = checked(queries.QUERIES["op8_best_fit_packing"](spark, SF).collect(), documents, P.LIMIT)
    assert used <= -(-total // P.LIMIT) + 2
