"""Statistics against plain Python, trees against a node-by-node walk, verdicts on held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siteloom.llm import quality_trees as Q
from siteloom.llm import queries

TEXTS = [None, "", " \n ", "a", "a b a b a b", "Été à 12% !!", "x\nx\n\n y.", "日本 語", "##a b$$ |c|", "w " * 5000 + "end."]


def plain(text):
    data = (text or "").encode()
    words = re.findall(rb"[^ \t-\r]+", data)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t-\r]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    letters = sum(map(len, words))
    share = lambda a, b: a / max(b, 1)
    count = lambda chars: sum(b in chars for b in data)
    symbols, marks = b"#*$%&<>@^~=+_{}[]\\", b".,;:!?'\"()-"
    p = np.array(list(Counter(data).values())) / max(len(data), 1)
    return [len(words), len(lines), share(letters, len(words)), max(map(len, words), default=0), share(len(set(words)), len(words)),
            share(max(Counter(words).values(), default=0), len(words)), share(sum(grams.values()) - len(grams), sum(grams.values())),
            share(len(lines) - len(set(lines)), len(lines)), share(len(words), len(lines)), share(sum(65 <= b < 91 for b in data), letters),
            share(sum(48 <= b < 58 for b in data), letters), share(count(marks), letters), share(count(symbols), letters),
            share(count(b"|"), letters), share(len(data) - letters, len(data)), share(sum(b >= 128 for b in data), letters),
            share(sum(any(b in symbols for b in w) for w in words), len(words)),
            share(sum(a == b and b in symbols + marks for a, b in zip(data, data[1:])), letters),  # noqa: RUF007
            share(sum(x[-1] in b".!?\"')" for x in lines), len(lines)), float(-(p * np.log2(p)).sum()) if len(p) else 0.0]


def test_statistics_equal_plain_python():
    found = np.concatenate(list(Q.statistics(pa.array(TEXTS))))
    assert found.shape == (len(TEXTS), len(Q.STATISTICS))
    np.testing.assert_allclose(found, np.array([plain(t) for t in TEXTS]), atol=1e-9)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(900, 5)).round(2)
    return rows, ((rows[:, 1] > 0.2) ^ (rows[:, 3] > 0)).astype(float)


def test_flat_trees_equal_a_walk(made):
    rows, label = made
    trees = Q.fit(rows, label, trees=15)
    for x, score in zip(rows[:50], trees.score(rows[:50]), strict=True):
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_trees_learn_what_one_cut_cannot(made):
    rows, label = made
    trees = Q.fit(rows[:600], label[:600])
    assert ((trees.score(rows[600:]) > 0.5) == label[600:]).mean() > 0.95


def test_leaf_values_are_those_of_the_bins(made):
    rows, label = made
    cuts = [Q.cuts_of(rows[:, f], 16) for f in range(5)]
    binned = np.column_stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)])
    feature, cut, value, leaf = Q.grow(binned, cuts, label - 0.5, np.full(len(label), 0.25), 3)
    walked = Q.Trees(0.0, feature[None], cut[None], np.arange(8.0)[None])
    p = walked.score(rows)
    np.testing.assert_allclose(np.log(p / (1 - p)).round(), leaf)


def test_held_out_rows_of_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op13_quality_trees"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((rows["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)) == rows["held_out"]).all()
    unseen = rows[rows["held_out"]]
    assert len(unseen) > 500 and (unseen["predicted"] == unseen["quality"]).mean() > 0.98
    assert unseen[unseen["quality"] == 1]["predicted"].mean() > 0.99


def test_only_the_text_counts_and_odd_rows_are_scored(spark):
    docs = [(None, "a b", "x", 9.0, 1), (1, None, None, None, None), (2, "", "x", 1.0, 0), (2, "", "y", 2.0, 1), (3, "good words here.", "x", 0.0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double, quality int")
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    rows = Q.scored(df, Q.train(df, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert rows[2]["score"] == rows[3]["score"]
    none = Q.train(df.limit(0), labels)
    assert Q.scored(df.limit(0), none).count() == 0 and {r["score"] for r in Q.scored(df, none).collect()} == {0.5}
    one = Q.train(df, spark.createDataFrame([(1, 1), (3, 1), (4, 1)], "doc_id long, quality int"))
    assert all(r["score"] > 0.99 for r in Q.scored(df, one).collect())
