"""Counts against plain Python, and the learned list on held-out and made cases."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from siteloom.llm import quality_rules as Q
from siteloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    n, repeat = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, repeat, n < 50 or 100 * repeat > 50 * n)


TEXTS = [None, "", " \n\t ", "a\n\na\n \n \na ", "été <b> & | 日本 x\x0by\x85z", "a b c a b c a", "x\ny\nx\ny\n" * 300,
         "word " * 3000 + "end", "one " * 2, "a b " * 25, "q r s"]


def test_counts_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, kept string")
    rows = Q.judged(docs, []).select("doc.doc_id", *Q.COUNTS[:5], "base_failed", "kept").collect()
    assert sorted(tuple(r)[:7] for r in rows) == [(i, *brute(t)) for i, t in enumerate(TEXTS)]
    assert all(r["kept"] is not r["base_failed"] for r in rows)


def test_query_on_given_tables(spark):
    rows = queries.QUERIES["op5_quality_rules"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {d: brute(t) for d, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_rules_are_accurate_on_unseen_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.train(docs, labels.filter("doc_id % 2 = 0"))
    assert rules
    rows = Q.judged(docs, rules).selectExpr("doc.doc_id", "rule > 0 or base_failed low", "rule").join(
        labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    wrong = [r for r in rows if r["rule"] and r["quality"] == 1]
    missed = [r for r in rows if not r["low"] and r["quality"] == 0]
    assert len(wrong) <= 0.02 * len(rows) and len(missed) <= 0.02 * len(rows)


def test_two_rules_and_a_noise_feature():
    rng = np.random.default_rng(1)
    values = {"words": rng.random(3000), "upper_share": rng.random(3000), "digit_share": rng.random(3000)}
    low = (values["words"] > 0.9) | ((values["upper_share"] < 0.2) & (values["digit_share"] > 0.5))
    rules = Q.learn(values, low)
    hit = np.any([Q.covers(r, values, 3000) for r in rules], axis=0)
    assert (hit == low).mean() > 0.98 and len(rules) >= 2


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 0, 0), (1, None, 1)], [(1, 0, 0), (2, 0, 0)]])
def test_no_rules_without_both_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "x " * 60)], "doc_id long, text string")
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert Q.train(docs, own) == []
    assert [r["doc_id"] for r in Q.filtered(docs.union(docs.limit(0)), own).collect()] == []


def test_clean_rows_stay_with_their_columns(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, 3), (1, text, 3), (2, "", 4)], "doc_id long, text string, rule int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = Q.filtered(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, 3)] * 2


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judged(docs, Q.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))).count() == 0
