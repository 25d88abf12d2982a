"""Decontamination against a plain search of every window in every text."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from siteloom.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(documents, items, window=10):
    wanted = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            wanted.setdefault(tuple(own[i:i + size]), set()).add(None if item is None else str(item))
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in documents:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if got := wanted.get(tuple(own[i:i + size])):
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc, len(own), len(hit), tuple(sorted(found - {None}))))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=str)


def test_edge_rows_and_short_items(spark):
    rng = random.Random(3)
    vocabulary = ["ab", "Cd", "été", "x1", "y", "zz", "q"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([9, 10, 11, 12, 30]))) for i in range(20)]
    items += [(100, "lonely"), (101, "two Words"), (102, None), (103, " .,! "), (104, items[0][1]), (0, items[1][1]),
              (None, "nameless item")]
    documents = [(i, say(rng.randrange(60))) for i in range(80)]
    documents += [(200, None), (201, ""), (202, "so LONELY two-words here lonely"), (203, say(5000) + " " + items[2][1]),
                  (204, items[3][1] + ", " + items[3][1]), (204, items[3][1] + ", " + items[3][1]), (204, "other"),
                  (None, "a nameless item"), (None, None)]
    docs = spark.createDataFrame([(*d, "clash", 1) for d in documents], "doc_id long, text string, found string, n_hit int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, hash int")
    assert ours(decontaminate.contamination(docs, bench)) == brute(documents, items)


def test_tied_minima_and_repeats(spark):
    items = [(1, "a a a a a a a a a a a a"), (2, "a b a b a b a b a b a b")]
    documents = [(1, "a " * 9), (2, "a " * 10), (3, "b a " * 30), (4, "x " + "a b " * 5 + "x")]
    assert ours(decontaminate.contamination(spark.createDataFrame(documents, "doc_id long, text string"),
                                            spark.createDataFrame(items, "item_id long, text string"))) == brute(documents, items)


@pytest.mark.parametrize("documents,items", [([], [(1, "some words")]), ([(1, "some words")], [])])
def test_empty_tables(spark, documents, items):
    found = decontaminate.contamination(spark.createDataFrame(documents, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"))
    assert ours(found) == brute(documents, items)


def test_query_on_given_tables(spark):
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
            for r in queries.QUERIES["op2_decontaminate"](spark, SF).collect()}
    load = lambda name, key: [(r[key], r["text"]) for r in pq.read_table(f"{SF}/{name}.parquet").to_pylist()]
    expected = brute(load("documents", "doc_id"), load("benchmark", "item_id"))
    assert rows == {(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in expected}
    assert any(r[2] for r in rows)
