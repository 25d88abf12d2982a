"""Components against all pairs in plain Python."""

import random
import re

import pyarrow.parquet as pq
import pytest

from siteloom.llm import jaccard_join as J
from siteloom.llm import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(5)], strict=False))


def brute(documents):
    sets = [shingles(t) for _, t in documents]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        near = set()
        for x in s:
            near.update(where.setdefault(x, []))
            where[x].append(i)
        for j in near:
            common = len(s & sets[j])
            if common * 100 >= 80 * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                if a != b:
                    parent[b] = a
    least = {}
    for i, (d, _) in enumerate(documents):
        least.setdefault(find(i), []).append(d)
    name = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    return sorted(((d, len(sets[i]), d if not sets[i] else name(i)) for i, (d, _) in enumerate(documents)), key=str)


def ours(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(rng):
    word = lambda: "w" + str(rng.randrange(4000))
    common = [word() for _ in range(30)]
    documents, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 20, 60, 200]))]
        if rng.random() < 0.4:
            base = common + base
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[:max(1, int(len(own) * rng.uniform(0.75, 1)))]
            documents.append((n * 7919 % 100003, " ".join(own)))
            n += 1
    return documents


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_chains_and_common_passages(spark, seed):
    documents = corpus(random.Random(seed))
    df = spark.createDataFrame([(*d, 1) for d in documents], "doc_id long, text string, node int")
    assert ours(J.similar_components(df)) == brute(documents)


def test_hot_near_copies_with_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(J, "FLOOR", 2)
    monkeypatch.setattr(J, "SALTS", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    documents = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{i}"
        documents.append((1000 - i, " ".join(own)))
    documents += [(2000 + i, " ".join(base[:40] + [f"y{i}-{j}" for j in range(10)])) for i in range(30)]
    assert ours(J.similar_components(spark.createDataFrame(documents, "doc_id long, text string"))) == brute(documents)


def test_blocks_of_long_lists(spark):
    rng = random.Random(4)
    placed = [(t, node, 100, 0, node % 5 if t else 7) for t in range(4) for node in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(placed, "token long, node long, n int, pos int, root long")
    lists = {}
    for t, node, _, _, root in placed:
        lists.setdefault(t, []).append((node, root))
    wanted = {(min(a, b), max(a, b)) for l in lists.values() for a, x in l for b, y in l if x != y}
    for block in (7, 60, 1000):
        found = [tuple(r) for r in J.across_components(df, 80, block).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_edge_rows(spark):
    documents = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"), (8, "A B C D E"),
                 (8, "A B C D E"), (8, "other text of six words here"), (None, "a b c d e"), (None, "only this nameless row is so"),
                 (9, "q " * 30000), (10, "Q Q Q Q Q q"), (None, None)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert ours(J.similar_components(df)) == brute(documents)
    assert ours(J.similar_components(df.limit(0))) == []


def test_query_on_given_tables(spark):
    documents = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert ours(queries.QUERIES["op10_jaccard_join"](spark, SF)) == brute(documents)
