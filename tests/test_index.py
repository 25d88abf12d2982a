"""Index build: splitting, merging, vectors."""

import hashlib
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.operators import index as I

LENGTHS = [0, 1, 500, 501, 2000, 2001, 3500, 3501, 9000]


def texts(spark, values):
    return spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(values)], "parent_id string, content string")


def by_parent(df):
    out = {}
    for r in df.orderBy("parent_id", "ord").collect():
        out.setdefault(r.parent_id, []).append(r.chunk)
    return out


def test_windows_rebuild_the_text(spark):
    letters = random.Random(1)
    values = ["".join(letters.choice("abc ") for _ in range(n)) for n in LENGTHS]
    found = by_parent(I.chunk_text(texts(spark, values)))
    for i, text in enumerate(values):
        chunks = found[f"p{i}"]
        assert len(chunks) == max(-(-(len(text) - 500) // 1500), 1)
        assert chunks[0] + "".join(c[500:] for c in chunks[1:]) == text
        assert all(len(c) <= 2000 for c in chunks)
    assert "p0" not in by_parent(I.nonempty(I.chunk_text(texts(spark, values))))


def test_sentence_windows_end_at_sentences(spark):
    letters = random.Random(2)
    text = "".join(letters.choice("abcdefghi .") for _ in range(20000))
    plain = "x" * 7000
    found = by_parent(I.chunk_text(texts(spark, [text, plain, ""]), boundary=True))
    for name, whole in (("p0", text), ("p1", plain)):
        chunks = found[name]
        assert chunks[0] + "".join(c[500:] for c in chunks[1:]) == whole and max(map(len, chunks)) <= 2000
    assert all(c.endswith(".") for c in found["p0"][:-1]) and found["p2"] == [""]


def test_merge_equals_a_plain_splice(spark):
    docs = texts(spark, ["hello world", "abc", "none", "", "edge"])
    inserts = [("p0", 5, 0, "A"), ("p0", 5, 1, "B"), ("p0", 0, 0, "C"), ("p1", 3, 0, "T"), ("p3", 0, 0, "only"),
               ("p4", 99, 0, "far"), ("gone", 0, 0, "x")]
    ocr = spark.createDataFrame(inserts, "parent_id string, content_offset long, ord int, text string")
    found = {r.parent_id: r.content for r in I.merge_inserts(docs, ocr).collect()}

    def splice(text, items):
        for offset, _, item in sorted(items, reverse=True):
            text = text[:offset] + f" {item} " + text[offset:]
        return text

    for r in docs.collect():
        assert found[r.parent_id] == splice(r.content, [i[1:] for i in inserts if i[0] == r.parent_id])


def test_hashed_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", "..."), ("c", None)], "id string, chunk string")
    rows = {r.id: r.vector for r in I.embed_hash(df, dim=64).collect()}
    assert sum(x * x for x in rows["a"]) == pytest.approx(1, abs=1e-6)
    assert rows["b"] == [0.0] * 64 and rows["c"] == [0.0] * 64


def test_user_vectors_of_wrong_size_become_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, vector array<float>")
    rows = {r.id: r.vector for r in I.embed_column(df, vectors, 2).collect()}
    assert rows == {"a": [1.0, 2.0], "b": None, "c": None}


def test_a_failing_text_loses_only_itself(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if texts.str.startswith("bad").any():
            raise KeyError("bad text")
        return [[float(len(t)), 1.0] for t in texts]
    texts = pd.Series([f"good {i}" for i in range(1000)])
    texts[[3, 700]] = "bad"
    made = I._isolated(model, texts)
    assert made.index[made["error"].notna()].tolist() == [3, 700] == made.index[made["vector"].isna()].tolist()
    assert made["error"][3] == "KeyError: 'bad text'" and made["vector"][4].tolist() == [6.0, 1.0]
    assert len(calls) <= 1 + 2 * 2 * 10
    short = I._isolated(lambda t: [[0.0]], pd.Series(["a", "b"]))
    assert short["error"].isna().all()
    assert I._isolated(lambda t: [], pd.Series(["a"]))["error"].tolist() == ["ValueError: 0 vectors for 1 texts"]
    assert I._isolated(model, pd.Series([], dtype=object)).empty

    def picky(texts):
        if texts.isna().any() or (texts == "").any():
            raise ValueError("nothing to read")
        return [[float(len(t))] for t in texts]
    df = spark.createDataFrame([(1, "ab", "x"), (2, None, "x"), (3, "", "x"), (4, "abcd", "x")], "id int, chunk string, error string")
    rows = I.embed_tolerant(df.drop("error"), picky).orderBy("id").collect()
    assert [(r["id"], r["vector"], r["error"]) for r in rows] == [
        (1, [2.0], None), (2, None, "ValueError: nothing to read"), (3, None, "ValueError: nothing to read"), (4, [4.0], None)]


def test_postings_move_passages_once(spark):
    df = spark.createDataFrame([("a", "x y x", "t", "en", "s", "doc")],
                               "id string, chunk string, title string, language string, section string, kind string")
    plan = I.postings(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = I.postings(df).filter(F.col("field") == "chunk").select("term", "tf", "dl").collect()
    assert sorted(map(tuple, rows)) == [("x", 2, 3), ("y", 1, 3)]


def plain_words(text):
    found, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            found, word = [*found, word], ""
    return found


def test_words_are_hashed_once_per_batch_and_not_in_the_plan(spark):
    values = random.Random(4)
    rows = [(i, "".join(values.choice("ab ÉÑ.9\u0644\n") for _ in range(values.randint(0, 60)))) for i in range(300)] + [(300, None)]
    found = I.embed_hash(spark.createDataFrame(rows, "i int, chunk string"), dim=16)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        sums = [0] * 16
        for word in plain_words(r.chunk):
            digest = hashlib.md5(word.encode()).hexdigest()
            sums[int(digest[:8], 16) % 16] += -1 if digest[8] >= "8" else 1
        norm = sum(x * x for x in sums) ** 0.5 or 1.0
        assert r.vector == pytest.approx([x / norm for x in sums], abs=1e-6)


@pytest.mark.parametrize("rows_at_once", [1, 7, 1000])
def test_postings_are_counted_without_a_table_of_all_terms(spark, monkeypatch, rows_at_once):
    """Keys may repeat and be null, in one batch or across several; rows of one key and field length count together."""
    monkeypatch.setattr(I, "POSTING_ROWS", rows_at_once)
    values = random.Random(5)
    rows = [(values.choice(["a", "b", "c_1", None, ""]), values.choice(["x y x", " x, y ", "", "z", None, "É é"]),
             values.choice(["t", "", None, "x y"]), values.choice(["en", None]), "s", values.choice(["doc", "page"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "id string, chunk string, title string, language string, section string, kind string")
    wanted = Counter()
    for name, chunk, title, *rest in rows:
        for field, found in (("chunk", plain_words(chunk)), ("title", plain_words(title)), ("id", [] if name is None else [name])):
            for word in found:
                wanted[name, *rest, field, len(found), word] += 1
    made = I.postings(df)
    assert made.columns == ["id", "language", "section", "kind", "field", "dl", "term", "tf"]
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = [tuple(r) for r in made.collect()]
    assert sorted(map(str, found)) == sorted(str((*k, n)) for k, n in wanted.items())
    ordered = df.orderBy(*I.POSTING_KEYS).select(*I.POSTING_KEYS, X.words("chunk").alias("_chunk"), X.words("title").alias("_title"),
                                                 F.when(F.col("id").isNotNull(), F.array("id")).alias("_id")).toArrow()
    here = [tuple(r.values()) for b in I._counted(iter(ordered.to_batches())) for r in b.to_pylist()]
    assert sorted(map(str, here)) == sorted(str((*k, n)) for k, n in wanted.items())
    assert I.postings(df.limit(0)).collect() == []
