"""Chunk removal against a plain count of equal chunks, and planted passages."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from siteloom.llm import kernel as K
from siteloom.llm import line_chunks as L
from siteloom.llm import queries

SF = "/root/testdata/sf0.001"


def cut(text):
    """(start, end, stop) of each removable chunk of one text, in bytes."""
    for _, _, data, offsets in K.groups(pa.array([text or ""])):
        c = L.chunks(data, offsets)
        return [tuple(int(v) for v in x) for x in zip(c["start"], c["end"], c["stop"], strict=True)]


def all_runs(text):
    """(first line, last line) of the chunks, and of every shortest run of 16 words onwards and back, by trying all."""
    raw = (text or "").encode()
    lines, at = [], 0
    for piece in raw.split(b"\n"):
        if piece:
            lines.append((at, at + len(piece)))
        at += len(piece) + 1
    words = [len(re.findall(rb"[^ \t-\r]+", raw[a:b])) for a, b in lines]
    found = {(i, j) for i in range(len(lines)) for j in range(i, min(i + 20, len(lines))) if sum(words[i:j + 1]) >= 16
             and (sum(words[i:j]) < 16 or sum(words[i + 1:j + 1]) < 16)}
    begins = {a: i for i, (a, _) in enumerate(lines)}
    ends = {b: i for i, (_, b) in enumerate(lines)}
    return raw, lines, found | {(begins[a], ends[b]) for a, b, _ in cut(text)}


def brute(documents):
    """Texts left, by document, when repeated runs of equal bytes go but for lines of first occurrences."""
    order = sorted({(d is None, d or 0, hashlib.md5((("null" if d is None else f"={d}") + "|" + (t or "")).encode()).hexdigest(), t or "")
                    for d, t in documents})
    places, gone, kept = {}, {}, {}
    for key in order:
        raw, lines, found = all_runs(key[3])
        for i, j in sorted(found):
            places.setdefault(raw[lines[i][0]:lines[j][1]], []).append((key, i, j))
    for found in places.values():
        if len(found) > 1:
            for n, (key, i, j) in enumerate(found):
                (gone if n else kept).setdefault(key, set()).update(range(i, j + 1))
    out = {}
    for key in order:
        raw, lines, _ = all_runs(key[3])
        go = gone.get(key, set()) - kept.get(key, set())
        starts = [a for a, _ in lines] + [len(raw)]
        text, at = b"", 0
        for i in sorted(go):
            text += raw[at:starts[i]]
            at = starts[i + 1]
        out[key] = (text + raw[at:]).decode()
    return {(None if nameless else d, t): v for (nameless, d, _, t), v in out.items()}


def ours(df):
    return {(r["id"], r["was"]): r["text"] for r in L.deduplicated(df).selectExpr(
        "doc.doc_id id", "coalesce(doc.text, '') was", "coalesce(text, '') text").collect()}


def line(rng, words):
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words))


def test_chunks_tile_and_resist_shifts():
    rng = random.Random(1)
    text = "\n".join(line(rng, rng.choice([2, 5, 9, 20, 40])) for _ in range(200))
    lines = text.split("\n")
    moved = "\n".join([line(rng, 7), *lines[:100], line(rng, 3), *lines[100:]])
    own = {text.encode()[a:b] for a, b, _ in cut(text)}
    other = {moved.encode()[a:b] for a, b, _ in cut(moved)}
    assert len(own - other) <= 4
    spans = sorted(cut(text))
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))


def test_equals_a_plain_count(spark):
    rng = random.Random(2)
    pool = [line(rng, n) for n in (3, 4, 6, 8, 18, 30, 60)]
    documents = []
    for i in range(120):
        body = []
        for _ in range(rng.randrange(1, 12)):
            body.append(rng.choice(pool) if rng.random() < 0.5 else line(rng, rng.choice([3, 9, 20])))
        documents.append((i, rng.choice(["\n", "\n\n"]).join(body) + rng.choice(["", "\n"])))
    documents += [(500, documents[3][1]), (501, "é日\n" * 30), (502, None), (503, ""), (504, "\n\n"), (None, documents[4][1]),
                  (3, documents[3][1])]
    df = spark.createDataFrame([(*d, "clash", 1) for d in documents], "doc_id long, text string, spans string, hash int")
    assert ours(df) == brute(documents)
    assert L.deduplicated(df).count() == len(documents)
    assert L.deduplicated(df.limit(0)).count() == 0


def test_planted_passages_are_caught_and_clean_texts_stay(spark):
    rng = random.Random(4)
    long_line = line(rng, 55)
    many_lines = "\n".join(line(rng, 9) for _ in range(12))
    documents = [(i, "\n".join([line(rng, 12), line(rng, 40), p, line(rng, 30), line(rng, 5)]))
                 for i, p in enumerate([long_line] * 6 + [many_lines] * 6)]
    clean = [(100 + i, "\n".join(line(rng, 10) for _ in range(20)) + "\nshort common line\n") for i in range(20)]
    left = ours(spark.createDataFrame(documents + clean, "doc_id long, text string"))
    assert all(left[d] == d[1] for d in clean)
    for d in documents:
        first = d[0] in (0, 6)
        assert (left[d] == d[1]) == first
        if d[1].find(long_line) >= 0 and not first:
            assert long_line not in left[d] and len(left[d]) == len(d[1]) - len(long_line) - 1


def test_query_on_given_tables(spark):
    documents = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    expected = brute(documents)
    rows = queries.QUERIES["op6_line_chunks"](spark, SF).collect()
    assert {r["doc_id"]: r["n_chars"] for r in rows} == {d: len(t) for (d, _), t in expected.items()}
    assert any(r["n_removed_lines"] for r in rows)


def test_long_text_in_one_group():
    text = "a b\n" * 400_000
    for _, _, data, offsets in K.groups(pa.array([text])):
        assert np.all(np.diff(L.chunks(data, offsets)["start"]) > 0)
        assert np.all(np.diff(L.runs(data, offsets)["start"]) >= 0)


def test_whole_passages_of_short_lines_go(spark):
    """Passages of 51 to 60 words in lines of 3 to 15 words, between lines of 8 words of their own."""
    rng = random.Random(5)
    documents, expected = [], {}
    for i in range(130):
        size, left, passage = 3 + i % 13, rng.randrange(51, 61), []
        while left:
            passage.append(line(rng, min(size, left)))
            left -= min(size, left)
        for j in (2 * i, 2 * i + 1):
            above, below = ([line(rng, 8) for _ in range(4)] for _ in range(2))
            documents.append((j, "\n".join(above + passage + below)))
            expected[documents[-1]] = "\n".join(above + below) if j % 2 else documents[-1][1]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert ours(df) == expected
    removed = L.deduplicated(df).filter("doc.doc_id % 2 = 1").selectExpr("size(spans) n", "spans[0].lines k", "doc.text was", "text").collect()
    assert all(r["n"] == 1 and r["k"] == r["was"].count("\n") - r["text"].count("\n") for r in removed)


def test_first_occurrences_stay_whole(spark):
    rng = random.Random(6)
    a, b, c, q, z = (line(rng, 10) for _ in range(5))
    docs = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{q}\n{b}\n{c}\n{z}")]
    left = ours(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [left[d] for d in docs] == [f"{a}\n{b}", f"{b}\n{c}", f"{q}\n{z}"]


def test_shorter_runs_by_parameter(spark):
    rng = random.Random(7)
    short = "\n".join(line(rng, 2) for _ in range(3))
    docs = spark.createDataFrame([(i, "\n".join([line(rng, 6), short, line(rng, 6)])) for i in range(4)], "doc_id long, text string")
    usual = L.deduplicated(docs, chunk_words=100).filter("size(spans) > 0").count()
    assert usual == 0 and L.deduplicated(docs, min_words=6, chunk_words=100).filter("size(spans) > 0").count() == 3
