"""Phrase places against a plain search, and templates with changed words."""

import pyarrow.parquet as pq

from siteloom.llm import license_scan as L
from siteloom.llm import queries

SF = "/root/testdata/sf0.001"


def brute(text):
    words = L.words_in(text or "")
    found = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == tuple(p.split())]
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None), sorted({x for _, x in found}))


MIT = dict(L.TEMPLATES)["mit-text"]
BSD = dict(L.TEMPLATES)["bsd-text"]
TEXTS = [None, "", " .,", "MIT License", "the mit-LICENSE, Mit license mit license", "general public general public license 7 apache\nlicense",
         "filler words here " * 5000 + MIT, MIT.replace("without limitation", "with no limit at all"), MIT[:60], "x " + BSD.upper() + " y " + BSD,
         "of the software and of the work to the terms of the", "Released under the MIT License.", "mit licénse mitlicense"]


def test_places_labels_and_changed_words(spark):
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, labels string, hits int")
    rows = {r["doc_id"]: r for r in L.scanned(df).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert rows[6]["labels"] == ["mit-text"] == rows[7]["labels"] and rows[6]["score"] == 1 and 0.8 <= rows[7]["score"] < 1
    assert rows[8]["labels"] == [] and rows[8]["score"] < 0.8
    assert rows[9]["labels"] == ["bsd-text"] and len(rows[9]["spans"]) == 2
    assert rows[10]["labels"] == [] and "mit-statement" in rows[11]["labels"]
    assert L.scanned(df.limit(0)).count() == 0
    assert sum(1 for _ in L.scanned(df).collect()) == 2 * len(TEXTS)


def test_words_put_in_the_middle_keep_the_label(spark):
    words = MIT.split()
    texts = []
    for n in range(4, 21):
        for at in (12, len(words) // 2, len(words) - 12):
            texts.append(" ".join([*words[:at], *[f"company{i}" for i in range(n)], *words[at:]]))
    for n in (4, 9):  # at two places, and one clause cut out
        texts.append(" ".join([*words[:18], *["acme"] * n, *words[18:40], *["inc"] * n, *words[40:]]))
        texts.append(" ".join([*words[:20], *words[20 + n:]]))
    apart = len(texts)
    texts += [" ".join([*words[:25], *["far"] * 400, *words[25:]]), " ".join([*words[28:], *words[:28]]), MIT + " " + MIT]
    rows = {r["doc_id"]: r for r in L.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(apart):
        assert rows[i]["labels"] == ["mit-text"] and rows[i]["score"] >= 0.8, texts[i]
    assert rows[apart]["labels"] == [] == rows[apart + 1]["labels"]
    assert rows[apart + 2]["labels"] == ["mit-text"] and [s["share"] for s in rows[apart + 2]["spans"]] == [1.0, 1.0]


def test_long_drifting_text_is_compared_in_tiles(spark):
    drift = " ".join(" ".join(MIT.split()[i % 40:i % 40 + 5]) for i in range(30_000))
    texts = [drift, drift + " " + MIT + " " + drift]
    rows = {r["doc_id"]: r for r in L.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = len(L.words_in(MIT))
    assert all(s["end"] - s["first"] <= L.tile(n) for r in rows.values() for s in r["spans"])
    assert "mit-text" in rows[1]["labels"] and rows[1]["score"] == 1


def test_query_on_given_tables(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_license_scan"](spark, SF).collect()}
    for d in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        r, (words, *base, labels) = rows[d["doc_id"]], brute(d["text"])
        assert [r["n_words"], r["n_base"], r["first_word"], r["last_word"]] == [words, *base]
        assert r["base_labels"] == ",".join(labels)
    assert any(r["n_base"] for r in rows.values())
