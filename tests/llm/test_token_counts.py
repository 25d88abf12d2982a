"""Counts against a plain dynamic programme for every word."""

import random
import re

import public_tokenizers
import pyarrow.parquet as pq

from siteloom.llm import queries
from siteloom.llm import token_counts as T

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(T.MODEL)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_trie_equals_plain_counts():
    vocabulary = T.Vocabulary({"a": -1.0, "ab": -1.5, "abc": -4.0, "bc": -1.0, "c": -2.0, "▁": -1.0, "▁a": -1.0, "aa": -2.0}, -20.0)
    rng = random.Random(1)
    words = list({"▁" + "".join(rng.choice("abcdé日𝄞") for _ in range(rng.randrange(12))) for _ in range(2000)})
    assert T.trie_counts(words, vocabulary).tolist() == [T.plain_count(w, vocabulary) for w in words]
    assert T.plain_count("▁aa", vocabulary) == 2 and T.plain_count("▁abc", vocabulary) == 2 and T.plain_count("日", vocabulary) == 3
    assert T.trie_counts([], vocabulary).tolist() == []


def test_edge_rows_and_small_tables_of_known_words(spark, monkeypatch):
    texts = [None, "", " \n ", "one two one", "x" * 5000 + " y", "é日𝄞 \x00", "a\x0bb\x85c"] + ["w%d x" % i for i in range(50)]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens int")
    vocabulary = T.vocabulary_at(PATH)
    got = sorted(tuple(r) for r in T.counted(df, PATH).collect())
    expected = [(i, len(WORD.findall(t or "")), sum(T.plain_count(T.MARK + w, vocabulary) for w in WORD.findall(t or "")))
                for i, t in enumerate(texts)]
    assert got == sorted(expected * 2)
    monkeypatch.setattr(T, "KNOWN", 5)
    counts = T.Counts(vocabulary)
    for t in texts[7:]:
        for _, _, data, offsets in T.K.groups(T.pa.array([t])):
            words = T.K.words_of(data, offsets, T.K.NOT_SPACE, lower=False)
            assert counts.look_up(words, data).tolist() == [T.plain_count(T.MARK + w, vocabulary) for w in t.split()]
    assert T.counted(df.limit(0), PATH).count() == 0


def test_query_on_given_tables(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    vocabulary, known = T.scored_at(PATH, T.fitted(documents, PATH)), {}
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in queries.QUERIES["op9_token_counts"](spark, SF).collect()}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        words = WORD.findall(r["text"])
        for w in set(words) - set(known):
            known[w] = T.plain_count(T.MARK + w, vocabulary)
        assert rows[r["doc_id"]] == (len(words), sum(known[w] for w in words))


def plain_expected(word, vocabulary):
    """Expected pieces of one word by listing its cuts."""
    cuts = [([], 1.0)]
    done = []
    while cuts:
        pieces, p = cuts.pop()
        rest = word[sum(map(len, pieces)):]
        if not rest:
            done.append((pieces, p))
        for n in range(1, len(rest) + 1):
            known = vocabulary.pieces.get(rest[:n])
            if known is not None or n == 1:
                score = known if known is not None else len(rest[0].encode()) * vocabulary.byte_score
                cuts.append(([*pieces, rest[:n]], p * T.np.exp(score)))
    total, out = sum(p for _, p in done), {}
    for pieces, p in done:
        for piece in pieces:
            out[piece] = out.get(piece, 0) + p / total
    return out


def test_expected_counts_equal_a_listing_of_all_cuts():
    vocabulary = T.Vocabulary({"a": -1.0, "ab": -1.5, "abc": -4.0, "bc": -1.0, "c": -2.0, "▁": -1.0, "▁a": -1.0, "aa": -2.0}, -3.0)
    rng = random.Random(3)
    words = list({"▁" + "".join(rng.choice("abcé") for _ in range(rng.randrange(7))) for _ in range(200)})
    often = T.np.array([rng.randrange(1, 9) for _ in words])
    got, expected = T.expected_counts(words, often, vocabulary) / T.UNIT, dict.fromkeys(vocabulary.pieces, 0.0)
    for word, n in zip(words, often, strict=True):
        for piece, share in plain_expected(word, vocabulary).items():
            if piece in expected:
                expected[piece] += n * share
    assert T.np.allclose(got, list(expected.values()), atol=0.05)


def test_query_counts_under_scores_fitted_to_all_documents(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    scores = T.fitted(documents, PATH)
    assert (scores == T.fitted(documents.repartition(7), PATH)).all()
    vocabulary, often = T.scored_at(PATH, scores), {}
    rows = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op9_token_counts"](spark, SF).collect()}
    for r in documents.collect():
        words = WORD.findall(r["text"])
        for w in words:
            often[w] = often.get(w, 0) + 1
    known = {w: T.plain_count(T.MARK + w, vocabulary) for w in often}
    for r in documents.collect():
        assert rows[r["doc_id"]] == sum(known[w] for w in WORD.findall(r["text"]))
    plain = sum(n * len(own.encode(w)) for w, n in often.items())
    ranks = sum(n * T.plain_count(T.MARK + w, T.vocabulary_at(PATH)) for w, n in often.items())
    print("tokens: fitted", sum(rows.values()), "ranks", ranks, "encode", plain)
    assert sum(rows.values()) < 1.05 * plain < ranks
    assert T.fitted(documents.limit(0), PATH).shape == scores.shape
