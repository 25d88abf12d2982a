"""Alignments against a plain version that encodes whole texts one by one."""

import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from siteloom.llm import queries
from siteloom.llm import token_align as T

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(T.MODEL_A), public_tokenizers.path(T.MODEL_B)
TEXTS = [None, "", "a", " ", " a", "a ", "a  b", "a\n\n b", "x \n\ny", "x　 y", "x \n\ny", "a\r\n b", "a;\r\n b", "\tq", "\nq",
         "</s> <s> <|endoftext|> x", "a▁b", "日本語 テキスト", "é é ê é", "🎉🎉 🎉", "ab" * 5000, "a" * 3000, "don't I'll 12345 3.14",
         "  \n \t  x \x0b y\x85z \x1c q", "ﬁ ½", "a\x00b", "x \ny", "١٢٣ العربية", "a\n b\n\tc", "word " * 40_000]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet, docs = T.byte_alphabet(), []
    for text in texts:
        docs.append(None)
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            said = [[bytes(alphabet[c] for c in first.id_to_token(i)) for i in a],
                    [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
                     for i in b]]
            if all(b"".join(s) == (" " + text).encode() for s in said):
                ends = [list(accumulate(map(len, s))) for s in said]
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = []
                places = [dict(zip(e, range(1, len(e) + 1), strict=True)) for e in ends]
                i = j = 0
                for end in common:
                    groups.append((a[i:places[0][end]], b[j:places[1][end]]))
                    i, j = places[0][end], places[1][end]
                docs[-1] = (len(a), len(b), groups)
    count = Counter(p for d in docs if d for p in {(x, y) for g, h in d[2] for x in g for y in h})
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        links = [(x, y) for g, h in d[2] for x in g for y in h]
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d[2])
        yield (*d[:2], len(d[2]), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
               hashlib.sha256(shown.encode()).hexdigest())


@pytest.mark.parametrize("frequent", [T.FREQUENT, 5, 0])
def test_edge_rows(spark, frequent):
    texts = TEXTS * 2 + ["a b"] * 30
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, pairs string")
    found, counts = T.aligned(docs, A, B, frequent=frequent)
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == list(brute(texts))
    assert counts.filter("best").count() >= counts.select("a").distinct().count()


def test_query_on_given_tables(spark):
    rows = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_token_align"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert rows == dict(zip((d["doc_id"] for d in docs), brute([d["text"] for d in docs]), strict=True))


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    rows = T.aligned(docs, A, B)[0].collect()
    assert len(rows) == 4 and len({tuple(r)[1:] for r in rows}) == 2
    assert {r["count_sum"] for r in rows if r["n_a"]} == {3 * 2}
    assert T.aligned(docs.limit(0), A, B)[0].count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    known = T.Known(T.Pair(A, B))
    words = [f" w{i}".encode() for i in range(50)]
    data, edge = T.flat(words)
    hashes = T.segment_hashes(data, edge[:-1], edge[1:])
    row = known.look_up(hashes, words.__getitem__)
    kept = known.measures[row]
    monkeypatch.setattr(T, "KNOWN", 10)
    row = known.look_up(hashes, words.__getitem__)
    again = known.measures[row]
    assert (kept == again).all()


def test_a_group_of_very_many_tokens(monkeypatch):
    segments = [(" " + "日" * 40 + "x" * 500).encode(), b" plain"]
    pair = T.Pair(A, B)
    usual = T.align(segments, pair)
    monkeypatch.setattr(T, "WIDE", 0)
    reduced = T.align(segments, pair)
    assert (usual.pairs == reduced.pairs).all() and (usual.links == reduced.links).all()
