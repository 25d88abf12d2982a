"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

A text's pre-tokens are its words between ASCII white space, each with the word-begin mark
in front. Distinct pre-tokens are put into a trie, level by level; the best score of a node
(the sum of piece scores of its best cut, and of equal sums the fewest pieces) is worked out once
from its ancestors, so words with a common beginning share that work. The count at
a word's last node is stored, and texts add up stored counts. A character that is no piece counts one
token per UTF-8 byte.

Counts need no shuffle: each worker keeps its own table of known pre-tokens, up to ``KNOWN``.
The pieces are those of a given model file. Its scores are merge ranks, not log probabilities, so
``fitted`` estimates these from all documents: ``ROUNDS`` rounds of expected counts over the distinct
pre-tokens with their frequencies, from equal scores on. The driver holds one number per piece.
Expected counts are summed as whole ``1 / UNIT`` parts, so the same rows give the same scores in any order.
Null and empty texts have no tokens. Other columns are ignored; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import kernel as K
from siteloom.scale import written

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KNOWN = 2_000_000
GROUP_BYTES = 4 << 20
LONG = 64
ROUNDS = 4
UNIT = 1 << 16
FLOOR = 0.01

RADIX = 0x9E3779B97F4A7C15


def char_codes(codes: np.ndarray) -> np.ndarray:
    return K.mix(codes.astype(np.uint64) + np.uint64(1))


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes, scores and numbers; and the score of a byte."""

    pieces: dict[str, float]
    byte_score: float

    def __post_init__(self):
        self.by_length = {}
        for number, (piece, score) in enumerate(self.pieces.items()):
            self.by_length.setdefault(len(piece), []).append((piece, score, number))
        self.longest = max(self.by_length, default=1)
        for length, own in self.by_length.items():
            codes = char_codes(np.array([[ord(c) for c in p] for p, _, _ in own], dtype=np.uint64))
            total = np.zeros(len(own), dtype=np.uint64)
            for j in range(length):
                total = total * np.uint64(RADIX) + codes[:, j]
            order = np.argsort(total)
            self.by_length[length] = (total[order], np.array([s for _, s, _ in own])[order], np.array([i for _, _, i in own])[order])

    def find(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of the piece of each hash; minus infinity and -1 where there is none."""
        own = self.by_length.get(length)
        if own is None:
            return np.full(hashes.shape, -np.inf), np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(own[0], hashes), len(own[0]) - 1)
        same = own[0][at] == hashes
        return np.where(same, own[1][at], -np.inf), np.where(same, own[2][at], -1)

    def score(self, length: int, hashes: np.ndarray) -> np.ndarray:
        return self.find(length, hashes)[0]


@lru_cache(maxsize=2)
def vocabulary_at(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): float(model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return Vocabulary(pieces, min(pieces.values()) - 10.0)


def scored_at(path: str, scores: np.ndarray) -> Vocabulary:
    """The pieces of a model file with scores of one's own, in their order."""
    return Vocabulary(dict(zip(vocabulary_at(path).pieces, scores.tolist(), strict=True)), float(scores.min()) - 10.0)


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def trie_counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each distinct word (mark included), by one pass over the levels of their trie."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size) - size
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    mixed = char_codes(codes)
    parent, hashed, best, count = [np.array([-1])], [np.zeros(1, dtype=np.uint64)], [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
    nodes, at = 1, np.zeros(len(words), dtype=np.int64)
    out = np.zeros(len(words), dtype=np.int64)
    live = np.arange(len(words))
    for depth in range(int(size.max(initial=0))):
        live = live[size[live] > depth]
        place = begin[live] + depth
        _, first, inverse = np.unique((at[live] << 21) | codes[place], return_index=True, return_inverse=True)
        up = at[live][first]
        all_parent, all_hash, all_best, all_count = (np.concatenate(x) if len(x) > 1 else x[0] for x in (parent, hashed, best, count))
        parent, hashed, best, count = [all_parent], [all_hash], [all_best], [all_count]
        own = all_hash[up] * np.uint64(RADIX) + mixed[place[first]]
        single = vocabulary.score(1, mixed[place[first]])
        raw = utf8_size(codes[place[first]])
        score = all_best[up] + np.where(np.isfinite(single), single, raw * vocabulary.byte_score)
        pieces = all_count[up] + np.where(np.isfinite(single), 1, raw)
        ancestor, power = up, np.uint64(RADIX)
        for length in range(2, min(depth + 1, vocabulary.longest) + 1):
            ancestor = all_parent[ancestor]
            power = np.uint64((int(power) * RADIX) & 0xFFFFFFFFFFFFFFFF)
            gain = vocabulary.score(length, own - all_hash[ancestor] * power)
            new, n = all_best[ancestor] + gain, all_count[ancestor] + 1
            better = (new > score) | ((new == score) & (n < pieces))
            score, pieces = np.where(better, new, score), np.where(better, n, pieces)
        parent.append(up)
        hashed.append(own)
        best.append(score)
        count.append(pieces)
        at[live] = nodes + inverse
        nodes += len(first)
        done = live[size[live] == depth + 1]
        out[done] = pieces[at[done] - (nodes - len(first))]
    return out


def plain_count(word: str, vocabulary: Vocabulary) -> int:
    """The same for one word by itself; for words so long that no other shares them."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(max(0, end - vocabulary.longest), end):
            piece = word[start:end]
            score, n = vocabulary.pieces.get(piece), 1
            if score is None:
                if end - start > 1:
                    continue
                n = len(piece.encode("utf-8", "surrogatepass"))
                score = n * vocabulary.byte_score
            ways.append((best[start][0] + score, -(best[start][1] + n)))
        score, n = max(ways)
        best.append((score, -n))
    return best[-1][1]


def expected_counts(words: list[str], often: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How often each piece is expected in the words (mark included), over all their cuts, in parts of 1 / ``UNIT``."""
    out = np.zeros(len(vocabulary.pieces), dtype=np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == length)
        codes = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        codes = codes.reshape(len(own), length).T
        mixed, hashed, edges = char_codes(codes), np.zeros((length + 1, len(own)), dtype=np.uint64), {}
        for n in range(1, min(length, vocabulary.longest) + 1):
            hashed = hashed[:length - n + 1] * np.uint64(RADIX) + mixed[n - 1:]
            edges[n] = vocabulary.find(n, hashed)
        single, number = edges[1]
        edges[1] = np.where(number >= 0, single, utf8_size(codes) * vocabulary.byte_score), number
        ahead, back = np.zeros((length + 1, len(own))), np.zeros((length + 1, len(own)))
        for at in range(1, length + 1):
            ahead[at] = np.logaddexp.reduce([ahead[at - n] + edges[n][0][at - n] for n in edges if n <= at])
            back[length - at] = np.logaddexp.reduce([back[length - at + n] + edges[n][0][length - at] for n in edges if n <= at])
        for n, (score, number) in edges.items():
            share = np.exp(ahead[:length - n + 1] + score + back[n:] - ahead[length]) * often[own]
            np.add.at(out, number[number >= 0], np.rint(share[number >= 0] * UNIT).astype(np.int64))
    return out


def pretokens(documents: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words of all documents and how often they occur, counted within each group of texts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.groups(batch.column("text"), GROUP_BYTES, 4000):
                words = K.words_of(data, offsets, K.NOT_SPACE, lower=False)
                _, first, count = np.unique(words.hash, return_index=True, return_counts=True)
                raw = data.tobytes()
                said = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first], words.end[first], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(said, type=pa.string()), pa.array(count)], names=["word", "count"])

    return (documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, count bigint")
            .groupBy("word").agg(F.sum("count").alias("count")))


def fitted(documents: DataFrame, path: str, text: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the model's pieces, in their order, fitted to all documents."""
    words = written(pretokens(documents, text), "pretokens")
    size = len(vocabulary_at(path).pieces)
    scores = np.full(size, -np.log(size))
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], given: np.ndarray = scores) -> Iterator[pa.RecordBatch]:
            vocabulary, total = scored_at(path, given), np.zeros(size, dtype=np.int64)
            for batch in batches:
                total += expected_counts([MARK + w for w in batch.column("word").to_pylist()], batch.column("count").to_numpy(), vocabulary)
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], names=["piece", "parts"])

        found = words.mapInArrow(run, "piece bigint, parts bigint").groupBy("piece").agg(F.sum("parts").alias("parts")).toPandas()
        count = np.full(size, FLOOR)
        count[found["piece"].to_numpy(dtype=np.int64)] += found["parts"].to_numpy(dtype=np.int64) / UNIT
        scores = np.log(count / count.sum())
    return scores


class Counts:
    """Stored counts of known pre-tokens by hash."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def look_up(self, words: K.Words, data: np.ndarray) -> np.ndarray:
        distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KNOWN:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            said = [MARK + raw[words.start[i]:words.end[i]].decode("utf-8", "replace") for i in first[new]]
            long = np.array([len(w) > LONG for w in said])
            counts = np.zeros(len(new), dtype=np.int64)
            counts[~long] = trie_counts([w for w, x in zip(said, long, strict=True) if not x], self.vocabulary)
            counts[long] = [plain_count(w, self.vocabulary) for w, x in zip(said, long, strict=True) if x]
            place = at[new]
            self.hashes = np.insert(self.hashes, place, distinct[new])
            self.counts = np.insert(self.counts, place, counts)
            at = np.searchsorted(self.hashes, distinct)
        return self.counts[at][inverse]


@lru_cache(maxsize=1)
def counts_at(path: str, scores: bytes | None) -> Counts:
    return Counts(vocabulary_at(path) if scores is None else scored_at(path, np.frombuffer(scores)))


def counted(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", scores: np.ndarray | None = None) -> DataFrame:
    """Per row: id, n_words and n_tokens, under ``scores`` (see ``fitted``) or else the file's own."""
    given = None if scores is None else scores.tobytes()
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_at(path, given)
        for batch in batches:
            for lo, hi, data, offsets in K.groups(batch.column("text"), GROUP_BYTES, 4000):
                words = K.words_of(data, offsets, K.NOT_SPACE, lower=False)
                tokens = counts.look_up(words, data) if len(words.hash) else np.zeros(0, dtype=np.int64)
                total = np.bincount(words.doc, weights=tokens, minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(words.per_doc()), pa.array(total)],
                                                 names=["id", "n_words", "n_tokens"])

    return (documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint").withColumnRenamed("id", doc_id))
