"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled whole, so equal texts meet and are counted (map-side first: a text that makes up a third of
all rows is one row per task before anything moves). Each distinct text is encoded by both tokenizers; the byte offsets where
tokens of both end cut them into groups, and every token pair of one group is a link. A pair of ids counts
once for every document that holds it linked, so counts are summed over distinct texts, weighted by how many documents
have the text; measures of a text then go to all ids that have it.

Tokenizer A (byte-level BPE) reads a space and the text, B (a sentencepiece model) the text, to which it adds the space.
Inside texts the strings of special tokens are plain text. A text is cut into segments before single spaces and line feeds that
follow a character which is no white space: no pre-token of A and no piece of B goes over such a cut, so both tokenizers give the
same tokens there as in the whole text, and a cut is always the end of a group. Each worker remembers the tokens,
groups and pairs of up to ``KNOWN`` segments by 64-bit hash; forgotten ones are only worked out again. For a model of
which a piece breaks this rule the whole text is one segment.

Pair counts are joined to the pairs of texts in two parts: pairs that are in so many documents that at most ``FREQUENT`` pairs
are as common go by broadcast, so no common pair is ever a hot key; the others are shuffled.

Defined results: null and empty texts, and texts whose tokens of A or B do not spell them out exactly (as with U+2581 in the text, which B
reads as a space), have no tokens: zeros and an empty group string. Repeated rows count as documents of their own and stay.
An empty table gives no rows. Other columns, whatever their names, are ignored. One text is encoded by one task by need.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import kernel as K
from siteloom.scale import lookup_join, written

MODEL_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
KNOWN = 400_000
FREQUENT = 200_000
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
WIDE = 1 << 16

#: Bytes that may end a Unicode white space character: a cut is only made after others.
PLAIN_END = np.zeros(256, dtype=bool)
PLAIN_END[0x21:0x7F] = True
WIDE_END = np.zeros(256, dtype=bool)
WIDE_END[0x80:0xC0] = True


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable, else the next free code from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes and where each part begins, one entry more."""
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)])


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after another."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        spelled_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = flat(spelled_a), flat(spelled_b)
        self.said_a, self.said_b = ([str(i).encode() for i in range(len(x))] for x in (spelled_a, spelled_b))
        self.splits = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def encode(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for segments that begin with white space: B gets those that begin with a space without it, as it adds
        one itself (but not to nothing), and loses the added space before others."""
        said = [s.decode("utf-8", "replace") for s in segments]
        ids_a = [e.ids for e in self.a.encode_batch(said, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] if s[0] == " " else s for s in said], num_threads=1)
        alone = [self.b.piece_to_id("▁")]
        return ids_a, [alone if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(said, ids_b, strict=True)]


def spelled(ids: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the tokens of many segments, the bytes of each token, and of each segment."""
    data, begin = table
    size = begin[ids + 1] - begin[ids]
    upto = np.concatenate([[0], np.cumsum(size)])
    edges = np.concatenate([[0], np.cumsum(count)])
    return data[ranges(begin[ids], size)], size, np.diff(upto[edges])


@dataclass
class Aligned:
    """Per segment: whether it spells out, ``MEASURES``, the group string, and its pairs with how many links each has."""

    right: np.ndarray
    measures: np.ndarray
    groups: list[bytes]
    pair_count: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


def group_pairs(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, segment: np.ndarray, segments: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs of each segment and their links, from the tokens of its groups in order. Groups of very many tokens are first
    reduced to their distinct ids."""
    begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = np.flatnonzero(n_a * n_b > WIDE)
    small = np.flatnonzero(n_a * n_b <= WIDE)
    each = (n_a * n_b)[small]
    group = np.repeat(small, each)
    place = ranges(np.zeros(len(small), dtype=np.int64), each)
    a = ids_a[begin_a[group] + place // n_b[group]]
    b = ids_b[begin_b[group] + place % n_b[group]]
    keys, owner, weight = [(a.astype(np.int64) << 32) | b], [segment[group]], [np.ones(len(group), dtype=np.int64)]
    for g in large.tolist():
        own_a, often_a = np.unique(ids_a[begin_a[g]:begin_a[g] + n_a[g]], return_counts=True)
        own_b, often_b = np.unique(ids_b[begin_b[g]:begin_b[g] + n_b[g]], return_counts=True)
        keys.append(((own_a.astype(np.int64) << 32)[:, None] | own_b[None, :]).ravel())
        owner.append(np.full(len(keys[-1]), segment[g]))
        weight.append(np.outer(often_a, often_b).ravel())
    return summed(np.concatenate(owner), np.concatenate(keys), np.concatenate(weight), segments)


def summed(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each owner, how many each owner has, and the summed weights; by owner, then key."""
    order = np.lexsort((keys, owner))
    owner, keys, weight = owner[order], keys[order], weight[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight, first) if len(first) else weight
    return np.bincount(owner[first], minlength=owners), keys[first], total


def align(segments: list[bytes], pair: Pair) -> Aligned:
    """Tokens of both in every segment, cut into groups where tokens of both end."""
    found_a, found_b = pair.encode(segments)
    data, begin = flat(segments)
    size = np.diff(begin)

    def spells(found: list[list[int]], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter((i for f in found for i in f), dtype=np.int64, count=int(count.sum()))
        out, _, length = spelled(ids, count, table)
        same = length == size
        at = np.cumsum(length) - length
        equal = out[ranges(at[same], size[same])] == data[ranges(begin[:-1][same], size[same])]
        wrong = np.zeros(len(found), dtype=bool)
        wrong[np.repeat(np.flatnonzero(same), size[same])[~equal]] = True
        return same & ~wrong

    right = spells(found_a, pair.bytes_a) & spells(found_b, pair.bytes_b)
    keep = np.flatnonzero(right)
    own = [[found[i] for i in keep] for found in (found_a, found_b)]
    counts = [np.fromiter(map(len, f), dtype=np.int64, count=len(f)) for f in own]
    ids = [np.fromiter((i for f in x for i in f), dtype=np.int64, count=int(c.sum())) for x, c in zip(own, counts, strict=True)]
    ends = [np.cumsum(spelled(i, c, t)[1]) for i, c, t in zip(ids, counts, (pair.bytes_a, pair.bytes_b), strict=True)]
    common = np.intersect1d(*ends, assume_unique=True)
    upto = [np.searchsorted(e, common, side="right") for e in ends]
    n_a, n_b = (np.diff(np.concatenate([[0], u])) for u in upto)
    segment = np.searchsorted(np.cumsum(size[keep]), common)
    pair_count, pairs, links = group_pairs(ids[0], ids[1], n_a, n_b, segment, len(keep))

    said = [[names[i] for i in x.tolist()] for names, x in ((pair.said_a, ids[0]), (pair.said_b, ids[1]))]
    text = [b",".join(said[0][i:j]) + b"|" + b",".join(said[1][k:m]) for i, j, k, m in zip(
        (upto[0] - n_a).tolist(), upto[0].tolist(), (upto[1] - n_b).tolist(), upto[1].tolist(), strict=True)]
    n_groups = np.bincount(segment, minlength=len(keep))
    edge = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
    measures = np.zeros((len(segments), len(MEASURES)), dtype=np.int64)
    measures[keep] = np.column_stack([counts[0], counts[1], n_groups,
                                      np.bincount(segment, weights=n_a * n_b, minlength=len(keep)).astype(np.int64)])
    groups, per_segment = [b""] * len(segments), np.zeros(len(segments), dtype=np.int64)
    for at, i in enumerate(keep.tolist()):
        groups[i] = b";".join(text[edge[at]:edge[at + 1]]) + b";"
    per_segment[keep] = pair_count
    return Aligned(right, measures, groups, per_segment, pairs, links)


class Known:
    """What is known of segments, by hash, up to ``KNOWN`` of them."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.hashes, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.right, self.measures = np.zeros(0, dtype=bool), np.zeros((0, len(MEASURES)), dtype=np.int64)
        self.text, self.text_at = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.pairs, self.links, self.pairs_at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def look_up(self, hashes: np.ndarray, segment) -> np.ndarray:
        """Row of each segment; ``segment(i)`` gives the bytes of the i-th."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KNOWN:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            found = align([segment(i) for i in first[new].tolist()], self.pair)
            text, text_at = flat(found.groups)
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.row = np.insert(self.row, at[new], len(self.right) + np.arange(len(new)))
            self.right = np.concatenate([self.right, found.right])
            self.measures = np.concatenate([self.measures, found.measures])
            self.text_at = np.concatenate([self.text_at, len(self.text) + text_at[1:]])
            self.text = np.concatenate([self.text, text])
            self.pairs_at = np.concatenate([self.pairs_at, len(self.pairs) + np.cumsum(found.pair_count)])
            self.pairs, self.links = np.concatenate([self.pairs, found.pairs]), np.concatenate([self.links, found.links])
            at = np.searchsorted(self.hashes, distinct)
        return self.row[at][inverse]


@lru_cache(maxsize=1)
def known_at(path_a: str, path_b: str) -> Known:
    return Known(Pair(path_a, path_b))


def segments_of(data: np.ndarray, offsets: np.ndarray, splits: bool) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of segments and the text of each; of texts that begin with the added space."""
    cut = np.zeros(len(data), dtype=bool)
    if splits and len(data):
        before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
        lead = np.concatenate([[0, 0], data[:-2]]).astype(np.uint8)
        wide = WIDE_END[before] & (lead >= 0xC3) & (lead < 0xE0)
        cut = ((data == 0x20) | (data == 0x0A)) & (PLAIN_END[before] | wide)
    cut[offsets[:-1]] = True
    start = np.flatnonzero(cut)
    return start, np.searchsorted(offsets, start, side="right") - 1


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each segment, block by block."""
    out, at = np.zeros(len(start), dtype=np.uint64), 0
    while at < len(out):
        stop = max(int(np.searchsorted(end, start[at] + K.BLOCK_BYTES)), at + 1)
        lo, hi = start[at], end[stop - 1]
        out[at:stop] = K.spans_hash(data[lo:hi], start[at:stop] - lo, end[at:stop] - lo)
        at = stop
    return out


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per distinct text (``text``, ``n`` documents): its key, n, ``MEASURES``, groups_sha256, and its id pairs with their links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_at(path_a, path_b)
        for batch in batches:
            for lo, hi, plain, plain_offsets in K.groups(batch.column("text")):
                rows = hi - lo
                offsets = plain_offsets + np.arange(rows + 1)
                data = np.full(len(plain) + rows, 0x20, dtype=np.uint8)
                data[np.arange(len(plain)) + np.repeat(np.arange(1, rows + 1), np.diff(plain_offsets))] = plain
                start, doc = segments_of(data, offsets, known.pair.splits)
                end = np.append(start[1:], len(data))
                raw = data.tobytes()
                row = known.look_up(segment_hashes(data, start, end),
                                    lambda i, raw=raw, start=start, end=end: raw[start[i]:end[i]])
                right = np.bincount(doc, weights=~known.right[row], minlength=rows) == 0
                row, doc = row[right[doc]], doc[right[doc]]
                measures = np.column_stack([np.bincount(doc, weights=known.measures[row, j], minlength=rows) for j in range(len(MEASURES))])

                size = known.text_at[row + 1] - known.text_at[row]
                text = known.text[ranges(known.text_at[row], size)].tobytes()
                edge = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=rows).astype(np.int64))]).tolist()
                digest = [hashlib.sha256(text[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(edge, edge[1:])]  # noqa: RUF007

                size = known.pairs_at[row + 1] - known.pairs_at[row]
                at = ranges(known.pairs_at[row], size)
                count, pairs, links = summed(np.repeat(doc, size), known.pairs[at], known.links[at], rows)
                place = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, rows), batch.column("n").slice(lo, rows),
                     *(pa.array(m.astype(np.int64)) for m in measures.T), pa.array(digest),
                     pa.ListArray.from_arrays(place, pa.array(pairs)), pa.ListArray.from_arrays(place, pa.array(links))],
                    names=["key", "n", *MEASURES, "groups_sha256", "pairs", "links"])

    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    return texts.select(text_key("text").alias("key"), "n", "text").mapInArrow(
        run, f"key string, n bigint, {fields}, groups_sha256 string, pairs array<bigint>, links array<bigint>")


def text_key(text: str):
    return F.sha2(F.col(text), 256)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per pair of ids: how many documents hold it linked, and whether that is the most of its A id."""
    counts = written(aligned.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))  # one row per id of A
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def weighted(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per text: n_best and count_sum. ``counts`` are joined in two parts, split at a power of two so that at most
    ``frequent`` pairs are in the part that is sent to every task."""
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    power = max(sizes, default=0) + 1
    while sizes and power > 0 and sum(n for p, n in sizes.items() if p >= power - 1) <= frequent:
        power -= 1
    often, rare = counts.filter(F.col("count") >= 2 ** power), counts.filter(F.col("count") < 2 ** power)
    rows = aligned.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("key", F.col("x.pairs").alias("pair"), "x.links")
    value = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")]
    sums = rows.join(F.broadcast(often), "pair").groupBy("key").agg(*value)
    if power > 0:
        others = rows.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("key").agg(*value)
        sums = sums.unionByName(others).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return sums


def aligned(documents: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT
            ) -> tuple[DataFrame, DataFrame]:
    """Per document: id, ``MEASURES``, n_best, count_sum and groups_sha256; and the counts of id pairs (a, b, count, best)."""
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    found = written(aligned_texts(texts, path_a, path_b), "aligned_texts")
    counts = written(pair_counts(found), "pair_counts")
    measures = written(found.select("key", *MEASURES, "groups_sha256").join(weighted(found, counts, frequent), "key"), "measures")
    every = rows.select("id", text_key("text").alias("key"))
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    per_document = lookup_join(every, measures, ["key"], "left").select(
        F.col("id").alias(doc_id), *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return per_document, counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "count", "best")
