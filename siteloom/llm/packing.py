"""Best-fit packing of tokenised documents by patterns of lengths.

Documents become token ids with an end id each, and only those longer than a sequence are
cut. The histogram of piece lengths (one count per length, so at most as long as a
sequence) is all the driver sees: patterns of two or three lengths that fill a
sequence exactly are enumerated, non-negative least squares fits how often each is
used, the fit is rounded down so that it never uses more pieces than there are, and the
residual histogram is packed best-fit, longest first. Spark then numbers the pieces of each
length and joins them to the plan's places. Pieces of equal length are numbered within
hash groups (``SPREAD`` of them for every ``PIECES`` pieces), so one common length is never ranked in a single task.

Null or empty text is the end id alone. Rows repeated in id and text are distinct pieces that differ
in their place only. An empty table gives no rows. Other columns are ignored.

Tokenising runs the given tokenizer on each distinct piece of text once: words of plain
Latin letters are split as its pre-tokenizer does and looked up in a table of known
pieces; whatever else is encoded as it stands between white space.

The plan has at most a few places per possible length (bounded by ``limit``, not by the data), so it is
broadcast to the pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteloom.llm import kernel as K
from siteloom.llm.tables import row_key
from siteloom.scale import lookup_join, written

LIMIT = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
SPREAD = 64
PIECES = 4_000_000
STEP = 16
ROUNDS = 400
KNOWN = 800_000

LETTER, DIGIT, OTHER, FOREIGN = 1, 2, 3, 4
CLASS = np.full(256, FOREIGN, dtype=np.uint8)
CLASS[33:127] = OTHER
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[0x80:0xC0] = CLASS[0xC3] = LETTER
CLASS[[0x27, 0x3C]] = FOREIGN


class Tokens:
    """Ids of byte pieces, remembered by hash up to ``KNOWN`` pieces."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.size = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64))
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        begin = len(self.ids) + np.cumsum(size) - size
        flat = np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(size.sum()))
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.begin = np.insert(self.begin, place, begin)
        self.size = np.insert(self.size, place, size)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each piece in ``self.ids``."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KNOWN:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            self.learn(distinct[new], [raw[start[i]:end[i]].decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.hashes, distinct)
        return self.begin[at][inverse], self.size[at][inverse]


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> K.Words:
    """Words between white space, those of plain Latin letters, digits and marks cut further into
    letter runs, single digits and mark runs."""
    words = K.words_of(data, offsets, K.NOT_SPACE, lower=False)
    if not len(words.start):
        return words
    kind = CLASS[data]
    lead = data == 0xC3
    trail = (data >= 0x80) & (data < 0xC0)
    after_lead = np.concatenate([[False], lead[:-1]])
    odd = (kind == FOREIGN) & K.NOT_SPACE[data]
    odd |= trail & (~after_lead | (data == 0x97) | (data == 0xB7))
    total = np.concatenate([[0], np.cumsum(odd)])
    plain = total[words.end] == total[words.start]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    level = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(level, words.start[plain], 1)
    np.add.at(level, words.end[plain], -1)
    inside = np.cumsum(level)[:-1] > 0
    cut[:-1] &= inside
    cut[words.start] = False
    extra = np.flatnonzero(cut[:-1])
    start = np.sort(np.concatenate([words.start, extra]))
    end = np.sort(np.concatenate([words.end, extra]))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return K.Words(doc, start, end, np.zeros(0, dtype=np.uint64), words.docs)


def hashes_of(data: np.ndarray, pieces: K.Words) -> np.ndarray:
    """Hash of each piece without regard to the case of A to Z, block by block."""
    out = np.zeros(len(pieces.start), dtype=np.uint64)
    at = 0
    while at < len(out):
        stop = max(int(np.searchsorted(pieces.end, pieces.start[at] + K.BLOCK_BYTES)), at + 1)
        lo, hi = pieces.start[at], pieces.end[stop - 1]
        out[at:stop] = K.spans_hash(data[lo:hi], pieces.start[at:stop] - lo, pieces.end[at:stop] - lo, K.LOWERED)
        at = stop
    return out


def token_ids(texts: pa.Array, tokens: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of texts: how many, ids without end id, and where each text's ids begin (one more entry)."""
    for lo, hi, data, offsets in K.groups(texts):
        pieces = pieces_of(data, offsets)
        if not len(pieces.start):
            yield hi - lo, np.zeros(0, dtype=np.uint32), np.zeros(hi - lo + 1, dtype=np.int64)
            continue
        begin, size = tokens.look_up(data, pieces.start, pieces.end, hashes_of(data, pieces))
        upto = np.cumsum(size)
        flat = tokens.ids[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        per_doc = np.bincount(pieces.doc, weights=size, minlength=hi - lo).astype(np.int64)
        yield hi - lo, flat, np.concatenate([[0], np.cumsum(per_doc)])


def tokenizer_at(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def tokens_at(path: str) -> Tokens:
    """One table of known pieces for all tasks of a worker."""
    return Tokens(tokenizer_at(path))


def cut_ids(flat: np.ndarray, begin: np.ndarray, limit: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Pieces of a group of texts, from all their ids and where each text's begin: text, number, start, length, and ids as bytes."""
    size = np.diff(begin)
    ids = np.full(len(flat) + len(size), end_id, dtype="<u4")
    ids[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
    many = -(-(size + 1) // limit)
    doc = np.repeat(np.arange(len(size)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * limit
    length = np.minimum(limit, size[doc] + 1 - start)
    edges = (4 * np.concatenate([[0], np.cumsum(length)])).astype(np.int32)
    return doc, piece, start, length, pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids)])


def cut_pieces(df: DataFrame, doc_id: str, path: str, limit: int, end_id: int) -> DataFrame:
    """One row per piece: id, row, piece, start, length and ids (little-endian unsigned 32-bit numbers)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_at(path)
        for batch in batches:
            at = 0
            for rows, flat, begin in token_ids(batch.column("text"), tokens):
                doc, piece, start, length, ids = cut_ids(flat, begin, limit, end_id)
                take = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("row").take(take), pa.array(piece, type=pa.int32()), pa.array(start),
                     pa.array(length), ids], names=["id", "row", "piece", "start", "length", "ids"])
                at += rows

    rows = df.select(F.col(doc_id).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.select("id", row_key("id", "text").alias("row"), "text").mapInArrow(
        run, f"id {kind}, row string, piece int, start bigint, length bigint, ids binary")


@dataclass
class Plan:
    """Each group: the lengths in one sequence, in order, and how many such sequences there are."""

    groups: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.groups)


def patterns(limit: int, present: np.ndarray, step: int = STEP) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence exactly, of lengths that occur:
    the full one, all pairs, and triples whose second length lies on a grid from the first."""
    rows = [(limit, 0, 0)] if present[limit] else []
    a = np.arange(1, limit // 2 + 1)
    a = a[present[a] & present[limit - a]]
    rows += [(x, limit - x, 0) for x in a.tolist()]
    for x in (np.flatnonzero(present[1:limit // 3 + 1]) + 1).tolist():
        y = np.arange(x, (limit - x) // 2 + 1, step)
        y = y[present[y] & present[limit - x - y]]
        rows += [(x, int(b), limit - x - int(b)) for b in y]
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def fitted(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeat counts x of the patterns that bring A x near the histogram,
    by accelerated projected gradient steps."""
    h = histogram.astype(float)
    ones = (rows > 0).astype(float)

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, j], weights=x * ones[:, j], minlength=len(h)) for j in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[rows[:, j]] * ones[:, j] for j in range(3))

    norm = np.ones(len(rows))
    for _ in range(30):
        norm = back(used(norm))
        size = np.linalg.norm(norm)
        norm /= size
    x, y, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(used(y) - h) / (1.05 * size))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


def best_fit(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequence that has room; equal cases are moved as counts."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(limit + 1, dtype=bool)
    done = []

    def put(lengths: tuple[int, ...], left: int, count: int) -> None:
        if left == 0:
            done.append((lengths, count))
        else:
            open_.setdefault(left, []).append((lengths, count))
            room[left] = True

    for length in range(limit, 0, -1):
        left = int(histogram[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                each = limit // length
                if whole := left // each:
                    put((length,) * each, limit - each * length, whole)
                if left % each:
                    put((length,) * (left % each), limit - (left % each) * length, 1)
                break
            free = length + int(fits[0])
            lengths, count = open_[free].pop()
            moved = min(count, left)
            if count > moved:
                open_[free].append((lengths, count - moved))
            elif not open_[free]:
                room[free] = False
            put((*lengths, length), free - length, moved)
            left -= moved
    return done + [g for groups in open_.values() for g in groups]


def plan(histogram: np.ndarray, limit: int = LIMIT) -> Plan:
    """``histogram[n]`` pieces of length n, packed. Rounded fits are clipped to what is left, largest first."""
    left = histogram.astype(np.int64).copy()
    groups = []
    rows = patterns(limit, left > 0)
    if len(rows):
        counts = np.floor(fitted(rows, left) + 1e-6).astype(np.int64)
        for i in np.argsort(-counts, kind="stable"):
            lengths = tuple(int(v) for v in rows[i] if v)
            need = {v: lengths.count(v) for v in lengths}
            count = min([int(counts[i]), *(int(left[v]) // m for v, m in need.items())])
            if count > 0:
                groups.append((lengths, count))
                for v, m in need.items():
                    left[v] -= m * count
    return Plan(groups + best_fit(left, limit))


def packed(documents: DataFrame, path: str, doc_id: str = "doc_id", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian unsigned 32-bit numbers), their CRC, sequence_id and offset."""
    spark = documents.sparkSession
    pieces = written(cut_pieces(documents, doc_id, path, limit, end_id), "pieces")
    spread = SPREAD * (1 + pieces.count() // PIECES)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(spread)).cast("int"))
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("count")), "histogram")
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("count")).collect():  # at most ``limit`` rows
        histogram[r["length"]] = r["count"]
    places, sequence, taken = [], 0, np.zeros(limit + 1, dtype=np.int64)
    for lengths, count in plan(histogram, limit).groups:
        offset = 0
        for length in lengths:
            places.append((length, int(taken[length]), int(taken[length]) + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    slots = spark.createDataFrame(places, "length bigint, low bigint, high bigint, first_sequence bigint, offset bigint")

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("row", "piece")
    numbered = lookup_join(pieces.withColumn("within", F.row_number().over(order) - 1), base, ["length", "part"], "inner")
    placed = numbered.withColumn("at", F.col("base") + F.col("within"))
    low, high = F.col("s.low"), F.col("s.high")
    found = placed.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length"))
                                   & (F.col("p.at") >= low) & (F.col("p.at") < high))
    return found.select(
        F.col("id").alias(doc_id), "piece", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), "ids",
        F.crc32("ids").alias("ids_crc32"), (F.col("first_sequence") + F.col("at") - low).alias("sequence_id"), "offset")
