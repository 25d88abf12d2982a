"""Vectorised words, word hashes and k-gram hashes over Arrow text batches.

Everything here works on one Arrow batch inside a task. Texts are taken as UTF-8
bytes in groups of bounded size, so memory follows ``GROUP_BYTES`` and the longest
single text, not the batch. Hashes are 64-bit sums over byte (or word) positions
with a mixing step; they are equal in every process and on every run.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 19
GROUP_ROWS = 1000
BLOCK_BYTES = 1 << 19

RADIX = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * RADIX)
LOWERED = BYTES.copy()
LOWERED[65:91] = BYTES[97:123]

#: Word characters: all but ASCII white space; and digits, ASCII letters and all beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX ** i and its inverse modulo 2 ** 64, for i < n; kept for blocks of usual size."""
    if len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    inverse = np.uint64(pow(int(RADIX), -1, 1 << 64))
    grown = []
    for base in (RADIX, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        grown.append(np.multiply.accumulate(steps))
    if n <= 2 * BLOCK_BYTES:
        _powers["up"], _powers["down"] = grown
    return grown[0], grown[1]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """64-bit hash of every byte span of one block; the same bytes give the same
    hash at any place."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * GRAM)


@dataclass
class Words:
    """The words of a group of texts: text number, byte span and hash of each."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def groups(texts: pa.Array, max_bytes: int = GROUP_BYTES, max_rows: int = GROUP_ROWS
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``max_bytes`` at most: first row, end row, their bytes, and where
    each text starts in them (one entry more than rows). A null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not (wide or pa.types.is_string(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, len(texts))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi
    release()


def release() -> None:
    """Give memory that is free again back to the system, as a worker outlives its tasks: what earlier tasks
    left in reference cycles (helpers come by value, with their tables), the Arrow pool, and the C library's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(data: np.ndarray, inside: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a long byte range after bytes that belong to no word."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~inside[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(~inside[data[end:]])
                end = end + int(gaps[0]) + 1 if len(gaps) else len(data)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """All maximal runs of bytes that are ``inside``, never across two texts."""
    table = LOWERED if lower else BYTES
    found = []
    for lo, hi in blocks(data, inside):
        part = data[lo:hi]
        mask = np.zeros(len(part) + 2, dtype=bool)
        mask[1:-1] = inside[part]
        begins = mask[1:] & ~mask[:-1]
        ends = mask[:-1] & ~mask[1:]
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
        cuts = cuts[mask[cuts] & mask[cuts + 1]]
        begins[cuts] = ends[cuts] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        found.append((start + lo, end + lo, spans_hash(part, start, end, table)))
    start, end, hashed = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (
        np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, end, hashed, len(offsets) - 1)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words of one text, and the number of its first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = words.hash[:n].copy()
    for j in range(1, k):
        total *= GRAM
        total += words.hash[j:n + j]
    first = np.flatnonzero(words.doc[:n] == words.doc[k - 1:])
    return mix(total[first] + np.uint64(k)), first


def whole(words: Words, keep: np.ndarray) -> np.ndarray:
    """Hash of the whole word sequence of each text in ``keep`` (of few words each), equal to the
    hash that ``grams`` gives a window of just these words."""
    count, begin = words.per_doc(), np.searchsorted(words.doc, np.arange(words.docs))
    out = np.zeros(len(keep), dtype=np.uint64)
    for i, d in enumerate(keep):
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in words.hash[begin[d]:begin[d] + count[d]]:
                total = total * GRAM + h
            out[i] = total + np.uint64(count[d])
    return mix(out)


def lists(values: np.ndarray, doc: np.ndarray, docs: int, kind: pa.DataType) -> pa.ListArray:
    """One list per text from values in text order."""
    offsets = np.zeros(docs + 1, dtype=np.int32)
    np.cumsum(np.bincount(doc, minlength=docs), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


class Bitmap:
    """Fixed-size set of hash remainders: no member is missed, strangers pass at the rate
    at which it is filled. Only narrows what is shuffled; an exact join follows."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.size = np.uint64(len(bits) * 8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % self.size
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
