"""Removal of line runs that repeat across a corpus, found by content-defined chunks.

A rolling hash over the hashes of ``ROLL`` lines chooses boundaries, so chunks tile a text and lie alike after a shift;
those of several lines and ``CHUNK_WORDS`` words are compared across all documents. A boundary next to a passage depends on
the line outside, so a short passage may hold no whole chunk. Therefore shortest runs of lines with ``min_words`` words,
from every line onwards and from every line back, are compared in the same way: each line of
a repeated run of ``min_words`` words or more lies in one that is inside the run, so the run goes as a
whole, whatever the length of its lines and whatever stands around it. (A long line alone is such a run.)

Hashes that occur more than once are found first, by a map-side count; only the texts of such
runs are shuffled, and they count as repeated when their bytes are equal. The first
occurrence (by id, then row, then place) stays and all others are cut out with the line breaks
that follow them, but for lines that belong to the first occurrence of another run: so whatever goes, goes where
an equal run stays whole. Cuts that overlap or touch are one. Of lines that go on repeating themselves one period stays.
Occurrences are never gathered: they are counted, and joined to the first.

Null and empty texts have no chunks and stay as they are. Rows equal in id and text are one document
and get the same result; null ids come last. An empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import kernel as K
from siteloom.llm.tables import bitmap_of, row_key
from siteloom.scale import lookup_join, written

MIN_WORDS = 16
CHUNK_WORDS = 8
ROLL = 2
DIVISOR = 3
MOST_LINES = 64

LINE = np.ones(256, dtype=bool)
LINE[10] = False


@dataclass
class Lines:
    """The lines of a group of texts that are not empty, and the words before each (one entry more)."""

    lines: K.Words
    upto: np.ndarray
    offsets: np.ndarray

    def units(self, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
        """Runs by first and last line: text number, first byte, end of the last
        line, start of the line after it (or end of the text), number of the first line, lines and hash."""
        lines, n = self.lines, len(self.lines.start)
        if not n:
            return {k: np.zeros(0, dtype=np.int64) for k in ("doc", "start", "end", "stop", "line", "lines", "hash")}
        up, down = K._power(n + 1)
        mixed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(lines.hash * up[:-1], dtype=np.uint64)])
        hashed = K.mix((mixed[last + 1] - mixed[first]) * down[first] + (last - first + 1).astype(np.uint64) * K.GRAM)
        after = np.append(lines.start[1:], 0)
        final = np.append(lines.doc[1:] != lines.doc[:-1], True)
        after[final] = self.offsets[lines.doc[final] + 1]
        return {"doc": lines.doc[first], "start": lines.start[first], "end": lines.end[last], "stop": after[last],
                "line": first - np.searchsorted(lines.doc, lines.doc[first]), "lines": last - first + 1, "hash": hashed}


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    lines = K.words_of(data, offsets, LINE, lower=False)
    inside = K.NOT_SPACE[data]
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] |= inside[heads]
    total = np.concatenate([[0], np.cumsum(begins)])
    return Lines(lines, np.concatenate([[0], np.cumsum(total[lines.end] - total[lines.start])]), offsets)


def tiles(own: Lines, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the chunks between boundaries that have several lines and ``least`` words."""
    doc, n = own.lines.doc, len(own.lines.start)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rolled = own.lines.hash.copy()
    for back in range(1, min(ROLL, n)):
        same = doc[back:] == doc[:-back]
        rolled[back:] += np.where(same, K.mix(own.lines.hash[:-back] + np.uint64(back)), np.uint64(0))
    final = np.append(doc[1:] != doc[:-1], True)
    ends = (K.mix(rolled) % np.uint64(DIVISOR) == 0) | final
    number = np.arange(n)
    begun = np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), number, 0))
    ends |= (number - begun + 1) % MOST_LINES == 0
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    large = (last > first) & (own.upto[last + 1] - own.upto[first] >= least)
    return first[large], last[large]


def shortest(own: Lines, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs of ``least`` words, from every line onwards and back."""
    n, upto = len(own.lines.start), own.upto
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    number = np.arange(n)
    onwards = np.searchsorted(upto, upto[:-1] + least) - 1
    back = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    first, last = np.concatenate([number, back]), np.concatenate([onwards, number])
    whole = (first >= 0) & (last < n) & (first <= last)
    whole[whole] = own.lines.doc[first[whole]] == own.lines.doc[last[whole]]
    return first[whole], last[whole]


def chunks(data: np.ndarray, offsets: np.ndarray, chunk_words: int = CHUNK_WORDS) -> dict[str, np.ndarray]:
    """The content-defined chunks of a group of texts."""
    own = lines_of(data, offsets)
    return own.units(*tiles(own, chunk_words))


def runs(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, chunk_words: int = CHUNK_WORDS) -> dict[str, np.ndarray]:
    """Chunks and shortest runs together, each once."""
    own = lines_of(data, offsets)
    n = max(len(own.lines.start), 1)
    first, last = (np.concatenate(x) for x in zip(tiles(own, chunk_words), shortest(own, min_words), strict=True))
    return own.units(*np.divmod(np.unique(first * n + last), n))


def hash_counts(df: DataFrame, min_words: int, chunk_words: int) -> DataFrame:
    """Hashes of runs and how often they occur, summed within each group of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.groups(batch.column("text")):
                value, count = np.unique(K.as_long(runs(data, offsets, min_words, chunk_words)["hash"].astype(np.uint64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["hash", "count"])

    return df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "hash bigint, count bigint")


def occurrences(df: DataFrame, id_column: str, repeated: K.Bitmap, min_words: int, chunk_words: int) -> DataFrame:
    """Runs whose hash may be repeated, with their bytes and place."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in K.groups(batch.column("text")):
                c = runs(data, offsets, min_words, chunk_words)
                take = np.flatnonzero(repeated.has(c["hash"].astype(np.uint64)))
                doc, start, end = (c[k][take] for k in ("doc", "start", "end"))
                raw, at = data.tobytes(), pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(at), batch.column("row").take(at), pa.array(start - offsets[doc]),
                    pa.array(c["stop"][take] - offsets[doc]), pa.array(c["line"][take]), pa.array(c["lines"][take]),
                    pa.array(K.as_long(c["hash"][take].astype(np.uint64))),
                    pa.array([raw[a:b] for a, b in zip(start, end, strict=True)], type=pa.binary())],
                    names=["id", "row", "start", "stop", "line", "lines", "hash", "bytes"])

    rows = df.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.select("id", row_key("id", "text").alias("row"), "text").mapInArrow(
        run, f"id {kind}, row string, start bigint, stop bigint, line bigint, lines bigint, hash bigint, bytes binary")


def cut_lines(gone: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Spans (rows of start, stop, line, lines) that ``gone`` covers and ``kept`` does not, those that touch as one."""
    both = np.concatenate([gone, kept])
    edge, at = np.unique(np.concatenate([both[:, 2], both[:, 2] + both[:, 3]]), return_index=True)
    byte = np.concatenate([both[:, 0], both[:, 1]])[at]

    def covered(spans: np.ndarray) -> np.ndarray:
        level = np.zeros(len(edge) + 1, dtype=np.int64)
        np.add.at(level, np.searchsorted(edge, spans[:, 2]), 1)
        np.add.at(level, np.searchsorted(edge, spans[:, 2] + spans[:, 3]), -1)
        return np.cumsum(level)[:-1] > 0

    cut = np.concatenate([[False], covered(gone) & ~covered(kept), [False]])
    begin, end = np.flatnonzero(cut[1:] & ~cut[:-1]), np.flatnonzero(~cut[1:] & cut[:-1])
    return np.column_stack([byte[begin], byte[end], edge[begin], edge[end] - edge[begin]])


def joined(found: DataFrame) -> DataFrame:
    """The spans to cut of each row, from its runs that are repeats (``gone``) and those that are first occurrences (``kept``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("gone", "kept"):
                column = batch.column(name)
                flat = column.flatten()
                spans = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "stop", "line", "lines")])
                offsets = column.offsets.to_numpy()
                sides.append((spans, offsets - offsets[0]))
            (gone, at), (kept, to) = sides
            out = [cut_lines(gone[at[i]:at[i + 1]], kept[to[i]:to[i + 1]]) for i in range(batch.num_rows)]
            flat = np.concatenate([*out, np.zeros((0, 4), dtype=np.int64)]).astype(np.int64)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(flat[:, 3])], ["start", "stop", "lines"])
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["row", "spans"])

    return found.mapInArrow(run, "row string, spans array<struct<start:bigint,stop:bigint,lines:bigint>>")


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", min_words: int = MIN_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per row that loses something: its key and the byte spans to cut (start, stop, lines), in order."""
    often = hash_counts(documents, min_words, chunk_words).groupBy("hash").agg(F.sum("count").alias("count")).filter("count > 1")
    found = written(occurrences(documents, doc_id, bitmap_of(often, "hash"), min_words, chunk_words), "occurrences")
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "start")
    first = (found.groupBy("hash", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter(F.col("first") != F.col("last")).select("hash", "bytes", "first"))
    span = F.struct("start", "stop", "line", "lines")
    is_first = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    placed = found.join(written(first, "first"), ["hash", "bytes"]).select(
        "row", F.when(~is_first, span).alias("gone"), F.when(is_first, span).alias("kept"))
    rows = placed.groupBy("row").agg(F.collect_set("gone").alias("gone"), F.collect_set("kept").alias("kept"))
    return joined(rows.filter(F.size("gone") > 0)).filter(F.size("spans") > 0)


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", min_words: int = MIN_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Every row as ``doc``, its ``text`` without repeated runs, and the spans cut (empty: none)."""
    spans = written(repeated_spans(documents, doc_id, min_words, chunk_words), "spans")
    rows = documents.select(F.struct("*").alias("doc"), row_key(doc_id, "text").alias("row"))
    text = F.col("doc.text")
    raw = text.cast("binary")
    edges = F.zip_with(
        F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.stop")),
        F.concat(F.col("spans.start"), F.array(F.octet_length(text).cast("bigint"))),
        lambda a, b: F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,lines:bigint>>")
    return lookup_join(rows, spans, ["row"], "left").select(
        "doc", F.when(F.col("spans").isNull(), text).otherwise(F.array_join(edges, "")).alias("text"),
        F.coalesce("spans", none).alias("spans"))
