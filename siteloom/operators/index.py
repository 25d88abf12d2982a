"""From sources to index rows: merge, split, embed, project, post."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import tokens, words
from siteloom.scale import checkpointed, lookup_join, written

CHUNK_SIZE, CHUNK_OVERLAP = 2000, 500
EMBED_DIM = 256
SENTENCE_CUT = r"(?s)^.*[.!?؟\n]"
# Analyzer of each searchable text field.
SEARCH_FIELDS = {"chunk": "standard", "title": "standard", "id": "keyword"}
POSTING_KEYS = ["id", "language", "section", "kind"]
POSTING_ROWS = 1000
LISTS_DDL = "id string, language string, section string, kind string, field string, dl int, terms array<string>, tfs array<int>"
# Entries of a block of chunks, whose numbers fit a short integer, and the shelf that their keys stand on.
BLOCK_ENTRIES, KEYS_SHELF = 32 * 1024, -1
ENTRY_KEYS = [*POSTING_KEYS, "field", "dl"]
INVERTED_DDL = ("block bigint, field string, term string, base int, places array<smallint>, tfs array<int>, "
                "keys array<struct<id:string,language:string,section:string,kind:string,field:string,dl:int>>")


def merge_inserts(docs: DataFrame, ocr_text: DataFrame) -> DataFrame:
    """Put image texts into ``content`` at their offsets, a blank on each side.

    Only the image texts are grouped; a document's own text moves at most once.
    """
    inserts = written(ocr_text.groupBy("parent_id").agg(F.array_sort(F.collect_list(
        F.struct("content_offset", "ord", "text"))).alias("_inserts")), "inserts")
    joined = lookup_join(docs, inserts, ["parent_id"], "left")
    length = F.length("content")

    def offset(i: Column) -> Column:
        at = F.try_element_at("_inserts", i)["content_offset"]
        return F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), length)).cast("int")

    def piece(item: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(offset(F.greatest(i, F.lit(1))))
        before = F.substr("content", start + 1, offset(i + 1) - start)
        return F.concat(before, F.lit(" "), item["text"], F.lit(" "))

    tail = F.substr("content", offset(F.size("_inserts")) + 1)
    merged = F.concat(F.array_join(F.transform("_inserts", piece), ""), tail)
    return joined.withColumn("content", F.when(F.col("_inserts").isNull(), F.col("content"))
                             .otherwise(merged)).drop("_inserts")


def _cut_points(size: int, overlap: int) -> Column:
    """Windows (start, length) of a text whose ends are moved back to the last
    sentence end in the second half of the window, when there is one."""
    length = F.length("content")
    steps = F.sequence(F.lit(1), F.greatest(
        F.ceil(length / F.lit(max(size // 2 - overlap, 1))), F.lit(1)).cast("int"))
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("done"),
                     F.array().cast("array<struct<start:int,length:int>>").alias("windows"))

    def step(acc: Column, _: Column) -> Column:
        window = F.substr("content", acc.pos + 1, F.lit(size))
        to_sentence = F.length(F.regexp_extract(window, SENTENCE_CUT, 0))
        last = acc.pos + size >= length
        cut = F.when(last, length - acc.pos).when(to_sentence > size // 2, to_sentence).otherwise(size)
        grown = F.struct(
            F.when(last, acc.pos).otherwise(acc.pos + cut - overlap).alias("pos"),
            last.alias("done"),
            F.array_append(acc.windows, F.struct(acc.pos.alias("start"), cut.alias("length")))
            .alias("windows"))
        return F.when(acc.done, acc).otherwise(grown)

    return F.aggregate(steps, start, step).windows


def chunk_text(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               boundary: bool = False) -> DataFrame:
    """One row per passage of ``content``: ``ord``, ``chunk`` and ``id``.

    Plain windows by default; with ``boundary`` they end at sentences. The
    split happens inside the row, so nothing is shuffled.
    """
    if boundary:
        windows = _cut_points(size, overlap)
        parts = F.transform(windows, lambda w: F.substr("content", w.start + 1, w.length))
    else:
        n = F.greatest(F.ceil((F.length("content") - overlap) / (size - overlap)), F.lit(1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(
            "content", i * (size - overlap) + 1, F.lit(size)))
    rest = [c for c in df.columns if c != "content"]
    out = df.select(*rest, F.posexplode(parts).alias("ord", "chunk"))
    return out.withColumn("id", F.concat_ws("_", "parent_id", "ord"))


def nonempty(chunks: DataFrame) -> DataFrame:
    """Only passages with text are indexed; their parents are not."""
    return chunks.filter((F.col("chunk") != "") & F.col("chunk").isNotNull())


def _features(known: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of every word, from bytes 0 to 3 and 4 of its digest."""
    digests = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in known]), np.uint8).reshape(-1, 16)
    return (digests[:, :4].copy().view(">u4").ravel() % dim).astype(np.int64), 1.0 - 2.0 * (digests[:, 4] >> 7)


def _hashed_vectors(dim: int) -> Callable[[Column], Column]:
    def count(words: pa.Array) -> pa.Array:
        """Bucket counts per row, scaled to unit length. Each distinct word of the batch is hashed once; empty
        ones, which a split leaves at its ends, do not count."""
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.cast(pa.binary()).to_pylist()
        buckets, signs = _features(known, dim)
        signs[[i for i, w in enumerate(known) if not w]] = 0.0
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cell = np.repeat(np.arange(len(words)) * dim, sizes) + buckets[codes]
        sums = np.bincount(cell, weights=signs[codes], minlength=len(words) * dim)
        sums = sums.reshape(len(words), dim)
        norm = np.sqrt((sums ** 2).sum(axis=1, keepdims=True))
        unit = (sums / np.where(norm == 0, 1.0, norm)).astype(np.float32)
        offsets = np.arange(0, unit.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))
    return F.arrow_udf(count, "array<float>")


def embed_hash(df: DataFrame, column: str = "chunk", dim: int = EMBED_DIM) -> DataFrame:
    """Add ``vector``: signed feature hashing of the tokens, unit length.

    Texts are split in the JVM; Python hashes the distinct words of an Arrow batch and counts buckets,
    so the step needs no shuffle.
    """
    return df.withColumn("vector", _hashed_vectors(dim)(words(column)))


def embed_column(df: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Add the vectors the user has, by id; one of a wrong size becomes null."""
    fitting = vectors.select("id", F.when(F.size("vector") == dim, F.col("vector")).alias("vector"))
    return df.join(fitting, "id", "left")


def embed_udf(df: DataFrame, fn: Callable[[pd.Series], list[list[float]]],
              column: str = "chunk") -> DataFrame:
    """Add vectors from a user's model; ``fn`` gets whole Arrow batches and
    reaches each Python worker once."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(fn(batch)))
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(column)))


def _isolated(fn: Callable[[pd.Series], list[list[float]]], texts: pd.Series) -> pd.DataFrame:
    """Vector and error of every text. A batch that fails is halved until the failing texts stand alone, so few
    of them cost few further calls."""
    vectors, errors = [None] * len(texts), [None] * len(texts)
    todo = [(0, len(texts))] if len(texts) else []
    while todo:
        lo, hi = todo.pop()
        try:
            found = list(fn(texts.iloc[lo:hi].reset_index(drop=True)))
            if len(found) != hi - lo:
                raise ValueError(f"{len(found)} vectors for {hi - lo} texts")
            vectors[lo:hi] = [None if v is None else np.asarray(v, dtype=np.float32) for v in found]
        except Exception as error:  # a user's model may raise anything
            if hi - lo > 1:
                todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            else:
                errors[lo] = f"{type(error).__name__}: {error}"
    return pd.DataFrame({"vector": vectors, "error": errors})


def embed_tolerant(df: DataFrame, fn: Callable[[pd.Series], list[list[float]]], column: str = "chunk") -> DataFrame:
    """As ``embed_udf``, with a column ``error``: a text the model fails on gets no vector and the reason, and the
    other texts of its batch keep theirs. A null text goes to the model like any other."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _isolated(fn, batch)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = F.pandas_udf(run, "vector array<float>, error string")(F.col(column))
    return df.withColumn("_made", made).select(*df.columns, "_made.vector", "_made.error")


def project_index(chunks: DataFrame) -> DataFrame:
    """Index rows: a passage with its vector and its parent's fields."""
    wanted = ["id", "parent_id", "ord", "chunk", "vector", "title", "source_url", "language",
              "section", "kind", "crawled_at", "content_hash"]
    return nonempty(chunks).select(*[c for c in wanted if c in chunks.columns])


@dataclass(frozen=True)
class SearchIndex:
    """The tables a query reads. ``lists``, if there, is what ``postings`` are read from, with the terms of a chunk's field in one
    row. ``inverted`` holds them once more as lists by term, in ``shelves`` folders by the hash of (field, term) and sorted by them;
    ``by_term`` shows these one by one."""

    chunks: DataFrame
    postings: DataFrame
    term_df: DataFrame
    corpus_stats: DataFrame
    by_term: DataFrame | None = None
    shelves: int = 0
    lists: DataFrame | None = None
    inverted: DataFrame | None = None


def _fields(chunks: DataFrame) -> DataFrame:
    """One row per chunk and searchable field, with its tokens."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(
        tokens(name, analyzer), F.array().cast("array<string>")).alias("tokens"))
        for name, analyzer in SEARCH_FIELDS.items()])
    return chunks.select("id", "language", "section", "kind", F.inline(fields)) \
        .withColumn("dl", F.size("tokens"))


def analyze(chunks: DataFrame) -> DataFrame:
    """(id, field, term): every token of every searchable field."""
    return _fields(chunks).select("id", "field", F.explode("tokens").alias("term"))


def postings(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, field, term, tf, dl, language, section, kind).

    Chunks are spread and sorted by id before they are tokenised, so rows of equal keys stand side by side and words are
    counted batch by batch: passages are shuffled once, tokens never, and a task holds the counts of one batch
    only. Field length and filter columns ride along, which spares a join per query.
    """
    spread = chunks.select("id", "chunk", "title", "language", "section", "kind")
    spread = spread.repartition(partitions, "id") if partitions else spread.repartition("id")
    return _by_key(spread).mapInArrow(_counted, ", ".join([f"{c} string" for c in POSTING_KEYS] + ["field string, dl int, term string, tf int"]))


def posting_lists(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same postings as they are stored: (id, language, section, kind, field, dl, terms, tfs), a row for each key, field
    and field length, so what these share is written once and not with every term."""
    spread = chunks.select("id", "chunk", "title", "language", "section", "kind")
    spread = spread.repartition(partitions, "id") if partitions else spread.repartition("id")
    return _by_key(spread).mapInArrow(_listed, LISTS_DDL)


def flat(lists: DataFrame) -> DataFrame:
    """Posting lists as postings."""
    return lists.select(*POSTING_KEYS, "field", "dl", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))


def _by_key(spread: DataFrame) -> DataFrame:
    split = [F.when(F.col(name).isNotNull(), F.array(name)) if analyzer == "keyword" else words(name)
             for name, analyzer in SEARCH_FIELDS.items()]
    return spread.sortWithinPartitions(*POSTING_KEYS).select(*POSTING_KEYS, *[w.alias(f"_{n}") for w, n in zip(split, SEARCH_FIELDS)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows sorted by key."""
    for lists in _listed(batches):
        rows = pa.array(np.repeat(np.arange(lists.num_rows), lists["terms"].value_lengths().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([*[lists[c].take(rows) for c in (*POSTING_KEYS, "field", "dl")], lists["terms"].flatten(), lists["tfs"].flatten()],
                                         names=[*POSTING_KEYS, "field", "dl", "term", "tf"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of rows sorted by key. Counts of the last key wait for the next rows, which may have the same."""
    schema = pa.schema([*[(c, pa.string()) for c in POSTING_KEYS], ("field", pa.string()), ("dl", pa.int32()),
                        ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
    key, waiting = None, defaultdict(Counter)

    def waited() -> pa.RecordBatch:
        own = [pa.array([v] * len(waiting), pa.string()) for v in key]
        told = [pa.array(v, t) for v, t in zip(zip(*waiting), (pa.string(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*own, *told, pa.array([list(c) for c in waiting.values()], pa.list_(pa.string())),
                                           pa.array([list(c.values()) for c in waiting.values()], pa.list_(pa.int32()))], schema=schema)

    for part in (b.slice(at, POSTING_ROWS) for b in batches for at in range(0, b.num_rows, POSTING_ROWS)):
        group = _runs([part[c] for c in POSTING_KEYS])
        first, last = (tuple(part[c][at].as_py() for c in POSTING_KEYS) for at in (0, part.num_rows - 1))
        found = [(name, *_word_counts(part[f"_{name}"], group, analyzer)) for name, analyzer in SEARCH_FIELDS.items()]

        def wait(number: int) -> None:
            for name, at, dl, term, tf in found:
                here = np.flatnonzero(group[at] == number)
                for d, t, n in zip(dl[here].tolist(), term.take(pa.array(here)).to_pylist(), tf[here].tolist()):
                    waiting[name, d][t] += n

        if key is not None:
            if key == first:
                wait(0)
            if waiting and (key != first or group[-1] > 0):
                yield waited()
                waiting = defaultdict(Counter)
        for name, at, dl, term, tf in found:
            whole = np.flatnonzero((group[at] < group[-1]) & ((group[at] > 0) | (key != first)))
            if len(whole):
                starts = np.flatnonzero(np.diff(at[whole], prepend=-1))
                ends = pa.array(np.append(starts, len(whole)).astype(np.int32))
                rows = whole[starts]
                yield pa.RecordBatch.from_arrays(
                    [*[part[c].take(pa.array(at[rows])) for c in POSTING_KEYS], pa.array([name] * len(rows), pa.string()), pa.array(dl[rows].astype(np.int32)),
                     pa.ListArray.from_arrays(ends, term.take(pa.array(whole))), pa.ListArray.from_arrays(ends, pa.array(tf[whole].astype(np.int32)))], schema=schema)
        if group[-1] > 0 or key != first:
            wait(group[-1])
        key = last
    if waiting:
        yield waited()


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Number of the run of equal rows that each row belongs to, from 0."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _word_counts(lists: pa.Array, group: np.ndarray, analyzer: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, length, term, count) of the words in ``lists``; rows of one group and length are counted together
    and named by the first of them."""
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    if analyzer != "keyword":  # a split leaves empty words at the ends
        real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
        codes, row = codes[real], row[real]
    size = np.bincount(row, minlength=len(lists))
    _, named, same = np.unique(group * (size.max(initial=0) + 1) + size, return_index=True, return_inverse=True)
    keys = np.sort(same[row] * len(coded.dictionary) + codes)
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    at = named[keys[starts] // max(len(coded.dictionary), 1)]
    return at, size[at], coded.dictionary.take(pa.array(keys[starts] % max(len(coded.dictionary), 1))), np.diff(starts, append=len(keys))


def shelf(shelves: int) -> Column:
    """The folder that postings of (field, term) stand in."""
    return F.pmod(F.crc32(F.encode(F.concat_ws("\x01", "field", "term"), "UTF-8")), F.lit(shelves)).cast("int").alias("shelf")


def inverted(posted: DataFrame, shelves: int) -> DataFrame:
    """Postings or their lists by term, packed: (block, shelf, pack), with all terms of a block of chunks that stand on one shelf in a row.
    ``unpacked`` shows them as (block, field, term, base, places, tfs) for every term of a block, and (block, base,
    keys) once for a block. A posting is a number, its place among the keys from ``base`` on, and a count; a chunk is in one block."""
    if "terms" not in posted.columns:
        posted = posted.groupBy(*ENTRY_KEYS).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
    entry = F.struct(*POSTING_KEYS, "field", "dl", "terms", "tfs")
    chunks = posted.groupBy(F.col("id").alias("_id")).agg(F.collect_list(entry).alias("entries")).select("entries")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for entries in (block for batch in batches for block in _blocks(batch["entries"])):
            keys, lists = _block_lists(entries)
            yield _packs(number, [(KEYS_SHELF, keys)])
            yield _packs(number, _shelved(lists, shelves))
            number += 1

    return chunks.mapInArrow(packed, "block bigint, shelf int, pack binary")


def unpacked(packs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own, pack in zip(batch["block"].to_pylist(), batch["shelf"].to_pylist(), batch["pack"]):
                for told in pq.read_table(pa.BufferReader(pack.as_buffer()), use_threads=False).combine_chunks().to_batches():
                    yield _inverted_rows(block, own, told)

    return packs.mapInArrow(rows, f"{INVERTED_DDL}, shelf int")


def _packs(number: int, told: Iterable[tuple[int, pa.Table]]) -> pa.RecordBatch:
    """Tables as Parquet bytes, which hold rising places as small steps and sorted terms by what they do not share."""
    shelves, packs = [], []
    for own, rows in told:
        sink = pa.BufferOutputStream()
        coded = {"term": "DELTA_BYTE_ARRAY", "places.list.element": "DELTA_BINARY_PACKED"} if "term" in rows.column_names else None
        pq.write_table(rows, sink, compression="zstd", use_dictionary=["field", "base", "tfs.list.element"] if coded else True,
                       column_encoding=coded, write_statistics=False, store_schema=False)
        shelves.append(own)
        packs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_pydict({"block": pa.array([number] * len(packs), pa.int64()), "shelf": pa.array(shelves, pa.int32()), "pack": pa.array(packs, pa.binary())})


def _shelved(lists: pa.Table, shelves: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shelf, as ``shelf`` has it, sorted by term."""
    of = np.array([zlib.crc32(f"{f}\x01{t}".encode()) for f, t in zip(lists["field"].to_pylist(), lists["term"].to_pylist())], dtype=np.int64) % shelves
    keyed = pa.table({"shelf": of, "field": lists["field"], "term": lists["term"]})
    order = pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in keyed.column_names])
    for own, start, end in zip(*(x.tolist() for x in _spans(of[order.to_numpy()]))):
        yield own, lists.take(order.slice(start, end - start))


def _spans(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of every run."""
    values, starts = np.unique(sorted_values, return_index=True)
    return values, starts, np.append(starts[1:], len(sorted_values))


def _blocks(entries: pa.ListArray) -> Iterator[pa.StructArray]:
    """Entries of chunks that follow each other, ``BLOCK_ENTRIES`` at most or those of one chunk."""
    ends, at = np.cumsum(entries.value_lengths().to_numpy(zero_copy_only=False)), 0
    while at < len(entries):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_ENTRIES, side="right")))
        yield entries.slice(at, end - at).flatten()
        at = end


def _block_lists(entries: pa.StructArray) -> tuple[pa.Table, pa.Table]:
    """Keys and lists of a block. Entries beyond the first ``BLOCK_ENTRIES``, which a chunk of very many has, follow in further rows."""
    own = dict(zip(entries.type.names, entries.flatten()))
    keys = pa.StructArray.from_arrays([own[c] for c in ENTRY_KEYS], names=ENTRY_KEYS)
    bases = np.arange(0, len(entries), BLOCK_ENTRIES)
    cuts = pa.array(np.append(bases, len(entries)).astype(np.int32))
    told_keys = pa.table({"base": pa.array(bases.astype(np.int32)), "keys": pa.ListArray.from_arrays(cuts, keys)})
    words, fields = own["terms"].flatten().dictionary_encode(), own["field"].dictionary_encode()
    entry = np.repeat(np.arange(len(entries)), own["terms"].value_lengths().to_numpy(zero_copy_only=False))
    part, place = np.divmod(entry, BLOCK_ENTRIES)
    n_words = max(1, len(words.dictionary))
    term = fields.indices.to_numpy()[entry].astype(np.int64) * n_words + words.indices.to_numpy()
    key = (term * len(bases) + part) * BLOCK_ENTRIES + place
    order = np.argsort(key)
    row = key[order] // BLOCK_ENTRIES
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    told, at = np.divmod(row[starts], len(bases))
    cuts = pa.array(np.append(starts, len(row)).astype(np.int32))
    return told_keys, pa.table({
        "field": fields.dictionary.take(pa.array(told // n_words)), "term": words.dictionary.take(pa.array(told % n_words)),
        "base": pa.array((at * BLOCK_ENTRIES).astype(np.int32)), "places": pa.ListArray.from_arrays(cuts, pa.array(place[order].astype(np.int16))),
        "tfs": pa.ListArray.from_arrays(cuts, own["tfs"].flatten().take(pa.array(order)))})


def _inverted_rows(block: int, shelf: int, told: pa.RecordBatch) -> pa.RecordBatch:
    key = pa.struct([*[(c, pa.string()) for c in (*POSTING_KEYS, "field")], ("dl", pa.int32())])
    types = {"block": pa.int64(), "field": pa.string(), "term": pa.string(), "base": pa.int32(), "places": pa.list_(pa.int16()),
             "tfs": pa.list_(pa.int32()), "keys": pa.list_(key), "shelf": pa.int32()}
    n = told.num_rows
    own = {"block": np.full(n, block), "shelf": np.full(n, shelf)} | {c: told[c] for c in told.schema.names}
    return pa.RecordBatch.from_arrays([pa.array(own[c]).cast(t) if c in own else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def upright(lists: DataFrame) -> DataFrame:
    """Stored lists by term as postings, with their shelf. Filters on shelf and term reach the scan."""
    keys = lists.filter(F.col("shelf") == KEYS_SHELF).select("block", "base", F.posexplode("keys").alias("place", "key"))
    keys = checkpointed(keys.select("block", (F.col("base") + F.col("place")).alias("entry"), *[f"key.{c}" for c in (*POSTING_KEYS, "dl")]), eager=False)
    each = lists.filter(F.col("shelf") != KEYS_SHELF).select(
        "shelf", "block", "field", "term", "base", F.inline(F.arrays_zip("places", "tfs")).alias("place", "tf"))
    return each.withColumn("entry", F.col("base") + F.col("place")).join(keys, ["block", "entry"]) \
        .select(*POSTING_KEYS, "field", "dl", "term", "tf", "shelf")


def doc_len(chunks: DataFrame) -> DataFrame:
    return _fields(chunks).select("id", "field", "dl")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(field, n, avgdl) over the chunks that have the field."""
    return lengths.filter("dl > 0").groupBy("field").agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_df(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))
