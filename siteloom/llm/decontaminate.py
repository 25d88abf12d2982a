"""Benchmark decontamination by winnowed word k-grams.

A training document and a benchmark item that share ``n`` consecutive words share
``n - k + 1`` consecutive k-grams, and so the smallest hash of that window: both sides
keep the minimum of every window of k-grams, the fingerprints are joined, and every
match is extended by up to ``n - k`` words to both sides. All shared spans of ``n``
words are found, whole documents and all items. Items of fewer than ``n`` words are
one window of their own length and are matched by the hash of all their words.

A fingerprint travels with the hashes of the words around it, so matches are verified
and extended in the join and no text is shuffled. Documents first drop fingerprints
that no item has, by a bitmap of fixed size; it only narrows the exact join.

Null or empty texts have no words, are never hit, and items without words match
nothing. Rows repeated in id and text each get the same result. Columns besides id and
text are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import kernel as K
from siteloom.llm.tables import bitmap_of, row_key
from siteloom.scale import lookup_join, written

WINDOW = 10
GRAM = 5

CANDIDATE = pa.struct([("size", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64()), ("near", pa.list_(pa.int64()))])
CANDIDATES = "array<struct<size:int,pos:int,hash:bigint,near:array<bigint>>>"


def winnowed(hashes: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the k-grams that are the minimum of a window of ``window``
    consecutive k-grams of one text; of equal minima all are kept."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = hashes[:n].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j:n + j], out=least)
    least[doc[:n] != doc[window - 1:]] = 0
    padded = np.zeros(len(hashes) + window - 1, dtype=np.uint64)
    padded[window - 1:window - 1 + n] = least
    best = padded[:len(hashes)].copy()
    for j in range(1, window):
        np.maximum(best, padded[j:len(hashes) + j], out=best)
    return np.flatnonzero(best == hashes)


def around(words: K.Words, first: np.ndarray, reach: int, k: int, missing: int) -> np.ndarray:
    """Hashes of the words from ``reach`` before a k-gram to ``reach`` after it; ``missing`` beyond the text."""
    at = first[:, None] + np.arange(-reach, k + reach)[None, :]
    inside = np.clip(at, 0, len(words.hash) - 1)
    own = (at == inside) & (words.doc[inside] == words.doc[first][:, None])
    return np.where(own, K.as_long(words.hash)[inside], missing)


def fingerprints(texts: pa.Array, window: int, k: int, missing: int, keep: K.Bitmap | None, short: dict[int, K.Bitmap] | None
                 ) -> Iterator[tuple[int, np.ndarray, pa.ListArray]]:
    """For each group of texts: how many, their word counts, and their fingerprints. Items
    (``keep`` is None) give all, and their own hash when short; documents those in the bitmaps."""
    for lo, hi, data, offsets in K.groups(texts):
        words = K.words_of(data, offsets, K.ALNUM, lower=True)
        count = words.per_doc()
        begin = np.concatenate([[0], np.cumsum(count)])
        gram, first = K.grams(words, k)
        chosen = winnowed(gram, words.doc[first], window - k + 1)
        if keep is not None:
            chosen = chosen[keep.has(gram[chosen])]
        at = first[chosen]
        parts = [(words.doc[at], np.zeros(len(at), dtype=np.int64), at, gram[chosen],
                  around(words, at, window - k, k, missing) if len(at) else np.zeros((0, window + window - k)))]
        if keep is None:
            few = np.flatnonzero((count > 0) & (count < window))
            parts.append((few, count[few], begin[few], K.whole(words, few), None))
        for size, held in (short or {}).items():
            gram, first = K.grams(words, size)
            found = np.flatnonzero(held.has(gram))
            parts.append((words.doc[first[found]], np.full(len(found), size), first[found], gram[found], None))
        doc = np.concatenate([p[0] for p in parts]).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        near_counts = np.concatenate([np.full(len(p[0]), 0 if p[4] is None else p[4].shape[1]) for p in parts])
        near = np.concatenate([p[4].ravel() for p in parts if p[4] is not None]).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near_counts)]), type=pa.int32()), pa.array(near))
        flat = pa.StructArray.from_arrays([
            pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
            pa.array((np.concatenate([p[2] for p in parts]) - begin[doc]).astype(np.int32)),
            pa.array(K.as_long(np.concatenate([p[3] for p in parts]).astype(np.uint64))), lists], fields=list(CANDIDATE))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))])
        yield hi - lo, count, pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), flat.take(pa.array(order)))


def scan(df: DataFrame, id_column: str, window: int, k: int, missing: int, keep: K.Bitmap | None = None,
         short: dict[int, K.Bitmap] | None = None) -> DataFrame:
    """One row per text: id, row key, word count, fingerprints."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, count, found in fingerprints(batch.column("text"), window, k, missing, keep, short):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, rows), batch.column("row").slice(at, rows), pa.array(count), found],
                    names=["id", "row", "n_words", "found"])
                at += rows

    plain = df.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    return plain.select("id", row_key("id", "text").alias("row"), "text").mapInArrow(
        run, f"id {kind}, row string, n_words bigint, found {CANDIDATES}")


def extended(mine: str, theirs: str, reach: int, k: int) -> tuple[F.Column, F.Column, F.Column]:
    """Whether the k-gram's own words are equal, and how many words before and after it."""
    same = [F.col(mine)[i] == F.col(theirs)[i] for i in range(k + 2 * reach)]
    middle = F.lit(True)
    for e in same[reach:reach + k]:
        middle = middle & e

    def run(tests: list[F.Column]) -> F.Column:
        total, so_far = F.lit(0), F.lit(True)
        for e in tests:
            so_far = so_far & e
            total = total + so_far.cast("int")
        return total

    return middle, run(same[:reach][::-1]), run(same[reach + k:])


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                  window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Per document: id, row key, n_words, n_hit (words inside any shared window), items (ids of the
    items whose windows occur, as sorted strings) and spans (word ranges hit, half open)."""
    reach = window - k
    items = written(scan(benchmark, item_id, window, k, -1).select(
        F.col("id").cast("string").alias("item"), F.explode("found").alias("f")).select("item", "f.*").distinct(), "items")
    keep = bitmap_of(items.filter("size = 0"), "hash")
    sizes = [r["size"] for r in items.filter("size > 0").select("size").distinct().collect()]  # below ``window``
    short = {s: bitmap_of(items.filter(F.col("size") == s), "hash") for s in sizes}
    docs = written(scan(documents, doc_id, window, k, 0, keep, short), "fingerprints")

    theirs = items.select("item", "size", "hash", F.col("near").alias("theirs"))
    mine = docs.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumnRenamed("near", "mine")
    matched = lookup_join(mine, theirs, ["size", "hash"], "inner")
    middle, before, after = extended("mine", "theirs", reach, k)
    hits = (matched.withColumn("before", F.when(F.col("size") == 0, before).otherwise(0))
            .withColumn("after", F.when(F.col("size") == 0, after).otherwise(0))
            .filter((F.col("size") > 0) | (middle & (F.col("before") + F.col("after") >= reach)))
            .select("row", "item", (F.col("pos") - F.col("before")).alias("start"),
                    (F.col("pos") + F.col("after") + F.when(F.col("size") == 0, k).otherwise(F.col("size"))).alias("end")))
    merged = F.aggregate(
        F.array_sort("spans"), F.expr("named_struct('n', 0L, 'reach', -1)"),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("n"),
                                F.greatest(acc["reach"], s["end"]).alias("reach")))["n"]
    found = (hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"),
                                     F.collect_set(F.struct("start", "end")).alias("spans"))
             .select("row", "items", F.array_sort("spans").alias("spans"), merged.alias("n_hit")))
    none = F.array().cast("array<string>")
    return (docs.select("id", "row", "n_words").join(found, "row", "left")
            .select(F.col("id").alias(doc_id), "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("items", none).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")))
