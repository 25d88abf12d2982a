"""Quality scores by histogram gradient-boosted trees over document statistics.

Every whole text becomes one row of plain statistics (``STATISTICS``; nothing but the text is looked at).
Trees are grown by Newton steps of the logistic loss on histograms of binned statistics, on a labelled
sample: the ``SAMPLE`` rows of lowest id hash, the documented bound. A tree is complete, ``DEPTH`` levels deep, so all
trees together are three arrays (statistic, cut, leaf value) and a batch of rows walks all of them at once in
numpy, one level a step. Scoring is one pass over the texts without any shuffle.

Defined results: a null text counts as empty; an empty text has zeros and gets a score. A null id is scored, never
trained on and never held out. Rows whose id is held out, and null labels, train nothing; of several labels of one id
the lowest counts; repeated rows are scored each. Without labels of both kinds every score is the one label's rate (0.5
without any). An empty table gives no rows. Other columns, whatever their names, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm import kernel as K

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
SMOOTH = 1.0
LEAST_WEIGHT = 2.0

STATISTICS = ["words", "lines", "word_length", "longest_word", "distinct_share", "commonest_share", "repeat_share", "dup_line_share",
              "words_per_line", "upper_share", "digit_share", "mark_share", "symbol_share", "bar_share", "space_share", "foreign_share",
              "marked_word_share", "double_mark_share", "line_end_share", "byte_entropy"]

LINE, UPPER, DIGIT, MARK, SYMBOL, END = (np.zeros(256, dtype=bool) for _ in range(6))
LINE[:] = True
LINE[10] = False
UPPER[65:91] = DIGIT[48:58] = True
MARK[list(b".,;:!?'\"()-")] = True
SYMBOL[list(b"#*$%&<>@^~=+_{}[]\\")] = True
END[list(b".!?\"')")] = True


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def most(groups: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Largest value of each group; 0 where it has none."""
    out = np.zeros(rows, dtype=np.int64)
    np.maximum.at(out, groups, values)
    return out


def statistics(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each group of texts: a row per text, a column per name of ``STATISTICS``."""
    for lo, hi, data, offsets in K.groups(texts):
        rows, size = hi - lo, np.diff(offsets)

        def count(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])

        words = K.words_of(data, offsets, K.NOT_SPACE, lower=False)
        per_doc, inside = words.per_doc(), K.NOT_SPACE[data]
        length = words.end - words.start
        distinct, often = np.unique((words.doc.astype(np.uint64) << np.uint64(54)) | (words.hash >> np.uint64(10)), return_counts=True)
        of = (distinct >> np.uint64(54)).astype(np.int64)
        gram, first = K.grams(words, 3)
        grams = np.bincount(words.doc[first], minlength=rows)
        different = np.unique((words.doc[first].astype(np.uint64) << np.uint64(54)) | (gram >> np.uint64(10))) >> np.uint64(54)
        repeats = grams - np.bincount(different.astype(np.int64), minlength=rows)

        lines = K.words_of(data, offsets, LINE, lower=False)
        filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        said = np.flatnonzero(filled[lines.end] > filled[lines.start])
        line_doc = lines.doc[said]
        n_lines = np.bincount(line_doc, minlength=rows)
        different = np.unique((line_doc.astype(np.uint64) << np.uint64(54)) | (lines.hash[said] >> np.uint64(10))) >> np.uint64(54)
        dup_lines = n_lines - np.bincount(different.astype(np.int64), minlength=rows)
        ended = np.bincount(line_doc, weights=END[data[lines.end[said] - 1]], minlength=rows)

        symbols = SYMBOL[data]
        marked = np.concatenate([[0], np.cumsum(symbols, dtype=np.int64)])
        marked_words = np.bincount(words.doc, weights=marked[words.end] > marked[words.start], minlength=rows)
        odd = symbols | MARK[data]
        twice = np.zeros(len(data), dtype=bool)
        twice[1:] = odd[1:] & (data[1:] == data[:-1])

        doc = np.repeat(np.arange(rows), size)
        seen = np.bincount(doc * 256 + data, minlength=rows * 256).reshape(rows, 256)
        p = seen / np.maximum(size, 1)[:, None]
        entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)

        letters = count(inside)
        yield np.column_stack([
            per_doc, n_lines, share(np.bincount(words.doc, weights=length, minlength=rows), per_doc), most(words.doc, length, rows),
            share(np.bincount(of, minlength=rows), per_doc), share(most(of, often, rows), per_doc), share(repeats, grams),
            share(dup_lines, n_lines), share(per_doc, n_lines), share(count(UPPER[data]), letters), share(count(DIGIT[data]), letters),
            share(count(MARK[data]), letters), share(count(symbols), letters), share(count(data == 0x7C), letters),
            share(size - letters, size), share(count(data >= 0x80), letters), share(marked_words, per_doc), share(count(twice), letters),
            share(ended, n_lines), entropy]).astype(float)


@dataclass(frozen=True)
class Trees:
    """Complete trees in arrays: ``feature`` and ``cut`` (trees x inner nodes, level by level), ``leaf`` (trees x leaves)
    and the log odds that all rows start from."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(rows), self.start)
        if len(self.leaf):
            tree, row = np.arange(len(self.leaf)), np.arange(len(rows))[:, None]
            node = np.zeros((len(rows), len(tree)), dtype=np.int64)
            inner = self.feature.shape[1]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (rows[row, self.feature[tree, node]] > self.cut[tree, node])
            total += self.leaf[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def cuts_of(column: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts between different values, by quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: statistic and cut of each inner node, value of each leaf, and the leaf of each row."""
    features, inner = binned.shape[1], (1 << depth) - 1
    bins = max(map(len, cuts)) + 1
    feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(binned), dtype=np.int64)
    for level in range(depth):
        first, wide = (1 << level) - 1, 1 << level
        gain = np.full((features, wide, bins), -np.inf)
        for f in range(features):
            at = (node - first) * bins + binned[:, f]
            g = np.bincount(at, weights=gradient, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
            h = np.bincount(at, weights=weight, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
            g_all, h_all = g[:, -1:], h[:, -1:]
            own = g ** 2 / (h + SMOOTH) + (g_all - g) ** 2 / (h_all - h + SMOOTH) - g_all ** 2 / (h_all + SMOOTH)
            usable = (h >= LEAST_WEIGHT) & (h_all - h >= LEAST_WEIGHT) & (np.arange(bins) < len(cuts[f]))
            gain[f] = np.where(usable, own, -np.inf)
        best = gain.transpose(1, 0, 2).reshape(wide, -1).argmax(axis=1)
        for n in range(wide):
            f, b = divmod(int(best[n]), bins)
            if gain[f, n, b] > 1e-9:
                feature[first + n], cut[first + n] = f, cuts[f][b]
        bound = np.array([np.searchsorted(cuts[f], c) if np.isfinite(c) else bins for f, c in zip(feature, cut, strict=True)])
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > bound[node])
    leaf = node - inner
    g = np.bincount(leaf, weights=gradient, minlength=inner + 1)
    h = np.bincount(leaf, weights=weight, minlength=inner + 1)
    return feature, cut, g / (h + SMOOTH), leaf


def fit(rows: np.ndarray, label: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosted trees for the probability of label 1."""
    rate = float(label.mean()) if len(label) else 0.5
    empty = np.zeros((0, (1 << depth) - 1))
    if rate in (0.0, 1.0) or not len(label):
        odds = {0.0: -20.0, 1.0: 20.0}.get(rate, 0.0)
        return Trees(odds, empty.astype(np.int64), empty, np.zeros((0, 1 << depth)))
    cuts = [cuts_of(rows[:, f], bins) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)])
    start = float(np.log(rate / (1 - rate)))
    total, grown = np.full(len(rows), start), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        feature, cut, value, leaf = grow(binned, cuts, label - p, p * (1 - p), depth)
        total += RATE * value[leaf]
        grown.append((feature, cut, RATE * value))
    return Trees(start, *(np.array(x) for x in zip(*grown, strict=True)))


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether an id belongs to the fold that never trains: crc32 of its text divides by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents that are not held out, of lowest id hash; the same rows give the same trees."""
    chosen = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
              .filter("id is not null and label in (0, 1)").filter(~held_out("id"))
              .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in statistics(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("order").slice(at, len(found)), batch.column("label").slice(at, len(found)),
                     *(pa.array(c) for c in found.T)], names=["order", "label", *STATISTICS])
                at += len(found)

    fields = ", ".join(f"{c} double" for c in STATISTICS)
    table = (texts.select(F.xxhash64("id").alias("order"), "label", "text").mapInArrow(run, f"order bigint, label int, {fields}")
             .orderBy("order", "label", *STATISTICS).limit(sample).toPandas())
    return fit(table[STATISTICS].to_numpy(dtype=float), table["label"].to_numpy(dtype=float))


def scored(documents: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score and predicted (1 from ``threshold`` on)."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in statistics(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(found)), pa.array(trees.score(found))], names=["id", "score"])
                at += len(found)

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(doc_id), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
