"""Hard negatives by an inverted multi-index, exact by certified bounds.

Vectors are cut into two halves, each with a codebook of ``CODES`` centres (k-means on a sample of at most ``SAMPLE`` rows, the
documented bound; every row is indexed). A pair of codes is a cell. The radius of a code is the largest distance of any row's
half to its centre, over all rows, so an anchor's half score with any row of the code is at most ``a.c + |a| r``, and the sum
over both halves bounds its score with every row of the cell.

An anchor visits cells in order of this bound: both lists of half bounds are sorted, and a heap gives the next best sum (multi-sequence).
It stops as soon as each of its windows is certified: full, and its last score above the next bound, or the next bound below the
window. Windows are, first, the ``POSITIVES`` best other rows of the anchor's label; then, for each of these, the ``NEGATIVES`` best rows of other labels
whose score is between ``LOW`` and ``HIGH`` percent of the positive's. So results are exact; codebooks only decide how much is visited.

Rows lie in slabs: at most about ``SLAB_ROWS`` rows of one first code, ordered by the second, dealt by id hash, so a code that
holds most rows is many slabs. Anchors go in blocks of ``BLOCK``; a round sends a block's open anchors to the racks (``RACK`` slabs) of the codes
they visit next, a task multiplies block by slab and returns the best of each window only, and these are merged map-side first.
Each round visits ``GROWTH`` times as many cells in all as the one before; its state is written to the shared folder.

Scores are inner products of whole numbers (``scaled``) in 64-bit floats, exact below 2 ** 53. Ties go to the smaller id.

Defined results: rows with a null id or label, a null or empty vector, a null or non-finite component, or another number of components than
most rows take no part. Rows equal in id, label and vector are one row; rows that share an id only are each other's neither
positive nor negative. An anchor without positives, or without negatives in its windows, has no rows. An empty table gives none. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.scale import lookup_join, top_k, written

SAMPLE = 8192
CODES = 16
STEPS = 10
SLAB_ROWS = 16_384
BLOCK = 512
RACK = 16
FIRST_CELLS = 16
GROWTH = 4
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95

BLOCK_FIELDS = "block int, ids binary, labels binary, vectors binary, low binary, high binary, score binary, id binary"


def scaled(vector: Column, by: int = 256) -> Column:
    """Each component times ``by``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("double"))


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Columns id, label and vector of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(finite).select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector"))
    sizes = whole.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), "size").first()
    return whole.filter(F.size("vector") == (usual["size"] if usual else -1))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def means(points: np.ndarray, codes: int, steps: int = STEPS) -> np.ndarray:
    """k-means from the first different points on; an empty centre stays where it is."""
    first = np.sort(np.unique(points, axis=0, return_index=True)[1])[:codes]
    centres = points[first]
    for _ in range(steps):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


@dataclass
class Index:
    """Both codebooks, their radii, which cells have rows (codes x codes), and how many racks each first code has."""

    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    filled: np.ndarray
    racks: np.ndarray

    def half_bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: highest and lowest score with any row of each code, with room for rounding."""
        cut = self.halves[0].shape[1]
        out = []
        for part, centres, radius in zip((vectors[:, :cut], vectors[:, cut:]), self.halves, self.radii, strict=True):
            middle, reach = part @ centres.T, np.linalg.norm(part, axis=1)[:, None] * radius[None, :]
            reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
            out.append((middle + reach, middle - reach))
        return out


def best_sums(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of places of two lists with their sums, highest sum first, by the multi-sequence heap."""
    order = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    heap, seen = [(-(first[order[0][0]] + second[order[1][0]]), 0, 0)], {(0, 0)}
    while heap:
        total, a, b = heapq.heappop(heap)
        yield -total, order[0][a], order[1][b]
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(order[0]) and y < len(order[1]) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[order[0][x]] + second[order[1][y]]), x, y))


@dataclass
class Block:
    """Anchors of one block: their windows (low, high: anchors x windows) and the best found (score, id: anchors x windows x k)."""

    block: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray
    id: np.ndarray

    def record(self) -> list:
        return [self.block, *(np.ascontiguousarray(x).tobytes() for x in (
            self.ids, self.labels, self.vectors, self.low, self.high, self.score, self.id))]

    def table(self) -> pa.Table:
        names = [f.split(" ")[0] for f in BLOCK_FIELDS.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
        return pa.table([pa.array([x], type=t) for x, t in zip(self.record(), kinds, strict=True)], names=names)

    @staticmethod
    def read(row: dict) -> Block:
        ids, labels = (np.frombuffer(row[k], dtype=np.int64) for k in ("ids", "labels"))
        n = len(ids)
        low, high = (np.frombuffer(row[k]).reshape(n, -1) for k in ("low", "high"))
        score, found = np.frombuffer(row["score"]), np.frombuffer(row["id"], dtype=np.int64)
        return Block(row["block"], ids, labels, np.frombuffer(row["vectors"]).reshape(n, -1), low, high,
                     score.reshape(*low.shape, -1), found.reshape(*low.shape, -1))


def next_cells(block: Block, index: Index, begin: int, end: int) -> dict[int, dict[int, list[int]]]:
    """For each first code: the anchors (by place) that visit it between their ``begin``-th and ``end``-th cell, and the second codes they want."""
    (high_1, low_1), (high_2, low_2) = index.half_bounds(block.vectors)
    need = np.maximum(block.low, block.score[:, :, -1])
    out: dict[int, dict[int, list[int]]] = {}
    for at in range(len(block.ids)):
        least, below = need[at].min(), block.high[at].max()
        for number, (bound, i, j) in enumerate(best_sums(high_1[at], high_2[at])):
            if number >= end or bound < least:
                break
            if number >= begin and index.filled[i, j]:
                wanted = (bound >= need[at]) & (low_1[at, i] + low_2[at, j] <= block.high[at])
                if wanted.any() and low_1[at, i] + low_2[at, j] <= below:
                    out.setdefault(i, {}).setdefault(at, []).append(j)
    return out


def visits(blocks: DataFrame, index: Index, begin: int, end: int) -> DataFrame:
    """One row per block, first code and rack visited next: the anchors with their wanted second codes."""
    codes = len(index.halves[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                for i, anchors in next_cells(block, index, begin, end).items():
                    at = np.array(list(anchors), dtype=np.int64)
                    cells = np.zeros((len(at), codes), dtype=bool)
                    for n, second in enumerate(anchors.values()):
                        cells[n, second] = True
                    need = np.maximum(block.low, block.score[:, :, -1])[at]
                    own = [at, cells, block.ids[at], block.labels[at], block.vectors[at], need, block.high[at]]
                    data = [np.ascontiguousarray(x).tobytes() for x in own]
                    for rack in range(int(index.racks[i])):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i], type=pa.int32()), pa.array([rack], type=pa.int32()), pa.array([block.block], type=pa.int32()),
                             *(pa.array([x], type=pa.binary()) for x in data)],
                            names=["shelf", "rack", "block", "at", "cells", "ids", "labels", "vectors", "low", "high"])

    return blocks.mapInArrow(run, "shelf int, rack int, block int, at binary, cells binary, ids binary, labels binary, vectors binary, "
                                  "low binary, high binary")


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` columns of each row by falling score, of equal ones the first: row, column, score. Columns at minus infinity are none."""
    found = []
    for _ in range(min(k, score.shape[1])):
        column = score.argmax(axis=1)
        value = score[np.arange(len(score)), column]
        row = np.flatnonzero(value > -np.inf)
        if not len(row):
            break
        found.append((row, column[row], value[row]))
        score[row, column[row]] = -np.inf
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)


def hits_in(slab: dict, visit: dict, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """Block places, windows, scores and ids of the best rows of one slab for one block."""
    rows, labels = (np.frombuffer(slab[c], dtype=np.int64) for c in ("ids", "labels"))
    vectors, starts = np.frombuffer(slab["vectors"]).reshape(len(rows), -1), np.frombuffer(slab["starts"], dtype=np.int64)
    at, ids, own = (np.frombuffer(visit[c], dtype=np.int64) for c in ("at", "ids", "labels"))
    cells = np.frombuffer(visit["cells"], dtype=bool).reshape(len(at), -1)
    anchors, low, high = (np.frombuffer(visit[c]).reshape(len(at), -1) for c in ("vectors", "low", "high"))
    out = []
    for j in range(cells.shape[1]):
        who, part = np.flatnonzero(cells[:, j]), slice(int(starts[j]), int(starts[j + 1]))
        if not len(who) or part.start == part.stop:
            continue
        score = anchors[who] @ vectors[part].T
        fits = (own[who][:, None] == labels[part][None, :]) == same
        fits &= ids[who][:, None] != rows[part][None, :]
        for w in range(low.shape[1]):
            inside = fits & (score >= low[who, w][:, None]) & (score <= high[who, w][:, None])
            some = np.flatnonzero(inside.any(axis=1))
            row, column, value = best(np.where(inside[some], score[some], -np.inf), k)
            out.append((at[who[some[row]]], np.full(len(row), w), value, rows[part][column]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
    place, window, value, found = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((found, -value, window, place))
    place, window, value, found = place[order], window[order], value[order], found[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1])
    rank = np.arange(len(place)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(place) else place
    first = rank < k
    return place[first], window[first], value[first], found[first]


def hits(slabs: DataFrame, wanted: DataFrame, same: bool, k: int) -> DataFrame:
    """Candidates (block, at, window, score, id) of all slabs that are visited."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                slab, visit = batch.column("slab")[n].as_py(), batch.column("visit")[n].as_py()
                place, window, value, found = hits_in(slab, visit, same, k)
                if len(place):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(place), visit["block"]), type=pa.int32()), pa.array(place, type=pa.int32()),
                         pa.array(window, type=pa.int32()), pa.array(value), pa.array(found)], names=["block", "at", "window", "score", "id"])

    left = slabs.select("shelf", "rack", F.struct("ids", "labels", "vectors", "starts").alias("slab"))
    right = wanted.select("shelf", "rack", F.struct("block", "at", "cells", "ids", "labels", "vectors", "low", "high").alias("visit"))
    return lookup_join(left, right, ["shelf", "rack"], "inner").select("slab", "visit").mapInArrow(
        run, "block int, at int, window int, score double, id bigint")


def merged(block: pa.Table, found: pa.Table, k: int) -> pa.Table:
    """A block with the best of what it had and what a round found."""
    own = Block.read(block.to_pylist()[0])
    n, windows = own.low.shape
    at, window, value, ids = (found.column(c).to_numpy() for c in ("at", "window", "score", "id"))
    place = np.concatenate([np.repeat(np.arange(n * windows), k), at.astype(np.int64) * windows + window])
    value, ids = np.concatenate([own.score.ravel(), value]), np.concatenate([own.id.ravel(), ids])
    order = np.lexsort((ids, -value, place))
    place, value, ids = place[order], value[order], ids[order]
    begin = np.searchsorted(place, np.arange(n * windows))
    first = (begin[:, None] + np.arange(k)).ravel()
    own.score, own.id = value[first].reshape(n, windows, k), ids[first].reshape(n, windows, k)
    return own.table()


def searched(blocks: DataFrame, slabs: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """The blocks when every window of every anchor is certified."""
    cells, begin, end = index.filled.size, 0, min(FIRST_CELLS, index.filled.size)
    while True:
        wanted = written(visits(blocks, index, begin, end), "visits")
        if not wanted.isEmpty():
            found = top_k(hits(slabs, wanted, same, k), ["block", "at", "window"], [F.desc("score"), F.col("id")], k)
            blocks = written(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
                lambda a, b: merged(a, b, k), BLOCK_FIELDS), "blocks")
        if end == cells:
            return blocks
        begin, end = end, min(end * GROWTH, cells)


def index_of(rows: DataFrame, codes: int, sample: int) -> tuple[DataFrame, Index]:
    """All rows with their codes and distances, written; and the index (racks still to be set by ``slabs_of``)."""
    taken = rows.orderBy(F.xxhash64("id"), "id", "label", "vector").limit(sample).select("vector").toPandas()["vector"]
    points = np.array(taken.to_list(), dtype=float)
    cut = points.shape[1] // 2
    halves = means(points[:, :cut], codes), means(points[:, cut:], codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("vector"))
            columns = []
            for part, centres in ((points[:, :cut], halves[0]), (points[:, cut:], halves[1])):
                code = nearest(part, centres)
                columns.append((code, np.linalg.norm(part - centres[code], axis=1)))
            (i, far_1), (j, far_2) = columns
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("vector"), pa.array(i, type=pa.int32()),
                 pa.array(j, type=pa.int32()), pa.array(far_1), pa.array(far_2)], names=["id", "label", "vector", "shelf", "code", "far_1", "far_2"])

    coded = written(rows.mapInArrow(run, "id bigint, label bigint, vector array<double>, shelf int, code int, far_1 double, far_2 double"), "coded")
    cells = coded.groupBy("shelf", "code").agg(  # at most codes ** 2 rows
        F.count(F.lit(1)).alias("n"), F.max("far_1").alias("far_1"), F.max("far_2").alias("far_2")).toPandas()
    radii = np.zeros(len(halves[0])), np.zeros(len(halves[1]))
    count = np.zeros((len(halves[0]), len(halves[1])), dtype=np.int64)
    for c in cells.itertuples():
        count[c.shelf, c.code] = c.n
        radii[0][c.shelf], radii[1][c.code] = max(radii[0][c.shelf], c.far_1), max(radii[1][c.code], c.far_2)
    return coded, Index(halves, radii, count > 0, -(-count.sum(axis=1) // SLAB_ROWS))


def slabs_of(coded: DataFrame, index: Index) -> DataFrame:
    """Rows packed by first code and id hash, ordered by second code and id, each row once."""
    codes, slabs = len(index.halves[1]), np.maximum(index.racks, 1)
    index.racks = -(-slabs // RACK)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("vector").combine_chunks())
        ids, labels, code = (table.column(c).to_numpy() for c in ("id", "label", "code"))
        order = np.lexsort((*vectors.T[::-1], labels, ids, code))
        ids, labels, code, vectors = ids[order], labels[order], code[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        starts = np.searchsorted(code[new], np.arange(codes + 1))
        data = [x.tobytes() for x in (ids[new], labels[new], np.ascontiguousarray(vectors[new]), starts)]
        return pa.table([pa.array([key[0].as_py()], type=pa.int32()), pa.array([key[1].as_py() // RACK], type=pa.int32()),
                         *(pa.array([x], type=pa.binary()) for x in data)], names=["shelf", "rack", "ids", "labels", "vectors", "starts"])

    number = F.element_at(F.array(*[F.lit(int(s)) for s in slabs]), F.col("shelf") + 1)
    dealt = coded.select("id", "label", "vector", "shelf", "code", F.pmod(F.xxhash64("id"), number).cast("int").alias("slab"))
    return written(dealt.groupBy("shelf", "slab").applyInArrow(
        pack, "shelf int, rack int, ids binary, labels binary, vectors binary, starts binary"), "slabs")


def blocks_of(anchors: DataFrame, positives: int) -> DataFrame:
    """Anchors in blocks, each with one open window for its positives."""
    own = written(anchors.dropDuplicates(), "anchors")
    many = -(-own.count() // BLOCK) or 1

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        vectors, n = matrix(table.column("vector").combine_chunks()), len(ids)
        order = np.lexsort((*vectors.T[::-1], labels, ids))
        return Block(key[0].as_py(), ids[order], labels[order], vectors[order], np.full((n, 1), -np.inf), np.full((n, 1), np.inf),
                     np.full((n, 1, positives), -np.inf), np.zeros((n, 1, positives), dtype=np.int64)).table()

    return written(own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).groupBy("block").applyInArrow(
        pack, BLOCK_FIELDS), "blocks")


def windows_of(blocks: DataFrame, low: int, high: int, negatives: int) -> DataFrame:
    """Each anchor with a window per positive: ids and scores of positives stand in front of the windows' own fields."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block.read(row)
                score = own.score[:, 0, :]
                there = np.isfinite(score)
                whole = np.where(there, score, 0).astype(np.int64)
                least, most = -((-low * whole) // 100), (high * whole) // 100
                shape = (*score.shape, negatives)
                new = Block(own.block, own.ids, own.labels, own.vectors, np.where(there, least, np.inf), np.where(there, most, -np.inf),
                            np.full(shape, -np.inf), np.zeros(shape, dtype=np.int64))
                out = new.table()
                for name, data in (("positive_score", whole), ("positive_id", own.id[:, 0, :])):
                    out = out.append_column(name, pa.array([np.ascontiguousarray(data).tobytes()], type=pa.binary()))
                yield from out.to_batches()

    return blocks.mapInArrow(run, BLOCK_FIELDS + ", positive_score binary, positive_id binary")


def listed(blocks: DataFrame, positives: DataFrame) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of certified windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block.read(row)
                at, window, rank = np.nonzero(np.isfinite(own.score))
                score, ids = (np.frombuffer(row[c], dtype=np.int64).reshape(own.low.shape) for c in ("positive_score", "positive_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.ids[at]), pa.array(ids[at, window]), pa.array(rank + 1, type=pa.int32()), pa.array(own.id[at, window, rank]),
                     pa.array(score[at, window]), pa.array(own.score[at, window, rank].astype(np.int64))],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return blocks.join(positives.select("block", "positive_score", "positive_id"), "block").mapInArrow(
        run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def mined(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "vector", label: str = "label", codes: int = CODES,
          sample: int = SAMPLE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of every anchor (``is_anchor``: a condition on column ``id``) and each of its positives; vectors are whole numbers."""
    clean = usable(rows, vec_id, vector, label)
    spark: SparkSession = rows.sparkSession
    if clean.isEmpty():
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                                         "negative_score bigint")
    coded, index = index_of(clean, codes, sample)
    slabs = slabs_of(coded, index)
    anchors = blocks_of(coded.filter(is_anchor).select("id", "label", "vector"), positives)
    found = searched(anchors, slabs, index, same=True, k=positives)
    windows = written(windows_of(found, low, high, negatives), "windows")
    return listed(searched(windows.drop("positive_score", "positive_id"), slabs, index, same=False, k=negatives), windows)
