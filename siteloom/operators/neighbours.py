"""Vector leg: exact and cell-pruned cosine neighbours.

Every task keeps its own best ``k`` per query while it streams over its Arrow
batches, so pairs are never emitted: a task returns at most queries * k rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.scale import checkpointed, is_small, top_k, written
from siteloom.schemas import FILTER_FIELDS

QUERY_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
SCORE_CELLS = 4 * 1024 * 1024
SENT_QUERIES, BLOCK_VECTORS, MOST_TASKS = 2000, 128 * 1024, 8192
PACK_ROWS, PACK_BYTES = 1024, 4 * 1024 * 1024
# Queries and rows of a product, rows of the first one, pairs scored at a time, and the share of pairs from which on all are.
TILE, FIRST_ROWS, PAIRS, DENSE = 1024, 256, 16 * 1024, 16
_OUT = "qid bigint, id string, score double"
_OUT_SCHEMA = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("score", pa.float64())])
# A key has the number of a row in its lowest bits and the score above them, at most 2 in millionths below 1.
_ONE, _NUMBER_BITS, _KEY_BITS = 1_000_000, 20, 42
_NUMBERS, _NONE = (1 << _NUMBER_BITS) - 1, (1 << _KEY_BITS) - 1


class _Best:
    """Running best k of a set of queries."""

    def __init__(self, queries: pd.DataFrame, k: int) -> None:
        self.k = k
        self.qids = queries["qid"].to_numpy()
        self.matrix = _unit(np.stack(queries["vector"].to_numpy()).astype(np.float64))
        wanted = [f for f in FILTER_FIELDS if f in queries]
        self.filters = [tuple((f, v) for f, v in zip(wanted, row) if v is not None)
                        for row in zip(*(queries[f] for f in wanted))] or [()] * len(queries)
        self.cells = [list(c) for c in queries["cells"]] if "cells" in queries else None
        self.best = [(np.empty(0), np.empty(0, dtype=object)) for _ in self.qids]

    def _passing(self, columns: dict[str, np.ndarray], usable: np.ndarray) -> dict[tuple, np.ndarray]:
        """Row mask of every distinct filter."""
        masks = {}
        for wanted in set(self.filters):
            mask = usable.copy()
            for field, value in wanted:
                mask &= columns[field] == value
            masks[wanted] = mask
        return masks

    def add(self, ids: np.ndarray, vectors: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        usable = (vectors != 0).any(axis=1)
        scores = np.round(self.matrix @ _unit(vectors).T, 6)
        passing = self._passing(columns, usable)
        least = np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.best])
        for q in np.flatnonzero(scores.max(axis=1) >= least) if len(ids) else ():
            fits = passing[self.filters[q]]
            if self.cells is not None:
                fits = fits & np.isin(columns["cell"], self.cells[q])
            kept_scores, kept_ids = self.best[q]
            if len(kept_scores) == self.k:
                fits = fits & (scores[q] >= kept_scores[-1])
            rows = np.flatnonzero(fits)
            if len(rows) > self.k:
                found = scores[q, rows]
                rows = rows[found >= np.partition(found, -self.k)[-self.k]]
            if len(rows):
                merged = np.concatenate([kept_scores, scores[q, rows]])
                names = np.concatenate([kept_ids, ids[rows]])
                order = np.lexsort((names.astype(str), -merged))[:self.k]
                self.best[q] = merged[order], names[order]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({
            "qid": np.repeat(self.qids, [len(s) for s, _ in self.best]),
            "id": np.concatenate([n for _, n in self.best]) if self.best else [],
            "score": np.concatenate([s for s, _ in self.best]) if self.best else []})


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1.0, norm)


def _columns(chunks: DataFrame, queries: DataFrame) -> list[Column]:
    extra = [c for c in (*FILTER_FIELDS, "cell") if c in chunks.columns]
    used = [c for c in extra if c in queries.columns or c == "cell"]
    return [F.col("id").cast("string").alias("id"), "vector", *used]


def knn(queries: DataFrame, chunks: DataFrame, k: int = 50,
        max_query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, id, score, rank): the exact k nearest chunks of every query.

    Queries carry ``vector``, optional filter columns and optional ``cells``.
    A query batch of measured small size and at most ``SENT_QUERIES`` rows is sent to every task, so chunks never
    move. A larger one is cut into blocks and co-grouped with blocks of chunks, whose number grows with
    queries times chunks, so no task grows.
    Scores are rounded to 6 places before ranking; ties go to the lower id.
    """
    queries = checkpointed(queries.filter("vector is not null").filter(F.exists("vector", lambda x: x != 0)))
    rows = chunks.select(*_columns(chunks, queries)).filter("vector is not null")
    few = queries.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES
    run = _knn_sent if few and is_small(queries, max_query_bytes) else _knn_blocks
    found = run(queries, rows, k)
    return top_k(found, ["qid"], [F.desc("score"), F.asc("id")], k)


def _knn_sent(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(queries.toPandas())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value.empty:
            return
        best = _Best(sent.value, k)
        step = max(1, SCORE_CELLS // len(sent.value))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                vectors = batch["vector"].flatten().to_numpy().reshape(batch.num_rows, -1)
                columns = {n: batch[n].to_numpy(zero_copy_only=False) for n in batch.schema.names
                           if n not in ("id", "vector")}
                best.add(batch["id"].to_numpy(zero_copy_only=False), vectors.astype(np.float64), columns)
        yield pa.RecordBatch.from_pandas(best.rows(), schema=pa.schema(
            [("qid", pa.int64()), ("id", pa.string()), ("score", pa.float64())]), preserve_index=False)

    return rows.mapInArrow(search, _OUT)


def _knn_blocks(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Every block of queries meets every block of chunks exactly once. Blocks
    hold ``BLOCK_BYTES`` of vectors and about ``BLOCK_VECTORS`` of them at most, and travel in packs of rows, so vectors
    are not taken apart on the way. Blocks of queries are as many as all cores need, as they return ``k`` rows per
    query and block of chunks. Pairs of blocks are dealt over more partitions than there are pairs, as hashes collide."""
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def blocks(df: DataFrame, most: int, per_row: int = 0) -> tuple[int, int]:
        size, n = df.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8, F.count(F.lit(1))).first()
        return n, max(1, -(-size // most), -(-n // BLOCK_VECTORS), -(-n * per_row // SCORE_CELLS))

    (queries_n, n_query), (rows_n, n_chunk) = blocks(queries, BLOCK_BYTES // 4, k), blocks(rows, BLOCK_BYTES)
    if queries_n > SENT_QUERIES:
        n_query = max(n_query, -(-2 * cores // n_chunk))
    tasks = min(4 * n_query * n_chunk, MOST_TASKS)
    every_query = F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(n_chunk - 1)))
    left = _packs(queries, "_q", n_query, queries_n).withColumn("_c", every_chunk)
    right = _packs(rows, "_c", n_chunk, rows_n).withColumn("_q", every_query)

    def search(some_queries: pa.Table, some_rows: pa.Table) -> pa.Table:
        if not (some_queries.num_rows and some_rows.num_rows):
            return _OUT_SCHEMA.empty_table()
        return _best_pairs(_unpacked(some_queries), _unpacked(some_rows), k)

    pairs = [df.repartition(tasks, "_q", "_c").groupBy("_q", "_c") for df in (left, right)]
    return pairs[0].cogroup(pairs[1]).applyInArrow(search, _OUT)


def _packs(df: DataFrame, block: str, blocks: int, rows: int) -> DataFrame:
    """(block, pack): rows as Arrow bytes, dealt over the blocks pack by pack. They are written, as each is read by many
    tasks that must find the same rows in it."""
    most = max(1, min(PACK_ROWS, BLOCK_VECTORS, -(-rows // blocks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            wide = max(1, PACK_BYTES // max(1, batch.nbytes // max(1, batch.num_rows)))
            step = min(most, wide)
            for part in (batch.slice(start, step) for start in range(0, batch.num_rows, step)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_pydict({block: pa.array([at % blocks], pa.int32()), "pack": [sink.getvalue().to_pybytes()]})
                at += 1

    return written(df.mapInArrow(pack, f"{block} int, pack binary"), "packs")


def _unpacked(packs: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs["pack"]]).combine_chunks()


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _best_pairs(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of ``rows`` for each query. Rows are numbered by id, so that an integer of score and number stands
    for the place of a pair, and are looked at in random order, so that good ones come early."""
    rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_start"))
    right = _matrix(rows["vector"])
    usable = (right != 0).any(axis=1)
    left, right = _unit(_matrix(queries["vector"])), _unit(right)
    usable &= np.isfinite(right).all(axis=1)
    asking = np.isfinite(left).all(axis=1)
    near = _Near(left, right, k)
    fields = [f for f in FILTER_FIELDS if f in queries.column_names]
    wanted = list(zip(*(queries[f].to_pylist() for f in fields))) or [()] * len(left)
    same: dict[tuple, list[int]] = {}
    for q in np.flatnonzero(asking).tolist():
        same.setdefault(wanted[q], []).append(q)
    deal, found = np.random.default_rng(0), []
    for kind, own in same.items():
        fits = usable.copy()
        for field, value in zip(fields, kind):
            if value is not None:
                fits &= pc.fill_null(pc.equal(rows[field], value), False).to_numpy()
        order = deal.permutation(np.flatnonzero(fits))
        for tile in (np.array(own[at:at + TILE]) for at in range(0, len(own), TILE)):
            found.append((tile, near.best(tile, _probed(queries, rows, tile, order))))
    at = [(tile.repeat(k), best.ravel()) for tile, best in found]
    q, key = (np.concatenate([part[i] for part in at] or [np.empty(0, np.int64)]) for i in (0, 1))
    q, key = q[key != _NONE], key[key != _NONE]
    return pa.Table.from_arrays([queries["qid"].take(pa.array(q)), rows["id"].take(pa.array(key & _NUMBERS)),
                                 pa.array((_ONE - (key >> _NUMBER_BITS)) / _ONE)], schema=_OUT_SCHEMA)


def _probed(queries: pa.Table, rows: pa.Table, tile: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the tile, rows) that meet: all, or those of each cell that is probed."""
    if "cells" not in queries.column_names:
        yield np.arange(len(tile)), order
        return
    cells = queries["cells"].take(pa.array(tile)).combine_chunks()
    place = np.repeat(np.arange(len(tile)), cells.value_lengths().to_numpy(zero_copy_only=False))
    asked, stands = cells.flatten().to_numpy(zero_copy_only=False), rows["cell"].to_numpy()[order]
    by_asked, by_row = np.argsort(asked, kind="stable"), np.argsort(stands, kind="stable")
    asked, stands = asked[by_asked], stands[by_row]
    for cell in np.unique(asked):
        some, here = (slice(*np.searchsorted(of, [cell, cell + 1])) for of in (asked, stands))
        if here.start < here.stop:
            yield np.unique(place[by_asked[some]]), order[by_row[here]]


class _Near:
    """Best pairs of unit vectors. Products in single precision, whose error is bounded, leave out what cannot be among the
    best; the rest is scored in double precision. Where much is left, as copies of one vector leave, so are all."""

    def __init__(self, left: np.ndarray, right: np.ndarray, k: int) -> None:
        self.left, self.right, self.k = left, right, k
        self.narrow = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32))
        # Half a step of the rounded score and twice the bound of the error of a sum of products.
        self.slack = 1 / _ONE + (left.shape[1] + 16) * 2.0 ** -23

    def best(self, tile: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The keys of the best ``k`` of every query of the tile, lowest first."""
        best, waiting, n_waiting = np.full((len(tile), self.k), _NONE), [], 0
        for some, order in parts:
            queries, at = tile[some], 0
            narrow = self.narrow[0][queries]
            while at < len(order):
                least = best[some, -1]
                new = (least == _NONE).any()
                rows = order[at:at + (max(FIRST_ROWS, self.k) if new else TILE)]
                at += len(rows)
                if not new:
                    floor = (1 - (least >> _NUMBER_BITS) / _ONE - self.slack).astype(np.float32)
                    hits = _true((narrow @ self.narrow[1][rows].T) >= floor[:, None])
                    if len(hits) * DENSE <= len(queries) * len(rows):
                        q, r = np.divmod(hits, len(rows))
                        key = self._keys(queries[q], rows[r])
                        good = key < least[q]
                        waiting.append((some[q[good]] << _KEY_BITS) | key[good])
                        n_waiting += len(waiting[-1])
                        if n_waiting > best.size:
                            _merge(best, waiting)
                            n_waiting = 0
                        continue
                scores = self.left[queries] @ self.right[rows].T
                grown = np.concatenate([best[some], _key(scores, rows)], axis=1)
                grown.partition(self.k - 1, axis=1)
                best[some] = np.sort(grown[:, :self.k], axis=1)
        _merge(best, waiting)
        return best

    def _keys(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Keys of single pairs."""
        found = [np.einsum("ij,ij->i", self.left[queries[at:at + PAIRS]], self.right[rows[at:at + PAIRS]]) for at in range(0, len(queries), PAIRS)]
        return _key(np.concatenate(found), rows) if found else np.empty(0, np.int64)


def _key(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Falling score, rounded to 6 places, then row."""
    return (_ONE - np.rint(scores * _ONE).astype(np.int64) << _NUMBER_BITS) + rows


def _true(hits: np.ndarray) -> np.ndarray:
    """Places of the few true values, eight looked at together."""
    flat = hits.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    near = (np.flatnonzero(flat.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
    return near[flat[near]]


def _merge(best: np.ndarray, waiting: list[np.ndarray]) -> None:
    """Put waiting keys, with the place of their query above them, into the lists of their queries."""
    new = np.concatenate([*waiting, np.empty(0, np.int64)])
    waiting.clear()
    who = np.unique(new >> _KEY_BITS)
    grown = np.concatenate([((who[:, None] << _KEY_BITS) | best[who]).ravel(), new])
    grown.sort()
    first = np.searchsorted(grown, who << _KEY_BITS)
    best[who] = grown[first[:, None] + np.arange(best.shape[1])] & _NONE


def train_cells(chunks: DataFrame, cells: int, seed: int = 42, max_iter: int = 10) -> np.ndarray:
    """Centres of ``cells`` groups of unit vectors. Their number is a setting,
    so the array sent to tasks does not grow with the data."""
    unit = chunks.filter("vector is not null").select(
        array_to_vector(_unit_column("vector")).alias("features")).persist()
    try:
        model = KMeans(k=cells, seed=seed, maxIter=max_iter).fit(unit)
    finally:
        unit.unpersist()
    return np.stack(model.clusterCenters())


def _unit_column(vector: str) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("double"))


def nearest_cells(df: DataFrame, centres: np.ndarray, n: int, name: str = "cells") -> DataFrame:
    """Add the numbers of the ``n`` cells nearest to each vector."""
    def nearest(vectors: pa.Array) -> pa.Array:
        matrix = _unit(vectors.flatten().to_numpy().reshape(len(vectors), -1).astype(np.float64))
        away = (centres ** 2).sum(axis=1) - 2 * matrix @ centres.T
        order = np.argsort(away, axis=1, kind="stable")[:, :n].astype(np.int32)
        offsets = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel()))
    return df.withColumn(name, F.arrow_udf(nearest, "array<int>")(F.col("vector")))


def chosen_centres(chunks: DataFrame, cells: int, key: str = "id") -> np.ndarray:
    """Centres without training: the unit vectors of the ``cells`` rows whose
    key has the lowest digest."""
    rows = (chunks.filter("vector is not null").select(F.md5(F.col(key).cast("string")).alias("digest"), "vector")
            .orderBy("digest").limit(cells).toPandas())
    return _unit(np.stack(rows["vector"].to_numpy()).astype(np.float64))


def write_cells(chunks: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """Build step: vectors laid out by cell. Queries read only the cells they probe."""
    placed = assign_cells(chunks, centres)
    placed.write.partitionBy("cell").parquet(path)
    return placed.sparkSession.read.parquet(path)


def assign_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``cell``; written with ``partitionBy('cell')`` it prunes the scan."""
    placed = nearest_cells(chunks.filter("vector is not null"), centres, 1, "_cells")
    return placed.withColumn("cell", F.element_at("_cells", 1)).drop("_cells")


def knn_approx(queries: DataFrame, placed: DataFrame, centres: np.ndarray, probes: int,
               k: int = 50) -> DataFrame:
    """Neighbours from the ``probes`` cells nearest to each query only. The
    cells that any query probes become a partition filter on the scan."""
    probing = nearest_cells(queries.filter("vector is not null"), centres, probes)
    used = [r[0] for r in probing.select(F.explode("cells").alias("c")).distinct().collect()]
    return knn(probing, placed.filter(F.col("cell").isin(used)), k)


@dataclass(frozen=True)
class Cells:
    """Vectors laid out by cell (``write_cells``), the centres, and how many cells a query reads; ``probes_for``
    gives a number that reaches a wanted recall."""

    placed: DataFrame
    centres: np.ndarray
    probes: int


def recalls(asked: DataFrame, placed: DataFrame, centres: np.ndarray, k: int = 50) -> list[float]:
    """Share of the exact neighbours of ``asked`` that lie in the nearest 1, 2, ... cells; just these
    neighbours are found by ``knn_approx`` with so many probes."""
    order = nearest_cells(asked.filter("vector is not null"), centres, len(centres)).select("qid", "cells")
    exact = knn(asked, placed.drop("cell"), k).select("qid", "id").join(placed.select("id", "cell"), "id").join(order, "qid")
    found = exact.groupBy(F.array_position("cells", F.col("cell")).alias("at")).count().collect()
    share = np.zeros(len(centres))
    for at, n in found:
        share[at - 1] += n
    return (np.cumsum(share) / max(share.sum(), 1)).tolist()


def probes_for(asked: DataFrame, placed: DataFrame, centres: np.ndarray, recall: float = 0.9, k: int = 50) -> int:
    """Fewest probes that find ``recall`` of the exact neighbours of a sample of queries."""
    return next((i + 1 for i, r in enumerate(recalls(asked, placed, centres, k)) if r >= recall), len(centres))
