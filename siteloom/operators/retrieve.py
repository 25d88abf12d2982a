"""Text leg, fusion, second-stage ranking, captions and answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import sentences, tokens
from siteloom.operators.index import ENTRY_KEYS, KEYS_SHELF, SEARCH_FIELDS, SearchIndex, shelf
from siteloom.scale import checkpointed, is_small, lookup_join, top_k, written
from siteloom.schemas import FILTER_FIELDS

K1, B = 1.2, 0.75
RRF_K = 60
RERANK_DEPTH = 50
MOST_SHELVES, MAX_TERMS = 0.25, 500
# A weight matrix of 32 MB at most, one bit of a long per distinct filter, and chunks that are scored at a time.
MATRIX_CELLS, MAX_FILTERS, BLOCK_ROWS = 4 * 1024 * 1024, 62, 512
# Weights of the passage, its best sentence and its title in the
# second-stage score, which runs from 0 to 4.
RERANK_WEIGHTS = {"chunk": 2.0, "sentence": 1.2, "title": 0.8}


def ranked_by(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("id")]


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, field, term, qtf): analysed as the field was."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), tokens("q", analyzer).alias("tokens"))
                       for name, analyzer in SEARCH_FIELDS.items()])
    terms = queries.select("qid", F.inline(fields)).select("qid", "field", F.explode("tokens").alias("term"))
    return terms.groupBy("qid", "field", "term").agg(F.count("*").alias("qtf"))


def weighted_terms(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Query terms that occur, with idf weight and the query's filters."""
    terms = query_terms(queries)
    wanted = terms.select("field", "term").distinct()
    found = lookup_join(index.term_df, checkpointed(wanted), ["field", "term"], "left_semi")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = F.broadcast(index.corpus_stats)  # one row per searchable field
    filters = queries.select("qid", *[F.col(f).alias(f"_{f}") for f in FILTER_FIELDS])
    return (terms.join(found, ["field", "term"]).join(stats, "field").join(filters, "qid")
            .select("qid", "field", "term", "avgdl", idf.alias("idf"),
                    (idf * F.col("qtf")).alias("weight"), *[f"_{f}" for f in FILTER_FIELDS]))


def _asked(index: SearchIndex, weights: DataFrame, most: float) -> Column | None:
    """The shelves and terms to read for weighted query terms, if there are postings by term and the terms stand on at most the
    share ``most`` of the shelves."""
    if index.by_term is None:
        return None
    wanted = checkpointed(weights.select("term", shelf(index.shelves)).distinct())
    shelves = sorted(r[0] for r in wanted.select("shelf").distinct().collect())  # at most index.shelves
    if len(shelves) > most * index.shelves:
        return None
    asked = F.col("shelf").isin(shelves)
    terms = sorted({r[0] for r in wanted.select("term").distinct().limit(MAX_TERMS + 1).collect()})
    if terms and len(terms) <= MAX_TERMS:
        tens = [F.col("term").isin(terms[i:i + 10]) for i in range(0, len(terms), 10)]
        while len(tens) > 1:  # a balanced tree of alternatives
            tens = [tens[i] | tens[i + 1] if i + 1 < len(tens) else tens[i] for i in range(0, len(tens), 2)]
        asked = asked & tens[0]
    return asked


def asked_postings(index: SearchIndex, weights: DataFrame, most: float = MOST_SHELVES) -> DataFrame:
    """The postings to read for weighted query terms.

    Those by term, if there are any and the terms stand on at most the share ``most`` of the shelves: only these folders
    are listed, and for up to ``MAX_TERMS`` terms the filter on them is pushed down, ten at a time as
    that is how many Parquet compares one by one, so sorted row groups without them are skipped. Else all postings by id.
    """
    asked = _asked(index, weights, most)
    return index.postings if asked is None else index.by_term.filter(asked).drop("shelf")


def _scored_rows(index: SearchIndex, weights: DataFrame, most: float = MOST_SHELVES) -> DataFrame:
    """The same as rows to score from: lists by id, which need no shuffle, or the asked lists by term and the keys of all
    blocks, which are shuffled by block; postings where the index has no lists."""
    asked = _asked(index, weights, most)
    if asked is None:
        return index.postings if index.lists is None else index.lists
    if index.inverted is None:
        return index.by_term.filter(asked).drop("shelf")
    return index.inverted.filter(asked).unionByName(index.inverted.filter(F.col("shelf") == KEYS_SHELF))


def bm25_scores(queries: DataFrame, index: SearchIndex, weights: DataFrame | None = None,
                facets: bool = False, most: float = MOST_SHELVES) -> DataFrame:
    """(qid, id, score) of every matching chunk that passes the query's
    filters, summed over the searchable fields; with the facet fields on
    request.

    The weights of a batch of measured size are a matrix (term, query) that every task gets: a posting then
    meets the term list once instead of every query that holds its term. A larger batch is joined.
    """
    weights = checkpointed(weighted_terms(queries, index)) if weights is None else weights
    by = ["id", *(FILTER_FIELDS if facets else ())]
    if _fits_matrix(weights):
        return _matrix_scores(_scored_rows(index, weights, most), _sent(weights), by)
    hits = lookup_join(asked_postings(index, weights, most), weights, ["field", "term"], "inner")
    for f in FILTER_FIELDS:
        hits = hits.filter(F.col(f"_{f}").isNull() | (F.col(f) == F.col(f"_{f}")))
    return hits.groupBy("qid", *by).agg(F.round(F.sum(F.col("weight") * saturated()), 6).alias("score"))


def saturated() -> Column:
    """What a posting gives a term of weight 1."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _fits_matrix(weights: DataFrame, depth: int = 1) -> bool:
    """Whether the matrix, and a list of ``depth`` scores per query, are of a size that each task may hold."""
    filters = [f"_{f}" for f in FILTER_FIELDS]
    terms, queries, kinds = (weights.select(*c).distinct().count() for c in (["field", "term"], ["qid"], filters))
    return 0 < queries * max(terms, depth) <= MATRIX_CELLS and kinds <= MAX_FILTERS and is_small(weights)


class _Weights:
    """Weights of a query batch: a matrix (term, query) per distinct filter, and numbers for the terms."""

    def __init__(self, told: pd.DataFrame) -> None:
        filters = [f"_{f}" for f in FILTER_FIELDS]
        number = told.groupby(["field", "term"], sort=False).ngroup().to_numpy()
        self.terms = told.assign(t=number.astype("int32")).drop_duplicates("t")[["field", "term", "t", "avgdl"]].reset_index(drop=True)
        self.fields, at_field = np.unique(self.terms["field"].to_numpy(dtype=object), return_inverse=True)
        self.words, at_word = np.unique(self.terms["term"].to_numpy(dtype=object), return_inverse=True)
        self.numbers = np.full((len(self.fields) + 1, len(self.words) + 1), -1)  # the last of each: none of them
        self.numbers[at_field, at_word] = self.terms["t"]
        self.avgdl = self.terms["avgdl"].to_numpy()
        self.qids, n_terms = np.unique(told["qid"].to_numpy()), len(self.terms)
        wanted = [tuple(None if pd.isna(v) else v for v in row) for row in told[filters].itertuples(index=False)]
        self.kinds, self.parts = sorted(set(wanted), key=str), []
        for kind in self.kinds:
            here = np.array([w == kind for w in wanted])
            asking, column = np.unique(told["qid"].to_numpy()[here], return_inverse=True)
            cells = np.bincount(number[here] * len(asking) + column, weights=told["weight"].to_numpy()[here], minlength=n_terms * len(asking))
            self.parts.append((np.searchsorted(self.qids, asking), cells.reshape(n_terms, len(asking))))
        self.plain = bool((told["weight"] > 0).all())

    def _hits(self, hits: pa.ListArray) -> tuple[np.ndarray, ...]:
        """(row, term, filter bits, saturated count) of the hits of a block of rows, from postings or from their lists."""
        row, hit = np.repeat(np.arange(len(hits)), _lengths(hits)), hits.flatten()
        if hit.type.num_fields == 3:
            t, bits, part = (c.to_numpy(zero_copy_only=False) for c in hit.flatten())
            return row, t, bits, part
        bits, field, dl, terms, tfs = hit.flatten()
        bits, dl, sizes = bits.to_numpy(), dl.to_numpy(), _lengths(terms)
        in_field, in_words = (pc.fill_null(pc.index_in(found, pa.array(known, pa.string())), len(known)).to_numpy()
                              for found, known in ((field, self.fields), (terms.flatten(), self.words)))
        entry = np.repeat(np.arange(len(hit)), sizes)
        asked = np.flatnonzero(in_words < len(self.words))
        entry = entry[asked]
        t = self.numbers[in_field[entry], in_words[asked]]
        known = t >= 0
        t, entry, tf = t[known], entry[known], tfs.flatten().to_numpy()[asked[known]]
        return row[entry], t, bits[entry], tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[entry] / self.avgdl[t]))

    def scores(self, hits: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether it matches) of every row and query, ``BLOCK_ROWS`` rows at a time."""
        total, found = np.zeros((len(hits), len(self.qids))), np.zeros((len(hits), len(self.qids)), dtype=bool)
        for at in range(0, len(hits), BLOCK_ROWS):
            block = hits.slice(at, BLOCK_ROWS)
            here, n = slice(at, at + len(block)), len(block)
            row, t, bits, part = self._hits(block)
            for bit, (columns, cells) in enumerate(self.parts):
                fit = (bits >> bit) & 1 == 1
                used = np.flatnonzero(np.bincount(t[fit], minlength=len(cells)))
                place = np.zeros(len(cells), dtype=np.int64)
                place[used] = np.arange(len(used))
                given = np.bincount(row[fit] * len(used) + place[t[fit]], weights=part[fit], minlength=n * len(used)).reshape(n, len(used))
                sums = given @ cells[used]
                total[here, columns] += sums
                # Sums of positive parts are 0 without a match only; else matches are counted.
                found[here, columns] |= sums != 0 if self.plain else (given != 0).astype(float) @ (cells[used] != 0).astype(float) > 0
        return total, found


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False)


def _sent(weights: DataFrame) -> Broadcast[pd.DataFrame]:
    """A plain table is sent, of which each task makes its ``_Weights``."""
    return weights.sparkSession.sparkContext.broadcast(weights.toPandas())


def _chunk_hits(posted: DataFrame, weights: _Weights, by: list[str], only: DataFrame | None = None) -> DataFrame:
    """(*by, hits) of every chunk, or of those whose ids are in ``only``. A posting or list carries one bit per distinct filter of the
    batch that its chunk passes."""
    if "places" in posted.columns:
        hits = _block_hits(posted, weights, by)
        return hits if only is None else lookup_join(hits, only, ["id"], "left_semi")
    if only is not None:
        posted = lookup_join(posted, only, ["id"], "left_semi")
    fits = F.lit(0).cast("long")
    for bit, kind in enumerate(weights.kinds):
        passes = F.lit(True)
        for f, value in zip(FILTER_FIELDS, kind):
            passes = passes if value is None else passes & (F.col(f) == value)
        fits = fits + F.when(passes, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    if "terms" in posted.columns:
        hits = posted.select(*by, F.struct(fits.alias("fits"), "field", "dl", "terms", "tfs").alias("hit"))
    else:
        terms = posted.sparkSession.createDataFrame(weights.terms, "field string, term string, t int, avgdl double")
        hits = posted.join(F.broadcast(terms), ["field", "term"]).select(*by, F.struct("t", fits.alias("fits"), saturated().alias("part")).alias("hit"))
    return hits.filter("hit.fits <> 0").groupBy(*by).agg(F.collect_list("hit").alias("hits"))


def _block_hits(posted: DataFrame, weights: _Weights, by: list[str]) -> DataFrame:
    """The hits of lists by term: lists and keys of a block come to one task, which turns them."""
    terms = posted.sparkSession.createDataFrame(weights.terms, "field string, term string, t int, avgdl double")
    lists = posted.filter(F.col("shelf") != KEYS_SHELF).join(F.broadcast(terms), ["field", "term"]).select("block", "base", "t", "places", "tfs")
    keys = posted.filter(F.col("shelf") == KEYS_SHELF).select("block", "base", "keys")
    rows = lists.unionByName(keys, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("t"), "base")
    kinds, avgdl = weights.kinds, weights.avgdl

    def turn(block: pa.Table) -> pa.RecordBatch:
        n_keys = block["t"].null_count
        own = dict(zip(ENTRY_KEYS, block["keys"].slice(0, n_keys).combine_chunks().flatten().flatten()))
        bits = np.zeros(len(own["id"]), dtype=np.int64)
        for bit, kind in enumerate(kinds):
            passes = np.ones(len(bits), dtype=bool)
            for f, value in zip(FILTER_FIELDS, kind):
                if value is not None:
                    passes &= pc.fill_null(pc.equal(own[f], value), False).to_numpy(zero_copy_only=False)
            bits |= passes.astype(np.int64) << bit
        codes = [own[c].dictionary_encode(null_encoding="encode").indices.to_numpy() for c in by]
        _, first, chunk = np.unique(np.stack(codes), axis=1, return_index=True, return_inverse=True)
        lists = block.slice(n_keys).combine_chunks()
        base, t, places, tfs = (lists[c].combine_chunks() for c in ("base", "t", "places", "tfs"))
        sizes = _lengths(places)
        entry = places.flatten().to_numpy() + np.repeat(base.to_numpy(zero_copy_only=False), sizes)
        t, tf = np.repeat(t.to_numpy(zero_copy_only=False).astype(np.int32), sizes), tfs.flatten().to_numpy()
        order = np.argsort(chunk[entry], kind="stable")
        order = order[bits[entry[order]] != 0]
        entry, t, tf = entry[order], t[order], tf[order]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * own["dl"].to_numpy()[entry] / avgdl[t]))
        sizes = np.bincount(chunk[entry], minlength=len(first))
        has = np.flatnonzero(sizes)
        hits = pa.StructArray.from_arrays([pa.array(t), pa.array(bits[entry]), pa.array(part)], names=["t", "fits", "part"])
        cuts = pa.array(np.append(0, np.cumsum(sizes[has])).astype(np.int32))
        return pa.RecordBatch.from_arrays([*[own[c].take(pa.array(first[has])) for c in by], pa.ListArray.from_arrays(cuts, hits)], names=[*by, "hits"])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = None, []
        for batch in batches:
            numbers = batch["block"].to_numpy()
            starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
            for start, end in zip(starts, [*starts[1:], len(numbers)]):
                if waiting and numbers[start] != number:
                    yield turn(pa.Table.from_batches(waiting))
                    waiting = []
                number = numbers[start]
                waiting.append(batch.slice(start, end - start))
        if waiting:
            yield turn(pa.Table.from_batches(waiting))

    kept = ", ".join(f"{c} string" for c in by)
    return rows.mapInArrow(turned, f"{kept}, hits array<struct<t:int,fits:bigint,part:double>>")


def _matrix_scores(posted: DataFrame, sent: Broadcast[pd.DataFrame], by: list[str], only: DataFrame | None = None) -> DataFrame:
    """Scores by matrix products over blocks of chunks."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(sent.value)
        for block in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
            total, found = weights.scores(block["hits"])
            at, column = np.nonzero(found)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(weights.qids[column], pa.int64()), *[block[c].take(rows) for c in by], pa.array(total[at, column])],
                                             names=["qid", *by, "score"])

    kept = ", ".join(f"{c} string" for c in by)
    return _chunk_hits(posted, _Weights(sent.value), by, only).mapInArrow(score, f"qid long, {kept}, score double").withColumn("score", F.round("score", 6))


_SUMMED = ["what", "qid", "id", *FILTER_FIELDS, "score", "n"]
_SUMMED_DDL = "what string, qid long, id string, " + ", ".join(f"{f} string" for f in FILTER_FIELDS) + ", score double, n long"
_NO_MARKS = pd.DataFrame({"qid": [], "id": [], "score": []})


class _Summed:
    """What a task keeps of the scores of its chunks: the best ``depth`` per query, how many stand ahead of each
    marked match, and how many there are per combination of facet values."""

    def __init__(self, weights: _Weights, depth: int, marks: pd.DataFrame, facets: bool) -> None:
        self.weights, self.depth, self.facets = weights, depth, facets
        n = len(weights.qids)
        self.top = np.full((n, depth), -np.inf)
        self.best = [np.empty(0, dtype=np.int64), np.empty(0), pa.array([], pa.string())]
        self.counts: dict[tuple, np.ndarray] = {}
        self.marks = [(q, -own["score"].to_numpy(), own["id"].to_numpy(dtype=str), np.zeros(len(own) + 1, dtype=np.int64))
                      for q, own in _numbered(weights.qids, marks)]

    def add(self, block: pa.RecordBatch) -> None:
        total, found = self.weights.scores(block["hits"])
        if self.facets:
            self._count(block, found)
        if not self.depth and not self.marks:
            return
        scores = np.where(found, np.round(total, 6), -np.inf)
        if self.depth:
            self._keep(block["id"], scores)
        if self.marks:
            self._pass_marks(block["id"], scores)

    def _keep(self, ids: pa.Array, scores: np.ndarray) -> None:
        grown = np.concatenate([self.top, scores.T], axis=1)
        self.top = np.partition(grown, len(ids), axis=1)[:, len(ids):]
        least = self.top.min(axis=1)
        q, score, names = self.best
        keep = score >= least[q]
        at, new = np.nonzero((scores >= least) & (scores > -np.inf))
        self.best = [np.concatenate([q[keep], new]), np.concatenate([score[keep], scores[at, new]]),
                     pa.concat_arrays([names.filter(pa.array(keep)), ids.take(pa.array(at))])]

    def _pass_marks(self, ids: pa.Array, scores: np.ndarray) -> None:
        """A match stands ahead of the marks from some place on, in the order of the list: those of lower scores, and of
        equal scores those with higher ids."""
        for q, falling, names, ahead in self.marks:
            own = -scores[:, q]
            place, first = np.searchsorted(falling, own, side="right"), np.searchsorted(falling, own)
            tied = np.flatnonzero(first < place)
            for start in np.unique(first[tied]):
                rows = tied[first[tied] == start]
                same = names[start:place[rows[0]]]
                place[rows] = start + np.searchsorted(same, ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(str), side="right")
            ahead += np.bincount(place, minlength=len(ahead))

    def _count(self, block: pa.RecordBatch, found: np.ndarray) -> None:
        codes = [block[f].dictionary_encode(null_encoding="encode").indices.to_numpy() for f in FILTER_FIELDS]
        _, first, group = np.unique(np.stack(codes), axis=1, return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(first)))
        sums = np.add.reduceat(found[order].astype(np.int32), starts, axis=0)
        for own, n in zip(zip(*(block[f].take(pa.array(first)).to_pylist() for f in FILTER_FIELDS)), sums):
            self.counts[own] = self.counts[own] + n if own in self.counts else n

    def rows(self) -> Iterator[pa.RecordBatch]:
        qids = self.weights.qids
        q, score, names = self.best
        yield _summed_rows("best", qid=qids[q], id=names, score=score)
        for q, falling, names, ahead in self.marks:
            yield _summed_rows("mark", qid=np.full(len(names), qids[q]), id=names.tolist(), score=-falling, n=np.cumsum(ahead)[:-1])
        told = list(self.counts.items())
        for some in (told[at:at + BLOCK_ROWS] for at in range(0, len(told), BLOCK_ROWS)):
            sums = np.stack([n for _, n in some])
            at, q = np.nonzero(sums)
            own = {f: pa.array([key[i] for key, _ in some], pa.string()).take(pa.array(at)) for i, f in enumerate(FILTER_FIELDS)}
            yield _summed_rows("facet", qid=qids[q], n=sums[at, q].astype(np.int64), **own)


def _numbered(qids: np.ndarray, marks: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """(number of the query, its marks in the order of the list)."""
    for qid, own in marks.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid"):
        yield int(np.searchsorted(qids, qid)), own


def _summed_rows(what: str, **columns: object) -> pa.RecordBatch:
    n, types = len(columns["qid"]), {"qid": pa.int64(), "score": pa.float64(), "n": pa.int64()}
    own = {c: pa.array(columns[c], types.get(c, pa.string())) if c in columns else pa.nulls(n, types.get(c, pa.string())) for c in _SUMMED}
    return pa.RecordBatch.from_pydict(own | {"what": pa.array([what] * n, pa.string())})


def _summed(posted: DataFrame, sent: Broadcast[pd.DataFrame], depth: int, marks: pd.DataFrame = _NO_MARKS, facets: bool = False) -> DataFrame:
    """One pass over the postings, of which a task returns no more than ``_Summed`` keeps, however many chunks match."""
    by = ["id", *(FILTER_FIELDS if facets else ())]
    marked = posted.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(sent.value)
        kept = _Summed(weights, depth, marked.value, facets)
        step = max(1, MATRIX_CELLS // len(weights.qids))
        for block in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            kept.add(block)
        yield from kept.rows()

    return _chunk_hits(posted, _Weights(sent.value), by).mapInArrow(run, _SUMMED_DDL)


def _best_rows(summed: DataFrame, depth: int, rank: str = "rank") -> DataFrame:
    return top_k(summed.filter("what = 'best'").select("qid", "id", "score"), ["qid"], ranked_by(), depth, rank)


def _facet_rows(summed: DataFrame) -> DataFrame:
    return summed.filter("what = 'facet'").select("qid", *FILTER_FIELDS, "n")


def bm25(queries: DataFrame, index: SearchIndex, k: int = 50, most: float = MOST_SHELVES) -> DataFrame:
    """(qid, id, score, rank): the best k chunks per query."""
    weights = checkpointed(weighted_terms(queries, index))
    if not _fits_matrix(weights, k):
        return top_k(bm25_scores(queries, index, weights, most=most), ["qid"], ranked_by(), k)
    return _best_rows(_summed(_scored_rows(index, weights, most), _sent(weights), k), k)


def match_counts(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(qid, language, section, kind, n): how many chunks match, in one or more rows per combination of values."""
    weights = checkpointed(weighted_terms(queries, index))
    if not _fits_matrix(weights):
        return bm25_scores(queries, index, weights, facets=True).groupBy("qid", *FILTER_FIELDS).agg(F.count("*").alias("n"))
    return _facet_rows(_summed(_scored_rows(index, weights), _sent(weights), 0, facets=True))


def text_leg(queries: DataFrame, index: SearchIndex, weights: DataFrame, neighbours: DataFrame, depth: int,
             facets: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(``text_ranks`` of the text matches, their counts per combination of facet values on request).

    With weights of a small batch, scores never leave the task that makes them: the neighbours' chunks are scored first,
    then one pass over all postings finds the first ``depth``, counts what stands ahead of each neighbour, and counts facets.
    A larger batch has its scores written and read again.
    """
    if not (_fits_matrix(weights, depth) and is_small(neighbours)):
        scores = written(bm25_scores(queries, index, weights, facets), "scores")
        counts = scores.groupBy("qid", *FILTER_FIELDS).agg(F.count("*").alias("n")) if facets else None
        return text_ranks(scores, neighbours, depth), counts
    posted, sent = _scored_rows(index, weights), _sent(weights)
    near = checkpointed(neighbours.select("qid", "id").distinct())
    by = ["id", *(FILTER_FIELDS if facets else ())]
    scored = _matrix_scores(posted, sent, by, near.select("id").distinct())
    marks = lookup_join(scored, near, ["qid", "id"], "left_semi").select("qid", "id", "score").distinct().toPandas()
    summed = written(_summed(posted, sent, depth, marks, facets), "matches")
    head = _best_rows(summed, depth, "text_rank").drop("score")
    deep = summed.filter("what = 'mark'").groupBy("qid", "id", "score").agg((F.sum("n") + 1).cast("int").alias("text_rank"))
    ranks = head.unionByName(deep.filter(F.col("text_rank") > depth).drop("score"))
    return ranks, _facet_rows(summed) if facets else None


def text_ranks(scores: DataFrame, neighbours: DataFrame, depth: int) -> DataFrame:
    """(qid, id, text_rank) for the first ``depth`` text matches and, however
    far down they stand, for all neighbours that match.

    The full list of a query is never sorted: matches are counted per narrow
    score step with map-side combine. The counts tell how low a score can still
    be among the first ``depth``, so only those rows are ranked; and a
    neighbour's rank is the number in the steps above its own plus those ahead
    of it within the step.
    """
    steps = scores.select("qid", "id", "score", F.floor(F.col("score") * 100).alias("step"))
    falling = Window.partitionBy("qid").orderBy(F.desc("step"))
    above = checkpointed(steps.groupBy("qid", "step").agg(F.count("*").alias("n")).withColumn(
        "above", F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")))
    lowest = above.filter(F.col("above") < depth).groupBy("qid").agg(F.min("step").alias("lowest"))
    high = lookup_join(steps, lowest, ["qid"], "inner").filter("step >= lowest")
    head = top_k(high.select("qid", "id", "score"), ["qid"], ranked_by(), depth, "text_rank").drop("score")
    marks = checkpointed(lookup_join(steps, neighbours.select("qid", "id"), ["qid", "id"], "left_semi"))
    mark = marks.select("qid", "step", F.col("id").alias("mark"), F.col("score").alias("mark_score"))
    ahead = (F.col("score") > F.col("mark_score")) | (
        (F.col("score") == F.col("mark_score")) & (F.col("id") < F.col("mark")))
    inside = lookup_join(steps, mark, ["qid", "step"], "inner").filter(ahead | (F.col("id") == F.col("mark"))) \
        .groupBy("qid", "step", F.col("mark").alias("id")).agg(F.count("*").alias("inside"))
    deep = inside.join(above, ["qid", "step"]).select(
        "qid", "id", (F.col("above") + F.col("inside")).cast("int").alias("text_rank"))
    return head.unionByName(deep.filter(F.col("text_rank") > depth))


def hybrid(text: DataFrame, neighbours: DataFrame, k0: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (qid, id, text_rank) and (qid, id, rank)."""
    legs = text.select("qid", "id", F.col("text_rank").alias("r")).unionByName(
        neighbours.select("qid", "id", F.col("rank").alias("r")))
    return legs.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k0 + F.col("r"))), 9).alias("score"))


def cover(text: Column, terms: Column) -> Column:
    """Share of the query's idf weight whose terms stand in the text."""
    def weight(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda acc, t: acc + t.idf)

    def share(words: Column) -> Column:
        found = weight(F.filter(terms, lambda t: F.array_contains(words, t.term)))
        return F.coalesce(F.try_divide(found, weight(terms)), F.lit(0.0))

    # The one-element array binds the tokens, so a text is tokenised once.
    return F.element_at(F.transform(F.array(F.array_distinct(tokens(text))), share), 1)


def term_lists(weights: DataFrame) -> DataFrame:
    """(qid, terms): the distinct passage terms of each query with their idf;
    a query has at most as many as its own length allows."""
    return weights.filter("field = 'chunk'").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms"))


def with_sentences(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Add the terms and the best sentence: highest cover, then first."""
    joined = lookup_join(candidates, terms, ["qid"], "left")
    none = F.array().cast("array<struct<term:string,idf:double>>")
    joined = joined.withColumn("terms", F.coalesce("terms", none))
    scored = F.transform(sentences("chunk"), lambda s, i: F.struct(
        F.round(cover(s, F.col("terms")), 6).alias("cover"), (-i).alias("order"), s.alias("text")))
    return joined.withColumn("best_sentence", F.array_max(scored))


def rerank(candidates: DataFrame, terms: DataFrame, depth: int = RERANK_DEPTH) -> DataFrame:
    """Second-stage score of the first ``depth`` of (qid, id, rank, chunk,
    title); null beyond. Adds ``reranker``, ``caption`` and ``caption_score``."""
    scored = with_sentences(candidates, terms)
    w = RERANK_WEIGHTS
    total = (w["chunk"] * cover(F.col("chunk"), F.col("terms"))
             + w["sentence"] * F.coalesce(F.col("best_sentence.cover"), F.lit(0.0))
             + w["title"] * cover(F.coalesce("title", F.lit("")), F.col("terms")))
    ranked = F.col("rank") <= depth
    return scored.select(
        *candidates.columns, F.when(ranked, F.round(total, 6)).alias("reranker"),
        F.when(ranked, F.col("best_sentence.text")).alias("caption"),
        F.when(ranked, F.col("best_sentence.cover")).alias("caption_score"))


def answers(captioned: DataFrame, min_score: float | None = None, n: int = 1) -> DataFrame:
    """(qid, text, score): the best extracts of a query; empty ones are left
    out, and weak ones where a least score is given."""
    good = captioned.filter(F.col("caption") != "")
    if min_score is not None:
        good = good.filter(F.col("caption_score") >= min_score)
    best = top_k(good, ["qid"], [F.desc("caption_score"), F.asc("id")], n, "answer_rank")
    return best.select("qid", "answer_rank", F.col("caption").alias("text"),
                       F.col("caption_score").alias("score"))
