"""A batch of queries against the index: answers, facets and result cards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import stripped
from siteloom.operators import filters as Q
from siteloom.operators import neighbours as V
from siteloom.operators import retrieve as R
from siteloom.operators import shape as S
from siteloom.operators.index import SearchIndex
from siteloom.plans.index_build import Embedder, with_vectors
from siteloom.scale import checkpointed, lookup_join, top_k
from siteloom.schemas import FILTER_FIELDS

NEIGHBOURS = 50
DEPTH = Q.SKIP_RANGE[1] + Q.TOP_RANGE[1]
_ANY = "\x00any"
_PAGE = ["qid", "id", "rn", "rank", "score"]


@dataclass(frozen=True)
class Response:
    """``rejected`` holds the queries that broke a limit, with the error."""

    answers: DataFrame
    facets: DataFrame
    results: DataFrame
    rejected: DataFrame


def prepare(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); texts are trimmed, blank filters become null."""
    accepted, rejected = Q.split_queries(queries)
    tidy = {f: F.nullif(F.col(f), F.lit("")) for f in FILTER_FIELDS}
    return accepted.withColumns({"q": stripped("q"), **tidy}), rejected


def text_and_neighbours(asked: DataFrame, index: SearchIndex, k: int = NEIGHBOURS,
                        fn: Embedder | None = None,
                        facets: bool = False,
                        cells: V.Cells | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(text ranks, neighbours, weighted terms, match counts on request) of the non-blank queries. Neighbours come first, so
    that one pass over the postings tells their ranks too. With ``cells`` neighbours come
    from the probed cells only, else from all vectors."""
    weights = checkpointed(R.weighted_terms(asked, index))
    vectors = with_vectors(asked.select("qid", "q", *FILTER_FIELDS), "q", fn)
    near = checkpointed(V.knn_approx(vectors, cells.placed, cells.centres, cells.probes, k) if cells else V.knn(vectors, index.chunks, k))
    ranks, counts = R.text_leg(asked, index, weights, near, DEPTH, facets)
    return ranks, near, weights, counts


def fused(ranks: DataFrame, neighbours: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(qid, id, score, rank) in fused order, as deep as any page can reach."""
    return top_k(R.hybrid(ranks, neighbours), ["qid"], R.ranked_by(), depth)


def _filter_key(columns: list[Column]) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(c, F.lit(_ANY)) for c in columns])


def match_all(blank: DataFrame, index: SearchIndex, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(ranked, counts) of blank queries: every chunk that passes the filter,
    score 1, ordered by id.

    Queries with equal filters share one result, and a chunk finds the filters
    it passes by equality on its eight possible filter keys.
    """
    keyed = blank.select("qid", _filter_key([F.col(f) for f in FILTER_FIELDS]).alias("fkey"))
    keys = checkpointed(keyed.select("fkey").distinct())
    any_or = [[F.col(f), F.lit(None).cast("string")] for f in FILTER_FIELDS]
    possible = F.array(*[_filter_key([a, b, c]) for a in any_or[0] for b in any_or[1] for c in any_or[2]])
    rows = index.chunks.select("id", *FILTER_FIELDS, F.explode(F.array_distinct(possible)).alias("fkey"))
    passing = lookup_join(rows, keys, ["fkey"], "left_semi")
    counts = passing.groupBy("fkey", *FILTER_FIELDS).agg(F.count("*").alias("n"))
    head = top_k(passing.select("fkey", "id"), ["fkey"], [F.asc("id")], depth)
    ranked = keyed.join(head, "fkey").select("qid", "id", F.lit(1.0).alias("score"), "rank")
    return ranked, keyed.join(counts, "fkey").select("qid", *FILTER_FIELDS, "n")


def candidate_counts(matched: DataFrame, ranks: DataFrame, neighbours: DataFrame,
                     index: SearchIndex) -> DataFrame:
    """How many candidates (text matches and neighbours) each query has per
    combination of facet values, in one or more rows. ``ranks`` holds every neighbour that is a text
    match, so only the others are looked up."""
    only_near = checkpointed(neighbours.select("qid", "id").join(ranks, ["qid", "id"], "left_anti"))
    near = lookup_join(index.chunks.select("id", *FILTER_FIELDS), only_near, ["id"], "inner")
    return matched.unionByName(near.groupBy("qid", *FILTER_FIELDS).agg(F.count("*").alias("n")))


def with_chunks(rows: DataFrame, index: SearchIndex) -> DataFrame:
    """Fetch the stored fields of a short list of (qid, id) rows; the list is
    what travels, the chunk table is scanned where it lies."""
    chunks = index.chunks.drop("vector")
    return lookup_join(chunks, rows, ["id"], "inner")


def rerank_order(ranked: DataFrame, terms: DataFrame, index: SearchIndex) -> DataFrame:
    """Fused rows with ``reranker``, ``caption`` and the final position ``rn``:
    the reranked head first, by its new score, then the rest as fused."""
    head = ranked.filter(F.col("rank") <= R.RERANK_DEPTH)
    # 50 passages per query, dealt out evenly because reading them is costly.
    tasks = int(head.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = R.rerank(with_chunks(head, index).repartition(tasks, "qid", "id"), terms)
    scored = checkpointed(top_k(scored, ["qid"], R.ranked_by("reranker"), R.RERANK_DEPTH, "rn")
                          .select(*_PAGE, "reranker", "caption", "caption_score"))
    rest = ranked.filter(F.col("rank") > R.RERANK_DEPTH).withColumn("rn", F.col("rank"))
    return scored.unionByName(rest.select(*_PAGE), allowMissingColumns=True)


def search(queries: DataFrame, index: SearchIndex, fn: Embedder | None = None,
           cells: V.Cells | None = None, collapse_first: bool = False) -> Response:
    """Filter, retrieve, fuse, rerank, count, page and collapse a query batch.

    Pages count chunks, and a page may collapse to fewer cards; with ``collapse_first`` they count cards, drawn
    from the first ``DEPTH`` chunks of a query. ``cells`` makes the vector leg approximate.
    """
    accepted, rejected = prepare(queries)
    accepted = checkpointed(accepted)
    asked, blank = accepted.filter("q <> ''"), accepted.filter("q = ''")
    ranks, neighbours, weights, matched = text_and_neighbours(asked, index, fn=fn, facets=True, cells=cells)
    ranks = checkpointed(ranks)
    ranked = rerank_order(checkpointed(fused(ranks, neighbours)), R.term_lists(weights), index)
    everything, blank_counts = match_all(blank, index)
    listed = ranked.unionByName(everything.withColumn("rn", F.col("rank")).select(*_PAGE),
                                allowMissingColumns=True)
    if collapse_first:
        listed = S.first_per_parent(listed)
    page = S.page_slice(lookup_join(listed, accepted.select("qid", "skip", "top"), ["qid"], "inner"))
    cards = S.result_card(S.collapse(with_chunks(checkpointed(page), index)))
    counts = candidate_counts(matched, ranks, neighbours, index).unionByName(blank_counts)
    return Response(R.answers(ranked.filter("caption is not null")), S.facets(counts), cards, rejected)
