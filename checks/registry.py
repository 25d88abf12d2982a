"""One runnable query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as D
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators import extract as E
from siteloom.operators import filters as Q
from siteloom.operators import incremental as N
from siteloom.operators import index as I
from siteloom.operators import main_content as M
from siteloom.operators import neighbours as V
from siteloom.operators import retrieve as R
from siteloom.operators import shape as S
from siteloom.plans import crawl as C
from siteloom.plans import index_build as B
from siteloom.plans import search as P
from siteloom.scale import checkpointed, scratch_path
from siteloom.sources import landed as L
from siteloom.sources import sinks as K
from siteloom.sources.index_store import save_by_term, save_index, with_terms
from siteloom.sources.versioned import VersionedTable
from siteloom.streaming import streams as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ASSET_HOSTS = ["example.com", "example.net", "example.org"]


def now():
    return F.timestamp_seconds(F.lit(D.EPOCH + 120 * D.DAY))



def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scalar(name: str, source: Query, key: str, column) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return source(spark, sf).select(F.col(key), column().alias("value"))
    QUERIES[name] = run


# -- sources and sinks ---------------------------------------------------------

def _landed_copy(spark, sf):
    path = scratch_path(spark, "landed")
    D.landed(spark, sf).write.parquet(path)
    return L.read_landed(spark, path)


@query
def scan_landed(spark, sf):
    return _landed_copy(spark, sf).select(
        "url", "content_type", F.length("html").alias("html_chars"),
        F.octet_length("body").alias("body_bytes"))


@query
def robots_sitemaps(spark, sf):
    return L.robots_sitemaps(D.robots(spark, sf))


@query
def sitemap_entries(spark, sf):
    return L.sitemap_entries(D.sitemap_xml(spark, sf))


@query
def sitemap_expand(spark, sf):
    seeds = L.robots_sitemaps(D.robots(spark, sf)).select("loc")
    found = L.sitemap_expand(seeds, D.sitemap_xml(spark, sf))
    return N.page_dedup(found)


def _records(pages):
    marked = M.main_content(pages, keep=("content_type", "html", "fetched_at"))
    return E.page_record(marked).withColumn("lastmod", F.lit(None).cast("string"))


def _artifacts(spark, sf):
    landed = D.landed(spark, sf)
    pages = _records(D.landed_pages(spark, sf))
    return K.page_bundle(pages).unionByName(K.binary_artifact(E.binary_record(landed)))


@query
def scan_by_extension(spark, sf):
    artifacts = _artifacts(spark, sf)
    kept = K.union_sources(*[L.scan_container(artifacts, c) for c in L.INDEXED_EXTENSIONS])
    return kept.select("container", "name")


@query
def scan_manifest(spark, sf):
    return N.known_hashes(D.manifest(spark, sf))


@query
def sink_route(spark, sf):
    docs = D.docs_src(spark, sf).select("parent_id", "kind")
    pages = D.pages_src(spark, sf).select("parent_id", "kind")
    other = D.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("chat"), "conv_id", "turn").alias("parent_id"), F.col("role").alias("kind"))
    return K.route(docs.unionByName(pages).unionByName(other))


def _described(artifacts):
    return artifacts.select("container", "name", "content_type", F.octet_length("data").alias("n_bytes"),
                            F.sha2("data", 256).alias("data_hash"), *[
        F.try_element_at("metadata", F.lit(k)).alias(k)
        for k in ("sourceurl", "title", "language", "crawledat", "contenthash", "kind")])


@query
def sink_page_bundle(spark, sf):
    return _described(K.page_bundle(_records(D.landed_pages(spark, sf))))


@query
def sink_binary(spark, sf):
    landed = D.landed(spark, sf)
    shots = D.landed_pages(spark, sf).select(
        "url", F.lit("snapshot").alias("kind"), F.col("url").alias("source_page"),
        F.when(F.contains("url", F.lit("?")), "application/pdf").otherwise("image/png").alias("content_type"),
        F.encode("url", "UTF-8").alias("body"), U.content_hash("url").alias("content_hash"),
        F.col("fetched_at").alias("crawled_at"), U.language_from_url("url").alias("language"))
    return _described(K.binary_artifact(E.binary_record(landed).unionByName(shots)))


@query
def sink_upsert(spark, sf):
    """Into a stored table, whose earlier version stays as it was."""
    stored = D.manifest(spark, sf).select("container", "name", "content_hash", "modified_at")
    pages = N.page_keys(D.landed_pages(spark, sf)).select(
        F.lit("pages").alias("container"), F.concat("base_name", F.lit(".html")).alias("name"),
        "content_hash", F.col("fetched_at").alias("modified_at"))
    older = pages.select("container", "name", F.reverse("content_hash").alias("content_hash"),
                         (F.col("modified_at") - F.expr("interval 1 hour")).alias("modified_at"))
    table = VersionedTable(spark, scratch_path(spark, "upserted"), stored.schema, ["container", "name"], by=("container",), buckets=8)
    table.write(stored)
    K.upsert_stored(table, pages.unionByName(older), ["modified_at", "content_hash"])
    return table.read()


@query
def artifact_store(spark, sf):
    """Artifacts stored, English documents stored again in another form, and read back
    by container, pages by their Markdown only."""
    store = K.artifact_store(spark, scratch_path(spark, "artifacts"), buckets=8)
    store.write(_artifacts(spark, sf))
    docs = D.landed(spark, sf).filter(U.language_from_url("url") == "en").withColumn("body", F.encode("url", "UTF-8"))
    store.write(K.binary_artifact(E.binary_record(docs)))
    kept = K.union_sources(*[L.scan_container(store.read(), c) for c in ("pages", "docs", "images")])
    return kept.select("container", "name", F.octet_length("data").alias("n_bytes"), F.sha2("data", 256).alias("data_hash"))


def _all_sources(spark, sf):
    texts = E.binary_record(D.landed(spark, sf)).filter("kind = 'doc'") \
        .withColumn("text", F.decode("body", "UTF-8"))
    return K.union_sources(D.docs_src(spark, sf), D.pages_src(spark, sf),
                           B.text_assets(texts).drop("media_type"))


@query
def union_sources(spark, sf):
    return _all_sources(spark, sf).select(
        "parent_id", "title", "source_url", "language", "section", "kind", "content_hash",
        F.length("content").alias("n_chars"))


@query
def sink_index(spark, sf):
    table = K.index_table(spark, scratch_path(spark, "chunks"), buckets=8)
    K.write_index(I.nonempty(I.chunk_text(D.docs_src(spark, sf))), table)
    return table.read().select("id", "parent_id", "ord", F.sha2("chunk", 256).alias("chunk_hash"))


# -- scalar functions ----------------------------------------------------------

for _name, _column in {
    "url_path": U.url_path, "url_host": U.url_host, "language_from_url": U.language_from_url,
    "section_from_url": U.section_from_url, "blob_name": U.blob_name, "page_base_name": U.page_base_name,
    "snapshot_name": U.snapshot_name, "percent_encode": U.percent_encode, "url_extension": U.url_extension,
}.items():
    scalar(_name, D.landed, "url", lambda f=_column: f("url"))
scalar("media_type", D.landed, "url", lambda: X.media_type("content_type"))
scalar("binary_kind", D.landed, "url", lambda: X.binary_kind("content_type"))


def _documents(spark, sf):
    return D.table(spark, sf, "documents")


scalar("header_safe", _documents, "doc_id", lambda: X.header_safe("text"))
scalar("text_direction", _documents, "doc_id", lambda: X.text_direction("text"))


@query
def content_hash(spark, sf):
    """Of text and of bytes."""
    return D.landed(spark, sf).select(
        "url", F.coalesce(U.content_hash("html"), U.content_hash("body")).alias("value"))


@query
def percent_decode(spark, sf):
    """Of encoded titles and of raw text with percent signs and pluses."""
    docs = D.docs_src(spark, sf)
    raw = docs.select("parent_id", F.lit("raw").alias("form"), F.col("content").alias("t"))
    encoded = docs.select("parent_id", F.lit("encoded").alias("form"), U.percent_encode("content").alias("t"))
    return raw.unionByName(encoded).select("parent_id", "form", U.percent_decode("t").alias("value"))


@query
def url_join(spark, sf):
    pages = D.pages_with_assets(spark, sf)
    found = F.regexp_extract_all("html", F.lit(r'(?:href|src|data-src|srcset)="([^"]*)"'), F.lit(1))
    refs = pages.select("url", F.explode(F.array_distinct(found)).alias("ref"))
    return refs.select("url", "ref", U.url_join("url", "ref").alias("value"))


# -- extraction ----------------------------------------------------------------

@query
def html_gate(spark, sf):
    pages, binary = E.split_by_type(D.landed(spark, sf))
    return pages.select("url", F.lit("page").alias("way")).unionByName(
        binary.select("url", F.lit("binary").alias("way")))


@query
def page_title(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", E.page_title("html").alias("title"))


@query
def visible_text(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", E.visible_text("html").alias("text"))


@query
def main_content(spark, sf):
    return M.main_content(D.table(spark, sf, "pages"))


@query
def image_refs(spark, sf):
    return E.image_refs(D.pages_with_assets(spark, sf))


@query
def doc_refs(spark, sf):
    return E.doc_refs(D.pages_with_assets(spark, sf))


def _assets(spark, sf):
    pages = D.pages_with_assets(spark, sf)
    images = E.asset_filter(E.image_refs(pages), E.IMAGE_EXTENSIONS, ASSET_HOSTS)
    docs = E.asset_filter(E.doc_refs(pages), E.DOC_EXTENSIONS, ASSET_HOSTS)
    return images.withColumn("kind", F.lit("image")).unionByName(docs.withColumn("kind", F.lit("doc")))


@query
def asset_filter(spark, sf):
    return _assets(spark, sf)


@query
def asset_dedup(spark, sf):
    return E.asset_dedup(_assets(spark, sf))


@query
def rendered_image_union(spark, sf):
    return E.rendered_images(D.rendered(spark, sf), E.image_refs(D.pages_with_assets(spark, sf)), ASSET_HOSTS)


@query
def asset_language(spark, sf):
    assets = _assets(spark, sf).withColumnRenamed("asset_url", "url")
    return E.asset_language(assets).select("url", "source_page", "language")


@query
def page_record(spark, sf):
    landed = D.landed(spark, sf)
    entries = N.page_dedup(L.sitemap_entries(D.sitemap_xml(spark, sf)))
    return E.page_record(landed, lastmod=entries).drop("html")


@query
def linked_assets(spark, sf):
    """Binary responses with the page that links them; documents nobody links stand for themselves."""
    responses = D.site_files(spark, sf).unionByName(D.landed(spark, sf))
    links = E.asset_links(D.pages_with_assets(spark, sf), ASSET_HOSTS)
    return E.binary_record(responses, links).drop("body", "crawled_at")


def _crawl(spark, sf, store, moved=False):
    responses = D.site_pages(spark, sf, moved).unionByName(D.site_files(spark, sf)).unionByName(
        D.landed(spark, sf).filter("body is not null"))
    return C.crawl(responses, D.robots_seeds(spark, sf), D.sitemap_xml(spark, sf), D.robots(spark, sf), store, now(), ASSET_HOSTS)


@query
def ingest_artifacts(spark, sf):
    """What a crawl from the robots files on has stored."""
    store = K.artifact_store(spark, scratch_path(spark, "crawled"), buckets=8)
    _crawl(spark, sf, store)
    told = {c: F.try_element_at("metadata", F.lit(k)) for c, k in (
        ("content_hash", "contenthash"), ("source_page", "sourcepage"), ("language", "language"))}
    described = F.when(F.endswith("name", F.lit(".json")), F.get_json_object(F.decode("data", "UTF-8"), "$.lastmod"))
    return store.read().select("container", "name", *[v.alias(k) for k, v in told.items()], described.alias("lastmod"))


@query
def run_manifest(spark, sf):
    """Counters of two runs: everything is new, then pages with a query string have changed."""
    store = K.artifact_store(spark, scratch_path(spark, "crawled"), buckets=8)
    runs = [_crawl(spark, sf, store, moved).counters for moved in (False, True)]
    rows = [(n, k.removeprefix("uploaded_"), v) for n, run in enumerate(runs, 1) for k, v in run.items()]
    return spark.createDataFrame(rows, "run int, container string, uploaded long")


# -- filters -------------------------------------------------------------------

@query
def allowed_domains(spark, sf):
    pages = D.table(spark, sf, "pages").select("page_id", "url")
    return Q.allowed_domains(pages, seeds=pages.filter(F.startswith("url", F.lit("https:"))))


@query
def robots_allowed(spark, sf):
    return Q.robots_allowed(D.table(spark, sf, "pages").select("page_id", "url"),
                            Q.robots_rules(D.robots(spark, sf)))


@query
def facet_filter(spark, sf):
    sources = D.docs_src(spark, sf).unionByName(D.pages_src(spark, sf))
    kept = Q.facet_filter(sources, {"language": "en", "section": "", "kind": "doc"})
    return kept.select("parent_id", "language", "section", "kind")


@query
def query_bounds(spark, sf):
    return Q.validate_queries(D.raw_queries(spark, sf)).select("qid", "top", "skip", "error")


@query
def nonempty_chunks(spark, sf):
    """Passages of each document line by line; empty lines give none."""
    lines = D.docs_src(spark, sf).select(
        "parent_id", F.posexplode(F.split("content", "\n")).alias("line", "content"))
    lines = lines.withColumn("parent_id", F.concat_ws("-", "parent_id", "line"))
    return I.nonempty(I.chunk_text(lines)).select("id", F.length("chunk").alias("n_chars"))


# -- incremental ---------------------------------------------------------------

@query
def changed_pages(spark, sf):
    return N.changed_pages(D.landed(spark, sf), D.manifest(spark, sf)).select(
        "url", "base_name", "content_hash")


@query
def changed_artifacts(spark, sf):
    pages = D.landed_pages(spark, sf)
    records = E.page_record(pages).withColumns({"markdown": E.visible_text("html"),
                                                "lastmod": F.lit(None).cast("string")})
    return N.changed_artifacts(K.page_bundle(records), D.manifest(spark, sf)).select("container", "name")


@query
def change_class(spark, sf):
    return N.classify(N.page_keys(D.landed_pages(spark, sf)), D.manifest(spark, sf)).select(
        "base_name", "content_hash", "change_class")


@query
def run_counters(spark, sf):
    classed = N.classify(N.page_keys(D.landed_pages(spark, sf)), D.manifest(spark, sf))
    return N.run_counters(classed.withColumn("container", F.lit("pages")))


@query
def page_dedup(spark, sf):
    """Entries listed by url sets and, again and undated, by the pages table."""
    listed = L.sitemap_entries(D.sitemap_xml(spark, sf)).select("loc", "lastmod")
    again = D.table(spark, sf, "pages").select(
        F.col("url").alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    return N.page_dedup(listed.unionByName(again))


def _stored(spark, sf):
    return D.manifest(spark, sf).unionByName(D.snapshots(spark, sf))


@query
def snapshot_expiry(spark, sf):
    return N.expire(_stored(spark, sf), now()).select("container", "name", "modified_at")


@query
def soft_delete(spark, sf):
    return N.purge(_stored(spark, sf), now()).select("container", "name", "deleted_at", "recoverable")


def _tombstones(spark, sf):
    return D.manifest(spark, sf).select(
        F.concat(F.lit("page-"), "base_name").alias("parent_id"), "deleted_at")


@query
def deletion_detect(spark, sf):
    chunks = I.nonempty(I.chunk_text(D.pages_src(spark, sf)))
    return N.drop_deleted(chunks, _tombstones(spark, sf)).select("id", "parent_id")


@query
def incremental_index(spark, sf):
    """Sources of English text changed: their chunks are rebuilt without blanks."""
    src = D.docs_src(spark, sf)
    changed = src.filter("language = 'en'").withColumn("content", F.replace("content", F.lit(" "), F.lit("_")))
    old, new = I.nonempty(I.chunk_text(src)), I.nonempty(I.chunk_text(changed))
    return N.refresh_index(old, new, changed).select("id", "parent_id", F.sha2("chunk", 256).alias("chunk_hash"))


@query
def quarantine(spark, sf):
    """Conversation turns as landings of which many lack something."""
    turns = D.table(spark, sf, "conversations").select(
        F.when(F.col("role") != "system", F.concat(F.lit("chat:"), F.when(
            F.col("turn") > 1, F.lit("//chat.example.com")).otherwise(""), F.lit("/"), "conv_id",
            F.lit("/"), "turn")).alias("url"),
        F.when(F.col("role") == "user", "text/html").alias("content_type"),
        F.when(F.contains("text", F.lit("the")), F.col("text")).alias("html"),
        F.lit(None).cast("binary").alias("body"))
    good, bad = N.with_errors(turns)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).groupBy("url", "error") \
        .agg(F.count("*").alias("n"))


@query
def snapshot_lookup(spark, sf):
    return N.attach_snapshot(D.pages_src(spark, sf).select("parent_id", "source_url"), D.snapshots(spark, sf))


# -- index build ---------------------------------------------------------------

@query
def merge_inserts(spark, sf):
    return I.merge_inserts(D.docs_src(spark, sf), D.ocr_text(spark, sf)).select("parent_id", "content")


def _chunks(spark, sf):
    return I.nonempty(I.chunk_text(D.docs_src(spark, sf)))


@query
def chunk_text(spark, sf):
    return _chunks(spark, sf).select("id", "parent_id", "ord", "chunk")


@query
def chunk_sentences(spark, sf):
    return I.chunk_text(D.docs_src(spark, sf), boundary=True).select("id", "ord", "chunk")


@query
def embed_hash(spark, sf):
    vectors = I.embed_hash(_chunks(spark, sf)).select("id", F.posexplode("vector").alias("bucket", "w"))
    return vectors.filter("w <> 0").select("id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


def _user_vectors(spark, sf):
    return D.table(spark, sf, "embeddings").select(
        F.concat(F.lit("doc-"), "vec_id", F.lit("_0")).alias("id"), F.col("embedding").alias("vector"))


@query
def embed_column(spark, sf):
    return I.embed_column(_chunks(spark, sf), _user_vectors(spark, sf), 64).select(
        "id", F.size("vector").alias("dim"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def embed_udf(spark, sf):
    """A user's function: length, words and lines of each passage."""
    def shape_of(texts: pd.Series) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]
    rows = B.with_vectors(_chunks(spark, sf), "chunk", shape_of)
    return rows.select("id", *[F.col("vector")[i].cast("double").alias(n)
                               for i, n in enumerate(("n_chars", "n_blanks", "n_breaks"))])


@query
def embed_rejects(spark, sf):
    """A model that fails on a batch with any passage of a single line: those alone are rejected."""
    def fails(texts: pd.Series) -> list[list[float]]:
        if not texts.str.contains("\n", regex=False).all():
            raise ValueError("a single line")
        return [[float(len(t))] for t in texts]
    rows, rejected = B.index_rows_and_rejects(_all_sources(spark, sf), fails, D.ocr_text(spark, sf))
    made = rows.select("id", F.col("vector")[0].cast("double").alias("n_chars"), F.lit(None).cast("string").alias("error"))
    return made.unionByName(rejected.select("id", F.lit(None).cast("double").alias("n_chars"), "error"))


@query
def index_projection(spark, sf):
    rows = B.index_rows(_all_sources(spark, sf), D.ocr_text(spark, sf))
    return rows.select("id", "parent_id", "ord", F.sha2("chunk", 256).alias("chunk_hash"), "title", "source_url",
                       "language", "section", "kind", "content_hash", F.size("vector").alias("dim"))


@query
def analyze_text(spark, sf):
    return I.analyze(_chunks(spark, sf)).groupBy("field", "term").agg(F.count("*").alias("n"))


@query
def build_postings(spark, sf):
    return I.postings(_chunks(spark, sf)).select("id", "field", "term", "tf", "dl")


@query
def term_frequencies(spark, sf):
    return I.term_df(I.postings(_chunks(spark, sf)))


@query
def corpus_stats(spark, sf):
    stats = I.corpus_stats(I.doc_len(_chunks(spark, sf)))
    return stats.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


# -- retrieval -----------------------------------------------------------------

_INDEXES: dict[tuple[str, str], I.SearchIndex] = {}


def new_index(spark: SparkSession, sf: str) -> I.SearchIndex:
    """The index over documents and pages, built and written."""
    sources = D.docs_src(spark, sf).unionByName(D.pages_src(spark, sf))
    return save_index(B.index_rows(sources), scratch_path(spark, "index"))


def index_of(spark: SparkSession, sf: str) -> I.SearchIndex:
    """That index, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = new_index(spark, sf)
    return _INDEXES[key]


def _asked(spark, sf):
    return P.prepare(D.queries(spark, sf))[0].filter("q <> ''")


@query
def match_all(spark, sf):
    blank = P.prepare(D.queries(spark, sf))[0].filter("q = ''")
    ranked, _ = P.match_all(blank, index_of(spark, sf))
    return ranked


@query
def bm25_topk(spark, sf):
    return R.bm25(_asked(spark, sf), index_of(spark, sf))


@query
def bm25_by_term(spark, sf):
    """The same from the postings by term, whatever share of them the queries ask for."""
    index, path = index_of(spark, sf), scratch_path(spark, "by-term")
    save_by_term(index.lists, path, 64)
    return R.bm25(_asked(spark, sf), with_terms(index, path), most=1.0)


def _query_vectors(spark, sf):
    return B.with_vectors(_asked(spark, sf), "q")


@query
def knn_exact(spark, sf):
    return V.knn(_query_vectors(spark, sf), index_of(spark, sf).chunks)


def _cells(spark, sf, probes):
    vectors = D.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    centres = V.chosen_centres(vectors, 20)
    placed = V.write_cells(vectors, centres, scratch_path(spark, "cells"))
    return V.knn_approx(vectors.drop("id"), placed, centres, probes, k=10)


@query
def knn_approx(spark, sf):
    """Every vector asks 15 of 20 cells for its 10 neighbours, for a recall of 0.9 and more."""
    return _cells(spark, sf, 15)


@query
def knn_all_cells(spark, sf):
    """With all cells probed the answer is exact."""
    return _cells(spark, sf, 20)


@query
def hybrid_rrf(spark, sf):
    ranks, near, _, _ = P.text_and_neighbours(_asked(spark, sf), index_of(spark, sf))
    return P.fused(ranks, near)


@query
def hybrid_cells(spark, sf):
    """Fused ranks with neighbours read from cells; all cells are probed, so they are exact."""
    index = index_of(spark, sf)
    centres = V.chosen_centres(index.chunks, 12)
    cells = V.Cells(V.write_cells(index.chunks, centres, scratch_path(spark, "cells")), centres, 12)
    ranks, near, _, _ = P.text_and_neighbours(_asked(spark, sf), index, cells=cells)
    return P.fused(ranks, near)


def _reranked(spark, sf, k=P.NEIGHBOURS):
    index = index_of(spark, sf)
    ranks, near, weights, _ = P.text_and_neighbours(_asked(spark, sf), index, k)
    ranked = checkpointed(P.fused(ranks, near))
    return P.rerank_order(ranked, R.term_lists(weights), index)


@query
def rerank(spark, sf):
    return _reranked(spark, sf).select("qid", "id", "rn", "reranker")


@query
def captions(spark, sf):
    return _reranked(spark, sf).filter("reranker is not null").select("qid", "id", "caption", "caption_score")


@query
def answers(spark, sf):
    return R.answers(_reranked(spark, sf).filter("caption is not null"))


@query
def facet_counts(spark, sf):
    return S.facets(R.match_counts(_asked(spark, sf), index_of(spark, sf)))


def _paged(spark, sf):
    asked = _asked(spark, sf)
    ranked = R.bm25(asked, index_of(spark, sf), P.DEPTH).withColumnRenamed("rank", "rn")
    return S.page_slice(ranked.join(asked.select("qid", "skip", "top"), "qid"))


@query
def page_slice(spark, sf):
    return _paged(spark, sf).select("qid", "id", "rn")


def _cards(spark, sf):
    """Pages of the text leg; the whole score stands in for the second stage."""
    page = P.with_chunks(checkpointed(_paged(spark, sf)), index_of(spark, sf))
    return S.collapse(page.withColumns({
        "reranker": F.floor("score").cast("double"),
        "caption": F.when(F.col("language") == "en", F.element_at(X.sentences("chunk"), 1))}))


@query
def collapse_parent(spark, sf):
    return _cards(spark, sf).select("qid", "pos", "parent_id", "id", "rn", "reranker")


@query
def result_card(spark, sf):
    return S.result_card(_cards(spark, sf))


@query
def display_text(spark, sf):
    return S.display_text(S.result_card(_cards(spark, sf)))


@query
def cli_rows(spark, sf):
    """The flat list shows the best five of each query: five neighbours are
    fused with the text leg, and the head is ranked anew."""
    best = _reranked(spark, sf, 5).filter("rn <= 5").select("qid", "id", "rn", "score", "reranker")
    return S.cli_rows(P.with_chunks(checkpointed(best), index_of(spark, sf)))


@query
def search_response(spark, sf):
    return P.search(D.queries(spark, sf), index_of(spark, sf)).results


@query
def search_collapsed(spark, sf):
    """Pages of cards instead of chunks."""
    return P.search(D.queries(spark, sf), index_of(spark, sf), collapse_first=True).results


@query
def search_facets(spark, sf):
    return P.search(D.queries(spark, sf), index_of(spark, sf)).facets


# -- streams -------------------------------------------------------------------

def _stream(spark, df: DataFrame) -> DataFrame:
    """A file stream over the rows of ``df`` in several files, half of them a batch."""
    path, files = scratch_path(spark, "stream"), max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path)


@query
def stream_asset_dedup(spark, sf):
    table = W.asset_table(spark, scratch_path(spark, "assets"), buckets=8)
    W.stream_asset_dedup(_stream(spark, _assets(spark, sf)), table, scratch_path(spark, "state"))
    return table.read().select("asset_url")


@query
def stream_unique_assets(spark, sf):
    """The same assets by Spark's own streaming state, in RocksDB."""
    path, state = scratch_path(spark, "unique"), scratch_path(spark, "state")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = W.unique_assets(_stream(spark, _assets(spark, sf)))
        stream.select("asset_url").writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("asset_url string").parquet(path)


@query
def stream_changed_pages(spark, sf):
    table = W.changed_table(spark, scratch_path(spark, "changed"), D.manifest(spark, sf), buckets=8)
    W.stream_changed_pages(_stream(spark, D.landed(spark, sf)), table, scratch_path(spark, "state"))
    return W.read_changed(table).select("base_name", "url", "content_hash")


@query
def stream_index_refresh(spark, sf):
    table = K.index_table(spark, scratch_path(spark, "refreshed"), buckets=8)
    W.stream_index_refresh(_stream(spark, D.docs_src(spark, sf)), table, scratch_path(spark, "state"))
    return W.read_index(table).select("id", "parent_id", F.sha2("chunk", 256).alias("chunk_hash"))
