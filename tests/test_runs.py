"""Incremental runs, sinks, streams and whole plans."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siteloom.operators import incremental as N
from siteloom.plans import crawl, index_build, search
from siteloom.scale import scratch_path
from siteloom.schemas import LANDED, QUERIES
from siteloom.sources import landed as L
from siteloom.sources import sinks
from siteloom.sources.index_store import load_index, save_index
from siteloom.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def landed(spark, rows):
    return spark.createDataFrame([(u, c, h, b, T0 + dt.timedelta(minutes=m)) for u, c, h, b, m in rows], LANDED)


@pytest.fixture(scope="module")
def responses(spark):
    rows = [(f"https://h.com/en/p{i}.html", "text/html", f"<title>T{i} é</title><p>Body number {i}.</p>", None, i)
            for i in range(6)]
    rows += [("https://h.com/f.PDF", "application/pdf; x", None, bytearray(b"pdf"), 7),
             ("https://h.com/i.png", "image/png", None, bytearray(b"png"), 8), ("", "text/html", "<p>x</p>", None, 9)]
    return landed(spark, rows)


def stored(artifacts):
    """The manifest an ingest leaves behind."""
    return artifacts.select(
        "container", "name", F.regexp_replace("name", r"\.html$", "").alias("base_name"),
        F.col("metadata")["contenthash"].alias("content_hash"))


def test_a_second_ingest_stores_nothing(spark, responses):
    first = crawl.ingest(responses, None).artifacts
    assert {r.container: r["count"] for r in first.groupBy("container").count().collect()} == {
        "pages": 18, "docs": 1, "images": 1}
    manifest = stored(first).cache()
    assert crawl.ingest(responses, manifest).artifacts.count() == 0
    changed = responses.withColumn("html", F.when(F.col("url").contains("p3"), "<p>new</p>").otherwise(F.col("html")))
    assert crawl.ingest(changed, manifest).artifacts.count() == 3
    assert crawl.ingest(changed, manifest, incremental=False).artifacts.count() == 3
    keys = N.page_keys(responses.filter("url <> ''"))
    assert {r.change_class for r in N.classify(keys, manifest).collect()} == {"unchanged"}


def test_rejected_responses_are_returned(spark, responses):
    assert [(r.url, r.error) for r in crawl.ingest(responses, None).rejected.collect()] == [("", "no url")]


def test_the_manifest_of_a_run_makes_the_next_one_empty(spark, responses):
    empty = stored(crawl.ingest(responses, None).artifacts).limit(0).withColumns(
        {"modified_at": F.lit(T0), "deleted_at": F.lit(None).cast("timestamp")})
    first = crawl.ingest(responses, empty)
    after = crawl.next_manifest(empty, first.artifacts, F.lit(T0)).cache()
    assert after.count() == first.artifacts.count() == 20
    assert crawl.ingest(responses, after).artifacts.count() == 0
    changed = responses.withColumn("html", F.when(F.col("url").contains("p3"), "<p>new</p>").otherwise(F.col("html")))
    again = crawl.next_manifest(after, crawl.ingest(changed, after).artifacts, F.lit(T0 + dt.timedelta(1))).cache()
    assert again.count() == 20 and again.filter(F.col("modified_at") > F.lit(T0)).count() == 3


@pytest.mark.parametrize("small", [True, False])
def test_a_page_is_judged_by_its_html_alone(spark, responses, monkeypatch, small):
    artifacts = crawl.ingest(responses, None).artifacts.cache()
    manifest = stored(artifacts).filter("name like '%.html' or container <> 'pages'")
    monkeypatch.setattr(N, "is_small", lambda df: small)
    assert N.changed_artifacts(artifacts, manifest).count() == 0
    left = N.changed_artifacts(artifacts, manifest.filter("name not like '%p2%'"))
    assert sorted(r.name.rsplit(".", 1)[1] for r in left.collect()) == ["html", "json", "md"]


def test_large_manifest_gives_the_same_changes(spark, responses, monkeypatch):
    manifest = stored(crawl.ingest(responses, None).artifacts).filter("name not like '%p2%'").cache()
    small = {r.url for r in N.changed_pages(responses.filter("url <> ''"), manifest).collect()}
    monkeypatch.setattr(N, "is_small", lambda df: False)
    assert {r.url for r in N.changed_pages(responses.filter("url <> ''"), manifest).collect()} == small == {
        "https://h.com/en/p2.html"}


def test_page_bundle_describes_the_page(spark, responses):
    rows = {r.name.rsplit(".", 1)[1]: r for r in crawl.ingest(responses.filter("url like '%p1%'"), None).artifacts.collect()}
    described = json.loads(bytes(rows["json"].data).decode())
    assert described["title"] == "T1 é" and described["lastmod"] is None and described["crawledAt"] == "2024-01-01T00:01:00+00:00"
    assert bytes(rows["md"].data).decode() == "Body number 1."
    assert rows["html"].metadata["title"] == "T1%20%C3%A9" and rows["html"].metadata["kind"] == "page"


def test_retention_is_strict(spark):
    now = F.lit(T0 + dt.timedelta(days=40))
    rows = [("snapshots", T0 + dt.timedelta(days=d), None) for d in (9, 10, 11)] + [("pages", T0, None)]
    df = spark.createDataFrame(rows, "container string, modified_at timestamp, deleted_at timestamp")
    assert N.expire(df, now).count() == 3
    gone = spark.createDataFrame([(T0 + dt.timedelta(days=d),) for d in (32, 33, 34)] + [(None,)], "deleted_at timestamp")
    assert sorted(r.recoverable for r in N.purge(gone, now).collect()) == [False, True, True]


def test_upsert_last_write_wins(spark):
    schema = "container string, name string, v int, at int"
    target = spark.createDataFrame([("c", "a", 1, 9), ("c", "b", 1, 9)], schema)
    updates = spark.createDataFrame([("c", "a", 2, 1), ("c", "a", 3, 2), ("c", "n", 4, 1)], schema)
    assert sorted(map(tuple, sinks.upsert(target, updates, ["container", "name"], ["at"]).collect())) == [
        ("c", "a", 3, 2), ("c", "b", 1, 9), ("c", "n", 4, 1)]


def test_nested_sitemaps_cycles_and_entities(spark):
    def index(*locs):
        return "<sitemapindex>" + "".join(f"<sitemap><loc> {l} </loc></sitemap>" for l in locs) + "</sitemapindex>"
    maps = spark.createDataFrame([
        ("r", index("i", "s1")), ("i", index("s2", "r")), ("s1", "<urlset><url><loc>u1?a=1&amp;b</loc></url></urlset>"),
        ("s2", '<urlset xmlns="http://x"><url><loc>u2</loc><lastmod>2024</lastmod></url><url><loc>u1</loc></url></urlset>'),
        ("lost", "<urlset><url><loc>u9</loc></url></urlset>"), ("bad", "<urlset><url>")], "url string, xml string")
    found = L.sitemap_expand(spark.createDataFrame([("r",)], "loc string"), maps)
    assert {(r.loc, r.lastmod) for r in found.collect()} == {("u1?a=1&b", None), ("u2", "2024"), ("u1", None)}


def test_sitemaps_of_any_depth(spark):
    chain = [(f"i{n}", f"<sitemapindex><sitemap><loc>i{n + 1}</loc></sitemap></sitemapindex>") for n in range(14)]
    maps = spark.createDataFrame([*chain, ("i14", "<urlset><url><loc>u</loc></url></urlset>")], "url string, xml string")
    assert [r.loc for r in L.sitemap_expand(spark.createDataFrame([("i0",)], "loc string"), maps).collect()] == ["u"]


def test_loose_files_are_pruned_by_name(spark, tmp_path):
    for name in ("a.png", "b.PNG", "c.txt", "d.jpg"):
        (tmp_path / name).write_bytes(b"x")
    found = L.read_files(spark, str(tmp_path), "images").collect()
    assert {r.name.rsplit("/", 1)[1] for r in found} >= {"a.png", "d.jpg"} and len(found) < 4


def file_stream(spark, df, files):
    path = scratch_path(spark, "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("files", [1, 4])
def test_streams_give_the_batch_result(spark, responses, files):
    pages = responses.filter("url <> ''")
    table, state = streams.changed_table(spark, scratch_path(spark, "t"), buckets=2), scratch_path(spark, "s")
    streams.stream_changed_pages(file_stream(spark, pages, files), table, state)
    assert {r.url for r in streams.read_changed(table).collect()} == {r.url for r in N.changed_pages(pages, None).collect()}

    refs = spark.createDataFrame([(f"a{i % 3}", f"p{i}") for i in range(30)], "asset_url string, source_page string")
    table, state = streams.asset_table(spark, scratch_path(spark, "t"), buckets=2), scratch_path(spark, "s")
    streams.stream_asset_dedup(file_stream(spark, refs, files), table, state)
    assert sorted(r.asset_url for r in table.read().collect()) == ["a0", "a1", "a2"]


def sources(spark, rows):
    df = spark.createDataFrame(rows, "parent_id string, content string, minute int")
    return df.select(
        "parent_id", F.lit("t").alias("title"), F.lit("http://h/x").alias("source_url"), F.lit("en").alias("language"),
        F.lit("s").alias("section"), F.lit("doc").alias("kind"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60).alias("crawled_at"),
        F.sha2("content", 256).alias("content_hash"), "content")


def test_index_refresh_replaces_whole_parents(spark):
    first = sources(spark, [("a", "x " * 2500, 0), ("b", "keep", 0), ("c", "will vanish", 0)])
    second = sources(spark, [("a", "short", 1), ("c", "", 1), ("b", "keep", 1)])
    path, at, state = (scratch_path(spark, n) for n in ("in", "t", "s"))
    table = sinks.index_table(spark, at, buckets=2)
    for batch in (first, second, second):
        batch.write.mode("append").parquet(path)
        streams.stream_index_refresh(spark.readStream.schema(first.schema).parquet(path), table, state)
    rows = streams.read_index(table).collect()
    assert {(r.id, r.chunk) for r in rows} == {("a_0", "short"), ("b_0", "keep")}


@pytest.fixture(scope="module")
def small_index(spark):
    rows = [("cats", "Cats sleep all day. " * 200, 0), ("dogs", "Dogs bark at cats.", 0), ("birds", "Birds sing.", 0)]
    path = scratch_path(spark, "index")
    return path, save_index(index_build.index_rows(sources(spark, rows)), path, 4)


def test_search_cards_facets_and_rejects(spark, small_index):
    asked = spark.createDataFrame([(1, "Cats?", None, None, None, 20, 0), (2, "", "en", None, None, 2, 1),
                                   (3, "x", None, None, None, 99, 0), (4, "cats", "fr", None, None, 20, 0)], QUERIES)
    response = search.search(asked, small_index[1])
    cards = {(r.qid, r.pos): r for r in response.results.collect()}
    assert cards[(1, 1)].parent_id in ("cats", "dogs") and sum(q == 1 for q, _ in cards) == 3
    assert "at" in cards[(1, 1)].caption.lower() and sum(q == 4 for q, _ in cards) == 0
    assert sum(q == 2 for q, _ in cards) == 1  # two chunks of one parent fill the page
    facets = {(r.qid, r.field): r["count"] for r in response.facets.collect()}
    assert facets[(2, "kind")] == facets[(1, "kind")] == 5
    assert [r.qid for r in response.rejected.collect()] == [3]
    assert {r.qid for r in response.answers.collect()} == {1}


def test_index_reads_back_from_any_session(spark, small_index):
    path, index = small_index
    other = spark.newSession()
    other.sql("DROP TABLE IF EXISTS " + "postings_" + path.rsplit("/", 1)[-1].replace("-", "_"))
    again = load_index(other, path, 4)
    assert again.postings.count() == index.postings.count() > 0


def test_postings_are_stored_as_lists(spark, small_index):
    """A row per chunk and field, not per term; the frequencies of terms are those of the postings."""
    from siteloom.operators import index as I
    index = small_index[1]
    assert index.lists.count() == index.postings.select("id", "field").distinct().count() < index.postings.count()
    assert sorted(map(tuple, index.term_df.collect())) == sorted(map(tuple, I.term_df(index.postings).collect()))
    assert sorted(map(tuple, I.postings(index.chunks).collect())) == sorted(map(tuple, index.postings.collect()))


def test_scoring_a_stored_index_needs_no_exchange(spark, small_index):
    from siteloom.operators import retrieve as R
    asked = spark.createDataFrame([(1, "cats dogs", None, None, None, 20, 0)], QUERIES)
    plan = R.bm25_scores(asked, small_index[1], facets=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_postings_by_term_are_read_where_the_terms_stand(spark):
    from siteloom.operators import index as I
    from siteloom.operators import retrieve as R
    rows = [(f"p{i}", f"common word{i} Word{i % 7} other{i % 3} words. " * 3, 0) for i in range(60)]
    path = scratch_path(spark, "index")
    index = save_index(index_build.index_rows(sources(spark, rows)), path, 4, by_term=True)
    assert index.shelves == 32 and load_index(spark.newSession(), path, 4).shelves == 32
    plain = replace(index, by_term=None)
    fields = ["term", "tf", "dl", "id", "field", "language"]
    assert sorted(index.by_term.select(*fields).collect()) == sorted(index.postings.select(*fields).collect())

    def scores(found):
        return sorted(tuple(r) for r in found.collect())
    few = spark.createDataFrame([(1, "word3 common", None, None, None, 20, 0), (2, "word5", "fr", None, None, 20, 0),
                                 (3, "nowhere", None, None, None, 20, 0)], QUERIES)
    weights = R.weighted_terms(few, index)
    read = R.asked_postings(index, weights)
    plan = read._jdf.queryExecution().executedPlan().toString()
    asked = {r[0] for r in weights.select(I.shelf(32)).distinct().collect()}
    assert "shelf" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term, [common,word3" in plan.split("PushedFilters: [")[1]
    files = {r[0].split("/shelf=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files <= {str(s) for s in asked} and 0 < len(asked) < 8
    assert {r.term for r in read.select("term").distinct().collect()} == {"common", "word3"} | {
        r.term for r in weights.select("term").distinct().collect()}
    assert scores(R.bm25_scores(few, index, facets=True)) == scores(R.bm25_scores(few, plain, facets=True)) != []
    every = spark.createDataFrame([(i, f"word{i} other{i % 3} common", None, None, None, 20, 0) for i in range(60)], QUERIES)
    assert R.asked_postings(index, R.weighted_terms(every, index)) is index.postings
    assert scores(R.bm25(every, index, most=1.0)) == scores(R.bm25(every, plain))
    nothing = spark.createDataFrame([], QUERIES)
    assert R.bm25_scores(nothing, index).count() == 0
    response = search.search(few, index)
    assert {r.qid for r in response.results.collect()} >= {1}


def test_a_crawl_takes_wanted_pages_and_links_assets(spark):
    def page(body):
        return f"<title>T</title><p>{body} with enough words to be kept as text.</p>"
    html = [("https://h.com/en/a", page("first") + '<img src="/i.png?v=1"><a href="/d.pdf">d</a>'), ("https://h.com/no/b", page("second")),
            ("https://other.org/c", page("third")), ("https://h.com/unlisted", page("fourth"))]
    rows = [(u, "text/html", h, None, 1) for u, h in html] + [("https://h.com/en/a", "text/html", page("older"), None, 0)]
    rows += [(f"https://h.com/{n}", c, None, bytearray(n.encode()), 2) for n, c in (
        ("i.png", "image/png"), ("d.pdf", "application/pdf"), ("x.pdf", "application/pdf"))]
    entries = "".join(f"<url><loc>{u}</loc><lastmod>2024-01-0{n}</lastmod></url>" for n, (u, _) in enumerate(html[:3], 1))
    sitemaps = spark.createDataFrame([("https://h.com/s.xml", f"<urlset>{entries}</urlset>")], "url string, xml string")
    robots = spark.createDataFrame([("h.com", "User-agent: *\nDisallow: /no/\nSitemap: https://h.com/s.xml")], "host string, body string")
    seeds = spark.createDataFrame([("https://h.com/robots.txt",)], "url string")
    store = sinks.artifact_store(spark, scratch_path(spark, "store"), buckets=2)

    def run(batch):
        return crawl.crawl(landed(spark, batch), seeds, sitemaps, robots, store, F.lit(T0)).counters
    assert run(rows) == {"uploaded_pages": 3, "uploaded_images": 1, "uploaded_docs": 2, "uploaded_snapshots": 0}
    stored = {r["name"].rsplit(".", 1)[-1] + str("x-" in r["name"]): r for r in store.read().collect()}
    assert json.loads(bytes(stored["jsonFalse"]["data"]))["lastmod"] == "2024-01-01"
    assert "first" in bytes(stored["mdFalse"]["data"]).decode()
    told = {k: (r["metadata"]["sourcepage"], r["metadata"]["language"]) for k, r in stored.items() if "sourcepage" in r["metadata"]}
    page_url = "https%3A%2F%2Fh.com%2Fen%2Fa"
    assert told == {"pngFalse": (page_url, "en"), "pdfFalse": (page_url, "en"), "pdfTrue": ("https%3A%2F%2Fh.com%2Fx.pdf", "unknown")}
    version = store.state().version
    assert set(run(rows).values()) == {0} and store.read().count() == 6 and store.state().version == version + 1
