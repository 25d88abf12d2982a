"""Inputs the given tables lack, derived from whole tables by Spark.

Each is also written as SQL in ``checks.oracle``. What differs between rows is
decided by what a row holds (a query string, a fragment, a language), so every
row takes part and the inputs grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators.extract import page_title, visible_text
from siteloom.scale import spread

EPOCH = 1704067200  # 2024-01-01T00:00:00Z
DAY = 86400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def minutes(column: str) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + F.col(column) * 60)


def days(column: str) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + F.col(column) * DAY)


def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "url", F.lit("text/html; charset=utf-8").alias("content_type"), "html",
        F.lit(None).cast("binary").alias("body"), minutes("page_id").alias("fetched_at"))


def landed(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, documents as PDF responses and embeddings as image responses."""
    none = F.lit(None).cast("string").alias("html")
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("https://files.example.com/"), "lang", F.lit("/"), "source", F.lit("/"),
                 "doc_id", F.lit(".pdf")).alias("url"),
        F.lit("Application/PDF; v=1").alias("content_type"), none,
        F.encode("text", "UTF-8").alias("body"), minutes("doc_id").alias("fetched_at"))
    images = table(spark, sf, "embeddings").select(
        F.concat(F.lit("https://img.example.com/"), "label", F.lit("/"), "vec_id",
                 F.lit(".PNG")).alias("url"),
        F.lit("image/png").alias("content_type"), none,
        F.encode(F.col("vec_id").cast("string"), "UTF-8").alias("body"),
        minutes("vec_id").alias("fetched_at"))
    return landed_pages(spark, sf).unionByName(docs).unionByName(images)


def pages_with_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with image, source and document tags appended to their HTML. The
    language image and section document are shared by very many pages."""
    tags = F.concat(
        F.lit('<img src="/img/'), U.language_from_url("url"), F.lit('.png?v=1">'),
        F.lit('<img data-src="b.jpg">'),
        F.lit('<source srcset="/s/'), F.col("page_id"), F.lit('.webp 2x">'),
        F.lit('<a href="/d/'), U.section_from_url("url"), F.lit('.pdf?x=1#p2">pdf</a>'),
        F.lit('<a href="https://other.test/x.pdf">other</a>'))
    return table(spark, sf, "pages").select("page_id", "url", F.concat("html", tags).alias("html"))


def site_pages(spark: SparkSession, sf: str, moved: bool = False) -> DataFrame:
    """Those pages as responses; ``moved``: pages with a query string have changed."""
    html = F.when(F.contains("url", F.lit("?")), F.concat("html", F.lit("<p>moved</p>"))).otherwise(F.col("html")) if moved else F.col("html")
    return pages_with_assets(spark, sf).select(
        "url", F.lit("text/html; charset=utf-8").alias("content_type"), html.alias("html"),
        F.lit(None).cast("binary").alias("body"), minutes("page_id").alias("fetched_at"))


def site_files(spark: SparkSession, sf: str) -> DataFrame:
    """Responses for the files those pages link on their own site."""
    site = F.regexp_extract("url", "^[^/]*//[^/?#]*", 0)

    def file(folder: str, name: Column, ending: str, content_type: str) -> Column:
        return F.struct(F.concat(site, F.lit(folder), name, F.lit(ending)).alias("url"), F.lit(content_type).alias("content_type"))

    files = table(spark, sf, "pages").select(F.explode(F.array(
        file("/img/", U.language_from_url("url"), ".png", "image/png"),
        file("/s/", F.col("page_id").cast("string"), ".webp", "image/webp"),
        file("/d/", U.section_from_url("url"), ".pdf", "application/pdf"))).alias("f"))
    return files.select("f.url", "f.content_type").distinct().select(
        "url", "content_type", F.lit(None).cast("string").alias("html"), F.encode("url", "UTF-8").alias("body"),
        F.timestamp_seconds(F.lit(EPOCH)).alias("fetched_at"))


def robots_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return robots(spark, sf).select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url"))


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("url").alias("source_page"),
        F.concat(F.lit("https://cdn.example.com/r/"), U.section_from_url("url"),
                 F.lit(".png?w=1")).alias("asset_url"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier run stored. Pages with a fragment are new since, those
    with a query string have another hash, those ending in / were deleted."""
    base, name_hash = U.page_base_name("url"), U.content_hash("html")
    return table(spark, sf, "pages").filter(~F.contains("url", F.lit("#"))).select(
        F.lit("pages").alias("container"), F.concat(base, F.lit(".html")).alias("name"),
        base.alias("base_name"),
        F.when(F.contains("url", F.lit("?")), F.reverse(name_hash)).otherwise(name_hash).alias("content_hash"),
        days("page_id").alias("modified_at"),
        F.when(F.endswith("url", F.lit("/")), days("page_id")).alias("deleted_at"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Stored snapshots: of the pages named .html."""
    return table(spark, sf, "pages").filter(U.url_extension("url") == ".html").select(
        F.lit("snapshots").alias("container"), U.snapshot_name("url").alias("name"),
        F.lit(None).cast("string").alias("base_name"), F.lit(None).cast("string").alias("content_hash"),
        days("page_id").alias("modified_at"), F.lit(None).cast("timestamp").alias("deleted_at"))


def docs_src(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as index sources; the first line is the title."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("parent_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://docs.example.com/"), "lang", F.lit("/"), "source", F.lit("/"),
                 "doc_id", F.lit(".html")).alias("source_url"),
        F.col("lang").alias("language"), F.col("source").alias("section"), F.lit("doc").alias("kind"),
        minutes("doc_id").alias("crawled_at"), U.content_hash("text").alias("content_hash"),
        F.col("text").alias("content"))


def pages_src(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as index sources, by their visible text."""
    return table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), U.page_base_name("url")).alias("parent_id"),
        page_title("html").alias("title"), F.col("url").alias("source_url"),
        U.language_from_url("url").alias("language"), U.section_from_url("url").alias("section"),
        F.lit("page").alias("kind"), minutes("page_id").alias("crawled_at"),
        U.content_hash("html").alias("content_hash"), visible_text("html").alias("content"))


def ocr_text(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as image texts of the document with their number,
    spread over it by turn."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "n_chars")
    return table(spark, sf, "conversations").join(docs, "conv_id").select(
        F.concat(F.lit("doc-"), "conv_id").alias("parent_id"),
        F.expr("n_chars * turn div 9").alias("content_offset"), F.col("turn").cast("int").alias("ord"),
        "text")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as queries, and one blank query per language. Items with
    the word "the" ask for English only; items of several lines skip sixty. One blank
    query is of tabs and line breaks."""
    none = F.lit(None).cast("string")
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("q"),
        F.when(F.contains("text", F.lit(" the ")), "en").alias("language"), none.alias("section"),
        none.alias("kind"), F.lit(20).alias("top"),
        F.when(F.contains("text", F.lit("\n")), 60).otherwise(0).alias("skip"))
    blank = table(spark, sf, "documents").groupBy("lang").agg(F.min("doc_id").alias("d")).select(
        (-1 - F.col("d")).alias("qid"), F.when(F.col("lang") == "en", "\t\n").otherwise("").alias("q"), F.col("lang").alias("language"),
        none.alias("section"), none.alias("kind"), F.lit(20).alias("top"), F.lit(0).alias("skip"))
    return asked.unionByName(blank)


def raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    """All conversation turns as unchecked queries."""
    return table(spark, sf, "conversations").select(
        F.expr("conv_id * 100 + turn").alias("qid"), F.col("text").alias("q"),
        F.col("role").alias("language"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("string").alias("kind"), (F.col("turn") * 9).cast("int").alias("top"),
        (F.col("conv_id") * 11 - 1).cast("int").alias("skip"))


def robots(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(U.url_host("url").alias("host")).distinct()
    return hosts.select("host", F.concat(
        F.lit("User-agent: *\nDisallow: /es/ # none\nAllow: /es/5\nSitemap: https://"), "host",
        F.lit("/sitemap.xml\n")).alias("body"))


def sitemap_xml(spark: SparkSession, sf: str) -> DataFrame:
    """(url, xml): per host an index of group indexes of url sets. A file lists
    a thousand entries at most, as the protocol limits files too."""
    lastmod = F.when(F.contains("url", F.lit("#")), F.lit("")).otherwise(
        F.concat(F.lit("<lastmod>"), F.date_format(minutes("page_id"), "yyyy-MM-dd"), F.lit("</lastmod>")))
    pages = table(spark, sf, "pages").select(
        U.url_host("url").alias("host"), F.expr("page_id div 1000").alias("shard"),
        F.expr("page_id div 1000000").alias("grp"),
        F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"),
                 lastmod, F.lit("</url>")).alias("entry"))
    site = F.concat(F.lit("https://"), "host")

    def document(tag: str) -> Column:
        return F.concat(F.lit(f'<?xml version="1.0"?><{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                        F.array_join(F.collect_list("entry"), ""), F.lit(f"</{tag}>")).alias("xml")

    def nested(loc: Column) -> Column:
        return F.concat(F.lit("<sitemap><loc>"), loc, F.lit("</loc></sitemap>")).alias("entry")

    leaf = F.concat(site, F.lit("/sitemap-"), "shard", F.lit(".xml"))
    group = F.concat(site, F.lit("/sitemap-group-"), "grp", F.lit(".xml"))
    root = F.concat(site, F.lit("/sitemap.xml"))
    shards = pages.select("host", "shard", "grp").distinct()
    sets = pages.groupBy(leaf.alias("url")).agg(document("urlset"))
    groups = shards.select(group.alias("url"), nested(leaf)).groupBy("url").agg(document("sitemapindex"))
    roots = shards.select("host", "grp").distinct().select(root.alias("url"), nested(group)) \
        .groupBy("url").agg(document("sitemapindex"))
    return sets.unionByName(groups).unionByName(roots)
