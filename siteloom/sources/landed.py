"""Reading landed responses, loose files, robots texts and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.urls import name_extension
from siteloom.scale import checkpointed
from siteloom.schemas import LANDED

# File types indexed from each container.
INDEXED_EXTENSIONS = {
    "pages": (".md",),
    "docs": (".pdf",),
    "images": (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".gif"),
    "snapshots": (".png", ".pdf"),
}
# The parts of a sitemap document that are read.
SITEMAP_SCHEMA = ("url array<struct<loc string, lastmod string>>, "
                  "sitemap array<struct<loc string, lastmod string>>")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses from Parquet under the fixed schema."""
    return spark.read.schema(LANDED).parquet(path)


def read_files(spark: SparkSession, path: str, container: str) -> DataFrame:
    """Loose files of a container as artifacts, pruned by file name first."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in INDEXED_EXTENSIONS[container]) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)
    return files.select(F.lit(container).alias("container"), F.col("path").alias("name"),
                        F.col("content").alias("data"), F.col("modificationTime").alias("modified_at"))


def scan_container(artifacts: DataFrame, container: str,
                   extensions: tuple[str, ...] | None = None) -> DataFrame:
    """A container's artifacts of the indexed file types."""
    wanted = extensions or INDEXED_EXTENSIONS[container]
    return artifacts.filter((F.col("container") == container)
                            & name_extension("name").isin(*wanted))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, loc): sitemap URLs robots texts advertise."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    return robots.select("host", F.explode(found).alias("loc"))


def _parsed(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.withColumn("_doc", F.from_xml("xml", F.lit(SITEMAP_SCHEMA)))


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, loc, lastmod): page entries of url sets."""
    entries = _parsed(sitemaps).select(F.col("url").alias("sitemap"), F.inline("_doc.url"))
    return entries.select("sitemap", F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod")) \
        .filter("loc <> ''")


def sitemap_expand(seeds: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Page entries reachable from the seed sitemaps through nested indexes.

    Breadth first over (parent, child) pairs only; every round is cut off by a
    checkpoint and the documents themselves are joined once at the end. Each
    sitemap is visited once, so cycles end, and any depth is followed.
    """
    children = checkpointed(
        _parsed(sitemaps).select(F.col("url").alias("loc"), F.inline("_doc.sitemap").alias("child", "_"))
        .select("loc", F.trim("child").alias("child")).filter("child <> ''"))
    visited = checkpointed(seeds.select("loc").distinct())
    frontier = visited
    while not frontier.isEmpty():
        found = children.join(frontier, "loc", "left_semi").select(F.col("child").alias("loc"))
        frontier = checkpointed(found.distinct().join(visited, "loc", "left_anti"))
        visited = checkpointed(visited.unionByName(frontier))
    reached = sitemaps.join(visited.withColumnRenamed("loc", "url"), "url", "left_semi")
    return sitemap_entries(reached)
