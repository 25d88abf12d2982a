"""Landing records as artifacts, and tables that survive replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.scale import checkpointed, lookup_join
from siteloom.schemas import ARTIFACTS, CHUNKS
from siteloom.sources.versioned import BUCKETS, State, VersionedTable

# Container of each kind of record; anything else lands in docs.
CONTAINERS = {"page": "pages", "image": "images", "doc": "docs", "snapshot": "snapshots"}
FALLBACK_CONTAINER = "docs"


def container_of(kind: str | Column) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    known = F.create_map(*[F.lit(v) for pair in CONTAINERS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(kind, F.lit(""))), F.lit(FALLBACK_CONTAINER))


def route(records: DataFrame) -> DataFrame:
    """Add the container each record belongs to."""
    return records.withColumn("container", container_of("kind"))


def iso_time(ts: str | Column) -> Column:
    """Timestamp as ISO-8601 UTC text."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _metadata(**values: Column) -> Column:
    return F.create_map(*[c for name, v in values.items() for c in (F.lit(name), v)])


def page_bundle(pages: DataFrame) -> DataFrame:
    """Three artifacts per page: HTML, Markdown and a JSON description."""
    crawled = iso_time("crawled_at")
    meta = _metadata(
        sourceurl=U.percent_encode("url"), title=X.header_safe("title"),
        crawledat=U.percent_encode(crawled),
        language=U.percent_encode(F.coalesce("language", F.lit("unknown"))),
        section=U.percent_encode(F.coalesce("section", F.lit("unknown"))),
        contenthash=F.col("content_hash"), kind=F.lit("page"))
    described = F.to_json(F.struct(
        F.col("url").alias("sourceUrl"), "title", "language", "section",
        F.col("content_hash").alias("contentHash"), crawled.alias("crawledAt"), "lastmod"),
        {"ignoreNullFields": "false"})

    def artifact(ext: str, content_type: str, data: Column) -> Column:
        return F.struct(F.lit("pages").alias("container"),
                        F.concat(F.col("base_name"), F.lit(ext)).alias("name"),
                        F.lit(f"{content_type}; charset=utf-8").alias("content_type"),
                        F.encode(F.coalesce(data, F.lit("")), "UTF-8").alias("data"),
                        meta.alias("metadata"))

    return pages.select(F.inline(F.array(
        artifact(".html", "text/html", F.col("html")),
        artifact(".md", "text/markdown", F.col("markdown")),
        artifact(".json", "application/json", described))))


def binary_artifact(assets: DataFrame) -> DataFrame:
    """One artifact per image, document or snapshot."""
    given = F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit(X.DEFAULT_MEDIA_TYPE))
    snapshot = F.when(F.contains(given, F.lit("pdf")), U.blob_name("url", "pdf")).otherwise(
        U.blob_name("url", "png"))
    name = F.when(F.col("kind") == "snapshot", snapshot).otherwise(U.blob_name("url"))
    return assets.withColumn("_name", name).select(
        container_of("kind").alias("container"), F.col("_name").alias("name"),
        F.substring_index(given, ";", 1).alias("content_type"), F.col("body").alias("data"),
        _metadata(
            sourceurl=U.percent_encode("url"),
            title=X.header_safe(F.substring_index("_name", "/", -1)),
            sourcepage=U.percent_encode("source_page"),
            crawledat=U.percent_encode(iso_time("crawled_at")),
            language=U.percent_encode(F.coalesce("language", F.lit("unknown"))),
            contenthash=F.col("content_hash"), kind=U.percent_encode("kind")).alias("metadata"))


def latest(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, by map-side aggregation."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins per key: the update latest in ``order`` replaces the
    stored row. Only the updates are aggregated (once, with map-side combine); stored
    rows are dropped by key and never sorted."""
    new = checkpointed(latest(updates, keys, order))
    kept = lookup_join(target, new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def upsert_stored(table: VersionedTable, updates: DataFrame, order: list[str],
                  mark: tuple[str, int] | None = None) -> State:
    """The same into a stored table: the winning updates become its newest rows, in the
    buckets they fall into; nothing that is stored is read."""
    return table.write(latest(updates, table.key, order), mark)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Several containers feed one index; a missing column is null."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out


def index_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """The stored chunk rows of an index: parents are replaced whole."""
    return VersionedTable(spark, path, CHUNKS, ["parent_id"], buckets=buckets)


def write_index(chunks: DataFrame, table: VersionedTable, mark: tuple[str, int] | None = None) -> State:
    """Chunk rows of a run; the chunks of a parent lie together (a huge parent is split over
    several files) and replace all it had."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in chunks.columns]
    return table.write(chunks.select("*", *missing), mark, spread=(F.floor(F.col("ord") / 512),))


def artifact_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """Stored artifacts by (container, name), a partition for each container: the last write of a name
    wins, and scanning one container opens no file of the others."""
    return VersionedTable(spark, path, ARTIFACTS, ["container", "name"], by=("container",), buckets=buckets)


def stored_manifest(store: VersionedTable, modified_at: Column) -> DataFrame:
    """What a store holds, as a manifest; the artifacts' data is not read."""
    page = F.col("container") == "pages"
    return store.read().select(
        "container", "name", F.when(page, F.regexp_replace("name", r"\.(html|md|json)$", "")).alias("base_name"),
        F.try_element_at("metadata", F.lit("contenthash")).alias("content_hash"),
        modified_at.alias("modified_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
