"""Incremental runs as streams: each micro-batch runs the batch operators and writes one version of a
stored table, marked with its number, so a replay changes nothing. A batch reads the buckets its own keys
fall into and no other part of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siteloom.operators import extract as X
from siteloom.operators import incremental as N
from siteloom.plans.index_build import index_rows
from siteloom.scale import checkpointed
from siteloom.schemas import CHUNKS
from siteloom.sources import sinks
from siteloom.sources.versioned import BUCKETS, VersionedTable

ASSET_SCHEMA = T.StructType([T.StructField("asset_url", T.StringType()),
                             T.StructField("source_page", T.StringType())])
STORED_SCHEMA = T.StructType([*[T.StructField(n, T.StringType()) for n in ("base_name", "url", "content_hash")],
                              T.StructField("batch", T.LongType())])
MARK = "batch"
PIECES = 32


def run_available(stream: DataFrame, checkpoint: str,
                  each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has arrived since the last run, then stop."""
    query = (stream.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()
    return query


def into(table: VersionedTable, batch_of: Callable[[DataFrame, int], DataFrame], **more) -> Callable[[DataFrame, int], None]:
    """Write what ``batch_of`` makes of each batch, unless the table has that batch already."""
    def each(batch: DataFrame, number: int) -> None:
        if not table.done((MARK, number)):
            table.write(batch_of(batch, number), (MARK, number), **more)
    return each


def asset_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """Seen assets; each is written once."""
    return VersionedTable(spark, path, ASSET_SCHEMA, ["asset_url"], buckets=buckets, once=True)


def stream_asset_dedup(refs: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Seen-asset table over micro-batches: each asset URL is stored once.

    A batch is reduced by hash aggregation first, so an asset on every page is
    no hot key; only unseen URLs are then written. The table is the state.
    """
    def unseen(batch: DataFrame, number: int) -> DataFrame:
        new = checkpointed(X.asset_dedup(batch.select("asset_url", "source_page")))
        return new.join(table.near(new).select("asset_url"), "asset_url", "left_anti")
    return run_available(refs, checkpoint, into(table, unseen))


def unique_assets(refs: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The same with Spark's own state: a stream of each asset URL's first row. Without ``event_time`` the state
    keeps every URL; with it a URL is forgotten ``delay`` after it was seen, so the state stays bounded and
    repeats within that time are dropped."""
    if event_time is None:
        return refs.dropDuplicates(["asset_url"])
    return refs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["asset_url"])


def changed_table(spark: SparkSession, path: str, manifest: DataFrame | None = None, buckets: int = BUCKETS) -> VersionedTable:
    """Key and hash of known pages. The start manifest is written once, as rows without a batch."""
    table = VersionedTable(spark, path, STORED_SCHEMA, ["base_name"], buckets=buckets)
    if manifest is not None and not table.done(("manifest", 0)):
        start = N.known_hashes(manifest).withColumns({"url": F.lit(None).cast("string"), "batch": F.lit(None).cast("long")})
        table.write(start, ("manifest", 0))
    return table


def stream_changed_pages(landed: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Store the key and hash of every landed page that is new or changed,
    against the start manifest and all earlier batches."""
    def changed(batch: DataFrame, number: int) -> DataFrame:
        keys = N.page_keys(batch).select("base_name", "url", "content_hash", "fetched_at")
        new = checkpointed(sinks.latest(keys, ["base_name"], ["fetched_at", "content_hash"]))
        known = table.near(new).select("base_name", "content_hash")
        return new.join(known, ["base_name", "content_hash"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
    return run_available(landed, checkpoint, into(table, changed))


def read_changed(table: VersionedTable) -> DataFrame:
    """The last stored state of every page that any batch changed."""
    return table.read().filter("batch is not null").drop("batch")


def stream_index_refresh(sources: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Rebuild the chunks of new or changed sources. A source without text
    leaves one empty marker row, which hides its earlier chunks."""
    def rebuilt(batch: DataFrame, number: int) -> DataFrame:
        new = checkpointed(sinks.latest(batch, ["parent_id"], ["crawled_at", "content_hash"]))
        known = table.near(new).select("parent_id", "content_hash").distinct()
        changed = checkpointed(new.join(known, ["parent_id", "content_hash"], "left_anti"))
        rows = index_rows(changed)
        gone = changed.filter(F.coalesce("content", F.lit("")) == "").select("parent_id", "content_hash")
        marked = rows.unionByName(gone.withColumn("ord", F.lit(0)), allowMissingColumns=True)
        return marked.select(*CHUNKS.fieldNames())
    # A bucket's rows are dealt over PIECES tasks and more; adaptive execution joins small ones.
    pieces = (F.pmod(F.hash("parent_id"), F.lit(PIECES)), F.floor(F.col("ord") / 512))
    return run_available(sources, checkpoint, into(table, rebuilt, spread=pieces))


def read_index(table: VersionedTable) -> DataFrame:
    """Current chunk rows of a refreshed index, without marker rows."""
    return table.read().filter("chunk is not null")
