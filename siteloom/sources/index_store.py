"""The search index as written tables, built once and read by every query."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators import index as I

BUCKET_BYTES = 64 * 1024 * 1024
SHELVES_PER_BUCKET, MAX_SHELVES = 8, 4096
FILE_LISTS = 5_000_000
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# Shuffle files go when the table they were for is written, not when the driver happens to collect its garbage.
GIVE_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TASK_BYTES, PACKED_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"


def save_index(chunks: DataFrame, path: str, buckets: int | None = None, by_term: bool = False) -> I.SearchIndex:
    """Write the index below ``path`` and return it as read back.

    Postings are stored as lists, bucketed by id: scoring, which groups by (query, id), then
    reads whole groups per task and needs no exchange. With ``by_term`` they are written
    by term too, for small query batches.
    """
    spark = chunks.sparkSession
    split = chunks.repartition("parent_id", (chunks["ord"] / 512).cast("int"))
    with _held(spark, GIVE_BACK, "true"):
        split.sortWithinPartitions("parent_id", "ord").write.mode("overwrite").parquet(f"{path}/chunks")
    stored = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    buckets = buckets or _bucket_count(stored)
    with _held(spark, GIVE_BACK, "true"), _held(spark, OPEN_FILES, "4"):  # postings come bucket by bucket, so they need not be sorted by it
        (I.posting_lists(stored, buckets).write.mode("overwrite").format("parquet").bucketBy(buckets, "id")
         .option("path", f"{path}/postings").saveAsTable(_table(path)))
    lists = spark.table(_table(path))
    lengths = lists.select("id", "field", "dl").distinct()
    with _held(spark, GIVE_BACK, "true"):
        I.term_df(lists.select("field", F.explode("terms").alias("term"))).write.mode("overwrite").parquet(f"{path}/term_df")
    I.corpus_stats(lengths).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    if by_term:
        save_by_term(lists, path, min(MAX_SHELVES, SHELVES_PER_BUCKET * buckets))
    return load_index(spark, path, buckets)


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session has this value meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def save_by_term(posted: DataFrame, path: str, shelves: int) -> None:
    """Write postings, or their lists, by term. What is shuffled and stored of a posting is a place and a count, in packs, as
    ``index.inverted`` makes them. Lists of a frequent term are dealt over several files of its shelf: adaptive
    execution cuts large partitions and joins small ones."""
    rows = I.unpacked(I.inverted(posted, shelves).hint("rebalance", "shelf"))
    with _held(posted.sparkSession, GIVE_BACK, "true"), _held(posted.sparkSession, TASK_BYTES, PACKED_BYTES):  # rows to sort are some ten times as large as their packs
        (rows.sortWithinPartitions("shelf", "field", "term", "block").write.mode("overwrite").option("compression", "zstd")
         .option("maxRecordsPerFile", FILE_LISTS).partitionBy("shelf").parquet(f"{path}/by_term"))
    sizes = posted.sparkSession.createDataFrame([(shelves,)], "shelves int")
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/shelves")


def with_terms(index: I.SearchIndex, path: str) -> I.SearchIndex:
    """The index with the postings by term that stand below ``path``."""
    spark = index.chunks.sparkSession
    shelves = spark.read.schema("shelves int").parquet(f"{path}/shelves").first()[0]
    read = spark.read.schema(f"{I.INVERTED_DDL}, shelf int").parquet(f"{path}/by_term")
    return replace(index, by_term=I.upright(read), shelves=shelves, inverted=read)


def _has_terms(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shelves/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _bucket_count(stored: DataFrame) -> int:
    """A bucket is one task when it is read, so their number follows the text."""
    size = stored.agg(F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0))).first()[0]
    least = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // BUCKET_BYTES))


def load_index(spark: SparkSession, path: str, buckets: int) -> I.SearchIndex:
    """Read a written index, from any session."""
    if not spark.catalog.tableExists(_table(path)):
        spark.sql(f"CREATE TABLE {_table(path)} ({I.LISTS_DDL}) USING parquet CLUSTERED BY (id) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{path}/postings'")
    lists = spark.table(_table(path))
    index = I.SearchIndex(
        chunks=spark.read.parquet(f"{path}/chunks"),
        postings=I.flat(lists),
        term_df=spark.read.schema("field string, term string, df bigint").parquet(f"{path}/term_df"),
        corpus_stats=spark.read.schema("field string, n bigint, avgdl double").parquet(
            f"{path}/corpus_stats"),
        lists=lists)
    return with_terms(index, path) if _has_terms(spark, path) else index


def _table(path: str) -> str:
    return "postings_" + "".join(c if c.isalnum() else "_" for c in path.rstrip("/").rsplit("/", 1)[-1])
