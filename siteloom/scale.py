"""Helpers that keep joins, ranks and lineage safe on large inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the one the cluster names; a local
    session without that setting (tests) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="siteloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise once in the shared folder, so that later jobs neither
    recompute the lineage nor lose it with an executor. If not ``eager``, the first of these jobs does it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """The same for a wide intermediate that several jobs read by column: a
    Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a file scan over all cores when it has fewer files than
    that (a file of one row group is read by one task, however it is split); a
    table of many files is left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if len(scan.inputFiles()) < cores else scan


def byte_size(df: DataFrame) -> int:
    """Serialised size of a DataFrame, summed on the executors."""
    measured = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    return int(measured.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0])


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    return byte_size(df) <= max_bytes


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large side with a lookup side whose size is measured first.

    Small: broadcast, so the large side never moves. Else both sides shuffle once
    on the keys and no row is copied; a task whose key is hot on the large side
    is split by adaptive execution, which copies the lookup rows of that task only.
    ``how`` is inner, left, left_semi or left_anti, for all of which the large
    (left) side can be split.
    """
    if is_small(right, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def allow_early_limit(spark: SparkSession, k: int) -> None:
    """Spark limits a ranked window before its shuffle only up to a threshold;
    raise it where a deeper rank is asked for."""
    if int(spark.conf.get(GROUP_LIMIT, "1000")) < k:
        spark.conf.set(GROUP_LIMIT, str(k))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank",
          salts: int = SALTS) -> DataFrame:
    """Exact first ``k`` rows of every key, ranked from 1.

    Every task keeps its own first ``k`` per key before anything is shuffled;
    those are merged in ``salts`` groups of tasks and then once more, so the
    last sort of a key sees ``salts * k`` rows, however many tasks there were.
    """
    allow_early_limit(df.sparkSession, k)
    group = F.pmod(F.spark_partition_id(), F.lit(salts))
    first = Window.partitionBy(*keys, "_group").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_group", group)
            .withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= k)
            .withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= k)
            .drop("_group"))
