"""Helpers shared by the corpus operators: row identity and bounded filters."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.kernel import Bitmap

BITMAP_BYTES = 4 << 20


def discard(table: DataFrame) -> None:
    """Delete the files of a written intermediate that no later step reads."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Hand rows to Python in batches of at most this size while the jobs within run."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """128 bits that name a row by its id and text. Rows equal in both are the same document
    and get the same result; a null counts as a value of its own in the id, as empty in the text."""
    first = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns[:-1]]
    return F.md5(F.concat(*first, F.lit("|"), F.coalesce(F.col(columns[-1]), F.lit(""))))


def bitmap_of(hashes: DataFrame, column: str, size_bytes: int = BITMAP_BYTES) -> Bitmap:
    """A bitmap of one long column. Its size is fixed (``size_bytes``), whatever the table's, so it
    may be sent to every task. Built by a map-side bit-or; the driver gets its words only."""
    bits = size_bytes * 8
    assert bits & (bits - 1) == 0, "a power of two"
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (hashes.filter(F.col(column).isNotNull()).select(at.alias("at"))
             .groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value")).toPandas())
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["value"].to_numpy(dtype=np.int64)
    return Bitmap(out.view(np.uint8))
