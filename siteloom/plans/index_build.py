"""Sources to index rows: merge, split, embed, project."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import media_type
from siteloom.operators import index as I
from siteloom.scale import written

Embedder = Callable[[pd.Series], list[list[float]]]


def with_vectors(df: DataFrame, column: str, fn: Embedder | None = None) -> DataFrame:
    """Vectors for chunks or queries; both sides must use the same embedder."""
    return I.embed_udf(df, fn, column) if fn else I.embed_hash(df, column)


def index_rows(sources: DataFrame, ocr_text: DataFrame | None = None, boundary: bool = False,
               fn: Embedder | None = None) -> DataFrame:
    """Chunk rows of sources (parent_id, title, ..., content)."""
    return I.project_index(with_vectors(passages(sources, ocr_text, boundary), "chunk", fn))


def passages(sources: DataFrame, ocr_text: DataFrame | None = None, boundary: bool = False) -> DataFrame:
    merged = sources if ocr_text is None else I.merge_inserts(sources, ocr_text)
    return I.nonempty(I.chunk_text(merged, boundary=boundary))


def index_rows_and_rejects(sources: DataFrame, fn: Embedder, ocr_text: DataFrame | None = None,
                           boundary: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index rows, rejected passages with ``error``) where a user's model may fail on some texts; the vectors are
    written, so the model runs once."""
    made = written(I.embed_tolerant(passages(sources, ocr_text, boundary), fn), "vectors")
    return I.project_index(made.filter("error is null")), made.filter("error is not null").drop("vector")


def page_sources(pages: DataFrame) -> DataFrame:
    """Page rows with Markdown as index sources."""
    return pages.select(
        F.concat(F.lit("page-"), "base_name").alias("parent_id"), "title",
        F.col("url").alias("source_url"), "language", "section", F.lit("page").alias("kind"),
        "crawled_at", "content_hash", F.col("markdown").alias("content"))


def text_assets(assets: DataFrame) -> DataFrame:
    """Binary rows whose text was cracked upstream (column ``text``) as index
    sources; they have no section."""
    return assets.select(
        F.concat(F.lit("asset-"), F.sha2("url", 256)).alias("parent_id"),
        F.substring_index("url", "/", -1).alias("title"), F.col("url").alias("source_url"),
        "language", "kind", "crawled_at", "content_hash",
        media_type("content_type").alias("media_type"), F.col("text").alias("content"))
