"""Facets, paging, collapse and the shapes results are shown in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import collapse_space
from siteloom.functions.urls import percent_decode
from siteloom.scale import top_k
from siteloom.schemas import FILTER_FIELDS, fields_with
from siteloom.sources.sinks import iso_time

FACET_SIZE = 20
SNIPPET, CLI_SNIPPET = 400, 160
UNTITLED = "(untitled)"


def facets(candidates: DataFrame, n: int = FACET_SIZE,
           fields: tuple[str, ...] = FILTER_FIELDS) -> DataFrame:
    """(qid, field, value, count): the n most frequent values of each field.

    Candidates are first counted per value combination; only those few counts
    go through the grouping sets.
    """
    wrong = set(fields) - fields_with("facetable")
    if wrong:
        raise ValueError(f"not facetable: {sorted(wrong)}")
    if "n" not in candidates.columns:
        candidates = candidates.groupBy("qid", *fields).agg(F.count("*").alias("n"))
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    counted = candidates.select("qid", "n", F.inline(values)).filter("value is not null") \
        .groupBy("qid", "field", "value").agg(F.sum("n").alias("count"))
    top = top_k(counted, ["qid", "field"], [F.desc("count"), F.asc("value")], n)
    return top.select("qid", "field", "value", "count")


def page_slice(ranked: DataFrame) -> DataFrame:
    """Rows (qid, rn, skip, top) of each query's page; applied to chunks, so a
    page may collapse to fewer cards than ``top``."""
    return ranked.filter((F.col("rn") > F.col("skip")) & (F.col("rn") <= F.col("skip") + F.col("top")))


def collapse(page: DataFrame) -> DataFrame:
    """One row per parent, else per decoded URL, else per row.

    It keeps the first position of its group and the content of the best
    reranked chunk; equal scores keep the earlier one. Pages hold 50 rows at
    most, so the window stays small.
    """
    key = F.coalesce(F.concat(F.lit("p:"), F.nullif(F.col("parent_id"), F.lit(""))),
                     F.concat(F.lit("u:"), F.nullif(percent_decode("source_url"), F.lit(""))),
                     F.concat(F.lit("r:"), F.col("rn").cast("string")))
    group = Window.partitionBy("qid", "_key")
    best = group.orderBy(F.coalesce("reranker", F.lit(0.0)).desc(), F.asc("rn"))
    return (page.withColumn("_key", key)
            .withColumns({"_best": F.row_number().over(best), "first_rn": F.min("rn").over(group)})
            .filter("_best = 1")
            .withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("first_rn")))
            .drop("_key", "_best", "first_rn"))


def first_per_parent(ranked: DataFrame) -> DataFrame:
    """One row per parent, before paging: it stands where the first chunk of its parent stood and holds the best
    reranked one, so that a page has as many cards as asked for.

    ``rn`` is counted anew over parents. The parent is read from the chunk id (parent, '_', number), so no stored
    field is fetched. Lists are limited before, so the windows stay small.
    """
    group = Window.partitionBy("qid", "_parent")
    best = group.orderBy(F.coalesce("reranker", F.lit(0.0)).desc(), F.asc("rn"))
    return (ranked.withColumn("_parent", F.regexp_replace("id", "_[0-9]+$", ""))
            .withColumns({"_best": F.row_number().over(best), "_first": F.min("rn").over(group)})
            .filter("_best = 1")
            .withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("_first")))
            .drop("_parent", "_best", "_first"))


def result_card(df: DataFrame) -> DataFrame:
    """The fields of a result card. Title and URL are decoded for display."""
    title = F.coalesce(F.nullif(percent_decode(F.coalesce("title", F.lit(""))), F.lit("")), F.lit(UNTITLED))
    return df.select(
        "qid", "pos", "parent_id", title.alias("title"),
        percent_decode(F.coalesce("source_url", F.lit(""))).alias("source_url"), "language", "section",
        "kind", iso_time("crawled_at").alias("crawled_at"), "score", "reranker", "caption",
        F.substr(F.coalesce("chunk", F.lit("")), F.lit(1), F.lit(SNIPPET)).alias("snippet"))


def display_text(cards: DataFrame) -> DataFrame:
    """What a card shows: its caption or else its snippet, and a short score."""
    shown = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.nullif(F.col("snippet"), F.lit("")))
    return cards.select("qid", "pos", shown.alias("text"), F.round("reranker", 2).alias("score"))


def cli_rows(ranked: DataFrame) -> DataFrame:
    """Flat result list with a short one-line snippet."""
    flat = collapse_space("chunk")
    return ranked.select(
        "qid", "rn", "reranker", "score", "language", "kind",
        percent_decode(F.coalesce("title", F.lit(""))).alias("title"),
        percent_decode(F.coalesce("source_url", F.lit(""))).alias("source_url"),
        F.substr(flat, F.lit(1), F.lit(CLI_SNIPPET)).alias("snippet"))
