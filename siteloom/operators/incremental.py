"""Change detection, run counters, retention and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.functions.text import stripped
from siteloom.operators.extract import split_by_type
from siteloom.scale import checkpointed, is_small, lookup_join

SNAPSHOT_DAYS = 30
SOFT_DELETE_DAYS = 7


def known_hashes(manifest: DataFrame, container: str = "pages") -> DataFrame:
    """(base_name, content_hash) of the stored pages that carry a hash."""
    stored = manifest.filter(
        (F.col("container") == container) & F.col("name").endswith(".html")
        & F.col("content_hash").isNotNull() & (F.col("content_hash") != ""))
    return stored.select(F.expr("left(name, length(name) - 5)").alias("base_name"), "content_hash")


def page_keys(landed: DataFrame) -> DataFrame:
    """HTML responses with their base name and content hash."""
    html, _ = split_by_type(landed)
    return html.withColumns({"base_name": U.page_base_name("url"),
                             "content_hash": U.content_hash("html")})


def changed_pages(landed: DataFrame, manifest: DataFrame | None,
                  incremental: bool = True) -> DataFrame:
    """Landed pages that are new or whose content differs from the stored one.

    With a small manifest the pages stay where they are. With a large one only
    keys are shuffled to find what changed; the bodies of the changed pages
    (few, in a daily run) are picked up by a second join on that short list.
    """
    pages = page_keys(landed)
    if not incremental or manifest is None:
        return pages
    keys = ["base_name", "content_hash"]
    known = known_hashes(manifest)
    if is_small(known):
        return pages.join(F.broadcast(known), keys, "left_anti")
    changed = checkpointed(pages.select(*keys).distinct().join(known, keys, "left_anti"))
    return lookup_join(pages, changed, keys, "left_semi")


def guard_name() -> Column:
    """The artifact whose stored hash decides: a page's HTML for all files of
    its bundle, else the artifact itself."""
    page = F.col("container") == "pages"
    return F.when(page, F.regexp_replace("name", r"\.(md|json)$", ".html")).otherwise(F.col("name"))


def changed_artifacts(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artifacts whose guard is not stored with the same hash; the hash travels
    in the metadata map. A page's files are stored or skipped together.

    With a large manifest only keys are shuffled to find what changed; bodies
    are picked up by a second join on that list.
    """
    keys = ["container", "_guard", "content_hash"]
    keyed = artifacts.withColumns({"_guard": guard_name(),
                                   "content_hash": F.try_element_at("metadata", F.lit("contenthash"))})
    stored = manifest.filter("content_hash is not null").select(
        "container", F.col("name").alias("_guard"), "content_hash").distinct()
    if is_small(stored):
        return keyed.join(F.broadcast(stored), keys, "left_anti").drop("_guard", "content_hash")
    named = keyed.withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    changed = checkpointed(named.select(*keys).distinct().join(stored, keys, "left_anti"))
    return lookup_join(named, changed, keys, "left_semi").drop("_guard", "content_hash")


def classify(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``change_class`` per page key: new, changed or unchanged."""
    known = known_hashes(manifest).withColumnRenamed("content_hash", "known_hash")
    joined = lookup_join(pages, known, ["base_name"], "left")
    return joined.withColumn(
        "change_class", F.when(F.col("known_hash").isNull(), "new")
        .when(F.col("known_hash") == F.col("content_hash"), "unchanged")
        .otherwise("changed")).drop("known_hash")


def run_counters(classified: DataFrame) -> DataFrame:
    """Counts per container and outcome: stored (new or changed) or skipped."""
    outcome = F.when(F.col("change_class") == "unchanged", "skipped").otherwise("uploaded")
    return classified.groupBy("container", "change_class", outcome.alias("outcome")).agg(
        F.count("*").alias("n"))


def page_dedup(entries: DataFrame) -> DataFrame:
    """Each page URL once, with its latest lastmod, whatever lists it."""
    return entries.groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def _older_than(column: str, days: int, now: Column) -> Column:
    return F.col(column) < now - F.expr(f"interval {int(days)} days")


def expire(manifest: DataFrame, now: Column, container: str = "snapshots",
           days: int = SNAPSHOT_DAYS) -> DataFrame:
    """What stays: everything but the container's rows not modified for more
    than ``days`` days."""
    gone = (F.col("container") == container) & _older_than("modified_at", days, now)
    return manifest.filter(~F.coalesce(gone, F.lit(False)))


def purge(manifest: DataFrame, now: Column, days: int = SOFT_DELETE_DAYS) -> DataFrame:
    """Drop rows deleted more than ``days`` days ago; younger ones can be
    recovered and are marked so."""
    kept = manifest.filter(~F.coalesce(_older_than("deleted_at", days, now), F.lit(False)))
    return kept.withColumn("recoverable", F.col("deleted_at").isNotNull())


def drop_deleted(chunks: DataFrame, tombstones: DataFrame, soft_delete: bool = True) -> DataFrame:
    """Chunks without those of deleted parents; only with soft delete on."""
    if not soft_delete:
        return chunks
    gone = checkpointed(tombstones.filter("deleted_at is not null").select("parent_id").distinct())
    return lookup_join(chunks, gone, ["parent_id"], "left_anti")


def refresh_index(chunks: DataFrame, rebuilt: DataFrame, changed: DataFrame) -> DataFrame:
    """All chunks of a changed parent are replaced by its rebuilt ones."""
    parents = checkpointed(changed.select("parent_id").distinct())
    kept = lookup_join(chunks, parents, ["parent_id"], "left_anti")
    return kept.unionByName(rebuilt)


def with_errors(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows that cannot be processed are set aside with a
    reason and never stop the run."""
    error = (F.when(F.col("url").isNull() | (stripped("url") == ""), "no url")
             .when(U.url_host("url") == "", "no host")
             .when(F.col("content_type").isNull(), "no content type")
             .when(F.col("html").isNull() & F.col("body").isNull(), "no body"))
    marked = landed.withColumn("error", error)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def attach_snapshot(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Name of each result's page snapshot, or null when there is none."""
    stored = manifest.filter(F.col("container") == "snapshots").select(
        F.col("name").alias("snapshot")).distinct()
    wanted = results.withColumn("_name", U.snapshot_name("source_url"))
    return lookup_join(wanted, stored.withColumn("_name", F.col("snapshot")), ["_name"], "left").drop("_name")
