"""From seeds and landed responses to stored artifacts: the ingest half."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import extract as X
from siteloom.operators import filters as Q
from siteloom.operators import incremental as N
from siteloom.operators.main_content import main_content
from siteloom.scale import checkpointed, lookup_join, written
from siteloom.sources import landed as L
from siteloom.sources import sinks
from siteloom.sources.versioned import VersionedTable


@dataclass(frozen=True)
class Ingested:
    """``rejected`` holds the responses that cannot be processed, with the reason."""

    artifacts: DataFrame
    rejected: DataFrame


def ingest(landed: DataFrame, manifest: DataFrame | None, incremental: bool = True, lastmod: DataFrame | None = None,
           asset_hosts: list[str] | DataFrame | None = None) -> Ingested:
    """Artifacts to store for a batch of responses, and what was set aside.

    Unchanged pages are dropped by hash before anything is parsed; the changed ones are written
    once, and the costly extraction reads only them. With ``asset_hosts`` assets carry the changed page that
    links them; with ``lastmod`` (loc, lastmod) pages carry their sitemap's date.
    """
    accepted, rejected = N.with_errors(landed)
    changed = written(N.changed_pages(accepted, manifest, incremental), "changed")
    pages = X.page_record(main_content(changed, keep=("content_type", "html", "fetched_at")), lastmod)
    if lastmod is None:
        pages = pages.withColumn("lastmod", F.lit(None).cast("string"))
    links = None if asset_hosts is None else X.asset_links(changed.select("url", "html"), asset_hosts)
    artifacts = sinks.page_bundle(pages).unionByName(sinks.binary_artifact(X.binary_record(accepted, links)))
    return Ingested(artifacts if manifest is None else N.changed_artifacts(artifacts, manifest), rejected)


def next_manifest(manifest: DataFrame, artifacts: DataFrame, stored_at: Column) -> DataFrame:
    """The manifest after a run: what it stored replaces rows of the same name,
    and a stored artifact is no longer deleted."""
    page = F.col("container") == "pages"
    base = F.when(page, F.regexp_replace("name", r"\.(html|md|json)$", ""))
    rows = artifacts.select("container", "name", base.alias("base_name"),
                            F.try_element_at("metadata", F.lit("contenthash")).alias("content_hash"),
                            stored_at.alias("modified_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return sinks.upsert(manifest, rows, ["container", "name"], ["modified_at"])


def wanted_pages(seeds: DataFrame, sitemaps: DataFrame, robots: DataFrame, agent: str = "*", domains: list[str] | None = None) -> DataFrame:
    """(url, lastmod) of the pages a crawl may take, each once.

    ``seeds`` (url) are sitemaps, or robots files, which stand for the sitemaps they name. Every nested sitemap is
    followed; pages must lie on the allowed domains (of the seeds, without a list) and be allowed by their host's rules.
    """
    named = L.robots_sitemaps(robots).withColumn("host", F.lower("host"))
    files = seeds.withColumn("host", U.url_host("url"))
    is_robots = F.endswith(U.url_path("url"), F.lit("/robots.txt"))
    start = files.filter(~is_robots).select(F.col("url").alias("loc")).unionByName(
        named.join(files.filter(is_robots).select("host").distinct(), "host", "left_semi").select("loc"))
    entries = N.page_dedup(L.sitemap_expand(start, sitemaps)).withColumnRenamed("loc", "url")
    return Q.robots_allowed(Q.allowed_domains(entries, domains, seeds), Q.robots_rules(robots, agent))


def requested(landed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The landed responses of wanted pages, and all that are no pages; each URL once, the latest."""
    html, binary = X.split_by_type(landed)
    pages = lookup_join(html, checkpointed(wanted.select("url")), ["url"], "left_semi")
    every = pages.unionByName(binary)
    times = every.groupBy("url").agg(F.max("fetched_at").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = checkpointed(times.select("url", "_last"))
    if repeated.isEmpty():
        return every
    once = lookup_join(every, repeated.select("url"), ["url"], "left_anti")
    again = lookup_join(every, repeated, ["url"], "inner").filter(F.col("fetched_at").eqNullSafe(F.col("_last")))
    return once.unionByName(again.drop("_last").dropDuplicates(["url"]))


@dataclass(frozen=True)
class Run:
    """What a crawl did: counts per outcome, taken from the run itself, and what it set aside."""

    counters: dict[str, int]
    rejected: DataFrame


def crawl(landed: DataFrame, seeds: DataFrame, sitemaps: DataFrame, robots: DataFrame, store: VersionedTable, now: Column,
          asset_hosts: list[str] | DataFrame | None = None, agent: str = "*", domains: list[str] | None = None,
          incremental: bool = True, mark: tuple[str, int] | None = None) -> Run:
    """One whole run into an artifact store: wanted pages, changed content, linked assets, one version.

    What the store holds is the manifest, so a second run over the same responses stores nothing. Counters
    (uploaded_<container>) are observed while the artifacts are written, without a pass of their own. A run whose
    ``mark`` the store has already is a replay and does nothing.
    """
    if mark and store.done(mark):
        return Run({}, N.with_errors(landed)[1])
    wanted = checkpointed(wanted_pages(seeds, sitemaps, robots, agent, domains))
    taken = requested(landed, wanted)
    manifest = sinks.stored_manifest(store, now)
    hosts = wanted.select(U.url_host("url").alias("host")).distinct() if asset_hosts is None else asset_hosts
    done = ingest(taken, manifest, incremental, wanted.select(F.col("url").alias("loc"), "lastmod"), hosts)
    counted = Observation()
    counts = [F.count_if(F.col("container") == c).alias(f"uploaded_{c}") for c in sinks.CONTAINERS.values()]
    before = store.state()
    after = store.write(done.artifacts.observe(counted, *counts), mark)
    if after.cells == before.cells:  # nothing to write: an empty plan is not observed
        return Run({f"uploaded_{c}": 0 for c in sinks.CONTAINERS.values()}, done.rejected)
    return Run({k: int(v) for k, v in counted.get.items()}, done.rejected)
