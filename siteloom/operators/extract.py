"""Page and asset extraction from landed responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.operators.filters import on_hosts
from siteloom.scale import checkpointed, lookup_join

# File types fetched as linked documents and as images.
DOC_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico", ".tiff")

# Markup patterns (no look-around, so other engines read them too).
NOISE = r"(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>"
ANY_TAG = r"(?s)<[^>]*>"
TITLE = r"(?is)<title[^>]*>([^<]*)"
ATTRIBUTE = r"""(?is)<{tag}\s(?:[^>]*?\s)?{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def split_by_type(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HTML responses go down the page path, all others down the binary path."""
    html = T.is_html("content_type")
    return landed.filter(html), landed.filter(~html)


def page_title(html: str | Column) -> Column:
    """Text of the first title element, decoded and stripped; '' without one."""
    html = F.col(html) if isinstance(html, str) else html
    raw = T.unescape(F.regexp_extract(html, TITLE, 1))
    return F.coalesce(F.regexp_replace(raw, f"^{T.WHITESPACE}|{T.WHITESPACE}$", ""), F.lit(""))


def without_noise(html: str | Column) -> Column:
    """Markup without comments, scripts and styles."""
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(html, NOISE, " ")


def visible_text(html: str | Column) -> Column:
    """The page's text without any markup, on one line."""
    return T.collapse_space(T.unescape(F.regexp_replace(without_noise(html), ANY_TAG, " ")))


def _attributes(markup: Column, tag: str, name: str) -> Column:
    found = F.regexp_extract_all(markup, F.lit(ATTRIBUTE.format(tag=tag, name=name)), F.lit(1))
    return F.transform(found, lambda v: T.unescape(F.regexp_replace(v, r"""^["']|["']$""", "")))


def _base_url(url: Column, markup: Column) -> Column:
    """Where relative links start: the page's ``<base href>`` or the page."""
    href = F.regexp_extract(markup, ATTRIBUTE.format(tag="base", name="href"), 1)
    return F.when(href == "", url).otherwise(
        U.url_join(url, F.regexp_replace(href, r"""^["']|["']$""", "")))


def _refs(pages: DataFrame, find: Callable[[Column], Column],
          cut: Callable[[Column], Column]) -> DataFrame:
    """One row per distinct reference of a page, resolved against the page.

    Repeats are removed inside the row, so nothing is shuffled.
    """
    marked = pages.select(
        F.col("url").alias("source_page"), without_noise("html").alias("_markup"))
    found = marked.select("source_page", find(F.col("_markup")).alias("_raw"),
                          _base_url(F.col("source_page"), F.col("_markup")).alias("_base"))
    resolved = F.transform("_raw", lambda r: U.url_join(F.col("_base"), cut(r)))
    return found.select("source_page", F.explode(F.array_distinct(resolved)).alias("asset_url"))


def image_refs(pages: DataFrame) -> DataFrame:
    """Image URLs of every page: img src, img data-src and the first source
    srcset candidate, each cut at the first blank and at ``?``."""
    def find(markup: Column) -> Column:
        return F.concat(_attributes(markup, "img", "src"), _attributes(markup, "img", "data-src"),
                        _attributes(markup, "source", "srcset"))
    return _refs(pages, find, lambda r: F.substring_index(F.substring_index(r, " ", 1), "?", 1))


def doc_refs(pages: DataFrame) -> DataFrame:
    """Linked URLs of every page, cut at ``?``."""
    return _refs(pages, lambda markup: _attributes(markup, "a", "href"),
                 lambda r: F.substring_index(r, "?", 1))


def asset_filter(refs: DataFrame, extensions: tuple[str, ...],
                 hosts: list[str] | DataFrame) -> DataFrame:
    """Keep asset URLs with a listed extension on an asset host or below one."""
    return on_hosts(_of_type(refs, extensions), U.url_host(F.lower(F.substring_index("asset_url", "#", 1))), hosts)


def _of_type(refs: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    bare = F.lower(F.substring_index("asset_url", "#", 1))
    wanted = r"(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + r")\z"
    return refs.filter(U.url_path(bare).rlike(wanted))


def asset_dedup(refs: DataFrame) -> DataFrame:
    """Every asset URL once; the smallest page URL linking it is its source.

    A hash aggregate with map-side combine: an asset on every page of the
    corpus still reaches the shuffle once per task.
    """
    others = [c for c in refs.columns if c not in ("asset_url", "source_page")]
    return refs.groupBy("asset_url", *others).agg(F.min("source_page").alias("source_page"))


def rendered_images(rendered: DataFrame, refs: DataFrame, hosts: list[str] | DataFrame) -> DataFrame:
    """Add image URLs (source_page, asset_url) seen in a rendered page."""
    seen = rendered.select(
        "source_page", F.substring_index("asset_url", "?", 1).alias("asset_url"))
    found = refs.select("source_page", "asset_url").unionByName(seen)
    return asset_dedup(asset_filter(found, IMAGE_EXTENSIONS, hosts))


def asset_language(assets: DataFrame) -> DataFrame:
    """Assets speak the language of their source page, or else of their URL."""
    source = F.coalesce(F.nullif(F.col("source_page"), F.lit("")), F.col("url"))
    return assets.withColumn("language", U.language_from_url(source))


def asset_links(pages: DataFrame, hosts: list[str] | DataFrame) -> DataFrame:
    """(asset_url, kind, source_page): images and documents that pages link on asset hosts, each URL
    once. Its source is the smallest page that links it, its kind that page's link (an image before a document)."""
    images, docs = image_refs(pages).withColumn("kind", F.lit("image")), doc_refs(pages).withColumn("kind", F.lit("doc"))
    first = F.min(F.struct("source_page", F.col("kind") != "image", "kind")).alias("_first")
    typed = _of_type(images, IMAGE_EXTENSIONS).unionByName(_of_type(docs, DOC_EXTENSIONS))
    each = checkpointed(typed.groupBy("asset_url").agg(first).select("asset_url", "_first.kind", "_first.source_page"))
    return on_hosts(each, U.url_host(F.lower(F.substring_index("asset_url", "#", 1))), hosts)


def binary_record(landed: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Asset rows for the responses that are not HTML. With ``links`` (asset_url, kind, source_page) a linked
    response gets the kind of its link and the page that links it, whose language it speaks; one
    that nobody links stands for itself. A response and a link meet without their fragments.

    Only URLs meet the link table; bodies are shuffled when the list of linked URLs is too long to send.
    """
    _, binary = split_by_type(landed)
    own = {"kind": T.binary_kind("content_type"), "source_page": F.col("url")}
    if links is not None:
        bare = F.substring_index("url", "#", 1).alias("_bare")
        wanted = binary.select(bare).distinct()
        known = links.select(F.substring_index("asset_url", "#", 1).alias("_bare"), F.struct("source_page", "kind").alias("_link"))
        met = checkpointed(known.join(wanted, "_bare", "left_semi").groupBy("_bare").agg(F.min("_link").alias("_link")))
        binary = lookup_join(binary.withColumn("_bare", F.substring_index("url", "#", 1)), met, ["_bare"], "left")
        own = {name: F.coalesce(F.col("_link")[name], value) for name, value in own.items()}
    return asset_language(binary.select(
        "url", own["kind"].alias("kind"), own["source_page"].alias("source_page"),
        F.lower("content_type").alias("content_type"), "body",
        U.content_hash("body").alias("content_hash"), F.col("fetched_at").alias("crawled_at")))


def page_record(landed: DataFrame, lastmod: DataFrame | None = None) -> DataFrame:
    """Full page rows. A ``markdown`` column is taken over; ``lastmod`` (loc,
    lastmod) is joined in when given: dates meet the pages' URLs first, so the bodies
    move only when the dates of these pages are themselves too many to send."""
    html, _ = split_by_type(landed)
    pages = html.select(
        "url", U.page_base_name("url").alias("base_name"), page_title("html").alias("title"),
        U.language_from_url("url").alias("language"), U.section_from_url("url").alias("section"),
        "html", *[c for c in ("markdown",) if c in landed.columns],
        U.content_hash("html").alias("content_hash"), F.col("fetched_at").alias("crawled_at"),
        U.url_host("url").alias("host"))
    if lastmod is not None:
        wanted = html.select("url").distinct()
        dated = checkpointed(lastmod.select(F.col("loc").alias("url"), "lastmod").join(wanted, "url", "left_semi"))
        pages = lookup_join(pages, dated, ["url"], "left")
    return pages
