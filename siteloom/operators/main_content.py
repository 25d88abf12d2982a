"""Boilerplate-free Markdown of pages, as a corpus job.

A page is cut into blocks by native expressions. Structure rules drop
navigation, advertisements and link lists inside the row; a corpus rule drops
blocks that a large share of a host's pages repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.operators.extract import ANY_TAG, NOISE
from siteloom.scale import checkpointed, lookup_join, written

# Elements dropped whole, tags that end a block, and the control
# characters that mark block ends, link text and headings until the last step.
DROPPED = "|".join(
    [rf"<{t}[\s>].*?</{t}\s*>" for t in ("head", "title", "nav", "footer", "aside", "header")]
    + [r"""<div\s[^>]*class\s*=\s*["']?ads?["'\s>].*?</div\s*>"""])
BLOCK_TAGS = ("html|body|main|article|section|div|p|ul|ol|li|dl|dt|dd|table|thead|tbody|tfoot|tr|"
              "h[1-6]|blockquote|pre|hr|figure|figcaption|form|address")
BREAK, LINK_OPEN, LINK_CLOSE, HEADING = "\x01", "\x02", "\x03", "\x04"
MIN_REPEAT_PAGES = 3
ATTR = r"""\s*=\s*["']([^"']*)["']"""

# Markup -> Markdown rewrites in order; {1} is the first group.
REWRITES = [
    (NOISE, " "),
    (rf"(?is){DROPPED}", BREAK),
    (rf"(?is)<img\s(?:[^>]*?\s)?src{ATTR}[^>]*?\salt{ATTR}[^>]*>", "![{2}]({1})"),
    (rf"(?is)<img\s(?:[^>]*?\s)?alt{ATTR}[^>]*?\ssrc{ATTR}[^>]*>", "![{1}]({2})"),
    (rf"(?is)<img\s(?:[^>]*?\s)?src{ATTR}[^>]*>", "![]({1})"),
    (rf"(?is)<a\s(?:[^>]*?\s)?href{ATTR}[^>]*>(.*?)</a\s*>",
     LINK_OPEN + "{2}" + LINK_CLOSE + "({1})"),
    (r"(?i)<h([1-6])(?:\s[^>]*)?>", BREAK + HEADING + "{1}"),
    (r"(?i)<li(?:\s[^>]*)?>", BREAK + "- "),
    (r"(?i)<tr(?:\s[^>]*)?>", BREAK + "| "),
    (r"(?i)</t[dh]\s*>", " | "),
    (r"(?i)<br(?:\s[^>]*)?/?>", " "),
    (rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", BREAK),
    (ANY_TAG, ""),
]


def blocks(html: str | Column) -> Column:
    """Array of non-empty text blocks with link and heading marks."""
    out = F.translate(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")),
                      BREAK + LINK_OPEN + LINK_CLOSE + HEADING, "")
    for pattern, replacement in REWRITES:
        for group in "12":
            replacement = replacement.replace("{" + group + "}", "$" + group)
        out = F.regexp_replace(out, pattern, replacement)
    parts = F.transform(F.split(out, BREAK), lambda b: T.collapse_space(T.unescape(b)))
    return F.filter(parts, lambda b: ~b.isin("", "-", "|") & ~b.rlike(rf"^{HEADING}[1-6] ?$"))


def link_share(block: Column) -> Column:
    """Share of a block's text that stands inside links."""
    linked = F.array_join(F.regexp_extract_all(
        block, F.lit(rf"{LINK_OPEN}([^{LINK_CLOSE}]*){LINK_CLOSE}"), F.lit(1)), "")
    plain = F.regexp_replace(block, rf"{LINK_CLOSE}\([^)]*\)|{LINK_OPEN}|^- |^{HEADING}[1-6]", "")
    return F.length(linked) / F.greatest(F.length(plain), F.lit(1))


def to_markdown(block: Column) -> Column:
    level = F.regexp_extract(block, rf"^{HEADING}([1-6])", 1)
    body = F.regexp_replace(block, rf"^{HEADING}[1-6] ?", "")
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce(level.try_cast("int"), F.lit(0))),
                       F.lit(" "), body)
    return F.translate(F.when(level != "", heading).otherwise(block), LINK_OPEN + LINK_CLOSE, "[]")


def page_blocks(pages: DataFrame, link_density: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, host, blocks) after the structure rules; blocks are Markdown."""
    kept = F.filter(F.col("_blocks"), lambda b: link_share(b) <= F.lit(link_density))
    return (pages.select("url", *keep, U.url_host("url").alias("host"), blocks("html").alias("_blocks"))
            .select("url", *keep, "host", F.transform(kept, to_markdown).alias("blocks")))


def block_counts(page_blocks_df: DataFrame) -> DataFrame:
    """(host, block_hash, n_pages): on how many pages of a host a block stands.

    Only digests are shuffled, after map-side counting.
    """
    digests = F.array_distinct(F.transform("blocks", lambda b: F.sha2(b, 256)))
    return (page_blocks_df.select("host", F.explode(digests).alias("block_hash"))
            .groupBy("host", "block_hash").agg(F.count("*").alias("n_pages")))


def repeated_blocks(page_blocks_df: DataFrame, repeat_share: float) -> DataFrame:
    """(host, repeated): digests on at least ``repeat_share`` of a host's pages.

    A host's list is short by construction: it cannot exceed the mean number
    of blocks of its pages divided by the share.
    """
    totals = checkpointed(page_blocks_df.groupBy("host").agg(F.count("*").alias("host_pages")))
    often = block_counts(page_blocks_df).filter(F.col("n_pages") >= MIN_REPEAT_PAGES)
    often = lookup_join(often, totals, ["host"], "inner").filter(
        F.col("n_pages") >= F.col("host_pages") * F.lit(repeat_share))
    return often.groupBy("host").agg(F.collect_set("block_hash").alias("repeated"))


def main_content(pages: DataFrame, repeat_share: float = 0.5,
                 link_density: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, markdown): every page's main text; '' when nothing is left. The
    ``keep`` columns of a page stay with it, which spares joining them back."""
    cut = written(page_blocks(pages, link_density, keep), "blocks")
    repeated = checkpointed(repeated_blocks(cut.select("url", "host", "blocks"), repeat_share))
    joined = lookup_join(cut, repeated, ["host"], "left")
    none = F.array().cast("array<string>")
    kept = F.filter("blocks", lambda b: ~F.array_contains(
        F.coalesce(F.col("repeated"), none), F.sha2(b, 256)))
    return joined.select("url", *keep, F.array_join(kept, "\n\n").alias("markdown"))
