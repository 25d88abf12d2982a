"""Text column functions: headers, media types, entities, tokens, sentences."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.urls import percent_encode

# Fixed values.
WHITESPACE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
DEFAULT_MEDIA_TYPE = "application/octet-stream"
RTL_RANGE = r"[\x{0600}-\x{06FF}]"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE = r"[^.!?؟\n]+[.!?؟]*"
# Named character references of HTML, the common ones first.
COMMON_ENTITIES = ["amp", "nbsp", "lt", "gt", "quot", "apos"]
NAMED_ENTITIES = {name: html5[f"{name};"] for name in
                  [*COMMON_ENTITIES, *sorted(n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in COMMON_ENTITIES)]}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_space(col: str | Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(_c(col), WHITESPACE, " "))


def stripped(col: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(col), f"^{WHITESPACE}|{WHITESPACE}$", "")


def header_safe(col: str | Column) -> Column:
    """One-line value; percent-encoded unless it is all ASCII."""
    flat = collapse_space(F.coalesce(_c(col), F.lit("")))
    return F.when(flat.rlike(r"^[\x00-\x7F]*$"), flat).otherwise(percent_encode(flat))


def media_type(col: str | Column) -> Column:
    """Content type, lower-cased and cut at ``;``, with the generic default."""
    given = F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(DEFAULT_MEDIA_TYPE))
    return F.substring_index(F.lower(given), ";", 1)


def is_html(content_type: str | Column) -> Column:
    return F.contains(F.lower(F.coalesce(_c(content_type), F.lit(""))), F.lit("text/html"))


def binary_kind(content_type: str | Column) -> Column:
    """``image`` for image/* types, ``doc`` for anything else."""
    lowered = F.lower(F.coalesce(_c(content_type), F.lit("")))
    return F.when(lowered.startswith("image/"), F.lit("image")).otherwise(F.lit("doc"))


def text_direction(col: str | Column) -> Column:
    """``rtl`` when the text holds an Arabic letter, else ``ltr``."""
    return F.when(_c(col).rlike(RTL_RANGE), F.lit("rtl")).otherwise(F.lit("ltr"))


def _code_point(number: Column) -> Column:
    """Character of a Unicode code point; U+FFFD outside the valid range."""
    ok = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    code = F.when(ok, number).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(col: str | Column) -> Column:
    """Decode the character references of HTML text, named and numeric, each
    once: the text is split at ``&`` and the head of every part is looked up."""
    names = F.create_map(*[F.lit(v) for pair in NAMED_ENTITIES.items() for v in pair])

    def piece(part: Column, i: Column) -> Column:
        dec = F.regexp_extract(part, r"^#([0-9]{1,7});", 1)
        hexa = F.regexp_extract(part, r"^#[xX]([0-9A-Fa-f]{1,6});", 1)
        known = F.try_element_at(names, F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1))
        char = (F.when(dec != "", _code_point(dec.cast("bigint")))
                .when(hexa != "", _code_point(F.conv(hexa, 16, 10).cast("bigint")))
                .otherwise(known))
        rest = F.substr(part, F.locate(";", part) + 1)
        return (F.when(i == 0, part).when(char.isNotNull(), F.concat(char, rest))
                .otherwise(F.concat(F.lit("&"), part)))

    text = _c(col)
    decoded = F.array_join(F.transform(F.split(text, "&"), piece), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def tokens(col: str | Column, analyzer: str = "standard") -> Column:
    """Array of tokens: lower-cased words, or the whole value for ``keyword``."""
    if analyzer == "keyword":
        return F.when(_c(col).isNotNull(), F.array(_c(col)))
    return F.filter(words(col), lambda t: t != "")


def words(col: str | Column) -> Column:
    """The standard tokens, with an empty one where a text begins or ends with a break."""
    return F.split(F.lower(_c(col)), TOKEN_BREAK)


def sentences(col: str | Column) -> Column:
    """Array of trimmed, non-empty sentences in reading order."""
    found = F.regexp_extract_all(_c(col), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, collapse_space), lambda s: s != "")
