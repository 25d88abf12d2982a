"""URL column functions: pure Catalyst expressions, no Python in the task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL grammar pieces used below.
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
AUTHORITY = r"//[^/?#]*"
UNSAFE_NAME_CHAR = r"[^\p{L}\p{N}\-_/.]"
SPLIT_EXTENSION = r"(?s)^(.*[^/.][^/]*)(\.[^/.]*)$"
UNKNOWN = "unknown"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _clean(url: str | Column) -> Column:
    """URL parsing ignores tabs and line breaks anywhere and blanks in front."""
    return F.ltrim(F.translate(_c(url), "\t\r\n", ""))


def percent_decode(col: str | Column) -> Column:
    """Tolerant decode: ``+`` stays a plus, a bad escape stays as written."""
    guarded = F.regexp_replace(_c(col), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def percent_encode(col: str | Column) -> Column:
    """Encode everything but unreserved characters; null becomes ''."""
    out = F.url_encode(F.coalesce(_c(col), F.lit("")))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def content_hash(col: str | Column) -> Column:
    """SHA-256 hex of text (as UTF-8) or of bytes."""
    return F.sha2(_c(col), 256)


def url_path(url: str | Column) -> Column:
    """Path without query, fragment or the last segment's ``;params``."""
    raw = F.regexp_extract(_clean(url), rf"^(?:{SCHEME})?(?:{AUTHORITY})?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def url_host(url: str | Column) -> Column:
    """Lower-case host name without user info or port; '' when there is none."""
    host = F.regexp_extract(
        _clean(url), rf"^(?:{SCHEME})?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#@\[]*)", 1)
    return F.lower(F.translate(host, "[]", ""))


def _segments(url: str | Column) -> Column:
    return F.filter(F.split(F.lower(url_path(url)), "/"), lambda s: s != "")


def _is_language(segment: Column) -> Column:
    return F.coalesce(segment.rlike(r"^\p{L}{2}$"), F.lit(False))


def language_from_url(url: str | Column) -> Column:
    """First path segment when it is exactly two letters, else ``unknown``."""
    first = F.try_element_at(_segments(url), F.lit(1))
    return F.when(_is_language(first), first).when(_c(url).isNotNull(), F.lit(UNKNOWN))


def section_from_url(url: str | Column) -> Column:
    """First path segment after the optional language, else ``unknown``."""
    segments = _segments(url)
    first = F.try_element_at(segments, F.lit(1))
    second = F.try_element_at(segments, F.lit(2))
    found = F.when(_is_language(first), second).otherwise(first)
    return F.when(_c(url).isNotNull(), F.coalesce(found, F.lit(UNKNOWN)))


def url_extension(url: str | Column) -> Column:
    """Lower-case extension of the path with its dot; dotfiles have none."""
    return F.lower(F.regexp_extract(url_path(url), SPLIT_EXTENSION, 2))


def name_extension(name: str | Column) -> Column:
    """The same for a plain artifact name."""
    return F.lower(F.regexp_extract(_c(name), SPLIT_EXTENSION, 2))


def blob_name(url: str | Column, suffix: str | Column | None = None) -> Column:
    """Readable decoded path, a short digest of the whole URL, then the suffix
    (or, without one, the path's own extension)."""
    path = F.trim(percent_decode(url_path(url)), F.lit("/"))
    path = F.when(path == "", F.lit("index")).otherwise(path)
    safe = F.regexp_replace(path, UNSAFE_NAME_CHAR, "-")
    has_ext = safe.rlike(SPLIT_EXTENSION)
    base = F.when(has_ext, F.regexp_extract(safe, SPLIT_EXTENSION, 1)).otherwise(safe)
    if suffix is None:
        ending = F.regexp_extract(safe, SPLIT_EXTENSION, 2)
    elif isinstance(suffix, Column):
        ending = F.concat(F.lit("."), suffix)
    else:
        ending = F.lit("." + suffix.lstrip("."))
    return F.concat(base, F.lit("-"), F.substring(content_hash(url), 1, 10), ending)


def page_base_name(url: str | Column) -> Column:
    """Page artifact name without ``.html``/``.htm``."""
    return F.regexp_replace(blob_name(url), r"(?i)\.html?$", "")


def snapshot_name(url: str | Column, kind: str | Column = "png") -> Column:
    """Artifact name of a page's rendered snapshot (png or pdf)."""
    return blob_name(url, kind)


def host_suffixes(host: str | Column) -> Column:
    """``a.b.c`` -> [``a.b.c``, ``b.c``, ``c``]: what an allow-list entry may equal."""
    parts = F.split(_c(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    trailing = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), trailing)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), folded).otherwise(path)


def url_join(base: str | Column, ref: str | Column) -> Column:
    """Resolve a reference against the URL of the page it stands on."""
    base, ref = _clean(base), _clean(ref)
    scheme = F.regexp_extract(base, rf"^({SCHEME})", 1)
    origin = F.regexp_extract(base, rf"^((?:{SCHEME})?(?:{AUTHORITY})?)", 1)
    base_path = F.regexp_extract(base, rf"^(?:{SCHEME})?(?:{AUTHORITY})?([^?#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    authority = F.regexp_extract(ref, rf"^({AUTHORITY})", 1)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(rf"^{SCHEME}"), ref)
        .when(ref.startswith("//"), F.concat(
            scheme, authority, _fold_dots(F.substr(ref_path, F.length(authority) + 1)), ref_tail))
        .when(ref.startswith("/"), F.concat(origin, _fold_dots(ref_path), ref_tail))
        .when(ref.startswith("?"), F.concat(origin, base_path, ref))
        .when(ref.startswith("#"), F.concat(F.substring_index(base, "#", 1), ref))
        .otherwise(F.concat(origin, _fold_dots(F.concat(folder, ref_path)), ref_tail)))
