"""URL and text functions against the standard library."""

import html
import posixpath
from urllib.parse import quote, unquote, urljoin, urlparse

import pytest

from siteloom.functions import text as T
from siteloom.functions import urls as U

# Stem and extension of the stored name of each URL, as literals read over by hand; the stem
# ends in the first ten hex digits of the URL's SHA-256.
NAMES = {
    "https://a.b": ("index-065644baa7", ""),
    "https://a.b/": ("index-3af5cf0a4c", ""),
    "https://a.b/en/": ("en-8b2cd80e27", ""),
    "https://u:p@A.b:80/AR/Caf%C3%A9%20x/a+b.html": ("AR/Café-x/a-b-9f571f61d8", ".html"),
    "http://h/x/.hidden": ("x/.hidden-2c5c072163", ""),
    "http://h/x/..a.tar.gz": ("x/..a.tar-5ca71c0870", ".gz"),
    "http://h/en/p;v=1?q=2": ("en/p-3db8469f0f", ""),
    "http://h/%D8%A7%D9%84/صفحة.HTM": ("ال/صفحة-abcf63e199", ".HTM"),
    "http://h/bad%ZZpath/x.pdf": ("bad-ZZpath/x-68a9c90782", ".pdf"),
    "http://h/a b/c.php": ("a-b/c-9b342e4a96", ".php"),
    "http://h/e1/zz": ("e1/zz-487a14d7de", ""),
    "http://h/élan/x": ("élan/x-2a7735a3b7", ""),
    "http://h/d/file.": ("d/file-58afab56e2", "."),
    "http://h/%2e%2e/x.html": ("../x-2ce555f1a0", ".html"),
    "//h/x": ("x-d64d730e38", ""),
    "/rel/x": ("rel/x-8ce8f6f5bf", ""),
    "http://[::1]:8/x": ("x-2784474762", ""),
    "http://h//a//b;c/d;e;f": ("a//b-c/d-949de810fe", ""),
    "http://h/x?a/b#c": ("x-2bded5d623", ""),
    "http://h/x.php": ("x-29878edd72", ".php"),
}
URLS = list(NAMES)


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def test_url_parts(spark):
    rows = one(spark, [(u,) for u in URLS], "u string", "u", U.url_path("u").alias("path"),
               U.url_host("u").alias("host"), U.percent_encode("u").alias("enc"), U.percent_decode("u").alias("dec"),
               U.blob_name("u").alias("name"), U.blob_name("u", "pdf").alias("pdf"), U.url_extension("u").alias("ext"))
    for r in rows:
        parsed = urlparse(r.u)
        assert (r.path, r.host) == (parsed.path, parsed.hostname or "")
        assert (r.enc, r.dec) == (quote(r.u, safe=""), unquote(r.u))
        stem, ext = NAMES[r.u]
        assert (r.name, r.pdf) == (stem + ext, stem + ".pdf")
        assert r.ext == posixpath.splitext(parsed.path)[1].lower()


def test_language_section_and_base(spark):
    rows = one(spark, [(u,) for u in ["http://h/EN/News/x", "http://h/e1/x", "http://h/ar", "http://h/", None,
                                      "http://h/ar/صفحة.HTM"]],
               "u string", U.language_from_url("u").alias("l"), U.section_from_url("u").alias("s"),
               U.page_base_name("u").alias("b"))
    assert [(r.l, r.s) for r in rows] == [("en", "news"), ("unknown", "e1"), ("ar", "unknown"),
                                          ("unknown", "unknown"), (None, None), ("ar", "صفحة.htm")]
    assert not rows[5].b.lower().endswith(".htm") and rows[5].b.startswith("ar/صفحة-")


def test_snapshot_name_drops_any_extension(spark):
    (row,) = one(spark, [("http://h/x.php",)], "u string", U.snapshot_name("u").alias("n"))
    assert row.n == "x-29878edd72.png"


@pytest.mark.parametrize("base", ["https://a.b", "https://a.b/en/p.html?x=1#f", "https://a.b/x/y/"])
def test_url_join(spark, base):
    refs = ["", "x.png", "../y.png", "./z", "/a/../b/./c.png", "//cdn.x/a/b", "http://o/x", "#f", "?q=1",
            "a/b/../../../../q", "..", ".", "x/", "mailto:x", "a b.png", "../"]
    rows = one(spark, [(base, r) for r in refs], "b string, r string", "r", U.url_join("b", "r").alias("j"))
    assert [r.j for r in rows] == [urljoin(base, ref) for ref in refs]


def test_header_values(spark):
    values = [None, "", " a \n b\t", "الترقية", "100%41", "café", "a b"]
    rows = one(spark, [(v,) for v in values], "v string", T.header_safe("v").alias("h"))
    flat = [" ".join((v or "").split()) for v in values]
    assert [r.h for r in rows] == [f if f.isascii() else quote(f, safe="") for f in flat]


def test_media_type_and_kind(spark):
    rows = one(spark, [(v,) for v in [None, "", "Text/HTML; charset=x", "IMAGE/PNG"]], "v string",
               T.media_type("v").alias("m"), T.binary_kind("v").alias("k"))
    assert [tuple(r) for r in rows] == [("application/octet-stream", "doc"), ("application/octet-stream", "doc"),
                                        ("text/html", "doc"), ("image/png", "image")]


def test_entities(spark):
    given = ["a &amp;lt; b", "&#65;&#x1F600;&#x41;", "&bad; &# &#x; x", "&lt;b&gt; &quot;", "no"]
    rows = one(spark, [(v,) for v in given], "v string", T.unescape("v").alias("u"))
    assert [r.u for r in rows][:2] == [html.unescape(g) for g in given[:2]]
    assert [r.u for r in rows][2:] == ["&bad; &# &#x; x", '<b> "', "no"]
    named = ["Caf&eacute; &ndash; &copy; A &amp; B", "&hearts;&Eacute;x&;& &nbsp;|", "&amp;eacute;"]
    rows = one(spark, [(v,) for v in named], "v string", T.unescape("v").alias("u"))
    assert [r.u for r in rows] == ["Café – © A & B", "♥Éx&;& \u00a0|", "&eacute;"]


def test_tokens_and_sentences(spark):
    (row,) = one(spark, [("Hi, É a1!  Next one? no\nx...",)], "v string", T.tokens("v").alias("t"),
                 T.sentences("v").alias("s"), T.tokens("v", "keyword").alias("k"), T.text_direction("v").alias("d"))
    assert row.t == ["hi", "é", "a1", "next", "one", "no", "x"]
    assert row.s == ["Hi, É a1!", "Next one?", "no", "x..."]
    assert len(row.k) == 1 and row.d == "ltr"
