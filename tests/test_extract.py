"""Extraction from pages, filters and robots rules."""

from siteloom.operators import extract as E
from siteloom.operators import filters as Q
from siteloom.operators.main_content import main_content

PAGE = """<html><head><title> A &amp; B </title><script>var t="</p><img src='no.png'>";</script></head><body>
<nav><a href="/n">N</a></nav><!-- <img src="no2.png"> --><h2>Head</h2><p>One <b>bold <a href="/l">link</a> text that is
long enough<ul><li>item</li></ul><p><a href="/x">only a link</a></p><table><tr><th>a</th><td>b</td></tr></table>
<img alt="alt" src="p.png?v=1 x"><img data-src='q.jpg'><source srcset="s.webp 1x, t.webp 2x"><div class="ad">Buy</div>
<a href=doc.PDF?x#p2>d</a><a href="https://sub.host.com/y.docx#p">e</a><a href="https://badhost.com/z.pdf">f</a></body></html>"""
URL = "https://host.com/en/page.html"


def pages(spark, html=PAGE, url=URL):
    return spark.createDataFrame([(url, html)], "url string, html string")


def test_title_and_markdown(spark):
    (row,) = pages(spark).select(E.page_title("html").alias("t")).collect()
    assert row.t == "A & B"
    (row,) = main_content(pages(spark)).collect()
    assert row.markdown.split("\n\n") == ["## Head", "One bold [link](/l) text that is long enough", "- item",
                                          "| a | b |", "![alt](p.png?v=1 x)"]


def test_empty_page_gives_empty_markdown(spark):
    rows = main_content(spark.createDataFrame([(URL, ""), (URL + "1", None)], "url string, html string")).collect()
    assert [r.markdown for r in rows] == ["", ""]


def test_blocks_most_pages_of_a_host_repeat_are_dropped(spark):
    rows = [(f"https://h.com/{i}", f"<p>menu</p><p>text {i}</p>") for i in range(4)]
    rows += [("https://other.com/1", "<p>menu</p><p>x</p>")]
    found = {r.url: r.markdown for r in main_content(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert found["https://h.com/2"] == "text 2" and found["https://other.com/1"] == "menu\n\nx"


def test_asset_refs_and_filter(spark):
    images = E.image_refs(pages(spark))
    assert {r.asset_url for r in images.collect()} == {f"https://host.com/en/{n}" for n in ("p.png", "q.jpg", "s.webp")}
    docs = E.asset_filter(E.doc_refs(pages(spark)), E.DOC_EXTENSIONS, ["host.com"])
    wanted = {"https://host.com/en/doc.PDF", "https://sub.host.com/y.docx#p"}
    assert {r.asset_url for r in docs.collect()} == wanted
    hosts = spark.createDataFrame([("host.com",), ("nothost.com",)], "host string")
    again = E.asset_filter(E.doc_refs(pages(spark)), E.DOC_EXTENSIONS, hosts)
    assert {r.asset_url for r in again.collect()} == wanted


def test_base_href_moves_relative_links(spark):
    html = '<base href="/other/"><img src="a.png">'
    assert [r.asset_url for r in E.image_refs(pages(spark, html)).collect()] == ["https://host.com/other/a.png"]


def test_asset_dedup_keeps_first_page(spark):
    refs = spark.createDataFrame([("b", "u"), ("a", "u"), ("c", "v")], "source_page string, asset_url string")
    assert {(r.asset_url, r.source_page) for r in E.asset_dedup(refs).collect()} == {("u", "a"), ("v", "c")}


def test_robots_groups_wildcards_and_ties(spark):
    body = ("User-agent: bot\nUser-agent: other\nDisallow: /private # x\n\nUser-agent: *\nDisallow: /a\nAllow: /a/ok\n"
            "Disallow: /*.gif$\nDisallow: /t\nAllow: /t\nDisallow:\n")
    robots = spark.createDataFrame([("h", body)], "host string, body string")
    paths = ["/private", "/a/x", "/a/ok/1", "/z.gif", "/z.gif?x", "/t/1", "/"]
    urls = spark.createDataFrame([(f"http://h{p}",) for p in paths] + [("http://free/a",)], "url string")

    def allowed(agent):
        kept = Q.robots_allowed(urls, Q.robots_rules(robots, agent)).collect()
        return {r.url.replace("http://h", "") for r in kept} - {"http://free/a"}

    assert allowed("crawler") == {"/private", "/a/ok/1", "/z.gif?x", "/t/1", "/"}
    assert allowed("Bot") == set(paths) - {"/private"}


def test_allowed_domains(spark):
    urls = spark.createDataFrame([(u,) for u in ["http://a.com/1", "http://x.a.com/", "http://ba.com/", "http://b.org/"]],
                                 "url string")
    assert [r.url for r in Q.allowed_domains(urls, ["a.com"]).collect()] == ["http://a.com/1", "http://x.a.com/"]
    seeds = spark.createDataFrame([("http://a.com/sitemap.xml",)], "url string")
    assert {r.url for r in Q.allowed_domains(urls, seeds=seeds).collect()} == {"http://a.com/1", "http://x.a.com/"}


def test_query_limits(spark):
    rows = [("x" * 1000, "en", 1, 0), ("x" * 1001, "en", 1, 0), ("x", "e" * 33, 1, 0), ("x", None, 0, 0), ("x", None, 51, 0),
            ("x", None, 50, 1000), ("x", None, 50, 1001), ("x", None, 1, -1), (None, None, None, None)]
    df = spark.createDataFrame([(i, q, l, None, None, t, s) for i, (q, l, t, s) in enumerate(rows)],
                               "qid long, q string, language string, section string, kind string, top int, skip int")
    good, bad = Q.split_queries(df)
    assert {r.qid for r in good.collect()} == {0, 5, 8}
    assert {r.qid: r.error for r in bad.collect()}[2] == "language too long"
    assert good.filter("qid = 8").select("q", "top", "skip").first() == ("", 20, 0)
