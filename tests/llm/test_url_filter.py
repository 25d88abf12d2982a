"""Host, path and rules against plain Python; the trees on held-out URLs."""

import re
import string

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siteloom.llm import queries
from siteloom.llm import url_filter as U

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [None, "", "no scheme", "http://", "http://Net", "http://NET/", "https://a.b.NET/x?y#z", "http://Example.net/en/q", "http://example.net/en",
        "ftp://x://example.com/de/", "http://example.com/de/#a://b", "http://xexample.com/de/", "http://org/fr/a", "http://a.org?/fr/",
        "http://ÄB.org/fr/é\n?x", "http://a.org:80/fr/", "http://a.net#/?", "://net/", "http://" + "a/" * 5000]


def test_edge_urls(spark):
    rows = [(i, u, "clash", 7) for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    got = U.judged(df).select("_row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict in (None, r["verdict"])


def test_query_on_given_tables(spark):
    rows = queries.QUERIES["op4_url_filter"](spark, SF).collect()
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])


def test_trees_judge_unseen_urls(spark):
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        url = f"http://x{i * 7919 % 9973}-win-{i}.example.com/{i}/{i}/{i}?a={i}&b={i}&c=1" if bad else f"https://news.example.com/story/part-{'abcdef'[i % 6]}"
        rows.append((i, url, float(bad) if i % 2 else None))
    df = spark.createDataFrame(rows, "id int, url string, known double")
    got = U.judged(df, labelled=F.col("_row.known"), rules=()).select("_row.id", "verdict").collect()
    wrong = sum((r["verdict"] == "block") != (r["id"] % 3 == 0) for r in got if r["id"] % 2 == 0)
    assert wrong <= 0.02 * 600


@pytest.mark.parametrize("urls", [[], ["http://a.net/", None]])
def test_without_labels_of_both_kinds(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert sorted(r["verdict"] for r in U.judged(df).collect()) == (["allow", "block"] if urls else [])


def test_plan_is_native(spark):
    plan = queries.QUERIES["op4_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_url_repeated_does_not_fill_the_sample(spark):
    rows = [(f"http://x-win-{i}.example.com/{i}/{i}?a={i}" if i % 2 else f"https://news.example.com/story-{'ab' * (i % 7)}{i}", float(i % 2))
            for i in range(80)]
    df = spark.createDataFrame(rows, "url string, known double")
    lowest = df.orderBy(F.xxhash64("url")).first()
    df = df.union(spark.createDataFrame([tuple(lowest)] * 200, df.schema))
    got = U.judged(df, labelled=F.col("_row.known"), rules=(), sample=100).select("_row.known", "score").collect()
    assert len({r["score"] for r in got}) > 1
    assert all((r["score"] > 0) == (r["known"] == 1) for r in got)


def test_own_label_is_not_a_feature(spark):
    rows = [(f"http://h{i}.s{i % 3}.example/", f"s{i % 3}.example", float(i % 2) if i % 5 else None) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "_url string, suffix string, blocked double").withColumn("fold", U.fold())
    folds = {}
    for r in df.collect():
        folds.setdefault(r["suffix"], []).append((r["fold"], r["blocked"]))
    for r in U.out_of_fold(df.withColumn("suffix_blocked", F.lit(9.0)), U.fold_statistics(df, "blocked")).collect():
        others = [b for f, b in folds[r["suffix"]] if f != r["fold"] and b is not None]
        assert r["suffix_blocked"] == pytest.approx((sum(others) + 1) / (len(others) + 2))
    random_labels = spark.createDataFrame([(f"http://a.only{i}.test/x", float(i * 7919 % 31 % 2)) for i in range(400)], "url string, known double")
    assert U.judged(random_labels, labelled=F.col("_row.known"), rules=()).count() == 400
