"""Archives read back against plain digests; equal bytes on every run."""

import base64
import gzip
import hashlib
import pathlib
import random

import pyarrow.parquet as pq
import pytest

from siteloom.llm import queries, warc

SF = "/root/testdata/sf0.001"


def brute(pages, least=0):
    first = {}
    for page, html in pages:
        first.setdefault(html or "", []).append(page)
    out = []
    seen = set()
    for page, html in pages:
        data = (html or "").encode()
        own = [p for p in first[html or ""] if p is not None]
        leader = min(own, default=None)
        response = len(data) < least or (page == leader and (leader, html or "") not in seen)
        if response and len(data) >= least:
            seen.add((leader, html or ""))
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit",
                    None if response else leader))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


PAGES = [(5, "x"), (3, "x"), (9, "x"), (3, "x"), (3, "other"), (1, None), (2, ""), (7, "é\r\n\r\nWARC/1.1\r\n"), (8, "long " * 300000),
         (None, "nameless"), (None, "x"), (11, "\r\n\r\n")]
URLS = ["http://a/ü b\r\nX: y", None, "", "http://b/"]


@pytest.mark.parametrize("least", [0, 2, 10 ** 9])
def test_edge_pages(spark, tmp_path, least):
    rows = [(p, URLS[i % 4], h, "clash") for i, (p, h) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_archive(df, str(tmp_path / "a"), min_revisit=least)
    back = warc.read_archive(spark, str(tmp_path / "a"))
    assert ours(back) == brute(PAGES, least)
    whole = {(r["page_id"], r["payload"]) for r in back.collect() if r["record_type"] == "response"}
    assert {(p, (h or "").encode()) for p, h in PAGES if p == 8 or p == 7} <= whole


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh ") for _ in range(3000)) if i % 3 else "copy") for i in range(900)]
    found = []
    for n, name in ((1, "a"), (7, "b")):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        manifest = warc.write_archive(df, str(tmp_path / name), shard_bytes=300_000, roll_bytes=12_000)
        found.append({r["file"]: (r["sha256"], r["bytes"], r["records"]) for r in manifest.collect()})
    assert found[0] == found[1] and len(found[0]) > 10 and sum(v[2] for v in found[0].values()) == 900
    assert len({f[:12] for f in found[0]}) > 3 and any(f.endswith("00001.warc.gz") for f in found[0])
    for name, (sha, size, _) in found[0].items():
        data = pathlib.Path(tmp_path / "b" / name).read_bytes()
        assert hashlib.sha256(data).hexdigest() == sha and len(data) == size
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert ours(warc.read_archive(spark, str(tmp_path / "b"))) == brute([(r[0], r[2]) for r in rows])


def test_many_rows_of_one_page_id_are_split(spark, tmp_path):
    rows = [(4, "u", f"{i} " * 200) for i in range(500)]
    manifest = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"), shard_bytes=20_000)
    assert max(r["records"] for r in manifest.collect()) < 200


def test_sample_holds_a_key_once(spark):
    rows = spark.range(30_000).selectExpr("if(id < 29900, 7, id) AS page_id", "page_id AS spread", "10L AS stored")
    found = {r["page_id"]: r["stored"] for r in warc.sampled_keys(rows, 100).collect()}
    assert found == {7: 299_000} | {i: 10 for i in range(29_900, 30_000)}
    assert warc.sampled_keys(rows, 10 ** 9).count() <= 1


def test_very_many_equal_rows(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("if(id < 29900, 7, id) AS page_id", "'u' AS url", "'same' AS html")
    warc.write_archive(rows, str(tmp_path / "a"), shard_bytes=200_000)
    kinds = warc.read_archive(spark, str(tmp_path / "a"), with_payload=False).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in kinds} == {("response", None, 1), ("revisit", 7, 29_999)}


def test_damage_and_unlisted_files_are_noticed(spark, tmp_path):
    path = tmp_path / "a"
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(path))
    file = next(path.glob("*.warc.gz"))
    (path / "part-9999999-00000.warc.gz").write_bytes(b"not listed")
    assert warc.read_archive(spark, str(path)).count() == 1
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read_archive(spark, str(path)).count()


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0


def test_query_on_given_tables(spark):
    pages = [(r["page_id"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    assert ours(queries.QUERIES["op3_warc"](spark, SF)) == brute(pages)
