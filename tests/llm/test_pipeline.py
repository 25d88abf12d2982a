"""Every stage against a plain version on its own input, then the whole run."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as plain_contamination
from test_jaccard_join import brute as plain_components
from test_line_chunks import brute as plain_lines
from test_packing import checked
from test_quality_rules import brute as plain_counts

import __spark_entry__
import corpus_pipeline as P
from siteloom.llm import packing, quality_rules

SF = "/root/testdata/sf0.001"
NAMES = [name for name, _ in P.STAGES]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the input and of every stage's output, with some rows of odd kinds put in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = docs.filter("doc_id in (9, 13)").withColumn("doc_id", F.col("doc_id") + 10 ** 6).withColumn("text", F.concat("text", F.lit(" more")))
    odd = docs.limit(4).withColumn("text", F.lit(None).cast("string")).union(docs.filter("doc_id in (9, 6)"))
    docs = docs.union(near).union(odd).union(docs.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("bigint")))
    frames = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    rules = quality_rules.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    judged = quality_rules.judged(stages[0], rules).filter("rule = 0").selectExpr("doc.doc_id", "doc.text")
    expected = [r for r in rows(judged) if not plain_counts(r[1])[5]]
    assert sorted(rows(stages[1]), key=str) == sorted(expected, key=str) and len(expected) < stages[0].count()


def test_line_dedup(stages):
    before, left = rows(stages[1]), plain_lines(rows(stages[1]))
    expected = [(d, left[d, t]) for d, t in before]
    expected = [(d, t) for (d, t), (_, was) in zip(expected, before, strict=True) if t == was or re.search(r"[^ \t-\r]", t)]
    assert sorted(rows(stages[2]), key=str) == sorted(expected, key=str)
    assert stages[2].filter("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("at", [0, 2])
def test_jaccard_join(spark, stages, at):
    before = rows(stages[at])
    kept = rows(stages[3] if at else P.near_duplicates(spark, stages[0], SF))
    named = [(d, n, c) for d, n, c in plain_components(before)]
    groups = {c for _, n, c in named if n}
    assert len(kept) == len(groups) + sum(1 for _, n, _ in named if not n)
    assert {d for d, t in kept if t is not None} == groups
    assert set(kept) <= set(before)


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    hit = {d for d, _, n, _ in plain_contamination(rows(stages[3]), items) if n}
    assert sorted(rows(stages[4]), key=str) == sorted([r for r in rows(stages[3]) if r[0] not in hit], key=str)


def test_packing(stages):
    checked(stages[5].collect(), rows(stages[4]), packing.LIMIT)


def test_whole_run_and_empty_table(spark, tmp_path):
    out = __spark_entry__.queries()["pipeline"](spark, SF)
    assert NAMES == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert out.count() > 20 and out.columns == ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
