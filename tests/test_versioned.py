"""Versioned tables: what readers see, which files a write or a lookup touches, replays and rivals."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import registry
from siteloom.scale import scratch_path
from siteloom.sources import landed as L
from siteloom.sources import sinks, versioned
from siteloom.sources.versioned import ConcurrentWrite, VersionedTable
from siteloom.streaming import streams

SCHEMA = T.StructType([T.StructField("part", T.StringType()), T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def table(spark, buckets=4):
    return VersionedTable(spark, scratch_path(spark, "versioned"), SCHEMA, ["part", "k"], by=("part",), buckets=buckets)


def seen(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_replace_all_rows_of_their_key(spark):
    t = table(spark)
    assert seen(t.read()) == []
    t.write(rows(spark, ("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", None, 1), ("b", "x", 1)))
    t.write(rows(spark, ("a", "x", 9), ("b", None, 8)))
    assert seen(t.read()) == seen(rows(spark, ("a", "x", 9), ("a", "y", 1), ("b", None, 8), ("b", "x", 1)))
    t.delete(rows(spark, ("b", None, 0), ("a", "z", 0)))
    assert seen(t.read()) == seen(rows(spark, ("a", "x", 9), ("a", "y", 1), ("b", "x", 1)))


def test_a_reader_sees_the_old_or_the_new_version(spark, monkeypatch):
    t = table(spark)
    before = t.write(rows(spark, ("a", "x", 1)))
    reader = t.read()
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.write(rows(spark, ("a", "x", 2), ("b", "n", 1)))
    monkeypatch.undo()
    assert seen(t.read()) == seen(reader) == [("a", "x", 1)] and t.state() == before
    t.write(rows(spark, ("a", "x", 3)))
    assert seen(reader) == seen(t.read(before.version)) == [("a", "x", 1)] and seen(t.read()) == [("a", "x", 3)]


def test_a_rival_is_refused(spark):
    t = table(spark)
    state = t.write(rows(spark, ("a", "x", 1)))
    name, cells = t._write(rows(spark, ("a", "x", 2)), state)
    t.write(rows(spark, ("a", "x", 3)))
    with pytest.raises(ConcurrentWrite):
        t._commit(state, {c: [name] for c in cells}, None)
    assert seen(t.read()) == [("a", "x", 3)] and not [n for n in t.folder.names("versions") if n.endswith(".tmp")]


def test_a_replayed_mark_changes_nothing(spark):
    t = table(spark)
    t.write(rows(spark, ("a", "x", 1)), ("run", 0))
    state = t.write(rows(spark, ("a", "x", 2)), ("run", 1))
    assert t.write(rows(spark, ("a", "x", 7)), ("run", 0)) == t.write(rows(spark, ("a", "x", 7)), ("run", 1)) == state
    assert t.done(("run", 1)) and not t.done(("run", 2)) and not t.done(("other", 0))


def test_only_touched_buckets_are_read_and_written(spark):
    t = table(spark, buckets=16)
    t.write(rows(spark, *[("a", f"k{i}", i) for i in range(400)]))
    every, first = set(t.read().inputFiles()), t.state()
    t.write(rows(spark, ("a", "k7", -1)))
    changed = {c for c, g in t.state().cells.items() if g != first.cells[c]}
    assert len(changed) == 1 and len(set(t.read().inputFiles()) - every) == 1
    near = t.near(rows(spark, ("a", "k7", 0)))
    assert len(near.inputFiles()) == 2 < len(every) and seen(near.filter("k = 'k7'")) == [("a", "k7", -1)]
    assert t.near(rows(spark, ("z", "k7", 0))).count() == 0


def test_generations_stay_few_and_old_ones_go(spark, monkeypatch):
    monkeypatch.setattr(versioned, "MAX_GENERATIONS", 3)
    t = table(spark, buckets=1)
    for i in range(9):
        t.write(rows(spark, ("a", f"k{i % 2}", i)))
        assert len(t.state().cells["part=a/_bucket=0"]) <= 3
    t.compact()
    assert t.vacuum(keep=1) > 0 and len(t.read().inputFiles()) == 1 and len(t.versions()) == 1
    assert seen(t.read()) == [("a", "k0", 8), ("a", "k1", 7)]


WRITES = st.lists(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["x", "y", None]), st.integers(0, 9)), min_size=1, max_size=4),
                  min_size=1, max_size=3)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(WRITES)
def test_any_writes_equal_a_dict(spark, writes):
    t, expected = table(spark, buckets=2), {}
    for batch in writes:
        t.write(rows(spark, *batch))
        expected |= {(p, k): [r for r in batch if r[:2] == (p, k)] for p, k, _ in batch}
    assert seen(t.read()) == sorted((r for own in expected.values() for r in own), key=repr)


def test_upsert_into_a_stored_table(spark):
    schema = T.StructType([*SCHEMA.fields, T.StructField("at", T.IntegerType())])
    t = VersionedTable(spark, scratch_path(spark, "t"), schema, ["part", "k"], buckets=2)
    for batch in ([("c", "a", 1, 9), ("c", "b", 1, 9)], [("c", "a", 2, 1), ("c", "a", 3, 2), ("c", "n", 4, 1)]):
        sinks.upsert_stored(t, spark.createDataFrame(batch, schema), ["at"])
    assert seen(t.read()) == [("c", "a", 3, 2), ("c", "b", 1, 9), ("c", "n", 4, 1)]


def test_artifacts_are_read_by_container(spark):
    store = sinks.artifact_store(spark, scratch_path(spark, "store"), buckets=2)

    def artifacts(*values):
        return spark.createDataFrame([(c, n, "t", bytearray(d), {"contenthash": d.decode()}) for c, n, d in values], store.schema)
    store.write(artifacts(("pages", "p.html", b"1"), ("pages", "p.md", b"1"), ("images", "i.png", b"2"), ("docs", "d.pdf", b"3")))
    store.write(artifacts(("images", "i.png", b"4")))
    scan = L.scan_container(store.read(), "images")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(container" in plan
    assert [(r["name"], bytes(r["data"])) for r in scan.collect()] == [("i.png", b"4")]
    at = dt.datetime(2024, 1, 1)
    manifest = sinks.stored_manifest(store, F.lit(at))
    assert "data:binary" not in manifest._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]
    assert sorted((r["name"], r["base_name"], r["content_hash"]) for r in manifest.collect()) == [
        ("d.pdf", None, "3"), ("i.png", None, "4"), ("p.html", "p", "1"), ("p.md", "p", "1")]


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_restart_and_replay(spark):
    """Every run reads what came since; a batch whose table write was made before the crash is not made again."""
    path, state = scratch_path(spark, "in"), scratch_path(spark, "s")
    t = streams.asset_table(spark, scratch_path(spark, "t"), buckets=2)
    for run in range(3):
        refs = spark.createDataFrame([(f"a{i}", f"p{run}") for i in range(run + 3)], streams.ASSET_SCHEMA)
        refs.coalesce(1).write.mode("append").parquet(path)
        streams.stream_asset_dedup(stream_of(spark, path, refs.schema), t, state)
    assert seen(t.read()) == [("a0", "p0"), ("a1", "p0"), ("a2", "p0"), ("a3", "p1"), ("a4", "p2")]
    number = t.state().version
    streams.stream_asset_dedup(stream_of(spark, path, streams.ASSET_SCHEMA), t, scratch_path(spark, "lost"))
    assert t.state().version == number


def test_spark_state_forgets_after_the_delay(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "s"))
    schema = "asset_url string, source_page string, at timestamp"
    day = [dt.datetime(2024, 1, d) for d in range(1, 12)]
    for batch in ([("a", "1", day[0]), ("a", "2", day[0]), ("b", "1", day[0])], [("a", "3", day[0])], [("c", "1", day[8])],
                  [("d", "1", day[9])], [("a", "9", day[9])]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = streams.unique_assets(stream_of(spark, path, spark.createDataFrame([], schema).schema), "at", "1 day")
        query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
    found = seen(spark.read.parquet(out).select("asset_url"))
    assert found == [("a",), ("a",), ("b",), ("c",), ("d",)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_tasks_of_a_refresh_follow_the_partitions(spark, monkeypatch, tmp_path):
    """A stream's files and the pieces of a bucket are not a fixed few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(registry, "scratch_path", lambda *_: str(tmp_path / "files"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        registry._stream(spark, spark.range(200))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "files").glob("*.parquet"))) == 9
    told = {}
    monkeypatch.setattr(streams, "into", lambda *_, **more: told.update(more))
    monkeypatch.setattr(streams, "run_available", lambda *_: None)
    streams.stream_index_refresh(None, None, "")
    parents = spark.range(500).select(F.concat(F.lit("doc-"), "id").alias("parent_id"), F.lit(0).alias("ord"))
    assert parents.select(*told["spread"]).distinct().count() == streams.PIECES
