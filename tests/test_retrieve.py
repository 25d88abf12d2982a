"""Ranking operators against brute force."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom import scale
from siteloom.operators import index as I
from siteloom.operators import neighbours as V
from siteloom.operators import retrieve as R
from siteloom.operators import shape as S
from siteloom.operators.index import SearchIndex
from siteloom.sources.index_store import save_by_term, with_terms


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03d}", [float(x) for x in rng.normal(size=8)], ["en", "fr"][i % 2]) for i in range(300)]
    rows += [(f"w{i:03d}", rows[0][1], "en") for i in range(150)]  # a third are copies of one vector
    rows += [("zero", [0.0] * 8, "en"), ("none", None, "en")]
    return spark.createDataFrame(rows, "id string, vector array<float>, language string").cache()


@pytest.fixture(scope="module")
def asked(spark, vectors):
    rows = [(i, r.vector, "en" if i % 3 == 0 else None) for i, r in enumerate(
        vectors.filter("id between 'v000' and 'v019'").orderBy("id").collect())]
    return spark.createDataFrame(rows, "qid long, vector array<float>, language string").cache()


def nearest(vectors, asked, k):
    stored = [(r.id, np.array(r.vector, np.float32).astype(float), r.language) for r in vectors.collect()
              if r.vector and any(r.vector)]
    out = set()
    for q in asked.collect():
        v = np.array(q.vector, np.float32).astype(float)
        scored = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w, lang in stored
                  if q.language in (None, lang)]
        out |= {(q.qid, i, n + 1) for n, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("limit", [V.QUERY_BYTES, 0])
def test_both_exact_ways_equal_brute_force(vectors, asked, limit):
    found = V.knn(asked, vectors, 10, max_query_bytes=limit)
    assert {(r.qid, r.id, r.rank) for r in found.collect()} == nearest(vectors, asked, 10)


def test_more_probed_cells_find_more(vectors, asked):
    stored = vectors.filter("vector is not null and id < 'w'")
    exact = {(q, i) for q, i, _ in nearest(stored, asked, 10)}
    centres = V.train_cells(stored, 6)
    placed = V.assign_cells(stored, centres)
    recalls = [len(exact & {(r.qid, r.id) for r in V.knn_approx(asked, placed, centres, p, 10).collect()}) / len(exact)
               for p in (1, 3, 6)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and recalls[0] < 1.0


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 8)) * 10
    rows = [(f"c{i:03d}", [float(x) for x in middles[i % 5] + rng.normal(size=8)]) for i in range(300)]
    stored = spark.createDataFrame(rows, "id string, vector array<float>")
    few = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows[:20])], "qid long, vector array<float>")
    centres = V.train_cells(stored, 5)
    found = V.knn_approx(few, V.assign_cells(stored, centres), centres, 2, 10).collect()
    every = {(r.qid, r.id) for r in V.knn(few, stored, 10).collect()}
    assert len(every & {(r.qid, r.id) for r in found}) / len(every) >= 0.9


def scored(spark, n=400):
    values = random.Random(7)
    rows = [(q, f"d{i:03d}", round(values.choice([1.5, 2.25, values.random() * 9]), 6)) for q in range(3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "qid long, id string, score double").repartition(7)


def test_neighbours_far_down_keep_their_exact_rank(spark):
    rows, scores = scored(spark)
    near = [(q, f"d{i:03d}", n) for q in range(3) for n, i in enumerate(range(0, 400, 9), 1)] + [(0, "absent", 99)]
    found = R.text_ranks(scores, spark.createDataFrame(near, "qid long, id string, rank int"), depth=20)
    wanted = set()
    for q in range(3):
        order = sorted((-s, i) for qq, i, s in rows if qq == q)
        near_ids = {i for qq, i, _ in near if qq == q}
        wanted |= {(q, i, n) for n, (_, i) in enumerate(order, 1) if n <= 20 or i in near_ids}
    assert {(r.qid, r.id, r.text_rank) for r in found.collect()} == wanted


def test_fusion_does_not_depend_on_the_order_of_legs(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, id string, text_rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid long, id string, rank int")
    one = R.hybrid(a, b).collect()
    two = R.hybrid(b.withColumnRenamed("rank", "text_rank"), a.withColumnRenamed("text_rank", "rank")).collect()
    assert sorted(one) == sorted(two)
    assert {r.id: r.score for r in one}["y"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_collapse_keeps_one_row_per_key(spark):
    values = random.Random(11)
    rows = []
    for q in range(60):
        for rn in range(1, values.randint(1, 20) + 1):
            parent = values.choice(["a", "b", "c", None, ""])
            rows.append((q, rn, parent, values.choice(["u", "v", None, ""]) if not parent else "s",
                         values.choice([None, 0.0, 1.0, 2.0])))
    df = spark.createDataFrame(rows, "qid long, rn int, parent_id string, source_url string, reranker double")
    found = S.collapse(df).collect()
    members = {}
    for row in rows:
        members.setdefault((row[0], row[2] or None, None if row[2] else row[3] or row[1]), []).append(row)
    best = {max(own, key=lambda r: (r[4] or 0.0, -r[1])) for own in members.values()}
    assert {(r.qid, r.rn) for r in found} == {(r[0], r[1]) for r in best} and len(found) == len(members)
    for q in range(60):
        first = sorted((min(r[1] for r in own), max(own, key=lambda r: (r[4] or 0.0, -r[1]))[1])
                       for key, own in members.items() if key[0] == q)
        assert [rn for _, rn in first] == [r.rn for r in sorted((r for r in found if r.qid == q), key=lambda r: r.pos)]


def test_pages_of_cards_are_full(spark):
    rows = [(1, f"p{i % 4}_{i}", i + 1, float(i % 3)) for i in range(20)] + [(2, "a_b_7", 1, None), (2, "a_b_8", 2, None), (2, "a", 3, None)]
    df = spark.createDataFrame(rows, "qid int, id string, rn int, reranker double")
    found = [tuple(r) for r in S.first_per_parent(df).select("qid", "rn", "id").orderBy("qid", "rn").collect()]
    assert found == [(1, 1, "p0_8"), (1, 2, "p1_5"), (1, 3, "p2_2"), (1, 4, "p3_11"), (2, 1, "a_b_7"), (2, 2, "a")]
    assert S.first_per_parent(df.limit(0)).collect() == []


def test_collapse_of_a_few_given_rows(spark):
    rows = [(1, 1, "a", "s", 1.0), (1, 2, "b", "s", 3.0), (1, 3, "a", "s", 2.0), (1, 4, None, "http://h/%C3%A9", None),
            (1, 5, "", "http://h/é", None), (1, 6, None, None, 9.0), (1, 7, None, "", 9.0), (1, 8, "b", "s", 3.0)]
    df = spark.createDataFrame(rows, "qid long, rn int, parent_id string, source_url string, reranker double")
    assert sorted((r.pos, r.rn) for r in S.collapse(df).collect()) == [(1, 3), (2, 2), (3, 4), (4, 6), (5, 7)]


@pytest.mark.parametrize("k", [1000, 1050])
def test_ranks_are_limited_before_the_shuffle(spark, k):
    df = spark.range(5000).select((F.col("id") % 2).alias("qid"), F.col("id"))
    top = scale.top_k(df, ["qid"], [F.asc("id")], k)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert top.count() == 2 * k


def test_facets_count_values_and_skip_nulls(spark):
    rows = [(1, "en", "a", "doc")] * 3 + [(1, "fr", None, "doc"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "qid long, language string, section string, kind string")
    assert {tuple(r) for r in S.facets(df).collect()} == {
        (1, "language", "en", 3), (1, "language", "fr", 1), (1, "section", "a", 3), (1, "kind", "doc", 4)}
    assert {r.value for r in S.facets(df, n=1).filter("field = 'language'").collect()} == {"en"}
    with pytest.raises(ValueError):
        S.facets(df, fields=("chunk",))


@pytest.mark.parametrize("salts", [1, 3])
def test_top_k_is_exact_for_a_hot_key(spark, salts):
    rows, scores = scored(spark, 100)
    hot = scores.withColumn("qid", F.lit(1))
    found = scale.top_k(hot, ["qid"], [F.desc("score"), F.asc("id")], 25, salts=salts).collect()
    order = sorted((-s, i) for _, i, s in rows)[:25]
    assert sorted((-r.score, r.id) for r in found) == order and {r["rank"] for r in found} == set(range(1, 26))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    left = spark.range(200).select(F.col("id"), F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 5).alias("k"))
    right = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (9, "d")], "k long, v string")
    one = scale.lookup_join(left, right, ["k"], how).collect()
    two = scale.lookup_join(left, right, ["k"], how, max_bytes=0)
    assert sorted(map(str, one)) == sorted(map(str, two.collect()))
    assert "Broadcast" not in two.hint("merge")._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_second_stage(spark):
    terms = spark.createDataFrame([(1, [("cat", 3.0), ("dog", 1.0)])], "qid long, terms array<struct<term:string,idf:double>>")
    rows = spark.createDataFrame([(1, "a", 1, "A dog. The cat sat. End", "Cat"), (1, "b", 51, "cat", ""), (2, "c", 1, "x", "x")],
                                 "qid long, id string, rank int, chunk string, title string")
    found = {r.id: r for r in R.rerank(rows, terms).collect()}
    assert found["a"].caption == "The cat sat." and found["a"].reranker == pytest.approx(2.0 + 1.2 * 0.75 + 0.8 * 0.75)
    assert found["b"].reranker is None and found["c"].reranker == 0.0


def test_probes_follow_measured_recall_on_the_given_vectors(spark, tmp_path):
    """Every vector of the smallest table asks for 10 neighbours."""
    stored = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    centres = V.chosen_centres(stored, 20)
    placed, asked = V.write_cells(stored.drop("qid"), centres, str(tmp_path / "cells")), stored.drop("id")
    exact = {(r.qid, r.id) for r in V.knn(asked, stored.drop("qid"), 10).collect()}
    measured, probes = V.recalls(asked, placed, centres, 10), V.probes_for(asked, placed, centres, 0.9, 10)
    print("recall@10 by probes", [round(r, 3) for r in measured], "for 0.9:", probes)
    for p in (6, probes - 1, probes):
        found = {(r.qid, r.id) for r in V.knn_approx(asked, placed, centres, p, 10).collect()}
        assert measured[p - 1] == pytest.approx(len(exact & found) / len(exact))
    assert measured[probes - 2] < 0.9 <= measured[probes - 1] and measured[-1] == 1.0


def test_matrix_scores_equal_the_join(spark, monkeypatch):
    """Filters, repeated query ids, repeated chunk ids, a weight below zero, and facet columns."""
    values = random.Random(21)
    posted = [(f"c{values.randint(0, 60)}", values.choice(["en", "fr", None]), "s", "doc", values.choice(["chunk", "title"]),
               values.randint(1, 9), f"t{values.randint(0, 20)}", values.randint(1, 3)) for _ in range(900)]
    rows = spark.createDataFrame(posted, "id string, language string, section string, kind string, field string, dl int, term string, tf int")
    told = [(values.randint(1, 12), values.choice(["chunk", "title"]), f"t{values.randint(0, 25)}", 4.5, 1.0, values.choice([-0.5, 0.25, 1.5]),
             values.choice([None, "en", "fr", "es"]), values.choice([None, "s"]), None) for _ in range(80)]
    weights = spark.createDataFrame(told, "qid long, field string, term string, avgdl double, idf double, weight double, _language string, _section string, _kind string")
    index = SearchIndex(rows, rows, rows, rows)
    for given in (weights, weights.filter("weight > 0"), weights.limit(0)):
        for facets in (False, True):
            found = R.bm25_scores(None, index, given, facets)
            monkeypatch.setattr(R, "MATRIX_CELLS", -1)
            joined = R.bm25_scores(None, index, given, facets)
            monkeypatch.undo()
            keys = [c for c in joined.columns if c != "score"]
            one, two = ({tuple(r[c] for c in keys): r.score for r in df.collect()} for df in (found, joined))
            assert found.columns == joined.columns and set(one) == set(two) and (one or not given.count())
            assert all(one[k] == pytest.approx(two[k], abs=2e-6) for k in one)
    # A posting is no longer multiplied by the queries that hold its term.
    assert "collect_list" in R.bm25_scores(None, index, weights)._jdf.queryExecution().optimizedPlan().toString()


def test_many_queries_are_searched_block_by_block(spark, vectors, asked, monkeypatch):
    """The number of block pairs grows with queries and rows, and so do the partitions."""
    monkeypatch.setattr(V, "SENT_QUERIES", 10)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 7)
    seen = []
    blocks = V._knn_blocks
    monkeypatch.setattr(V, "_knn_blocks", lambda *args: seen.append(blocks(*args)) or seen[-1])
    found = V.knn(asked, vectors, 10)
    assert {(r.qid, r.id, r.rank) for r in found.collect()} == nearest(vectors, asked, 10)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {4 * 3 * 65})" in plan


@pytest.mark.parametrize("first, dense, wait", [(256, 16, 10), (4, 10 ** 9, 1), (4, 0, 10)])
def test_blocks_equal_brute_force(spark, monkeypatch, first, dense, wait):
    """Pairs of vectors are not scored one query at a time: packs of rows meet as matrices. Copies, repeated and missing
    ids, filters, cells, lists that are not full, and vectors that are not numbers are among them."""
    monkeypatch.setattr(V, "SENT_QUERIES", 10)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 70)
    for name, value in {"TILE": 32, "FIRST_ROWS": first, "DENSE": dense, "PAIRS": 5}.items():
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(8)
    rows = [(f"v{i % 190}", [float(x) for x in rng.normal(size=6)], ["en", "fr", None][i % 3], i % 4) for i in range(200)]
    rows += [(f"w{i:03d}", rows[i % 2][1], "en", i % 2) for i in range(60)]
    rows += [(None, rows[5][1], "fr", 1), ("zero", [0.0] * 6, "en", 0), ("none", None, "en", 0), ("lost", [float("nan")] * 6, "en", 1), ("few", rows[6][1], "es", 3)]
    stored = spark.createDataFrame(rows, "id string, vector array<float>, language string, cell int").repartition(3)
    told = [(2 ** 60 + i // 2 * 2, rows[i][1], [None, "en", "es"][i % 3], sorted({i % 4, i % 3})) for i in range(120)]
    told += [(None, rows[7][1], None, [0, 1, 2, 3]), (5, [0.0] * 6, None, [0]), (6, None, None, [0])]
    asked = spark.createDataFrame(told, "qid long, vector array<float>, language string, cells array<int>").repartition(2)
    unit = {i: np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float))
            for i, r in enumerate(rows) if r[1] and any(r[1]) and not np.isnan(r[1][0])}

    def brute(with_cells, k):
        found = {}
        for qid, vector, language, cells in told:
            if vector and any(vector):
                v = np.array(vector, np.float32).astype(float)
                for i, w in unit.items():
                    name, _, lang, cell = rows[i]
                    if language in (None, lang) and (not with_cells or cell in cells):
                        found.setdefault(qid, []).append((-round(float(v @ w / np.linalg.norm(v)), 6), name or ""))
        return {(qid, n, name, -score) for qid, own in found.items() for n, (score, name) in enumerate(sorted(own)[:k], 1)}
    for with_cells, k in ((False, wait), (True, wait), (True, 300)):
        found = V.knn(asked if with_cells else asked.drop("cells"), stored if with_cells else stored.drop("cell"), k)
        assert {(r.qid, r.rank, r.id or "", r.score) for r in found.collect()} == brute(with_cells, k)
        # Workers have the constants as they are; here they are set.
        told_rows = stored.filter("vector is not null").toArrow()
        told_asked = asked.filter("vector is not null").filter(F.exists("vector", lambda x: x != 0)).toArrow()
        direct = V._best_pairs(told_asked if with_cells else told_asked.drop_columns("cells"), told_rows, k).to_pylist()
        best = spark.createDataFrame([(r["qid"], r["id"], r["score"]) for r in direct], V._OUT)
        ranked = scale.top_k(best, ["qid"], [F.desc("score"), F.asc("id")], k)
        assert {(r.qid, r.rank, r.id or "", r.score) for r in ranked.collect()} == brute(with_cells, k)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    ragged = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0] * 6)], "id string, vector array<float>").coalesce(1)
    with pytest.raises(Exception, match="vectors of 2 and of 6 numbers"):
        V.knn(asked.drop("cells", "language"), ragged, 3).collect()


def random_index(spark, rows=900, chunks=60):
    """Postings, repeated keys among them, and the same as lists: one list is a few postings of a key, field and length."""
    values = random.Random(31)
    posted = {}
    for _ in range(rows):
        key = (f"c{values.randint(0, chunks):02d}", values.choice(["en", "fr", None]), f"s{values.randint(0, 3)}", "doc", values.choice(["chunk", "title"]), values.randint(1, 3))
        posted[*key, f"t{values.randint(0, 20)}"] = values.randint(1, 2)
    flat = spark.createDataFrame([(*k, n) for k, n in posted.items()], "id string, language string, section string, kind string, field string, dl int, term string, tf int")
    keys = ["id", "language", "section", "kind", "field", "dl"]
    lists = flat.groupBy(*keys).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
    told = [(q, values.choice(["chunk", "title"]), f"t{values.randint(0, 25)}", 4.5, 1.0, values.choice([0.25, 1.5]),
             values.choice([None, "en"]) if q % 2 else None, None, None) for q in range(1, 9) for _ in range(6)]
    weights = spark.createDataFrame(told, "qid long, field string, term string, avgdl double, idf double, weight double, _language string, _section string, _kind string")
    return flat, lists, weights


def test_lists_give_the_scores_of_their_postings(spark):
    flat, lists, weights = random_index(spark)
    for facets in (False, True):
        one, two = (sorted(map(str, R.bm25_scores(None, SearchIndex(flat, flat, flat, flat, lists=own), weights, facets).collect())) for own in (None, lists))
        assert one == two and one


def test_ranks_and_facets_come_from_one_pass(spark):
    """Ranks of the head and of neighbours however deep, ties and chunks without a match among them, and counts of all matches."""
    flat, lists, weights = random_index(spark)
    single = flat.dropDuplicates(["id", "field", "term"]).withColumns({"language": F.lit("en"), "dl": F.lit(2), "tf": F.lit(1)})
    near = spark.createDataFrame([(q, f"c{i:02d}", n) for q in range(1, 12) for n, i in enumerate(range(q, 75, 4), 1)], "qid long, id string, rank int")
    one_list = single.groupBy("id", "language", "section", "kind", "field", "dl").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
    for own in (None, one_list):
        index = SearchIndex(single, single, single, single, lists=own)
        scores = R.bm25_scores(None, index, weights)
        assert scores.groupBy("qid", "score").count().filter("count > 3").count() > 0
        wanted = sorted(map(tuple, R.text_ranks(scores, near, 5).select("qid", "id", "text_rank").collect()))
        found, none = R.text_leg(None, index, weights, near, 5)
        assert sorted(map(tuple, found.select("qid", "id", "text_rank").collect())) == wanted and none is None
    index = SearchIndex(flat, flat, flat, flat, lists=lists)
    _, counts = R.text_leg(None, index, weights, near, 5, facets=True)
    matches = R.bm25_scores(None, index, weights, facets=True)
    plain = {tuple(r) for r in matches.groupBy("qid", "language", "section", "kind").count().collect()}
    assert {tuple(r) for r in counts.groupBy("qid", "language", "section", "kind").agg(F.sum("n")).collect()} == plain


def test_best_chunks_and_counts_do_not_need_all_scores(spark):
    flat, lists, weights = random_index(spark)
    index = SearchIndex(flat, flat, flat, flat, lists=lists)
    sent = R._sent(weights)
    everything = R.bm25_scores(None, index, weights)
    wanted = scale.top_k(everything, ["qid"], R.ranked_by(), 4)
    summed = R._summed(lists.coalesce(1), sent, 4)
    assert sorted(map(str, R._best_rows(summed, 4).collect())) == sorted(map(str, wanted.select("qid", "id", "score", "rank").collect()))
    assert "MapInArrow" in R._best_rows(summed, 4)._jdf.queryExecution().executedPlan().toString()
    ties = everything.groupBy("qid", "score").count().agg(F.max("count")).first()[0]
    assert summed.count() <= 8 * (4 + ties) < everything.count()
    facets = R._facet_rows(R._summed(lists, sent, 0, facets=True)).agg(F.sum("n")).first()[0]
    assert facets == R.bm25_scores(None, index, weights, facets=True).count()


def by_block(spark, lists, shelves=8):
    """An index by term of which each block is made here, with the constants of this process."""
    own = lists.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("id", "language", "section", "kind", "field", "dl", "terms", "tfs")).alias("entries"))
    rows = []
    for number, entries in enumerate(I._blocks(own.select("entries").coalesce(1).toArrow()["entries"].combine_chunks())):
        keys, told = I._block_lists(entries)
        for shelf, table in [(I.KEYS_SHELF, keys), *I._shelved(told, shelves)]:
            for batch in table.combine_chunks().to_batches():
                rows += I._inverted_rows(number, shelf, batch).to_pylist()
    return spark.createDataFrame([tuple(r.values()) for r in rows], f"{I.INVERTED_DDL}, shelf int").repartition(3)


@pytest.mark.parametrize("entries", [None, 5, 32 * 1024])
def test_lists_by_term_give_the_scores_of_their_postings(spark, monkeypatch, entries):
    """What is stored by term is a row per term of a block, and these are scored as the postings are: repeated ids, filters, facets,
    ranks of neighbours. A chunk may have more entries than a block."""
    flat, lists, weights = random_index(spark)
    plain = SearchIndex(flat, flat, flat, flat, lists=lists)
    if entries:
        monkeypatch.setattr(I, "BLOCK_ENTRIES", entries)
        stored = by_block(spark, lists)
        index = replace(plain, by_term=I.upright(stored), inverted=stored, shelves=8)
    else:
        path = scale.scratch_path(spark, "by-term")
        save_by_term(flat, path, 8)
        index = with_terms(plain, path)
        own = index.inverted.filter("term is not null")
        assert own.filter(own.shelf != I.shelf(8)).count() == 0 < own.select("field", "term").distinct().count() == own.count() < flat.count() / 10
    assert sorted(map(str, index.by_term.select(*flat.columns).collect())) == sorted(map(str, flat.collect()))
    for facets in (False, True):
        found, wanted = (R.bm25_scores(None, i, weights, facets, most=1.0) for i in (index, plain))
        assert found.columns == wanted.columns and "places" in found._jdf.queryExecution().optimizedPlan().toString()
        one, two = ({tuple(r[c] for c in wanted.columns if c != "score"): r.score for r in df.collect()} for df in (found, wanted))
        assert set(one) == set(two) and found.count() == len(one) > 0 and all(one[k] == pytest.approx(two[k], abs=2e-6) for k in one)
    near = spark.createDataFrame([(q, f"c{i:02d}", n) for q in range(1, 12) for n, i in enumerate(range(q, 75, 4), 1)], "qid long, id string, rank int")
    monkeypatch.setattr(R, "MOST_SHELVES", 1.0)
    ranks = [R.text_leg(None, i, weights, near, 5)[0] for i in (index, plain)]
    assert len({str(sorted(tuple(r) for r in df.select("qid", "id", "text_rank").collect())) for df in ranks}) == 1
