"""Mined negatives against a plain search of all pairs, and the order and certification of visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import hard_negatives as H

KIND = "vec_id long, vector array<double>, label int, id int, score string"


def brute(rows):
    clean = sorted({(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v
                    and all(x is not None and np.isfinite(x) for x in v)})
    size = max({len(v) for _, _, v in clean}, key=lambda n: (sum(len(v) == n for _, _, v in clean), -n), default=0)
    clean = [c for c in clean if len(c[2]) == size]
    out = []
    for anchor, label, vector in clean:
        if anchor % 50:
            continue
        scores = [(-int(np.dot(vector, v)), i, own) for i, own, v in clean if i != anchor]
        for p, positive, _ in sorted(s for s in scores if s[2] == label)[:5]:
            fits = sorted(s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(anchor, positive, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND)
    return sorted(tuple(r) for r in H.mined(df, F.col("id") % 50 == 0, **more).collect())


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 12)) * 60
    own = rng.integers(0, 8, n)
    return [(i, [float(x) for x in np.floor(centres[c] + rng.normal(size=12) * 4)], int(c % 3)) for i, c in enumerate(own)]


def test_odd_rows(spark):
    rows = clustered(300)
    same = rows[10][1]
    rows += [(None, same, 1), (400, None, 1), (401, [], 1), (402, [float("nan")] * 12, 1), (403, [None] * 12, 1), (404, [1.0], 1),
             (405, [float("inf")] * 12, 1), (450, same, None), (450, same, 0), (450, same, 0), (450, same, 1), (500, [0.0] * 12, 2),
             *[(600 + i, same, i % 2) for i in range(60)]]
    assert mined(spark, rows, codes=4) == brute(rows)
    assert mined(spark, rows, codes=1, sample=5) == brute(rows)


def test_many_slabs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "SLAB_ROWS", 40)
    monkeypatch.setattr(H, "BLOCK", 3)
    monkeypatch.setattr(H, "RACK", 2)
    rows = clustered(700, seed=5)
    assert mined(spark, rows, codes=3) == brute(rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None, None)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []


def test_visits_follow_falling_bounds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=7).round(1), rng.normal(size=5).round(1)
        found = list(H.best_sums(a, b))
        assert len({(i, j) for _, i, j in found}) == 35
        assert [s for s, _, _ in found] == sorted((x + y for x in a for y in b), reverse=True)
        assert all(s == a[i] + b[j] for s, i, j in found)


@pytest.fixture(scope="module")
def small_index():
    rows = clustered(4000, seed=9)
    points = np.array([v for _, v, _ in rows])
    halves = H.means(points[:400, :6], 8), H.means(points[:400, 6:], 8)
    codes = H.nearest(points[:, :6], halves[0]), H.nearest(points[:, 6:], halves[1])
    radii = tuple(np.array([np.linalg.norm(p[c == i] - h[i], axis=1).max(initial=0) for i in range(8)])
                  for p, c, h in zip((points[:, :6], points[:, 6:]), codes, halves, strict=True))
    filled = np.zeros((8, 8), dtype=bool)
    filled[codes] = True
    return points, codes, H.Index(halves, radii, filled, np.ones(8, dtype=np.int64))


def test_bounds_hold(small_index):
    points, codes, index = small_index
    (high_1, low_1), (high_2, low_2) = index.half_bounds(points[:50])
    score = points[:50] @ points.T
    assert (score <= high_1[:, codes[0]] + high_2[:, codes[1]]).all()
    assert (score >= low_1[:, codes[0]] + low_2[:, codes[1]]).all()


def test_certified_anchors_stop(small_index):
    """An anchor whose window is full of higher scores than the bound of a cell does not visit it."""
    points, codes, index = small_index
    anchors = points[:20]
    score = np.sort(anchors @ points.T, axis=1)[:, ::-1][:, :5]
    block = H.Block(0, np.arange(20), np.zeros(20, dtype=np.int64), anchors, np.full((20, 1), -np.inf), np.full((20, 1), np.inf),
                    score[:, None, :].copy(), np.zeros((20, 1, 5), dtype=np.int64))
    wanted = H.next_cells(block, index, 0, 64)
    visited = sum(len(js) for anchors in wanted.values() for js in anchors.values())
    (high_1, _), (high_2, _) = index.half_bounds(anchors)
    bound = high_1[:, :, None] + high_2[:, None, :]
    assert visited == int((index.filled & (bound >= score[:, 4][:, None, None])).sum()) < 0.6 * 20 * index.filled.sum()
