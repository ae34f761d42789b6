"""Top-k search against all products."""

import math

import numpy as np
import pytest

from groundcheck.llm import topk_search as K
from groundcheck.llm.topk_search import exact_top_k


def brute(rows, every, k):
    """All lines of the k best, by plain whole numbers; a row is its place in ``rows``."""
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(sound):
        if i is None or i % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(sound) if b != a)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def lines(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def frame(spark, rows, parts=3):
    """With columns of clashing names."""
    return spark.createDataFrame([(i, v, 1, "d", 2.0) for i, v in rows], "vec_id long, embedding array<double>, c2 int, c3 string, c4 double").toDF("vec_id", "embedding", "Vec_Id", "d", "score").repartition(parts)


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 4
    return [(k, [float(x) for x in centres[k % 6] * rng.uniform(0.1, 3) + rng.normal(size=dim) * 0.3]) for k in range(n)]


@pytest.mark.parametrize("dim,k", [(3, 5), (16, 1), (64, 7)])
def test_products(spark, dim, k):
    rows = clustered(400, dim)
    found = exact_top_k(frame(spark, rows), lambda c: c % 10 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert lines(found) == brute(rows, 10, k)


def test_ties_nulls_and_odd_rows(spark):
    rows = clustered(60, 4)
    rows += [(k, [1.0, 0.5, -0.25, 0.0]) for k in range(100, 140)]  # equal vectors: ties go by id
    rows += [(100, [1.0, 0.5, -0.25, 0.0])] * 3  # repeated rows
    rows += [(150, None), (200, [1.0, None, 0.0, 0.0]), (250, [math.nan] * 4), (300, [math.inf, 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 0.5, -0.25, 0.0])]
    rows += [(350, []), (400, [2.0]), (450, [1.0, 1.0, 1.0, 1.0, 5.0])]  # other lengths
    out = exact_top_k(frame(spark, rows), lambda c: c % 50 == 0)
    from itertools import zip_longest

    padded = [(i, v if v is None else [x if x is not None or j < len(v) else 0.0 for j, x in enumerate([*v, *[0.0] * (5 - len(v))])]) for i, v in rows]
    assert lines(out) == brute(padded, 50, 5)
    assert list(zip_longest(sorted({r[0] for r in lines(out)}))) == [(0,), (50,), (100,), (350,), (400,), (450,)]


def test_few_rows(spark):
    rows = clustered(3, 4)
    assert lines(exact_top_k(frame(spark, rows), lambda c: c == 0)) == brute(rows, 10, 5)
    assert lines(exact_top_k(frame(spark, rows[:1]), lambda c: c == 0)) == []
    for none in (frame(spark, rows).limit(0), frame(spark, [(0, None), (1, [None])])):
        found = exact_top_k(none, lambda c: c == 0)
        assert found.collect() == [] and found.columns == ["query_id", "rank", "vec_id", "score"]
    nobody = exact_top_k(frame(spark, rows), lambda c: c < 0)
    assert nobody.collect() == []


def test_large_numbers(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(1).integers(-(2**22), 2**22, size=(80, 6)).tolist())]
    assert lines(exact_top_k(frame(spark, rows), lambda c: c % 10 == 0)) == brute(rows, 10, 5)  # products beyond 2^53
    with pytest.raises(ValueError, match="too large"):
        exact_top_k(frame(spark, [(0, [1e300])]), lambda c: c == 0)


def test_small_groups_and_files(spark, monkeypatch):
    """Several groups a task and several files of queries change nothing."""
    rows = clustered(500, 8, 3)
    df = frame(spark, rows)
    whole = lines(exact_top_k(df, lambda c: c % 5 == 0))
    monkeypatch.setattr(K, "QUERY_BYTES", 2000)
    monkeypatch.setattr(K, "COLUMNS", 7)
    assert lines(exact_top_k(df, lambda c: c % 5 == 0, pivots=3)) == whole == brute(rows, 5, 5)


def side(x, points):
    import pyarrow as pa

    return K.Side(pa.array(range(len(x))), np.arange(len(x)), x, K.Pivots(points, x[:0], np.zeros(0)).distances(x), np.arange(len(x)))


def test_bounds_hold_and_eliminate():
    """No product exceeds its bound, and of clustered rows most are never evaluated."""
    x = np.floor(256 * np.array([v for _, v in clustered(3000, 8, 5)]))
    points = K.choose(x[:1000], 32)
    assert len(np.unique(points, axis=0)) == len(points) == 32
    c = side(x, points)
    bound = K.bounds(c, slice(0, 40), c, float(np.sqrt((points**2).sum(axis=1)).max()))
    scores = x[:40] @ x.T
    assert (bound >= scores).all()
    met = 0
    for r in range(40):
        bound[r, r] = np.nan
        at, got, done = K.best(bound[r], c, x[r], -np.inf, 5)
        scores[r, r] = -np.inf
        assert got.tolist() == sorted(scores[r].tolist(), reverse=True)[:5]
        met += done
    assert met < 0.25 * 40 * len(x)
    assert len(K.choose(np.ones((50, 3)), 8)) == 1  # equal rows give one pivot


def test_lost_task_repeats(spark):
    """The result can be computed again after its first use, as when a task is run again."""
    rows = clustered(200, 8, 7)
    out = exact_top_k(frame(spark, rows), lambda c: c % 20 == 0)
    assert lines(out) == lines(out)
