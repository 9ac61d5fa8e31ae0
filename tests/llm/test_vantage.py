import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm import vantage as V


def frame(spark, rows):
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def brute(rows, every, k):
    out = []
    use = [(i, v) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    use = sorted({(i, tuple(v)) for i, v in use})
    for q, a in use:
        if q % every:
            continue
        near = {i: reduce(lambda s, e: s + e, (x * y for x, y in zip(a, v, strict=True))) for i, v in use if i != q and len(v) == len(a)}
        for n, (i, s) in enumerate(sorted(near.items(), key=lambda e: (-e[1], e[0]))[:k], 1):
            out.append((q, n, i, s))
    return out


def run(df, **kw):
    return sorted(map(tuple, V.neighbours(df, **kw).collect()))


@pytest.mark.parametrize("kind", ["uniform", "clustered", "norms", "copies"])
def test_factor_one_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12))
    if kind == "clustered":
        x = rng.normal(size=(10, 12))[rng.integers(0, 10, 1500)] + 0.05 * x
    elif kind == "norms":
        x *= np.exp(2 * rng.normal(size=(1500, 1)))
    elif kind == "copies":
        x[200:900] = x[7]
        x[1000:1020] = x[40]
    rows = list(enumerate(x.tolist()))
    assert run(frame(spark, rows), every=20, k=20, shard_rows=400) == brute(rows, 20, 20)


def test_trees_of_one_and_many_leaves_agree():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(700, 8)), rng.normal(size=(30, 8))
    ids, own = [np.array([i]) for i in range(700)], np.full(30, -1)
    a = V.Tree(x, ids, leaf=1000).search(own, q, 9, 1.0)
    b = V.Tree(x, ids, leaf=4).search(own, q, 9, 1.0)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_a_larger_factor_visits_less_and_keeps_recall():
    """Points near a plane, where there is something to prune."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = V.Tree(x, [np.array([i]) for i in range(4000)], leaf=16)
    q, own = x[::40], np.arange(0, 4000, 40)

    def visited(factor):
        n = 0
        points = tree.points

        class Counted(np.ndarray):
            def __getitem__(self, at):
                nonlocal n
                n += at.stop - at.start if isinstance(at, slice) else 0
                return np.asarray(points)[at]

        tree.points = points.view(Counted)
        try:
            return tree.search(own, q, 10, factor)[0], n
        finally:
            tree.points = points

    exact, all_points = visited(1.0)
    fewer, some = visited(1.3)
    assert some <= all_points
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, fewer, strict=True)]) >= 0.9


def test_recall_on_the_table(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = set(map(tuple, V.neighbours(vecs).select("query_id", "vec_id").collect()))
    for factor in (1.0, 1.2, 1.5):
        got = set(map(tuple, V.neighbours(vecs, factor=factor, shard_rows=100).select("query_id", "vec_id").collect()))
        assert len(got & exact) / len(exact) >= (1.0 if factor == 1.0 else 0.9)


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (20, None), (40, [0, 0]), (60, [math.nan, 1]), (80, [None, 1]), (100, [math.inf, 1]), (None, [1, 1])]
    rows += [(1, [1, 1]), (2, [1, 1]), (3, [-1, 0]), (4, [1, 2, 3]), (120, [3, 2, 1]), (5, []), (6, [1, -0.0])]
    df = frame(spark, rows).select("*", F.lit("x").alias("id"), F.lit(1).alias("shard"), F.lit(2).alias("vec"), F.lit(3).alias("rank"))
    assert run(df, k=3) == brute(rows, 20, 3)
    assert run(df.limit(0), k=3) == []


def test_fewer_than_k(spark):
    rows = [(0, [1.0, 2.0]), (7, [2.0, 1.0])]
    assert run(frame(spark, rows)) == [(0, 1, 7, 4.0)]
