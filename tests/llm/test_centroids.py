import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"
DIMS, K, ROUNDS = 6, 5, 3


def brute(rows, k, rounds, dims, seed=2):
    own = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(own, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in own]
        for j in range(len(c)):
            mine = [v for (_, v), t in zip(own, to, strict=True) if t == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *nearest(v)) for i, v in own]
    inertia = [sum(d for _, d, j in out if j == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for i, d, j in out), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    middle = [[rng.uniform(-2, 2) for _ in range(DIMS)] for _ in range(7)]
    out = [(i, [x + rng.gauss(0, 0.1 if i % 3 else 1) for x in middle[i % 7]]) for i in range(600)]
    out += [(1000 + i, out[3][1]) for i in range(300)]  # one common vector
    out += [(2000, None), (2001, [None] * DIMS), (2002, [float("nan")] * DIMS), (2003, [1.0] * (DIMS - 1)), (2004, []), (2005, [float("-inf")] * DIMS), (None, out[9][1]), (2006, [0.0] * DIMS)]
    return [*out, out[0], out[0]]


@pytest.mark.parametrize("tree", [40, 4096])
def test_against_brute_force(spark, rows, tree, monkeypatch):
    monkeypatch.setattr(centroids, "TREE_ROWS", tree)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Cluster", F.lit("x")).withColumn("radius", F.lit(None).cast("double")).repartition(3)
    got = sorted(map(tuple, centroids.cluster(df, K, ROUNDS, dims=DIMS).collect()), key=str)
    assert got == brute(rows, K, ROUNDS, DIMS)


def test_few_rows_ties_and_none(spark):
    few = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5])]
    got = sorted(map(tuple, centroids.cluster(spark.createDataFrame(few, SCHEMA), 40, 5, dims=2).collect()), key=str)
    assert got == brute(few, 40, 5, 2)
    assert len({r[1] for r in got if r[0] in (1, 2)}) == 1  # of equal centroids the smaller number has both
    assert centroids.cluster(spark.createDataFrame([], SCHEMA), dims=2).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components(spark):
    rows = [(i, [500_000.0 * (-1) ** i, float(i)]) for i in range(50)]
    got = sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, SCHEMA), 4, 2, dims=2).collect()), key=str)
    assert got == brute(rows, 4, 2, 2)
    with pytest.raises(Exception, match="need not fit a long"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], SCHEMA), dims=2).count()


def test_balls_are_settled_whole_and_rightly():
    rng = np.random.default_rng(5)
    c = rng.integers(-2000, 2000, (9, 8))
    v = np.concatenate([x + rng.integers(-30, 30, (200, 8)) for x in c])
    order, radius, count, sums = centroids.build(v)
    label, size, total, whole = centroids.descend(v[order], radius, count, sums, c)
    exact = ((v[order][:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (label == exact).all() and (size == np.bincount(exact, minlength=9)).all()
    assert (total == np.array([v[order][exact == j].sum(axis=0) for j in range(9)])).all()
    assert whole > 1000  # most rows lie in balls far from every border


def test_nodes_hold_their_rows():
    v = np.random.default_rng(6).integers(-500, 500, (333, 5))
    order, radius, count, sums = centroids.build(v)
    assert sorted(order.tolist()) == list(range(333))
    at = 0
    for level in range(centroids._levels(333) + 1):
        edge = centroids.bounds(333, level)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            x = v[order][a:b]
            assert count[at] == b - a
            assert (sums[at] == x.sum(axis=0)).all() and np.isclose(radius[at], np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)).max())
            at += 1
    assert at == len(count) and np.diff(edge).max() <= centroids.LEAF_ROWS
