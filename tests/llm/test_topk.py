import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import topk


def brute(rows, k, step):
    own = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            own.setdefault((i, tuple(math.floor(256 * float(np.float32(x))) for x in e)), None)
    out = []
    for i, v in own:
        if i % step == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in own if j != i)  # noqa: B905
            out += [(i, j, -s) for s, j in ranked[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(700)]
    out += [(700 + i, out[3][1]) for i in range(40)]  # a common vector, with ties
    out += [(900, None), (950, [None] * 24), (1000, [float("nan")] * 24), (1050, [float("inf")] + [0.0] * 23), (None, out[0][1]), (1100, []), (1150, [1.0]), (1200, [0.5] * 30), (2000, [1e6] * 24), (2050, [-1e6] * 24)]
    return [*out, out[5], out[50]]


@pytest.mark.parametrize("span", [100, 100_000])
def test_against_brute_force(spark, rows, span, monkeypatch):
    monkeypatch.setattr(topk, "SPAN", span)
    monkeypatch.setattr(topk, "QUERY_GROUP", 5)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Score", F.lit(1)).repartition(3)
    got = topk.top_k(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == sorted(brute(rows, 5, 50), key=lambda r: (r[0], -r[2], r[1]))
    assert all(1 <= r["rank"] <= 5 for r in got)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    got = topk.top_k(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-300, 300, (20, 23)).astype(float), rng.integers(-300, 300, (30, 23)).astype(float)
    exact, before = q @ c.T, np.inf
    for segments in (1, 2, 4, 8, 23, 64):
        bound = topk._statistics(q, segments) @ topk._statistics(c, segments).T
        assert (bound >= exact - 1e-6).all()
        before = bound
    assert np.allclose(before, exact)


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    table = pa.table({"vec_id": pa.array([7, 3, 3, 9, 3], pa.int64()), "v": pa.array([[1, 2], [4], [4], [], [4, 0]], pa.list_(pa.int64()))})
    ids, v = topk.unpack(table)
    again = topk.unpack(table.take([4, 3, 2, 1, 0]))
    assert ids.tolist() == again[0].tolist() == [3, 3, 7, 9] and v.tolist() == again[1].tolist() == [[4, 0], [4, 0], [1, 2], [0, 0]]


def test_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    big = 2.0**22  # 2**30 after scaling: products of two are 2**60 and more than doubles hold
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 3.0]), (50, [big, -1.0])]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(q, c): (256 * int(x[0])) * (256 * int(y[0])) + 65536 * int(x[1] * y[1]) for q, x in rows for c, y in rows if q % 50 == 0 and q != c}
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(spark.createDataFrame([(0, [2.0**54]), (1, [2.0**54])], schema)).collect()
    with pytest.raises(Exception, match="beyond 2"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], schema)).collect()


def test_groups_follow_the_queries(spark, monkeypatch):
    """All ids are divisible by 50, so every row asks."""
    monkeypatch.setattr(topk, "QUERY_GROUP", 16)
    rng = random.Random(8)
    rows = [(50 * i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df)
    assert got.count() == 600
    want = brute(rows, 5, 50)
    assert sorted((r.query_id, r.vec_id, r.score) for r in got.collect()) == sorted(want)
