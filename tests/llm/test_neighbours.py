import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, step):
    own = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = [float(np.float32(x)) for x in e]
            own.setdefault((i, tuple(v)), None)
    width = max((len(v) for _, v in own), default=0)
    ids, v = np.array([i for i, _ in own]), np.array([[*v, *[0.0] * (width - len(v))] for _, v in own])
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % step == 0:
            d = np.sqrt(((v - q) ** 2).sum(axis=1))
            out.setdefault(int(i), set()).update((float(x), int(j)) for x, j in zip(d, ids, strict=True) if j != i)
    return {i: sorted(x)[:k] for i, x in out.items()}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(1500)]
    out += [(2000 + i, out[3][1]) for i in range(400)]  # a common vector, with ties
    out += [(5000, None), (5100, [None] * 20), (5200, [float("nan")] * 20), (5300, [float("inf")] + [0.0] * 19), (None, out[0][1]), (5400, []), (5500, [0.0] * 20), (5600, [1.0]), (5700, [0.5] * 30)]
    return [*out, out[5], out[100], (200, out[7][1])]


def test_all_probes_are_exact(spark, rows, monkeypatch):
    for name, value in (("SHARD_MIN", 50), ("SHARD_MAX", 100), ("GROUP", 3), ("QUERY_BLOCK", 7), ("ROW_BLOCK", 64), ("PAIR_BLOCK", 33)):
        monkeypatch.setattr(neighbours, name, value)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Score", F.lit(1)).withColumn("b", F.lit("x")).repartition(3)
    got, want = answers(neighbours.nearest(df, n_probes=10_000)), brute(rows, 10, 100)
    assert {i: [j for _, j in x] for i, x in got.items()} == {i: [j for _, j in x] for i, x in want.items()}
    assert all(np.isclose(a, b, rtol=1e-14) for i in want for (a, _), (b, _) in zip(got[i], want[i], strict=True))


def test_recall_and_own_scores(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = answers(neighbours.nearest(df)), brute(rows, 10, 100)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    at_most = [sum(s <= want[i][-1][0] * (1 + 1e-12) for s, _ in got[i]) for i in want]
    assert sum(at_most) >= 0.9 * 10 * len(want)


def test_registered_query_against_brute_force(spark):
    for sf in ("sf0.01", "sf0.1"):
        folder = f"/root/testdata/{sf}"
        got = answers(queries.op12_nearest_neighbours(spark, folder))
        want = brute([tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()], 10, 100)
        hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
        assert hits >= 0.93 * sum(map(len, want.values()))
        exact = {(i, j): s for i, x in want.items() for s, j in x}
        assert all(math.isclose(s, exact[i, j], rel_tol=1e-14) for i, x in got.items() for s, j in x if (i, j) in exact)


def test_few_candidates_are_all_found(spark):
    # far from all probed buckets, and fewer than k
    away = [(0, [1.0] + [0.0] * 63)] + [(i, [-1.0, i / 1e3] + [0.0] * 62) for i in range(1, 6)]
    got = answers(neighbours.nearest(spark.createDataFrame(away, SCHEMA)))
    assert [j for _, j in got[0]] == [j for _, j in brute(away, 10, 100)[0]] == [1, 2, 3, 4, 5]
    many = [(0, [1.0] + [0.0] * 63)] + [(i, [-1.0] + [0.0] * 63) for i in range(1, 40)]
    assert [j for _, j in answers(neighbours.nearest(spark.createDataFrame(many, SCHEMA)))[0]] == list(range(1, 11))
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0


def test_extreme_norms(spark):
    rows = [(i, [10.0 ** (300 - i), 1.0]) for i in range(0, 600, 50)]
    got = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert len(got) == 6 and all(len(x) == 10 and all(math.isfinite(s) for s, _ in x) for x in got.values())


def test_hashing():
    rng = np.random.default_rng(1)
    x = neighbours.unit_rows(rng.normal(size=(50, 16)))
    r = neighbours.rotated(x, 3)
    assert np.allclose(r @ r.T, x @ x.T)  # a rotation
    b = neighbours.buckets(x, 4)
    assert ((b // 32) == np.arange(4)).all()
    first = neighbours.probes(x, 128, 4)
    assert all(set(row) <= set(p) for row, p in zip(b.tolist(), first.tolist(), strict=True))  # all buckets: its own are among them
    assert all(set(p[:1]) <= set(row) for row, p in zip(b.tolist(), neighbours.probes(x, 1, 4).tolist(), strict=True))
