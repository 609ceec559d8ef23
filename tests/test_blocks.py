"""Counts of shuffled and weighed individuals against plain sums, and what of a run is done once."""

import numpy as np
import pytest

from locusflow.functions import cache
from locusflow.operators import blocks, kernel
from locusflow.plans import fixtures, resample_queries

SF = "/root/testdata/sf0.001"


def block(size=2000, seed=0):
    rng = np.random.default_rng(seed)
    own = blocks.Labels(["a", "b", "c"], np.array([900, 40, 2060]))
    numbers = rng.permutation(np.sort(rng.choice(own.n, size, replace=False)))
    loci = []
    for k in (2, 3, 5):
        rows = np.flatnonzero(rng.random(size) > 0.2)
        loci.append((rows, rng.integers(0, k, len(rows)).astype(np.int16), rng.integers(0, k, len(rows)).astype(np.int16), k))
    return own, numbers, loci


@pytest.mark.parametrize(("tally", "draw"), [(blocks.by_labels, blocks.shuffled), (blocks.by_weights, blocks.weighed)])
@pytest.mark.parametrize("limit", [16, 100_000])
def test_tallies_are_plain_sums(tally, draw, limit):
    own, numbers, loci = block()
    got = tally(own, numbers, loci, 3, np.array([4, 9]), limit=limit)
    for (rows, x, y, k), (c, h) in zip(loci, got, strict=True):
        for r, rep in enumerate((4, 9)):
            label, weight = draw(own, numbers, 3, rep, limit)
            w = (np.ones(len(numbers)) if weight is None else weight)[rows]
            for p in range(3):
                for a in range(k):
                    mine = label[rows] == p
                    assert c[r, p, a] == (w * mine * ((x == a) * 1 + (y == a))).sum()
                    assert h[r, p, a] == (w * mine * ((x == a) != (y == a))).sum()


def test_listed_rounds_are_the_hashes():
    n, key = 50_000, blocks.keys(1, 2)
    whole = blocks.places(np.arange(n), n, key)  # rounds are listed, tiles are several
    assert sorted(whole.tolist()) == list(range(n))
    for i in range(0, n, 997):  # too few numbers to list rounds for
        assert blocks.places(np.arange(i, min(i + 7, n)), n, key).tolist() == whole[i : i + 7].tolist()


def test_matrix_beyond_a_block_is_not_collected(spark, monkeypatch):
    geno = fixtures.genotypes(spark, SF)
    assert kernel._matrix(geno) is not None
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 100)
    assert kernel._matrix(geno) is None


def test_genotypes_of_a_query_are_derived_once_and_dealt_by_individual(spark):
    for made in (resample_queries._g, resample_queries._complete):
        assert made(spark, SF).storageLevel.useMemory
    cache.release()
    plan = fixtures.genotypes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # below the loci
