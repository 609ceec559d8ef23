import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.operators import blocks, counts, gstat, kernel, margins, wc84


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def geno(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["b", "a", "c"][i % 3], f"L{j}", *(map(int, rng.integers(101, 104 + j % 3, 2) * int(rng.random() > 0.1)))) for i in range(180) for j in range(5)]
    rows = [(i, p, x, a, b) for i, p, x, a, b in rows if i % 11 or x != "L2"]  # absent rows as well as missing ones
    return spark.createDataFrame(rows, "indiv long, pop string, locus string, a1 int, a2 int").repartition(3).persist()


def chi2_far(got: Counter, want: dict, n: int) -> bool:
    """Whether counts are further from their expectations than chance lets them be (6 deviations of the statistic)."""
    assert set(got) <= set(want)
    chi2 = sum((got[k] - n * p) ** 2 / (n * p) for k, p in want.items())
    free = len(want) - 1
    return chi2 > free + 6 * math.sqrt(2 * free)


def test_random_tables_have_their_exact_distribution():
    rows, columns, n = (4, 3), (3, 2, 2), 40_000
    got = Counter(tuple(t.ravel().tolist()) for t in margins.tables(np.random.default_rng(1), np.array(rows), np.array(columns), n))
    f = math.factorial
    want = {}
    for a, b in itertools.product(range(4), range(3)):
        c = 4 - a - b
        if 0 <= c <= 2:
            cells = (a, b, c, 3 - a, 2 - b, 2 - c)
            want[cells] = math.prod(map(f, rows + columns)) / f(7) / math.prod(map(f, cells))
    assert sum(want.values()) == pytest.approx(1) and not chi2_far(got, want, n)


def test_homozygotes_have_their_exact_distribution():
    copies, n = (3, 3, 2), 40_000
    whole = [x for x, k in enumerate(copies) for _ in range(k)]
    want = Counter()
    for order in itertools.permutations(range(8)):
        if all(order[i] < order[i + 1] for i in range(0, 8, 2)) and list(order[::2]) == sorted(order[::2]):  # each way to pair eight copies once
            pairs = [(whole[order[i]], whole[order[i + 1]]) for i in range(0, 8, 2)]
            want[tuple(sum(a == b == x for a, b in pairs) for x in range(3))] += 1
    total = sum(want.values())
    assert total == 105
    got = Counter(map(tuple, margins.homozygotes(np.random.default_rng(2), np.tile(copies, (n, 1))).tolist()))
    assert not chi2_far(got, {k: v / total for k, v in want.items()}, n)


def test_places_are_permutations_and_even():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(blocks.places(np.arange(n), n, blocks.keys(1, 5)).tolist()) == list(range(n))
    assert blocks.places(np.array([12, 3]), 10**12, blocks.keys(2, 1)).max() < 10**12
    n, reps = 5, 24_000
    got = Counter(tuple(blocks.moved(np.arange(n), n, "s", r).tolist()) for r in range(reps))
    assert not chi2_far(got, {p: 1 / 120 for p in itertools.permutations(range(n))}, reps)
    n, reps, k = 5000, 800, 20  # by the network
    every = np.array([blocks.places(np.arange(n), n, blocks.keys("t", r)) for r in range(reps)]) * k // n
    assert not chi2_far(Counter((np.repeat(np.arange(n) * k // n, reps) * k + every.T.ravel()).tolist()), {i: 1 / k**2 for i in range(k * k)}, n * reps)
    for a, b in ((0, 1), (0, 71), (17, 4999)):  # neighbours, the same part of the number, and any two
        assert not chi2_far(Counter((every[:, a] // 4 * 5 + every[:, b] // 4).tolist()), {i: 1 / 25 for i in range(25)}, reps)


SIZES = [(kernel.permute, "labels", 1), (kernel.permute, "labels", 100_000), (kernel.permuted_counts, "labels", 1), (kernel.permute, "alleles_within", 1), (kernel.permuted_counts, "alleles_global", 1), (kernel.bootstrap_individual_counts, None, 1)]


@pytest.mark.parametrize(("made", "scheme", "listed"), SIZES)
def test_one_result_at_every_size(geno, made, scheme, listed, monkeypatch):
    monkeypatch.setattr(blocks, "LISTED", listed)
    monkeypatch.setattr(blocks, "LEAF", 7)
    of = {"scheme": scheme} if scheme else {}
    names = made(geno, 70, 3, engine="kernel", **of).columns
    within = rows_of(made(geno, 70, 3, engine="kernel", **of).select(names))
    for name, value in (("BLOCK_CELLS", 60), ("BLOCK_LOCI", 2), ("BLOCK_BYTES", 1), ("LOOKED_UP", 10)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(kernel, "MAX_CELLS", 1)
    beyond = rows_of(made(geno.repartition(7), 70, 3, engine="kernel", **of).select(names))
    assert within == beyond and len({r[0] for r in within}) == 70 and {r[1] for r in within} == {f"L{j}" for j in range(5)}


@pytest.mark.parametrize("scheme", kernel.SCHEMES)
def test_counts_lead_to_the_statistics(geno, scheme):
    c = kernel.permuted_counts(geno, 5, 7, scheme, "kernel")
    own = wc84.observed(c, ["rep"]).join(gstat.g_by_locus(c, ["rep"]), ["rep", "locus"]).select("rep", "locus", "fst", "fit", "fis", "g")
    got = rows_of(kernel.permute(geno, 5, 7, scheme, "kernel"))
    for a, b in zip(got, rows_of(own), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    whole = counts.allele_counts(geno)
    if scheme == "alleles_within":
        assert rows_of(c.filter("rep = 3").select("locus", "pop", "allele", "c")) == rows_of(whole.select("locus", "pop", "allele", "c"))
    totals = lambda x: rows_of(x.groupBy("locus", "allele").agg(F.sum("c")))
    assert totals(c.filter("rep = 4")) == totals(whole)


@pytest.mark.parametrize("scheme", kernel.SCHEMES)
def test_same_null_distribution_as_shuffles(geno, scheme):
    """Means and deviations of drawn replicates against those of rows that are really shuffled."""
    n = 400
    a, b = (x.groupBy("locus").agg(*[f(v).alias(f"{f.__name__}_{v}") for v in ("fst", "fis", "g") for f in (F.avg, F.stddev)]).orderBy("locus").collect() for x in (kernel.permute(geno, n, 1, scheme, "kernel"), kernel.permute(geno, n, 1, scheme, "auto")))
    for x, y in zip(a, b, strict=True):
        for v in ("fst", "fis", "g"):
            if scheme == "alleles_within" and v != "fis":
                continue  # G stays as it is
            sd = y[f"stddev_{v}"]
            assert abs(x[f"avg_{v}"] - y[f"avg_{v}"]) < 5 * sd * math.sqrt(2 / n)
            assert abs(x[f"stddev_{v}"] / sd - 1) < 5 / math.sqrt(n)


def test_weights_add_up_and_are_multinomial():
    leaf = {"limit": 4}
    own, n = blocks.Labels(["a", "b"], np.array([11, 3])), 4000
    every = np.array([blocks.weighed(own, np.arange(14), "w", r, **leaf)[1] for r in range(n)])
    assert (every[:, :11].sum(axis=1) == 11).all() and (every[:, 11:].sum(axis=1) == 3).all()
    part = np.array([blocks.weighed(own, np.array([5, 9, 12]), "w", r, **leaf)[1] for r in range(50)])
    assert (part == every[:50, [5, 9, 12]]).all()  # whichever others are asked for
    binomial = lambda k, size: {i: math.comb(k, i) / size**i * (1 - 1 / size) ** (k - i) for i in range(k + 1)}
    for i, size in ((0, 11), (10, 11), (12, 3)):
        want = binomial(size, size)
        want = {k: p for k, p in want.items() if p * n > 5} | {-1: sum(p for p in want.values() if p * n <= 5) or 1e-9}
        assert not chi2_far(Counter(int(x) if int(x) in want else -1 for x in every[:, i]), want, n)
    assert np.corrcoef(every[:, 0], every[:, 10])[0, 1] == pytest.approx(-1 / 10, abs=0.06)


def test_bootstrap_counts_as_drawn_rows_do(geno):
    """Means and deviations of a statistic over replicates, against md5 draws."""
    n = 300
    a, b = (wc84.fis_by_locus(kernel.bootstrap_individual_counts(geno, n, 2, e), ["rep"]).groupBy("locus").agg(F.avg("fis"), F.stddev("fis")).orderBy("locus").collect() for e in ("kernel", "auto"))
    for x, y in zip(a, b, strict=True):
        assert abs(x[1] - y[1]) < 5 * y[2] * math.sqrt(2 / n) and abs(x[2] / y[2] - 1) < 5 / math.sqrt(n)


def test_p_values_are_uniform_under_the_null():
    rng, p = np.random.default_rng(9), []
    for k in range(300):
        own = margins.tables(rng, np.array([40, 60, 30]), np.array([50, 40, 25, 15]), 1)
        none = np.zeros((1, 4))
        drawn = margins.tables(margins.generator("u", k), own[0].sum(axis=1), own[0].sum(axis=0), 99)
        g = margins.statistics(drawn, np.zeros((99, 4)))["g"]
        p.append((1 + (g >= margins.statistics(own, none)["g"][0] - 1e-9).sum()) / 100)
    p = np.sort(p)
    assert np.abs(p - np.arange(1, 301) / 300).max() < 1.63 / math.sqrt(300) + 0.01  # Kolmogorov's bound at 1 %


def test_g_test_from_counts(geno):
    c = counts.allele_counts(geno)
    got = {r["locus"]: (r["g"], r["p_value"]) for r in margins.g_p_values(c, 200, 4).collect()}
    want = {r["locus"]: r["g"] for r in gstat.g_by_locus(c).collect()}
    assert got.keys() == want.keys()
    for locus, (g, p) in got.items():
        assert g == pytest.approx(want[locus]) and 1 / 201 <= p <= 1
    apart = c.withColumn("allele", F.when(F.col("pop") == "a", 1).otherwise(2))
    assert all(r["p_value"] == pytest.approx(1 / 201) for r in margins.g_p_values(apart.groupBy("locus", "pop", "allele").agg(F.sum("c").alias("c")), 200, 4).collect())


def test_few_genotypes_and_none(spark):
    schema = "indiv long, pop string, locus string, a1 int, a2 int"
    for scheme in kernel.SCHEMES:
        assert kernel.permute(spark.createDataFrame([], schema), 3, 1, scheme).count() == 0
        one = spark.createDataFrame([(1, "a", "L1", 1, 2), (2, "a", "L1", 0, 0)], schema)
        assert [r["fst"] for r in kernel.permute(one, 2, 1, scheme).collect()] == [None, None]


@pytest.mark.parametrize(("missing", "every"), [(False, False), (True, True)])
def test_linkage_by_blocks_equals_rows_of_pairs(geno, missing, every, monkeypatch):
    key = lambda df: {(r["pop"], r["locus1"], r["locus2"]): (r["n"], r["g"]) for r in df.collect()}
    lone = geno.unionByName(geno.filter("indiv < 9").withColumn("pop", F.lit("d")).withColumn("a1", F.lit(101)).withColumn("a2", F.when(F.col("locus") == "L1", F.col("a2")).otherwise(101)))  # one genotype but at a locus
    want = key(gstat.ld_g(gstat.locus_pairs(lone, missing), every=every))
    for blocks_ in ((64, 8192), (2, 16)):
        monkeypatch.setattr(gstat, "LOCUS_BLOCK", blocks_[0])
        monkeypatch.setattr(gstat, "PEOPLE_BLOCK", blocks_[1])
        got = key(gstat.linkage(lone, missing, every))
        assert got.keys() == want.keys() and len(got) >= 30
        for k, v in got.items():
            assert v[0] == want[k][0] and v[1] == pytest.approx(want[k][1], abs=1e-8)
    assert gstat.linkage(geno.limit(0), missing, every).count() == 0


def test_linkage_tables_drawn_from_margins(spark, monkeypatch):
    """The p-values of shuffled individuals, with no bound on these, by the same observed values."""
    rng = np.random.default_rng(5)
    first, third = rng.integers(1, 4, (120, 2)), rng.integers(0, 4, (120, 2))
    second = np.where(rng.random((120, 1)) < 0.3, first, rng.integers(1, 4, (120, 2)))
    rows = [(i, "ab"[i % 2], x, *g[i].tolist()) for i in range(120) for x, g in (("L1", first), ("L2", second), ("L3", third))]
    geno = spark.createDataFrame(rows, "indiv long, pop string, locus string, a1 int, a2 int")
    n = 800
    want = {r[:3]: r[3:] for r in map(tuple, kernel.ld_p_values(geno, n, 1).collect())}
    monkeypatch.setattr(kernel, "MAX_CELLS", 1)
    got = {r[:3]: r[3:] for r in map(tuple, kernel.ld_p_values(geno, n, 1, "margins").collect())}
    assert got.keys() == want.keys() and len(got) == 9
    for k, (g, p) in got.items():
        assert g == pytest.approx(want[k][0], abs=1e-8) and abs(p - want[k][1]) < 5 * np.sqrt(2 * max(want[k][1] * (1 - want[k][1]), 1 / n) / n)
    few = {r[:3]: r[4] for r in map(tuple, kernel.ld_p_values(geno, 70, 1, "margins").collect())}
    assert few.keys() == got.keys() and all(round(p * 70) == pytest.approx(p * 70) and p >= 1 / 70 for p in few.values())
