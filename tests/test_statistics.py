"""Golden values, hand-checkable micro-fixtures, invariants."""

import math
import os
import random

import pytest
from locusflow.operators import counts, diversity, frequencies, gstat, inference, kernel, resample, wc84
from locusflow.plans.fixtures import genotypes
from locusflow.sources import ingest

SF = "/root/testdata/sf0.01"
#: FST, FIT and FIS of the fixture at sf0.01 (fixed values).
GOLDEN = {"L1": (0.05363814, 0.24513432, 0.20234985), "L2": (0.06090164, 0.24150608, 0.19231686), "L3": (0.07067944, 0.28771744, 0.23354482), "L4": (0.06456554, 0.25079819, 0.1990868), "L5": (0.07385674, 0.2914859, 0.23498434), "L6": (0.07490512, 0.25932845, 0.19935612)}
PERMUTED = (0.00145356, -0.00135301, -0.00193263, 0.00063003, -0.00033704, 0.00047233)
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def table(spark, rows):
    """Rows of (pop, locus, a1, a2); individuals are numbered."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "indiv long, pop int, locus string, a1 int, a2 int")


def one(df):
    (row,) = df.collect()
    return row


@needs_data
def test_golden_values(spark):
    got = {r.locus: r for r in wc84.observed(counts.allele_counts(genotypes(spark, SF))).collect()}
    for locus, (fst, fit, fis) in GOLDEN.items():
        assert (got[locus].fst, got[locus].fit, got[locus].fis) == pytest.approx((fst, fit, fis), abs=1e-8)


@needs_data
@pytest.mark.parametrize("digits", [0, 1])
def test_golden_permutation(spark, digits):
    moved = resample.permute_labels(genotypes(spark, SF), 1, 1, digits)
    got = {r.locus: r.fst for r in wc84.observed(counts.allele_counts(moved, ["rep"]), ["rep"]).collect()}
    assert [got[f"L{i}"] for i in range(1, 7)] == pytest.approx(PERMUTED, abs=1e-8)


@needs_data
def test_bucketed_ranks_equal_plain_ranks(spark):
    g = genotypes(spark, "/root/testdata/sf0.001")
    for within in (True, False):
        a, b = (sorted(map(tuple, resample.permute_alleles(g, 2, 3, within, d).collect())) for d in (0, 2))
        assert a == b


def brute_wc(rows):
    """a, b and c of one locus from the definitions."""
    pops = sorted({r[0] for r in rows})
    n = {p: sum(r[0] == p for r in rows) for p in pops}
    r, total = len(pops), len(rows)
    nbar, nc = total / r, (total - sum(v * v for v in n.values()) / total) / (r - 1)
    out = [0, 0, 0]
    for al in {x for row in rows for x in row[2:]}:
        freq = {p: sum((row[2] == al) + (row[3] == al) for row in rows if row[0] == p) / (2 * n[p]) for p in pops}
        pbar = sum(n[p] * freq[p] for p in pops) / total
        s2 = sum(n[p] * (freq[p] - pbar) ** 2 for p in pops) / ((r - 1) * nbar)
        h = sum(row[2] != row[3] and al in row[2:] for row in rows) / total
        core = pbar * (1 - pbar) - (r - 1) / r * s2
        out[0] += nbar / nc * (s2 - (core - h / 4) / (nbar - 1))
        out[1] += nbar / (nbar - 1) * (core - (2 * nbar - 1) / (4 * nbar) * h)
        out[2] += h / 2
    return out


def test_against_definitions_and_identity(spark):
    rng = random.Random(1)
    rows = [(p, "A", rng.choice([10, 20, 30]), rng.choice([10, 20, 20, 40 + p])) for p in range(4) for _ in range(3 + 4 * p)]
    c = counts.allele_counts(table(spark, rows))
    got = one(wc84.locus_stats(c))
    assert (got.a, got.b, got.c) == pytest.approx(brute_wc(rows))
    f = one(wc84.observed(c))
    assert 1 - f.fit == pytest.approx((1 - f.fis) * (1 - f.fst))
    assert kernel.statistics(*_codes(rows)) == pytest.approx((f.fst, f.fit, f.fis, one(gstat.g_by_locus(c)).g))
    total = c.groupBy().sum("c").first()[0]
    assert total == 2 * len(rows)


def _codes(rows):
    import numpy as np

    alleles = sorted({x for r in rows for x in r[2:]})
    at = {a: i for i, a in enumerate(alleles)}
    return np.array([r[0] for r in rows]), np.array([at[r[2]] for r in rows]), np.array([at[r[3]] for r in rows]), len(alleles), len({r[0] for r in rows})


def test_one_population(spark):
    c = counts.allele_counts(table(spark, [(1, "A", 10, 20), (1, "A", 10, 10), (1, "A", 20, 20)]))
    f = one(wc84.observed(c))
    assert f.fst is None and f.fit is None
    assert one(wc84.fis_by_locus(c)).fis is not None
    assert one(gstat.g_by_locus(c)).g is None
    assert one(diversity.hi_hs(c)).hi is None


def test_fixed_difference(spark):
    c = counts.allele_counts(table(spark, [(p, "A", 10 * p, 10 * p) for p in (1, 2) for _ in range(5)]))
    f = one(wc84.observed(c))
    assert f.fst == pytest.approx(1) and f.hs == 0
    assert one(diversity.fst_max(c)).fst_max == pytest.approx(1)


def test_monomorphic(spark):
    c = counts.allele_counts(table(spark, [(p, "A", 10, 10) for p in (1, 2) for _ in range(5)]))
    f = one(wc84.observed(c))
    assert all(f[v] is None for v in ("fst", "fit", "fis", "hi", "hs", "ht"))
    assert one(gstat.g_by_locus(c)).g == 0 and one(gstat.g_by_locus(c, min_alleles=2)).g is None
    assert one(diversity.nei(c)).hs == 0
    rows = wc84.per_allele(c).collect()
    assert len(rows) == 1 and rows[0].fst is None and rows[0].freq == 1


def test_one_individual_each(spark):
    c = counts.allele_counts(table(spark, [(p, "A", 10, 10 + p) for p in range(4)]))
    f = one(wc84.observed(c))
    assert f.fst is None and one(diversity.nei(c)).hs is None
    hh = one(diversity.hi_hs(c))
    assert hh.hi is not None and hh.hs is not None  # kept where components aren't defined


def test_partly_missing_genotypes_are_missing(spark):
    g = table(spark, [(1, "A", 10, 0), (1, "A", 0, 10), (1, "A", 0, 0), (1, "A", 10, 20)])
    assert one(counts.genotype_counts(g)).n == 1
    assert {r.allele for r in counts.allele_counts(g).collect()} == {10, 20}
    freq = {r.allele: r for r in frequencies.long_table(g).collect()}
    assert freq["10"].n_genotyped == 2 and freq["10"].n_missing == 2  # only the first allele is looked at here


def test_basic_stats_have_an_overall_row(spark):
    rng = random.Random(2)
    rows = [(p, loc, rng.choice([1, 2, 3]), rng.choice([1, 2, 3])) for loc in "AB" for p in (1, 2, 3) for _ in range(6)]
    got = {r.id: r for r in diversity.basic_stats(counts.allele_counts(table(spark, rows))).collect()}
    assert set(got) == {"A", "B", "Overall"}
    assert got["Overall"].ho == pytest.approx((got["A"].ho + got["B"].ho) / 2)
    assert all(r[c] is None or 0 <= r[c] <= 1 for r in got.values() for c in r.asDict() if c not in ("id", "ho", "hs", "ht"))


def test_p_values_and_intervals(spark):
    perm = spark.createDataFrame([(i, "x", float(i)) for i in range(1, 10)] + [(10, "x", None)], "rep long, id string, v double")
    obs = spark.createDataFrame([("x", 8.0)], "id string, v double")
    assert one(inference.p_values(perm, obs, ["id"], "v")).p_value == pytest.approx(3 / 10)
    assert one(inference.p_values(perm, obs, ["id"], "v", "less")).p_value == pytest.approx(9 / 10)
    assert one(inference.p_values(perm, obs, ["id"], "v", plus1=False)).p_value == pytest.approx(2 / 9)
    ci = one(inference.interval(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double").selectExpr("'a' id", "v"), ["id"], "v", 0.5))
    assert (ci.ci_l, ci.ci_u) == (1.75, 5.0)  # type 7
    ci = one(inference.interval(perm, ["id"], "v", 0.5, "floor"))
    assert (ci.ci_l, ci.ci_u) == (3.0, 7.0)
    assert 0 < one(inference.p_values(perm, obs, ["id"], "v", "two_sided_abs")).p_value <= 1


def test_resampling_keeps_sizes(spark):
    rng = random.Random(3)
    g = table(spark, [(p, "A", rng.choice([1, 2, 3]), rng.choice([1, 2, 3])) for p in (1, 2, 3) for _ in range(5 + p)])
    c = counts.allele_counts(g)
    size = {r["pop"]: r.n for r in counts.pop_locus(c).collect()}
    for rep in resample.bootstrap_individuals(g, 4, 1).groupBy("rep", "pop").sum("c").collect():
        assert rep["sum(c)"] == 2 * size[rep["pop"]]
    pooled = {r.allele: r.n for r in c.groupBy("allele").agg({"c": "sum"}).withColumnRenamed("sum(c)", "n").collect()}
    for moved in (resample.permute_labels(g, 3, 1), resample.permute_alleles(g, 3, 1), resample.permute_alleles(g, 3, 1, False)):
        for r in counts.allele_counts(moved, ["rep"]).groupBy("rep", "allele").sum("c").collect():
            assert r["sum(c)"] == pooled[r.allele]
    slots = resample.bootstrap_populations(c, 3, 1).select("rep", "pop").distinct().groupBy("rep").count().collect()
    assert all(r["count"] == 3 for r in slots)


def test_ld_of_an_uninformative_table(spark):
    rows = [(i, 1, loc, a, b) for i in range(8) for loc, a, b in (("A", 1, 1 + i % 2), ("B", 2, 2))]
    g = spark.createDataFrame(rows, "indiv long, pop int, locus string, a1 int, a2 int")
    assert gstat.ld_g(gstat.locus_pairs(g)).count() == 0
    rows = [(i, 1, loc, 1, 1 + i % 2) for i in range(8) for loc in "AB"]
    got = one(gstat.ld_g(gstat.locus_pairs(spark.createDataFrame(rows, "indiv long, pop int, locus string, a1 int, a2 int"))))
    assert got.g == pytest.approx(2 * 8 * math.log(2))


def test_kernel_refuses_what_is_too_large(spark):
    g = table(spark, [(1, "A", 1, 2), (2, "A", 1, 1)])
    with pytest.raises(ValueError):
        kernel.collect(g, limit=1)


def mean_squares(values):
    """Sums of a, b and c over alleles by the nested analysis of variance: between populations, individuals within them, and copies within individuals."""
    a = b = c = 0.0
    pops = sorted({p for p, _, _ in values})
    n = [sum(p == q for q, _, _ in values) for p in pops]
    total, r = sum(n), len(pops)
    nc = (total - sum(x * x for x in n) / total) / (r - 1)
    for allele in {x for _, *g in values for x in g}:
        y = [(p, [float(x == allele) for x in g]) for p, *g in values]
        grand = sum(sum(v) for _, v in y) / (2 * total)
        mean = {p: sum(sum(v) for q, v in y if q == p) / (2 * k) for p, k in zip(pops, n, strict=True)}
        ssp = sum(2 * k * (mean[p] - grand) ** 2 for p, k in zip(pops, n, strict=True))
        ssi = sum(2 * (sum(v) / 2 - mean[p]) ** 2 for p, v in y)
        ssg = sum((x - sum(v) / 2) ** 2 for _, v in y for x in v)
        msp, msi, msg = ssp / (r - 1), ssi / (total - r), ssg / total
        a, b, c = a + (msp - msi) / (2 * nc), b + (msi - msg) / 2, c + msg
    return a, b, c


def test_toy_matrix_of_packed_genotypes(spark):
    """Two populations of ten, a locus of two and one of three alleles, genotypes packed to base 100; against an analysis of variance."""
    rng = random.Random(1)
    alleles = {"L1": ([10, 20], [0.8, 0.2], [0.2, 0.8]), "L2": ([10, 20, 30], [0.6, 0.3, 0.1], [0.1, 0.3, 0.6])}
    rows = []
    for i in range(20):
        for locus, (values, *weights) in alleles.items():
            x, y = sorted(rng.choices(values, weights[i // 10], k=2))
            rows.append((i, locus, x * 100 + y, 1 + i // 10))
    geno = ingest.as_genotypes(spark.createDataFrame(rows, "indiv_id long, locus_id string, gt int, pop_code int"), base=100)
    parts = [mean_squares([(p, g // 100, g % 100) for _, locus, g, p in rows if locus == x]) for x in alleles]
    a, b, c = (sum(x[i] for x in parts) for i in range(3))
    got = one(wc84.overall(wc84.locus_stats(counts.allele_counts(geno))))
    assert (got.fst, got.fit, got.fis) == pytest.approx((a / (a + b + c), (a + b) / (a + b + c), b / (b + c)))
    assert 0.1 < got.fst < 0.6


def test_large_strata_are_cut_unasked(spark, monkeypatch):
    """The default takes digits by the size of the largest stratum, and ranks stay the same."""
    g = table(spark, [(1 + i % 2, "L", 1 + i % 3, 1 + i % 4) for i in range(60)])
    want = [sorted(map(tuple, f(g, 2, 3).collect())) for f in (resample.permute_labels, resample.permute_alleles)]
    assert resample._digits(g, ["locus"], None) == 0
    monkeypatch.setattr(resample, "RANK_ROWS", 10)
    assert resample._digits(g, ["locus"], None) == 1
    assert [sorted(map(tuple, f(g, 2, 3).collect())) for f in (resample.permute_labels, resample.permute_alleles)] == want
