"""Null alleles, geodesics, isolation by distance, Mantel family."""

import math

import numpy as np
import pytest
from locusflow.operators import geo, mantel, nulls
from pyspark.sql import functions as F


def test_geodesics():
    known = [(0, 0, 0, 1, 111319.491), (-37.951033417, 144.424867889, -37.652821139, 143.926495528, 54972.271), (90, 0, 0, 0, 10001965.729), (10, 5, 10, 5, 0), (50 + 3 / 60 + 58.76 / 3600, -5 - 42 / 60 - 53.10 / 3600, 58 + 38 / 60 + 38.48 / 3600, -3 - 4 / 60 - 12.34 / 3600, 969954.114)]
    lat1, lon1, lat2, lon2, want = map(np.array, zip(*known, strict=True))
    assert geo.geodesic(lat1, lon1, lat2, lon2) == pytest.approx(want, abs=0.002)
    assert np.isnan(geo.geodesic([np.nan], [0], [1], [1])[0])


def test_coincident_points_have_no_logarithm(spark):
    d = geo.distances(spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 5.0), (3, 11.0, 5.0)], "pop int, lat double, lon double")).collect()
    at = {(r.pop1, r.pop2): r for r in d}
    assert at[1, 2].d == 0 and at[1, 2].ln_d is None and at[1, 3].ln_d == pytest.approx(math.log(at[1, 3].d))


def em_scalar(ii, ix, n, blanks, homo):
    rd = math.sqrt(blanks / n) if homo else math.sqrt(1 / (n + 1))
    hom = sum(ii)
    p = [1 - math.sqrt(max(0, (blanks + hom - a + n - blanks - hom - b) / n if homo else (1 + hom - a + n - hom - b) / (n + 1))) for a, b in zip(ii, ix, strict=True)]
    for _ in range(5000):
        new = [(x + rd) / (x + 2 * rd) * a / n + b / (2 * n) for x, a, b in zip(p, ii, ix, strict=True)]
        r = sum(rd / (x + 2 * rd) * a / n for x, a in zip(p, ii, strict=True)) + (blanks / n if homo else 0)
        done = abs(r - rd) <= 1e-6 and all(abs(x - y) <= 1e-6 for x, y in zip(p, new, strict=True))
        p, rd = new, max(0, r)
        if done:
            break
    return rd, p


def test_em_against_one_at_a_time():
    cases = [([5, 3, 1], [4, 2, 4], 20, 6, True), ([5, 3, 1], [4, 2, 4], 14, 0, False), ([0, 0, 0], [3, 3, 0], 3, 0, False), ([9, 0, 0], [0, 0, 0], 9, 0, False)]
    ii, ix, n, blanks, homo = (np.array(x, float) for x in zip(*cases, strict=True))
    rd, p = nulls.em(ii, ix, n, blanks, homo.astype(bool))
    for k, case in enumerate(cases):
        keep = [i for i in range(3) if case[0][i] + case[1][i] > 0]
        want = em_scalar([case[0][i] for i in keep], [case[1][i] for i in keep], *case[2:])
        assert rd[k] == pytest.approx(want[0], abs=1e-12) and [p[k, i] for i in keep] == pytest.approx(want[1], abs=1e-12)


def test_blanks_and_treatments(spark):
    rows = [(i, 1, "A", 0, 0) for i in range(2)] + [(i, 1, "A", 999, 999) for i in range(2, 5)] + [(i, 1, "A", 10, 20) for i in range(5, 9)] + [(20, 2, "A", 10, 10), (21, 2, "A", 999, 10)] + [(30, 1, "B", 10, 10)]
    g = spark.createDataFrame(rows, "indiv long, pop int, locus string, a1 int, a2 int")
    homo = spark.createDataFrame([("A", "null_homo"), ("B", "absent")], "locus string, treat string")
    at = {(r.locus, r["pop"]): r for r in nulls.em_table(g, homo).collect()}
    assert len(at) == 4
    assert (at["A", 1].efpop, at["A", 1].n_absent, at["A", 1].n_null_homo) == (9, 0, 5)
    assert at["A", 2].treat == "absent" and {x.allele for x in at["A", 2].x} == {10}  # no blanks: falls back
    assert (at["B", 2].efpop, at["B", 2].rd, at["B", 2].x) == (0, 0.0, [])
    absent = {(r.locus, r["pop"]): r for r in nulls.em_table(g).collect()}
    assert (absent["A", 1].n_absent, absent["A", 1].n_null_homo) == (5, 0)
    assert {r.locus: r.treat for r in nulls.suggest_treatments(g).collect()} == {"A": "null_homo", "B": "absent"}
    parts = nulls.both(*nulls.inputs(nulls.em_table(g)), ["locus"]).collect()
    assert {r.locus: r.nc_raw for r in parts}["B"] == 0  # one population has no genotypes


def test_binomial_tail():
    for n in (1, 7, 60):
        for p in (0.0, 0.03, 0.5, 0.9, 1.0):
            for k in range(n + 1):
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert nulls.binomial_lower(np.array([k]), np.array([n]), np.array([p]))[0] == pytest.approx(want, abs=1e-12)
    assert nulls.binomial_lower(np.array([50_000]), np.array([100_000]), np.array([0.5]))[0] == pytest.approx(0.50126, abs=1e-4)


def matrix(spark, values):
    return spark.createDataFrame(values, "pop1 string, pop2 string, x double, y double, z double")


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((9, 2))
    out = []
    for i in range(9):
        for j in range(i + 1, 9):
            d = float(np.hypot(*(pts[i] - pts[j])))
            out.append((f"p{i}", f"p{j}", d, d * 2 + float(rng.normal(0, 0.1)), float(rng.random())))
    return matrix(spark, out), out


def test_mantel(pairs):
    df, rows = pairs
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    got = mantel.mantel(df, "x", "y", 99, 1).collect()[0]
    assert got.stat == pytest.approx(np.corrcoef(x, y)[0, 1]) and got.p_pos == pytest.approx(0.01) and got.p_neg == 1.0
    assert mantel.mantel(df, "x", "y", 99, 1, plus1=False).collect()[0].p_pos == 0
    assert mantel.mantel(df.withColumn("x", F.col("x") * 3 + 1), "x", "y", 99, 1).collect()[0].p_pos == got.p_pos
    assert mantel.mantel(df, "x", "y", 9, 1, "b").collect()[0].stat == pytest.approx(np.polyfit(x, y, 1)[0])
    rank = lambda v: np.argsort(np.argsort(v))
    assert mantel.mantel(df, "x", "y", 9, 1, "spearman").collect()[0].stat == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_incomplete_matrices(pairs):
    df, rows = pairs
    holes = df.withColumn("y", F.when((F.col("pop1") == "p0") & (F.col("pop2") == "p1"), F.lit(float("nan"))).otherwise(F.col("y")))
    got = mantel.mantel(holes, "x", "y", 19, 1).collect()[0]
    assert got.n_pairs == len(rows) - 1 and got.n_perm == 19
    assert mantel.mantel(df.limit(2), "x", "y", 5, 1).collect()[0].stat is None


def test_partial_mantel_and_mrm(pairs):
    df, rows = pairs
    x, y, z = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    got = mantel.partial_mantel(df, "x", "y", "z", 19, 1).collect()[0]
    c = np.corrcoef([x, y, z])
    assert got.stat == pytest.approx((c[0, 1] - c[0, 2] * c[1, 2]) / math.sqrt((1 - c[0, 2] ** 2) * (1 - c[1, 2] ** 2)))
    fit = {r.term: r for r in mantel.mrm(df, "y", ["x", "z"], 19, 1).collect()}
    coef, res, *_ = np.linalg.lstsq(np.column_stack([np.ones_like(x), x, z]), y, rcond=None)
    assert [fit["x"].value, fit["z"].value] == pytest.approx(coef[1:])
    assert fit["R2"].value == pytest.approx(1 - res[0] / ((y - y.mean()) ** 2).sum())
    with pytest.raises(ValueError, match="collinear"):
        mantel.mrm(df.withColumn("w", F.col("x") * 2), "y", ["x", "w"], 5, 1)
    with pytest.raises(ValueError, match="complete pairs"):
        mantel.mrm(df.limit(4), "y", ["x", "z"], 5, 1)
    assert {(r.a, r.b): r.r for r in mantel.correlations(df, ["x", "y"]).collect()}["x", "y"] == pytest.approx(c[0, 1])


@pytest.mark.parametrize("bounds", [{"MAX_MOVES": 0}, {"TILE": 4}, {"TILE": 100}])
def test_matrices_tiles_and_joins_permute_alike(pairs, bounds, monkeypatch):
    """Null distributions from matrices equal those of tiles and of renamed rows, with holes and a missing pair too."""
    df, _ = pairs
    holes = df.withColumn("y", F.when((F.col("pop1") == "p0") & (F.col("pop2") == "p1"), F.lit(None)).otherwise(F.col("y") + 100)).filter("pop1 <> 'p2' OR pop2 <> 'p5'")
    holes = holes.withColumn("x", F.when(F.col("pop1") == "p6", F.lit(float("nan"))).otherwise(F.col("x")))

    def all_tests(x):
        out = [mantel.mantel(x, "x", "y", 30, 7, k).collect()[0] for k in ("r", "b", "cross", "spearman")]
        out.append(mantel.partial_mantel(x, "x", "y", "z", 30, 7).collect()[0])
        return [*out, *mantel.mrm(x, "y", ["x", "z"], 30, 7).orderBy("term").collect()], mantel.null_distribution(x, 30, 7).orderBy("rep").collect()

    fast, null = all_tests(holes)
    monkeypatch.setattr(mantel, "MAX_PAIRS", 0)
    for name, value in bounds.items():
        monkeypatch.setattr(mantel, name, value)
    slow, other = all_tests(holes)
    assert [tuple(r) for r in fast] == [pytest.approx(tuple(r)) if not isinstance(r[0], str) else (r[0], *[pytest.approx(v) for v in r[1:]]) for r in slow]
    assert [r.s for r in null] == pytest.approx([r.s for r in other]) and len(null) == 30


def test_external_and_excluded_pairs(spark):
    t = spark.createDataFrame([("A", "B", 0.1), ("A", "C", 0.2), ("B", "C", 0.3)], "pop1 string, pop2 string, fst double")
    ext = spark.createDataFrame([("C", "A", "12.5"), ("A", " C", "99"), ("B", "C", "x")], "Pop1 string, Pop2 string, Distance string")
    got = {(r.pop1, r.pop2): r.d for r in geo.external_distances(t, ext).collect()}
    assert got == {("A", "C"): 12.5, ("B", "C"): None}
    ordered = ext.withColumn("row", F.when(F.col("Distance") == "99", 0).otherwise(1))
    assert {(r.pop1, r.pop2): r.d for r in geo.external_distances(t, ordered, order="row").collect()} == {("A", "C"): 99.0, ("B", "C"): None}
    assert {r.pop2 for r in geo.exclude_pairs(t, "C-B, A - B, nonsense").collect()} == {"C"}
    assert geo.exclude_pairs(t, "").count() == 3


def test_lines(spark):
    t = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(4)], "x double, y double")
    r = geo.regression_summary(t, "x", {"Average": "y"}).collect()[0]
    assert (r.slope, r.intercept, r.r2, r.nb) == pytest.approx((2, 1, 1, 0.5)) and r.nem == pytest.approx(0.5 / (2 * math.pi))
    assert geo.fit_line(t.limit(2), "y", "x").collect()[0].slope is None
