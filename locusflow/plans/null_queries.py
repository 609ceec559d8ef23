"""Registered queries: null alleles, distances, isolation by distance, Mantel family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import r8
from ..operators import counts, geo, inference, mantel, nulls
from . import oracle
from .base_queries import rounded
from .fixtures import coordinates, genotypes

B, SEED, ALPHA = 20, 12345, 0.05
HOMO = ("L1", "L2", "L3")


def _geno(s, d):
    return genotypes(s, d, nulls=True)


def _treat(g):
    return g.select("locus").distinct().withColumn("treat", F.when(F.col("locus").isin(*HOMO), "null_homo").otherwise("absent"))


def _table(s, d):
    g = _geno(s, d)
    return nulls.em_table(g, _treat(g))


def _inputs(s, d):
    return nulls.inputs(_table(s, d))


def null_em(s, d):
    x = nulls.em_long(_table(s, d)).select("locus", "pop", "allele", "rd", "p", "freq")
    return x.select("locus", "pop", "allele", *[F.round(c, 6).alias(c) for c in ("rd", "p", "freq")])


def null_treatments(s, d):
    return nulls.suggest_treatments(_geno(s, d))


def null_t1(s, d):
    return nulls.t1(_table(s, d), _treat(_geno(s, d)))


def null_t2(s, d):
    return nulls.t2(_table(s, d), _treat(_geno(s, d)))


def fst_global_ena(s, d):
    return nulls.fst_pooled(nulls.both(*_inputs(s, d), ["locus"]), []).select(*[F.round(c, 6).alias(c) for c in ("fst_raw", "fst_ena")])


def fst_locus_ena(s, d):
    return nulls.fst_by_locus(nulls.both(*_inputs(s, d), ["locus"]))


def fst_pair(s, d):
    return nulls.fst_pooled(nulls.pairwise_components(*_inputs(s, d)), ["pop1", "pop2"]).select("pop1", "pop2", *[F.round(c, 6).alias(c) for c in ("fst_raw", "fst_ena")])


def fst_locus_pair(s, d):
    return nulls.fst_locus_pair(nulls.pairwise_components(*_inputs(s, d)))


def dcse_pair(s, d):
    return nulls.chord_pooled(nulls.pairwise_chord(*_inputs(s, d))).select("pop1", "pop2", *[F.round(c, 6).alias(c) for c in ("dcse_raw", "dcse_ina")])


def dcse_locus_pair(s, d):
    return nulls.pairwise_chord(*_inputs(s, d)).select("locus", "pop1", "pop2", *[F.round(c, 6).alias(c) for c in ("dcse_raw", "dcse_ina")])


def _ci(boot, by, names):
    parts = [inference.interval(boot, by, v, 1 - ALPHA).select(*by, F.col("ci_l").alias(f"{v}_lo"), F.col("boot_median").alias(f"{v}_median"), F.col("ci_u").alias(f"{v}_hi")) for v in names]
    out = reduce(lambda a, b: a.join(b, by) if by else a.crossJoin(b), parts)
    return out.select(*by, *[F.round(c, 6).alias(c) for c in out.columns if c not in by])


def boot_loci_ena(s, d, n=B):
    """Intervals of the global FST over drawn loci."""
    return _ci(nulls.bootstrap_loci_fst(nulls.both(*_inputs(s, d), ["locus"]), n, SEED), [], ("fst_raw", "fst_ena"))


def boot_loci_pair(s, d, n=B):
    return _ci(nulls.bootstrap_loci_fst(nulls.pairwise_components(*_inputs(s, d)), n, SEED, ("pop1", "pop2")), ["pop1", "pop2"], ("fst_raw", "fst_ena"))


def boot_loci_dcse(s, d, n=B):
    return _ci(nulls.bootstrap_loci_chord(nulls.pairwise_chord(*_inputs(s, d)), n, SEED), ["pop1", "pop2"], ("dcse_raw", "dcse_ina"))


def boot_loci_shared(s, d, n=B):
    """Intervals of all statistics from one draw of loci a replicate."""
    x = nulls.shared_intervals(nulls.both(*_inputs(s, d), ["locus"]), nulls.pairwise_components(*_inputs(s, d)), nulls.pairwise_chord(*_inputs(s, d)), n, SEED, 1 - ALPHA)
    return x.select("statistic", "pop1", "pop2", F.round("ci_l", 6).alias("ci_l"), F.round("ci_u", 6).alias("ci_u"))


def boot_subs_ena(s, d):
    """FST by replicate over drawn populations."""
    return nulls.fst_pooled(nulls.bootstrap_subsamples(*_inputs(s, d), B, SEED), ["rep"]).select("rep", *[F.round(c, 6).alias(c) for c in ("fst_raw", "fst_ena")])


# -- geography -----------------------------------------------------------------------


def _points(s, d):
    return coordinates(genotypes(s, d))


def _meta(s, d):
    g = genotypes(s, d).select("indiv", "pop").distinct()
    return g.join(_points(s, d), "pop").select("indiv", "pop", F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"))


def centroids(s, d):
    return rounded(geo.centroids(_meta(s, d)), "lat", "lon")


def map_points(s, d):
    return geo.map_points(_meta(s, d)).select("pop", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "n")


def vincenty(s, d):
    return geo.distances(_points(s, d)).select("pop1", "pop2", F.round("d", 3).alias("d"), F.round("ln_d", 6).alias("ln_d"))


def _ibd(s, d):
    """FST of valid genotypes (no null alleles) against planar distances, which SQL can follow."""
    g = genotypes(s, d)
    table = nulls.em_table(g)
    parts = nulls.inputs(table)
    fst = nulls.fst_pooled(nulls.pairwise_components(*parts), ["pop1", "pop2"]).select("pop1", "pop2", "fst_raw")
    chords = nulls.chord_pooled(nulls.pairwise_chord(*parts)).select("pop1", "pop2", "dcse_raw")
    return geo.ibd_table(fst, chords, geo.distances(_points(s, d), planar=True))


def ibd_table(s, d):
    return rounded(_ibd(s, d), "fst_raw", "dcse_raw", "d", "ln_d", "fr_raw")


def ibd_regression(s, d):
    x = _ibd(s, d)
    two = geo.regression_summary(x, "ln_d", {"2D": "fr_raw", "2D chord": "dcse_raw"}).unionByName(geo.regression_summary(x, "d", {"1D": "fr_raw"}))
    return rounded(two, "slope", "intercept", "r2", "nb", "nem")


def ibd_external(s, d):
    """Only the pairs of an external table, named in any order, count."""
    x = _ibd(s, d).select("pop1", "pop2", "fst_raw", "d", "ln_d")
    ext = x.filter((F.col("pop1") + F.col("pop2")) % 3 == 0).select(F.col("pop2").alias("Pop1"), F.col("pop1").alias("Pop2"), (F.col("pop1") * 10 + F.col("pop2")).cast("string").alias("Distance"))
    return rounded(geo.external_distances(x, ext), "fst_raw", "d", "ln_d")


def pair_exclusion(s, d):
    return rounded(geo.exclude_pairs(_ibd(s, d).select("pop1", "pop2", "fst_raw"), "3-1, 2-4, 0 - 24"), "fst_raw")


MANTEL = ("stat", "p_pos", "p_neg", "p_two", "slope", "intercept", "r2")


def _mantel(kind, plus1=True):
    return lambda s, d, n=B: rounded(mantel.mantel(_ibd(s, d), "d", "fr_raw", n, SEED, kind, plus1), *MANTEL)


def partial_mantel(s, d, n=B):
    return rounded(mantel.partial_mantel(_ibd(s, d), "d", "fr_raw", "dcse_raw", n, SEED), "stat", "rxy", "rxz", "ryz", "p_pos", "p_neg", "p_two")


def _mrm(std):
    return lambda s, d, n=B: rounded(mantel.mrm(_ibd(s, d), "fr_raw", ["d", "dcse_raw"], n, SEED, std), "value", "p_pos", "p_neg")


def mrm_correlations(s, d):
    return rounded(mantel.correlations(_ibd(s, d), ["fr_raw", "d", "dcse_raw"]), "r")


def mantel_null_quantiles(s, d, n=B):
    x = _ibd(s, d).select("pop1", "pop2", F.col("d").alias("x"), F.col("fr_raw").alias("y"))
    obs = mantel.complete(x, "x", "y").agg(F.corr("x", "y").alias("o"))
    return rounded(inference.null_quantiles(mantel.null_distribution(x, n, SEED).crossJoin(obs), "s", F.col("o")), "value")


_SPARK = {f.__name__: f for f in (null_em, null_treatments, null_t1, null_t2, fst_global_ena, fst_locus_ena, fst_pair, fst_locus_pair, dcse_pair, dcse_locus_pair, boot_loci_ena, boot_loci_pair, boot_loci_dcse, boot_loci_shared, boot_subs_ena, centroids, map_points, vincenty, ibd_table, ibd_regression, ibd_external, pair_exclusion, partial_mantel, mrm_correlations, mantel_null_quantiles)}
_SPARK |= {"mantel_plus1": _mantel("r"), "mantel_plain": _mantel("r", False), "mantel_cross": _mantel("cross"), "mantel_slope": _mantel("b"), "mantel_spearman": _mantel("spearman"), "mrm": _mrm(False), "mrm_standardized": _mrm(True)}

# -- SQL ---------------------------------------------------------------------------------


def em_sql(src: str) -> str:
    """CTEs tb (locus x population sizes, rd) and al (allele rows), by recursion."""
    return f"""
cl AS (SELECT *, a1 <= 0 OR (a1 = 999 AND a2 = 999) AS blank FROM {src}),
tr AS (SELECT DISTINCT locus, CASE WHEN locus IN {HOMO} AND '{src}' = 'gnull' THEN 'null_homo' ELSE 'absent' END AS treat FROM geno),
sz0 AS (SELECT locus, pop, count(*) AS efpop, count(*) FILTER (WHERE blank) AS nb FROM cl GROUP BY ALL),
tb0 AS (SELECT l.locus, p.pop, l.treat, coalesce(efpop, 0) AS efpop, coalesce(nb, 0) AS nb, l.treat = 'null_homo' AND coalesce(nb, 0) > 0 AS homo FROM tr l CROSS JOIN (SELECT DISTINCT pop FROM geno) p LEFT JOIN sz0 USING (locus, pop)),
ac AS (SELECT locus, pop, allele, sum(ii)::DOUBLE AS ii, sum(ix)::DOUBLE AS ix FROM (SELECT locus, pop, a1 AS allele, 1 AS ii, 0 AS ix FROM cl WHERE NOT blank AND a1 = a2 UNION ALL SELECT locus, pop, unnest([a1, a2]), 0, 1 FROM cl WHERE NOT blank AND a1 <> a2) GROUP BY ALL),
ar AS (SELECT locus, pop, list(allele ORDER BY allele) AS als, list(ii ORDER BY allele) AS ii, list(ix ORDER BY allele) AS ix, sum(ii) AS hom FROM ac GROUP BY ALL),
st AS (SELECT locus, pop, als, ii, ix, hom, homo, (efpop - CASE WHEN homo THEN 0 ELSE nb END)::DOUBLE AS n, CASE WHEN homo THEN nb ELSE 0 END::DOUBLE AS nul FROM ar JOIN tb0 USING (locus, pop)),
em AS (SELECT locus, pop, als, ii, ix, homo, n, nul, 0 AS it, false AS done, CASE WHEN homo THEN sqrt(nul / n) ELSE sqrt(1 / (n + 1)) END AS rd,
    list_transform(range(1, len(ii) + 1), lambda i: 1 - sqrt(greatest(0, CASE WHEN homo THEN (nul + hom - ii[i] + (n - nul - hom) - ix[i]) / n ELSE (1 + hom - ii[i] + (n - hom) - ix[i]) / (n + 1) END))) AS p FROM st
  UNION ALL SELECT locus, pop, als, ii, ix, homo, n, nul, it + 1, abs(rn - rd) <= 1e-6 AND list_max(list_transform(range(1, len(p) + 1), lambda i: abs(np[i] - p[i]))) <= 1e-6, greatest(0, rn), np
  FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda i: (p[i] + rd) / (p[i] + 2 * rd) * (ii[i] / n) + ix[i] / (2 * n)) AS np, list_sum(list_transform(range(1, len(p) + 1), lambda i: rd / (p[i] + 2 * rd) * (ii[i] / n))) + CASE WHEN homo THEN nul / n ELSE 0 END AS rn FROM em WHERE NOT done AND it < 5000)),
fin AS (SELECT * FROM em WHERE done),
tb AS (SELECT t.*, coalesce(rd, 0.0) AS rd, greatest(efpop - nb, 0)::DOUBLE AS ni_raw, (efpop - CASE WHEN t.homo THEN 0 ELSE nb END)::DOUBLE AS ni_ena FROM tb0 t LEFT JOIN fin USING (locus, pop)),
al0 AS (SELECT locus, pop, rd, unnest(als) AS allele, unnest(ii) AS ii, unnest(ix) AS ix, unnest(p) AS p FROM fin),
al AS (SELECT a.*, t.ni_raw, t.ni_ena, (2 * ii + ix) / (2 * t.ni_raw) AS freq, (2 * ii + ix) AS na_raw, ii AS aa_raw, p * 2 * t.ni_ena AS na_ena, CASE WHEN ii > 0 AND p + 2 * a.rd > 0 THEN ii * p / (p + 2 * a.rd) ELSE 0 END AS aa_ena FROM al0 a JOIN tb t USING (locus, pop))"""


def wc_sql(by: str, tb: str = "tb", al: str = "al", effective: bool = False) -> str:
    """CTE wc: s1, s3, nc of raw and ena by the columns given."""
    r = "r_eff" if effective else "r_all"
    out = []
    for k in ("raw", "ena"):
        out.append(f"""
z_{k} AS (SELECT {by}, sum(ni_{k}) AS n, sum(ni_{k} ** 2) AS n2, count(*)::DOUBLE AS r_all, (count(*) FILTER (WHERE ni_{k} > 0))::DOUBLE AS r_eff FROM {tb} GROUP BY ALL),
y_{k} AS (SELECT {by}, allele, sum(na_{k}) AS sna, sum(CASE WHEN ni_{k} > 0 THEN na_{k} ** 2 / (2 * ni_{k}) ELSE 0 END) AS s2a, sum(aa_{k}) AS saa FROM {al} GROUP BY ALL),
x_{k} AS (SELECT *, (n - n2 / n) / ({r} - 1) AS nco, (0.5 * sna - saa) / n AS msg, (0.5 * sna + saa - s2a) / (n - {r}) AS msi, (s2a - 0.5 * sna ** 2 / n) / ({r} - 1) AS msp FROM y_{k} JOIN z_{k} USING ({by}) WHERE n > 0 AND {r} >= 2 AND n - {r} > 0 AND n - n2 / n > 0),
w_{k} AS (SELECT {by}, sum((msp - msi) / (2 * nco)) AS s1, sum((msp - msi) / (2 * nco) + 0.5 * (msi - msg) + msg) AS s3 FROM x_{k} GROUP BY ALL),
wc_{k} AS (SELECT z.*, coalesce(s1, 0) AS s1_{k}, coalesce(s3, 0) AS s3_{k}, CASE WHEN n > 0 AND r_eff > 1 THEN (n - n2 / n) / (r_eff - 1) ELSE 0 END AS nc_{k}, r_eff AS r_{k} FROM z_{k} z LEFT JOIN w_{k} USING ({by}))""")
    return ",".join(out) + f",\nwc AS (SELECT {by}, s1_raw, s3_raw, nc_raw, r_raw, s1_ena, s3_ena, nc_ena, r_ena FROM wc_raw JOIN wc_ena USING ({by}))"


GNULL = "gnull AS (SELECT indiv, pop, locus, CASE WHEN coded THEN 999 ELSE a1 END AS a1, CASE WHEN coded THEN 999 ELSE a2 END AS a2 FROM geno)"
PAIR = """pp AS (SELECT a.pop AS pop1, b.pop AS pop2, unnest([a.pop, b.pop]) AS pop FROM (SELECT DISTINCT pop FROM geno) a JOIN (SELECT DISTINCT pop FROM geno) b ON a.pop < b.pop),
ptb AS (SELECT * FROM pp JOIN tb USING (pop)), pal AS (SELECT * FROM pp JOIN al USING (pop))"""
CHORD = """
ck AS (SELECT i.pop1, i.pop2, i.locus, i.allele, sqrt(i.freq * j.freq) AS raw, sqrt(greatest(i.p, 0) * greatest(j.p, 0)) AS ina FROM pal i JOIN pal j ON i.pop1 = j.pop1 AND i.pop2 = j.pop2 AND i.locus = j.locus AND i.allele = j.allele AND i.pop = i.pop1 AND j.pop = j.pop2),
cs AS (SELECT pop1, pop2, locus, sum(raw) AS raw, sum(ina) AS ina FROM ck GROUP BY ALL),
ch AS (SELECT a.pop1, a.pop2, a.locus, CASE WHEN a.ni_raw > 0 AND b.ni_raw > 0 AND coalesce(raw, 0) <= 1 THEN 2 / pi() * sqrt(2 * (1 - coalesce(raw, 0))) END AS dcse_raw,
  CASE WHEN a.ni_ena > 0 AND b.ni_ena > 0 AND coalesce(ina, 0) + sqrt(a.rd * b.rd) <= 1 THEN 2 / pi() * sqrt(2 * (1 - coalesce(ina, 0) - sqrt(a.rd * b.rd))) END AS dcse_ina
  FROM ptb a JOIN ptb b ON a.pop1 = b.pop1 AND a.pop2 = b.pop2 AND a.locus = b.locus AND a.pop = a.pop1 AND b.pop = b.pop2 LEFT JOIN cs ON cs.pop1 = a.pop1 AND cs.pop2 = a.pop2 AND cs.locus = a.locus)"""
POOL = lambda src, by="": "SELECT " + by + ", ".join(f"CASE WHEN sum(s3_{k} * nc_{k}) > 0 THEN sum(s1_{k} * nc_{k}) / sum(s3_{k} * nc_{k}) END AS fst_{k}" for k in ("raw", "ena")) + f" FROM {src}" + (f" GROUP BY {by.rstrip(', ')}" if by else "")
R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


def q(*parts: str) -> str:
    return oracle.query(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _draw(src: str, column: str) -> str:
    """CTE sl: rep, slot and the drawn value."""
    return f"""
dn AS (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS i FROM (SELECT DISTINCT {column} FROM {src})), dk AS (SELECT count(*) AS k FROM dn),
sl AS (SELECT rep, slot, dn.{column} FROM (SELECT rep, i + 1 AS slot, U('{SEED}', rep, i + 1) % k AS j FROM dn, dk, range(1, {B + 1}) t(rep)) JOIN dn ON j = dn.i)"""


CI6 = lambda *names: ", ".join(f"round(quantile_cont({n}::DOUBLE, {p}), 6) AS {n}_{t}" for n in names for p, t in ((0.025, "lo"), (0.5, "median"), (0.975, "hi")))
E_ = (GNULL, em_sql("gnull"))
P_ = (*E_, PAIR)
BINOM = "(SELECT sum(exp(lgamma(n_tot + 1) - lgamma(k + 1) - lgamma(n_tot - k + 1) + k * ln(pr) + (n_tot - k) * ln(1 - pr))) FROM range(n_blanks + 1) t(k))"
POINTS = "pt AS (SELECT DISTINCT pop, 10 + (pop * 37 % 97) * 0.1::DOUBLE AS lat, 5 + (pop * 53 % 89) * 0.1::DOUBLE AS lon FROM geno)"
IBD = (em_sql("geno"), PAIR, wc_sql("pop1, pop2, locus", "ptb", "pal"), CHORD, POINTS, f"""
fp AS ({POOL("wc", "pop1, pop2, ")}), dd AS (SELECT a.pop AS pop1, b.pop AS pop2, sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS d FROM pt a JOIN pt b ON a.pop < b.pop),
ib AS (SELECT pop1, pop2, fst_raw, dcse_raw, d, CASE WHEN d > 0 THEN ln(d) END AS ln_d, CASE WHEN fst_raw IS NOT NULL THEN greatest(0, least(0.9999, fst_raw)) / (1 - greatest(0, least(0.9999, fst_raw))) END AS fr_raw
  FROM fp JOIN (SELECT pop1, pop2, avg(dcse_raw) AS dcse_raw FROM ch GROUP BY ALL) USING (pop1, pop2) LEFT JOIN dd USING (pop1, pop2))""")  # fmt: skip
PERM = f"""
lb AS (SELECT DISTINCT unnest([pop1, pop2]) AS l FROM mt), lr AS (SELECT l, row_number() OVER (ORDER BY l) AS r FROM lb),
rn AS (SELECT rep, l AS t, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '{SEED}', rep, l)), l) AS r FROM lb, range(1, {B + 1}) t(rep)),
mp AS (SELECT rep, l, t FROM rn JOIN lr USING (r)),
pm AS (SELECT a.rep, m.*, s.x AS px, s.y AS py FROM mt m JOIN mp a ON m.pop1 = a.l JOIN mp b ON b.rep = a.rep AND m.pop2 = b.l LEFT JOIN mt s ON s.pop1 = least(a.t, b.t) AND s.pop2 = greatest(a.t, b.t))"""


def _mantel_sql(stat, x="d", y="fr_raw", eps="1.4901161193847656e-08", plus1=1, source="SELECT pop1, pop2, d AS x, fr_raw AS y FROM ib WHERE d IS NOT NULL AND fr_raw IS NOT NULL", perm=None):
    perm = perm or stat.replace("y", "py")
    return q(*IBD, f"mt AS ({source})", PERM, f"ob AS (SELECT {stat} AS o, count(*) AS n_pairs FROM mt), nl AS (SELECT rep, {perm} AS s FROM pm WHERE py IS NOT NULL GROUP BY rep), li AS (SELECT regr_slope(fr_raw, d) AS slope, regr_intercept(fr_raw, d) AS intercept, regr_r2(fr_raw, d) AS r2 FROM ib), pv AS (SELECT (count(*) FILTER (WHERE s >= o - {eps}) + {plus1}) / (count(s) + {plus1}) AS p, (count(*) FILTER (WHERE s <= o + {eps}) + {plus1}) / (count(s) + {plus1}) AS n, count(s) AS n_perm FROM nl, ob)",
             "SELECT R(o) AS stat, n_pairs, R(p) AS p_pos, R(n) AS p_neg, n_perm, R(least(1.0, 2 * least(p, n))) AS p_two, R(slope) AS slope, R(intercept) AS intercept, R(r2) AS r2 FROM ob, pv, li")


RANKS = "SELECT pop1, pop2, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS x, rank() OVER (ORDER BY fr_raw) + (count(*) OVER (PARTITION BY fr_raw) - 1) / 2.0 AS y FROM ib"


def _mrm_sql(std: bool) -> str:
    mom = lambda y, x, z: f"count(*) AS n, var_samp({y}) AS vy, var_samp({x}) AS vx, var_samp({z}) AS vz, covar_samp({x}, {y}) AS xy, covar_samp({z}, {y}) AS zy, covar_samp({x}, {z}) AS xz"
    sol = "(xy * vz - zy * xz) / (vx * vz - xz * xz) AS b1, (zy * vx - xy * xz) / (vx * vz - xz * xz) AS b2"
    scale = "b1 * sqrt(vx / vy) AS d, b2 * sqrt(vz / vy) AS dcse_raw" if std else "b1 AS d, b2 AS dcse_raw"
    pick = lambda c: f"SELECT '{c}' AS term, R(o.\"{c}\") AS value, any_value(o.n) AS n_pairs, R((count(*) FILTER (WHERE m.\"{c}\" >= o.\"{c}\" - 1e-9) + 1) / (count(*) + 1)) AS p_pos, R((count(*) FILTER (WHERE m.\"{c}\" <= o.\"{c}\" + 1e-9) + 1) / (count(*) + 1)) AS p_neg FROM ms m, os o GROUP BY o.\"{c}\""
    return q(*IBD, "mt AS (SELECT pop1, pop2, d AS x, fr_raw AS y, dcse_raw AS z FROM ib)", PERM, f'o1 AS (SELECT {mom("y", "x", "z")} FROM mt), o2 AS (SELECT *, {sol} FROM o1), os AS (SELECT n, {scale}, (b1 * xy + b2 * zy) / vy AS "R2" FROM o2), m1 AS (SELECT rep, {mom("py", "x", "z")} FROM pm GROUP BY rep), m2 AS (SELECT *, {sol} FROM m1), ms AS (SELECT rep, {scale}, (b1 * xy + b2 * zy) / vy AS "R2" FROM m2)', " UNION ALL ".join(map(pick, ("d", "dcse_raw", "R2"))))


#: Vincenty's inverse formula, a recursion on the longitude difference on the sphere.
_V = """sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs"""
_VA = f"SELECT *, 1 - sa * sa AS c2, CASE WHEN 1 - sa * sa <> 0 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS cm, atan2(ss, cs) AS sg FROM (SELECT *, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM (SELECT *, {_V} FROM vi))"
_VINCENTY = f"""
vp AS (SELECT a.pop AS pop1, b.pop AS pop2, atan((1 - {geo.FLATTENING!r}) * tan(radians(a.lat))) AS u1, atan((1 - {geo.FLATTENING!r}) * tan(radians(b.lat))) AS u2, radians(b.lon - a.lon) AS l, {geo.FLATTENING!r}::DOUBLE AS f FROM pt a JOIN pt b ON a.pop < b.pop),
vi AS (SELECT *, l AS lam, 0 AS it, false AS done FROM vp UNION ALL SELECT pop1, pop2, u1, u2, l, f, new, it + 1, abs(new - lam) < 1e-12 FROM (SELECT *, l + (1 - w) * f * sa * (sg + w * ss * (cm + w * cs * (2 * cm * cm - 1))) AS new FROM (SELECT *, f / 16 * c2 * (4 + f * (4 - 3 * c2)) AS w FROM ({_VA}))) WHERE NOT done AND it < 200),
vf AS (SELECT *, 1 + h / 16384 * (4096 + h * (h * (320 - 175 * h) - 768)) AS ka, h / 1024 * (256 + h * (h * (74 - 47 * h) - 128)) AS kb FROM (SELECT *, c2 * (1 / (1 - f) ** 2 - 1) AS h FROM ({_VA}) WHERE done)),
vd AS (SELECT pop1, pop2, {geo.AXIS!r} * (1 - f) * ka * (sg - kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS d FROM vf)"""
_LINE = lambda name, y, x: f"SELECT '{name}' AS line, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2, regr_count({y}, {x})::BIGINT AS n FROM ib"
_PART = "(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))"
_ORACLE = {
    "null_em": q(*E_, f"SELECT locus, pop, allele, {R6('rd', 'p', 'freq')} FROM al"),
    "null_treatments": q(GNULL, "SELECT locus, CASE WHEN bool_or(a1 = 999 AND a2 = 999) THEN 'null_homo' ELSE 'absent' END AS treat FROM gnull GROUP BY locus"),
    "null_t1": q(*E_, "SELECT locus, pop AS subsample, CASE WHEN treat = 'null_homo' THEN '999' ELSE '0' END AS miss, round(rd, 6) AS p_nulls, efpop AS n, nb AS n_blanks, round(efpop * rd * rd, 6) AS n_exp_blanks FROM tb"),
    "null_t2": q(*E_, "tt AS (SELECT locus, any_value(treat) AS treat, sum(efpop)::BIGINT AS n_tot, sum(nb)::BIGINT AS n_blanks, sum(efpop * rd * rd) AS av, sum(efpop * rd) / sum(efpop) AS ap, sum(efpop * rd * rd) / sum(efpop) AS pr FROM tb GROUP BY locus)", f"SELECT locus, CASE WHEN treat = 'null_homo' THEN '999' ELSE '0' END AS miss, round(av, 6) AS av_n_exp_blanks, round(ap, 6) AS av_p_nulls, n_tot, n_blanks, round(pr, 6) AS f_exp_blanks, round({BINOM}, 3) AS p_value FROM tt"),
    "fst_global_ena": q(*E_, wc_sql("locus"), f"SELECT {R6('fst_raw', 'fst_ena')} FROM ({POOL('wc')})"),
    "fst_locus_ena": q(*E_, wc_sql("locus"), "SELECT locus, round(CASE WHEN s3_raw <> 0 THEN s1_raw / s3_raw END, 6) AS fst_raw, round(CASE WHEN s3_ena <> 0 THEN s1_ena / s3_ena END, 6) AS fst_ena, r_raw::BIGINT AS n_pops_raw, r_ena::BIGINT AS n_pops_ena FROM wc"),
    "fst_pair": q(*P_, wc_sql("pop1, pop2, locus", "ptb", "pal"), f"SELECT pop1, pop2, {R6('fst_raw', 'fst_ena')} FROM ({POOL('wc', 'pop1, pop2, ')})"),
    "fst_locus_pair": q(*P_, wc_sql("pop1, pop2, locus", "ptb", "pal"), "SELECT locus, pop1, pop2, round(CASE WHEN nc_raw > 0 AND s3_raw <> 0 THEN s1_raw / s3_raw END, 6) AS fst_raw, round(CASE WHEN nc_ena > 0 AND s3_ena <> 0 THEN s1_ena / s3_ena END, 6) AS fst_ena FROM wc"),
    "dcse_pair": q(*P_, CHORD, "SELECT pop1, pop2, round(avg(dcse_raw), 6) AS dcse_raw, round(avg(dcse_ina), 6) AS dcse_ina FROM ch GROUP BY ALL"),
    "dcse_locus_pair": q(*P_, CHORD, f"SELECT locus, pop1, pop2, {R6('dcse_raw', 'dcse_ina')} FROM ch"),
    "boot_loci_ena": q(*E_, wc_sql("locus"), _draw("wc", "locus"), f"bt AS ({POOL('sl JOIN wc USING (locus)', 'rep, ')})", f"SELECT {CI6('fst_raw', 'fst_ena')} FROM bt"),
    "boot_loci_pair": q(*P_, wc_sql("pop1, pop2, locus", "ptb", "pal"), _draw("wc", "locus"), f"bt AS ({POOL('sl JOIN wc USING (locus)', 'rep, pop1, pop2, ')})", f"SELECT pop1, pop2, {CI6('fst_raw', 'fst_ena')} FROM bt GROUP BY pop1, pop2"),
    "boot_loci_dcse": q(*P_, CHORD, _draw("ch", "locus"), "bt AS (SELECT rep, pop1, pop2, avg(dcse_raw) AS dcse_raw, avg(dcse_ina) AS dcse_ina FROM sl JOIN ch USING (locus) GROUP BY ALL)", f"SELECT pop1, pop2, {CI6('dcse_raw', 'dcse_ina')} FROM bt GROUP BY pop1, pop2"),
    "boot_subs_ena": q(*E_, _draw("tb", "pop"), "btb AS (SELECT rep, slot, tb.* FROM sl JOIN tb USING (pop)), bal AS (SELECT rep, slot, al.* FROM sl JOIN al USING (pop))", wc_sql("rep, locus", "btb", "bal", True), f"SELECT rep, {R6('fst_raw', 'fst_ena')} FROM ({POOL('wc', 'rep, ')})"),
    "centroids": q(POINTS, "SELECT pop, R(avg(lat)) AS lat, R(avg(lon)) AS lon FROM pt GROUP BY pop"),
    "map_points": q(POINTS, "SELECT pop, any_value(lat) AS lat, any_value(lon) AS lon, count(DISTINCT indiv) AS n FROM geno JOIN pt USING (pop) GROUP BY pop"),
    "vincenty": q(POINTS, _VINCENTY, "SELECT pop1, pop2, round(d, 3) AS d, round(ln(d), 6) AS ln_d FROM vd"),
    "ibd_table": q(*IBD, "SELECT pop1, pop2, R(fst_raw) AS fst_raw, R(dcse_raw) AS dcse_raw, R(d) AS d, R(ln_d) AS ln_d, R(fr_raw) AS fr_raw FROM ib"),
    "ibd_regression": q(*IBD, f"ln_ AS ({_LINE('2D', 'fr_raw', 'ln_d')} UNION ALL {_LINE('2D chord', 'dcse_raw', 'ln_d')} UNION ALL {_LINE('1D', 'fr_raw', 'd')}), lb2 AS (SELECT *, round(slope, 4) AS b FROM ln_)", "SELECT line, R(slope) AS slope, R(intercept) AS intercept, R(r2) AS r2, n, b, R(CASE WHEN b <> 0 THEN 1 / b END) AS nb, R(CASE WHEN b <> 0 THEN 1 / b / (2 * pi()) END) AS nem FROM lb2"),
    "ibd_external": q(*IBD, "SELECT pop1, pop2, R(fst_raw) AS fst_raw, R(pop1 * 10 + pop2) AS d, R(ln(pop1 * 10 + pop2)) AS ln_d FROM ib WHERE (pop1 + pop2) % 3 = 0"),
    "pair_exclusion": q(*IBD, "SELECT pop1, pop2, R(fst_raw) AS fst_raw FROM ib WHERE NOT (pop1 = 1 AND pop2 = 3) AND NOT (pop1 = 2 AND pop2 = 4) AND NOT (pop1 = 0 AND pop2 = 24)"),
    "partial_mantel": q(*IBD, "mt AS (SELECT pop1, pop2, d AS x, fr_raw AS y, dcse_raw AS z FROM ib)", PERM, f"c0 AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n_pairs FROM mt), c1 AS (SELECT rep, corr(px, y) AS xy, corr(px, z) AS xz, corr(y, z) AS yz FROM pm GROUP BY rep), ob AS (SELECT *, {_PART} AS o FROM c0), nl AS (SELECT {_PART} AS s FROM c1), pv AS (SELECT (count(*) FILTER (WHERE s >= o - 1e-9) + 1) / (count(s) + 1) AS p, (count(*) FILTER (WHERE s <= o + 1e-9) + 1) / (count(s) + 1) AS n, count(s) AS n_perm FROM nl, ob)", "SELECT R(o) AS stat, R(xy) AS rxy, R(xz) AS rxz, R(yz) AS ryz, n_pairs, R(p) AS p_pos, R(n) AS p_neg, n_perm, R(least(1.0, 2 * least(p, n))) AS p_two FROM ob, pv"),
    "mrm_correlations": q(*IBD, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, R(corr({a}, {b})) AS r FROM ib" for a, b in (("fr_raw", "fr_raw"), ("fr_raw", "d"), ("fr_raw", "dcse_raw"), ("d", "d"), ("d", "dcse_raw"), ("dcse_raw", "dcse_raw")))),
    "mantel_null_quantiles": q(*IBD, "mt AS (SELECT pop1, pop2, d AS x, fr_raw AS y FROM ib)", PERM, "nl AS (SELECT corr(x, py) AS s FROM pm GROUP BY rep)", " UNION ALL ".join(f"SELECT '{100 * p:g}%' AS label, R(quantile_cont(s::DOUBLE, {p})) AS value FROM nl" for p in (0.005, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.995)) + " UNION ALL SELECT 'OBSERVED', R(corr(x, y)) FROM mt"),
    "mantel_plus1": _mantel_sql("corr(x, y)"),
    "mantel_plain": _mantel_sql("corr(x, y)", plus1=0),
    "mantel_cross": _mantel_sql("sum(x * y)", eps="1e-9"),
    "mantel_slope": _mantel_sql("regr_slope(y, x)"),
    "mantel_spearman": _mantel_sql("corr(x, y)", source=RANKS),
    "mrm": _mrm_sql(False),
    "mrm_standardized": _mrm_sql(True),
}


_ORACLE["boot_loci_shared"] = " UNION ALL ".join(
    f"SELECT '{v}' AS statistic, {pops}, {v}_lo AS ci_l, {v}_hi AS ci_u FROM ({_ORACLE[src]})"
    for src, pops, names in (("boot_loci_ena", "NULL::INT AS pop1, NULL::INT AS pop2", ("fst_raw", "fst_ena")), ("boot_loci_pair", "pop1, pop2", ("fst_raw", "fst_ena")), ("boot_loci_dcse", "pop1, pop2", ("dcse_raw", "dcse_ina")))
    for v in names
)


def queries() -> dict:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
