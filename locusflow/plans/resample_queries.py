"""Registered queries: permutations, bootstraps, and what is made of them.  Few replicates, as the SQL side has to follow."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import r8
from ..functions.cache import keep
from ..operators import counts, diversity, gstat, inference, kernel, resample, strata, wc84
from . import oracle
from .base_queries import COMPLETE, F_COLS, PAIRS, WC, ld_sql, rounded
from .fixtures import genotypes

B, SEED, CONF = 20, 1, 0.95
REP = "rep, "


def _g(s, d):
    """Cached, as replicates, counts and observed values are made of it in several passes."""
    return keep(genotypes(s, d))


def _c(s, d):
    return counts.allele_counts(_g(s, d))


def engine(n: int) -> str:
    """SQL follows the md5 draws of few replicates; thousands come from the faster engine."""
    return "auto" if n <= B else "kernel"


def ld_engine(n: int) -> str:
    """Linkage by md5 draws, or by tables drawn from their margins."""
    return "auto" if n <= B else "margins"


def _labels(s, d, n=B):
    return kernel.permuted_counts(_g(s, d), n, SEED, "labels", engine(n))


def _alleles(s, d, within=True, n=B):
    return kernel.permuted_counts(_g(s, d), n, SEED, "alleles_within" if within else "alleles_global", engine(n))


def _pops(s, d, n=B):
    return resample.bootstrap_populations(_c(s, d), n, SEED)


def _people(s, d, n=B):
    return kernel.bootstrap_individual_counts(_g(s, d), n, SEED, engine(n))


def _complete(s, d):
    return keep(counts.complete_individuals(_g(s, d)))


def with_overall(by_locus, whole, *names):
    """Rows by locus and rows named Overall."""
    return by_locus.select("rep", "locus", *names).unionByName(whole.select("rep", F.lit("Overall").alias("locus"), *names))


def perm_fst_labels(s, d, n=B):
    """By the relational ranking."""
    c = keep(strata.label_counts(_g(s, d), n, SEED))
    return rounded(wc84.observed(c, ["rep"]).join(gstat.g_by_locus(c, ["rep"]), ["rep", "locus"]).select("rep", "locus", "fst", "g"), "fst", "g")


def perm_fst_p(s, d, n=B):
    """p of FST (all three ways) and of G for each locus, and of the overall G."""
    c, obs = keep(_labels(s, d, n=n)), _c(s, d)
    gp, go = gstat.g_by_locus(c, ["rep"]), gstat.g_by_locus(obs)
    own = wc84.observed(c, ["rep"]), wc84.observed(obs)
    tests = [inference.p_values(*own, ["locus"], "fst", a).select("locus", F.lit(a).alias("test"), "observed", "p_value") for a in inference.ALTERNATIVES]
    tests.append(inference.p_values(gp, go, ["locus"], "g").select("locus", F.lit("g").alias("test"), "observed", "p_value"))
    tests.append(inference.p_values(gstat.g_overall(gp, ["rep"]), gstat.g_overall(go), [], "g").select(F.lit("Overall").alias("locus"), F.lit("g").alias("test"), "observed", "p_value"))
    out = tests[0]
    for t in tests[1:]:
        out = out.unionByName(t)
    return rounded(out, "observed", "p_value")


def perm_within_pop(s, d, n=B):
    """By the md5 ranking of each stratum."""
    c = strata.within_counts(_g(s, d), n, SEED)
    return rounded(wc84.observed(c, ["rep"]).select("rep", "locus", "fst", "fis"), "fst", "fis")


def perm_fis(s, d, n=B):
    c = keep(_alleles(s, d, n=n))
    return rounded(with_overall(wc84.fis_by_locus(c, ["rep"]), wc84.fis_overall(c, ["rep"]), "fis"), "fis")


def perm_fis_by_pop(s, d, n=B):
    return rounded(wc84.fis_by_pop(_alleles(s, d, n=n), ["rep"]), "fis")


def perm_fis_grid(s, d, n=B):
    """FIS and two-sided p of each population and locus."""
    perm, obs = wc84.fis_locus_pop(_alleles(s, d, n=n), ["rep"]), wc84.fis_locus_pop(_c(s, d))
    return rounded(inference.p_values(perm, obs, ["pop", "locus"], "fis", "two_sided_abs"), "observed", "p_value")


def perm_fit_global(s, d, n=B):
    c, obs = keep(_alleles(s, d, False, n)), _c(s, d)
    perm = with_overall(wc84.observed(c, ["rep"]), wc84.overall(wc84.locus_stats(c, ["rep"]), ["rep"]), "fit")
    own = wc84.observed(obs).select("locus", "fit").unionByName(wc84.overall(wc84.locus_stats(obs)).select(F.lit("Overall").alias("locus"), "fit"))
    return rounded(inference.p_values(perm, own, ["locus"], "fit", "two_sided_abs"), "observed", "p_value")


def perm_hi_hs_centered(s, d, n=B):
    """FIT two-sided by size; HI and HS by distance from the mean (observed HS is hs_b, permuted hs_f)."""
    c, obs = keep(_alleles(s, d, n=n)), _c(s, d)
    own, perm = diversity.hi_hs(obs), diversity.hs_f(c, ["rep"])
    fit = inference.p_values(wc84.observed(c, ["rep"]), own, ["locus"], "fit", "two_sided_abs").select("locus", F.lit("fit").alias("test"), "observed", "p_value")
    parts = [inference.p_centred(perm, own, ["locus"], v).select("locus", F.lit(v).alias("test"), "observed", "p_value") for v in ("hi", "hs")]
    return rounded(fit.unionByName(parts[0]).unionByName(parts[1]), "observed", "p_value")


def gtest_perm(s, d, n=B):
    """G of complete genotypes with p of at least and of more than the observed value, by locus and overall."""
    geno = _complete(s, d)
    obs = gstat.g_by_locus(counts.allele_counts(geno), min_alleles=2)
    perm = keep(gstat.g_by_locus(kernel.permuted_counts(geno, n, SEED, "labels", engine(n)), ["rep"], 2))
    o = obs.select(F.col("locus").alias("id"), "n_geno", "g").unionByName(obs.groupBy(F.lit("Overall").alias("id")).agg(F.max("n_geno").alias("n_geno"), F.sum("g").alias("g")))
    p = perm.select(F.col("locus").alias("id"), F.col("g").alias("gp")).unionByName(gstat.g_overall(perm, ["rep"]).select(F.lit("Overall").alias("id"), F.col("g").alias("gp")))
    # values that differ by rounding alone are equal
    near = F.abs(F.col("gp") - F.col("g")) < 1e-9
    m = F.count("gp") + 1
    x = p.join(o, "id").groupBy("id", "n_geno", "g").agg(((F.sum(((F.col("gp") >= F.col("g")) | near).cast("long")) + 1) / m).alias("p_ge"), ((F.sum(((F.col("gp") > F.col("g")) & ~near).cast("long")) + 1) / m).alias("p_gt"))
    return rounded(x, "g", "p_ge", "p_gt")


def ld_perm(s, d, n=B):
    """p of each pair of loci in each population and over all: (b + 1) / n with n - 1 shuffles."""
    pairs = gstat.locus_pairs(_g(s, d))
    return rounded(ld_p_values(pairs, n, SEED), "g", "p_value")


def ld_p_values(pairs, n: int, seed):
    obs, perm = keep(gstat.ld_g(pairs)), keep(strata.linkage_g(pairs, n - 1, seed))
    both = ["locus1", "locus2"]
    o = obs.select(F.col("pop").cast("string").alias("pop"), *both, "g").unionByName(gstat.ld_all(obs).select(F.lit("All").alias("pop"), *both, "g"))
    p = perm.select(F.col("pop").cast("string").alias("pop"), *both, F.col("g").alias("gp")).unionByName(gstat.ld_all(perm, ["rep"]).select(F.lit("All").alias("pop"), *both, F.col("g").alias("gp")))
    return o.join(p, ["pop", *both], "left").groupBy("pop", *both, "g").agg(((F.sum(F.coalesce((F.col("gp") >= F.col("g") - 1e-9).cast("long"), F.lit(0))) + 1) / n).alias("p_value"))


def ld_pooled_p(pairs, n: int, seed):
    """``pop, locus1, locus2, g, p_value``: the share of n shuffles with at least the observed G, by population; and Global, where shuffles of all populations meet the mean of their observed values."""
    obs, perm = keep(gstat.ld_g(pairs, every=True)), keep(strata.linkage_g(pairs, n, seed, every=True))
    both = ["locus1", "locus2"]
    sim = perm.select("pop", *both, F.col("g").alias("gp"))
    share = F.avg((F.col("gp") >= F.col("g") - 1e-10).cast("double")).alias("p_value")
    own = obs.select("pop", *both, "g").join(sim, ["pop", *both]).groupBy("pop", *both, "g").agg(share)
    # values that differ by rounding alone are equal here too
    whole = obs.groupBy(*both).agg(F.avg("g").alias("g")).join(sim.drop("pop"), both).groupBy(*both, "g").agg(share)
    return own.withColumn("pop", F.col("pop").cast("string")).unionByName(whole.withColumn("pop", F.lit("Global")))


def ld_pooled(s, d, n=B):
    return rounded(ld_pooled_p(gstat.locus_pairs(_g(s, d)), n, SEED), "g", "p_value")


def ld_pooled_missing(s, d, n=B):
    """Missing genotypes count as genotypes."""
    return rounded(ld_pooled_p(gstat.locus_pairs(_g(s, d), missing=True), n, SEED), "g", "p_value")


def boot_pop_fst(s, d, n=B):
    stats = kernel.bootstrap_locus_stats(_c(s, d), n, SEED)
    return rounded(with_overall(wc84.f_statistics(stats), wc84.overall(stats, ["rep"]), "fst", "hs", "ht"), "fst", "hs", "ht")


def boot_pop_fis(s, d, n=B):
    c = _pops(s, d, n=n)
    return rounded(with_overall(wc84.fis_by_locus(c, ["rep"]), wc84.fis_overall(c, ["rep"]), "fis"), "fis")


def boot_pop_fit(s, d, n=B):
    return rounded(diversity.hi_hs(_pops(s, d, n=n), ["rep"]), "fst", "fit", "hi", "hs")


def boot_pop_fit_ci(s, d, n=B):
    x = keep(diversity.hi_hs(_pops(s, d, n=n), ["rep"]))
    parts = [inference.interval(x, ["locus"], v, CONF).select("locus", F.lit(v).alias("statistic"), "boot_mean", "ci_l", "ci_u") for v in ("fit", "hi", "hs")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "boot_mean", "ci_l", "ci_u")


def boot_indiv_hs(s, d, n=B):
    c = _people(s, d, n=n)
    x = keep(wc84.hs_per_locus(counts.pop_locus(c, ["rep"]), ["rep"]))
    return rounded(x.unionByName(x.groupBy("rep").agg(F.avg("hs").alias("hs")).select("rep", F.lit("Overall").alias("locus"), "hs")), "hs")


def boot_indiv_fis(s, d, n=B):
    """By the md5 draw of each population."""
    c = keep(strata.individual_counts(_g(s, d), n, SEED))
    return rounded(with_overall(wc84.fis_by_locus(c, ["rep"]), wc84.fis_overall(c, ["rep"]), "fis"), "fis")


def boot_indiv_fis_by_pop(s, d, n=B):
    return rounded(wc84.fis_by_pop(_people(s, d, n=n), ["rep"]), "fis")


def boot_indiv_hs_per_pop(s, d, n=B):
    """HS (hs_c, mean over loci) of each population: observed, mean, SE and interval."""
    own = diversity.hs_by_pop_locus(_c(s, d)).groupBy("pop").agg(F.avg("hs").alias("observed"), F.count("hs").alias("n_loci"))
    boot = diversity.hs_by_pop_locus(_people(s, d, n=n), ["rep"]).groupBy("rep", "pop").agg(F.avg("hs").alias("hs"))
    x = own.join(inference.interval(boot, ["pop"], "hs", CONF), "pop").select("pop", "observed", "boot_mean", "boot_se", "ci_l", "ci_u", "n_loci")
    return rounded(x, "observed", "boot_mean", "boot_se", "ci_l", "ci_u")


def locus_bootstrap(stats, n: int, seed, conf: float = 0.95):
    """Statistic, observed, boot_mean, boot_se, ci_l, ci_u of FST, FIT, FIS (ratios) and HS, HT (means) over drawn loci with all five values."""
    full = stats.filter("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND hs IS NOT NULL AND ht IS NOT NULL")
    names = ("fst", "fit", "fis", "hs", "ht")
    own, boot = wc84.overall(full), wc84.overall(resample.bootstrap_loci(full, n, seed), ["rep"])
    long = lambda x, keys: x.select(*keys, F.explode(F.create_map(*[y for v in names for y in (F.lit(v.upper()), F.col(v))])).alias("statistic", "v"))
    ci = inference.interval(long(boot, ["rep"]), ["statistic"], "v", conf)
    return long(own, []).withColumnRenamed("v", "observed").join(ci, "statistic").select("statistic", "observed", "boot_mean", "boot_se", "ci_l", "ci_u")


def boot_loci(s, d, n=B):
    return rounded(locus_bootstrap(wc84.locus_stats(_c(s, d)), n, SEED, CONF), "observed", "boot_mean", "boot_se", "ci_l", "ci_u")


def ci_type7(s, d, n=B):
    return rounded(inference.interval(wc84.observed(_pops(s, d, n=n), ["rep"]), ["locus"], "fst", CONF), "boot_mean", "boot_median", "boot_se", "ci_l", "ci_u")


def ci_floor(s, d, n=B):
    x = inference.interval(wc84.fis_by_locus(_people(s, d, n=n), ["rep"]), ["locus"], "fis", CONF, "floor")
    return rounded(x.select("locus", "boot_mean", "ci_l", "ci_u", "n"), "boot_mean", "ci_l", "ci_u")


_QUERIES = [perm_fst_labels, perm_fst_p, perm_within_pop, perm_fis, perm_fis_by_pop, perm_fis_grid, perm_fit_global, perm_hi_hs_centered, gtest_perm, ld_perm, ld_pooled, ld_pooled_missing, boot_pop_fst, boot_pop_fis, boot_pop_fit, boot_pop_fit_ci, boot_indiv_hs, boot_indiv_fis, boot_indiv_fis_by_pop, boot_indiv_hs_per_pop, boot_loci, ci_type7, ci_floor]

# -- SQL ---------------------------------------------------------------------------


def labels_sql(src: str = "valid", people: str = "geno", n: int = B, seed=SEED) -> str:
    return f"""
ind AS (SELECT DISTINCT indiv, pop FROM {people}), plc AS (SELECT indiv, row_number() OVER (ORDER BY indiv) AS r FROM ind),
shf AS (SELECT rep, pop, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '{seed}', rep, indiv)), indiv) AS r FROM ind, range(1, {n + 1}) t(rep)),
prm AS (SELECT rep, v.indiv, shf.pop, locus, a1, a2 FROM {src} v JOIN plc USING (indiv) JOIN shf USING (r))"""


def alleles_sql(within: bool = True) -> str:
    by = "locus, pop" if within else "locus"
    return f"""
cps AS (SELECT indiv, pop, locus, copy, CASE WHEN copy = 0 THEN a1 ELSE a2 END AS allele FROM valid, range(2) t(copy)),
slt AS (SELECT indiv, pop, locus, copy, row_number() OVER (PARTITION BY {by} ORDER BY indiv, copy) AS r FROM cps),
shv AS (SELECT rep, {by}, allele, row_number() OVER (PARTITION BY rep, {by} ORDER BY md5(concat_ws('|', '{SEED}', rep, locus, indiv, copy)), indiv, copy) AS r FROM cps, range(1, {B + 1}) t(rep)),
prm AS (SELECT rep, indiv, slt.pop, slt.locus, max(allele) FILTER (WHERE copy = 0) AS a1, max(allele) FILTER (WHERE copy = 1) AS a2 FROM slt JOIN shv USING ({by}, r) GROUP BY ALL)"""


POPS_SQL = f"""
pn AS (SELECT pop, row_number() OVER (ORDER BY pop) - 1 AS i FROM (SELECT DISTINCT pop FROM valid)), pk AS (SELECT count(*) AS k FROM pn),
slo AS (SELECT rep, i + 1 AS slot, U('{SEED}', rep, i + 1) % k AS j FROM pn, pk, range(1, {B + 1}) t(rep)),
prm AS (SELECT rep, indiv, slot AS pop, locus, a1, a2 FROM slo JOIN pn ON slo.j = pn.i JOIN valid USING (pop))"""
PEOPLE_SQL = f"""
ppl AS (SELECT indiv, pop, row_number() OVER (PARTITION BY pop ORDER BY indiv) AS r, count(*) OVER (PARTITION BY pop) AS k FROM (SELECT DISTINCT indiv, pop FROM geno)),
drw AS (SELECT rep, pop, r AS slot, U('{SEED}', rep, pop, r) % k + 1 AS r FROM ppl, range(1, {B + 1}) t(rep)),
prm AS (SELECT rep, v.indiv, v.pop, locus, a1, a2 FROM drw JOIN ppl USING (pop, r) JOIN valid v ON v.indiv = ppl.indiv)"""
PER = (oracle.counts("prm", REP, "r_"), oracle.components(REP, "r_"))
PER_O = (*PER, oracle.over(REP, "r_"))
q = oracle.query


def _p(alt: str, perm: str = "x.v", obs: str = "o.v") -> str:
    hit = {"greater": f"{perm} >= {obs} - 1e-9", "less": f"{perm} <= {obs} + 1e-9", "two_sided_abs": f"abs({perm}) >= abs({obs}) - 1e-9"}[alt]
    return f"CASE WHEN count({perm}) FILTER (WHERE {obs} IS NOT NULL) > 0 THEN (count(*) FILTER (WHERE {hit}) + 1) / (count({perm}) + 1) END"


def _fis_union(src: str) -> str:
    return f"SELECT rep, locus, R(CASE WHEN sb + sw <> 0 THEN sb / (sb + sw) END) AS fis FROM (SELECT DISTINCT rep, locus FROM {src}n) LEFT JOIN {src}ms USING (rep, locus) UNION ALL SELECT rep, 'Overall', R(CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END) FROM {src}ms GROUP BY rep"


MS = oracle.mean_squares("rep, locus", "r_")
MSP = oracle.mean_squares("rep, pop, locus", "r_")
_CI = lambda v: f"R(avg({v})) AS boot_mean, R(quantile_cont({v}::DOUBLE, 0.025)) AS ci_l, R(quantile_cont({v}::DOUBLE, 0.975)) AS ci_u"
_GP = (oracle.counts(), oracle.g_sql(), oracle.counts("prm", REP, "r_"), oracle.g_sql(REP, "r_"))

_ORACLE = {
    "perm_fst_labels": q(labels_sql(), *PER, oracle.g_sql(REP, "r_"), "SELECT rep, locus, R(fst) AS fst, R(g) AS g FROM r_f JOIN r_g USING (rep, locus)"),
    "perm_fst_p": q(labels_sql(), *_GP, oracle.components(), oracle.components(REP, "r_"), "SELECT locus, test, R(observed) AS observed, R(p) AS p_value FROM (" + " UNION ALL ".join(f"SELECT locus, '{a}' AS test, o.fst AS observed, {_p(a, 'x.fst', 'o.fst')} AS p FROM r_f x JOIN f o USING (locus) GROUP BY ALL" for a in inference.ALTERNATIVES) + f" UNION ALL SELECT locus, 'g', o.g, {_p('greater', 'x.g', 'o.g')} FROM r_g x JOIN g o USING (locus) GROUP BY ALL UNION ALL SELECT 'Overall', 'g', o.g, {_p('greater', 'x.g', 'o.g')} FROM (SELECT rep, sum(g) AS g FROM r_g GROUP BY rep) x, (SELECT sum(g) AS g FROM g) o GROUP BY ALL)"),
    "perm_within_pop": q(alleles_sql(), *PER, "SELECT rep, locus, R(fst) AS fst, R(fis) AS fis FROM r_f"),
    "perm_fis": q(alleles_sql(), *PER, MS, _fis_union("r_")),
    "perm_fis_by_pop": q(alleles_sql(), *PER, MSP, "SELECT rep, pop, R(CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END) AS fis FROM (SELECT DISTINCT rep, pop, locus FROM r_n) LEFT JOIN r_ms USING (rep, pop, locus) GROUP BY rep, pop"),
    "perm_fis_grid": q(*WC, oracle.mean_squares("pop, locus"), alleles_sql(), *PER, MSP, "vv AS (SELECT rep, pop, locus, CASE WHEN sb + sw <> 0 THEN sb / (sb + sw) END AS v FROM (SELECT DISTINCT rep, pop, locus FROM r_n) LEFT JOIN r_ms USING (rep, pop, locus)), oo AS (SELECT pop, locus, CASE WHEN sb + sw <> 0 THEN sb / (sb + sw) END AS v FROM (SELECT DISTINCT pop, locus FROM n) LEFT JOIN ms USING (pop, locus))", f"SELECT pop, locus, R(o.v) AS observed, count(x.v) AS n_reps, R({_p('two_sided_abs')}) AS p_value FROM vv x JOIN oo o USING (pop, locus) GROUP BY pop, locus, o.v"),
    "perm_fit_global": q(*WC, oracle.over(), alleles_sql(False), *PER_O, "xx AS (SELECT rep, locus, fit AS v FROM r_f UNION ALL SELECT rep, 'Overall', fit FROM r_o), oo AS (SELECT locus, fit AS v FROM f UNION ALL SELECT 'Overall', fit FROM o)", f"SELECT locus, R(o.v) AS observed, count(x.v) AS n_reps, R({_p('two_sided_abs')}) AS p_value FROM xx x JOIN oo o USING (locus) GROUP BY locus, o.v"),
    "perm_hi_hs_centered": q(*WC, alleles_sql(), *PER, "oo AS (SELECT locus, het / nt AS hi, hs_b AS hs, CASE WHEN a + b + c <> 0 THEN (a + b) / (a + b + c) END AS fit FROM raw JOIN hs USING (locus)), xx AS (SELECT rep, locus, 'hi' AS test, ho AS v FROM r_hs UNION ALL SELECT rep, locus, 'hs', hs_f FROM r_hs), mu AS (SELECT locus, test, avg(v) AS mu FROM xx GROUP BY ALL)", f"SELECT locus, 'fit' AS test, R(o.fit) AS observed, R({_p('two_sided_abs', 'x.fit', 'o.fit')}) AS p_value FROM r_f x JOIN oo o USING (locus) GROUP BY locus, o.fit UNION ALL SELECT locus, test, R(o), R((count(*) FILTER (WHERE abs(v - mu) >= abs(o - mu) - 1e-9) + 1) / (count(v) + 1)) FROM (SELECT x.*, mu, CASE WHEN test = 'hi' THEN hi ELSE hs END AS o FROM xx x JOIN mu USING (locus, test) JOIN oo USING (locus)) GROUP BY locus, test, o"),
    "gtest_perm": q(COMPLETE, oracle.counts("complete"), oracle.g_sql(), labels_sql("complete", "complete"), oracle.counts("prm", REP, "r_"), oracle.g_sql(REP, "r_"), "oo AS (SELECT locus AS id, n_geno, g FROM g UNION ALL SELECT 'Overall', max(n_geno), sum(g) FROM g), xx AS (SELECT locus AS id, g AS v FROM r_g UNION ALL SELECT 'Overall', sum(g) FROM r_g GROUP BY rep)", "SELECT id, n_geno::BIGINT AS n_geno, R(g) AS g, R((count(*) FILTER (WHERE v >= g - 1e-9) + 1) / (count(v) + 1)) AS p_ge, R((count(*) FILTER (WHERE v > g + 1e-9) + 1) / (count(v) + 1)) AS p_gt FROM xx JOIN oo USING (id) GROUP BY id, n_geno, g"),
    "ld_perm": q(PAIRS, ld_sql(), f"""pk2 AS (SELECT *, row_number() OVER (PARTITION BY pop, locus1, locus2 ORDER BY indiv) AS r FROM prs),
mv AS (SELECT rep, pop, locus1, locus2, g2, row_number() OVER (PARTITION BY rep, pop, locus1, locus2 ORDER BY md5(concat_ws('|', '{SEED}', rep, locus1, locus2, indiv)), indiv) AS r FROM prs, range(1, {B}) t(rep)),
prp AS (SELECT rep, indiv, pop, locus1, locus2, g1, mv.g2 FROM pk2 JOIN mv USING (pop, locus1, locus2, r))""", ld_sql("prp", REP).replace("ce AS", "ce_ AS").replace("FROM ce", "FROM ce_").replace("lr AS", "lr_ AS").replace("lc AS", "lc_ AS").replace("lt AS", "lt_ AS").replace("ld AS", "ld_ AS").replace("JOIN lr", "JOIN lr_").replace("JOIN lc", "JOIN lc_").replace("JOIN lt", "JOIN lt_"), "oo AS (SELECT pop::VARCHAR AS pop, locus1, locus2, g FROM ld UNION ALL SELECT 'All', locus1, locus2, sum(g) FROM ld GROUP BY ALL), xx AS (SELECT pop::VARCHAR AS pop, locus1, locus2, g AS v FROM ld_ UNION ALL SELECT 'All', locus1, locus2, sum(g) FROM ld_ GROUP BY rep, locus1, locus2)", f"SELECT pop, locus1, locus2, R(g) AS g, R((count(*) FILTER (WHERE v >= g - 1e-9) + 1) / {B}) AS p_value FROM oo LEFT JOIN xx USING (pop, locus1, locus2) GROUP BY pop, locus1, locus2, g"),
    "boot_pop_fst": q(POPS_SQL, *PER_O, "SELECT rep, locus, R(fst) AS fst, R(hs) AS hs, R(ht) AS ht FROM r_f UNION ALL SELECT rep, 'Overall', R(fst), R(hs), R(ht) FROM r_o"),
    "boot_pop_fis": q(POPS_SQL, *PER, MS, _fis_union("r_")),
    "boot_pop_fit": q(POPS_SQL, *PER, "SELECT rep, locus, R(a / (a + b + c)) AS fst, R((a + b) / (a + b + c)) AS fit, R(het / nt) AS hi, R(hs_b) AS hs FROM r_raw JOIN r_hs USING (rep, locus)"),
    "boot_pop_fit_ci": q(POPS_SQL, *PER, "xx AS (SELECT rep, locus, (a + b) / (a + b + c) AS fit, het / nt AS hi, hs_b AS hs FROM r_raw JOIN r_hs USING (rep, locus))", " UNION ALL ".join(f"SELECT locus, '{v}' AS statistic, {_CI(v)} FROM xx GROUP BY locus" for v in ("fit", "hi", "hs"))),
    "boot_indiv_hs": q(PEOPLE_SQL, *PER, "SELECT rep, locus, R(hs) AS hs FROM r_hs UNION ALL SELECT rep, 'Overall', R(avg(hs)) FROM r_hs GROUP BY rep"),
    "boot_indiv_fis": q(PEOPLE_SQL, *PER, MS, _fis_union("r_")),
    "boot_indiv_fis_by_pop": q(PEOPLE_SQL, *PER, MSP, "SELECT rep, pop, R(CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END) AS fis FROM (SELECT DISTINCT rep, pop, locus FROM r_n) LEFT JOIN r_ms USING (rep, pop, locus) GROUP BY rep, pop"),
    "boot_indiv_hs_per_pop": q(*WC, PEOPLE_SQL, *PER, "oo AS (SELECT pop, avg(h) AS observed, count(h) AS n_loci FROM (SELECT pop, CASE WHEN n > 1 THEN he * 2 * n / (2 * n - 1) END AS h FROM div) GROUP BY pop), xx AS (SELECT rep, pop, avg(CASE WHEN n > 1 THEN he * 2 * n / (2 * n - 1) END) AS v FROM r_div GROUP BY rep, pop)", f"SELECT pop, R(observed) AS observed, {_CI('v')}, R(stddev_samp(v)) AS boot_se, n_loci FROM xx JOIN oo USING (pop) GROUP BY pop, observed, n_loci"),
    "boot_loci": q(*WC, oracle.over(), f"""ln AS (SELECT locus, row_number() OVER (ORDER BY locus) - 1 AS i FROM loc WHERE a + b + c + hs + ht IS NOT NULL), lk AS (SELECT count(*) AS k FROM ln),
sl AS (SELECT rep, i + 1 AS slot, U('{SEED}', rep, i + 1) % k AS j FROM ln, lk, range(1, {B + 1}) t(rep)),
bo AS (SELECT rep, sum(a) / sum(a + b + c) AS fst, sum(a + b) / sum(a + b + c) AS fit, sum(b) / sum(b + c) AS fis, avg(hs) AS hs, avg(ht) AS ht FROM sl JOIN ln ON sl.j = ln.i JOIN loc USING (locus) GROUP BY rep)""", " UNION ALL ".join(f"SELECT '{v.upper()}' AS statistic, R((SELECT {v} FROM o)) AS observed, {_CI(v)}, R(stddev_samp({v})) AS boot_se FROM bo" for v in ("fst", "fit", "fis", "hs", "ht"))),
    "ci_type7": q(POPS_SQL, *PER, f"SELECT locus, {_CI('fst')}, R(quantile_cont(fst::DOUBLE, 0.5)) AS boot_median, R(stddev_samp(fst)) AS boot_se, count(fst) AS n FROM r_f GROUP BY locus"),
    "ci_floor": q(PEOPLE_SQL, *PER, MS, "vv AS (SELECT locus, list_sort(list(sb / (sb + sw))) AS v FROM r_ms GROUP BY locus)", "SELECT locus, R(list_avg(v)) AS boot_mean, R(v[floor(len(v) * 0.025)::INT + 1]) AS ci_l, R(v[least(len(v) - 1, floor(len(v) * 0.975))::INT + 1]) AS ci_u, len(v) AS n FROM vv"),
}


def _ld_pooled_sql(source: str) -> str:
    every = " WHERE n >= 2 AND cells > 1 AND r1 > 1 AND r2 > 1"
    apart = lambda sql: re.sub(r"\b(ce|lr|lc|lt|ld)\b", r"\1_", sql)
    moved = f"mv AS (SELECT rep, pop, locus1, locus2, g2, row_number() OVER (PARTITION BY rep, pop, locus1, locus2 ORDER BY md5(concat_ws('|', '{SEED}', rep, locus1, locus2, indiv)), indiv) AS r FROM prs, range(1, {B + 1}) t(rep)), pk2 AS (SELECT *, row_number() OVER (PARTITION BY pop, locus1, locus2 ORDER BY indiv) AS r FROM prs), prp AS (SELECT rep, pop, locus1, locus2, g1, mv.g2 FROM pk2 JOIN mv USING (pop, locus1, locus2, r))"
    own = "SELECT pop::VARCHAR AS pop, locus1, locus2, R(o.g) AS g, R(avg((x.g >= o.g - 1e-10)::INT)) AS p_value FROM ld o JOIN ld_ x USING (pop, locus1, locus2) GROUP BY pop, locus1, locus2, o.g"
    whole = "SELECT 'Global', locus1, locus2, R(o.g), R(avg((x.g >= o.g - 1e-10)::INT)) FROM (SELECT locus1, locus2, avg(g) AS g FROM ld GROUP BY ALL) o JOIN ld_ x USING (locus1, locus2) GROUP BY locus1, locus2, o.g"
    return q(source, ld_sql().replace(every, ""), moved, apart(ld_sql("prp", REP).replace(every, "")), f"{own} UNION ALL {whole}")


_ORACLE["ld_pooled"] = _ld_pooled_sql(PAIRS)
_ORACLE["ld_pooled_missing"] = _ld_pooled_sql(PAIRS.replace("least(a1, a2) || '/' || greatest(a1, a2) AS g FROM valid", "CASE WHEN a1 > 0 AND a2 > 0 THEN least(a1, a2) || '/' || greatest(a1, a2) ELSE '0/0' END AS g FROM geno"))


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
