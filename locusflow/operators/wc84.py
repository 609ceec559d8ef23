"""Weir & Cockerham (1984) variance components, and FST, FIT and FIS from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio, ratio_nonzero
from .counts import Keys, pop_locus


def gathered(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row a locus: sizes, diversities, and ``x``, the (allele, c, h, n) of all its populations.

    Everything about a locus follows from this row, so the counts are made once, in a chain without joins; the row grows with
    populations x alleles, not with individuals.  ``ok`` tells where variance components are defined.
    """
    by = [*keys, "locus"]
    total = F.sum("c")
    per = counts.groupBy(*by, "pop").agg(
        (total / 2).cast("long").alias("n"), (F.sum("h") / 2).cast("long").alias("n_het"), (F.sum(F.col("c").cast("double") * F.col("c")) / (total.cast("double") * total)).alias("sp2"),
        F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("ol"), F.collect_list(F.struct("allele", "c", "h")).alias("x"),
    )
    n, n2 = F.col("n"), 2.0 * F.col("n")
    unbiased = F.when(n > 1, (1 - F.col("sp2")) * n2 / (n2 - 1))
    own = F.transform("x", lambda a: F.struct(a["allele"].alias("allele"), a["c"].alias("c"), a["h"].alias("h"), n.alias("n")))
    out = per.groupBy(*by).agg(
        F.count("*").alias("r"), F.sum(n).alias("nt"), F.sum(n.cast("double") * n).alias("n2"), F.sum("n_het").alias("het"), F.avg(unbiased).alias("hs"), F.avg(F.col("n_het") / n).alias("ho"),
        F.sum(n * (1 - F.col("sp2"))).alias("nh"), F.sum("ol").alias("ol"), F.sum(n2 * F.log(n2)).alias("rl"), F.flatten(F.collect_list(own)).alias("x"),
    )
    nc = F.when(F.col("r") > 1, (F.col("nt") - F.col("n2") / F.col("nt")) / (F.col("r") - 1))
    out = out.withColumn("nbar", F.col("nt") / F.col("r")).withColumn("nc", nc)
    return out.withColumn("ok", F.coalesce((F.col("r") >= 2) & (F.col("nt") > 1) & (F.col("nc") > 0) & (F.col("nbar") > 1), F.lit(False)))


_SIZES = ("r", "nt", "het", "hs", "ho", "nh", "nbar", "nc", "ok")


def allele_components(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per allele: the sizes of its locus, ``freq`` (pooled), ``mean_p`` (mean over populations) and a, b, c (null where they aren't defined)."""
    by = [*keys, "locus"]
    rows = gathered(counts, keys).select(*by, *_SIZES, F.explode("x").alias("s")).select(*by, *_SIZES, "s.*")
    c, n = F.col("c"), F.col("n")
    x = rows.groupBy(*by, "allele").agg(
        F.sum(c.cast("double") * c / (4.0 * n)).alias("q"), F.sum(c).alias("cs"), F.sum("h").alias("hc"), F.sum(c / (2.0 * n)).alias("ps"), *[F.first(v).alias(v) for v in _SIZES]
    )
    r, nt, nbar, nc = (F.col(v) for v in ("r", "nt", "nbar", "nc"))
    p, hbar = F.col("cs") / (2.0 * nt), F.col("hc") / nt.cast("double")
    s2 = (F.col("q") - F.col("cs").cast("double") * F.col("cs") / (4.0 * nt)) / ((r - 1) * nbar)
    inner = p * (1 - p) - (r - 1) / r * s2
    a = nbar / nc * (s2 - (inner - hbar / 4) / (nbar - 1))
    b = nbar / (nbar - 1) * (inner - (2 * nbar - 1) / (4 * nbar) * hbar)
    ok = F.col("ok")
    return x.select(*by, "allele", "nt", "r", "ok", "het", "hs", "ho", "nh", p.alias("freq"), (F.col("ps") / r).alias("mean_p"), F.when(ok, a).alias("a"), F.when(ok, b).alias("b"), F.when(ok, hbar / 2).alias("c"))


def hs_per_locus(pl: DataFrame, keys: Keys = ()) -> DataFrame:
    """HS-a: the plain mean over populations of more than one individual of their unbiased gene diversities."""
    n2 = 2.0 * F.col("n")
    return pl.groupBy(*keys, "locus").agg(F.avg(F.when(F.col("n") > 1, (1 - F.col("sp2")) * n2 / (n2 - 1))).alias("hs"))


def raw_stats(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per locus: sums of a, b and c as they are, Ho (mean over populations), HS-a, HT, heterozygotes, sizes, and ``nh`` (sum of n times biased diversity)."""
    by = [*keys, "locus"]
    same = ("nt", "r", "het", "hs", "ho", "nh")
    x = allele_components(counts, keys).groupBy(*by).agg(*[F.sum(v).alias(v) for v in "abc"], *[F.first(v).alias(v) for v in same], (1 - F.sum(F.col("mean_p") * F.col("mean_p"))).alias("ht"))
    n2 = 2.0 * F.col("nt")
    return x.withColumn("ht", F.col("ht") * n2 / (n2 - 1))


def locus_stats(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per locus: a, b, c and HI (heterozygotes / individuals), HS, HT; all six are null where a + b + c isn't above 0."""
    x = raw_stats(counts, keys)
    ok = F.col("a") + F.col("b") + F.col("c") > 0
    return x.select(*keys, "locus", *[F.when(ok, F.col(v)).alias(v) for v in ("a", "b", "c")], F.when(ok, F.col("het") / F.col("nt").cast("double")).alias("hi"), F.when(ok, F.col("hs")).alias("hs"), F.when(ok, F.col("ht")).alias("ht"), "r", "nt")


def f_statistics(stats: DataFrame) -> DataFrame:
    """Adds fst, fit and fis to rows with a, b and c."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return stats.withColumn("fst", ratio(a, a + b + c)).withColumn("fit", ratio(a + b, a + b + c)).withColumn("fis", ratio(b, b + c))


def observed(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per locus: fst, fit, fis, hi, hs, ht."""
    return f_statistics(locus_stats(counts, keys)).select(*keys, "locus", "fst", "fit", "fis", "hi", "hs", "ht")


def overall(stats: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row a key: ratios of sums over loci, and means of HI, HS and HT; from ``locus_stats``."""
    sums = stats.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in "abc"], *[F.avg(v).alias(v) for v in ("hi", "hs", "ht")])
    return f_statistics(sums).select(*keys, "fst", "fit", "fis", "hi", "hs", "ht")


def per_allele(counts: DataFrame) -> DataFrame:
    """Per allele: individuals, populations, pooled frequency, fis, fst and fit; denominators only need to differ from 0."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return allele_components(counts).select("locus", "allele", F.col("nt").alias("n_genotyped"), F.col("r").alias("n_pops"), "freq", ratio_nonzero(b, b + c).alias("fis"), ratio_nonzero(a, a + b + c).alias("fst"), ratio_nonzero(a + b, a + b + c).alias("fit"))


def fis_components(pl: DataFrame, by: Keys) -> DataFrame:
    """Within and between components of FIS by mean squares, for any grouping of (population, locus) rows.

    Summed over alleles, the squares within individuals are the heterozygotes, and those among individuals are
    2n(1 - sum p**2) minus them, so population sizes suffice.
    """
    n = F.col("n")
    x = pl.filter(n > 0).groupBy(*by).agg(F.sum(n).alias("nt"), F.count("*").alias("k"), F.sum("n_het").alias("het"), F.sum(2.0 * n * (1 - F.col("sp2"))).alias("s"))
    w = F.col("het") / F.col("nt").cast("double")
    msi = (F.col("s") - F.col("het")) / (F.col("nt") - F.col("k")).cast("double")
    ok = (F.col("nt") >= 2) & (F.col("nt") > F.col("k"))
    return x.select(*by, F.when(ok, w).alias("sw"), F.when(ok, 0.5 * (msi - w)).alias("sb"))


def fis_by_locus(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """FIS of each locus; works with a single population."""
    return fis_components(pop_locus(counts, keys), [*keys, "locus"]).select(*keys, "locus", ratio_nonzero(F.col("sb"), F.col("sb") + F.col("sw")).alias("fis"))


def fis_overall(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """The ratio of sums over loci."""
    x = fis_components(pop_locus(counts, keys), [*keys, "locus"]).groupBy(*keys).agg(F.sum("sb").alias("sb"), F.sum("sw").alias("sw"))
    return x.select(*keys, ratio(F.col("sb"), F.col("sb") + F.col("sw")).alias("fis"))


def fis_by_pop(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """FIS of each population: the ratio of sums over its loci, each taken alone."""
    x = fis_components(pop_locus(counts, keys), [*keys, "pop", "locus"]).groupBy(*keys, "pop").agg(F.sum("sb").alias("sb"), F.sum("sw").alias("sw"))
    return x.select(*keys, "pop", ratio(F.col("sb"), F.col("sb") + F.col("sw")).alias("fis"))


def fis_locus_pop(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """FIS of each population at each locus."""
    return fis_components(pop_locus(counts, keys), [*keys, "pop", "locus"]).select(*keys, "pop", "locus", ratio_nonzero(F.col("sb"), F.col("sb") + F.col("sw")).alias("fis"))
