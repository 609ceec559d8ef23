"""Gene diversities.  The variants of HS differ in weights and bias correction; they keep separate names.

* hs_a (``wc84.hs_per_locus``): plain mean over populations with n > 1, unbiased
* hs_b (``hi_hs``): weighted by n, biased
* hs_c (``hs_by_pop_locus``): one population and locus, unbiased
* hs_e (``fis_by_pop_biased``): mean over loci, biased
* hs_f (``hs_f``): sum over populations with n > 1, divided by all populations, unbiased
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clamp01, ratio
from ..functions.cache import keep
from . import wc84
from .counts import Keys, pop_locus


def unbiased():
    """1 - sum p**2, times 2n / (2n - 1); null unless n > 1."""
    n2 = 2.0 * F.col("n")
    return F.when(F.col("n") > 1, (1 - F.col("sp2")) * n2 / (n2 - 1))


def hs_by_pop_locus(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    return pop_locus(counts, keys).select(*keys, "pop", "locus", "n", "n_het", (F.col("n_het") / F.col("n")).alias("ho"), unbiased().alias("hs"))


def hs_wide(counts: DataFrame, populations: list | None = None) -> DataFrame:
    """HS with a row for each locus and a column for each population (``p`` + its name)."""
    x = hs_by_pop_locus(counts).withColumn("name", F.concat(F.lit("p"), F.col("pop").cast("string")))
    if populations is None:
        populations = [r["pop"] for r in counts.select("pop").distinct().orderBy("pop").collect()]  # populations become columns
    return x.groupBy("locus").pivot("name", [f"p{p}" for p in populations]).agg(F.first("hs"))


def pop_stats_overall(counts: DataFrame) -> DataFrame:
    """Ho, Hs and Fis of each population; Fis is 1 - sum het / sum n Hs over loci with Hs > 0."""
    good = F.col("hs") > 0
    x = hs_by_pop_locus(counts).groupBy("pop").agg(F.avg("ho").alias("ho"), F.avg("hs").alias("hs"), F.sum(F.when(good, F.col("n_het")).otherwise(0)).alias("het"), F.sum(F.when(good, F.col("n") * F.col("hs")).otherwise(0.0)).alias("d"))
    return x.select("pop", "ho", "hs", F.when(F.col("d") != 0, 1 - F.col("het") / F.col("d")).alias("fis"))


def pop_stats_one(counts: DataFrame, population) -> DataFrame:
    """Ho, Hs and Fis = 1 - Ho / Hs of each locus of one population."""
    return hs_by_pop_locus(counts.filter(F.col("pop") == population)).select("locus", "ho", "hs", F.when(F.col("hs") > 0, 1 - F.col("ho") / F.col("hs")).alias("fis"))


def fis_by_pop_biased(counts: DataFrame) -> DataFrame:
    """1 - mean Ho / mean biased Hs over the loci that aren't monomorphic."""
    hs = 1 - F.col("sp2")
    x = pop_locus(counts).filter(hs > 1e-15).groupBy("pop").agg(F.avg(F.col("n_het") / F.col("n")).alias("ho"), F.avg(hs).alias("hs"))
    every = counts.select("pop").distinct()
    return every.join(x, "pop", "left").select("pop", F.when(F.col("hs") > 0, 1 - F.col("ho") / F.col("hs")).alias("fis"))


def nei(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per locus: Ho (plain mean over populations), Hs (hs_a), Ht and the number of populations k."""
    return wc84.raw_stats(counts, keys).select(*keys, "locus", "ho", "hs", "ht", F.col("r").alias("k"))


def hi_hs(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per locus: fst, fit, HI and HS-b; the last two stay where components aren't defined, all are null with one population."""
    d = F.col("a") + F.col("b") + F.col("c")
    many = F.col("r") > 1
    return wc84.raw_stats(counts, keys).select(*keys, "locus", F.when(many & (d != 0), F.col("a") / d).alias("fst"), F.when(many & (d != 0), (F.col("a") + F.col("b")) / d).alias("fit"), F.when(many, F.col("het") / F.col("nt")).alias("hi"), F.when(many, F.col("nh") / F.col("nt")).alias("hs"))


def hs_f(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per locus: the mean over populations of Ho, and HS-f."""
    return pop_locus(counts, keys).groupBy(*keys, "locus").agg(F.avg(F.col("n_het") / F.col("n")).alias("hi"), (F.sum(F.coalesce(unbiased(), F.lit(0.0))) / F.count("*")).alias("hs"))


def private_alleles(counts: DataFrame) -> DataFrame:
    """The recoding that maximises differentiation: no two populations share an allele."""
    return counts.withColumn("allele", F.concat_ws("|", F.col("pop").cast("string"), F.col("allele").cast("string")))


def fst_max(counts: DataFrame) -> DataFrame:
    return wc84.observed(private_alleles(counts)).select("locus", F.col("fst").alias("fst_max"))


def _derived(x: DataFrame, k: str) -> DataFrame:
    ho, hs, ht, fst, top = (F.col(c) for c in ("ho", "hs", "ht", "fst", "fst_max"))
    kk = F.col(k).cast("double")
    gst2 = F.when((kk > 1) & (1 - hs != 0) & (kk * ht - hs != 0), kk * (ht - hs) / ((kk * ht - hs) * (1 - hs)))
    return x.select(
        F.col("locus").alias("id"), ho.alias("ho"), hs.alias("hs"), ht.alias("ht"), clamp01(F.col("fit")).alias("fit_wc"), clamp01(F.col("fis")).alias("fis_wc"), clamp01(fst).alias("fst_wc"),
        clamp01(F.when(hs > 0, 1 - ho / hs)).alias("fis_nei"), clamp01(F.when(ht > 0, 1 - hs / ht)).alias("fst_nei"), clamp01(top).alias("fst_max"),
        clamp01(ratio(fst, top)).alias("fst_prime_meirmans"), clamp01(ratio(fst, 1 - hs)).alias("fst_prime_hedrick"), clamp01(F.when(ht > 0, 1 - hs / ht)).alias("gst"), clamp01(gst2).alias("gst2"),
    )


def basic_stats(counts: DataFrame) -> DataFrame:
    """The table of basic statistics: a row for each locus and one named Overall.

    Overall Ho, Hs and Ht are means over loci; overall FIT, FIS and FST are ratios of sums, limited to [0, 1]
    before the primes are formed.
    """
    counts = keep(counts)  # small, and used for the table, its means and the recoded alleles
    stats, top = wc84.locus_stats(counts), wc84.locus_stats(private_alleles(counts))
    own = nei(counts).join(wc84.f_statistics(stats).select("locus", "fst", "fit", "fis"), "locus", "left").join(wc84.f_statistics(top).select("locus", F.col("fst").alias("fst_max")), "locus", "left")
    means = nei(counts).agg(*[F.avg(c).alias(c) for c in ("ho", "hs", "ht")])
    k = counts.agg(F.countDistinct("pop").alias("k"))
    whole = wc84.overall(stats).select(*[clamp01(F.col(c)).alias(c) for c in ("fst", "fit", "fis")])
    row = means.crossJoin(k).crossJoin(whole).crossJoin(wc84.overall(top).select(F.col("fst").alias("fst_max"))).withColumn("locus", F.lit("Overall"))  # one row each
    return _derived(own, "k").unionByName(_derived(row, "k"))
