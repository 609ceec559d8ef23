"""Whole analyses: each takes genotypes (``indiv, pop, locus, a1, a2``) and returns the table that a user reads.

Counts, observed, permuted and resampled, are cached: statistics by locus and over all start from them.  ``release`` frees them
when the tables have been read.  ``engine`` names the draws (see ``kernel``): the default holds at any size; the registered queries of few replicates ask for
``auto``, whose draws SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cache import keep, release
from ..operators import counts, diversity, gstat, inference, kernel, mantel, nulls, resample, wc84
from .resample_queries import locus_bootstrap, with_overall


def _overall(df: DataFrame, keys: list[str], value: Column, name: str, id_col: str = "id") -> DataFrame:
    return df.groupBy(*keys).agg(value.alias(name)).withColumn(id_col, F.lit("Overall"))


def _assemble(obs: DataFrame, boot: DataFrame, perm: DataFrame, value: str, conf: float, alternative: str = "two_sided_abs", rule: str = "type7", least: int = 0) -> DataFrame:
    """id, observed, boot_mean, boot_median, ci_l, ci_u, p_value from tables with id and value (replicates have rep)."""
    ci = inference.interval(boot, ["id"], value, conf, rule)
    enough = F.col("n") >= least
    ci = ci.select("id", "boot_mean", "boot_median", *[F.when(enough, F.col(c)).alias(c) for c in ("ci_l", "ci_u")])
    p = inference.p_values(perm, obs, ["id"], value, alternative).select("id", "p_value")
    return obs.select("id", F.col(value).alias("observed")).join(ci, "id", "left").join(p, "id", "left")


def fis_by_pop(geno: DataFrame, n_perm: int, n_boot: int, seed=1, conf: float = 0.95, consistent: bool = False, engine: str = "kernel") -> DataFrame:
    """FIS of each population, and Overall: the plain mean over populations (with ``consistent`` the ratio of sums)."""
    c = keep(counts.allele_counts(geno))
    perm, boot = keep(kernel.permuted_counts(geno, n_perm, seed, "alleles_within", engine)), keep(kernel.bootstrap_individual_counts(geno, n_boot, seed, engine))

    def table(x: DataFrame, keys: list[str]) -> DataFrame:
        own = wc84.fis_by_pop(x, keys).select(*keys, F.col("pop").cast("string").alias("id"), "fis")
        whole = wc84.fis_overall(x, keys).withColumn("id", F.lit("Overall")) if consistent else _overall(own, keys, F.avg("fis"), "fis")
        return own.unionByName(whole.select(*keys, "id", "fis"))

    return _assemble(table(c, []), table(boot, ["rep"]), table(perm, ["rep"]), "fis", conf)


def fis_by_locus(geno: DataFrame, n_perm: int, n_boot: int, seed=1, conf: float = 0.95, engine: str = "kernel") -> DataFrame:
    """FIS of each locus with floor-index intervals over individuals; Overall is the ratio of sums."""
    c = keep(counts.allele_counts(geno))
    perm, boot = keep(kernel.permuted_counts(geno, n_perm, seed, "alleles_within", engine)), keep(kernel.bootstrap_individual_counts(geno, n_boot, seed, engine))

    def table(x: DataFrame, keys: list[str]) -> DataFrame:
        return wc84.fis_by_locus(x, keys).select(*keys, F.col("locus").alias("id"), "fis").unionByName(wc84.fis_overall(x, keys).select(*keys, F.lit("Overall").alias("id"), "fis"))

    return _assemble(table(c, []), table(boot, ["rep"]), table(perm, ["rep"]), "fis", conf, rule="floor")


def fis_pop_block(geno: DataFrame, n_boot: int, seed=1, conf: float = 0.95) -> DataFrame:
    """Intervals of FIS by locus and Overall over drawn populations."""
    x = resample.bootstrap_populations(counts.allele_counts(geno), n_boot, seed)
    return inference.interval(with_overall(wc84.fis_by_locus(x, ["rep"]), wc84.fis_overall(x, ["rep"]), "fis"), ["locus"], "fis", conf, "floor")


def fit_analysis(geno: DataFrame, n_perm: int, n_boot: int, seed=1, conf: float = 0.95, consistent: bool = False, engine: str = "kernel") -> DataFrame:
    """FIT of each locus, and Overall: observed and permuted as a ratio of sums, resampled as the mean over loci (``consistent``: a ratio too)."""
    c = keep(counts.allele_counts(geno))
    perm = kernel.permuted_counts(geno, n_perm, seed, "alleles_global", engine)

    def table(stats: DataFrame, keys: list[str], mean: bool) -> DataFrame:
        own = wc84.f_statistics(stats).select(*keys, F.col("locus").alias("id"), "fit")
        whole = _overall(own, keys, F.avg("fit"), "fit") if mean else wc84.overall(stats, keys).withColumn("id", F.lit("Overall"))
        return own.unionByName(whole.select(*keys, "id", "fit"))

    perm, boot = keep(wc84.locus_stats(perm, ["rep"])), keep(kernel.bootstrap_locus_stats(c, n_boot, seed))
    return _assemble(table(wc84.locus_stats(c), [], False), table(boot, ["rep"], not consistent), table(perm, ["rep"], False), "fit", conf, least=10)


def fst_analysis(geno: DataFrame, n_perm: int, n_boot: int, seed=1, conf: float = 0.95, engine: str = "kernel") -> DataFrame:
    """FST of each locus and Overall (ratio of sums), intervals over drawn populations, p-values of G under shuffled population labels."""
    c = keep(counts.allele_counts(geno))
    perm, boot = keep(kernel.permute(geno, n_perm, seed, "labels", engine)), keep(kernel.bootstrap_locus_stats(c, n_boot, seed))

    def fst(stats: DataFrame, keys: list[str]) -> DataFrame:
        return wc84.f_statistics(stats).select(*keys, F.col("locus").alias("id"), "fst").unionByName(wc84.overall(stats, keys).select(*keys, F.lit("Overall").alias("id"), "fst"))

    def g(own: DataFrame, keys: list[str]) -> DataFrame:
        return own.select(*keys, F.col("locus").alias("id"), "g").unionByName(gstat.g_overall(own, keys).select(*keys, F.lit("Overall").alias("id"), "g"))

    ci = inference.interval(fst(boot, ["rep"]), ["id"], "fst", conf).select("id", "boot_mean", "boot_median", "ci_l", "ci_u")
    p = inference.p_values(g(perm, ["rep"]), g(gstat.g_by_locus(c), []), ["id"], "g").select("id", "p_value")
    return fst(wc84.locus_stats(c), []).withColumnRenamed("fst", "observed").join(ci, "id", "left").join(p, "id", "left")


def locus_table(geno: DataFrame, n_boot: int, seed=1, conf: float = 0.95) -> DataFrame:
    return locus_bootstrap(wc84.locus_stats(counts.allele_counts(geno)), n_boot, seed, conf)


def hs_tables(geno: DataFrame, n_boot: int, seed=1, conf: float = 0.95, engine: str = "kernel") -> DataFrame:
    """``unit, statistic, id``, observed, boot_mean, boot_se, ci_l, ci_u: HS over individuals, HS and HT over populations, by locus and Overall."""
    c = keep(counts.allele_counts(geno))
    obs = wc84.locus_stats(c)
    people = keep(wc84.hs_per_locus(counts.pop_locus(kernel.bootstrap_individual_counts(geno, n_boot, seed, engine), ["rep"]), ["rep"]))
    pops = keep(kernel.bootstrap_locus_stats(c, n_boot, seed))

    def long(x: DataFrame, keys: list[str], value: str) -> DataFrame:
        own = x.select(*keys, F.col("locus").alias("id"), F.col(value).alias("v"))
        return own.unionByName(_overall(own, keys, F.avg("v"), "v").select(*keys, "id", "v"))

    parts = [("individuals", "HS", long(obs, [], "hs"), long(people, ["rep"], "hs")), ("populations", "HS", long(obs, [], "hs"), long(pops, ["rep"], "hs")), ("populations", "HT", long(obs, [], "ht"), long(pops, ["rep"], "ht"))]
    out = None
    for unit, name, own, boot in parts:
        one = own.withColumnRenamed("v", "observed").join(inference.interval(boot, ["id"], "v", conf).select("id", "boot_mean", "boot_se", "ci_l", "ci_u"), "id", "left").select(F.lit(unit).alias("unit"), F.lit(name).alias("statistic"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def ld_matrix(geno: DataFrame, n_perm: int, seed=1, engine: str = "auto") -> DataFrame:
    """p-values of each pair of loci: a column ``p<pop>`` for each population, and ``All``."""
    p = kernel.ld_p_values(geno, n_perm, seed, engine)  # engine margins: tables of any size
    pops = [r["pop"] for r in geno.select(F.col("pop").cast("string").alias("pop")).distinct().orderBy("pop").collect()]  # populations become columns
    name = F.when(F.col("pop") == "All", "All").otherwise(F.concat(F.lit("p"), F.col("pop")))
    return p.withColumn("name", name).groupBy("locus1", "locus2").pivot("name", [*[f"p{x}" for x in pops], "All"]).agg(F.first("p_value"))


def _p_values(matrix: DataFrame) -> tuple[Column, Column]:
    """The p-values of a row, and the least (1 without any)."""
    values = F.filter(F.array(*[c for c in matrix.columns if c not in ("locus1", "locus2")]), lambda x: x.isNotNull())
    return values, F.coalesce(F.array_min(values), F.lit(1.0)).alias("min_p")


def ld_summary(matrix: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Of each pair: the least p, how many are below alpha, and the mean, over populations and All; pairs without any have p 1."""
    values, least = _p_values(matrix)
    n = F.size(values)
    return matrix.select("locus1", "locus2", least, F.size(F.filter(values, lambda x: x < alpha)).alias("n_significant"), F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).alias("mean_p"))


def ld_filtered(matrix: DataFrame, below: float | None = None) -> DataFrame:
    """Rows whose least p is below the limit, the least first."""
    x = matrix.select("*", _p_values(matrix)[1])
    return (x if below is None else x.filter(F.col("min_p") < below)).orderBy("min_p", "locus1", "locus2")


def null_alleles(geno: DataFrame, treatments: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a null-allele analysis by name; the EM runs once."""
    table = keep(nulls.em_table(geno, treatments))
    sizes, rows = nulls.inputs(table)
    pair, chord, whole = nulls.pairwise_components(sizes, rows), nulls.pairwise_chord(sizes, rows), nulls.both(sizes, rows, ["locus"])
    return {"t1": nulls.t1(table, treatments), "t2": nulls.t2(table, treatments), "global": nulls.fst_pooled(whole, []), "by_locus": nulls.fst_by_locus(whole), "pairs": nulls.fst_pooled(pair, ["pop1", "pop2"]).join(nulls.chord_pooled(chord), ["pop1", "pop2"]), "fst_by_locus_pair": nulls.fst_locus_pair(pair), "dcse_by_locus_pair": chord}


def null_summary(t1: DataFrame) -> DataFrame:
    """The mean and the largest null frequency."""
    return t1.agg(F.avg("p_nulls").alias("mean_p_nulls"), F.max("p_nulls").alias("max_p_nulls"))


def filter_pairs(table: DataFrame, locus=None, population=None) -> DataFrame:
    """Rows of a locus, and of a population on either side."""
    out = table if locus is None else table.filter(F.col("locus") == locus)
    return out if population is None else out.filter((F.col("pop1") == population) | (F.col("pop2") == population))


def summary_scalars(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Of a table with observed, p_value and ci columns: loci defined, significant ones, mean interval width, and 1 - p (a proxy of power)."""
    own = table.filter(F.col("id") != "Overall")
    return own.agg(F.count("*").alias("n_loci"), (F.count("observed") / F.count("*")).alias("share_defined"), F.sum((F.col("p_value") < alpha).cast("long")).alias("n_significant"), F.avg(F.col("ci_u") - F.col("ci_l")).alias("mean_ci_width"), F.avg(1 - F.col("p_value")).alias("mean_power_proxy"))


__all__ = ["fis_by_pop", "fis_by_locus", "fis_pop_block", "fit_analysis", "fst_analysis", "locus_table", "hs_tables", "ld_matrix", "ld_summary", "ld_filtered", "null_alleles", "null_summary", "filter_pairs", "summary_scalars", "diversity", "mantel", "release"]
