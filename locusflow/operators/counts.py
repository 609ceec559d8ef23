"""Genotype and allele counts: the small tables that every estimator starts from.

``keys`` are columns in front of (locus, population): a replicate, a pair, nothing.
All estimators take them, so one definition serves observed, permuted and
resampled data.  Counts combine on the map side; their size depends on loci, populations
and alleles, not on individuals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import valid

Keys = list[str] | tuple[str, ...]


def valid_genotypes(geno: DataFrame, populations: list | None = None, loci: list | None = None) -> DataFrame:
    """Rows with both alleles, of the populations and loci asked for (all by default)."""
    out = geno.filter(valid())
    if populations is not None:
        out = out.filter(F.col("pop").isin(populations))
    return out if loci is None else out.filter(F.col("locus").isin(loci))


def genotype_counts(geno: DataFrame, keys: Keys = ()) -> DataFrame:
    """``n`` and ``n_het`` by population and locus."""
    return geno.filter(valid()).groupBy(*keys, "locus", "pop").agg(F.count("*").alias("n"), F.sum((F.col("a1") != F.col("a2")).cast("long")).alias("n_het"))


def allele_counts(geno: DataFrame, keys: Keys = (), weight: str | None = None) -> DataFrame:
    """``c`` copies and ``h`` heterozygous carriers of each allele by population and locus; ``weight`` counts a row that often."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    copies = geno.filter(valid()).select(*keys, "locus", "pop", F.when(F.col("a1") != F.col("a2"), w).otherwise(F.lit(0).cast("long")).alias("h"), w.alias("w"), F.explode(F.array("a1", "a2")).alias("allele"))
    return copies.groupBy(*keys, "locus", "pop", "allele").agg(F.sum("w").alias("c"), F.sum("h").alias("h"))


def pop_locus(counts: DataFrame, keys: Keys = ()) -> DataFrame:
    """``n``, ``n_het`` and ``sp2`` (sum of squared allele frequencies) by population and locus, from allele counts alone."""
    c2 = F.sum(F.col("c").cast("double") * F.col("c"))
    total = F.sum("c")
    return counts.groupBy(*keys, "locus", "pop").agg((total / 2).cast("long").alias("n"), (F.sum("h") / 2).cast("long").alias("n_het"), (c2 / (total.cast("double") * total)).alias("sp2"))


def missing_by_pop_locus(geno: DataFrame) -> DataFrame:
    """Sample size, missing and genotyped cells and the missing proportion by population and locus (a row with only ``gt > 0`` asked for)."""
    ok = F.sum((F.col("a1") > 0).cast("long"))
    return geno.groupBy("pop", "locus").agg(F.count("*").alias("sample_size"), ok.alias("genotyped")).select("pop", "locus", "sample_size", (F.col("sample_size") - F.col("genotyped")).alias("missing"), "genotyped", (1 - F.col("genotyped") / F.col("sample_size")).alias("missing_share"))


def pop_sizes(geno: DataFrame) -> DataFrame:
    """Distinct individuals by population."""
    return geno.groupBy("pop").agg(F.countDistinct("indiv").alias("sample_size"))


def overview(geno: DataFrame) -> DataFrame:
    """One row: individuals, populations, loci, cells, and missing cells."""
    return geno.agg(F.countDistinct("indiv").alias("n_individuals"), F.countDistinct("pop").alias("n_pops"), F.countDistinct("locus").alias("n_loci"), F.count("*").alias("n_cells"), F.sum((~valid()).cast("long")).alias("n_missing"))


def complete_individuals(geno: DataFrame) -> DataFrame:
    """The rows of individuals that are genotyped at every locus."""
    ok = geno.filter(valid())
    n = ok.agg(F.countDistinct("locus").alias("n_loci"))
    full = ok.groupBy("indiv").agg(F.countDistinct("locus").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n_loci")).select("indiv")  # one row
    return ok.join(full, "indiv", "left_semi")


def locus_order(geno: DataFrame) -> DataFrame:
    """``locus, first_seen``: loci in the order of the first individual that has them."""
    return geno.groupBy("locus").agg(F.min("indiv").alias("first_seen"))


def pop_codes(geno: DataFrame) -> DataFrame:
    """``pop, pop_code``: dense ranks of the sorted populations (a table of populations, however many individuals)."""
    from pyspark.sql.window import Window

    return geno.select("pop").distinct().select("pop", F.dense_rank().over(Window.orderBy("pop")).alias("pop_code"))


def pairs_template(geno: DataFrame) -> DataFrame:
    """All pairs of populations ``pop1 < pop2`` with an empty distance."""
    pops = geno.select("pop").distinct()
    a, b = pops.select(F.col("pop").alias("pop1")), pops.select(F.col("pop").alias("pop2"))
    return a.join(b, F.col("pop1") < F.col("pop2")).withColumn("distance", F.lit(None).cast("double"))


def update_counts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds the allele counts of new individuals to stored ones; counts are additive."""
    by = [c for c in stored.columns if c not in ("c", "h")]
    return stored.unionByName(fresh).groupBy(*by).agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
