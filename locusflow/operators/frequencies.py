"""Allele frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_table(geno: DataFrame, population=None, marker=None) -> DataFrame:
    """A row for each population, marker and allele that the marker has anywhere (zero where the population lacks it).

    Only the first allele must be there (a1 > 0), as in the packed test gt > 0.  He is biased, Ne = 1 / sum p**2,
    Fis = (He - Ho) / He; frequencies have 4 decimals, diversities 3.
    """
    own = geno
    if population is not None:
        own = own.filter(F.col("pop") == population)
    if marker is not None:
        own = own.filter(F.col("locus") == marker)
    ok = own.filter("a1 > 0")
    counts = ok.select("pop", "locus", F.explode(F.array("a1", "a2")).alias("allele")).groupBy("pop", "locus", "allele").agg(F.count("*").alias("count"))
    universe, pops = counts.select("locus", "allele").distinct(), counts.select("pop").distinct()
    grid = pops.crossJoin(universe)  # populations x alleles is the asked-for result
    total = counts.groupBy("pop", "locus").agg(
        F.sum("count").alias("n_alleles"), F.count("*").alias("na"), (F.sum("count").cast("double") * F.sum("count") / F.sum(F.col("count").cast("double") * F.col("count"))).alias("ne")
    )
    het = own.groupBy("pop", "locus").agg(F.sum((F.col("a1") > 0).cast("long")).alias("n_genotyped"), F.sum((~(F.col("a1") > 0)).cast("long")).alias("n_missing"), F.sum(((F.col("a1") > 0) & (F.col("a1") != F.col("a2"))).cast("long")).alias("n_het"))
    x = grid.join(counts, ["pop", "locus", "allele"], "left").join(total, ["pop", "locus"], "left").join(het, ["pop", "locus"], "left")
    he, ho = 1 - 1 / F.col("ne"), F.when(F.col("n_genotyped") > 0, F.col("n_het") / F.col("n_genotyped"))
    n = F.coalesce(F.col("count"), F.lit(0).cast("long"))
    return x.select(
        "pop", F.col("locus").alias("marker"), F.col("allele").cast("string").alias("allele"), F.round(F.coalesce(n / F.col("n_alleles"), F.lit(0.0)), 4).alias("frequency"), n.alias("count"),
        F.coalesce("n_alleles", F.lit(0).cast("long")).alias("n_alleles"), "n_genotyped", "n_missing", "na", F.round("ne", 3).alias("ne"), F.round(he, 3).alias("he"), F.round(ho, 3).alias("ho"), F.round(F.when(he > 0, (he - ho) / he), 3).alias("fis"),
    )


def wide_report(long: DataFrame, populations: list | None = None) -> DataFrame:
    """Text rows by marker: sample sizes, allele frequencies (with a global column) and diversities, a column ``p<pop>`` each.

    ``row_type`` is stat, allele or div_stat; ``position`` orders the rows of a marker.
    """
    if populations is None:
        populations = [r["pop"] for r in long.select("pop").distinct().orderBy("pop").collect()]  # populations become columns
    one = long.groupBy("marker", "pop").agg(*[F.first(c).alias(c) for c in ("n_genotyped", "n_missing", "na", "ne", "he", "ho", "fis")])
    three = lambda c: F.format_string("%.3f", F.col(c))
    stats = [("stat", "N genotyped", 1, F.col("n_genotyped").cast("string")), ("stat", "N missing", 2, F.col("n_missing").cast("string")), ("div_stat", "Na", 1001, F.col("na").cast("string")), *(("div_stat", s, 1001 + i, F.when(F.col(s.lower()).isNotNull(), three(s.lower()))) for i, s in enumerate(("Ne", "He", "Ho", "Fis"), 1))]
    rows = one.select("marker", "pop", F.explode(F.array(*[F.struct(F.lit(t).alias("row_type"), F.lit(n).alias("row_label"), F.lit(float(p)).alias("position"), v.alias("v")) for t, n, p, v in stats])).alias("s")).select("marker", "pop", "s.*")
    alleles = long.select("marker", "pop", F.lit("allele").alias("row_type"), F.col("allele").alias("row_label"), (F.lit(3.0) + F.col("allele").cast("double") / 1e9).alias("position"), F.format_string("%.4f", F.col("frequency")).alias("v"))
    by = ["marker", "row_type", "row_label", "position"]
    wide = rows.unionByName(alleles).withColumn("name", F.concat(F.lit("p"), F.col("pop").cast("string"))).groupBy(*by).pivot("name", [f"p{p}" for p in populations]).agg(F.first("v"))
    whole = long.groupBy("marker", F.col("allele").alias("row_label")).agg(F.sum("count").alias("n"))
    share = whole.join(whole.groupBy("marker").agg(F.sum("n").alias("t")), "marker").select("marker", F.lit("allele").alias("row_type"), "row_label", F.format_string("%.4f", F.col("n") / F.col("t")).alias("global"))
    sizes = one.groupBy("marker").agg(F.sum("n_genotyped").alias("g"), F.sum("n_missing").alias("m")).select("marker", F.lit("stat").alias("row_type"), F.explode(F.create_map(F.lit("N genotyped"), F.col("g").cast("string"), F.lit("N missing"), F.col("m").cast("string"))).alias("row_label", "global"))
    return wide.join(share.unionByName(sizes), ["marker", "row_type", "row_label"], "left").select(*by, *[F.coalesce(f"p{p}", F.lit("")).alias(f"p{p}") for p in populations], F.coalesce("global", F.lit("")).alias("global"))
