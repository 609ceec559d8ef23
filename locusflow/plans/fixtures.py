"""Genotypes derived from the ``customer`` table, the same in Spark and in SQL.

Six loci, 3 + l alleles at locus l; individuals are customers, populations nations.
A twentieth of the cells is missing: the row is there with alleles 0/0, or with 999/999
(a null homozygote) in the variant for null alleles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uniform

N_LOCI = 6


def genotypes(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """``indiv, pop, locus, a1, a2``; with ``nulls`` half of the missing cells are 999/999."""
    # a file of customers is small beside what is made of it: individuals are dealt to all cores first, and stay together
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("indiv"), F.col("c_nationkey").alias("pop")).repartition("indiv")
    cells = people.withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(N_LOCI))))
    k = F.col("l") + 3

    def allele(h: str):
        u = uniform(F.col("indiv"), F.col("l"), h)
        return F.when(u % 4 == 0, F.lit(101) + (F.col("pop") + F.col("l")) % k).otherwise(F.lit(101) + F.floor(u / 4) % k).cast("int")

    missing = uniform(F.col("indiv"), F.col("l"), "m") % 20 == 0
    coded = (uniform(F.col("indiv"), F.col("l"), "n") % 2 == 0) if nulls else F.lit(False)
    first = allele("a")
    second = F.when(uniform(F.col("indiv"), F.col("l"), "f") % 5 == 0, first).otherwise(allele("b"))
    blank = F.when(coded, F.lit(999)).otherwise(F.lit(0))
    return cells.select("indiv", "pop", F.concat(F.lit("L"), F.col("l")).alias("locus"), F.when(missing, blank).otherwise(first).alias("a1"), F.when(missing, blank).otherwise(second).alias("a2"))


def coordinates(geno: DataFrame) -> DataFrame:
    """``pop, lat, lon``: a point for each population."""
    return geno.select("pop").distinct().select("pop", (F.lit(10.0) + (F.col("pop") * 37 % 97) * 0.1).alias("lat"), (F.lit(5.0) + (F.col("pop") * 53 % 89) * 0.1).alias("lon"))


SQL = """
geno AS (SELECT indiv, pop, locus, CASE WHEN m THEN 0 ELSE a1 END AS a1, CASE WHEN m THEN 0 ELSE a2 END AS a2, m AND n AS coded FROM (
  SELECT indiv, pop, 'L' || l AS locus, a1, CASE WHEN uf % 5 = 0 THEN a1 ELSE 101 + CASE WHEN ub % 4 = 0 THEN (pop + l) % (3 + l) ELSE (ub // 4) % (3 + l) END END AS a2, um % 20 = 0 AS m, un % 2 = 0 AS n FROM (
    SELECT *, 101 + CASE WHEN ua % 4 = 0 THEN (pop + l) % (3 + l) ELSE (ua // 4) % (3 + l) END AS a1 FROM (
      SELECT c_custkey AS indiv, c_nationkey AS pop, l, U(c_custkey, l, 'a') AS ua, U(c_custkey, l, 'b') AS ub, U(c_custkey, l, 'f') AS uf, U(c_custkey, l, 'm') AS um, U(c_custkey, l, 'n') AS un
      FROM customer, range(1, 7) t(l))))),
valid AS (SELECT indiv, pop, locus, a1::INT AS a1, a2::INT AS a2 FROM geno WHERE a1 > 0 AND a2 > 0)
"""
