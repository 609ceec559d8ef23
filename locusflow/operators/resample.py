"""Permutations and bootstraps as relational operators.

Shuffles order rows by md5(seed | replicate | id), draws are md5 numbers modulo the number of
choices: reproducible on any cluster, whatever the partitioning, and in any
engine.  A shuffle is a ranking; where the largest stratum has over ``RANK_ROWS`` rows, ``ranked`` takes it apart by the first hex
digits of the key, so that no task sorts a whole stratum: ranks within a
bucket, plus the rows of the buckets before it.

Replicates are a key column (``rep``) of the same estimators that serve the observed
data.  Population and locus bootstraps resample counts, not genotypes; individual
bootstraps weigh rows by how often they were drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import order_key, uniform, valid
from .counts import allele_counts

#: Rows of a stratum that one task may rank.
RANK_ROWS = 1_000_000


def replicates(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(1, n + 1).withColumnRenamed("id", "rep")


def digits_for(rows: int) -> int:
    """Hex digits of the key that cut a stratum of so many rows into buckets of RANK_ROWS at most, on average."""
    digits = 0
    while rows > RANK_ROWS * 16**digits:
        digits += 1
    return digits


def ranked(df: DataFrame, by: list[str], key: str, tie: list[str], name: str, digits: int = 0) -> DataFrame:
    """Adds the rank (from 1) of ``key``, then ``tie``, within ``by``; ``key`` is lower-case hex text of fixed length."""
    if not digits:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key, *tie)).cast("long"))
    b = df.withColumn("_bucket", F.substring(key, 1, digits))
    sizes = b.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(key, *tie))
    return b.withColumn("_nth", nth).join(before, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_nth")).drop("_bucket", "_nth", "_before")


def _digits(df: DataFrame, by: list[str], digits: int | None) -> int:
    """As given, else by the size of the largest stratum, which is counted."""
    if digits is not None:
        return digits
    top = (df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")) if by else df.agg(F.count("*"))).first()[0]
    return digits_for(top or 0)


def _hex(x: Column) -> Column:
    """A long of 0 or more as fixed-length hex, in the same order."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def _individuals(geno: DataFrame) -> DataFrame:
    return geno.select("indiv", "pop").distinct()


def shuffled_labels(geno: DataFrame, n: int, seed: int | str = 1, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The place ``_r`` of each ``indiv``, and the population that each ``rep`` has there."""
    people = _individuals(geno)
    digits = _digits(people, [], digits)
    places = ranked(people.withColumn("_k", _hex(F.col("indiv"))).withColumn("_one", F.lit(1)), ["_one"], "_k", ["indiv"], "_r", digits).select("_r", "indiv")
    shuffled = people.crossJoin(F.broadcast(replicates(geno, n))).withColumn("_k", order_key(seed, F.col("rep"), F.col("indiv")))
    return places, ranked(shuffled, ["rep"], "_k", ["indiv"], "_r", digits).select("rep", "pop", "_r")


def permute_labels(geno: DataFrame, n: int, seed: int | str = 1, digits: int | None = None) -> DataFrame:
    """Genotypes with population labels shuffled over all individuals, a copy for each replicate."""
    places, shuffled = shuffled_labels(geno, n, seed, digits)
    labels = shuffled.join(places, "_r").select("rep", "indiv", "pop")
    return geno.drop("pop").join(labels, "indiv").select("rep", "indiv", "pop", "locus", "a1", "a2")


def permute_alleles(geno: DataFrame, n: int, seed: int | str = 1, within_pop: bool = True, digits: int | None = None) -> DataFrame:
    """Genotypes with allele copies shuffled within population and locus (or within locus), a copy for each replicate.

    Copies fall on the same places (individuals in order, two each), so genotypes stay where they were.  Only
    valid genotypes take part.
    """
    by = ["locus", "pop"] if within_pop else ["locus"]
    ok = geno.filter(valid())
    digits = _digits(ok, by, digits)
    copies = ok.select("indiv", *(["pop"] if within_pop else []), "locus", F.posexplode(F.array("a1", "a2")).alias("copy", "allele"))
    places = ranked(ok.select("indiv", "pop", "locus").withColumn("_k", _hex(F.col("indiv"))), by, "_k", ["indiv"], "_p", digits)
    shuffled = copies.crossJoin(F.broadcast(replicates(geno, n))).withColumn("_k", order_key(seed, F.col("rep"), F.col("locus"), F.col("indiv"), F.col("copy")))
    shuffled = ranked(shuffled, ["rep", *by], "_k", ["indiv", "copy"], "_r", digits)
    pairs = shuffled.withColumn("_p", F.floor((F.col("_r") + 1) / 2)).groupBy("rep", *by, "_p").agg(F.max(F.when(F.col("_r") % 2 == 1, F.col("allele"))).alias("a1"), F.max(F.when(F.col("_r") % 2 == 0, F.col("allele"))).alias("a2"))
    return pairs.join(places, [*by, "_p"]).select("rep", "indiv", "pop", "locus", "a1", "a2")


def _numbered(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their place (from 0) in order: populations or loci, a small dimension."""
    return values.select(column).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("long").alias("_at"))


def draw(values: DataFrame, column: str, n: int, seed: int | str) -> DataFrame:
    """``rep, slot`` and the value drawn, with replacement, as many slots as there are distinct values."""
    own = _numbered(values, column)
    size = own.agg(F.count("*").alias("_size"))  # one row
    slots = own.select((F.col("_at") + 1).alias("slot")).crossJoin(F.broadcast(replicates(values, n))).crossJoin(F.broadcast(size))
    slots = slots.select("rep", "slot", (uniform(seed, F.col("rep"), F.col("slot")) % F.col("_size")).alias("_at"))
    return slots.join(own, "_at").select("rep", "slot", column)


def bootstrap_populations(counts: DataFrame, n: int, seed: int | str = 1) -> DataFrame:
    """Allele counts by replicate; each drawn population is a population of its own (``pop`` is the slot)."""
    slots = draw(counts, "pop", n, seed)
    return counts.join(slots, "pop").select("rep", "locus", F.col("slot").alias("pop"), "allele", "c", "h")


def bootstrap_individuals(geno: DataFrame, n: int, seed: int | str = 1, digits: int | None = None) -> DataFrame:
    """Allele counts by replicate of individuals drawn within their population, as many as it has."""
    digits = _digits(_individuals(geno), ["pop"], digits)
    people = ranked(_individuals(geno).withColumn("_k", _hex(F.col("indiv"))), ["pop"], "_k", ["indiv"], "_r", digits)
    sizes = people.groupBy("pop").agg(F.count("*").alias("_size"))
    slots = people.select("pop", F.col("_r").alias("slot")).join(sizes, "pop").crossJoin(F.broadcast(replicates(geno, n)))
    drawn = slots.select("rep", "pop", (uniform(seed, F.col("rep"), F.col("pop"), F.col("slot")) % F.col("_size") + 1).alias("_r")).groupBy("rep", "pop", "_r").agg(F.count("*").alias("_w"))
    weights = drawn.join(people.select("pop", "_r", "indiv"), ["pop", "_r"]).select("rep", "indiv", "_w")
    return allele_counts(geno.join(weights, "indiv"), ["rep"], weight="_w")


def bootstrap_loci(rows: DataFrame, n: int, seed: int | str = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of drawn loci, by replicate and slot; with ``by`` (such as a pair of populations) all groups share the draws."""
    return draw(rows, "locus", n, seed).join(rows, "locus")


def permute_pairs(pairs: DataFrame, n: int, seed: int | str = 1, digits: int | None = None) -> DataFrame:
    """Pairs of genotypes (see ``gstat.locus_pairs``) with the second locus shuffled within population, apart for each pair of loci."""
    by = ["pop", "locus1", "locus2"]
    digits = _digits(pairs, by, digits)
    places = ranked(pairs.withColumn("_k", _hex(F.col("indiv"))), by, "_k", ["indiv"], "_r", digits).select(*by, "_r", "indiv", "g1")
    moved = pairs.select(*by, "indiv", "g2").crossJoin(F.broadcast(replicates(pairs, n))).withColumn("_k", order_key(seed, F.col("rep"), F.col("locus1"), F.col("locus2"), F.col("indiv")))
    moved = ranked(moved, ["rep", *by], "_k", ["indiv"], "_r", digits).select("rep", *by, "_r", "g2")
    return moved.join(places, [*by, "_r"]).select("rep", "indiv", *by, "g1", "g2")
