"""G statistics of differentiation and of linkage disequilibrium."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import valid
from .counts import Keys
from .wc84 import gathered

#: Loci and individuals of a block, of which each two blocks of loci meet in a task.
LOCUS_BLOCK, PEOPLE_BLOCK = 64, 8192


def g_by_locus(counts: DataFrame, keys: Keys = (), min_alleles: int = 1) -> DataFrame:
    """``g, n_geno`` of the population x allele table of each locus; null with one population, under two individuals or under ``min_alleles`` alleles.

    The sum 2 O ln(O / E) is taken apart as 2 (O ln O - ...) by margins, so no cell needs a join with its margins.
    """
    by = [*keys, "locus"]
    rows = gathered(counts, keys).select(*by, "r", "nt", "ol", "rl", F.explode("x").alias("s"))
    alleles = rows.groupBy(*by, F.col("s.allele").alias("allele")).agg(F.sum("s.c").cast("double").alias("col"), *[F.first(v).alias(v) for v in ("r", "nt", "ol", "rl")])
    x = alleles.groupBy(*by).agg(F.sum(F.col("col") * F.log("col")).alias("cl"), F.count("*").alias("k"), *[F.first(v).alias(v) for v in ("r", "nt", "ol", "rl")])
    t = 2.0 * F.col("nt")
    g = 2 * (F.col("ol") - F.col("rl") - F.col("cl") + t * F.log(t))
    # exact zero for what rounding leaves of a table without association
    g = F.when(F.abs(g) < 1e-9, 0.0).otherwise(g)
    return x.select(*by, F.when((F.col("r") >= 2) & (F.col("nt") >= 2) & (F.col("k") >= min_alleles), g).alias("g"), F.col("nt").alias("n_geno"))


def g_overall(g: DataFrame, keys: Keys = ()) -> DataFrame:
    return g.groupBy(*keys).agg(F.sum("g").alias("g"))


def normalised(geno: DataFrame, missing: bool = False) -> DataFrame:
    """``indiv, pop, locus, g``: valid genotypes as text, the lesser allele first; with ``missing`` the others as ``0/0``."""
    if missing:
        g = F.when(valid(), F.concat_ws("/", F.least("a1", "a2"), F.greatest("a1", "a2"))).otherwise("0/0")
        return geno.select("indiv", "pop", "locus", g.alias("g"))
    return geno.filter(valid()).select("indiv", "pop", "locus", F.concat_ws("/", F.least("a1", "a2"), F.greatest("a1", "a2")).alias("g"))


def locus_pairs(geno: DataFrame, missing: bool = False) -> DataFrame:
    """``indiv, pop, locus1, locus2, g1, g2`` for each pair of loci (in name order) that an individual has both of; with ``missing`` a missing genotype is one as any other.

    One aggregation gathers an individual's loci, so each genotype moves once and not once a pair.
    """
    own = normalised(geno, missing).groupBy("indiv", "pop").agg(F.sort_array(F.collect_list(F.struct("locus", "g"))).alias("x"))
    left = own.select("indiv", "pop", "x", F.posexplode("x").alias("i", "one"))
    both = left.select("indiv", "pop", "one", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("two"))
    return both.select("indiv", "pop", F.col("one.locus").alias("locus1"), F.col("two.locus").alias("locus2"), F.col("one.g").alias("g1"), F.col("two.g").alias("g2"))


def ld_g(pairs: DataFrame, keys: Keys = (), every: bool = False) -> DataFrame:
    """``pop, locus1, locus2, n, g``: the G statistic of genotype tables; rows only where a table has two rows, columns and cells at least, or of ``every`` table (0 for the others)."""
    by = [*keys, "pop", "locus1", "locus2"]
    ln = lambda c: F.sum(F.col(c) * F.log(c))
    cells = pairs.groupBy(*by, "g1", "g2").agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy(*by, "g1").agg(F.sum("o").alias("m"), ln("o").alias("ol"), F.collect_list(F.struct("g2", "o")).alias("x"))
    # a table of genotypes is small beside its individuals, so its columns are summed from one row
    whole = rows.groupBy(*by).agg(ln("m").alias("rl"), F.count("*").alias("rows"), F.sum("m").alias("n"), F.sum("ol").alias("ol"), F.flatten(F.collect_list("x")).alias("x"))
    same = ("rl", "rows", "n", "ol", "cells")
    columns = whole.withColumn("cells", F.size("x")).select(*by, *same, F.explode("x").alias("s")).groupBy(*by, F.col("s.g2").alias("g2")).agg(F.sum("s.o").alias("m"), *[F.first(v).alias(v) for v in same])
    x = columns.groupBy(*by).agg(ln("m").alias("cl"), F.count("*").alias("columns"), *[F.first(v).alias(v) for v in same])
    if not every:
        x = x.filter((F.col("rows") > 1) & (F.col("columns") > 1) & (F.col("cells") > 1) & (F.col("n") >= 2))
    g = 2 * (F.col("ol") - F.col("rl") - F.col("cl") + F.col("n") * F.log("n"))
    return x.select(*by, F.col("n").cast("long").alias("n"), F.when(F.abs(g) < 1e-9, 0.0).otherwise(g).alias("g"))


def _coded(t: pd.DataFrame) -> tuple[np.ndarray, dict]:
    """The individuals of a block in order, and for each locus their codes (-1: none) and the genotypes that these stand for."""
    people, row = np.unique(t["indiv"].to_numpy(), return_inverse=True)
    out = {}
    for locus, at in t.groupby("locus").indices.items():
        kinds, code = np.unique(t["g"].to_numpy()[at], return_inverse=True)
        own = np.full(len(people), -1, np.int64)
        own[row[at]] = code
        out[locus] = own, kinds
    return people, out


def _tables(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The genotype tables of each two loci of a pair of blocks, as triples (first, second, individuals)."""
    (pop, _, i, j), out = key, []
    if len(a) and len(b):
        (who, first), (other, second) = _coded(a), _coded(b)
        _, at, bt = np.intersect1d(who, other, assume_unique=True, return_indices=True)
        for x, (u, ku) in first.items():
            for y, (v, kv) in second.items():
                if x == y or i == j and x > y:
                    continue
                p, q = u[at], v[bt]
                ok = (p >= 0) & (q >= 0)
                if not ok.any():
                    continue
                n = np.bincount(p[ok] * len(kv) + q[ok])
                cell = np.flatnonzero(n)
                g1, g2 = ku[cell // len(kv)], kv[cell % len(kv)]
                one, two, g1, g2 = (x, y, g1, g2) if x < y else (y, x, g2, g1)
                out.append((pop, one, two, np.stack([g1, g2, n[cell]], axis=1).ravel()))
    return pd.DataFrame(out, columns=["pop", "locus1", "locus2", "x"])


def table_of(x: np.ndarray) -> np.ndarray:
    """The table that triples (first, second, individuals) stand for; what blocks of individuals have of a cell adds up."""
    first, second, o = np.asarray(x, np.int64).reshape(-1, 3).T
    r, c = (np.unique(v, return_inverse=True)[1] for v in (first, second))
    k = int(c.max()) + 1
    return np.bincount(r * k + c, o, minlength=(int(r.max()) + 1) * k).reshape(-1, k)


def _table_g(x: np.ndarray) -> tuple[int, float, bool]:
    """Individuals, G and whether there are two rows, columns and cells at least."""
    t = table_of(x)
    k = t.shape[1]
    ln = lambda v: float((v[v > 0] * np.log(v[v > 0])).sum())
    n = t.sum()
    g = 2 * (ln(t) - ln(t.sum(axis=1)) - ln(t.sum(axis=0)) + n * np.log(n))
    return int(n), 0.0 if abs(g) < 1e-9 else float(g), t.shape[0] > 1 and k > 1 and n >= 2


def linkage_tables(geno: DataFrame, missing: bool = False) -> DataFrame:
    """``pop, locus1, locus2, x``: the table of each pair of loci in each population, as triples (first genotype, second, individuals).

    Loci and a population's individuals are dealt to blocks by their hash.  Each two blocks of loci meet once for each block of individuals and make
    the tables of their pairs by counting codes, so a genotype is sent once for each block of loci, and no individual becomes a row for each pair.
    """
    packed = F.least("a1", "a2").cast("long") * F.lit(1 << 32) + F.greatest("a1", "a2")
    own = geno.select("indiv", "pop", "locus", F.when(valid(), packed).otherwise(0).alias("g")) if missing else geno.filter(valid()).select("indiv", "pop", "locus", packed.alias("g"))
    many = max(1, -(-(own.agg(F.countDistinct("locus")).first()[0] or 1) // LOCUS_BLOCK))
    sizes = own.groupBy("pop", "locus").agg(F.count("*").alias("n")).groupBy("pop").agg(F.ceil(F.max("n") / PEOPLE_BLOCK).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("indiv"), F.col("_parts")).cast("int")
    block = F.pmod(F.xxhash64("locus"), F.lit(many)).cast("int")
    dealt = own.join(sizes, "pop").select("indiv", "pop", "locus", "g", part.alias("part"), block.alias("own"))
    columns, by = ["indiv", "pop", "locus", "g", "part"], ["pop", "part", "i", "j"]
    left = dealt.select(*columns, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(many - 1))).alias("j"))
    right = dealt.select(*[F.col(c).alias(c) for c in columns], F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    kind = {c: geno.schema[c].dataType.simpleString() for c in ("pop", "locus")}
    front = f"pop {kind['pop']}, locus1 {kind['locus']}, locus2 {kind['locus']}"
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_tables, f"{front}, x array<long>")
    return parts.groupBy("pop", "locus1", "locus2").agg(F.flatten(F.collect_list("x")).alias("x"))


def linkage(geno: DataFrame, missing: bool = False, every: bool = False) -> DataFrame:
    """``ld_g`` of all pairs of loci, by blocks: ``pop, locus1, locus2, n, g``."""
    kind = {c: geno.schema[c].dataType.simpleString() for c in ("pop", "locus")}
    front = f"pop {kind['pop']}, locus1 {kind['locus']}, locus2 {kind['locus']}"

    def run(batches):
        for pdf in batches:
            got = [_table_g(x) for x in pdf["x"]]
            out = pdf[["pop", "locus1", "locus2"]].assign(n=[g[0] for g in got], g=[g[1] for g in got])
            yield out if every else out[np.array([g[2] for g in got], bool)]

    return linkage_tables(geno, missing).mapInPandas(run, f"{front}, n long, g double")


def ld_all(g: DataFrame, keys: Keys = ()) -> DataFrame:
    """The sum over populations of each pair of loci."""
    return g.groupBy(*keys, "locus1", "locus2").agg(F.sum("g").alias("g"), F.count("*").alias("n_pops"))
