"""Replicates drawn from margins: tables of counts, however many individuals they were counted from.

Shuffling the allele copies of a population leaves its allele counts, so only homozygotes change; shuffling them over all populations leaves
the alleles' totals and the populations' sizes.  What such a shuffle does to the counts is drawn by hypergeometric
variables, one after another, so its cost grows with populations x alleles.

A locus is one row with the counts of all its populations.  Rows are dealt by locus and chunk of replicates, and a
generator is keyed by (seed, scheme, locus, chunk): results don't depend on how the work is dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import allele_counts
from .gstat import linkage_tables, table_of

#: Replicates of a chunk, and tasks at most.
CHUNK, MAX_TASKS = 64, 10_000
#: Replicates of a chunk of linkage tables, and bytes of tables that are drawn at once: a call for few replicates costs more than its draws.
LINKAGE_CHUNK, TABLE_BYTES = 512, 64 << 20
STATISTICS = ("fst", "fit", "fis", "g")


def generator(*key) -> np.random.Generator:
    """Philox, keyed by the text of the parts."""
    digest = hashlib.md5("|".join(map(str, key)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def tables(rng: np.random.Generator, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """n x rows x columns: random tables with the given margins, as dealing the columns' copies to the rows' places would make them."""
    left = np.tile(np.asarray(columns, np.int64), (n, 1))
    out = np.zeros((n, len(rows), left.shape[1]), np.int64)
    for i, size in enumerate(rows):
        want, rest = np.full(n, size, np.int64), left.sum(axis=1)
        for j in range(left.shape[1]):
            rest = rest - left[:, j]
            out[:, i, j] = rng.hypergeometric(left[:, j], rest, want)
            want = want - out[:, i, j]
        left -= out[:, i]
    return out


def homozygotes(rng: np.random.Generator, copies: np.ndarray) -> np.ndarray:
    """How many genotypes have an allele twice when the copies (last axis: alleles; an even sum) are paired at random.

    Copies of one allele fall into the places of genotypes that are half filled and of those that are empty; of the latter, some fill both places.
    """
    half, empty = np.zeros(copies.shape[:-1], np.int64), copies.sum(axis=-1) // 2
    out = np.zeros_like(copies)
    for j in range(copies.shape[-1]):
        into = rng.hypergeometric(half, 2 * empty, copies[..., j])
        fresh = copies[..., j] - into
        first = rng.hypergeometric(empty, empty, fresh)
        both = rng.hypergeometric(first, empty - first, fresh - first)
        out[..., j] = both
        half, empty = half - into + fresh - 2 * both, empty - fresh + both
    return out


def statistics(c: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """FST, FIT, FIS and G of each replicate from copies (replicates x populations x alleles) and heterozygous carriers (replicates x alleles); NaN where they aren't defined."""
    n = c.sum(axis=2) / 2.0
    r, total = (n > 0).sum(axis=1), n.sum(axis=1)
    column = c.sum(axis=1)
    xlogx = lambda x: np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)
    g = 2 * (xlogx(c.astype(float)).sum(axis=(1, 2)) - xlogx(2 * n).sum(axis=1) - xlogx(column.astype(float)).sum(axis=1) + xlogx(2 * total))
    g = np.where(np.abs(g) < 1e-9, 0.0, g)
    with np.errstate(divide="ignore", invalid="ignore"):
        nbar, nc = total / r, (total - (n * n).sum(axis=1) / total) / (r - 1)
        p = column / (2 * total)[:, None]
        freq = np.where(n[:, :, None] > 0, c / (2 * n)[:, :, None], 0.0)
        s2 = (n[:, :, None] * (freq - p[:, None, :]) ** 2).sum(axis=1) / ((r - 1) * nbar)[:, None]
        hbar = h / total[:, None]
        core = p * (1 - p) - ((r - 1) / r)[:, None] * s2
        a = ((nbar / nc)[:, None] * (s2 - (core - hbar / 4) / (nbar - 1)[:, None])).sum(axis=1)
        b = ((nbar / (nbar - 1))[:, None] * (core - ((2 * nbar - 1) / (4 * nbar))[:, None] * hbar)).sum(axis=1)
        w = hbar.sum(axis=1) / 2
        whole = a + b + w
        enough = (r >= 2) & (total >= 2)
        ok = enough & (nc > 0) & (nbar > 1) & (whole > 0)
        nan = np.nan
        return {"fst": np.where(ok, a / whole, nan), "fit": np.where(ok, (a + b) / whole, nan), "fis": np.where(ok & (b + w > 0), b / (b + w), nan), "g": np.where(enough, g, nan)}


def by_locus(counts: DataFrame) -> DataFrame:
    """``locus, x``: the (pop, allele, c) of each locus in order; populations are text."""
    cell = F.struct(F.col("pop").cast("string").alias("pop"), F.col("allele").cast("long").alias("allele"), F.col("c").cast("long").alias("c"))
    return counts.groupBy("locus").agg(F.sort_array(F.collect_list(cell)).alias("x"))


def shuffled(x, scheme: str, n: int, key: tuple) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Populations, alleles, copies (replicates x populations x alleles) and homozygotes of n shuffles of a locus."""
    pops, alleles = sorted({s["pop"] for s in x}), sorted({s["allele"] for s in x})
    at_pop, at_allele = {p: i for i, p in enumerate(pops)}, {a: i for i, a in enumerate(alleles)}
    own = np.zeros((len(pops), len(alleles)), np.int64)
    for s in x:
        own[at_pop[s["pop"]], at_allele[s["allele"]]] = s["c"]
    rng = generator(*key)
    c = np.tile(own, (n, 1, 1)) if scheme == "alleles_within" else tables(rng, own.sum(axis=1), own.sum(axis=0), n)
    return pops, np.array(alleles, np.int64), c, homozygotes(rng, c)


def _replicates(geno: DataFrame, n: int, seed, scheme: str, make: Callable, schema: str) -> DataFrame:
    """What ``make(locus, reps, populations, alleles, copies, homozygotes)`` yields of each locus and chunk."""
    chunks = -(-n // CHUNK)
    loci = by_locus(allele_counts(geno))
    work = loci.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if n > 0 else loci.limit(0).withColumn("chunk", F.lit(0))

    def run(batches):
        for pdf in batches:
            for locus, x, chunk in zip(pdf["locus"], pdf["x"], pdf["chunk"], strict=True):
                reps = np.arange(1 + chunk * CHUNK, min(n, (chunk + 1) * CHUNK) + 1)
                # a chunk is drawn whole, so a replicate doesn't depend on how many follow
                pops, alleles, c, hom = shuffled(x, scheme, CHUNK, (seed, scheme, locus, chunk))
                yield make(locus, reps, pops, alleles, c[: len(reps)], hom[: len(reps)])

    tasks = max(1, min(chunks, MAX_TASKS))
    return work.repartition(tasks, "locus", "chunk").mapInPandas(run, schema)


def permute(geno: DataFrame, n: int, seed, scheme: str) -> DataFrame:
    """``rep, locus, fst, fit, fis, g`` of n shuffles of allele copies, within populations or over all."""
    kind = geno.schema["locus"].dataType.simpleString()

    def make(locus, reps, pops, alleles, c, hom) -> pd.DataFrame:
        return pd.DataFrame({"rep": reps, "locus": locus, **statistics(c, (c - 2 * hom).sum(axis=1))})

    out = _replicates(geno, n, seed, scheme, make, f"rep long, locus {kind}, " + ", ".join(f"{v} double" for v in STATISTICS))
    return out.select("rep", "locus", *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in STATISTICS])


def permuted_counts(geno: DataFrame, n: int, seed, scheme: str) -> DataFrame:
    """``counts.allele_counts`` with ``rep`` of n shuffles of allele copies."""
    kind = {f.name: f.dataType.simpleString() for f in geno.schema.fields}

    def make(locus, reps, pops, alleles, c, hom) -> pd.DataFrame:
        r, p, a = np.nonzero(c)
        return pd.DataFrame({"rep": reps[r], "locus": locus, "pop": np.array(pops, object)[p], "allele": alleles[a], "c": c[r, p, a], "h": (c - 2 * hom)[r, p, a]})

    out = _replicates(geno, n, seed, scheme, make, f"rep long, locus {kind['locus']}, pop string, allele long, c long, h long")
    return out.select("rep", "locus", F.col("pop").cast(kind["pop"]).alias("pop"), F.col("allele").cast(kind["a1"]).alias("allele"), "c", "h")


def g_p_values(counts: DataFrame, n: int, seed) -> DataFrame:
    """``locus, g, p_value`` of differentiation by n random tables of populations x alleles with the margins of each locus, loci apart; (b + 1) / (n + 1).

    Copies are dealt one by one, as in haploid data or under random union; to move whole genotypes, shuffle labels.
    """
    chunks = -(-n // CHUNK)
    work = by_locus(counts).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(batches):
        for pdf in batches:
            for locus, x, chunk in zip(pdf["locus"], pdf["x"], pdf["chunk"], strict=True):
                frame = pd.DataFrame([(s["pop"], s["allele"], s["c"]) for s in x], columns=["pop", "allele", "c"]).pivot(index="pop", columns="allele", values="c").fillna(0).to_numpy(np.int64)
                none = np.zeros((1, frame.shape[1]))
                drawn = tables(generator(seed, "tables", locus, chunk), frame.sum(axis=1), frame.sum(axis=0), CHUNK)[: n - chunk * CHUNK]
                own, got = statistics(frame[None], none)["g"][0], statistics(drawn, np.repeat(none, len(drawn), axis=0))["g"]
                yield pd.DataFrame({"locus": [locus], "g": [own], "hits": [int((got >= own - 1e-9).sum())]})

    kind = counts.schema["locus"].dataType.simpleString()
    out = work.repartition(max(1, min(chunks, MAX_TASKS)), "locus", "chunk").mapInPandas(run, f"locus {kind}, g double, hits long")
    g = F.max("g")
    return out.groupBy("locus").agg(F.when(~F.isnan(g), g).alias("g"), F.when(~F.isnan(g), (F.sum("hits") + 1) / (n + 1)).alias("p_value"))


def _ln(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1))


def table_g(t: np.ndarray, fixed: float) -> np.ndarray:
    """G of tables (last two axes) whose margins and total add ``fixed``."""
    return 2 * (_ln(t).sum(axis=(-2, -1)) + fixed)


def ld_p_values(geno: DataFrame, n: int, seed) -> DataFrame:
    """``pop, locus1, locus2, g, p_value``, and All, as ``kernel.ld_p_values``: (b + 1) / n over n - 1 shuffles of the second locus within population.

    Such a shuffle keeps the margins of a pair's table, so tables are drawn with these margins: its cost grows with populations x genotypes, not with individuals.
    """
    chunks = max(1, -(-(n - 1) // LINKAGE_CHUNK))
    own = linkage_tables(geno).select(F.col("pop").cast("string").alias("pop"), F.col("locus1").cast("string").alias("locus1"), F.col("locus2").cast("string").alias("locus2"), "x")
    work = own.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    pair = ["locus1", "locus2"]

    def draw(batches):
        for pdf in batches:
            rows = []
            for pop, one, two, x, chunk in zip(pdf["pop"], pdf["locus1"], pdf["locus2"], pdf["x"], pdf["chunk"], strict=True):
                t = table_of(x).astype(np.int64)
                if min(t.shape) < 2:
                    continue
                r, c = t.sum(axis=1), t.sum(axis=0)
                fixed = float(_ln(r.sum()) - _ln(r).sum() - _ln(c).sum())
                rng, step = generator(seed, "linkage", one, two, pop, chunk), max(1, min(LINKAGE_CHUNK, TABLE_BYTES // (8 * t.size)))
                here, gs = min(LINKAGE_CHUNK, n - 1 - chunk * LINKAGE_CHUNK), []
                # tables are drawn by whole steps, so a replicate doesn't depend on how many follow
                for _ in range(0, here, step):
                    gs.append(table_g(tables(rng, r, c, step), fixed))
                rows.append((pop, one, two, chunk, float(table_g(t, fixed)), np.concatenate([*gs, []])[: max(here, 0)]))
            yield pd.DataFrame(rows, columns=["pop", *pair, "chunk", "g", "gs"])

    drawn = work.repartition(max(1, min(16 * chunks, MAX_TASKS)), "pop", *pair, "chunk").mapInPandas(draw, "pop string, locus1 string, locus2 string, chunk int, g double, gs array<double>")
    # the populations of a pair and chunk meet once, for All
    met = drawn.groupBy(*pair, "chunk").agg(F.sort_array(F.collect_list(F.struct("pop", "g", "gs"))).alias("x"))

    def count(batches):
        for pdf in batches:
            rows = []
            for one, two, x in zip(pdf["locus1"], pdf["locus2"], pdf["x"], strict=True):
                obs, got = np.array([s["g"] for s in x]), np.array([s["gs"] for s in x]).reshape(len(x), -1)
                rows += [(s["pop"], one, two, max(o, 0.0), int(b)) for s, o, b in zip(x, obs, (got >= obs[:, None] - 1e-9).sum(axis=1), strict=True)]
                rows.append(("All", one, two, float(obs.sum()), int((got.sum(axis=0) >= obs.sum() - 1e-9).sum())))
            yield pd.DataFrame(rows, columns=["pop", *pair, "g", "hits"])

    hits = met.mapInPandas(count, "pop string, locus1 string, locus2 string, g double, hits long")
    return hits.groupBy("pop", *pair).agg(F.max("g").alias("g"), ((F.sum("hits") + 1) / n).alias("p_value"))
