"""Null alleles: EM frequencies, FST corrected by ENA, chord distances corrected by INA.

Blanks are cells without a genotype, or with a null code (999/999) for both alleles.  Each
locus is treated as ``absent`` (blanks are no data) or ``null_homo`` (blanks are null homozygotes).
Everything after the EM is joins and sums over the table of populations x loci x alleles.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import NULL_ALLELES, ratio, ratio_nonzero
from ..functions.cache import keep
from . import resample

MAX_ITER, TOLERANCE = 5000, 1e-6
#: Values of replicates x pairs that a task holds at once.
BATCH = 2_000_000
#: Populations of a block, of which each two meet in a task.
POP_BLOCK = 256


def blank() -> Column:
    coded = F.col("a1").isin(*NULL_ALLELES) & F.col("a2").isin(*NULL_ALLELES)
    return F.col("a1").isNull() | F.col("a2").isNull() | (F.col("a1") <= 0) | coded


def suggest_treatments(geno: DataFrame) -> DataFrame:
    """``locus, treat``: null_homo where some blanks carry a null code.  (An extension: it looks at the codes themselves.)"""
    coded = F.max((F.col("a1").isin(*NULL_ALLELES) & F.col("a2").isin(*NULL_ALLELES)).cast("int"))
    return geno.groupBy("locus").agg(F.when(coded == 1, "null_homo").otherwise("absent").alias("treat"))


def _allele_type(geno: DataFrame) -> str:
    return geno.select(F.array("a1", "a2").alias("a")).schema["a"].dataType.elementType.simpleString()


def observed(geno: DataFrame, treatments: DataFrame | None = None) -> DataFrame:
    """Per locus and population (all combinations): efpop, n_absent, n_null_homo, n_valid, treat and ``x``, an array of (allele, ii, ix).

    A population without blanks at a locus falls back to absent.  Populations without any row have zeros.
    """
    cells = geno.withColumn("_blank", blank())
    sizes = cells.groupBy("locus", "pop").agg(F.count("*").alias("efpop"), F.sum(F.col("_blank").cast("long")).alias("n_blank"))
    good = cells.filter(~F.col("_blank")).select("locus", "pop", (F.col("a1") == F.col("a2")).alias("_same"), F.explode(F.array_distinct(F.array("a1", "a2"))).alias("allele")).filter(~F.col("allele").isin(*NULL_ALLELES))
    per = good.groupBy("locus", "pop", "allele").agg(F.sum(F.col("_same").cast("double")).alias("ii"), F.sum((~F.col("_same")).cast("double")).alias("ix"))
    packed = per.groupBy("locus", "pop").agg(F.sort_array(F.collect_list(F.struct("allele", "ii", "ix"))).alias("x"))
    grid = geno.select("locus").distinct().crossJoin(geno.select("pop").distinct())  # what the tables report
    out = grid.join(sizes, ["locus", "pop"], "left").join(packed, ["locus", "pop"], "left")
    out = out.join(treatments, "locus", "left") if treatments is not None else out.withColumn("treat", F.lit("absent"))
    homo = (F.col("treat") == "null_homo") & (F.col("n_blank") > 0)
    zero = F.lit(0).cast("long")
    return out.select(
        "locus", "pop", F.coalesce("efpop", zero).alias("efpop"), F.when(homo, zero).otherwise(F.coalesce("n_blank", zero)).alias("n_absent"), F.when(homo, F.col("n_blank")).otherwise(zero).alias("n_null_homo"),
        F.coalesce(F.col("efpop") - F.col("n_blank"), zero).alias("n_valid"), F.when(homo, "null_homo").otherwise("absent").alias("treat"), F.coalesce("x", F.array().cast(f"array<struct<allele:{_allele_type(geno)},ii:double,ix:double>>")).alias("x"),
    )


def em(ii: np.ndarray, ix: np.ndarray, n: np.ndarray, nulls: np.ndarray, homo: np.ndarray, max_iter: int = MAX_ITER) -> tuple[np.ndarray, np.ndarray]:
    """Null frequency and corrected allele frequencies of many populations at once (a row each, alleles padded with zeros)."""
    there = (ii + ix) > 0
    hom = ii.sum(axis=1, keepdims=True)
    size, blanks, is_homo = n[:, None], nulls[:, None], homo[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        rd = np.where(homo, np.sqrt(nulls / n), np.sqrt(1 / (n + 1)))
        others = np.where(is_homo, blanks + hom - ii + (size - blanks - hom) - ix, 1 + hom - ii + (size - hom) - ix)
        p = np.where(there, 1 - np.sqrt(np.maximum(0, others / np.where(is_homo, size, size + 1))), 0.0)
    live = np.arange(len(n))
    for _ in range(max_iter):
        if not len(live):
            break
        pa, r = p[live], rd[live][:, None]
        denom = pa + 2 * r
        ok = there[live] & (denom > 0)
        safe = np.where(ok, denom, 1.0)
        share = ii[live] / size[live]
        new = np.where(ok, (pa + r) / safe * share + ix[live] / (2 * size[live]), 0.0)
        rn = np.where(ok, r / safe * share, 0.0).sum(axis=1) + np.where(homo[live], nulls[live] / n[live], 0.0)
        moved = ((np.abs(new - pa) > TOLERANCE) & ok).any(axis=1) | (np.abs(rn - rd[live]) > TOLERANCE)
        p[live], rd[live] = new, np.maximum(0, rn)
        live = live[moved]
    return rd, p


def _em_batches(batches):
    for pdf in batches:
        width = max((len(x) for x in pdf["x"]), default=0)
        ii, ix = np.zeros((len(pdf), max(width, 1))), np.zeros((len(pdf), max(width, 1)))
        for row, x in enumerate(pdf["x"]):
            for j, s in enumerate(x):
                ii[row, j], ix[row, j] = s["ii"], s["ix"]
        n = (pdf["efpop"] - pdf["n_absent"]).to_numpy(float)
        some = (pdf["n_valid"].to_numpy() > 0) & (pdf["x"].map(len).to_numpy() > 0)
        rd, p = np.zeros(len(pdf)), np.zeros_like(ii)
        if some.any():
            rd[some], p[some] = em(ii[some], ix[some], n[some], pdf["n_null_homo"].to_numpy(float)[some], (pdf["treat"] == "null_homo").to_numpy()[some])
        out = pdf.drop(columns="x")
        out["rd"] = rd
        out["x"] = [[{"allele": int(s["allele"]), "ii": s["ii"], "ix": s["ix"], "p": float(p[row, j])} for j, s in enumerate(x)] if some[row] else [] for row, x in enumerate(pdf["x"])]
        yield out


def em_table(geno: DataFrame, treatments: DataFrame | None = None) -> DataFrame:
    """``observed`` with rd and the corrected frequency p of each allele in ``x``.  Loci, populations and alleles keep their types."""
    own = observed(geno, treatments)
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    names = ("locus", "pop", "efpop", "n_absent", "n_null_homo", "n_valid", "treat")
    return own.mapInPandas(_em_batches, ", ".join(f"{n} {kind[n]}" for n in names) + f", rd double, x array<struct<allele:{_allele_type(geno)},ii:double,ix:double,p:double>>")


def em_long(table: DataFrame) -> DataFrame:
    """A row for each locus, population and allele: rd, p (corrected), freq (observed), ii, ix."""
    return table.select("locus", "pop", "rd", "n_valid", "efpop", "n_absent", "n_null_homo", F.explode("x").alias("s")).select("locus", "pop", "rd", "efpop", "n_absent", "n_null_homo", "s.*", ((2 * F.col("s.ii") + F.col("s.ix")) / (2.0 * F.col("n_valid"))).alias("freq"))


def inputs(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes by locus and population (ni_raw, ni_ena), and allele rows (na, aa, for raw and ENA, and both frequencies)."""
    table = keep(table)  # populations x loci; the EM runs once for all that is made of it
    sizes = table.select("locus", "pop", "rd", F.greatest(F.col("efpop") - F.col("n_absent") - F.col("n_null_homo"), F.lit(0)).alias("ni_raw"), F.greatest(F.col("efpop") - F.col("n_absent"), F.lit(0)).alias("ni_ena"))
    long = em_long(table).withColumn("ni_raw", F.col("efpop") - F.col("n_absent") - F.col("n_null_homo")).withColumn("ni_ena", F.col("efpop") - F.col("n_absent"))
    d = F.col("p") + 2 * F.col("rd")
    rows = long.select(
        "locus", "pop", "allele", "rd", "ni_raw", "ni_ena", "freq", "p", (F.col("freq") * 2 * F.col("ni_raw")).alias("na_raw"), F.col("ii").alias("aa_raw"), (F.col("p") * 2 * F.col("ni_ena")).alias("na_ena"),
        F.when((F.col("ii") > 0) & (d > 0), F.col("ii") * F.col("p") / d).otherwise(0.0).alias("aa_ena"),
    )
    return sizes, rows


def _components(sizes: DataFrame, rows: DataFrame, by: list[str], kind: str, effective: bool = False) -> DataFrame:
    """``by``, s1, s3 (sums over alleles), nc, r: ``effective`` counts populations with genotypes in place of all."""
    ni = F.col(f"ni_{kind}").cast("double")
    size = sizes.groupBy(*by).agg(F.sum(ni).alias("n"), F.sum(ni * ni).alias("n2"), F.count("*").alias("r_all"), F.sum((ni > 0).cast("long")).alias("r_eff"))
    na, aa = F.col(f"na_{kind}"), F.col(f"aa_{kind}")
    al = rows.groupBy(*by, "allele").agg(F.sum(na).alias("sna"), F.sum(F.when(ni > 0, na * na / (2 * ni)).otherwise(0.0)).alias("s2a"), F.sum(aa).alias("saa"))
    r = F.col("r_eff" if effective else "r_all").cast("double")
    n = F.col("n")
    size = size.withColumn("nc_own", F.when((n > 0) & (r > 1), (n - F.col("n2") / n) / (r - 1)).otherwise(0.0)).withColumn("nc", F.when((n > 0) & (F.col("r_eff") > 1), (n - F.col("n2") / n) / (F.col("r_eff") - 1)).otherwise(0.0))
    x = al.join(size, by)
    ok = (n > 0) & (r >= 2) & (F.col("nc_own") > 0) & (n - r > 0)
    msg = (0.5 * F.col("sna") - F.col("saa")) / n
    msi = (0.5 * F.col("sna") + F.col("saa") - F.col("s2a")) / (n - r)
    msp = (F.col("s2a") - 0.5 * F.col("sna") * F.col("sna") / n) / (r - 1)
    s2p, s2i = (msp - msi) / (2 * F.col("nc_own")), 0.5 * (msi - msg)
    parts = x.groupBy(*by).agg(F.sum(F.when(ok, s2p).otherwise(0.0)).alias("s1"), F.sum(F.when(ok, s2p + s2i + msg).otherwise(0.0)).alias("s3"))
    zero = F.lit(0.0)
    return size.join(parts, by, "left").select(*by, F.coalesce("s1", zero).alias(f"s1_{kind}"), F.coalesce("s3", zero).alias(f"s3_{kind}"), F.col("nc").alias(f"nc_{kind}"), F.col("r_eff").alias(f"r_{kind}"))


def both(sizes: DataFrame, rows: DataFrame, by: list[str], effective: bool = False) -> DataFrame:
    return _components(sizes, rows, by, "raw", effective).join(_components(sizes, rows, by, "ena", effective), by)


def fst_by_locus(parts: DataFrame) -> DataFrame:
    return parts.select("locus", F.round(ratio_nonzero(F.col("s1_raw"), F.col("s3_raw")), 6).alias("fst_raw"), F.round(ratio_nonzero(F.col("s1_ena"), F.col("s3_ena")), 6).alias("fst_ena"), F.col("r_raw").alias("n_pops_raw"), F.col("r_ena").alias("n_pops_ena"))


def fst_pooled(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over loci, each weighed by its nc."""
    w = lambda v, k: F.sum(F.col(f"{v}_{k}") * F.col(f"nc_{k}"))
    return parts.groupBy(*keys).agg(ratio(w("s1", "raw"), w("s3", "raw")).alias("fst_raw"), ratio(w("s1", "ena"), w("s3", "ena")).alias("fst_ena"))


def pairs(geno: DataFrame) -> DataFrame:
    """``pop1 < pop2`` and each of the two as ``pop``."""
    pops = geno.select("pop").distinct()
    two = pops.select(F.col("pop").alias("pop1")).join(pops.select(F.col("pop").alias("pop2")), F.col("pop1") < F.col("pop2"))
    return two.select("pop1", "pop2", F.explode(F.array("pop1", "pop2")).alias("pop"))


def paired(sizes: DataFrame, rows: DataFrame, pair: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables once for each pair that a population is in."""
    return sizes.join(pair, "pop"), rows.join(pair, "pop")


def pair_components(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """Components of each pair and locus; those of a pair with one side empty are 0 (its nc is 0)."""
    return both(sizes, rows, ["pop1", "pop2", "locus"])


def fst_locus_pair(parts: DataFrame) -> DataFrame:
    return parts.select("locus", "pop1", "pop2", *[F.round(F.when(F.col(f"nc_{k}") > 0, ratio_nonzero(F.col(f"s1_{k}"), F.col(f"s3_{k}"))), 6).alias(f"fst_{k}") for k in ("raw", "ena")])


def chord(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """Cavalli-Sforza chord distances of each pair and locus, raw and INA (the null allele is one more state); null over a product sum of 1."""
    by = ["pop1", "pop2", "locus"]
    meet = lambda c: F.when(F.sum((F.col(c) > 0).cast("int")) == 2, F.sqrt(F.min(c) * F.max(c))).otherwise(0.0)
    cells = rows.groupBy(*by, "allele").agg(meet("freq").alias("raw"), meet("p").alias("ina")).groupBy(*by).agg(F.sum("raw").alias("raw"), F.sum("ina").alias("ina"))
    seen = rows.groupBy(*by).agg(F.countDistinct("pop").alias("k"))
    size = sizes.groupBy(*by).agg(F.min("ni_raw").alias("ni_raw"), F.min("ni_ena").alias("ni_ena"), F.sqrt(F.min("rd") * F.max("rd")).alias("nulls"))
    x = size.join(cells, by, "left").join(seen, by, "left")

    def distance(product: Column) -> Column:
        return F.when(product <= 1.0, (2.0 / math.pi) * F.sqrt(2.0 * (1.0 - product)))

    return x.select(*by, F.when((F.col("ni_raw") > 0) & (F.col("k") == 2), distance(F.col("raw"))).alias("dcse_raw"), F.when(F.col("ni_ena") > 0, distance(F.coalesce("ina", F.lit(0.0)) + F.col("nulls"))).alias("dcse_ina"))


# -- pairs of populations by blocks ---------------------------------------------------------


def _cells(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each locus and population: its sizes, and its alleles as an array."""
    x = rows.groupBy("locus", "pop").agg(F.sort_array(F.collect_list(F.struct("allele", *_ALLELE))).alias("x"))
    return sizes.select("locus", "pop", "rd", *[F.col(c).cast("double").alias(c) for c in ("ni_raw", "ni_ena")]).join(x, ["locus", "pop"], "left")


_ALLELE = ("na_raw", "aa_raw", "na_ena", "aa_ena", "freq", "p")


@dataclass
class Side:
    """The populations of a block at one locus; ``value`` has a matrix (populations x alleles) for each of ``_ALLELE``, zeros where a population lacks an allele."""

    pops: np.ndarray
    rd: np.ndarray
    n: dict[str, np.ndarray]
    seen: np.ndarray
    value: dict[str, np.ndarray]


def _sides(*frames: pd.DataFrame) -> list[Side]:
    cells = [[[] if x is None else list(x) for x in f["x"]] for f in frames]
    alleles = {a: i for i, a in enumerate(sorted({c["allele"] for own in cells for x in own for c in x}))}
    out = []
    for f, own in zip(frames, cells, strict=True):
        value = {v: np.zeros((len(f), len(alleles))) for v in _ALLELE}
        for row, x in enumerate(own):
            for c in x:
                for v in _ALLELE:
                    value[v][row, alleles[c["allele"]]] = c[v] or 0.0
        out.append(Side(f["pop"].to_numpy(), f["rd"].to_numpy(float), {k: f[f"ni_{k}"].to_numpy(float) for k in ("raw", "ena")}, np.array([len(x) > 0 for x in own], bool), value))
    return out


def _fst_parts(a: Side, b: Side) -> dict[str, np.ndarray]:
    """``_components`` of every pair: linear in sums over alleles, of which only the squares of a pair's copies need a product of matrices."""
    out = {}
    for k in ("raw", "ena"):
        (na, nb), (x, y) = (a.n[k], b.n[k]), (a.value[f"na_{k}"], b.value[f"na_{k}"])
        n, n2 = na[:, None] + nb, (na * na)[:, None] + nb * nb
        each = lambda f: f(x, na, a.value[f"aa_{k}"])[:, None] + f(y, nb, b.value[f"aa_{k}"])  # noqa: B023, E731
        with np.errstate(divide="ignore", invalid="ignore"):
            copies, homo = each(lambda v, m, h: v.sum(axis=1)), each(lambda v, m, h: h.sum(axis=1))
            within = each(lambda v, m, h: np.where(m > 0, (v * v).sum(axis=1) / (2 * m), 0.0))
            square = each(lambda v, m, h: (v * v).sum(axis=1)) + 2 * (x @ y.T)
            nc = np.where(n > 0, n - n2 / n, 0.0)
            filled = (na > 0)[:, None].astype(int) + (nb > 0)
            ok = (n > 0) & (nc > 0) & (n - 2 > 0)
            msg, msi, msp = (0.5 * copies - homo) / n, (0.5 * copies + homo - within) / (n - 2), within - 0.5 * square / n
            s2p, s2i = (msp - msi) / (2 * nc), 0.5 * (msi - msg)
            s3 = s2p + s2i + msg
        out |= {f"s1_{k}": np.where(ok, s2p, 0.0), f"s3_{k}": np.where(ok, s3, 0.0), f"nc_{k}": np.where(filled > 1, nc, 0.0), f"r_{k}": filled}
    return out


def _chord_parts(a: Side, b: Side) -> dict[str, np.ndarray]:
    """``chord`` of every pair, by products of square roots of frequencies."""

    def products(c: str, nulls: np.ndarray) -> np.ndarray:
        x, y = (np.maximum(s.value[c], 0.0) for s in (a, b))
        out = np.sqrt(x) @ np.sqrt(y).T
        i, j = np.nonzero(np.abs(out + nulls - 1) < 1e-9)  # at the limit of 1 each product counts as it is
        out[i, j] = np.sqrt(x[i] * y[j]).sum(axis=1)
        return out + nulls

    def distance(product: np.ndarray, ok: np.ndarray) -> np.ndarray:
        return np.where(ok & (product <= 1), 2 / math.pi * np.sqrt(2 * np.maximum(0.0, 1 - product)), np.nan)

    both, nulls = lambda f: f(a)[:, None] & f(b), np.sqrt(a.rd[:, None] * b.rd)
    return {"dcse_raw": distance(products("freq", np.zeros_like(nulls)), both(lambda s: (s.n["raw"] > 0) & s.seen)), "dcse_ina": distance(products("p", nulls), both(lambda s: s.n["ena"] > 0))}


def _pairwise(sizes: DataFrame, rows: DataFrame, parts, fields: dict[str, str]) -> DataFrame:
    """``pop1 < pop2, locus`` and what ``parts`` makes of the pairs of two sides.

    Populations are dealt to blocks by their hash, and each pair of blocks meets once at each locus: a population's alleles are sent once for
    each block, not once for each other population.
    """
    cells = keep(_cells(sizes, rows))
    many = max(1, -(-(cells.agg(F.countDistinct("pop")).first()[0] or 1) // POP_BLOCK))
    block = F.pmod(F.xxhash64("pop"), F.lit(many)).cast("int")
    columns = ["locus", "pop", "rd", "ni_raw", "ni_ena", "x"]
    left = cells.select(*columns, block.alias("i")).select(*columns, "i", F.explode(F.sequence(F.col("i"), F.lit(many - 1))).alias("j"))
    right = cells.select(*[F.col(c).alias(c) for c in columns], block.alias("j")).select(*columns, F.explode(F.sequence(F.lit(0), F.col("j"))).alias("i"), "j")
    kind = {c: cells.schema[c].dataType.simpleString() for c in ("locus", "pop")}
    names = ["pop1", "pop2", "locus", *fields]

    def meet(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        (x, y), (locus, i, j) = _sides(a, b), key
        first, second = x.pops[:, None], y.pops[None]
        forward = first < second
        r, c = np.nonzero(forward if i == j else first != second)
        turned = ~forward[r, c]
        found = parts(x, y)
        pop1, pop2 = np.where(turned, y.pops[c], x.pops[r]), np.where(turned, x.pops[r], y.pops[c])
        return pd.DataFrame({"pop1": pop1, "pop2": pop2, "locus": locus, **{f: found[f][r, c] for f in fields}})

    schema = f"pop1 {kind['pop']}, pop2 {kind['pop']}, locus {kind['locus']}, " + ", ".join(f"{n} {t}" for n, t in fields.items())
    out = left.groupBy("locus", "i", "j").cogroup(right.groupBy("locus", "i", "j")).applyInPandas(meet, schema)
    return out.select("pop1", "pop2", "locus", *[F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in fields.items()])


def pairwise_components(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """``pair_components`` of all pairs of populations, by blocks."""
    return _pairwise(sizes, rows, _fst_parts, {f"{v}_{k}": "long" if v == "r" else "double" for k in ("raw", "ena") for v in ("s1", "s3", "nc", "r")})


def pairwise_chord(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """``chord`` of all pairs of populations, by blocks."""
    return _pairwise(sizes, rows, _chord_parts, {"dcse_raw": "double", "dcse_ina": "double"})


def chord_pooled(d: DataFrame, keys: tuple[str, ...] = ("pop1", "pop2")) -> DataFrame:
    return d.groupBy(*keys).agg(F.avg("dcse_raw").alias("dcse_raw"), F.avg("dcse_ina").alias("dcse_ina"))


def t1(table: DataFrame, treatments: DataFrame | None = None) -> DataFrame:
    """Locus, subsample, code, null frequency, size, blanks and expected blanks."""
    code = F.lit("0")
    out = table
    if treatments is not None:
        out = out.drop("treat").join(treatments, "locus", "left")
        code = F.when(F.col("treat") == "null_homo", "999").otherwise("0")
    return out.select("locus", F.col("pop").alias("subsample"), code.alias("miss"), F.round("rd", 6).alias("p_nulls"), F.col("efpop").alias("n"), (F.col("n_absent") + F.col("n_null_homo")).alias("n_blanks"), F.round(F.col("efpop") * F.col("rd") * F.col("rd"), 6).alias("n_exp_blanks"))


def binomial_lower(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) of binomial variables, by the continued fraction of the incomplete beta function (modified Lentz)."""
    out = np.full(len(k), np.nan)
    for i in range(len(k)):
        kk, nn, pp = float(k[i]), float(n[i]), float(p[i])
        if not (nn >= 0 and 0 <= pp <= 1):
            continue
        if kk >= nn or pp == 0:
            out[i] = 1.0
        elif kk < 0 or pp == 1:
            out[i] = 0.0
        else:
            out[i] = _incomplete_beta(nn - kk, kk + 1, 1 - pp)
    return out


def _incomplete_beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_lower(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))


def t2(table: DataFrame, treatments: DataFrame | None = None) -> DataFrame:
    """Per locus: mean null frequency weighed by size, expected and observed blanks, and the lower binomial tail (3 decimals)."""
    n = F.col("efpop").cast("double")
    x = table.groupBy("locus").agg(F.sum("efpop").alias("n_tot"), F.sum(F.col("n_absent") + F.col("n_null_homo")).alias("n_blanks"), F.sum(n * F.col("rd") * F.col("rd")).alias("av"), F.sum(n * F.col("rd")).alias("ps"))
    code = F.lit("0")
    if treatments is not None:
        x, code = x.join(treatments, "locus", "left"), F.when(F.col("treat") == "null_homo", "999").otherwise("0")
    prob = F.when(F.col("n_tot") > 0, F.col("av") / F.col("n_tot"))
    return x.select("locus", code.alias("miss"), F.round("av", 6).alias("av_n_exp_blanks"), F.round(F.when(F.col("n_tot") > 0, F.col("ps") / F.col("n_tot")), 6).alias("av_p_nulls"), "n_tot", "n_blanks", F.round(prob, 6).alias("f_exp_blanks"), F.round(binomial_p(F.col("n_blanks"), F.col("n_tot"), prob), 3).alias("p_value"))


def bootstrap_loci_fst(parts: DataFrame, n: int, seed, keys: tuple[str, ...] = ()) -> DataFrame:
    """FST by replicate over drawn loci; with pairs as keys all pairs share the draws."""
    return fst_pooled(resample.bootstrap_loci(parts, n, seed), ["rep", *keys])


def bootstrap_loci_chord(d: DataFrame, n: int, seed) -> DataFrame:
    return chord_pooled(resample.bootstrap_loci(d, n, seed), ("rep", "pop1", "pop2"))


#: Numbers of a table of replicates x loci that is sent to tasks.
MAX_DRAWS = 20_000_000
_PARTS = ("s1_raw", "s3_raw", "nc_raw", "s1_ena", "s3_ena", "nc_ena")
_POOLED = ("fst_raw", "fst_ena", "dcse_raw", "dcse_ina")


def pooled_draws(times: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """The four statistics by replicate and pair: ``times`` says how often each replicate draws a locus, ``parts`` has the values of ``_PARTS`` and the two
    distances by locus and pair (NaN where there are none).  NaN where a statistic isn't defined."""
    out, there = {}, np.nan_to_num(parts)
    with np.errstate(divide="ignore", invalid="ignore"):
        for at, kind in ((0, "raw"), (3, "ena")):
            top, below = times @ (there[at] * there[at + 2]), times @ (there[at + 1] * there[at + 2])
            out[f"fst_{kind}"] = np.where(below > 0, top / below, np.nan)
        for at, kind in ((6, "raw"), (7, "ina")):
            n = times @ (~np.isnan(parts[at])).astype(float)
            out[f"dcse_{kind}"] = np.where(n > 0, (times @ there[at]) / n, np.nan)
    return out


def _ends(values: np.ndarray, conf: float) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated quantiles over the replicates with a value; NaN under two of them."""
    few = (~np.isnan(values)).sum(axis=0) < 2
    values = np.where(few[None], 0.0, values)
    return tuple(np.where(few, np.nan, np.nanquantile(values, q, axis=0)) for q in ((1 - conf) / 2, 1 - (1 - conf) / 2))


def shared_intervals(whole: DataFrame, pair: DataFrame, chords: DataFrame, n: int, seed, conf: float = 0.95) -> DataFrame:
    """``statistic, pop1, pop2, ci_l, ci_u``: FST over all (no populations), FST and chord distances of pairs, raw and corrected, from one draw of loci a replicate.

    Replicates without a value are passed over; under two with one, intervals are null.  A replicate weighs loci by how often it draws them, so all replicates of a batch
    of pairs are products of the weights with the pairs' loci, and only intervals leave a task.  Beyond ``MAX_DRAWS`` weights
    the relational form gives the same.
    """
    loci = [r["locus"] for r in whole.select("locus").union(pair.select("locus")).union(chords.select("locus")).distinct().orderBy("locus").collect()]
    if n * len(loci) > MAX_DRAWS:
        return shared_intervals_relational(whole, pair, chords, n, seed, conf)
    spark, k = whole.sparkSession, len(loci)
    drawn = np.array([[int(hashlib.md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % k for slot in range(1, k + 1)] for rep in range(1, n + 1)], np.int64).reshape(n, k)  # as ``resample.draw`` does
    times = np.zeros((n, k), np.float32)
    np.add.at(times, (np.repeat(np.arange(n), k), drawn.ravel()), 1)
    shared, at = spark.sparkContext.broadcast(times), {x: i for i, x in enumerate(loci)}  # MAX_DRAWS bounds them
    step = max(1, BATCH // max(n, k, 1))

    def run(batches):
        weights = shared.value.astype(float)
        for pdf in batches:
            for a in range(0, len(pdf), step):
                own = pdf.iloc[a : a + step]
                parts = np.full((8, k, len(own)), np.nan)
                for column, cells in enumerate(own["x"]):
                    for cell in cells:
                        parts[:, at[cell["locus"]], column] = [np.nan if v is None else v for v in cell["v"]]
                for name, values in pooled_draws(weights, parts).items():
                    low, high = _ends(values, conf)
                    yield pd.DataFrame({"statistic": name, "pop1": own["pop1"].to_numpy(), "pop2": own["pop2"].to_numpy(), "ci_l": low, "ci_u": high})

    names = {c: pair.schema[c].dataType.simpleString() for c in ("pop1", "pop2")}
    cell = lambda *v: F.struct("locus", F.array(*v).alias("v")).alias("x")
    every = whole.select(*[F.lit(None).cast(names[c]).alias(c) for c in names], cell(*_PARTS, *[F.lit(None).cast("double")] * 2))
    own = every.unionByName(pair.join(chords, ["pop1", "pop2", "locus"], "full").select("pop1", "pop2", cell(*_PARTS, "dcse_raw", "dcse_ina")))
    rows = own.groupBy("pop1", "pop2").agg(F.collect_list("x").alias("x"))  # a cell for each locus
    out = rows.mapInPandas(run, f"statistic string, pop1 {names['pop1']}, pop2 {names['pop2']}, ci_l double, ci_u double").filter(F.col("pop1").isNotNull() | F.col("statistic").startswith("fst"))
    return out.select("statistic", "pop1", "pop2", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("ci_l", "ci_u")])


def shared_intervals_relational(whole: DataFrame, pair: DataFrame, chords: DataFrame, n: int, seed, conf: float = 0.95) -> DataFrame:
    """The same with a row for each replicate, locus and pair."""
    long = lambda x, names, *keys: x.select("rep", *(keys or [F.lit(None).cast(pair.schema["pop1"].dataType).alias(k) for k in ("pop1", "pop2")]), F.explode(F.array(*[F.struct(F.lit(v).alias("statistic"), F.col(v).alias("v")) for v in names])).alias("s")).select("rep", "pop1", "pop2", "s.*")
    loci = whole.select("locus").union(pair.select("locus")).union(chords.select("locus")).distinct()
    draws = resample.draw(loci, "locus", n, seed)
    every = long(fst_pooled(draws.join(whole, "locus"), ["rep"]), [*_POOLED[:2]])
    pairs_ = long(fst_pooled(draws.join(pair, "locus"), ["rep", "pop1", "pop2"]), [*_POOLED[:2]], "pop1", "pop2")
    apart = long(chord_pooled(draws.join(chords, "locus"), ("rep", "pop1", "pop2")), [*_POOLED[2:]], "pop1", "pop2")
    ends = [F.when(F.count("v") >= 2, F.percentile("v", F.lit(p))) for p in ((1 - conf) / 2, 1 - (1 - conf) / 2)]
    return every.unionByName(pairs_).unionByName(apart).groupBy("statistic", "pop1", "pop2").agg(ends[0].alias("ci_l"), ends[1].alias("ci_u"))


def bootstrap_subsamples(sizes: DataFrame, rows: DataFrame, n: int, seed) -> DataFrame:
    """Components by replicate and locus over drawn populations (those with genotypes count); pool them with ``fst_pooled``."""
    slots = resample.draw(sizes, "pop", n, seed)
    return both(sizes.join(slots, "pop").drop("pop"), rows.join(slots, "pop").drop("pop"), ["rep", "locus"], effective=True)
