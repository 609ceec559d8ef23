"""Mantel tests, partial Mantel tests and multiple regression on distance matrices.

Matrices are long tables of pairs ``pop1 < pop2`` with value columns.  A permutation renames
populations (a ranking by md5 for each replicate), and a pair takes the permuted column's value of
the pair of new names.  Statistics are aggregates by replicate.  Pairs without a value on either
side don't count, and are masked anew in each replicate.

Up to ``MAX_PAIRS`` pairs, tasks hold the columns as square matrices and take many replicates at once.  Beyond, the matrices are cut into tiles, and each tile of the
columns that stay meets each tile of those that move in a task: what of one falls on the other in a replicate adds to the moments from which all
statistics follow.  Where renamings (replicates x populations) are more than ``MAX_MOVES``, renaming is a join.
All rank populations by the same md5 numbers, so they permute alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import average_rank, order_key
from ..functions.cache import keep
from .resample import replicates

#: Tolerances of the comparisons with the observed value (fixed values): of correlations and slopes, and of cross products.
EPS_STAT, EPS_CROSS = float(np.sqrt(np.finfo(float).eps)), 1e-9

#: Pairs (of about 1,000 populations) whose matrices may go to every task, 8 MB a column; and values that a task permutes at once.
MAX_PAIRS, BATCH = 500_000, 2_000_000
REPS_PER_TASK = 250
#: Populations along the side of a tile, and numbers of renamed populations that go to every task.
TILE, MAX_MOVES = 1000, 20_000_000
NUMBERED = ("tinyint", "smallint", "int", "bigint", "string")


def settled(pairs: DataFrame) -> DataFrame:
    """Pairs of populations are used several times by each test, and are few beside what they were made from: up to ``MAX_PAIRS`` of them become a local table, more are cached."""
    rows = pairs.limit(MAX_PAIRS + 1).collect()
    return pairs.sparkSession.createDataFrame(rows, pairs.schema) if len(rows) <= MAX_PAIRS else keep(pairs)


class Squares:
    """Columns of pairs as symmetric matrices over the populations in order; NaN where there is no pair or no value."""

    def __init__(self, rows: list, columns: list[str]):
        labels = sorted({r["pop1"] for r in rows} | {r["pop2"] for r in rows})
        at = {x: i for i, x in enumerate(labels)}
        self.names = [str(x) for x in labels]
        self.i, self.j = (np.array([at[r[p]] for r in rows], np.int64) for p in ("pop1", "pop2"))
        self.value = {c: np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in columns}
        self.square = {}
        for c, v in self.value.items():
            m = np.full((len(labels), len(labels)), np.nan)
            m[self.i, self.j] = m[self.j, self.i] = v
            self.square[c] = m

    def permuted(self, reps: np.ndarray, columns: list[str], seed) -> dict[str, np.ndarray]:
        """A row for each replicate: the columns taken from the renamed pairs."""
        new = np.array([_order(self.names, int(r), seed) for r in reps], np.int64).reshape(len(reps), -1)
        a, b = new[:, self.i], new[:, self.j]
        return {c: self.square[c][a, b] for c in columns}


def by_replicate(own: DataFrame, columns: list[str], n: int, seed, statistics: Callable[[dict, dict], dict], fields: list[str]) -> DataFrame | None:
    """``rep`` and ``fields`` of n replicates: what ``statistics`` makes of the columns (an array each) and the permuted ones (a row a replicate).  None where pairs are too many, repeat or have names of other types than ``NUMBERED``."""
    types = dict(own.dtypes)
    values = [c for c in own.columns if c not in ("pop1", "pop2")]
    rows = own.limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS or types["pop1"] not in NUMBERED or len({(r["pop1"], r["pop2"]) for r in rows}) < len(rows):
        return None
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast(Squares(rows, values))  # MAX_PAIRS bounds it

    def run(batches):
        m = shared.value
        step = max(1, BATCH // max(len(m.i), 1))
        for pdf in batches:
            for a in range(0, len(pdf), step):
                reps = pdf["rep"].to_numpy()[a : a + step]
                got = statistics(m.value, m.permuted(reps, columns, seed))
                yield pd.DataFrame({"rep": reps, **{f: got[f] for f in fields}})

    tasks = max(1, -(-n // REPS_PER_TASK))
    out = spark.range(1, n + 1, 1, tasks).toDF("rep").mapInPandas(run, "rep long, " + ", ".join(f"`{f}` double" for f in fields))
    return out.select("rep", *[F.when(~F.isnan(f"`{f}`"), F.col(f"`{f}`")).alias(f) for f in fields])


def _order(names: list[str], rep: int, seed) -> list[int]:
    """Populations (in their own order) ranked by md5 for a replicate, as the relational form does."""
    return sorted(range(len(names)), key=lambda k: (hashlib.md5(f"{seed}|{rep}|{names[k]}".encode()).hexdigest(), k))


def _square(t: pd.DataFrame, columns: list[str], a: int, b: int, side: int) -> np.ndarray:
    """Columns x rows x columns of a tile; NaN where there is no pair or no value."""
    out = np.full((len(columns), side, side), np.nan)
    i, j = t["i"].to_numpy() - a * side, t["j"].to_numpy() - b * side
    for k, c in enumerate(columns):
        out[k, i, j] = t[c].to_numpy(float)
    return out


def tiled(own: DataFrame, stay: list[str], move: list[str], n: int, seed) -> DataFrame | None:
    """``rep, n, s, ss`` of n replicates: over the pairs that have all columns (``stay``, then ``move`` renamed), their number, sums, and sums of products (upper triangle by rows).

    None where renamings are too many or names are of other types than ``NUMBERED``.
    """
    spark, types, side = own.sparkSession, dict(own.dtypes), TILE
    if types["pop1"] not in NUMBERED:
        return None
    labels = [r[0] for r in own.select("pop1").union(own.select("pop2")).distinct().limit(MAX_MOVES // max(n, 1) + 1).collect()]
    if len(labels) * n > MAX_MOVES:
        return None
    labels.sort()
    names = [str(x) for x in labels]
    moves = np.array([_order(names, rep, seed) for rep in range(1, n + 1)], np.int32).reshape(n, len(names))
    shared = spark.sparkContext.broadcast(moves)  # MAX_MOVES bounds it
    at = [spark.createDataFrame(list(zip(labels, range(len(labels)), strict=True)), f"{p} {types['pop1']}, {k} int") for p, k in (("pop1", "i"), ("pop2", "j"))]
    cells = own.join(at[0], "pop1").join(at[1], "pop2").withColumn("a", F.floor(F.col("i") / side).cast("int")).withColumn("b", F.floor(F.col("j") / side).cast("int"))
    tiles = [(a, b) for a in range(-(-len(names) // side)) for b in range(a, -(-len(names) // side))]
    other = lambda x, y: F.explode(F.array(*[F.struct(F.lit(a).alias(x), F.lit(b).alias(y)) for a, b in tiles]))
    left = cells.select("i", "j", *stay, "a", "b", other("c", "d").alias("o")).select("i", "j", *stay, "a", "b", "o.*")
    right = cells.select(*[F.col(c).alias(c) for c in ("i", "j", *move)], F.col("a").alias("c"), F.col("b").alias("d"), other("a", "b").alias("o")).select("i", "j", *move, "c", "d", "o.*")
    width = len(stay) + len(move)
    upper = np.triu_indices(width)

    def meet(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        (a, b, c, d), out = key, []
        if len(x) and len(y):
            fixed, moved = _square(x, stay, a, b, side), _square(y, move, c, d, side)
            if c == d:
                moved = np.where(np.isnan(moved), moved.transpose(0, 2, 1), moved)
            for rep, new in enumerate(shared.value, 1):
                one, two = new[a * side : (a + 1) * side], new[b * side : (b + 1) * side]
                for p, q, m in ((c, d, moved), (d, c, moved.transpose(0, 2, 1)))[: 1 if c == d else 2]:
                    r, k = np.flatnonzero(one // side == p), np.flatnonzero(two // side == q)
                    if not len(r) or not len(k):
                        continue
                    v = np.concatenate([fixed[:, r[:, None], k], m[:, one[r][:, None] - p * side, two[k] - q * side]]).reshape(width, -1)
                    v = v[:, ~np.isnan(v).any(axis=0)]
                    if v.shape[1]:
                        out.append((rep, v.shape[1], v.sum(axis=1), (v @ v.T)[upper]))
        return pd.DataFrame(out, columns=["rep", "n", "s", "ss"])

    parts = left.groupBy("a", "b", "c", "d").cogroup(right.groupBy("a", "b", "c", "d")).applyInPandas(meet, "rep long, n long, s array<double>, ss array<double>")
    total = lambda c, k: [F.sum(F.col(c)[i]) for i in range(k)]
    return parts.groupBy("rep").agg(F.sum("n").alias("n"), F.array(*total("s", width)).alias("s"), F.array(*total("ss", len(upper[0]))).alias("ss"))


def _about_means(own: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """The columns less their means, which keeps moments precise; and the means."""
    found = own.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    means = {c: float(found[c] or 0.0) for c in columns}
    return own.select("pop1", "pop2", *[(F.col(c) - F.lit(means[c])).alias(c) for c in columns]), means


def _joint(i: int, j: int, k: int) -> tuple[Column, Column, Column]:
    """Of columns i <= j among k: the sum of products, and of squares, about the means of the pairs that count."""
    at = {ij: p for p, ij in enumerate((a, b) for a in range(k) for b in range(a, k))}
    about = lambda a, b: F.col("ss")[at[a, b]] - F.col("s")[a] * F.col("s")[b] / F.col("n")
    return about(i, j), about(i, i), about(j, j)


def _correlation(i: int, j: int, k: int) -> Column:
    xy, xx, yy = _joint(i, j, k)
    return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))


def _centred(*xs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many pairs have all of the columns, by replicate, and the columns less their means over these (0 elsewhere)."""
    xs = np.broadcast_arrays(*xs)
    ok = ~np.isnan(sum(xs))
    n = ok.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, [np.where(ok, x - (np.where(ok, x, 0.0).sum(axis=1) / n)[:, None], 0.0) for x in xs]


def _r(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _one(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The statistic of each replicate; NaN under three pairs."""
    n, (a, b) = _centred(x, y)
    if kind == "cross":
        got = np.nansum(x * y, axis=1)
    elif kind == "r":
        got = _r(a, b)
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            got = (a * b).sum(axis=1) / (a * a).sum(axis=1)
    return np.where(n >= 3, got, np.nan)


def permuted(pairs: DataFrame, columns: list[str], n: int, seed) -> DataFrame:
    """``rep, pop1, pop2``, all columns, and ``columns`` once more with a p in front, taken from the renamed pair."""
    labels = pairs.select(F.col("pop1").alias("label")).union(pairs.select("pop2")).distinct()
    at = labels.select("label", F.row_number().over(Window.orderBy("label")).alias("_r"))
    new = labels.crossJoin(F.broadcast(replicates(pairs, n))).withColumn("_k", order_key(seed, F.col("rep"), F.col("label")))
    new = new.select("rep", "label", F.row_number().over(Window.partitionBy("rep").orderBy("_k", "label")).alias("_r"))
    renamed = new.withColumnRenamed("label", "to").join(at, "_r").select("rep", "label", "to")
    a, b = renamed.select("rep", F.col("label").alias("pop1"), F.col("to").alias("_a")), renamed.select("rep", F.col("label").alias("pop2"), F.col("to").alias("_b"))
    moved = pairs.join(a, "pop1").join(b, ["rep", "pop2"]).withColumn("_lo", F.least("_a", "_b")).withColumn("_hi", F.greatest("_a", "_b"))
    source = pairs.select(F.col("pop1").alias("_lo"), F.col("pop2").alias("_hi"), *[F.col(c).alias(f"p{c}") for c in columns])
    return moved.join(source, ["_lo", "_hi"], "left").drop("_lo", "_hi", "_a", "_b")


def complete(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def ranks(pairs: DataFrame, *columns: str) -> DataFrame:
    """The columns as average ranks over the pairs that have them all."""
    own = complete(pairs, *columns)
    return own.select("pop1", "pop2", *[average_rank([], c).alias(c) for c in columns])


def statistic(kind: str, x: str, y: str) -> Column:
    """r, b (slope of y on x) or cross (the sum of products)."""
    return {"r": F.corr(x, y), "b": F.regr_slope(y, x), "cross": F.sum(F.col(x) * F.col(y))}[kind]


def mantel(pairs: DataFrame, x: str, y: str, n: int, seed, kind: str = "r", plus1: bool = True) -> DataFrame:
    """One row: stat, p_pos, p_neg, n_pairs, n_perm, slope, intercept, r2.

    ``kind`` is r, b, spearman or cross; without ``plus1`` p-values are b / m.  Under three complete pairs all is null.
    """
    own = settled(pairs.select("pop1", "pop2", F.col(x).alias("x"), F.col(y).alias("y")))
    base = complete(own, "x", "y")
    if kind == "spearman":
        own = ranks(own, "x", "y")
    k, eps = ("r" if kind == "spearman" else kind), EPS_CROSS if kind == "cross" else EPS_STAT
    enough = F.count("*") >= 3
    obs = complete(own, "x", "y").agg(F.when(enough, statistic(k, "x", "y")).alias("stat"), F.count("*").alias("n_pairs"))
    line = base.agg(F.when(enough, F.regr_slope("y", "x")).alias("slope"), F.when(enough, F.regr_intercept("y", "x")).alias("intercept"), F.when(enough, F.regr_r2("y", "x")).alias("r2"))
    null = null_distribution(own, n, seed, k)
    return _two_sided(null, obs, eps, plus1).crossJoin(line)


def null_distribution(own: DataFrame, n: int, seed, kind: str = "r") -> DataFrame:
    """``rep, s`` of pairs with x and y: the statistic with y permuted."""
    fast = by_replicate(own.select("pop1", "pop2", "x", "y"), ["y"], n, seed, lambda v, p: {"s": _one(kind, v["x"][None, :], p["y"])}, ["s"])
    if fast is not None:
        return fast
    about, means = _about_means(own, ["x", "y"])
    moments = tiled(about, ["x"], ["y"], n, seed)
    if moments is not None:
        xy, xx, _ = _joint(0, 1, 2)
        mx, my, s = F.lit(means["x"]), F.lit(means["y"]), F.col("s")
        values = {"r": _correlation(0, 1, 2), "b": F.when(xx > 0, xy / xx), "cross": F.col("ss")[1] + mx * s[1] + my * s[0] + F.col("n") * mx * my}
        return moments.select("rep", F.when(F.col("n") >= 3, values[kind]).alias("s"))
    return complete(permuted(own, ["y"], n, seed), "x", "py").groupBy("rep").agg(F.when(F.count("*") >= 3, statistic(kind, "x", "py")).alias("s"))


def _two_sided(null: DataFrame, obs: DataFrame, eps: float, plus1: bool) -> DataFrame:
    """p of at least and at most the observed value; ``p_two`` doubles the smaller one."""
    m = F.count("s")
    one = int(plus1)
    p = lambda hit: F.when((m > 0) & F.first("stat").isNotNull(), (F.sum(hit.cast("long")) + one) / (m + one))
    out = null.crossJoin(obs).groupBy(*obs.columns).agg(p(F.col("s") >= F.col("stat") - eps).alias("p_pos"), p(F.col("s") <= F.col("stat") + eps).alias("p_neg"), m.alias("n_perm"))
    return out.withColumn("p_two", F.least(F.lit(1.0), 2 * F.least("p_pos", "p_neg")))


def _partial(xy: Column, xz: Column, yz: Column) -> Column:
    d = (1 - xz * xz) * (1 - yz * yz)
    return F.when(d > 0, (xy - xz * yz) / F.sqrt(d))


def partial_mantel(pairs: DataFrame, x: str, y: str, z: str, n: int, seed) -> DataFrame:
    """One row: stat (correlation of x and y given z), rxy, rxz, ryz and p-values; x is permuted.  Four complete triples at least."""
    own = settled(pairs.select("pop1", "pop2", F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")))
    full = complete(own, "x", "y", "z")
    r = full.agg(F.corr("x", "y").alias("rxy"), F.corr("x", "z").alias("rxz"), F.corr("y", "z").alias("ryz"), F.count("*").alias("n_pairs"))
    obs = r.select(F.when(F.col("n_pairs") >= 4, _partial(F.col("rxy"), F.col("rxz"), F.col("ryz"))).alias("stat"), "rxy", "rxz", "ryz", "n_pairs")

    def given(v: dict, p: dict) -> dict:
        k, (x_, y_, z_) = _centred(p["x"], v["y"][None, :], v["z"][None, :])
        xy, xz, yz = _r(x_, y_), _r(x_, z_), _r(y_, z_)
        with np.errstate(invalid="ignore", divide="ignore"):
            rest = (1 - xz * xz) * (1 - yz * yz)
            return {"s": np.where((k >= 4) & (rest > 0), (xy - xz * yz) / np.sqrt(rest), np.nan)}

    null = by_replicate(own, ["x"], n, seed, given, ["s"])
    moments = None if null is not None else tiled(_about_means(own, ["x", "y", "z"])[0], ["y", "z"], ["x"], n, seed)
    if moments is not None:
        null = moments.select("rep", F.when(F.col("n") >= 4, _partial(_correlation(0, 2, 3), _correlation(1, 2, 3), _correlation(0, 1, 3))).alias("s"))
    if null is None:
        moved = complete(permuted(own, ["x"], n, seed), "px", "y", "z").groupBy("rep").agg(F.corr("px", "y").alias("a"), F.corr("px", "z").alias("b"), F.corr("y", "z").alias("c"), F.count("*").alias("k"))
        null = moved.select("rep", F.when(F.col("k") >= 4, _partial(F.col("a"), F.col("b"), F.col("c"))).alias("s"))
    return _two_sided(null, obs, EPS_CROSS, True)


def _moments(rows: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """Per key: n, sums and sums of products of y and xs, as one array each."""
    names = [y, *xs]
    return complete(rows, *names).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in names]).alias("s"), F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]).alias("ss"))


def solve(n: float, s: np.ndarray, ss: np.ndarray, standardize: bool) -> tuple[np.ndarray, float] | None:
    """Coefficients (without intercept) and R2 by the normal equations of centred (and scaled) columns; None if singular."""
    k = len(s)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = ss
    m = m + np.triu(m, 1).T - np.outer(s, s) / n
    if n < k + 2 or m[0, 0] <= 0:
        return None
    if standardize:
        sd = np.sqrt(np.diag(m) / (n - 1))
        sd[sd < 1e-12] = 1.0
        m = m / np.outer(sd, sd)
    a, b = m[1:, 1:], m[1:, 0]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    if np.linalg.cond(a / np.outer(scale, scale)) > 1e10:
        return None
    coef = np.linalg.solve(a, b)
    return coef, float(coef @ b / m[0, 0])


def _solved(batches, xs: list[str], standardize: bool):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            got = solve(r.n, np.asarray(r.s, float), np.asarray(r.ss, float), standardize)
            for name, v in zip([*xs, "R2"], [None] * (len(xs) + 1) if got is None else [*got[0].tolist(), got[1]], strict=True):
                rows.append((r.rep, name, v, r.n))
        yield pd.DataFrame(rows, columns=["rep", "term", "v", "n"])


def mrm(pairs: DataFrame, y: str, xs: list[str], n: int, seed, standardize: bool = False) -> DataFrame:
    """``term, value, p_pos, p_neg, n_pairs``: a row for each predictor and one for R2; y is permuted.

    One to ten predictors; under k + 3 complete pairs, or with collinear predictors or a constant y, an error is raised.
    """
    if not 1 <= len(xs) <= 10 or y in xs:
        raise ValueError("one to ten predictors, none of them y")
    own = settled(pairs.select("pop1", "pop2", y, *xs))
    terms = [*xs, "R2"]
    schema, kernel = "rep long, term string, v double, n long", lambda b: _solved(b, xs, standardize)
    obs = _moments(own.withColumn("rep", F.lit(0).cast("long")), y, xs, ["rep"]).mapInPandas(kernel, schema).collect()  # a row for each term
    if not obs or obs[0]["n"] < len(xs) + 3:
        raise ValueError(f"{len(xs) + 3} complete pairs at least are needed for {len(xs)} predictors")
    if any(r["v"] is None or np.isnan(r["v"]) for r in obs):
        raise ValueError("the model can't be fitted; are predictors collinear?")
    observed = own.sparkSession.createDataFrame([(r["term"], r["v"], r["n"]) for r in obs], "term string, value double, n_pairs long")

    def fitted(v: dict, p: dict) -> dict:
        out = {t: np.full(len(p[y]), np.nan) for t in terms}
        columns = [v[c] for c in xs]
        upper = np.triu_indices(len(xs) + 1)
        for r, moved in enumerate(p[y]):
            m = np.stack([moved, *columns])
            m = m[:, ~np.isnan(m.sum(axis=0))]
            got = solve(m.shape[1], m.sum(axis=1), (m @ m.T)[upper], standardize) if m.shape[1] else None
            if got:
                for t, value in zip(terms, [*got[0], got[1]], strict=True):
                    out[t][r] = value
        return out

    fast = by_replicate(own, [y], n, seed, fitted, terms)
    if fast is not None:
        null = fast.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("v")) for t in terms])).alias("x")).select("x.*")
    else:
        moments = tiled(_about_means(own, [y, *xs])[0], xs, [y], n, seed)
        if moments is not None:  # y is their last column, and the solver's first
            k = len(xs) + 1
            at, turned = {ij: p for p, ij in enumerate((a, b) for a in range(k) for b in range(a, k))}, [k - 1, *range(k - 1)]
            pair = lambda a, b: F.col("ss")[at[min(a, b), max(a, b)]]
            moments = moments.select("rep", "n", F.array(*[F.col("s")[a] for a in turned]).alias("s"), F.array(*[pair(a, b) for p, a in enumerate(turned) for b in turned[p:]]).alias("ss"))
        else:
            moments = _moments(permuted(own, [y], n, seed), f"p{y}", xs, ["rep"])
        null = moments.mapInPandas(kernel, schema).select("term", "v")
    m = F.count("v")
    p = lambda hit: F.when((m > 0) & F.col("value").isNotNull(), (F.sum(hit.cast("long")) + 1) / (m + 1))
    return null.join(F.broadcast(observed), "term").groupBy("term", "value", "n_pairs").agg(p(F.col("v") >= F.col("value") - EPS_CROSS).alias("p_pos"), p(F.col("v") <= F.col("value") + EPS_CROSS).alias("p_neg"))


def correlations(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` of each two columns, over the pairs that have both."""
    both = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = pairs.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(both)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(both)])).alias("x")).select("x.*")
