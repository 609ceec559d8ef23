"""Geographic distances and isolation by distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import linearised

#: WGS84 (fixed values): semi-major axis in metres, flattening.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def centroids(meta: DataFrame) -> DataFrame:
    """Mean latitude and longitude of each population; text becomes null where it is no number."""
    return meta.groupBy("pop").agg(F.avg(F.expr("try_cast(lat AS DOUBLE)")).alias("lat"), F.avg(F.expr("try_cast(lon AS DOUBLE)")).alias("lon"))


def map_points(meta: DataFrame) -> DataFrame:
    return meta.groupBy("pop", "lat", "lon").agg(F.count("*").alias("n"))


def geodesic(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres on the ellipsoid by Vincenty's inverse formula, for arrays of degrees; coincident points have 0.

    At most 200 iterations to 1e-12; nearly antipodal points keep their last iterate.
    """
    f, a = FLATTENING, AXIS
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, span = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    ss, cc, sc, cs = np.sin(u1) * np.sin(u2), np.cos(u1) * np.cos(u2), np.sin(u1) * np.cos(u2), np.cos(u1) * np.sin(u2)
    lam, done = span.copy(), np.isnan(span + lat1 + lat2)
    sin_s = cos_s = sigma = cos2a = mid = np.zeros_like(span)
    with np.errstate(all="ignore"):
        for _ in range(200):
            east, north = np.cos(u2) * np.sin(lam), cs - sc * np.cos(lam)
            s1 = np.hypot(east, north)
            c1 = ss + cc * np.cos(lam)
            angle = np.arctan2(s1, c1)
            sin_a = np.where(s1 > 0, cc * np.sin(lam) / s1, 0.0)
            k2 = 1 - sin_a**2
            m = np.where(k2 != 0, c1 - 2 * ss / k2, 0.0)
            w = f / 16 * k2 * (4 + f * (4 - 3 * k2))
            new = span + (1 - w) * f * sin_a * (angle + w * s1 * (m + w * c1 * (2 * m**2 - 1)))
            sin_s, cos_s, sigma, cos2a, mid = (np.where(done, old, v) for old, v in ((sin_s, s1), (cos_s, c1), (sigma, angle), (cos2a, k2), (mid, m)))
            moved = np.abs(new - lam)
            lam = np.where(done, lam, new)
            done |= (moved < 1e-12) | (s1 == 0)
            if done.all():
                break
        h = cos2a * (a * a - b * b) / (b * b)
        big = 1 + h / 16384 * (4096 + h * (h * (320 - 175 * h) - 768))
        small = h / 1024 * (256 + h * (h * (74 - 47 * h) - 128))
        shift = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        out = b * big * (sigma - shift)
    return np.where(np.isnan(span + lat1 + lat2), np.nan, np.where(sin_s == 0, 0.0, out))


@F.pandas_udf(DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(lat1, lon1, lat2, lon2))


def distances(points: DataFrame, planar: bool = False) -> DataFrame:
    """``pop1 < pop2, d, ln_d`` between populations; metres, or degrees in the plane.  ln_d is null at distance 0."""
    a = points.select(F.col("pop").alias("pop1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select(F.col("pop").alias("pop2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    two = a.join(b, F.col("pop1") < F.col("pop2"))  # pairs of populations are the result
    here = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    d = F.sqrt((here[0] - here[2]) * (here[0] - here[2]) + (here[1] - here[3]) * (here[1] - here[3])) if planar else geodesic_m(*here)
    return two.withColumn("d", d).select("pop1", "pop2", F.when(~F.isnan("d"), F.col("d")).alias("d")).withColumn("ln_d", F.when(F.col("d") > 0, F.log("d")))


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders of a pair; names are trimmed text."""
    x, y = F.trim(a.cast("string")), F.trim(b.cast("string"))
    return F.concat_ws("__", F.least(x, y), F.greatest(x, y))


def first_rows(rows: DataFrame, order: str | None) -> DataFrame:
    """Of the rows of a ``_key`` the one with the least ``order``; without an order, the first in the order of partitions."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    names = [c for c in rows.columns if c != "_key"]
    own = rows.withColumn("_at", at).groupBy("_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), "_at").alias("_row"))
    return own.select("_key", *[F.col("_row").getField(c).alias(c) for c in names])


def external_distances(table: DataFrame, external: DataFrame, pop1: str = "Pop1", pop2: str = "Pop2", distance: str = "Distance", order: str | None = None) -> DataFrame:
    """Keeps the pairs that the external table has, with its distance; order in a pair doesn't matter.

    Of repeated pairs the first row counts, by the column ``order``, or as the table lies.  Text that is no number makes a null distance.
    """
    keyed = external.withColumn("_key", pair_key(F.col(pop1), F.col(pop2)))
    ext = first_rows(keyed, order).select("_key", F.expr(f"try_cast(`{distance}` AS DOUBLE)").alias("d"))
    return table.drop("d", "ln_d").withColumn("_key", pair_key(F.col("pop1"), F.col("pop2"))).join(ext, "_key").drop("_key").withColumn("ln_d", F.when(F.col("d") > 0, F.log("d")))


def exclude_pairs(table: DataFrame, text: str) -> DataFrame:
    """Without the pairs named like ``A-B, C-D``."""
    named = [tuple(x.strip() for x in part.split("-")) for part in text.split(",") if part.count("-") == 1]
    keys = ["__".join(sorted(p)) for p in named]
    return table.filter(~pair_key(F.col("pop1"), F.col("pop2")).isin(keys)) if keys else table


def ibd_table(fst: DataFrame, chords: DataFrame, d: DataFrame) -> DataFrame:
    """Pairs with FST, chord and geographic distances; every column that starts with fst_ gets a linearised fr_ beside it."""
    x = fst.join(chords, ["pop1", "pop2"]).join(d, ["pop1", "pop2"], "left")
    return x.select("*", *[linearised(F.col(c)).alias("fr_" + c[4:]) for c in fst.columns if c.startswith("fst_")])


def fit_line(table: DataFrame, y: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``slope, intercept, r2, n`` of y on x over complete rows; null under three."""
    ok = table.filter(F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.isnan(y) & ~F.isnan(x))
    n = F.count("*")
    fit = {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x)}
    return ok.groupBy(*keys).agg(*[F.when(n >= 3, v).alias(k) for k, v in fit.items()], n.alias("n"))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """Adds b (slope to 4 decimals), nb = 1 / b and nem = nb / 2 pi; null where b is 0."""
    b = F.round("slope", 4)
    return lines.withColumn("b", b).withColumn("nb", F.when(F.col("b") != 0, 1 / F.col("b"))).withColumn("nem", F.col("nb") / (2 * math.pi))


def regression_summary(table: DataFrame, x: str, lines: dict[str, str]) -> DataFrame:
    """A row for each named line (such as Average, 95%CI-i, 95%CI-s) of its y column on x."""
    out = None
    for name, y in lines.items():
        one = neighbourhood(fit_line(table, y, x)).withColumn("line", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("line", "slope", "intercept", "r2", "n", "b", "nb", "nem")
