"""P-values and confidence intervals from replicates (``rep``) and observed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantile7, quantile_floor

#: Values this close are equal: sums in another order differ by rounding, and permuted statistics are often tied.
EPS = 1e-9
ALTERNATIVES = ("greater", "less", "two_sided_abs")


def p_value(perm: Column, obs: Column, alternative: str = "greater", plus1: bool = True) -> Column:
    """An aggregate: (b + 1) / (m + 1) over the replicates that have a value, or b / m without ``plus1``."""
    hit = {"greater": perm >= obs - EPS, "less": perm <= obs + EPS, "two_sided_abs": F.abs(perm) >= F.abs(obs) - EPS}[alternative]
    b, m = F.sum(hit.cast("long")), F.count(F.when(obs.isNotNull(), perm))
    return F.when(m > 0, (b + 1) / (m + 1) if plus1 else b / m)


def p_values(perm: DataFrame, obs: DataFrame, by: list[str], value: str, alternative: str = "greater", plus1: bool = True) -> DataFrame:
    """``by``, observed, n_reps and p_value."""
    x = perm.select(*by, F.col(value).alias("_perm")).join(obs.select(*by, F.col(value).alias("observed")), by) if by else perm.select(F.col(value).alias("_perm")).crossJoin(obs.select(F.col(value).alias("observed")))
    return x.groupBy(*by, "observed").agg(F.count("_perm").alias("n_reps"), p_value(F.col("_perm"), F.col("observed"), alternative, plus1).alias("p_value"))


def p_centred(perm: DataFrame, obs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Two-sided p-values of distances from the mean of the replicates."""
    centre = perm.groupBy(*by).agg(F.avg(value).alias("_mu"))
    x = perm.select(*by, F.col(value).alias("_perm")).join(centre, by).join(obs.select(*by, F.col(value).alias("observed")), by)
    hit = (F.abs(F.col("_perm") - F.col("_mu")) >= F.abs(F.col("observed") - F.col("_mu")) - EPS).cast("long")
    m = F.count(F.when(F.col("observed").isNotNull(), F.col("_perm")))
    return x.groupBy(*by, "observed").agg(F.count("_perm").alias("n_reps"), F.when(m > 0, (F.sum(hit) + 1) / (m + 1)).alias("p_value"))


def interval(boot: DataFrame, by: list[str], value: str, conf: float = 0.95, rule: str = "type7") -> DataFrame:
    """``by``, boot_mean, boot_median, boot_se, ci_l, ci_u and n of the replicates that have a value.

    ``rule`` is ``type7`` (interpolated) or ``floor`` (sorted value at index floor(n p)).
    """
    q = {"type7": quantile7, "floor": quantile_floor}[rule]
    low, high = (1 - conf) / 2, 1 - (1 - conf) / 2
    v = F.col(value)
    return boot.groupBy(*by).agg(F.avg(v).alias("boot_mean"), quantile7(v, 0.5).alias("boot_median"), F.stddev_samp(v).alias("boot_se"), q(v, low).alias("ci_l"), q(v, high).alias("ci_u"), F.count(v).alias("n"))


def null_quantiles(null: DataFrame, value: str, observed: Column, probs: tuple[float, ...] = (0.005, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.995)) -> DataFrame:
    """``label, value``: quantiles of a null distribution, and a row OBSERVED."""
    row = null.agg(F.percentile(value, F.array(*map(F.lit, probs))).alias("q"), F.first(observed).alias("o"))
    labels = F.array(*[F.lit(f"{100 * p:g}%") for p in probs], F.lit("OBSERVED"))
    return row.select(F.explode(F.arrays_zip(labels.alias("label"), F.concat("q", F.array("o")).alias("value"))).alias("x")).select(F.col("x.label").alias("label"), F.col("x.value").alias("value"))
