"""Column helpers; everything here stays inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Alleles that code a null homozygote in null-allele work (fixed values).
NULL_ALLELES = (999, 999999)


def r8(x: Column, digits: int = 8) -> Column:
    """Rounded, without negative zero; NaN and infinity become null."""
    clean = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return F.round(clean, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b > 0."""
    return F.when(b > 0, a / b)


def ratio_nonzero(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def clamp01(x: Column) -> Column:
    """Limits to [0, 1]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def linearised(x: Column, top: float = 0.9999) -> Column:
    """x / (1 - x) of x limited to [0, top]."""
    y = F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), x)))
    return y / (1 - y)


def pack_gt(a1: Column, a2: Column, base: int = 1000) -> Column:
    """One number for a genotype; 0 where an allele is missing.  Longs, so no base overflows."""
    return F.when((a1 > 0) & (a2 > 0), a1.cast("long") * base + a2).otherwise(F.lit(0).cast("long"))


def unpack_gt(gt: Column, base: int = 1000) -> tuple[Column, Column]:
    ok = gt.isNotNull() & (gt > 0)
    return F.when(ok, F.floor(gt / base)).otherwise(0).cast("int"), F.when(ok, gt % base).otherwise(0).cast("int")


def valid(a1: Column | str = "a1", a2: Column | str = "a2") -> Column:
    return (F.col(a1) > 0) & (F.col(a2) > 0) if isinstance(a1, str) else (a1 > 0) & (a2 > 0)


def uniform(*parts) -> Column:
    """A 32-bit number that depends only on the parts' text: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def order_key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def p_greater(perm: Column, obs: Column) -> Column:
    """(b + 1) / (m + 1) over finite replicates, b of them at or above the observed value."""
    b, m = F.sum((perm >= obs).cast("long")), F.count(perm)
    return F.when((m > 0) & F.first(obs).isNotNull(), (b + 1) / (m + 1))


def quantile7(x: Column, p: float) -> Column:
    """Interpolated quantile (type 7) of the values that aren't null."""
    return F.percentile(x, F.lit(p))


def quantile_floor(x: Column, p: float) -> Column:
    """The sorted value at index floor(n * p), n - 1 at most."""
    v = F.sort_array(F.collect_list(x))
    at = F.least(F.floor(F.size(v) * p).cast("int"), F.size(v) - 1)
    return F.when(F.size(v) > 0, F.element_at(v, at + 1))


def average_rank(by: list[str], x: str) -> Column:
    """Average rank of ties, from 1, within groups (or a constant group)."""
    part = Window.partitionBy(*(by or [F.lit(0)]))
    return F.rank().over(part.orderBy(x)) + (F.count(F.lit(1)).over(part.partitionBy(*(by or [F.lit(0)]), x)) - 1) / 2.0
