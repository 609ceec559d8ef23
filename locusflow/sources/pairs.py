"""Tables of pairs of populations from files: distances, and genetic distances with their intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linearised
from . import ingest

#: Names under which files have the columns (fixed values, letter case aside), in order of preference.
POP1, POP2 = ("Pop1", "Farm1", "ID1"), ("Pop2", "Farm2", "ID2")
VALUES = {
    "fst_raw": ("FST_raw",),
    "fst_ena": ("FST_ENA",),
    "fst_raw_lo": ("FST_raw_CI_lo_loci", "FST_raw_lo"),
    "fst_raw_hi": ("FST_raw_CI_hi_loci", "FST_raw_hi"),
    "fst_ena_lo": ("FST_ENA_CI_lo_loci", "FST_ENA_lo"),
    "fst_ena_hi": ("FST_ENA_CI_hi_loci", "FST_ENA_hi"),
    "dcse_raw": ("DCSE_raw",),
    "dcse_ina": ("DCSE_INA",),
    "dcse_raw_lo": ("DCSE_raw_CI_lo_loci", "DCSE_raw_lo"),
    "dcse_raw_hi": ("DCSE_raw_CI_hi_loci", "DCSE_raw_hi"),
    "dcse_ina_lo": ("DCSE_INA_CI_lo_loci", "DCSE_INA_lo"),
    "dcse_ina_hi": ("DCSE_INA_CI_hi_loci", "DCSE_INA_hi"),
    "d": ("Dgeo_m", "D_geo", "Distance"),
    "ln_d": ("lnDgeo", "ln(D_geo)"),
}
#: Linearised columns: the names in files, and the column that they are made from where a file has none.
LINEARISED = {
    "fr_ena": ("FR", "fst_ena"),
    "fr_ena_lo": ("FR_lo", "fst_ena_lo"),
    "fr_ena_hi": ("FR_hi", "fst_ena_hi"),
    "fr_raw": ("FR_raw", "fst_raw"),
    "fr_raw_lo": ("FR_raw_lo", "fst_raw_lo"),
    "fr_raw_hi": ("FR_raw_hi", "fst_raw_hi"),
}
LEAST_ROWS = 3


def pick(names: list[str], aliases: tuple[str, ...], otherwise: str | None = None) -> str | None:
    """The column with the first alias that any has, whatever the letter case."""
    lower = {n.lower(): n for n in reversed(names)}
    return next((lower[a.lower()] for a in aliases if a.lower() in lower), otherwise)


def read_pairs(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> ingest.Raw:
    """A delimited file with three rows at least, else an error; all cells are text, and rows are numbered in file order."""
    raw = ingest.read_delimited(spark, path, sep, header)
    if raw.rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"{path} has fewer than {LEAST_ROWS} rows; check separator and header")
    return raw


def populations(names: list[str]) -> tuple[str, str]:
    """The two columns that name a pair: by alias, else the first and second."""
    if len(names) < 2:
        raise ValueError("two columns with populations are needed")
    one, two = pick(names, POP1, names[0]), pick(names, POP2, names[1])
    if one == two:
        raise ValueError("two different columns with populations are needed")
    return one, two


def guess_columns(names: list[str], numeric: list[str]) -> dict[str, str | None]:
    """What a Mantel test would take from a table: pop1, pop2, x (a logarithm of a distance, else a distance) and y (linearised, else other genetic distance)."""
    one, two = populations(names)
    rest = [n for n in numeric if n not in (one, two)]
    x = pick(rest, ("lnDgeo", "ln(D_geo)", "ln_d", "Dgeo_m", "D_geo", "Distance", "d"), rest[0] if rest else None)
    left = [n for n in rest if n != x]
    return {"pop1": one, "pop2": two, "x": x, "y": pick(left, ("FR", "FR_raw", "fr_ena", "fr_raw", "FST_ENA", "FST_raw", "DCSE_INA", "DCSE_raw"), left[0] if left else None)}


def raw_distance_warning(column: str | None, logged: bool = False) -> str | None:
    """A warning where a column looks like a distance that isn't logged; None otherwise."""
    name = (column or "").lower()
    if logged or not re.search("dgeo|dist", name) or re.search("ln|log", name):
        return None
    return f"{column} looks like a plain distance; in two dimensions genetic distance is regressed on its logarithm, and r and slope differ (rank correlations don't)"


def _number(column: str | None) -> Column:
    x = F.col(f"`{column}`").try_cast("double") if column else F.lit(None).cast("double")
    return F.when(~F.isnan(x), x)


def genetic_table(raw: ingest.Raw) -> DataFrame:
    """``pop1, pop2``, the genetic distances with their bounds, ``d`` and ``ln_d``: what the file has, what follows from it (linearised FST, ln_d of a positive d), else null."""
    one, two = populations(raw.columns)
    x = raw.rows.select(F.trim(F.col(f"`{one}`")).alias("pop1"), F.trim(F.col(f"`{two}`")).alias("pop2"), *[_number(pick(raw.columns, v)).alias(k) for k, v in VALUES.items()], *[_number(pick(raw.columns, (v,))).alias(k) for k, (v, _) in LINEARISED.items()])
    made = {k: linearised(F.col(source)) for k, (v, source) in LINEARISED.items() if pick(raw.columns, (v,)) is None}
    finite = F.abs("ln_d") < float("inf")
    return x.withColumns({**made, "ln_d": F.when(finite, F.col("ln_d")).otherwise(F.when(F.col("d") > 0, F.log("d")))})


def distance_table(raw: ingest.Raw) -> DataFrame:
    """``Pop1, Pop2, Distance, row`` of a file of distances, for ``geo.external_distances``."""
    if len(raw.columns) < 3:
        raise ValueError("three columns are needed: two populations and a distance")
    one, two = populations(raw.columns)
    named = pick(raw.columns, ("Distance",)) or next((n for n in raw.columns if n.lower().startswith("dgeo")), None) or pick(raw.columns, ("Dist",), raw.columns[2])
    return raw.rows.select(F.col(f"`{one}`").alias("Pop1"), F.col(f"`{two}`").alias("Pop2"), F.col(f"`{named}`").alias("Distance"), F.col("indiv").alias("row"))


def merge_extra(table: DataFrame, raw: ingest.Raw) -> DataFrame:
    """Adds the file's other columns to the pairs that it has (its first two columns name them, in any order; of repeated pairs the first row counts)."""
    from ..operators.geo import first_rows, pair_key

    one, two, *rest = raw.columns
    if not rest:
        raise ValueError("two columns with populations and one more at least are needed")
    extra = first_rows(raw.rows.withColumn("_key", pair_key(F.col(f"`{one}`"), F.col(f"`{two}`"))), "indiv").select("_key", *[_number(c).alias(c) for c in rest])
    return table.withColumn("_key", pair_key(F.col("pop1"), F.col("pop2"))).join(extra, "_key", "left").drop("_key")
