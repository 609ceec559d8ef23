"""Result files: delimited tables, and single text files with a header of comments.

A single file is written by Spark as parts, in the order of the rows, and its parts are joined through the file system of its path (``files.write_lines``), so a report may be
of any size and lie anywhere Spark writes.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", single: bool = False) -> None:
    """Delimited files with a header, one for each partition, or one in all."""
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def save(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).saveAsTable(name)


def header(title: str, dataset: str | None = None, subsamples: list | None = None, loci: list | None = None, n_perm: int | None = None, n_boot: int | None = None, unit: str | None = None, extra: dict | None = None, when: datetime.datetime | None = None) -> list[str]:
    """Comment lines ``# key = value`` that say what a table is; what isn't given is left out."""
    names = lambda xs: None if xs is None else f"{len(xs)} [{'; '.join(map(str, xs))}]"
    about = {
        "table": title,
        "written": (when or datetime.datetime.now()).isoformat(sep=" ", timespec="seconds"),
        "input": dataset,
        "populations": names(subsamples or None),
        "loci": names(loci or None),
        "permutations": n_perm,
        "bootstraps": n_boot,
        "resampled unit": unit,
        **(extra or {}),
    }
    return [f"# {key} = {value}" for key, value in about.items() if value is not None]


def _line(df: DataFrame, sep: str) -> Column:
    """A row as text: texts are quoted in CSV, nulls are NA."""
    text = lambda c, kind: F.concat(F.lit('"'), F.col(f"`{c}`"), F.lit('"')) if kind == "string" and sep == "," else F.col(f"`{c}`").cast("string")
    return F.concat_ws(sep, *[F.coalesce(text(c, kind), F.lit("NA")) for c, kind in df.dtypes]).alias("value")


def _names(df: DataFrame, sep: str) -> str:
    return sep.join(f'"{c}"' if sep == "," else c for c in df.columns)


def write_report(df: DataFrame, path: str, lines: list[str], sep: str = ",") -> None:
    """One text file: comment lines, then the table."""
    files.write_lines(df.select(_line(df, sep)), path, [*lines, _names(df, sep)])


def half_matrices(df: DataFrame, values: list[str], populations: list, loci: list) -> DataFrame:
    """``value``: the lines of the lower halves of matrices of pairs, a block for each locus and value, as tab-separated text in order.

    ``df`` has locus, pop1, pop2 and the values.  A block has a title, the names of the columns, a line for each further population and an empty line; pairs without a value are NA.
    """
    spark, names = df.sparkSession, [str(p) for p in populations]
    every, k = F.split(F.lit("\x01".join(names)), "\x01"), len(names)
    cells = F.array(*[F.struct(F.lit(i).alias("s"), F.round(F.col(v), 6).cast("string").alias("v")) for i, v in enumerate(values)])
    long = df.select(F.col("locus").cast("string").alias("locus"), F.col("pop1").cast("string").alias("pop1"), F.col("pop2").cast("string").alias("pop2"), F.explode(cells).alias("x")).select("locus", "pop1", "pop2", "x.*")
    rows = long.filter("v IS NOT NULL").groupBy("locus", "s", F.col("pop2").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("pop1", "v"))).alias("row"))
    blocks = spark.createDataFrame([(i, str(x)) for i, x in enumerate(loci)], "o int, locus string").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))))
    grid = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("name", F.get(every, F.col("i")))
    cell = lambda j: F.when(j < F.col("i"), F.coalesce(F.try_element_at("row", F.get(every, j)), F.lit("NA"))).otherwise("")
    line = F.concat_ws("\t", "name", *([F.transform(F.sequence(F.lit(0), F.lit(k - 2)), cell)] if k > 1 else []))
    top = F.concat("locus", F.lit(": "), F.get(F.array(*map(F.lit, values)), F.col("s")), F.lit("\n" + "\t".join(["", *names[:-1]])))
    text = F.concat(F.when(F.col("i") == 0, top).otherwise(line), F.when(F.col("i") == k - 1, F.lit("\n")).otherwise(""))
    return grid.join(rows, ["locus", "s", "name"], "left").select("o", "s", "i", text.alias("value")).orderBy("o", "s", "i").select("value")


def write_null_bundle(folder: str, name: str, t1: DataFrame, t2: DataFrame, pooled: DataFrame, by_locus: DataFrame, chords: DataFrame, populations: list, loci: list) -> list[str]:
    """The five files of a null-allele analysis: frequencies, summary, pairs, and half matrices of FST and of chord distances by locus."""
    paths = [f"{folder}/{name}_{part}.txt" for part in ("null_frequencies", "summary", "pairs", "fst_by_locus", "dcse_by_locus")]
    for path, df in zip(paths, (t1, t2, pooled), strict=False):
        write_report(df, path, header(path.rsplit("/", 1)[-1]), "\t")
    for path, df, stats in ((paths[3], by_locus, ["fst_raw", "fst_ena"]), (paths[4], chords, ["dcse_raw", "dcse_ina"])):
        files.write_lines(half_matrices(df, stats, populations, loci), path)
    return paths


def write_ibd_report(path: str, summary: DataFrame, table: DataFrame, model: str = "2D", metric: str = "fst_ena") -> None:
    """The regression report: a header, the lines (a row for each), and after an empty line the table of pairs."""
    found = [r["value"] for r in summary.select(_line(summary, "\t")).collect()]
    write_report(table, path, [*header("isolation by distance", extra={"model": model, "genetic distance": metric}), _names(summary, "\t"), *found, ""], "\t")
