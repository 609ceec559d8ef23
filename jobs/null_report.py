"""Report of null alleles and of isolation by distance corrected for them, over all sites.

The path that users take by hand: name the loci whose blanks are null homozygotes, estimate null frequencies by EM, correct FST (ENA) and
chord distances (INA) of each pair of sites, with intervals over drawn loci, and regress linearised FST on the logarithm of the geodesic
distance, with a Mantel test.

    python -m jobs.null_report --data DIR --output OUT --config jobs/null_report.json

Reads ``customer`` (from which genotypes are derived) and ``nation`` (names of sites) in DIR.  Writes one table of
``locus, pop1, pop2, statistic, value`` to ``OUT/analysis=<name>``.  A run replaces only the analyses that it makes, so a rerun gives the same table
and single analyses can be redone.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from locusflow.functions.cache import keep
from locusflow.operators import geo, mantel, nulls
from locusflow.plans.fixtures import coordinates, genotypes
from locusflow.plans.pipelines import release

LOG = logging.getLogger("null_report")
ANALYSES = ("frequencies", "summary", "pairs", "distance", "regression", "mantel")
#: null_homo: loci whose blanks are null homozygotes, or "auto" for those with null codes.
DEFAULTS = {"analyses": list(ANALYSES), "null_homo": "auto", "n_boot": 1000, "n_perm": 1000, "seed": 12345, "conf": 0.95}
SCHEMA = "locus string, pop1 string, pop2 string, statistic string, value double, analysis string"


def sites(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    """Genotypes (populations are names of sites), and ``pop, lat, lon``."""
    names = spark.read.parquet(f"{data}/nation.parquet").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("_name"))
    geno = genotypes(spark, data, nulls=True)

    def named(df: DataFrame) -> DataFrame:
        return df.join(names, F.col("pop") == F.col("_key")).withColumn("pop", F.col("_name")).drop("_key", "_name")

    return named(geno), named(coordinates(geno))


def treatments(geno: DataFrame, null_homo) -> DataFrame:
    if null_homo == "auto":
        return nulls.suggest_treatments(geno)
    return geno.select("locus").distinct().withColumn("treat", F.when(F.col("locus").isin(list(null_homo)), "null_homo").otherwise("absent"))


def _long(analysis: str, df: DataFrame, values: list[str], locus: str = "", pop1: str = "", pop2: str = "", statistic: str = "") -> DataFrame:
    """A row for each of the values, to 6 decimals (metres to 3); names of key columns that the table has, and the column that goes before the statistic's name."""
    key = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    front = F.concat(F.col(statistic), F.lit(" ")) if statistic else F.lit("")
    cells = F.array(*[F.struct(F.concat(front, F.lit(v)).alias("statistic"), F.round(F.col(v).cast("double"), 3 if v == "d" else 6).alias("value")) for v in values])
    return df.select(key(locus).alias("locus"), key(pop1).alias("pop1"), key(pop2).alias("pop2"), F.explode(cells).alias("x")).select("locus", "pop1", "pop2", "x.*", F.lit(analysis).alias("analysis"))


def tables(geno: DataFrame, points: DataFrame, at: dict) -> dict[str, DataFrame]:
    """The long table of each analysis."""
    treat = treatments(geno, at["null_homo"])
    em = keep(nulls.em_table(geno, treat))
    sizes, rows = nulls.inputs(em)
    # pairs x loci: the table, its replicates and distances start from them
    components, chords = keep(nulls.pairwise_components(sizes, rows)), keep(nulls.pairwise_chord(sizes, rows))
    pairs = keep(nulls.fst_pooled(components, ["pop1", "pop2"]).join(nulls.chord_pooled(chords), ["pop1", "pop2"]))
    by, values = ["pop1", "pop2"], ["fst_raw", "fst_ena", "dcse_raw", "dcse_ina"]
    ends = nulls.shared_intervals(nulls.both(sizes, rows, ["locus"]), components, chords, at["n_boot"], at["seed"], at["conf"])
    ends = ends.withColumnRenamed("ci_l", "lo").withColumnRenamed("ci_u", "hi")  # those of all sites together have no pair
    ibd = keep(geo.ibd_table(pairs.select(*by, "fst_raw", "fst_ena"), pairs.select(*by, "dcse_raw", "dcse_ina"), geo.distances(points)))
    lines = geo.regression_summary(ibd, "ln_d", {"raw": "fr_raw", "corrected": "fr_ena"})
    test = mantel.mantel(ibd, "ln_d", "fr_ena", at["n_perm"], at["seed"]) if "mantel" in at["analyses"] else None
    made = {
        "frequencies": _long("frequencies", nulls.t1(em, treat), ["p_nulls", "n", "n_blanks", "n_exp_blanks"], locus="locus", pop1="subsample"),
        "summary": _long("summary", nulls.t2(em, treat), ["av_n_exp_blanks", "av_p_nulls", "n_tot", "n_blanks", "f_exp_blanks", "p_value"], locus="locus"),
        "pairs": _long("pairs", pairs, values, pop1="pop1", pop2="pop2").unionByName(_long("pairs", ends, ["lo", "hi"], pop1="pop1", pop2="pop2", statistic="statistic")),
        "distance": _long("distance", ibd, ["d", "ln_d", "fr_raw", "fr_ena"], pop1="pop1", pop2="pop2"),
        "regression": _long("regression", lines, ["slope", "intercept", "r2", "n", "b", "nb", "nem"], statistic="line"),
    }
    if test is not None:
        made["mantel"] = _long("mantel", test, ["stat", "p_pos", "p_neg", "p_two", "n_pairs", "n_perm"])
    return made


def run(spark: SparkSession, data: str, output: str, config: dict | None = None) -> DataFrame:
    """Makes the analyses that are asked for and returns all that the output holds, read back."""
    at = settings(DEFAULTS, config)
    wrong = set(at["analyses"]) - set(ANALYSES)
    if wrong:
        raise ValueError(f"no such analyses: {', '.join(sorted(wrong))}")
    geno, points = sites(spark, data)
    geno = keep(geno)
    LOG.info("read %d genotypes of %d sites in %s", geno.count(), points.count(), data)
    made = tables(geno, points, at)
    whole = None
    for name in at["analyses"]:
        whole = made[name] if whole is None else whole.unionByName(made[name])
    if whole is not None:
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis").parquet(output)
    release()
    out = spark.read.schema(SCHEMA).parquet(output)
    for r in out.groupBy("analysis").count().orderBy("analysis").collect():  # a row for each analysis
        LOG.info("%s/analysis=%s has %d rows", output, r["analysis"], r["count"])
    return out


if __name__ == "__main__":
    command_line(
        __doc__.split("\n", 1)[0],
        lambda spark, args, config: run(spark, args.data, args.output, config),
        ("data", "folder with customer.parquet and nation.parquet"),
        ("output", "folder for the partitioned table"),
    )
