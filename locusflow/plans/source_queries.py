"""Registered queries that write files, read them back and go on from what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import counts, geo, mantel
from ..sources import export, ingest, pairs, params
from ..sources.folders import shared_folder
from . import null_queries, oracle, pipelines
from .base_queries import rounded
from .fixtures import coordinates, genotypes
from .null_queries import _ORACLE as NULLS
from .null_queries import IBD, POINTS

LOCI = [f"L{i}" for i in range(1, 7)]
q, qr = oracle.query, null_queries.q


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; results are read from it later, so it stays."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _wide(s, d, nulls: bool = False) -> DataFrame:
    """Genotypes as a file has them: population and coordinates, an id, and a text for each locus."""
    g = genotypes(s, d, nulls).withColumn("g", F.concat_ws("/", "a1", "a2"))
    w = g.groupBy(F.col("indiv").alias("HostInd"), "pop").pivot("locus", LOCI).agg(F.first("g"))
    return w.join(coordinates(genotypes(s, d)), "pop").select(F.concat(F.lit("Île"), F.col("pop")).alias("Population"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), "HostInd", *LOCI)


def _file(s, d, nulls: bool = False) -> ingest.Raw:
    path = _place(s, "wide")
    export.write_table(_wide(s, d, nulls), path)
    return ingest.read_delimited(s, path)


def _tally(geno: DataFrame) -> DataFrame:
    return geno.groupBy("pop", "locus", "a1", "a2").agg(F.count("*").alias("n"))


def ingest_string(s, d):
    """A file with a text for each genotype: told, read and built."""
    raw = _file(s, d)
    return _tally(ingest.build_genotypes(raw, ingest.detect_columns(raw.rows, raw.columns, ingest.missing_code("0"))))


def ingest_paired(s, d):
    """A Latin-1 file with semicolons and two columns a locus."""
    path, cells = _place(s, "paired"), [c for x in LOCI for c in (F.split(x, "/")[0].alias(x), F.split(x, "/")[1].alias(f"{x}_1"))]
    _wide(s, d).select("Population", *cells).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    raw = ingest.read_delimited(s, path)
    return _tally(ingest.build_genotypes(raw, ingest.Columns("Population", markers=[y for x in LOCI for y in (x, f"{x}_1")])))


def ingest_duplicates(s, d):
    """A tab-separated file whose header has each locus twice, with other missing codes and rows that are too short: names, rows and genotypes."""
    path, w = _place(s, "duplicates"), _wide(s, d)
    text = lambda x, i: F.when(F.col(x) == "0/0", "-9").otherwise(F.split(x, "/")[i])
    head = s.range(1).select(F.lit(-1).cast("long").alias("o"), F.lit("\t".join(["Population", *[y for x in LOCI for y in (x, x)]])).alias("value"))
    full = w.select(F.col("HostInd").cast("long").alias("o"), F.concat_ws("\t", "Population", *[text(x, i) for x in LOCI for i in (0, 1)]).alias("value"))
    short = w.filter("HostInd % 100 = 0").select(F.col("HostInd").cast("long").alias("o"), F.lit("short\t1").alias("value"))
    head.union(full).union(short).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    raw = ingest.read_delimited(s, path)
    tally = _tally(ingest.genotypes_paired(raw.rows, "Population", raw.columns[1:])).select("pop", "locus", "a1", "a2", "n")
    about = s.createDataFrame([("separator", raw.sep, raw.malformed), *[("column", c, i) for i, c in enumerate(raw.columns)]], "pop string, locus string, n long")
    return tally.unionByName(about.select("pop", "locus", F.lit(0).alias("a1"), F.lit(0).alias("a2"), "n"))


def ingest_columns(s, d):
    """What is told about a file and its columns."""
    raw = _file(s, d)
    found = ingest.detect_columns(raw.rows, raw.columns, ingest.missing_code("0"))
    base = ingest.infer_base(ingest.build_genotypes(raw, found))
    values = {"separator": raw.sep, "encoding": raw.encoding, "malformed": raw.malformed, "population": found.population, "latitude": found.latitude, "longitude": found.longitude, "markers": ",".join(found.markers), "marker_range": found.marker_range, "metadata": ",".join(found.metadata), "base": base}
    return s.createDataFrame([(k, str(v)) for k, v in values.items()], "what string, value string")


def ingest_meta(s, d):
    raw = _file(s, d)
    meta = ingest.build_meta(raw, ingest.detect_columns(raw.rows, raw.columns, ingest.missing_code("0")))
    return rounded(meta.groupBy(F.col("Population").alias("population"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon")).agg(F.count("*").alias("n"), F.countDistinct("individual").alias("n_ids"), F.sum(F.col("HostInd").cast("long")).alias("id_sum")), "lat", "lon")


def _file_nulls(s, d, name: str) -> DataFrame:
    """A table of the null-allele analysis of a file: populations are the file's names, blanks with null codes tell the loci with null homozygotes."""
    raw = _file(s, d, nulls=True)
    geno = ingest.build_genotypes(raw, ingest.detect_columns(raw.rows, raw.columns, ingest.missing_code("0")))
    chosen = F.when(F.col("locus").isin(*null_queries.HOMO), "null_homo").otherwise("absent")
    return pipelines.null_alleles(geno, geno.select("locus").distinct().withColumn("treat", chosen))[name]


def file_null_t1(s, d):
    return _file_nulls(s, d, "t1")


def file_null_t2(s, d):
    return _file_nulls(s, d, "t2")


def file_null_pairs(s, d):
    return _file_nulls(s, d, "pairs").select("pop1", "pop2", *[F.round(c, 6).alias(c) for c in ("fst_raw", "fst_ena", "dcse_raw", "dcse_ina")])


def file_null_locus_pairs(s, d):
    """FST and chord distances of each pair at each locus, from the file."""
    raw, chords = _file_nulls(s, d, "fst_by_locus_pair"), _file_nulls(s, d, "dcse_by_locus_pair")
    return raw.join(chords.select("locus", "pop1", "pop2", *[F.round(c, 6).alias(c) for c in ("dcse_raw", "dcse_ina")]), ["locus", "pop1", "pop2"])


def export_table(s, d):
    """Allele counts written as delimited files and read back."""
    path = _place(s, "counts")
    export.write_table(counts.allele_counts(genotypes(s, d)), path, "\t")
    return s.read.schema("locus string, pop int, allele int, c long, h long").option("sep", "\t").option("header", True).option("enforceSchema", False).csv(path)


def export_report(s, d):
    """The same as a report with comment lines."""
    path = f"{_place(s, 'report')}/counts.csv"
    export.write_report(counts.allele_counts(genotypes(s, d)), path, export.header("Allele counts", loci=LOCI))
    return s.read.schema("locus string, pop int, allele int, c long, h long").option("header", True).option("comment", "#").csv(path)


def _bundle(s, d) -> list[str]:
    geno, treat = genotypes(s, d, nulls=True), null_queries._treat(genotypes(s, d, nulls=True))
    x = pipelines.null_alleles(geno, treat)
    names = [r["pop"] for r in geno.select("pop").distinct().orderBy("pop").collect()]
    return export.write_null_bundle(_place(s, "bundle"), "run", x["t1"], x["t2"], x["pairs"], x["fst_by_locus_pair"], x["dcse_by_locus_pair"], names, LOCI)


def export_null_bundle(s, d):
    """The pairs of the five files of a null-allele analysis, read back."""
    schema = "pop1 int, pop2 int, fst_raw double, fst_ena double, dcse_raw double, dcse_ina double"
    x = s.read.schema(schema).option("sep", "\t").option("header", True).option("comment", "#").option("nullValue", "NA").csv(_bundle(s, d)[2])
    return x.select("pop1", "pop2", *[F.round(c, 6).alias(c) for c in ("fst_raw", "fst_ena", "dcse_raw", "dcse_ina")])


def export_half_matrices(s, d):
    """The half matrices of FST by locus, read back as rows of pairs."""
    # a blank line ends a block
    block = s.read.option("lineSep", "\n\n").text(_bundle(s, d)[3]).filter("value <> ''").select(F.split("value", "\n").alias("x"))
    title, names = F.split(F.col("x")[0], ": "), F.split(F.col("x")[1], "\t")
    lines = block.select(title[0].alias("locus"), title[1].alias("statistic"), names.alias("names"), F.explode(F.slice("x", 3, F.size("x"))).alias("line")).withColumn("cells", F.split("line", "\t"))
    cells = lines.select("locus", "statistic", F.col("cells")[0].cast("int").alias("pop2"), F.explode(F.arrays_zip("names", "cells")).alias("c")).filter("c.names <> '' AND c.cells <> ''")
    return cells.select("locus", "statistic", F.col("c.names").cast("int").alias("pop1"), "pop2", F.col("c.cells").try_cast("double").alias("value"))


def export_ibd_report(s, d):
    """The table of pairs of a regression report, read back."""
    path, x = f"{_place(s, 'ibd')}/report.txt", null_queries._ibd(s, d).select("pop1", "pop2", "fst_raw", "d", "fr_raw")
    export.write_ibd_report(path, geo.regression_summary(x, "d", {"1D": "fr_raw"}), x, "1D", "fst_raw")
    cells = F.split("value", "\t")
    lines = s.read.text(path).filter((F.size(cells) == 5) & ~F.col("value").startswith("pop1"))
    return rounded(lines.select(cells[0].cast("int").alias("pop1"), cells[1].cast("int").alias("pop2"), *[cells[i].try_cast("double").alias(c) for i, c in enumerate(("fst_raw", "d", "fr_raw"), 2)]), "fst_raw", "d", "fr_raw")


def params_store(s, d):
    """Settings written, overwritten, cleared and written again."""
    store = params.Store(s, f"params_{uuid.uuid4().hex}", _place(s, "params"))
    store.upsert(seed=1, gone="x")
    store.clear()
    store.upsert(seed=1, markers=["L1"], base=100)
    store.upsert(seed=7, name="")
    rows = [(k, str(v)) for k, v in store.all().items()] + [("missing", str(store.get("none", "default"))), ("empty", str(store.get("name", "default"))), ("first", store.get("markers")[0])]
    s.sql(f"DROP TABLE {store.name}")
    return s.createDataFrame(rows, "key string, value string")


def table_saved(s, d):
    """Allele counts saved as a table of the catalog and read back."""
    name = f"counts_{uuid.uuid4().hex}"
    export.save(counts.allele_counts(genotypes(s, d)).select("locus", "pop", "allele", "c", "h"), name, partition_by=["locus"])
    out = s.createDataFrame(s.table(name).select("locus", "pop", "allele", "c", "h").collect(), "locus string, pop int, allele int, c long, h long")  # loci x populations x alleles
    s.sql(f"DROP TABLE {name}")
    return out


def stream_counts(s, d):
    """Allele counts of genotypes that arrive in three files, kept up by a stream."""
    path, names = _place(s, "stream"), ["indiv", "pop", "locus", "a1", "a2"]
    g = genotypes(s, d).select(names)
    for k in range(3):
        g.filter(F.col("indiv") % 3 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    live = s.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = f"live_{uuid.uuid4().hex}"
    query = streaming.start_counts(live, name, f"{path}/checkpoint")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return s.table(name).select("locus", "pop", "allele", "c", "h")


def mantel_incomplete(s, d):
    """A Mantel test where some pairs have no genetic distance, and populations lie in one matrix only."""
    x = null_queries._ibd(s, d).select("pop1", "pop2", F.when(F.col("pop1") != 2, F.col("d")).alias("d"), F.when(((F.col("pop1") + F.col("pop2")) % 4 != 0) & (F.col("pop2") != 5), F.col("fr_raw")).alias("fr_raw"))
    return rounded(mantel.mantel(x, "d", "fr_raw", null_queries.B, null_queries.SEED), *null_queries.MANTEL)


def pairs_filtered(s, d):
    """Rows of a locus with a population on either side."""
    return pipelines.filter_pairs(null_queries.fst_locus_pair(s, d), "L2", 3)


def pairs_file(s, d):
    """Genetic distances from a file under other names, with what follows from them."""
    path = _place(s, "pairs")
    x = null_queries._ibd(s, d).select(F.col("pop1").alias("Farm1"), F.col("pop2").alias("Farm2"), F.col("fst_raw").alias("FST_raw"), (F.col("fst_raw") - 0.01).alias("FST_raw_CI_lo_loci"), F.when(F.col("pop1") % 5 != 0, F.col("d")).cast("string").alias("D_geo"))
    export.write_table(x.na.fill("NA", ["D_geo"]), path, ";")
    t = pairs.genetic_table(pairs.read_pairs(s, path))
    return rounded(t.select("pop1", "pop2", "fst_raw", "fst_raw_lo", "fst_ena", "fr_raw", "fr_raw_lo", "fr_ena", "d", "ln_d"), "fst_raw", "fst_raw_lo", "fst_ena", "fr_raw", "fr_raw_lo", "fr_ena", "d", "ln_d")


def distance_file(s, d):
    """Distances from a file with repeated pairs, of which the first counts; other pairs are left out."""
    path, x = _place(s, "distances"), null_queries._ibd(s, d).select("pop1", "pop2", "fst_raw", "d", "ln_d")
    some = x.filter((F.col("pop1") + F.col("pop2")) % 3 == 0)
    first = some.select(F.lit(0).alias("o"), F.col("pop2").alias("ID1"), F.col("pop1").alias("ID2"), (F.col("pop1") * 10 + F.col("pop2")).alias("Dist"))
    second = some.select(F.lit(1).alias("o"), F.col("pop1").alias("ID1"), F.col("pop2").alias("ID2"), F.lit(1).alias("Dist"))
    first.unionByName(second).repartition(1).sortWithinPartitions("o", "ID1", "ID2").drop("o").write.option("header", True).csv(path)
    return rounded(geo.external_distances(x, pairs.distance_table(pairs.read_pairs(s, path)), order="row"), "fst_raw", "d", "ln_d")


def mantel_columns(s, d):
    """What a Mantel test takes from a table of pairs, and what it warns of."""
    x = null_queries._ibd(s, d)
    names = [c for c, t in x.dtypes if t == "double"]
    plain = pairs.guess_columns(x.columns, [n for n in names if n != "ln_d"])
    found = pairs.guess_columns(x.columns, names)
    rows = [*found.items(), ("plain_x", plain["x"]), ("warned", str(pairs.raw_distance_warning("Dgeo_m") is not None)), ("warned_log", str(pairs.raw_distance_warning("Dgeo_m", True) is not None)), ("warned_ln", str(pairs.raw_distance_warning("lnDgeo") is not None))]
    return s.createDataFrame(rows, "what string, value string")


_QUERIES = [file_null_t1, file_null_t2, file_null_pairs, file_null_locus_pairs, ingest_string, ingest_paired, ingest_duplicates, ingest_columns, ingest_meta, export_table, export_report, export_null_bundle, export_half_matrices, export_ibd_report, params_store, table_saved, stream_counts, mantel_incomplete, pairs_filtered, pairs_file, distance_file, mantel_columns]

_TALLY = "SELECT 'Île' || pop AS pop, locus, a1::INT AS a1, a2::INT AS a2, count(*) AS n FROM geno GROUP BY ALL"
_LIN = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(0.9999, {x})) / (1 - greatest(0, least(0.9999, {x}))) END"
_HALF = " UNION ALL ".join(f"SELECT locus, '{v}' AS statistic, pop1, pop2, {v} AS value FROM ({NULLS['fst_locus_pair']}) WHERE {v} IS NOT NULL" for v in ("fst_raw", "fst_ena"))


def _named(sql: str) -> str:
    """The same with the names that the file has."""
    return sql.replace("geno AS (", "numbered AS (", 1).replace("valid AS (", "geno AS (SELECT indiv, 'Île' || pop AS pop, locus, a1, a2, coded FROM numbered),\nvalid AS (", 1)


_ORACLE = {
    "file_null_t1": _named(NULLS["null_t1"]),
    "file_null_t2": _named(NULLS["null_t2"]),
    "file_null_pairs": f"SELECT * FROM ({_named(NULLS['fst_pair'])}) JOIN ({_named(NULLS['dcse_pair'])}) USING (pop1, pop2)",
    "file_null_locus_pairs": f"SELECT * FROM ({_named(NULLS['fst_locus_pair'])}) JOIN ({_named(NULLS['dcse_locus_pair'])}) USING (locus, pop1, pop2)",
    "ingest_string": q(_TALLY),
    "ingest_paired": q(_TALLY),
    "ingest_duplicates": q("SELECT 'Île' || pop AS pop, locus, a1::INT AS a1, a2::INT AS a2, count(*) AS n FROM geno GROUP BY ALL UNION ALL SELECT 'separator', chr(9), 0, 0, (SELECT count(DISTINCT indiv) FROM geno WHERE indiv % 100 = 0) UNION ALL SELECT 'column', c, 0, 0, i FROM (VALUES ('Population', 0), ('L1', 1), ('L1_1', 2), ('L2', 3), ('L2_1', 4), ('L3', 5), ('L3_1', 6), ('L4', 7), ('L4_1', 8), ('L5', 9), ('L5_1', 10), ('L6', 11), ('L6_1', 12)) t(c, i)"),
    "ingest_columns": "SELECT * FROM (VALUES ('separator', ','), ('encoding', 'UTF-8'), ('malformed', '0'), ('population', 'Population'), ('latitude', 'Latitude'), ('longitude', 'Longitude'), ('markers', 'L1,L2,L3,L4,L5,L6'), ('marker_range', '5:10'), ('metadata', 'Latitude,Longitude,HostInd'), ('base', '1000')) t(what, value)",
    "ingest_meta": q(POINTS, "SELECT 'Île' || pop AS population, R(lat) AS lat, R(lon) AS lon, count(*) AS n, count(*) AS n_ids, sum(indiv)::BIGINT AS id_sum FROM (SELECT DISTINCT indiv, pop FROM geno) JOIN pt USING (pop) GROUP BY pop, pt.lat, pt.lon"),
    "export_table": q(oracle.counts(), "SELECT locus, pop, allele, c, h::BIGINT AS h FROM cnt"),
    "export_report": q(oracle.counts(), "SELECT locus, pop, allele, c, h::BIGINT AS h FROM cnt"),
    "table_saved": q(oracle.counts(), "SELECT locus, pop, allele, c, h::BIGINT AS h FROM cnt"),
    "stream_counts": q(oracle.counts(), "SELECT locus, pop, allele, c, h::BIGINT AS h FROM cnt"),
    "mantel_incomplete": null_queries._mantel_sql("corr(x, y)", source="SELECT pop1, pop2, CASE WHEN pop1 <> 2 THEN d END AS x, CASE WHEN (pop1 + pop2) % 4 <> 0 AND pop2 <> 5 THEN fr_raw END AS y FROM ib").replace("count(*) AS n_pairs FROM mt", "count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_pairs FROM mt").replace("regr_slope(fr_raw, d) AS slope, regr_intercept(fr_raw, d) AS intercept, regr_r2(fr_raw, d) AS r2 FROM ib", "regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM mt"),
    "export_null_bundle": f"SELECT * FROM ({NULLS['fst_pair']}) JOIN ({NULLS['dcse_pair']}) USING (pop1, pop2)",
    "export_half_matrices": _HALF,
    "export_ibd_report": qr(*IBD, "SELECT pop1, pop2, R(fst_raw) AS fst_raw, R(d) AS d, R(fr_raw) AS fr_raw FROM ib"),
    "params_store": "SELECT * FROM (VALUES ('seed', '7'), ('markers', '[''L1'']'), ('base', '100'), ('name', ''), ('missing', 'default'), ('empty', 'default'), ('first', 'L1')) t(key, value)",
    "pairs_filtered": f"SELECT * FROM ({NULLS['fst_locus_pair']}) WHERE locus = 'L2' AND (pop1 = 3 OR pop2 = 3)",
    "pairs_file": qr(*IBD, f"SELECT pop1::VARCHAR AS pop1, pop2::VARCHAR AS pop2, R(fst_raw) AS fst_raw, R(lo) AS fst_raw_lo, NULL::DOUBLE AS fst_ena, R({_LIN('fst_raw')}) AS fr_raw, R({_LIN('lo')}) AS fr_raw_lo, NULL::DOUBLE AS fr_ena, R(dd) AS d, R(CASE WHEN dd > 0 THEN ln(dd) END) AS ln_d FROM (SELECT *, fst_raw - 0.01::DOUBLE AS lo, CASE WHEN pop1 % 5 <> 0 THEN d END AS dd FROM ib)"),
    "distance_file": NULLS["ibd_external"],
    "mantel_columns": "SELECT * FROM (VALUES ('pop1', 'pop1'), ('pop2', 'pop2'), ('x', 'ln_d'), ('y', 'fr_raw'), ('plain_x', 'd'), ('warned', 'True'), ('warned_log', 'False'), ('warned_ln', 'False')) t(what, value)",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
