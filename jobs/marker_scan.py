"""Incremental scan of texts for words that tell sources apart, as genome scans look for outlier loci.

A word is a dominant marker: a document carries it or not.  Sources are populations, documents individuals, and languages are scanned
apart.  Presence is coded as in haploid data, as a homozygote, so the library's variance components (FST) and
G statistics apply.

    python -m jobs.marker_scan --documents DIR/documents.parquet --output OUT --checkpoint CKPT --config jobs/marker_scan.json

A file stream takes the files of ``documents`` that the checkpoint doesn't have yet, and ends.  Each micro-batch writes how many documents carry each word
to ``OUT/counts/batch=<number>``, over what an earlier try at the same batch may have left.  Counts add up, so the scan
(``OUT/scan/lang=<language>``) is made of the counts of all batches; texts are read once.  Output and checkpoint belong together: delete both or none.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from locusflow.functions import r8
from locusflow.operators import gstat, wc84

LOG = logging.getLogger("marker_scan")
#: min_carriers: documents of a language that must carry a word, and lack it, for it to be a marker.  outlier_fst: from here on a marker is an outlier.  max_files: of a micro-batch.
DEFAULTS = {"min_carriers": 20, "outlier_fst": 0.15, "max_files": 1000}
COUNTS = "lang string, source string, word string, n long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def carriers(docs: DataFrame) -> DataFrame:
    """``lang, source, word, n``: documents that have the word; the row of the empty word counts all documents.

    Words are runs of letters and digits, with A-Z in lower case.  A null language is ``und``, a null source ``unknown``, a null text has no words.
    """
    words = F.array_distinct(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[^\p{L}\p{N}]+"))
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), F.explode(F.array_union(words, F.array(F.lit("")))).alias("word"))
    return own.groupBy("lang", "source", "word").agg(F.count("*").alias("n"))


def scan(counts: DataFrame, min_carriers: int, outlier_fst: float) -> DataFrame:
    """``lang, word, n_docs, n_sources, fst, g, outlier`` of each marker.

    ``n_docs`` and ``n_sources`` are those with the word; ``g`` is of the table of sources by presence; ``outlier`` is null where FST is.
    """
    total = counts.groupBy("lang", "source", "word").agg(F.sum("n").alias("n"))
    sizes = total.filter("word = ''").select("lang", "source", F.col("n").alias("size"))
    whole = sizes.groupBy("lang").agg(F.sum("size").alias("whole"))
    common = total.filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_sources")).filter(F.col("n_docs") >= min_carriers)
    markers = common.join(whole, "lang").filter(F.col("whole") - F.col("n_docs") >= min_carriers).drop("whole")
    grid = markers.select("lang", "word").join(sizes, "lang").join(total, ["lang", "source", "word"], "left")  # every source of the language, with the word or without
    n, absent = F.coalesce("n", F.lit(0)), F.col("size") - F.coalesce("n", F.lit(0))
    alleles = F.array(*[F.struct(F.lit(a).alias("allele"), (2 * c).cast("long").alias("c")) for a, c in ((0, absent), (1, n))])
    table = grid.select("lang", F.col("word").alias("locus"), F.col("source").alias("pop"), F.explode(alleles).alias("x")).filter("x.c > 0").select("lang", "locus", "pop", "x.*", F.lit(0).cast("long").alias("h"))
    fst = wc84.observed(table, ["lang"]).select("lang", F.col("locus").alias("word"), "fst")
    g = gstat.g_by_locus(table, ["lang"]).select("lang", F.col("locus").alias("word"), (F.col("g") / 2).alias("g"))  # copies come in twos
    return markers.join(fst, ["lang", "word"]).join(g, ["lang", "word"]).select("lang", "word", "n_docs", "n_sources", r8(F.col("fst")).alias("fst"), r8(F.col("g")).alias("g"), (F.col("fst") >= outlier_fst).alias("outlier"))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes the files that are new and returns the scan over all that were ever taken, read back."""
    at, documents = settings(DEFAULTS, config), documents.rstrip("/")
    spark.createDataFrame([], COUNTS).write.mode("overwrite").parquet(f"{output}/counts/batch=-1")  # so that there is a table to read without any batch
    wanted = ["text", "lang", "source"]

    def take(batch: DataFrame, number: int) -> None:
        carriers(batch).write.mode("overwrite").parquet(f"{output}/counts/batch={number}")
        LOG.info("batch %d: wrote %s/counts/batch=%d", number, output, number)

    # as a pattern, the path may be one file as well as a folder of files
    pattern = f"{documents[:-1]}[{documents[-1]}]"
    live = spark.readStream.schema(spark.read.parquet(documents).select(wanted).schema).option("maxFilesPerTrigger", at["max_files"]).parquet(pattern)
    query = live.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d new documents of %s", sum(p["numInputRows"] for p in query.recentProgress), documents)
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts")
    scan(counts, at["min_carriers"], at["outlier_fst"]).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/scan")
    out = spark.read.schema("word string, n_docs long, n_sources long, fst double, g double, outlier boolean, lang string").parquet(f"{output}/scan")
    LOG.info("wrote %d markers to %s/scan", out.count(), output)
    return out


if __name__ == "__main__":
    command_line(
        __doc__.split("\n", 1)[0],
        lambda spark, args, config: run(spark, args.documents, args.output, args.checkpoint, config),
        ("documents", "folder or file of Parquet documents (text, lang, source)"),
        ("output", "folder for counts and scan"),
        ("checkpoint", "folder of the stream's checkpoint"),
    )
