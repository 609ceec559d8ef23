"""Allele counts of a stream of genotypes.  Counts are additive, so they are all the state that the estimators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.counts import allele_counts, update_counts


def streaming_counts(geno: DataFrame) -> DataFrame:
    """``locus, pop, allele, c, h`` of a streaming DataFrame of genotypes; the state is a row for each population and allele."""
    return allele_counts(geno)


def start_counts(geno: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps an in-memory table of the counts so far, for estimators to read."""
    return streaming_counts(geno).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def merge_batch(stored_path: str):
    """For ``foreachBatch``: adds a batch's counts to a Parquet table of counts, written beside it and swapped by number."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = allele_counts(batch)
        if number > 0:
            fresh = update_counts(spark.read.parquet(f"{stored_path}/batch={number - 1}"), fresh)
        fresh.write.mode("overwrite").parquet(f"{stored_path}/batch={number}")

    return run
