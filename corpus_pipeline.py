"""The corpus pipeline: quality rules, language ID, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the folder of spark.checkpoint.dir and rereads it for the next, after which it is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import language, minhash, packing, quality, simhash, substring, tokens
from locusflow.llm.common import delete, shared_folder

#: A document whose cosine with every language is below this is in none of them.
MIN_COSINE = 0.1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.filter_documents(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; lang becomes the predicted one.  Where no document has a lang to learn from, those with a letter stay as they are."""
    return language.keep_known(docs, language.learn(docs), MIN_COSINE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by SimHash fingerprints (op9) or by a Jaccard similarity of at least 0.8 over five-word shingles, which fingerprints alone miss."""
    return minhash.drop_near_copies(docs, also=simhash.class_links)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated 35-word windows, n_chars anew; documents of which nothing is left stay, as empty texts."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, by the tokens of its text."""
    return packing.pack(tokens.lengths(docs), length=F.col("n"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned language profiles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    top = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            delete(spark, before)
        before = f"{top}/{name}"
    return docs
