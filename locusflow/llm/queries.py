"""The registered queries of this subpackage, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, language, neighbours, packing, quality, sentencepiece, simhash, substring, tokens, topk, toxicity, urls
from .common import crc_mod, table

K = 35


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, from the ledger."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), check=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = toxicity.learn(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.learn(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.lengths(table(spark, sf_dir, "documents")), length=F.col("n"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digest(table(spark, sf_dir, "documents"), k=K)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS g FROM x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g WHERE len(g) = 35) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(35) t(j)),
k AS (SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n_removed FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_sentencepiece, op3_toxicity, op4_url_filter, op5_token_counts, op6_exact_top_k, op7_language_id, op8_length_packing, op9_simhash, op10_substring_dedup, op11_centroid_clusters, op12_nearest_neighbours)
    return {f.__name__: f for f in own} | {"quality_ablation": quality_ablation, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.SQL, "quality_ablation": quality.ABLATION_SQL, "op6_exact_top_k": topk.SQL, "op10_substring_dedup": SUBSTRING_SQL, "op11_centroid_clusters": centroids.SQL}
