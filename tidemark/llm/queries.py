"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import round_trip
from tidemark.llm.clusters import cluster_rows, cluster_sql
from tidemark.llm.frames import read
from tidemark.llm.licenses import license_labels, license_sql
from tidemark.llm.lines import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.pii import pseudonymise, session_key
from tidemark.llm.quality import quality_scores
from tidemark.llm.runs import run_digests
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.tiff import media_features
from tidemark.llm.token_counts import token_counts
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark), count_col="n_replaced", kinds_col="kinds")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count_col="n_removed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(read(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_rows(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_top_k": op2_top_k,
        "op3_pii": op3_pii,
        "op4_simhash": op4_simhash,
        "op5_lines": op5_lines,
        "op6_packing": op6_packing,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_tiff": op9_tiff,
        "op10_quality": op10_quality,
        "op11_licenses": op11_licenses,
        "op12_runs": op12_runs,
        "op13_clusters": op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2_SQL, "op11_licenses": license_sql(), "op13_clusters": cluster_sql()}
