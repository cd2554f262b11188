"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, embeddings, language, near_dup, privacy, quality, secrets, substrings, toxicity
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.sanitised_documents(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op10_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_links(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_substrings, op3_decontamination, op4_quality, op5_privacy, op6_near_dup, op7_language, op8_toxicity, op9_bpe, op10_embedding_pairs)}


#: The other operators' results aren't expressible in SQL.
SQL = {
    "op10_embedding_pairs": """
WITH u AS (SELECT vec_id, embedding::FLOAT[] AS v FROM embeddings),
c AS (SELECT v, min(vec_id) AS class_id, count(*) AS copies FROM u GROUP BY v),
l AS (SELECT a.vec_id, count(*) AS links FROM u a JOIN u b ON a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) >= 0.95 - 1e-6 GROUP BY a.vec_id)
SELECT u.vec_id, c.class_id, c.copies, coalesce(l.links, 0) AS links
FROM u JOIN c ON u.v = c.v LEFT JOIN l ON l.vec_id = u.vec_id
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
