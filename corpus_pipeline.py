"""The corpus pipeline: five stages from ``documents`` to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run`` writes
each result as Parquet in the shared folder and reads it again as the next stage's input, so a lost
executor never costs more than the running stage. All stages but the last return the columns of
``documents``.

Defined results: a null or empty text is never toxic, near-duplicate by text, contaminated or
secret and ends with null ids or an empty list; empty texts are copies of each other, so one
stays; an empty table stays empty; further columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontamination, near_dup, secrets, toxicity
from loomgraph.llm.common import discard, has_table, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words are learnt from ``labels`` where the folder has that table."""
    return toxicity.clean_documents(docs, labels=table(spark, sf_dir, "labels") if has_table(spark, sf_dir, "labels") else None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; ``n_chars`` follows the text."""
    redacted = secrets.redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.with_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No stage is expressible in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
