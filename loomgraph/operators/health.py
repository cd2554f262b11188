"""Index health: what failed to parse, and whether that makes an answer incomplete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LISTED = 20
HEALTHY = "failed is null and error_nodes = 0"


def summary(health: DataFrame) -> DataFrame:
    """One row: total, clean, partial and failed files; failed takes precedence."""
    failed, broken = F.col("failed").isNotNull(), F.col("error_nodes") > 0
    return health.agg(F.count("*").alias("total"), F.count_if(~failed & ~broken).alias("clean"), F.count_if(~failed & broken).alias("partial"), F.count_if(failed).alias("failed"))


def blindspots(health: DataFrame) -> DataFrame:
    """Unhealthy files, failed ones first, then by error nodes."""
    return health.where(f"not ({HEALTHY})").orderBy(F.desc(F.col("failed").isNotNull()), F.desc("error_nodes"), "path")


def touched_blindspots(health: DataFrame, result_files: DataFrame) -> DataFrame:
    """Unhealthy files in a directory above, below or the same as one of ``result_files(file)``.

    Every directory is exploded into its ancestors, which turns the prefix test into equality joins.
    """
    bad = health.where(f"not ({HEALTHY})").withColumn("dir", T.dir_of(F.col("path")))
    dirs = result_files.select(T.dir_of(F.col("file")).alias("dir")).distinct()
    up = lambda c: F.when(c == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), 1, n), "/")))
    above = dirs.select(F.explode(up(F.col("dir"))).alias("up")).distinct()
    below = bad.withColumn("up", F.explode(up(F.col("dir")))).join(dirs.select(F.col("dir").alias("up")), "up", "left_semi").drop("up")
    inside = bad.join(above.select(F.col("up").alias("dir")), "dir", "left_semi")
    return below.select(*health.columns).unionByName(inside.select(*health.columns)).distinct()


def index_health(health: DataFrame, result_files: DataFrame) -> DataFrame:
    """One row of counts with ``possibly_incomplete`` and the first blind spots; no row when all files are healthy."""
    touched = touched_blindspots(health, result_files).agg(F.count("*").alias("blindspots_total"), F.slice(F.sort_array(F.collect_list("path")), 1, LISTED).alias("blindspots"))
    failed, broken = F.col("failed").isNotNull(), F.col("error_nodes") > 0
    all_ = health.agg(F.count("*").alias("files_indexed"), F.count_if(~failed & broken).alias("partial"), F.count_if(failed).alias("failed"))
    return all_.crossJoin(touched).where("partial + failed > 0").withColumn("possibly_incomplete", F.col("blindspots_total") > 0)


def healing(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)``: healed or regressed between two runs; files of one run only don't count."""
    ok = F.expr(HEALTHY)
    both = before.select("path", ok.alias("was")).join(after.select("path", ok.alias("is")), "path")
    return both.where("was != is").select("path", F.when(F.col("is"), "healed").otherwise("regressed").alias("change"))


def signature_buckets(health: DataFrame) -> DataFrame:
    """``(signature, files, language, samples)`` of parse-error signatures, the most frequent first."""
    each = health.select("path", "language", "ordinal", F.explode("signatures").alias("signature"))
    by = each.groupBy("signature").agg(F.count("*").alias("files"), F.min_by("language", "ordinal").alias("language"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]), 1, 5).alias("samples"))
    return by.orderBy(F.desc("files"), "signature")


def failure_buckets(health: DataFrame) -> DataFrame:
    """``(reason, files, languages, samples)`` of failures, by message without its particulars."""
    each = health.where("failed is not null").select("path", "language", "ordinal", T.failure_reason(F.col("failed")).alias("reason"))
    by = each.groupBy("reason").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("language")).alias("languages"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]), 1, 5).alias("samples"))
    return by.orderBy(F.desc("files"), "reason")
