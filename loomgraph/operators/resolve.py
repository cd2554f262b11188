"""Call resolution: a call goes to its own file's definition, else to the only one anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_PROVIDER, GLOBAL_CONFIDENCE, LOCAL_CONFIDENCE


def bare_names(definitions: DataFrame) -> DataFrame:
    """``(file, name, id)``: of the definitions of one name in a file the last, by ``ordinal``."""
    return definitions.groupBy("file", "name").agg(F.max_by("id", F.struct("ordinal", "id")).alias("id"))


def global_index(names: DataFrame) -> DataFrame:
    """``(name, candidates, only)`` over the per-file names."""
    return names.groupBy("name").agg(F.count_distinct("id").alias("candidates"), F.min("id").alias("only"))


def resolve_calls(raw_calls: DataFrame, names: DataFrame) -> DataFrame:
    """``(from_id, callee, file, to_id, outcome)``; outcome is local, global, ambiguous or unresolved."""
    local = names.select("file", F.col("name").alias("callee"), F.col("id").alias("local_id"))
    anywhere = global_index(names).withColumnRenamed("name", "callee")
    joined = raw_calls.join(local, ["file", "callee"], "left").join(anywhere, "callee", "left")
    outcome = F.when(F.col("local_id").isNotNull(), "local").when(F.col("candidates") == 1, "global").when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved")
    to = F.when(outcome == "local", F.col("local_id")).when(outcome == "global", F.col("only"))
    return joined.select("from_id", "callee", "file", to.alias("to_id"), outcome.alias("outcome"))


def build_call_edges(resolved: DataFrame) -> DataFrame:
    """``(src, dst, call_count, confidence, provider)`` without calls to oneself."""
    kept = resolved.where("to_id is not null and to_id != '' and to_id != from_id")
    tier = F.when(F.col("outcome") == "local", LOCAL_CONFIDENCE).otherwise(GLOBAL_CONFIDENCE)
    edges = kept.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.count("*").alias("call_count"), F.min(tier).alias("confidence"))
    return edges.withColumn("provider", F.lit(DEFAULT_PROVIDER))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return resolved.agg(F.count("*").alias("call_sites"), is_("local").alias("local_calls"), is_("global").alias("global_calls"), is_("ambiguous").alias("ambiguous"), is_("unresolved").alias("unresolved"))


def cross_file_coverage(names: DataFrame, raw_calls: DataFrame, call_edges: DataFrame, functions: DataFrame) -> DataFrame:
    """``(candidates, covered, coverage)``: of the functions that some other file calls by name, how many have an edge from another file."""
    named = names.select("name", "id", F.col("file").alias("own_file"))
    called = raw_calls.select(F.col("callee").alias("name"), "file").distinct()
    candidates = named.join(called, "name").where("file != own_file").select("id").distinct()
    files = functions.select("id", "file").distinct()
    crossing = call_edges.join(files.toDF("src", "src_file"), "src").join(files.toDF("dst", "dst_file"), "dst").where("src_file != dst_file").select(F.col("dst").alias("id"), F.lit(1).alias("hit")).distinct()
    both = candidates.join(crossing, "id", "left").agg(F.count("*").alias("candidates"), F.count("hit").alias("covered"))
    return both.withColumn("coverage", F.try_divide(F.col("covered") * F.lit(100.0), F.col("candidates")))


def skipped_languages(files: DataFrame, available: list[str]) -> DataFrame:
    """``(language, files, reason)`` of languages without an extractor."""
    return files.where(~F.col("language").isin(available)).groupBy("language").agg(F.count("*").alias("files"), F.first(F.lit("no extractor")).alias("reason"))
