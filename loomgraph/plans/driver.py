"""Graph inputs derived from the driver tables, in the DataFrame API and, term by term, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import gathered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: str) -> Column:
    return F.col(c).cast("string")


def functions(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(text("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("ordinal"))


FUNCTIONS = "functions AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS file, p_partkey AS ordinal FROM part)"


def steps(spark, sf) -> DataFrame:
    """One row per call site: within an order, each part calls the next."""
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = gathered(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    return lines.select(text("l_partkey").alias("src"), F.lead("l_partkey").over(after).cast("string").alias("dst")).where("dst is not null and src != dst")


def calls(spark, sf) -> DataFrame:
    return gathered(steps(spark, sf), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("call_count"))


CALLS = """calls AS (SELECT src, dst, count(*) AS call_count FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS VARCHAR) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def seed_name(spark, sf) -> str:
    """The least function name, whatever the tables hold."""
    return table(spark, sf, "part").agg(F.min("p_name")).first()[0]


SEED = "(SELECT min(p_name) FROM part)"


def raw_calls(spark, sf) -> DataFrame:
    """Call sites by name: a line of an order calls the part named like the supplier's key says."""
    names = functions(spark, sf)
    caller = names.select(F.col("id").alias("from_id"), "file")
    callee = names.select(F.col("id").alias("to"), F.col("name").alias("callee"))
    return steps(spark, sf).join(caller, F.col("src") == F.col("from_id")).join(callee, F.col("dst") == F.col("to")).select("from_id", "callee", "file")


RAW_CALLS = f"""{FUNCTIONS}, steps AS (SELECT src, dst FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS VARCHAR) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst),
raw_calls AS (SELECT s.src AS from_id, b.name AS callee, a.file FROM steps s JOIN functions a ON a.id = s.src JOIN functions b ON b.id = s.dst),
names AS (SELECT file, name, arg_max(id, ordinal) AS id FROM functions GROUP BY file, name),
anywhere AS (SELECT name, count(DISTINCT id) AS candidates, min(id) AS only_id FROM names GROUP BY name),
resolved AS (SELECT r.from_id, r.callee, r.file,
  CASE WHEN n.id IS NOT NULL THEN n.id WHEN a.candidates = 1 THEN a.only_id END AS to_id,
  CASE WHEN n.id IS NOT NULL THEN 'local' WHEN a.candidates = 1 THEN 'global' WHEN a.candidates > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome
  FROM raw_calls r LEFT JOIN names n ON n.file = r.file AND n.name = r.callee LEFT JOIN anywhere a ON a.name = r.callee)"""


# Knowledge: suppliers are specs, customers decisions; an order makes its customer impact the suppliers of its lines.
def specs(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(text("s_suppkey").alias("id"), F.col("s_name").alias("title"), (F.col("s_suppkey") % 7 / 10).alias("confidence"))


def decisions(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(text("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 11) / 10).alias("confidence"))


def impacts(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(text("o_custkey").alias("src"), text("l_suppkey").alias("dst")).distinct()


def supersedes(spark, sf) -> DataFrame:
    before = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf, "customer").select(text("c_custkey").alias("src"), F.lag("c_custkey").over(before).cast("string").alias("dst")).where("dst is not null")


KNOWLEDGE = """decisions AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 11) / 10.0::DOUBLE END AS confidence FROM customer),
impacts AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
supersedes AS (SELECT src, dst FROM (SELECT CAST(c_custkey AS VARCHAR) AS src, CAST(lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR) AS dst FROM customer) WHERE dst IS NOT NULL)"""
SPEC = "1"


# Parse health: a page or document is a file of its source's directory.
def health(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    d = table(spark, sf, "documents").join(labels, "doc_id", "left")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/f"), text("doc_id"), F.lit(".ts"))
    return d.select(
        path.alias("path"),
        F.col("lang").alias("language"),
        F.col("doc_id").alias("ordinal"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("cannot read '"), path, F.lit("' at line "), text("n_chars"))).alias("failed"),
        F.when(F.col("quality") == 0, F.col("n_chars") % 5).otherwise(0).alias("error_nodes"),
        F.when(F.col("quality") == 0, F.array(F.concat(F.lit("E"), (F.col("n_chars") % 3).cast("string")), F.concat(F.lit("L"), F.col("lang")))).otherwise(F.array().cast("array<string>")).alias("signatures"),
    )


HEALTH = """marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
paths AS (SELECT d.*, m.toxic, m.quality, concat(source, '/', lang, '/f', doc_id, '.ts') AS path FROM documents d LEFT JOIN marks m USING (doc_id)),
health AS (SELECT path, lang AS language, doc_id AS ordinal,
  CASE WHEN toxic = 1 THEN concat('cannot read ''', path, ''' at line ', n_chars) END AS failed,
  CASE WHEN quality = 0 THEN n_chars % 5 ELSE 0 END AS error_nodes,
  CASE WHEN quality = 0 THEN [concat('E', n_chars % 3), concat('L', lang)] ELSE CAST([] AS VARCHAR[]) END AS signatures FROM paths)"""


def feedback_events(spark, sf) -> DataFrame:
    return as_feedback(table(spark, sf, "events"))


def as_feedback(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in (("error", "test_fail"), ("view", "test_pass"), ("purchase", "human_fix"), ("click", "status_change"), ("signup", "unknown")) for x in kv])
    return events.select(F.struct("ts", "event_id").alias("seq"), "event_id", text("user_id").alias("node_id"), kind[F.col("event_type")].alias("kind"))


def judged_nodes(spark, sf) -> DataFrame:
    """Users that are also customers: events of others have no node."""
    return table(spark, sf, "customer").select(text("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 10 + 1) / 10).alias("confidence"))


FEEDBACK = """deltas AS (SELECT ts, event_id, CAST(user_id AS VARCHAR) AS node_id,
  CASE event_type WHEN 'error' THEN -0.25::DOUBLE WHEN 'view' THEN 0.4::DOUBLE * 0.25::DOUBLE WHEN 'purchase' THEN 0.6::DOUBLE * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS delta FROM events),
judged AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 10 + 1) / 10.0::DOUBLE END AS confidence FROM customer)"""
