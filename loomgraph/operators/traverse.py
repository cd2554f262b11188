"""Paths of bounded length: callers, callees, chains, neighbourhoods.

A frontier is joined to the edges level by level; what was found before is dropped by an anti join, so
each node is expanded once, however many walks lead to it. Each level is a written table, so plans
stay short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..schema import clamp

MOST_STEPS = 10


def steps(value, default: int = 1, low: int = 1) -> int:
    return clamp(value, low, MOST_STEPS, default)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", include_seeds: bool = False) -> DataFrame:
    """``(id, distance)`` of what lies 1 to ``depth`` edges from ``seeds(id)``, by the shortest way.

    ``direction``: ``out`` follows ``src`` to ``dst``, ``in`` the other way, ``both`` either. A seed on
    a cycle is found as well, at the cycle's length; with ``include_seeds`` seeds have distance 0.
    """
    pairs = edges.select("src", "dst")
    if direction == "in":
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = pairs.where("src is not null and dst is not null").distinct()
    if depth > 1:
        pairs = cut(pairs, "edges")
    start = seeds.select("id").where("id is not null").distinct()
    found = [start.select("id", F.lit(0).alias("distance"))] if include_seeds else []
    frontier = start
    for d in range(1, depth + 1):
        now = frontier.join(pairs, frontier["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct()
        for before in found:
            now = now.join(before, "id", "left_anti")
        level = now.select("id", F.lit(d).alias("distance"))
        if d < depth:
            level = cut(level, "level")
            if level.isEmpty():
                break
        found.append(level)
        frontier = level.select("id")
    result = found[0] if found else start.select("id", F.lit(0).alias("distance")).limit(0)
    for level in found[1:]:
        result = result.unionByName(level)
    return result


def _named(functions: DataFrame, name: str) -> DataFrame:
    return functions.where(F.col("name") == F.lit(name))


def callers(functions: DataFrame, calls: DataFrame, name: str, depth=1) -> DataFrame:
    """``(id, name, file)`` of functions that call one of this name, over ``depth`` calls at most."""
    found = reach(calls, _named(functions, name), steps(depth), "in")
    return functions.join(found, "id", "left_semi").select("id", "name", "file").distinct().orderBy("file", "name", "id")


def callees(functions: DataFrame, calls: DataFrame, name: str, depth=1) -> DataFrame:
    found = reach(calls, _named(functions, name), steps(depth), "out")
    return functions.join(found, "id", "left_semi").select("id", "name", "file").distinct().orderBy("file", "name", "id")


def call_chain(functions: DataFrame, calls: DataFrame, name: str, direction: str = "both", depth=1) -> DataFrame:
    """Callers and callees with their ``direction``; an unknown direction means both."""
    parts = []
    if direction != "callees":
        parts.append(callers(functions, calls, name, depth).withColumn("direction", F.lit("callers")))
    if direction != "callers":
        parts.append(callees(functions, calls, name, depth).withColumn("direction", F.lit("callees")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def definition_files(functions: DataFrame, name: str) -> DataFrame:
    return _named(functions, name).select("file").distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, seed: str, depth=2) -> DataFrame:
    """``(label, id)`` within ``depth`` edges of the seed in either direction, the seed included.

    ``edges(rel, src_label, src, dst_label, dst)``; keys are label and id, so ids that two labels
    share don't leak from one to the other.
    """
    key = lambda label, id_: F.concat_ws("\x1f", F.col(label), F.col(id_))
    pairs = edges.select(key("src_label", "src").alias("src"), key("dst_label", "dst").alias("dst"))
    keyed = nodes.select(key("label", "id").alias("key"), "label", "id")
    found = reach(pairs, keyed.where(F.col("id") == F.lit(seed)).select(F.col("key").alias("id")), steps(depth, 2, 0), "both", True)
    return keyed.join(found.select(F.col("id").alias("key")), "key", "left_semi").select("label", "id").distinct()
