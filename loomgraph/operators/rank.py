"""Structural importance and communities as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from ..schema import clamp
from . import vectors
from .traverse import neighbourhood

DAMPING, ITERATIONS = 0.85, 20


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """``(id, rank)``; ranks sum to 1, what dangling vertices hold is spread evenly. Repeated edges count once."""
    v, n = vectors.numbered(vertices)
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    e = edges.select("src", "dst").join(v.toDF("src", "s"), "src").join(v.toDF("dst", "d"), "dst").select("s", F.col("d").alias("i"))
    links = v.select("i").join(e.groupBy("i").agg(F.collect_set("s").alias("sources")), "i", "left")
    links = cut(links.select("i", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources")), "links")
    rank = vectors.pagerank_rounds(links, n, damping, iterations)
    drop(links)
    return v.join(rank, "i").select("id", "rank")


def _keys(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = lambda label, id_: F.concat_ws("\x1f", F.col(label), F.col(id_))
    return nodes.select(key("label", "id").alias("key"), "label", "id", "display"), edges.select(key("src_label", "src").alias("src"), key("dst_label", "dst").alias("dst"))


def god_nodes(nodes: DataFrame, edges: DataFrame, limit=10, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """``(label, id, display, rank)`` of the highest-ranked nodes of the whole graph, isolated ones included."""
    keyed, pairs = _keys(nodes, edges)
    ranks = pagerank(keyed.select(F.col("key").alias("id")), pairs, damping, iterations).withColumnRenamed("id", "key")
    return keyed.join(ranks, "key").orderBy(F.desc("rank"), "label", "id").limit(clamp(limit, 1, 1000, 10)).select("label", "id", "display", "rank")


def related(nodes: DataFrame, edges: DataFrame, seed: str, depth=2, limit=10, iterations: int = ITERATIONS) -> DataFrame:
    """The highest-ranked nodes of the seed's neighbourhood, the seed itself left out; nothing for an unknown seed."""
    near = cut(neighbourhood(nodes, edges, seed, depth), "near")
    inside = nodes.join(near, ["label", "id"], "left_semi")
    ends = near.select(F.col("label").alias("src_label"), F.col("id").alias("src"))
    kept = edges.join(ends, ["src_label", "src"], "left_semi").join(ends.toDF("dst_label", "dst"), ["dst_label", "dst"], "left_semi")
    keyed, pairs = _keys(inside, kept)
    ranks = pagerank(keyed.select(F.col("key").alias("id")), pairs, DAMPING, iterations).withColumnRenamed("id", "key")
    return keyed.join(ranks, "key").where(F.col("id") != F.lit(seed)).orderBy(F.desc("rank"), "label", "id").limit(clamp(limit, 1, 1000, 10)).select("label", "id", "display", "rank")


def communities(vertices: DataFrame, edges: DataFrame, max_phases: int = 20, max_iterations: int = 20) -> DataFrame:
    """``(id, community)`` by Louvain's local moves on the undirected graph, named by their least id.

    All vertices judge their moves at once; half of them, another half each time, may make them, so
    that two neighbours don't swap for ever. Communities then become the next phase's vertices.
    """
    v, n = vectors.numbered(vertices)
    e = edges.where("src != dst").join(v.toDF("src", "s"), "src").join(v.toDF("dst", "d"), "dst")
    w = e.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.count("*").cast("double").alias("w"))
    # Both directions; a vertex with itself carries the weight inside a contracted community.
    pairs = cut(w.select("a", "b", "w").unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "louvain")
    total = pairs.agg(F.sum("w")).first()[0]
    if not total:
        return v.select("id", F.col("id").alias("community"))
    hashes = cut(v.select("i", F.xxhash64("id").alias("h")), "louvain")
    member = cut(v.select("i", F.col("i").alias("c")), "louvain")
    for _ in range(max_phases):
        parts = vectors.parts_of(pairs, pairs.count())
        links = cut(pairs.repartition(parts, "a").groupBy(F.col("a").alias("i")).agg(F.collect_list("b").alias("ends"), F.collect_list("w").alias("weights")), "louvain")
        drop(pairs)
        degrees = cut(links.select("i", F.aggregate("weights", F.lit(0.0), lambda x, y: x + y).alias("k")), "louvain")
        state = cut(links.select("i", F.col("i").alias("c")), "louvain")
        any_move = False
        quiet = 0
        for turn in range(max_iterations):
            moved = cut(vectors.louvain_turn(links, n, total, hashes._cut_path, degrees._cut_path, state._cut_path, turn), "louvain")
            drop(state)
            state = moved
            changes = moved.where("moved").count()
            any_move = any_move or changes > 0
            quiet = 0 if changes else quiet + 1
            if quiet == 2:  # neither half had anywhere to go
                break
        if not any_move:
            break
        before = member
        member = cut(member.join(state.select(F.col("i").alias("c"), F.col("c").alias("c2")), "c", "left").select("i", F.coalesce("c2", "c").alias("c")), "louvain")
        pairs = cut(vectors.contracted(links, n, state._cut_path), "louvain")
        for table in (before, links, degrees, state):
            drop(table)
    member = member.join(v, "i").select("id", "c")
    least = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(least, "c").select("id", "community").orderBy("community", "id")
