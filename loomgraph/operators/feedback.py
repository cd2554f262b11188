"""Confidence from feedback: an ordered fold with bounds, per node.

An event moves a confidence by its delta within bounds, a clamp ``x -> min(max(x + s, lo), hi)``. Clamps compose to clamps, so a node's
events are folded in pieces of ``PIECE`` in order and the pieces' clamps thereafter: no row holds all events of a hot node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import feedback_signal

PIECE = 256
STEP, LOW, HIGH, NEUTRAL = 0.25, 0.1, 1.0, 0.5


def delta(sign: Column, weight: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)) * F.lit(STEP) * sign


def signals(events: DataFrame) -> DataFrame:
    """``events(seq, node_id, kind[, weight])`` with their ``delta``; a given weight overrides the kind's."""
    sign, weight = feedback_signal(F.col("kind"))
    own = F.coalesce("weight", weight) if "weight" in events.columns else weight
    return events.select("seq", "node_id", delta(sign, own.cast("double")).alias("delta"))


def _pieces(events: DataFrame) -> DataFrame:
    """``(id, piece, d)``: each node's events in order, ``PIECE`` at a time."""
    turn = F.row_number().over(Window.partitionBy("node_id").orderBy("seq", "delta"))
    numbered = signals(events).where("node_id is not null").withColumn("turn", turn).withColumn("piece", F.floor((F.col("turn") - 1) / PIECE).cast("int"))
    return numbered.groupBy(F.col("node_id").alias("id"), "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "seq", "delta"))).alias("d"))


def _bounded(x: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))


def _clamp() -> Column:
    """The clamp of a piece's events one after the other."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    return F.aggregate("d", start, lambda f, x: F.struct((f["s"] + x["delta"]).alias("s"), _bounded(f["lo"] + x["delta"]).alias("lo"), _bounded(f["hi"] + x["delta"]).alias("hi")))


def _through(start: Column, clamps: Column) -> Column:
    return F.aggregate(clamps, start, lambda x, f: F.greatest(f["lo"], F.least(f["hi"], x + f["s"])))


def apply_feedback(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """``nodes(id, confidence)`` after all events in order of ``seq``; null starts at 0.5 once there is an event; events of unknown nodes are skipped."""
    clamps = _pieces(events).select("id", "piece", _clamp().alias("clamp"))
    per = clamps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "clamp"))), lambda x: x["clamp"]).alias("clamps"))
    moved = _through(F.coalesce("confidence", F.lit(NEUTRAL)).cast("double"), F.col("clamps"))
    joined = nodes.join(per, "id", "left")
    return joined.select(*[F.when(F.col("clamps").isNull(), F.col("confidence")).otherwise(moved).alias("confidence") if c == "confidence" else F.col(c) for c in nodes.columns])


def feedback_trace(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """``(node_id, seq, before, after)`` of every event of a known node."""
    starts = nodes.select("id", F.coalesce("confidence", F.lit(NEUTRAL)).cast("double").alias("start"))
    pieces = _pieces(events).withColumn("clamp", _clamp())
    earlier = F.collect_list("clamp").over(Window.partitionBy("id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("earlier", earlier).join(starts, "id").withColumn("now", _through(F.col("start"), F.col("earlier")))
    first = F.struct(F.col("now").alias("now"), F.array().cast("array<double>").alias("after"))

    def step(state: Column, x: Column) -> Column:
        moved = _bounded(state["now"] + x["delta"])
        return F.struct(moved.alias("now"), F.concat(state["after"], F.array(moved)).alias("after"))

    told = placed.select("id", "now", "d", F.aggregate("d", first, step, lambda s: s["after"]).alias("after"))
    before = F.concat(F.array("now"), F.slice("after", 1, F.size("after") - 1))
    each = told.select("id", F.explode(F.arrays_zip(F.transform("d", lambda x: x["seq"]).alias("seq"), before.alias("before"), F.col("after").alias("after"))).alias("e"))
    return each.select(F.col("id").alias("node_id"), F.col("e.seq").alias("seq"), F.col("e.before").alias("before"), F.col("e.after").alias("after"))


def top_by_confidence(nodes: DataFrame, limit=10) -> DataFrame:
    from ..schema import clamp

    return nodes.orderBy(F.desc_nulls_last("confidence"), "id").limit(clamp(limit, 1, 1000, 10)).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
