"""Feedback as a stream: keyed state holds each node's confidence."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import cut, drop, shared_dir
from ..operators import feedback


def running_confidence(events: DataFrame, late: str | None = None) -> DataFrame:
    """``(node_id, seq, before, after)`` of each event of a stream ``(seq, node_id, kind[, weight][, ts])``.

    State is one number per node, 0.5 at first. Within a micro-batch events apply in order of ``seq``;
    an event of a later batch can't change history. With ``late`` (and a column ``ts``) events older than
    the watermark are dropped and repeated ones of the same ``seq`` count once.
    """
    if late:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id", "seq"])
    rows = feedback.signals(events)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else feedback.NEUTRAL
        pdf = pd.concat(list(parts)).sort_values("seq", kind="stable")
        before, after = [], []
        for d in pdf["delta"]:
            before.append(now)
            now = max(feedback.LOW, min(feedback.HIGH, now + d))
            after.append(now)
        state.update((now,))
        yield pd.DataFrame({"node_id": key[0], "seq": pdf["seq"].to_numpy(), "before": before, "after": after})

    return rows.groupBy("node_id").applyInPandasWithState(step, "node_id string, seq long, before double, after double", "confidence double", "append", GroupStateTimeout.NoTimeout)


def evolved(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """``nodes(id, confidence)`` after all that a stream of events holds now, batch by batch.

    Each batch's result is a table in the shared folder, so a batch that is run again after a loss starts from the same rows.
    """
    now = [cut(nodes, "evolved")]
    done: list[int] = []

    def apply(batch: DataFrame, number: int) -> None:
        if number in done:
            return
        before = now[0]
        now[0] = cut(feedback.apply_feedback(before, batch), "evolved")
        done.append(number)
        drop(before)

    checkpoint = f"{shared_dir(events.sparkSession)}/evolved-{uuid.uuid4().hex}"
    events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return now[0]


def evolve(store, events: DataFrame, label: str, checkpoint: str):
    """Applies a stream to a stored label, batch by batch; the query's handle is returned."""

    def apply(batch: DataFrame, _: int) -> None:
        store.replace({label: feedback.apply_feedback(store.table(label), batch)})

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
