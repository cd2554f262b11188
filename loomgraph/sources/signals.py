"""Where feedback events come from."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

EVENTS = "seq long, node_id string, kind string, weight double, source string"


class SignalSource(Protocol):
    def collect(self) -> DataFrame: ...


class KnowledgeSource(Protocol):
    def ingest(self) -> dict[str, DataFrame]: ...


class NoSignals:
    """A source that has nothing to tell."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def collect(self) -> DataFrame:
        return self.spark.createDataFrame([], EVENTS)


class TableSignals:
    """Events of a DataFrame, in the declared shape."""

    def __init__(self, events: DataFrame):
        self.events = events

    def collect(self) -> DataFrame:
        return self.events
