"""The parse manifest: file health by root, a folder per run behind one index file."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DDL = "path string, language string, failed string, error_nodes int, error_extent long, source_extent long, signatures array<string>, ordinal string, indexed_at timestamp, root string"


class Unreadable(ValueError):
    """The manifest is there but can't be read, so that health is unknown, not good."""


def _index(path: str) -> dict[str, str]:
    """Each root's folder."""
    try:
        with open(f"{path}/INDEX") as f:
            found = json.load(f)
        if isinstance(found, dict) and all(isinstance(v, str) for v in found.values()):
            return found
    except FileNotFoundError:
        return {}
    except (OSError, ValueError):
        pass
    raise Unreadable("the manifest exists but could not be parsed")


def read(spark: SparkSession, path: str, root: str | None = None) -> DataFrame | None:
    """Files of all roots, or of one; None where no run was written yet."""
    folders = [f"{path}/{v}" for k, v in _index(path).items() if root is None or k == root]
    if not all(map(os.path.isdir, folders)):
        raise Unreadable("the manifest names runs that are gone")
    return spark.read.schema(_DDL).parquet(*folders) if folders else None


def read_or_none(spark: SparkSession, path: str, root: str | None = None) -> DataFrame | None:
    """As :func:`read`, a manifest that can't be parsed being none."""
    try:
        return read(spark, path, root)
    except Unreadable:
        return None


def write_run(health: DataFrame, path: str, root: str, clean: bool = False) -> None:
    """Replaces one root's section in one rename; ``clean`` drops the others. ``ordinal`` is the path, so that samples follow its order."""
    try:
        before = _index(path)
    except Unreadable:
        before = {}
    run = f"run-{uuid.uuid4().hex}"
    rows = health.select("path", "language", "failed", "error_nodes", "error_extent", "source_extent", "signatures", F.col("path").alias("ordinal"), F.current_timestamp().alias("indexed_at"), F.lit(root).alias("root"))
    rows.write.parquet(f"{path}/{run}")
    after = ({} if clean else before) | {root: run}
    part = f"{path}/INDEX.part"
    with open(part, "w") as f:
        json.dump(after, f)
    os.replace(part, f"{path}/INDEX")
    for gone in set(before.values()) - set(after.values()):
        shutil.rmtree(f"{path}/{gone}", ignore_errors=True)
