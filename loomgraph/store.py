"""The graph store: immutable Parquet tables behind one pointer file.

The pointer names each table's folder. A writer writes the tables that change, and only those, beside the old ones and then
replaces the pointer in one rename, so readers keep the tables that they opened, and a writer that fails leaves nothing
behind but files no one points to. A commit deletes nothing; :meth:`GraphStore.clean_up` removes, after a time of grace, what neither the pointer
nor a backup names. Backups are copies of the pointer, made before each migration and never overwritten.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import merge
from .sources import branches


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, read_only: bool, version: int, tables: dict[str, str]):
        self.spark, self.path, self.read_only, self.version, self.tables = spark, path, read_only, version, tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> GraphStore:
        """Creates and migrates a graph; a read-only one must exist and is never changed."""
        at = _pointer(path)
        if at is None:
            if read_only:
                raise FileNotFoundError(f"no graph at {path}; index a folder first")
            os.makedirs(path, exist_ok=True)
            store = cls(spark, path, False, 0, {})
            store.clear()
            return store
        store = cls(spark, path, read_only, at["version"], at["tables"])
        if not read_only:
            store.migrate()
        return store

    def table(self, name: str) -> DataFrame:
        if name not in schema.NODES and name not in schema.RELATIONS:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.path}/{self.tables[name]}")

    def nodes(self) -> DataFrame:
        """``(label, id, display)`` over all labels."""
        return reduce(DataFrame.unionByName, [self.table(t).select(F.lit(t).alias("label"), "id", F.col(schema.DISPLAY[t]).alias("display")) for t in schema.NODES])

    def edges(self) -> DataFrame:
        """``(rel, src_label, src, dst_label, dst)`` over all relations."""
        return reduce(DataFrame.unionByName, [self.table(t).select(F.lit(t).alias("rel"), F.lit(a).alias("src_label"), "src", F.lit(b).alias("dst_label"), "dst") for t, (a, b, _) in schema.RELATIONS.items()])

    def register_views(self) -> None:
        for t in (*schema.NODES, *schema.RELATIONS):
            self.table(t).createOrReplaceTempView(t)
        self.nodes().createOrReplaceTempView("nodes")
        self.edges().createOrReplaceTempView("edges")

    def query(self, sql: str, **params) -> DataFrame:
        """Any SQL over the tables and the views ``nodes`` and ``edges``, with named parameters."""
        self.register_views()
        return self.spark.sql(sql, args=params or None)

    def migrate(self) -> bool:
        """Adds declared columns that a stored table lacks, after a backup."""
        changed = {t: merge.with_declared_columns(self.table(t), schema.struct(t)) for t in (*schema.NODES, *schema.RELATIONS) if set(schema.struct(t).names) - set(self.table(t).columns)}
        if changed:
            self.backup()
            self._commit(changed)
        return bool(changed)

    def backup(self) -> str:
        """Keeps the present version under a name of its own."""
        name = f"BACKUP-{self.version}-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:6]}"
        with open(f"{self.path}/{name}", "x") as f:
            json.dump({"version": self.version, "tables": self.tables}, f)
        return name

    def restore(self, name: str) -> None:
        """Makes a backup's tables the present ones, as a new version."""
        if not re.fullmatch(r"BACKUP-[\w-]+", name):
            raise ValueError(f"no backup {name}")
        with open(f"{self.path}/{name}") as f:
            tables = json.load(f)["tables"]
        self._point({**tables})

    def clean_up(self, grace_seconds: float = 7 * 24 * 3600) -> list[str]:
        """Deletes tables that neither the pointer nor a backup names and that are older than the grace, as a reader may still hold younger ones."""
        if self.read_only:
            raise PermissionError("the graph is open for reading only")
        named = set(_pointer(self.path)["tables"].values())
        for x in os.listdir(self.path):
            if x.startswith("BACKUP-"):
                with open(f"{self.path}/{x}") as f:
                    named |= set(json.load(f)["tables"].values())
        gone = []
        for folder in (d for d in os.listdir(self.path) if re.fullmatch(r"v\d+-\w+", d)):
            for t in os.listdir(f"{self.path}/{folder}"):
                at = f"{self.path}/{folder}/{t}"
                if f"{folder}/{t}" not in named and time.time() - os.stat(at).st_mtime >= grace_seconds:
                    shutil.rmtree(at, ignore_errors=True)
                    gone.append(f"{folder}/{t}")
            if not os.listdir(f"{self.path}/{folder}"):
                os.rmdir(f"{self.path}/{folder}")
        return sorted(gone)

    def write(self, batches: dict[str, DataFrame]) -> None:
        """Upserts nodes first, then edges; batches without ``ordinal`` or ``present`` set all their columns."""
        done: dict[str, DataFrame] = {}
        for t, batch in sorted(batches.items(), key=lambda kv: kv[0] in schema.RELATIONS):
            names = schema.struct(t).names
            keys = ("id",) if t in schema.NODES else ("src", "dst")
            if "ordinal" not in batch.columns:
                batch = batch.withColumn("ordinal", F.lit(0))
            if "present" not in batch.columns:
                batch = batch.withColumn("present", F.array(*[F.lit(c) for c in names if c in batch.columns and c not in keys]).cast("array<string>"))
            if t in schema.NODES:
                done[t] = merge.upsert_nodes(self.table(t), batch)
            else:
                a, b, _ = schema.RELATIONS[t]
                done[t] = merge.upsert_edges(self.table(t), batch, done.get(a, self.table(a)), done.get(b, self.table(b)))
        self._commit(done)

    def replace(self, tables: dict[str, DataFrame]) -> None:
        self._commit(tables)

    def clear(self) -> None:
        self._commit({t: schema.empty(self.spark, t) for t in (*schema.NODES, *schema.RELATIONS)})

    def _commit(self, changed: dict[str, DataFrame]) -> None:
        if self.read_only:
            raise PermissionError("the graph is open for reading only")
        now = _pointer(self.path) or {"version": 0, "tables": {}}
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        for t, df in changed.items():
            df.write.parquet(f"{self.path}/{folder}/{t}")
        self._point({**now["tables"], **{t: f"{folder}/{t}" for t in changed}})

    def _point(self, tables: dict[str, str]) -> None:
        if self.read_only:
            raise PermissionError("the graph is open for reading only")
        new = ((_pointer(self.path) or {}).get("version") or 0) + 1
        part = f"{self.path}/CURRENT.{uuid.uuid4().hex[:8]}.part"
        with open(part, "w") as f:
            json.dump({"version": new, "tables": tables}, f)
        os.replace(part, f"{self.path}/CURRENT")
        self.version, self.tables = new, tables


def _pointer(path: str) -> dict | None:
    try:
        with open(f"{path}/CURRENT") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def graph_path(root: str, explicit: str | None = None, graph: str | None = None, isolation: str = "single", environment: dict | None = None, **ids: str) -> str:
    """Where a graph lies: an explicit path, the environment's ``LOOMGRAPH_DB``, a named graph, or the isolation model's place."""
    env = os.environ if environment is None else environment
    base = f"{root}/.loomgraph"
    if explicit:
        return explicit
    if env.get("LOOMGRAPH_DB"):
        return env["LOOMGRAPH_DB"]
    if isolation == "shared":
        if not ids.get("shared"):
            raise ValueError("this isolation needs the path of the shared graph")
        return ids["shared"]
    if graph is not None:
        return f"{base}/{re.sub(r'[^A-Za-z0-9._-]', '-', graph)[:80] or 'graph'}.graph"
    if isolation == "single":
        return f"{base}/default.graph"
    if isolation == "project":
        if not ids.get("org") or not ids.get("project"):
            raise ValueError("this isolation needs the ids of an organisation and a project")
        return f"{base}/{ids['org']}/{ids['project']}.graph"
    if isolation == "branch":
        branch = branches.current_branch(root)
        return f"{base}/branch-{branches.sanitize(branch)}.graph" if branch else f"{base}/default.graph"
    raise ValueError(f"unknown isolation {isolation!r}; one of single, project, branch, shared")


def collect_garbage(root: str, dry_run: bool = False) -> list[str]:
    """Removes the graphs of branches that are gone; returns their names."""
    base = f"{root}/.loomgraph"
    live = {f"branch-{branches.sanitize(b)}.graph" for b in branches.list_branches(root)}
    found = sorted(d for d in (os.listdir(base) if os.path.isdir(base) else []) if d.startswith("branch-") and d.endswith(".graph") and d not in live)
    if not dry_run:
        for d in found:
            shutil.rmtree(f"{base}/{d}")
    return found
