"""Source trees and markdown as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".cs", ".py", ".go", ".java", ".kt", ".kts", ".rs", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".h", ".rb", ".php", ".dart")
SKIPPED = frozenset("node_modules dist build target vendor bin obj coverage __pycache__ venv .venv .git .loomgraph".split())
READ_AT_ONCE = 16_000_000
FILES_PER_TASK = 256


def _system(root: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pa.fs.FileSystem.from_uri(root.rstrip("/"))
    return pa.fs.LocalFileSystem(), os.path.abspath(root)


def walk(root: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[list[str], list[str]]:
    """Paths of the files below ``root`` with these (case-sensitive) suffixes, and of linked folders, which aren't followed; both relative and in order.

    Names that begin with a dot or an underscore are names like others. Type declarations (``.d.ts``) are left out, and folders
    that hold no sources of one's own.
    """
    system, base = _system(root)
    local = isinstance(system, pa.fs.LocalFileSystem)
    found, links, todo = [], [], [base]
    while todo:
        for info in system.get_file_info(pa.fs.FileSelector(todo.pop())):
            below = info.path[len(base) :].lstrip("/")
            if info.type == pa.fs.FileType.Directory:
                if local and os.path.islink(info.path):
                    links.append(below)
                elif info.base_name not in SKIPPED:
                    todo.append(info.path)
            elif info.type == pa.fs.FileType.File and info.base_name.endswith(tuple(extensions)) and not info.base_name.endswith(".d.ts"):
                found.append(below)
    return sorted(found), sorted(links)


def _read(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """``(path, source, reason)``: the driver lists names only, tasks read; ``reason`` says why a file has no source."""
    paths, _ = walk(root, extensions)
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // FILES_PER_TASK)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "source", "reason"])

        rows, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        rows.append((path, f.read().decode("utf-8", "replace"), None))
                    size += len(rows[-1][1])
                except OSError as e:
                    rows.append((path, None, str(e)))
                if size > READ_AT_ONCE:
                    yield told(rows)
                    rows, size = [], 0
        if rows:
            yield told(rows)

    return names.mapInArrow(read, "path string, source string, reason string")


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``(path, source, language)`` of files below ``root``, paths relative to it; those that can't be read are left out and told by :func:`unreached`."""
    return _read(spark, root, extensions).where("reason is null").select("path", "source", T.language_of(F.col("path")).alias("language"))


def unreached(root: str) -> dict[str, list[str]]:
    """What a walk leaves out and should be told about: linked folders that aren't followed, files that can't be read."""
    files, links = walk(root)
    system, base = _system(root)
    unreadable = [p for p in files if not os.access(f"{base}/{p}", os.R_OK)] if isinstance(system, pa.fs.LocalFileSystem) else []
    return {"linked_folders": links, "unreadable": unreadable}


def in_memory(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(files, "path string, source string").withColumn("language", T.language_of(F.col("path")))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(content, fallback_id, ordinal)`` of the markdown files below ``root``; ``ordinal`` is the path, so that order is by path."""
    found = read_tree(spark, root, (".md",))
    return found.select(F.col("source").alias("content"), F.col("path").alias("fallback_id"), F.col("path").alias("ordinal"))
