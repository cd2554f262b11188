"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomgraph-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, which outlives any executor."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._loom_path = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_loom_path", None)
    if path:
        spark = df.sparkSession
        _delete(spark, path)
        _scratch[:] = [x for x in _scratch if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session may already be gone
            return


def batches_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts as Python strings; null becomes the empty text."""
    for b in batches:
        if b.num_rows:
            yield b, [t or "" for t in b.column(text).to_pylist()]


def strings_by_size(texts: Iterable[str], limit: int) -> Iterator[list[int]]:
    """Index runs whose texts have about ``limit`` characters in total, at least one text each."""
    run: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield run


def release() -> None:
    """Gives a worker's freed memory back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x
