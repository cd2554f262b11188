"""Cutting lineage with Parquet tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomgraph-core-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, however few files they come from: for steps that take much longer than moving the rows."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of the largest table read that fall to one partition of :func:`gathered`, counted as its bytes by its columns' default widths; packed columns hold several times as many.
_PART_ROWS = 1 << 16
_UNKNOWN = 1 << 60


def parts(df: DataFrame) -> int:
    """Partitions in which no task's share of ``df`` grows with its tables; 0 where all cores together hold them easily, or where nothing is known of their size."""
    leaves, rows = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0.0
    for i in range(leaves.size()):
        size, out = int(str(leaves.apply(i).stats().sizeInBytes())), leaves.apply(i).output()
        if size < _UNKNOWN:
            rows = max(rows, size / (8 + sum(out.apply(k).dataType().defaultSize() for k in range(out.size()))))
    n, spark = math.ceil(rows / _PART_ROWS), df.sparkSession
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else 0


def gathered(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """The same rows, for a step over equal keys: where the tables are large, shuffled by them into ``n``, else :func:`parts`, partitions; else as they are."""
    n = parts(df) if n is None else n
    return df.repartition(n, *keys) if n else df


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, read from a table written just now; survives the loss of any executor. Deleted by :func:`drop` or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def drop(df: DataFrame | None) -> None:
    """Deletes a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # that session may already be gone, another's may not
            continue
