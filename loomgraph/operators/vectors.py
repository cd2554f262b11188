"""Graphs as rows of packed neighbours, with one value per vertex in a table that each worker reads.

Vertices are numbered without gaps. A round over the graph is one job over the packed rows and shuffles nothing: a row holds all
links of its vertex, the values at the links' other ends come from the table of the round before. A worker holds a few numbers
per vertex (8 bytes each), never the links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop

_LOW = (1 << 33) - 1
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """``(id, i)`` of the distinct ids, ``i`` from 0 without gaps, and how many they are."""
    kept = cut(ids.select("id").distinct().withColumn("m", F.monotonically_increasing_id()), "numbers")
    counts = {r["p"]: r["n"] for r in kept.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    first, n = [], 0
    for p in range(max(counts, default=-1) + 1):
        first.append(n)
        n += counts.get(p, 0)
    at = F.element_at(F.array(*[F.lit(x).cast("long") for x in first or [0]]), (F.shiftright("m", 33) + 1).cast("int"))
    return kept.select("id", (at + F.col("m").bitwiseAND(F.lit(_LOW))).alias("i")), n


def parts_of(df: DataFrame, rows: int) -> int:
    """Partitions for so many links: several a core, fewer where there is little to do."""
    spark = df.sparkSession
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(most, rows // 50_000))


def load(path: str, n: int, **columns) -> list[np.ndarray]:
    """The columns of a table ``(i, ...)`` as arrays over all vertices, each with its value where a vertex has no row."""
    import pyarrow.dataset as ds

    found = ds.dataset(path.removeprefix("file://"), format="parquet") if path.startswith(("file:", "/")) else ds.dataset(path, format="parquet")
    out = [np.full(n, v) for v in columns.values()]
    for b in found.to_batches(columns=["i", *columns]):
        i = b.column(0).to_numpy()
        for k, a in enumerate(out):
            a[i] = b.column(k + 1).to_numpy(zero_copy_only=False)
    return out


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    return values, np.repeat(np.arange(len(sizes)), sizes)


def hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a whole number behind other columns, whose hashes are ``seed``."""
    rotl = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = seed.astype(np.int64).view(np.uint64) + _P5 + np.uint64(4)
        h = rotl(h ^ (np.uint64(value) * _P1), 23) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def pagerank_rounds(links: DataFrame, n: int, damping: float, iterations: int) -> DataFrame:
    """``(i, rank)`` after so many rounds over ``links(i, sources)``, a row for each vertex, its sources distinct."""
    degrees = cut(links.select(F.explode("sources").alias("i")).groupBy("i").agg(F.count("*").cast("double").alias("degree")), "degrees")
    rank = cut(links.select("i", F.lit(1.0 / n).alias("rank")), "rank")

    def step(degree_path: str, rank_path: str):
        def run(batches):
            import pyarrow as pa

            (degree,), (sent,) = load(degree_path, n, degree=0.0), load(rank_path, n, rank=0.0)
            lost = sent[degree == 0].sum()
            np.divide(sent, degree, out=sent, where=degree > 0)
            for b in batches:
                values, row = packed(b.column("sources"))
                got = np.bincount(row, weights=sent[values], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array((1 - damping) / n + damping * (got + lost / n))], names=["i", "rank"])

        return run

    for _ in range(iterations):
        before = rank
        rank = cut(links.mapInArrow(step(degrees._cut_path, rank._cut_path), "i long, rank double"), "rank")
        drop(before)
    drop(degrees)
    return rank


def louvain_turn(links: DataFrame, n: int, total: float, hashes: str, degrees: str, state: str, turn: int) -> DataFrame:
    """``(i, c, moved)``: each vertex of ``links(i, ends, weights)`` judges the communities around it; half of those that gain move."""

    def run(batches):
        import pyarrow as pa

        (h,), (k,), (c,) = load(hashes, n, h=0), load(degrees, n, k=0.0), load(state, n, c=0)
        tot = np.bincount(c, weights=k, minlength=n)
        for b in batches:
            i, m = b.column("i").to_numpy(), b.num_rows
            ends, row = packed(b.column("ends"))
            weight = b.column("weights").flatten().to_numpy(zero_copy_only=False)
            other = ends != i[row]
            key = np.concatenate([row[other] * n + c[ends[other]], np.arange(m) * n + c[i]])  # staying is a choice as well
            shared = np.concatenate([weight[other], np.zeros(m)])
            key, inverse = np.unique(key, return_inverse=True)
            shared = np.bincount(inverse, weights=shared, minlength=len(key))
            row, to = np.divmod(key, n)
            own, mine = k[i][row], to == c[i][row]
            gain = np.round(shared - own * (tot[to] - np.where(mine, own, 0.0)) / total, 9)
            order = np.lexsort((h[to], mine, gain, row))
            last = np.append(row[order][1:] != row[order][:-1], True)
            best = order[last]
            now = gain[mine]  # a row has one such choice; choices are in the order of rows
            moved = (gain[best] > now + 1e-9) & (hash_int(turn, h[i]) % 2 == 0)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(np.where(moved, to[best], c[i])), pa.array(moved)], names=["i", "c", "moved"])

    return links.mapInArrow(run, "i long, c long, moved boolean")


def contracted(links: DataFrame, n: int, state: str) -> DataFrame:
    """``(a, b, w)`` between the communities of a state, a community with itself as well."""

    def run(batches):
        import pyarrow as pa

        (c,) = load(state, n, c=0)
        for b in batches:
            ends, row = packed(b.column("ends"))
            key, inverse = np.unique(c[b.column("i").to_numpy()][row] * n + c[ends], return_inverse=True)
            w = np.bincount(inverse, weights=b.column("weights").flatten().to_numpy(zero_copy_only=False), minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key // n), pa.array(key % n), pa.array(w)], names=["a", "b", "w"])

    return links.mapInArrow(run, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
