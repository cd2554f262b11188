"""Steps over equal keys take more partitions, not larger ones, as their tables grow."""

import random

import pytest

from loomgraph import lineage
from loomgraph.operators import merge
from loomgraph.plans import driver, table_queries

EDGE = "src string, dst string, call_count long, confidence double, provider string"


def _tables(spark, at, orders):
    lines = [(o, n, (o * 7 + n * n * 3) % 50 + 1) for o in range(orders) for n in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    parts = [(k, f"n{k}", f"b{k % 3}") for k in range(1, 51)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{at}/part.parquet")
    return str(at)


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "_PART_ROWS", 50)
    sizes = [_tables(spark, tmp_path / str(n), n) for n in (200, 20_000)]
    few, many = [lineage.parts(spark.read.parquet(f"{at}/lineitem.parquet")) for at in sizes]
    assert many > few and many > 10
    for found in (driver.steps, driver.calls, table_queries.w03_merge_edges):
        assert found(spark, sizes[1]).rdd.getNumPartitions() == many


def test_small_or_unknown_tables_are_left_as_they_are(spark, tmp_path):
    at = _tables(spark, tmp_path, 100)
    assert lineage.parts(spark.read.parquet(f"{at}/lineitem.parquet")) == 0
    assert lineage.parts(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a long")) == 0


@pytest.mark.parametrize("rows", [1, 1 << 16])
def test_edges_fold_in_order_in_any_number_of_partitions(spark, tmp_path, monkeypatch, rows):
    rng = random.Random(3)
    ends = [str(k) for k in range(12)]
    stored = {(a, b): (k, 0.5, rng.choice(["scip", "tree-sitter"])) for k, (a, b) in enumerate((a, b) for a in ends for b in ends if rng.random() < 0.5)}
    batch = [(rng.choice(ends), rng.choice([*ends, "none"]), k, rng.choice([0.3, 0.5, 0.9]), rng.choice(["scip", "tree-sitter"]), k) for k in range(400)]
    want = dict(stored)
    for src, dst, count, confidence, provider, _ in batch:
        old = want.get((src, dst))
        if dst != "none" and (old is None or old[2] == provider or confidence > old[1]):
            want[src, dst] = (count, confidence, provider)
    rng.shuffle(batch)
    twice = [("x", "y", 1, 0.1, "scip"), ("x", "y", 2, 0.1, "scip"), (None, "y", 3, 0.1, "scip")]
    spark.createDataFrame([*[(*k, *v) for k, v in stored.items()], *twice], EDGE).write.parquet(f"{tmp_path}/stored")
    spark.createDataFrame([(*x, ["call_count", "confidence", "provider"]) for x in batch], f"{EDGE}, ordinal long, present array<string>").write.parquet(f"{tmp_path}/batch")
    spark.createDataFrame([(e,) for e in ends], "id string").write.parquet(f"{tmp_path}/ends")
    monkeypatch.setattr(lineage, "_PART_ROWS", rows)
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    assert (lineage.parts(read("stored")) > 0) == (rows == 1)
    got = [tuple(r) for r in merge.upsert_edges(read("stored"), read("batch"), read("ends"), read("ends")).collect()]
    assert sorted(got, key=repr) == sorted([*[(*k, *v) for k, v in want.items()], *twice], key=repr)
