"""Idempotent upsert of nodes and edges under provenance and origin precedence.

A batch is folded row by row in its order onto the stored row of the same key, as the policy isn't
commutative; the fold is one SQL aggregate over an array that a sorted window collects, so there is
one shuffle on the key, whose partitions grow in number with the tables, not in size.
Only columns named in ``present`` are set: a column that is absent differs from one that is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import gathered, parts
from ..schema import ORIGIN_RANK


def origin_rank(origin: Column) -> Column:
    return reduce(lambda c, kv: c.when(origin == kv[0], kv[1]), ORIGIN_RANK.items(), F.when(origin.isNull(), 0)).otherwise(0)


def should_overwrite(old: Column, new: Column, exists: Column) -> Column:
    """Of rows with ``provider`` and ``confidence``: the same provider may; another needs a strictly higher confidence."""
    better = F.coalesce(new["confidence"] > old["confidence"], F.lit(False))
    return ~exists | (old["provider"].eqNullSafe(new["provider"]) & new["provider"].isNotNull()) | better


def _fold(stored: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], keep_confidence: bool) -> DataFrame:
    kinds = dict(stored.dtypes)
    values = [c for c in columns if c not in keys]
    n = max(parts(stored), parts(batch))
    new = F.struct(*[F.col(c) if c in batch.columns else F.lit(None).cast(kinds[c]).alias(c) for c in values], F.lit(0).alias("_"))
    order = ["ordinal", "new", "present"]
    key = Window.partitionBy(*keys).orderBy(*order)
    writes = gathered(batch.select(*keys, "ordinal", new.alias("new"), "present"), *keys, n=n)
    incoming = writes.select(*keys, F.collect_list(F.struct(*order)).over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("writes"), F.row_number().over(key).alias("_k")).where("_k = 1").drop("_k")
    old = gathered(stored, *keys, n=n).select(*keys, F.struct(*values, F.lit(True).alias("exists")).alias("old"))
    blank = F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in values], F.lit(False).alias("exists"))
    joined = old.join(incoming, keys, "full")

    def write(state: Column, w: Column) -> Column:
        new, has = w["new"], lambda c: F.array_contains(w["present"], c)
        exists = state["exists"]
        allowed = F.lit(True)
        keep = F.lit(False)
        if "origin" in values:
            allowed = allowed & (~has("origin") | ~exists | (origin_rank(new["origin"]) >= origin_rank(state["origin"])))
        if "provider" in values:
            if "confidence" in values:
                rule = should_overwrite(state, new, exists)
                if keep_confidence:
                    keep = has("provider") & exists & state["provider"].eqNullSafe(new["provider"]) & state["confidence"].isNotNull()
            else:  # without a confidence another provider never overwrites
                rule = ~exists | (state["provider"].eqNullSafe(new["provider"]) & new["provider"].isNotNull())
            allowed = allowed & (~has("provider") | rule)
        fields = []
        for c in values:
            sets = allowed & has(c)
            if c == "confidence":
                sets = sets & ~keep
            fields.append(F.when(sets, new[c]).otherwise(state[c]).alias(c))
        return F.struct(*fields, F.lit(True).alias("exists"))

    folded = joined.withColumn("row", F.aggregate(F.coalesce("writes", F.array().cast(joined.schema["writes"].dataType)), F.coalesce("old", blank), write))
    return folded.select(*keys, *[F.col(f"row.{c}").alias(c) for c in values])


def upsert_nodes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The node table after ``batch(id, ordinal, present array<string>, columns...)``; a function keeps its learnt confidence when its own provider writes again."""
    return _fold(stored, batch, ["id"], stored.columns, keep_confidence=True).select(*stored.columns)


def upsert_edges(stored: DataFrame, batch: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The edge table after ``batch(src, dst, ordinal, present, columns...)``; an edge without both ends is dropped silently."""
    n = max(parts(batch), parts(sources), parts(targets))
    known = lambda ends, c: gathered(ends.select(F.col("id").alias(c)), c, n=n)  # noqa: E731  the batch follows their partitions unless they are broadcast
    kept = batch.join(known(sources, "src"), "src", "left_semi").join(known(targets, "dst"), "dst", "left_semi")
    if len(stored.columns) == 2:
        return stored.unionByName(kept.select("src", "dst")).distinct()
    return _fold(stored, kept, ["src", "dst"], stored.columns, keep_confidence=False).select(*stored.columns)


def with_declared_columns(df: DataFrame, declared) -> DataFrame:
    """Schema migration: missing declared columns become null, ``provider`` the first extractor's name."""
    have = set(df.columns)
    out = df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in declared.fields])
    return out.withColumn("provider", F.coalesce("provider", F.lit("tree-sitter"))) if "provider" in out.columns else out


def pending_migrations(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, pending)``: rows of each provenance table that still lack their provider."""
    parts = [df.agg(F.lit(name).alias("table"), F.count_if(F.col("provider").isNull()).alias("pending")) for name, df in sorted(tables.items()) if "provider" in df.columns]
    return reduce(DataFrame.unionByName, parts)
