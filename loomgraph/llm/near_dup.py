"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles.

1. One scan counts in how many documents each shingle bucket occurs (``2**BUCKET_BITS`` buckets, a
   fixed size whatever the corpus). A shingle's weight is ``(1 + ln tf) * idf`` with
   ``idf = ln(N / df) / ln(1 / RARE)``, at most 1: what fewer than ``RARE`` of all documents have
   weighs fully, boilerplate fades. Both are shares of the corpus, so they mean the same at any size.
2. A second scan draws ``BANDS * ROWS`` consistent weighted samples per document (the pair of element
   and quantised weight that minimises Ioffe's ``a``); bands of them are bucket keys. Equal texts are
   one node, a 64-bit hash; texts that share one by chance are told apart by 64 further bits and get nodes of their own.
3. In each bucket every node is paired with the bucket's leader, and each pair verified by the exact
   weighted Jaccard similarity of the two documents. Nodes that their leader turns out unlike are then
   paired with everyone in that bucket, so no candidate is skipped; a copy group of any size costs
   a number of pairs linear in its size.
4. Groups are the connected components of the verified pairs; the smallest id stays.

Chance that a pair shares a band: 0.906 at similarity 0.65, 0.963 at 0.7, 0.998 at 0.8.

Defined results: a null text belongs to no group and stays; equal texts, also empty ones, are one group;
a text of fewer words than a shingle is one shingle of its own words; repeated rows are copies of each other; of rows with
the smallest id one stays; rows with a null id are in a group only as copies that go; an empty
table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, mix64, release, strings_by_size
from .words import grams, split_words

SHINGLE = 2
THRESHOLD = 0.65
BANDS, ROWS = 12, 4
BUCKET_BITS = 18
RARE = 0.01
TABLE_BITS = 15
CHARS_AT_ONCE = 2_000_000
ELEMENTS_AT_ONCE = 16_384
SALTS = 16
SEEN_AT_ONCE = 1_000_000
_SLICE = 4096


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, 44-bit shingle and count, ordered by text and shingle."""
    w = split_words(texts)
    h, whole = grams(w, SHINGLE)
    sizes = np.diff(w.offsets)
    few = (sizes > 0) & (sizes < SHINGLE)
    if few.any():  # such a text is one word, whatever follows it in the run
        whole[w.offsets[:-1][few]] = True
        h[w.offsets[:-1][few]] = mix64(w.hashes[w.offsets[:-1][few]])
    code = (w.of_text[whole].astype(np.uint64) << np.uint64(44)) | (h[whole] >> np.uint64(20))
    unique, counts = np.unique(code, return_counts=True)
    return (unique >> np.uint64(44)).astype(np.int64), unique & np.uint64((1 << 44) - 1), counts


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Idf by bucket, over all rows of ``texts(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            some = b.column("text").to_pylist()
            for run in strings_by_size((t or "" for t in some), CHARS_AT_ONCE):
                at, shingles, _ = shingle_sets([some[i] for i in run])
                held += np.bincount(np.unique((at << BUCKET_BITS) | _bucket(shingles)) & ((1 << BUCKET_BITS) - 1), minlength=held.size)
                rows += len(run)
            release()
        if rows:
            parts = [held[i : i + _SLICE].tobytes() for i in range(0, held.size, _SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(parts)), -1], pa.int32()), pa.array([*parts, np.int64(rows).tobytes()], pa.binary())], ["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})

    rows = texts.mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    by = {r["part"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in rows}
    df = np.concatenate([by[i] for i in range((1 << BUCKET_BITS) // _SLICE)]) if by else np.zeros(1 << BUCKET_BITS, np.int64)
    n = int(by[-1][0]) if by else 1
    return np.clip(np.log((n + 1) / np.maximum(df, 1)) / np.log(1 / RARE), 0.05, 1.0).astype(np.float32)


def weights(shingles: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)).astype(np.float32) * idf[_bucket(shingles)]


_draws: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ioffe's r, ln c and beta, by a shingle's table row and the sample."""
    if not _draws:
        rng = np.random.Generator(np.random.PCG64(20240229))
        shape = (1 << TABLE_BITS, BANDS * ROWS)
        _draws.append((rng.gamma(2, 1, shape).astype(np.float32), np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, np.float32)))
    return _draws[0]


def samples(at: np.ndarray, shingles: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """A code per text and sample; equal codes are equal samples. Texts without shingles have zeros."""
    k = BANDS * ROWS
    out = np.zeros((n_texts, k), np.uint64)
    bounds = np.searchsorted(at, np.arange(n_texts + 1))
    row = ((shingles >> np.uint64(BUCKET_BITS)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    log_w = np.log(weight)
    r_, c_, b_ = _tables()
    columns = np.arange(k, dtype=np.uint64) << np.uint64(56)
    i = 0
    while i < n_texts:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + ELEMENTS_AT_ONCE, "right")) - 1)
        filled = np.flatnonzero(np.diff(bounds[i : j + 1])) + i
        lo, hi = bounds[i], bounds[j]
        i = j
        if not filled.size:
            continue
        best = np.full((filled.size, k), np.inf, np.float32)
        code = np.full((filled.size, k), np.iinfo(np.uint64).max, np.uint64)
        for a in range(lo, hi, 4 * ELEMENTS_AT_ONCE):  # a very long text in pieces
            z = min(hi, a + 4 * ELEMENTS_AT_ONCE)
            r, beta = r_[row[a:z]], b_[row[a:z]]
            t = np.floor(log_w[a:z, None] / r + beta)
            value = c_[row[a:z]] - r * (t - beta + 1)
            first = np.flatnonzero((bounds[filled + 1] > a) & (bounds[filled] < z))
            starts = np.maximum(bounds[filled[first]] - a, 0)
            least = np.minimum.reduceat(value, starts, axis=0)
            better, same = least < best[first], least <= best[first]
            best[first] = np.minimum(least, best[first])
            code[first] = np.where(better, np.iinfo(np.uint64).max, code[first])
            lengths = np.diff([*starts, z - a])
            rows, cols = np.nonzero((value == np.repeat(least, lengths, axis=0)) & np.repeat(same, lengths, axis=0))
            owner = np.repeat(first, lengths)[rows]
            found = mix64(shingles[a:z][rows] ^ columns[cols] ^ (t[rows, cols].astype(np.int64).astype(np.uint64) << np.uint64(44)))
            np.minimum.at(code, (owner, cols), found)
        out[filled] = code
    return out


def band_keys(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and band."""
    keys = np.zeros((codes.shape[0], BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix64(keys * np.uint64(31) + codes[:, k::ROWS][:, :BANDS])
        return mix64(keys + np.arange(BANDS, dtype=np.uint64))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of ordered shingles with weights; of two empty sets 0."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    union = float(a[1].sum()) + float(b[1].sum()) - shared
    return shared / union if union else 0.0


def _node(text_col: str, clashes: list[int]) -> Column:
    """The node of a text; nodes of ``clashes`` are split by the further bits. Null for a null text."""
    text = F.col(text_col)
    node = F.xxhash64(text)
    if clashes:
        node = F.when(node.isin(clashes), F.xxhash64(node, _further_bits(text))).otherwise(node)
    return F.when(text.isNotNull(), node)


def _further_bits(text: Column) -> Column:
    return F.xxhash64(F.lit("second"), text)


def _clashes(docs: DataFrame, text_col: str) -> list[int]:
    """Nodes that different texts share: two or three of ten billion texts by the odds, so the driver holds them."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("node"), _further_bits(F.col(text_col)).alias("more"))
    both = rows.groupBy("node").agg(F.min("more").alias("low"), F.max("more").alias("high"))
    return [r["node"] for r in both.where("low != high").select("node").collect()]


def _nodes(docs: DataFrame, text_col: str, clashes: list[int]) -> DataFrame:
    """The rows that take part with their node."""
    return docs.where(F.col(text_col).isNotNull()).select(_node(text_col, clashes).alias("node"), F.col(text_col).alias("text"))


def _bands(texts: DataFrame, idf) -> DataFrame:
    """``(keys, node)``: the bucket keys of each text, at least once."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fresh = []
            for i, node in enumerate(b.column("node").to_pylist()):  # copies that a task meets are drawn once
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            if len(seen) > SEEN_AT_ONCE:
                seen.clear()
            b = b.take(pa.array(fresh, pa.int64()))
            some = b.column("text").to_pylist()
            for run in strings_by_size(some, CHARS_AT_ONCE):
                at, shingles, counts = shingle_sets([some[i] for i in run])
                keys = band_keys(samples(at, shingles, weights(shingles, counts, idf.value), len(run))).view(np.int64)
                has = np.bincount(at, minlength=len(run)) > 0
                nodes = b.column("node").slice(run[0], len(run)).filter(pa.array(has))
                keys = keys[has]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())), nodes], ["keys", "node"])
            release()

    return texts.mapInArrow(draw, "keys array<long>, node long")


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """``(a, b, similarity)`` of each of the distinct ``pairs(a, b)``, whatever it is.

    Texts go once to each leader ``a`` they are paired with, the leader's own text first; they are
    compared as they stream past, so the size of a leader's group doesn't matter, and salts spread it.
    """
    salted = pairs.select("a", "b", (F.abs(F.hash("b")) % SALTS).alias("salt"))
    sent = salted.unionByName(salted.select("a", F.col("a").alias("b"), "salt").distinct())
    joined = sent.join(texts.select(F.col("node").alias("b"), "text"), "b")
    parts = joined.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            a, b, texts_ = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist()
            out: list[tuple[int, int, float]] = []
            for run in strings_by_size(texts_, CHARS_AT_ONCE):
                at, shingles, counts = shingle_sets([texts_[i] for i in run])
                weight = weights(shingles, counts, idf.value)
                bounds = np.searchsorted(at, np.arange(len(run) + 1))
                for k, i in enumerate(run):
                    s = slice(bounds[k], bounds[k + 1])
                    if a[i] == b[i]:
                        leader, own = a[i], (shingles[s].copy(), weight[s].copy())
                    elif a[i] == leader:
                        out.append((a[i], b[i], jaccard(own, (shingles[s], weight[s]))))
            if out:
                x, y, z = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.float64())], ["a", "b", "similarity"])
            release()

    return parts.select("a", "b", "text").mapInArrow(compare, "a long, b long, similarity double")


def components(spark, edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the smallest node of its component.

    Alternates large-star and small-star until nothing moves; each round is a written table.
    """
    now = materialize(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "star")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = F.min("b").over(Window.partitionBy("a"))
        small = large.select("a", "b", low.alias("m"))
        after = materialize(spark, small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct(), "star")
        same = _print_of(after) == _print_of(now)
        discard(now)
        now = after
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def verified_pairs(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, clashes: list[int] | None = None) -> DataFrame:
    """``(a, b, similarity)``: verified pairs of nodes that connect each group of unequal texts."""
    spark = docs.sparkSession
    texts = _nodes(docs, text_col, _clashes(docs, text_col) if clashes is None else clashes)
    idf = spark.sparkContext.broadcast(document_frequencies(docs.select(F.col(text_col).alias("text"))))
    exploded = _bands(texts, idf).dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    led = exploded.select("key", "node", F.min("node").over(Window.partitionBy("key")).alias("leader"), F.max("node").over(Window.partitionBy("key")).alias("last"))
    led = materialize(spark, led.where("leader != last").select("key", "node", "leader"), "buckets")
    # The texts of candidates, each once; sorted by the join, so the aggregate streams.
    texts = materialize(spark, texts.join(led.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "candidates")
    first = materialize(spark, _verified(led.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), texts, idf), "verified")
    unlike = led.join(first.where(F.col("similarity") < threshold).select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_semi")
    rest = unlike.select("key", F.col("node").alias("x"), "leader").join(led.select("key", F.col("node").alias("y")), "key").where("x != y and y != leader")
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    second = materialize(spark, _verified(rest, texts, idf), "verified")
    discard(texts)
    return first.unionByName(second).where(F.col("similarity") >= threshold)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, group_id, similarity)`` of each row in a group of two rows or more.

    ``group_id`` is the group's smallest id, the document that stays; ``similarity`` the highest that
    was verified for the row's text, 1 for copies.
    """
    clashes = _clashes(docs, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _node(text_col, clashes).alias("node"))
    grouped = rows.join(_groups(docs, id_col, text_col, threshold, clashes), "node")
    return grouped.where("doc_id is not null").select("doc_id", "group_id", F.round("similarity", 4).alias("similarity"))


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, clashes: list[int]) -> DataFrame:
    """``(node, low, group_id, similarity)`` of each text in a group; ``low`` is the smallest id of its rows."""
    spark = docs.sparkSession
    pairs = materialize(spark, verified_pairs(docs, text_col, threshold, clashes), "pairs")
    roots = components(spark, pairs)
    best = pairs.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.max("similarity").alias("similarity"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _node(text_col, clashes).alias("node"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    nodes = nodes.join(roots, "node", "left").join(best, "node", "left").where("rows > 1 or root is not null").select("node", "low", "rows", F.coalesce("root", "node").alias("root"), "similarity")
    kept = nodes.groupBy("root").agg(F.min("low").alias("group_id"))
    return materialize(spark, nodes.join(kept, "root").select("node", "low", "group_id", F.when(F.col("rows") > 1, 1.0).otherwise(F.col("similarity")).alias("similarity")), "groups")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, with all their columns."""
    clashes = _clashes(docs, text_col)
    groups = _groups(docs, id_col, text_col, threshold, clashes).select("node", "low", "group_id")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    packed = docs.select(whole, F.col(f"`{id_col}`").alias("doc_id"), _node(f"`{text_col}`", clashes).alias("node"))
    # The groups grow with the rows: one plan at every size, no broadcast where they happen to be few.
    joined = packed.join(groups.hint("merge"), "node", "left")
    ids = docs.where(F.col(text_col).isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), _node(text_col, clashes).alias("node"))
    repeated = ids.join(groups.where("low = group_id"), "node").where("doc_id = group_id").groupBy("group_id").count().where("count > 1").select("group_id")
    repeated = materialize(docs.sparkSession, repeated, "repeated")
    if repeated.isEmpty():
        return joined.where("group_id is null or doc_id = group_id").select("row.*")
    joined = joined.join(repeated.withColumn("twice", F.lit(True)), "group_id", "left")
    once = joined.where("group_id is null or (doc_id = group_id and twice is null)").select("row.*")
    return once.unionByName(joined.where("doc_id = group_id and twice").groupBy("group_id").agg(F.first("row").alias("row")).select("row.*"))
