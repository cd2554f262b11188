"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task cuts its rows into shards of about ``SHARD_CHARS`` characters and builds a suffix array of
each over words (lower case, without punctuation). Only suffixes that share their first ``SEED`` words
with some test suffix enter, as no other can hold a match; the rest of the text is never sorted.
The test suffixes' ranks by their first 1, 2, 4, 8 words are made once for the whole test set, by prefix doubling. Those of a
shard's suffixes are looked up among them; sorted by the ranks of their first words they are the array, in which a binary search
finds every test suffix's place and the suffixes around it are its occurrences. The ranks, a few words at a time, give
the length of each common prefix.

A match is reported when it is left-maximal and at least ``LEAST_WORDS`` long, or a whole test item of
fewer words (at least ``SEED``), or when a text of less than ``SEED`` words is, word for word, a test item. Each document and item has
its longest match, the first of equally long ones; documents with any are affected.

The test set is broadcast while it has at most ``TEST_CHARS`` characters; a larger one is searched in
slices below that size, one pass over the training texts each.

Defined results: null or empty texts on either side match nothing, nor do texts without words; texts of any length are searched
whole; equal items are reported each, repeated rows too; empty tables give an empty result, an empty test set affects no
document; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import mix64, release, strings_by_size
from .words import Words, grams, split_words

LEAST_WORDS = 13
SEED = 5
SHARD_CHARS = 4_000_000
TEST_CHARS = 8_000_000
LEVELS = 4


@dataclass
class TestSet:
    """The test items as words; ``items`` are their ids as given.

    ``ids`` are the words' places in ``vocabulary``, from 1 on, each item closed by 0; ``codes`` has for each level the sorted pairs of
    ranks of the level before, ``ranks`` each place's own, 0 where the item ends before.
    """

    items: list
    sizes: np.ndarray
    seeds: np.ndarray
    hit: np.ndarray
    vocabulary: np.ndarray
    item_of: np.ndarray
    item_at: np.ndarray
    ranks: list[np.ndarray]
    codes: list[np.ndarray] = field(default_factory=list)
    short: dict[tuple, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list, texts: list[str | None]) -> TestSet:
        w = split_words(texts)
        h, whole = grams(w, SEED)
        seeds = np.unique(h[whole])
        hit = np.zeros(1 << 20, bool)
        hit[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        sizes = np.diff(w.offsets)
        vocabulary, ids = np.unique(w.hashes, return_inverse=True)
        ids = np.insert(ids.astype(np.int64) + 1, w.offsets[1:], 0)
        item_of = np.repeat(np.arange(sizes.size), sizes + 1)
        item_at = np.arange(ids.size) - np.repeat(w.offsets[:-1] + np.arange(sizes.size), sizes + 1)
        made = cls(items, sizes, seeds, hit, vocabulary, item_of, item_at, [ids.astype(np.int32)])
        for k in range(LEVELS - 1):
            pairs = _pairs(made.ranks[-1], 1 << k)
            made.codes.append(np.unique(pairs[pairs > 0]))
            made.ranks.append(_look_up(made.codes[-1], pairs))
        for i in np.flatnonzero((sizes > 0) & (sizes < SEED)).tolist():
            made.short.setdefault(tuple(w.hashes[w.offsets[i] : w.offsets[i + 1]].tolist()), []).append(i)
        return made


def _pairs(ranks: np.ndarray, step: int) -> np.ndarray:
    """The rank at each place with that ``step`` places on; 0 where either is none."""
    ahead = np.zeros_like(ranks)
    ahead[:-step] = ranks[step:]
    return np.where((ranks > 0) & (ahead > 0), (ranks.astype(np.int64) << 32) | ahead, 0)


def _look_up(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places from 1 on among sorted codes, 0 for what isn't there."""
    if not codes.size:
        return np.zeros(wanted.size, np.int32)
    at = np.minimum(np.searchsorted(codes, wanted), codes.size - 1)
    return np.where(codes[at] == wanted, at + 1, 0).astype(np.int32)


def _common(train: list[np.ndarray], test: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words from ``p`` in a shard and from ``q`` in the test set are equal; both end with 0."""
    total = np.zeros(p.size, np.int64)
    for k in range(len(train) - 1, -1, -1):
        while True:  # again at the highest level, when the suffixes are longer than that
            a = train[k][np.minimum(p + total, train[k].size - 1)]
            same = (a > 0) & (a == test[k][np.minimum(q + total, test[k].size - 1)])
            total[same] += 1 << k
            if k < len(train) - 1 or not same.any():
                break
    return total


def matches(texts: list[str | None], test: TestSet, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int, int]]:
    """``(text index, item index, words, place in text, place in item)``: the longest match of each text and item."""
    w = split_words(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if test.short:
        counts = np.diff(w.offsets)
        for t in np.flatnonzero((counts > 0) & (counts < SEED)).tolist():
            for item in test.short.get(tuple(w.hashes[w.offsets[t] : w.offsets[t + 1]].tolist()), ()):
                best[t, item] = (-int(counts[t]), 0, 0)
    if test.seeds.size and w.hashes.size:
        _long_matches(w, test, least, best)
    return [(t, i, -s, start, begin) for (t, i), (s, start, begin) in sorted(best.items())]


def _long_matches(w: Words, test: TestSet, least: int, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    h, whole = grams(w, SEED)
    place = np.flatnonzero(whole & test.hit[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(test.seeds, h[place]), test.seeds.size - 1)
    place = place[test.seeds[at] == h[place]]
    if not place.size:
        return
    # The words of all seeds, runs of them closed by 0.
    cover = np.zeros(w.hashes.size + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + SEED, -1)
    kept = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    text_of = np.searchsorted(w.offsets, kept, "right") - 1
    new = np.flatnonzero((np.diff(kept) != 1) | (np.diff(text_of) != 0)) + 1
    ids = np.append(np.insert(_look_up(test.vocabulary, w.hashes[kept]), new, 0), 0)
    origin = np.append(np.insert(kept, new, -1), -1)
    ranks = [ids]
    for k, codes in enumerate(test.codes):
        ranks.append(_look_up(codes, _pairs(ranks[-1], 1 << k)))
    needed = np.where(test.sizes >= least, least, np.where(test.sizes >= SEED, test.sizes, 0))
    for m in sorted(set(needed.tolist()) - {0}):
        q = np.flatnonzero((needed[test.item_of] == m) & (test.item_at + m <= test.sizes[test.item_of]))
        keys, wanted = _prefixes(ranks, m), _prefixes(test.ranks, m)[q]
        array = np.flatnonzero(keys)
        array = array[np.argsort(keys[array], kind="stable")]
        keys = keys[array]
        lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        n = hi - lo
        q = np.repeat(q, n)
        p = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        before = ids[np.maximum(p - 1, 0)]
        maximal = (p == 0) | (before == 0) | (test.item_at[q] == 0) | (before != test.ranks[0][q - 1])
        p, q = p[maximal], q[maximal]
        length = _common(ranks, test.ranks, p, q)
        for start, item, begin, size in zip(origin[p].tolist(), test.item_of[q].tolist(), test.item_at[q].tolist(), length.tolist(), strict=True):
            if size < m:
                continue
            text = int(np.searchsorted(w.offsets, start, "right")) - 1
            found = (-size, start - int(w.offsets[text]), begin)
            if found < best.get((text, item), (0, 0, 0)):
                best[text, item] = found


def _prefixes(ranks: list[np.ndarray], m: int) -> np.ndarray:
    """A key of the ``m`` words from each place on, 0 where the text or the test set ends before: two overlapping powers of 2, or more for a long prefix."""
    level = min(m.bit_length() - 1, len(ranks) - 1)
    size, key, at = 1 << level, ranks[level].astype(np.int64), 0
    while at + size < m:
        at = min(at + size, m - size)
        ahead = np.zeros_like(key)
        ahead[: key.size - at] = ranks[level][at:]
        both = (key > 0) & (ahead > 0)
        # A pair of ranks fits in 64 bits; a third part would need new ranks.
        key = np.where(both, (key << 32) | ahead, 0) if at + size >= m and key.max(initial=0) < 1 << 31 else np.where(both, mix64((key.astype(np.uint64) << np.uint64(32)) ^ mix64(ahead.astype(np.uint64))).astype(np.int64) & ((1 << 62) - 1), 0)
    return key


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[TestSet]:
    """The test set in parts of at most about ``TEST_CHARS`` characters."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = 1 + int(chars) // TEST_CHARS
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        found = part.orderBy("item_id", "text").collect()
        yield TestSet.of([r["item_id"] for r in found], [r["text"] for r in found])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, words, doc_word, item_word, item_share)``: the longest match of each affected document and item; places count words from 0."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for test in _slices(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(test)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            sizes = t.sizes
            for b in batches:
                texts = b.column("text").to_pylist()
                for run in strings_by_size((x or "" for x in texts), SHARD_CHARS):
                    got = matches([texts[i] for i in run], t, least)
                    if got:
                        at, item, words, start, begin = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                b.column("doc_id").take(pa.array([run[i] for i in at])),
                                pa.array([t.items[i] for i in item]),
                                *(pa.array(x, pa.int32()) for x in (words, start, begin)),
                                pa.array([round(n / int(sizes[i]), 4) for n, i in zip(words, item, strict=True)]),
                            ],
                            ["doc_id", "item_id", "words", "doc_word", "item_word", "item_share"],
                        )

        part = rows.mapInArrow(scan, f"doc_id {kind}, item_id {item_kind}, words int, doc_word int, item_word int, item_share double")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The rows without a match, with all their columns. No shuffle."""
    spark = docs.sparkSession
    for test in _slices(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(test)
        docs = docs.where(~_affected(shared, least)(F.col(text_col)))
    return docs


def _affected(shared, least: int):
    @F.pandas_udf(BooleanType())
    def affected(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        out = np.zeros(len(texts), bool)
        for run in strings_by_size((t or "" for t in texts), SHARD_CHARS):
            for i, *_ in matches([texts[i] for i in run], shared.value, least):
                out[run[i]] = True
        release()
        return pd.Series(out)

    return affected
