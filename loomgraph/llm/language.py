"""Language ID by interpolated Kneser-Ney character models.

Text becomes lower-case letters, everything else one space. Every document with a language that isn't
held out (a tenth by the text's hash) counts towards its language's n-grams of ``ORDER`` characters;
the counts of lower orders are Kneser-Ney's, the number of different characters seen before. Counts, discounts
and totals are aggregates over all n-grams, and the model is a table in the shared folder: by language and order the
hashes of the n-grams in order, beside their discounted probabilities, and those of the contexts beside the weight of the
shorter context. The driver sees one row for each language and order. Each worker reads the table once into sorted arrays of 12 bytes
an entry; a look-up is a binary search. A text's language is the one with the lowest cross-entropy per symbol, in bits.

Rejection is calibrated on the held-out documents: by language and length, the median and the 99th
percentile of the cross-entropy give a bound ``REACH`` times their distance above the median; beyond it
the answer is ``und``. Lengths with few held-out documents take the bound of their whole language.

Defined results: null, empty and letterless texts are ``und`` with null numbers; long texts are scored
whole; equal rows get equal answers; of languages with equal cross-entropy the first by name wins;
rows with a null language train nothing; without any training text all are ``und``; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, mix64, strings_by_size

ORDER = 4
REACH = 4.0
LEAST_HELD_OUT = 50
CHARS_AT_ONCE = 2_000_000
HELD_AT_ONCE = 4_000_000
UNKNOWN = "und"
_SPACE = 0x20
_PARTS = 2 * ORDER + 2


def _letters() -> np.ndarray:
    """Each character of the basic plane as itself if it is a letter, else as a space."""
    table = np.full(1 << 16, _SPACE, np.uint16)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or 0x300 <= c < 0x370):
            table[c] = c
    return table


_LETTERS: list[np.ndarray] = []


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and n-gram of each symbol: ``ORDER`` characters of 16 bits, the last lowest."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    low = [(t or "").lower() for t in texts]
    joined = " ".join(low) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    symbols = _LETTERS[0][np.minimum(raw, 0xFFFF)]
    beyond = raw > 0xFFFF
    if beyond.any():
        symbols[beyond] = (0xE000 + raw[beyond] % 0x1900).astype(np.uint16)
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    letter = symbols != _SPACE
    first = np.zeros(symbols.size, bool)
    starts = np.cumsum(sizes) - sizes
    first[starts] = True
    before = np.empty_like(letter)
    before[:1] = False
    before[1:] = letter[:-1]
    before &= ~first
    at = np.flatnonzero(letter | before)  # of white space only the first after a letter
    owner = np.searchsorted(starts, at, "right") - 1
    s = symbols[at].astype(np.uint64)
    inside = at.size and np.arange(at.size) - np.searchsorted(owner, owner)
    code = s.copy()
    for k in range(1, ORDER):
        past = np.full(at.size, _SPACE, np.uint64)
        past[k:] = s[:-k] if k else s
        past[inside < k] = _SPACE
        code |= past << np.uint64(16 * k)
    return owner, code


def _counts(texts: DataFrame) -> DataFrame:
    """``(lang, code, n)`` over all rows of ``texts(lang, text)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pd.Series]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                total = pd.concat(parts).groupby(level=0).sum()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(total.index.to_numpy().view(np.int64)), pa.array(total.to_numpy(np.int64))], ["lang", "code", "n"])
            held.clear()

        for b in batches:
            langs, some = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                mine = [some[i] for i in np.flatnonzero(langs == lang)]
                for run in strings_by_size((t or "" for t in mine), CHARS_AT_ONCE):
                    _, code = gram_codes([mine[i] for i in run])
                    at, unique = pd.factorize(code)
                    parts = held.setdefault(lang, [])
                    parts.append(pd.Series(np.bincount(at, minlength=unique.size), index=unique))
                    if len(parts) > 16:
                        held[lang] = [pd.concat(parts).groupby(level=0).sum()]
            if sum(len(p) for parts in held.values() for p in parts) > HELD_AT_ONCE:  # what a task holds has a bound; parts add up later
                yield from flush()
        yield from flush()

    return texts.mapInArrow(scan, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _levels(counts: DataFrame) -> list[DataFrame]:
    """The n-grams of each order from 1 on; a lower order counts the different characters seen before."""
    found = [counts]
    for order in range(ORDER - 1, 0, -1):
        found.append(found[-1].groupBy("lang", F.col("code").bitwiseAND((1 << (16 * order)) - 1).alias("code")).agg(F.count("*").alias("n")))
    return found[::-1]


@dataclass
class Model:
    """A trained model: a table at ``path`` with ``(language, part, key, value)`` in order; part is twice the order, and one more for contexts."""

    path: str
    languages: list[str]
    uniform: float

    def tables(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """By language and part the sorted keys and their values; read once by each worker."""
        have = _loaded.get(self.path)
        if have is None:
            _loaded.clear()
            have = _loaded[self.path] = _read(self.path, len(self.languages))
        return have

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Base 2, of each distinct n-gram's last symbol in each language."""
        tables = self.tables()
        p = np.full((codes.size, len(self.languages)), self.uniform)
        for order in range(1, ORDER + 1):
            part = codes & np.uint64((1 << (16 * order)) - 1)
            grams, of_gram = np.unique(_key(part, order), return_inverse=True)
            heads, of_head = np.unique(_key(part >> np.uint64(16), order), return_inverse=True)
            for k, table in enumerate(tables):
                p[:, k] = _look_up(table[2 * order], grams, 0.0)[of_gram] + _look_up(table[2 * order + 1], heads, 1.0)[of_head] * p[:, k]
        return np.log2(p)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of symbols of each text, and its bits per symbol in each language."""
        owner, code = gram_codes(texts)
        at, unique = pd.factorize(code)
        logs = self.log_probabilities(np.asarray(unique, np.uint64))
        n = np.bincount(owner, minlength=len(texts))
        bits = np.stack([np.bincount(owner, -logs[at, k], minlength=len(texts)) for k in range(logs.shape[1])], 1) if logs.shape[1] else np.zeros((len(texts), 0))
        return n, bits / np.maximum(n, 1)[:, None]


_loaded: dict[str, list[list[tuple[np.ndarray, np.ndarray]]]] = {}


def _read(path: str, languages: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The shards in order, which together are one sorted table."""
    system, root = pa.fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in system.get_file_info(pa.fs.FileSelector(root)) if f.path.endswith(".parquet"))
    of, keys, values = [], [], []
    for f in files:
        shard = pq.read_table(f, filesystem=system)
        of.append((shard["language"].to_numpy() * _PARTS + shard["part"].to_numpy()).astype(np.int32))
        keys.append(shard["key"].to_numpy())
        values.append(shard["value"].to_numpy())
    of, keys, values = np.concatenate(of), np.concatenate(keys), np.concatenate(values)
    bounds = np.searchsorted(of, np.arange(languages * _PARTS + 1))
    return [[(keys[s:e], values[s:e]) for s, e in zip(bounds[k * _PARTS : (k + 1) * _PARTS], bounds[k * _PARTS + 1 : (k + 1) * _PARTS + 1], strict=True)] for k in range(languages)]


def _key(codes: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(codes + np.uint64(order) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _look_up(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    if not keys.size:
        return np.full(wanted.size, missing)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and pmod(xxhash64(text), 10) > 0")
    counts = materialize(spark, _counts(rows), "grams")
    levels = _levels(counts)
    told = None
    for order, level in enumerate(levels, 1):
        some = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).withColumn("order", F.lit(order))
        told = some if told is None else told.unionByName(some)
    found = told.collect()
    if not found:
        discard(counts)
        return None
    languages = sorted({r["lang"] for r in found})
    discount = {(r["lang"], r["order"]): r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] and r["twos"] else 0.5 for r in found}
    uniform = 1.0 / (levels[0].select("code").distinct().count() + 1)
    rules = F.broadcast(spark.createDataFrame([(lang, k, order, discount[lang, order]) for k, lang in enumerate(languages) for order in range(1, ORDER + 1)], "lang string, language int, order int, discount double"))
    entries = None
    for order, level in enumerate(levels, 1):
        level = level.join(rules.where(F.col("order") == order), "lang").withColumn("head", F.shiftrightunsigned("code", 16))
        total = F.sum("n").over(Window.partitionBy("language", "head"))
        grams = level.select("language", F.lit(2 * order).alias("part"), "code", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / total).alias("value"))
        heads = level.groupBy("language", F.col("head").alias("code")).agg((F.first("discount") * F.count("*") / F.sum("n")).alias("value"))
        both = grams.unionByName(heads.select("language", F.lit(2 * order + 1).alias("part"), "code", "value"))
        entries = both if entries is None else entries.unionByName(both)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, code = np.asarray(b.column("part")), np.asarray(b.column("code")).view(np.uint64)
            key = np.zeros(part.size, np.int64)
            for p in np.unique(part).tolist():
                key[part == p] = _key(code[part == p], p // 2)
            yield pa.RecordBatch.from_arrays([b.column("language"), b.column("part"), pa.array(key), pa.array(np.asarray(b.column("value"), np.float32))], ["language", "part", "key", "value"])

    hashed = entries.mapInArrow(keyed, "language int, part int, key long, value float")
    table = materialize(spark, hashed.repartitionByRange("language", "part", "key").sortWithinPartitions("language", "part", "key"), "model")
    discard(counts)
    return Model(table._loom_path, languages, uniform)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reach: float = REACH) -> DataFrame:
    """``(doc_id, language, bits, margin)`` of each row; ``margin`` is how many bits the runner-up is worse."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    model = train(docs, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("language"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("margin"))

    def scan(batches: Iterator[pa.RecordBatch], m: Model = model) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for run in strings_by_size((t or "" for t in texts), CHARS_AT_ONCE):
                n, bits = m.score([texts[i] for i in run])
                best = bits.argmin(1)
                ordered = np.sort(bits, 1)
                margin = ordered[:, 1] - ordered[:, 0] if bits.shape[1] > 1 else np.zeros(len(run))
                none = n == 0
                names = [None if no else m.languages[k] for k, no in zip(best.tolist(), none.tolist(), strict=True)]
                part = b.slice(run[0], len(run))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("held_out"), pa.array(names, pa.string()), pa.array(n.astype(np.int32)), pa.array(ordered[:, 0], mask=none), pa.array(margin, mask=none)], ["doc_id", "lang", "held_out", "best", "n", "bits", "margin"])

    marked = rows.withColumn("held_out", F.expr("coalesce(pmod(xxhash64(text), 10) = 0, false)"))
    scored = materialize(spark, marked.mapInArrow(scan, f"doc_id {kind}, lang string, held_out boolean, best string, n int, bits double, margin double"), "language")
    length = F.least(F.floor(F.log2("n")), F.lit(12)).cast("int")
    own = scored.where("held_out and best = lang").select("best", length.alias("length"), "bits")
    spread = F.percentile_approx("bits", [0.5, 0.99], 10_000).alias("q")
    rules = own.rollup("best", "length").agg(F.count("*").alias("held"), spread).where("best is not null").collect()
    bound = {(r["best"], r["length"]): r["q"][0] + max(reach * (r["q"][1] - r["q"][0]), 0.15) for r in rules if r["length"] is None or r["held"] >= LEAST_HELD_OUT}
    limits = spark.createDataFrame([(lang, size, float(bound.get((lang, size), bound.get((lang, None), float("inf"))))) for lang in model.languages for size in range(13)], "best string, length int, most double")
    judged = scored.withColumn("length", length).join(F.broadcast(limits), ["best", "length"], "left")
    return judged.select("doc_id", F.when(F.col("bits") <= F.col("most"), F.col("best")).otherwise(UNKNOWN).alias("language"), F.round("bits", 4).alias("bits"), F.round("margin", 4).alias("margin"))
