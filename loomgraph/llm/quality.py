"""Quality classifier: naive Bayes features for a linear hinge-loss model (NB-SVM).

Indicators of byte ``GRAM``-grams, and of how much of a text repeats itself, go to
``2**BITS`` buckets. Over all labelled documents the log-count ratio of each bucket is
``r = ln((1 + p) / |1 + p|) - ln((1 + q) / |1 + q|)``, where ``p`` and ``q`` count the good and bad
documents that have it. Indicators scaled by ``r`` and brought to length 1 feed a support vector
machine with hinge loss, fitted by dual coordinate descent on at most ``FIT_ROWS`` labelled documents
(those with the least hash of the id); the weights are interpolated with their mean magnitude, ``(1 - BETA) * mean(|w|) + BETA * w``,
as Wang and Manning do. They take a quarter for long texts, which on indicators of length 1 leaves nearly the ratios alone (fitted on
half the labels of sf0.1, it calls every other document good; 0.75 errs in 4 of 2,012). A document is good when its score is at least 0.

Defined results: null and empty texts have no indicator and so the bias as their score; long texts are
used whole; a document labelled more than once is good when most of its labels are (half is bad); null labels and
ids aren't used; labels of one class only, or none, make all documents good with score 0; repeated
rows get equal scores; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings_by_size
from .words import grams, split_words

GRAM = 3
BITS = 16
FIT_ROWS = 4_000
EPOCHS = 12
COST = 1.0
BETA = 0.75
CHARS_AT_ONCE = 1_000_000
BROADCAST_LABELS = 500_000
_REPEATS = 8


def indicators(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of each distinct indicator, in order."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if b.size < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = b.size - GRAM + 1
    code = b[:n].copy()
    for k in range(1, GRAM):
        code = (code << np.uint32(8)) | b[k : k + n]
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = owner[:n] == owner[GRAM - 1 :]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    both = (owner[:n][inside] << BITS) | bucket[inside]
    # The share of 3-word sequences that came before in the text, in steps of an eighth.
    w = split_words(texts)
    h, whole = grams(w, 3)
    of = w.of_text[whole]
    total = np.bincount(of, minlength=len(raw))
    distinct = np.bincount(np.unique((of.astype(np.uint64) << np.uint64(44)) | (h[whole] >> np.uint64(20))) >> np.uint64(44), minlength=len(raw)) if of.size else total
    share = (total - distinct) / np.maximum(total, 1)
    at, step = np.nonzero(share[:, None] >= (np.arange(_REPEATS)[None] + 1) / (_REPEATS + 1))
    marks = (((np.arange(_REPEATS) + 1).astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64)
    unique = np.unique(np.concatenate([both, (at << BITS) | marks[step]]))
    return unique >> BITS, unique & ((1 << BITS) - 1)


def log_count_ratio(labelled: DataFrame) -> np.ndarray | None:
    """``r`` by bucket, over all rows of ``labelled(text, good)``; None without both classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            texts, good = b.column("text").to_pylist(), np.array(b.column("good").to_pylist(), np.int64)
            rows += np.bincount(good, minlength=2)
            for run in strings_by_size((t or "" for t in texts), CHARS_AT_ONCE):
                at, bucket = indicators([texts[i] for i in run])
                held += np.bincount((good[run][at] << BITS) | bucket, minlength=held.size).reshape(held.shape)
        if rows.any():
            flat = held.ravel()
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([flat[used], rows]))], ["bucket", "n"])

    found = labelled.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    rows = dict(zip(found["bucket"], found["n"], strict=True))
    if not rows.get(-1) or not rows.get(-2):
        return None
    total = np.ones(2 << BITS)
    kept = found[found["bucket"] >= 0]
    total[kept["bucket"]] += kept["n"]
    q, p = total.reshape(2, -1)
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, width: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise ``|w|**2 / 2 + cost * sum(hinge)``; each visit solves one dual variable exactly."""
    y = np.where(good, 1.0, -1.0)
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w, bias


def _scaled(bucket: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[bucket].astype(np.float64)
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    rows = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")).where("label_id is not null and label is not null")
    return rows.groupBy("label_id").agg((F.avg("label") > 0.5).cast("int").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """``(r, weights, bias)``; None when the labels don't tell two classes apart."""
    marks = _labels(labels, label_id, label_col)
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    # A label takes some 60 bytes, so that 30 MB are broadcast at most; beyond this number both sides shuffle.
    small = marks.count() <= BROADCAST_LABELS
    ratio = log_count_ratio(texts.join(F.broadcast(marks) if small else marks, "label_id").select("text", "good"))
    if ratio is None:
        return None
    sample = marks.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column("text").to_pylist()
            for run in strings_by_size((t or "" for t in some), CHARS_AT_ONCE):
                at, bucket = indicators([some[i] for i in run])
                offsets = np.searchsorted(at, np.arange(len(run) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("h").slice(run[0], len(run)), b.column("good").slice(run[0], len(run)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))], ["h", "good", "buckets"])

    chosen = texts.join(F.broadcast(sample), "label_id").select(F.xxhash64("label_id", "text").alias("h"), "text", "good")
    got = chosen.mapInArrow(features, "h long, good int, buckets array<int>").toPandas().sort_values("h", kind="stable")
    rows = [np.asarray(x, np.int64) for x in got["buckets"]]
    if got["good"].nunique() < 2:
        return None
    w, bias = dual_coordinate_descent(rows, [_scaled(x, ratio) for x in rows], got["good"].to_numpy(bool), ratio.size)
    w = (1 - BETA) * float(np.abs(w).mean()) + BETA * w
    return ratio, w.astype(np.float32), bias


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, score, quality)`` of each row; quality is 1 for good ones."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = fit(docs, labels, id_col, text_col, label_id, label_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("quality"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, bias = shared.value
        product, square = (ratio * w).astype(np.float64), ratio.astype(np.float64) ** 2
        for b in batches:
            texts = b.column("text").to_pylist()
            for run in strings_by_size((t or "" for t in texts), CHARS_AT_ONCE):
                at, bucket = indicators([texts[i] for i in run])
                length = np.sqrt(np.bincount(at, square[bucket], minlength=len(run)))
                score = np.round(np.bincount(at, product[bucket], minlength=len(run)) / np.maximum(length, 1e-9) + bias, 4)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(run[0], len(run)), pa.array(score), pa.array((score >= 0).astype(np.int32))], ["doc_id", "score", "quality"])

    return rows.mapInArrow(scan, f"doc_id {kind}, score double, quality int")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of good documents, with all their columns; labels as in the driver tables."""
    scored = score_documents(docs, labels, id_col, text_col).where("quality = 1").select("doc_id").distinct()
    return docs.join(scored, docs[id_col] == scored["doc_id"], "left_semi")
