"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, telephone numbers, card numbers (Luhn-valid), IBANs, social
security numbers and IP addresses. What else in a text reveals them is learnt from the corpus: for
each entity ``e`` and each term ``t`` of a document that holds it, wherever it stands there, the pointwise mutual information
``ln(n(e,t) * N / (n(e) * n(t)))`` over documents is divided by the entity's own information
``ln(N / n(e))``. At 1 a term occurs with nothing but this entity, so that reading it discloses as much as
the value itself. As few documents are little evidence, the share ``n(e,t) / n(t)`` is taken at its lower
confidence bound (Wilson's, ``Z`` standard errors). A term whose disclosure is ``DISCLOSURE`` or more goes
wherever its entity stands; so does, once the corpus is large enough for the bound, a word that no other document has. All
counts are of rows, exact and over all documents, copies among them.

No pairs of entities and terms are formed where the counts can't reach the threshold (``n(t)`` is at most
``n(e) ** DISCLOSURE * N ** (1 - DISCLOSURE)`` then), and entities that stand in just the same documents, as those of
an address list do, are one class with one set of counts.

Entities are generalised to their kind (``<EMAIL>``), terms in capitals or with digits to
``<NAME>`` or ``<NUMBER>``; other terms are removed.

Defined results: null and empty texts have no entities and stay; long texts are sanitised whole;
repeated rows are sanitised alike; a disclosure equal to the threshold exceeds it; an entity that every
document holds has no information, so no term discloses it; an empty table gives an empty
result; other columns, whatever their names, are ignored by the report and kept by sanitisation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .common import discard, materialize, release, strings_by_size
from .words import char_places, split_words

DISCLOSURE = 0.8
Z = 1.645
CHARS_AT_ONCE = 2_000_000
HELD_AT_ONCE = 2_000_000

_ENTITY = re.compile(
    r"(?P<EMAIL>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})"
    r"|(?<![\w.])(?P<IP>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)"
    r"|(?<![A-Za-z0-9])(?P<IBAN>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w.-])(?P<SSN>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.])(?P<CARD>\d(?:[ -]?\d){12,18})(?![\w]|[.-]\d)"
    r"|(?<![\w.])(?P<PHONE>\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"
)
_HAS = re.compile(r"@|\d{2}|\d\.\d")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each protected entity, in order."""
    if not text or not _HAS.search(text):
        return []
    found = []
    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        # Sixteen digits are treated as a card even when the check digit is wrong: a typo is still disclosed.
        if kind == "CARD" and not _luhn(digits := re.sub(r"\D", "", m[0])) and len(digits) != 16:
            continue
        found.append((m.start(), m.end(), kind))
    return found


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _value(text: str, start: int, end: int) -> int:
    return _hash(re.sub(r"[ ().-]", "", text[start:end].lower()))


def _terms(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """The distinct words of a text beside its entities, as hashes."""
    at, parts = 0, []
    for s, e, _ in spans:
        parts.append(text[at:s])
        at = e
    return np.unique(split_words(["\n".join([*parts, text[at:]])]).hashes)


def _private(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``(..., key, text, entities, terms)`` of each row that holds an entity, by hash; ``columns`` end with the text as ``text``."""
    rows = docs.select(*columns).where(F.col("text").rlike(r"@|[0-9]{2}|[0-9]\.[0-9]")).withColumn("key", F.md5("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, values, terms = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                spans = entities(text)
                if spans:
                    keep.append(i)
                    values.append(sorted({_value(text, s, e) for s, e, _ in spans}))
                    terms.append(_terms(text, spans).view(np.int64))
            if keep:
                kept = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))], [*kept.schema.names, "entities", "terms"])

    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(scan, f"{inner}, entities array<long>, terms array<long>")


def _document_counts(texts: DataFrame) -> DataFrame:
    """``(term, docs)``: in how many rows each word occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "docs"])

        for b in batches:
            texts_ = b.column("text").to_pylist()
            for run in strings_by_size(texts_, CHARS_AT_ONCE):
                w = split_words([texts_[i] for i in run])
                order = np.lexsort((w.hashes, w.of_text))
                of, h = w.of_text[order], w.hashes[order]
                held.append(h[np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))] if h.size else h)
                size += held[-1].size
                if size > HELD_AT_ONCE:
                    yield flush()
                    size = 0
            release()
        if held:
            yield flush()

    return texts.mapInArrow(scan, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def _lower_bound(hits: Column, n: Column) -> Column:
    """Wilson's lower bound of the share ``hits / n``."""
    p, z2 = hits / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosures(docs: DataFrame, private: DataFrame, text_col: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """``(key, term, disclosure)``: the terms of each text whose disclosure of one of its entities reaches the threshold, by hash."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    total = float(texts.count())
    once = private.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    once = materialize(spark, once, "entity-documents")
    held = once.select("key", "copies", F.explode("entities").alias("entity"))
    # Entities of the same documents are one class, told by two sums over those.
    marks = held.groupBy("entity").agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.hash("key").cast("long")).alias("y"), F.sum("copies").alias("own"))
    classes = held.join(marks, "entity").select("key", F.struct("x", "y", "own").alias("entity"), "own").distinct()
    classes = materialize(spark, classes, "entity-classes")
    limit = lambda own: F.pow(own, F.lit(threshold)) * total ** (1 - threshold) + 1e-6 if threshold > 0 else F.lit(total)
    most = classes.groupBy("key").agg(F.max("own").alias("most"))
    terms = once.join(most, "key").select("key", "copies", "most", F.explode("terms").alias("term"))
    rare = terms.join(_document_counts(texts), "term").where(F.col("docs") <= limit(F.col("most"))).select("key", "copies", "term", "docs")
    pairs = rare.join(classes, "key").where(F.col("docs") <= limit(F.col("own")))
    both = F.sum("copies").over(Window.partitionBy("entity", "term"))
    judged = pairs.withColumn("both", both).withColumn("share", _lower_bound(F.col("both"), F.col("docs")))
    information = F.log(F.lit(total) / F.col("own"))
    judged = judged.select("key", "term", F.try_divide(F.log(F.col("share") * F.lit(total) / F.col("own")), information).alias("disclosure"))
    found = materialize(spark, judged.where(F.col("disclosure") >= threshold).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure")), "disclosing")
    discard(once)
    discard(classes)
    return found


def sanitised(text: str | None, revealed: np.ndarray) -> tuple[str | None, int, int]:
    """The text, the number of entities generalised and of terms generalised or removed; ``revealed`` are term hashes."""
    spans = entities(text)
    if not spans:
        return text, 0, 0
    cuts = [(s, e, f"<{kind}>") for s, e, kind in spans]
    terms = 0
    if revealed.size:
        w, place = split_words([text]), char_places(text)
        starts, ends = np.array([s for s, _, _ in spans]), np.array([e for _, e, _ in spans])
        for k in np.flatnonzero(np.isin(w.hashes.view(np.int64), revealed)).tolist():
            s, e = place(int(w.starts[k])), place(int(w.ends[k]))
            if not ((starts < e) & (s < ends)).any():
                word = text[s:e]
                cuts.append((s, e, "<NUMBER>" if any(c.isdigit() for c in word) else "<NAME>" if word[0].isupper() else ""))
                terms += 1
    at, parts = 0, []
    for s, e, mark in sorted(cuts):
        parts += [text[at:s], mark]
        at = e
    return "".join([*parts, text[at:]]), len(spans), terms


def _revealed(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.collect_list("term").alias("revealed"))  # no more than the text has words


def sanitised_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """``(doc_id, text, entities, terms)`` of each row that changes."""
    kind = docs.schema[id_col].dataType.simpleString()
    private = materialize(docs.sparkSession, _private(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]), "private")
    revealed = _revealed(disclosures(docs, private, text_col, threshold))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sanitised(t, np.array(r or (), np.int64)) for t, r in zip(b.column("text").to_pylist(), b.column("revealed").to_pylist(), strict=True)]
            texts, n, terms = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(terms, pa.int32())], ["doc_id", "text", "entities", "terms"])

    return private.select("doc_id", "text", "key").join(revealed, "key", "left").select("doc_id", "text", "revealed").mapInArrow(scan, f"doc_id {kind}, text string, entities int, terms int")


def sanitise(docs: DataFrame, text_col: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """All rows and columns, the texts sanitised."""
    private = materialize(docs.sparkSession, _private(docs, [F.col(f"`{text_col}`").alias("text")]), "private")
    revealed = materialize(docs.sparkSession, _revealed(disclosures(docs, private, f"`{text_col}`", threshold)), "revealed")
    discard(private)

    @F.pandas_udf(StringType())
    def clean(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([sanitised(t, np.array(() if r is None else r, np.int64))[0] for t, r in zip(texts, terms, strict=True)], dtype=object)

    packed = docs.select(F.md5(F.col(f"`{text_col}`")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), F.col(f"`{text_col}`").alias("text"))
    joined = packed.join(revealed, "key", "left").select("kept", clean("text", "revealed").alias("text"))
    return joined.select(*(F.col("text").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns))
