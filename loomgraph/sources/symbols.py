"""Symbol indexes: the protobuf wire format, symbol strings, occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_KINDS = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(b):
            raise ValueError("the index is cut off")
        c = b[at]
        at += 1
        value |= (c & 0x7F) << shift
        if c < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("this is no symbol index")


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            size, at = _varint(b, at)
            if at + size > len(b):
                raise ValueError("the index is cut off")
            value, at = b[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = b[at : at + size], at + size
        else:
            raise ValueError("this is no symbol index")
        yield key >> 3, value


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def decode_index(content: bytes) -> Iterator[tuple[str, int, int, str, int, list[int]]]:
    """``(path, document, occurrence, symbol, roles, range)`` of every occurrence."""
    doc = 0
    for number, value in _fields(content):
        if number != 2 or isinstance(value, int):
            continue
        path, occurrences = "", []
        for n, v in _fields(value):
            if n == 1:
                path = v.decode()
            elif n == 2:
                occurrences.append(v)
        for k, raw in enumerate(occurrences):
            symbol, roles, range_, typed = "", 0, [], []
            for n, v in _fields(raw):
                if n == 1:
                    range_ += _numbers(v)
                elif n == 2:
                    symbol = v.decode()
                elif n == 3:
                    roles = v
                elif n in (8, 9):  # typed ranges: on one line, or over several
                    parts = dict(_fields(v))
                    typed = [parts.get(i, 0) for i in range(1, 4 if n == 8 else 5)]
            yield path, doc, k, symbol, roles, typed or range_
        doc += 1


def parse_descriptors(text: str) -> list[tuple[str, str]] | None:
    """``(kind, name)`` of each descriptor of a symbol; None when it isn't well-formed."""
    out, at = [], 0

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] == "`":
            end, got = at + 1, ""
            while end < len(text):
                if text[end] == "`":
                    if text[end + 1 : end + 2] != "`":
                        return got, end + 1
                    end += 1
                got += text[end]
                end += 1
            raise ValueError
        end = at
        while end < len(text) and (text[end].isalnum() or text[end] in "_+-$"):
            end += 1
        if end == at:
            raise ValueError
        return text[at:end], end

    try:
        while at < len(text):
            c = text[at]
            if c == "[":
                got, at = name(at + 1)
                kind, closing = "type_parameter", "]"
            elif c == "(":
                got, at = name(at + 1)
                kind, closing = "parameter", ")"
            else:
                got, at = name(at)
                if text[at : at + 1] == "(":
                    at = text.index(")", at) + 1
                    kind, closing = "method", "."
                else:
                    closing = text[at : at + 1]
                    kind = _KINDS[closing]
            if text[at : at + 1] != closing:
                return None
            at += 1
            out.append((kind, got))
    except (ValueError, KeyError):
        return None
    return out


def parse_symbol(symbol: str) -> dict | None:
    """Scheme, package and descriptors; None for local or malformed symbols."""
    parts = symbol.split(" ", 4)
    if symbol.startswith("local ") or len(parts) < 5:
        return None
    found = parse_descriptors(parts[4])
    return None if found is None else {"scheme": parts[0], "manager": parts[1], "package": parts[2], "version": parts[3], "descriptors": found}


def classify_symbol(symbol: str) -> str:
    parsed = parse_symbol(symbol)
    last = parsed["descriptors"][-1][0] if parsed and parsed["descriptors"] else ""
    return {"method": "function", "type": "class"}.get(last, "other")


def qualified_name(symbol: str) -> str | None:
    parsed = parse_symbol(symbol)
    return ".".join(n for k, n in parsed["descriptors"] if k in ("type", "method")) if parsed else None


@F.pandas_udf(StringType())
def symbol_kind(symbols: pd.Series) -> pd.Series:
    return symbols.map(classify_symbol)


@F.pandas_udf(StringType())
def symbol_name(symbols: pd.Series) -> pd.Series:
    return symbols.map(qualified_name)


def canonical_id(file: Column, kind: Column, name: Column) -> Column:
    return F.when(kind == "class", F.concat(file, F.lit("#class:"), name)).otherwise(F.concat(file, F.lit("#"), name))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(file, doc_idx, occ_idx, symbol, symbol_roles, range, row, kind)`` of an index file."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(decode_index(bytes(content))), columns=["file", "doc_idx", "occ_idx", "symbol", "symbol_roles", "range"])

    rows = raw.mapInPandas(decode, "file string, doc_idx int, occ_idx int, symbol string, symbol_roles int, range array<int>")
    # Rows of an index count from 0, lines of a file from 1.
    return rows.withColumn("row", F.try_element_at("range", F.lit(1)) + 1).withColumn("kind", symbol_kind("symbol"))
