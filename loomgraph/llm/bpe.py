"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A text is split by the vocabulary's pattern. The bytes of a piece are read as Latin-1, so that an
Aho-Corasick automaton over the reversed tokens finds, in one pass from the right, the longest token
that starts at every byte. Encoding walks from the left taking longest matches; a token that merging
could not leave beside its predecessor is shortened to its longest proper prefix token, and a dead
end steps back one token. Whether two tokens can stand side by side follows from the merge that made
each of them and is memoised, so a piece takes time linear in its bytes and the ids are exactly those
of rank-by-rank merging. Pieces repeat, so each worker keeps the ids of those it met, up to a bound.

Defined results: a null text has null ids, 0 tokens and counts as exact; an empty text has an empty
list; texts of any length are encoded whole; equal rows give equal rows; an empty table gives an empty
result; other columns, whatever their names, are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import release, strings_by_size

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PIECES_KEPT = 300_000
PAIRS_KEPT = 500_000
CHARS_AT_ONCE = 2_000_000


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The tokens by rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    if b"" in tokens or sum(len(t) == 1 for t in tokens) != 256:
        raise ValueError(f"{path} is no byte-level vocabulary with ranks from 0")
    return tokens


class Encoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        by_bytes = {t: i for i, t in enumerate(tokens)}
        self.shorter = [next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        self.beside: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            if len(t) > 1:
                pair = self._made_of(t, by_bytes, i)
                self.parts[i] = pair
                self.merged[pair] = i
        self.beside.clear()
        self.pieces = _Pieces(self)
        self.split = regex.compile(PATTERN).findall

    def _made_of(self, token: bytes, by_bytes: dict[bytes, int], rank: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one: the only split of lower ranks that can stand unmerged until then."""
        for n in range(1, len(token)):
            a, b = by_bytes.get(token[:n], rank), by_bytes.get(token[n:], rank)
            if a < rank and b < rank and self._compatible(a, b):
                return a, b
        raise ValueError(f"token {rank} can't be reached by merges")

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave ``a`` and ``b`` next to each other."""
        limit = len(self.tokens)
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:  # the later-made side is undone first
                limit = a
                left, a = parts[a]
                if left == a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def _beside(self, a: int, b: int) -> bool:
        found = self.beside.get((a, b))
        if found is None:
            if len(self.beside) >= PAIRS_KEPT:
                self.beside.clear()
            found = self.beside[a, b] = self._compatible(a, b)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        at = n
        for end, token in self.automaton.iter(piece[::-1].decode("latin-1")):
            start = n - 1 - end
            if start != at:  # the longest comes first
                longest[start] = token
                at = start
        ids: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        pos, sizes, shorter = 0, self.sizes, self.shorter
        token = longest[0] if n else -1
        while pos < n:
            end = pos + sizes[token]
            if alive[end] and (not ids or self._beside(ids[-1], token)):
                ids.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[pos] = 0
                token = ids.pop()
                pos -= sizes[token]
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Piece to its ids as int32 bytes; starts over when full."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = array("i", self.encoder.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = found
        return found


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, tokens: list[bytes]) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(tokens)
    return _encoders[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, token_ids, exact)`` for each row; exact: decoding the ids gives the text again.

    One scan, no shuffle. The vocabulary is read on the driver and broadcast; it is of fixed size.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    encode = encoding(docs, vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n_tokens, ids, exact in encode(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(ids)), n_tokens, ids, exact], ["doc_id", "n_tokens", "token_ids", "exact"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, n_tokens int, token_ids array<int>, exact boolean")


def encoding(docs: DataFrame, vocabulary: str = VOCABULARY):
    """A function for executors: a column of texts to its pieces ``(offset, n_tokens, ids, exact)``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def encode(texts: pa.Array) -> Iterator[tuple[int, pa.Array, pa.Array, pa.Array]]:
        encoder = _encoder(vocabulary, shared.value)
        texts = texts.to_pylist()
        for run in strings_by_size((t or "" for t in texts), CHARS_AT_ONCE):
            some = [texts[i] for i in run]
            ids = [encoder.encode(t or "") for t in some]
            exact = [encoder.decode(x.tolist()) == (t or "").encode() for x, t in zip(ids, some, strict=True)]
            sizes = np.array([x.size for x in ids], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            no = np.array([t is None for t in some])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=pa.array(no)) if no.any() else pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield run[0], pa.array(sizes), lists, pa.array(exact)
        release()

    return encode


def with_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ids_col: str = "token_ids", count_col: str = "n_tokens") -> DataFrame:
    """The rows with their ids and token count, in place of columns of those names."""
    kept = [c for c in docs.columns if c.lower() not in (ids_col.lower(), count_col.lower())]
    encode = encoding(docs, vocabulary)
    rest = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = StructType([*rest.schema.fields, StructField(count_col, IntegerType()), StructField(ids_col, ArrayType(IntegerType()))])
    place = kept.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n_tokens, ids, _ in encode(b.column(place)):
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(ids)) for i in range(len(kept))), n_tokens, ids], schema.names)

    # By place: names with dots don't resolve there.
    return rest.toDF(*(f"c{i}" for i in range(len(kept)))).mapInArrow(scan, schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ids; null ids give a null text, bytes that are no UTF-8 the replacement character."""
    kind = encoded.schema[id_col].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for b in batches:
            texts = [None if ids is None else b"".join(map(get, ids)).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(scan, f"doc_id {kind}, text string")
