"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of ASCII letters and digits or of any characters beyond ASCII, in lower case.
All hashing is a polynomial over the UTF-8 bytes modulo 2**64 from prefix sums, then mixed, so no
Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from .common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_IS_WORD[128:] = True
_IS_TOKEN = np.ones(256, bool)
_IS_TOKEN[[*b" \t\n\r\x0b\x0c"]] = False
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or have.size < n:
        made = np.full(max(n, 1 << 16), base, np.uint64)
        made[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(made, out=made)
        have = _powers[key] = made
    return have


@dataclass
class Words:
    """``hashes`` of all words; text ``i`` has those from ``offsets[i]`` to ``offsets[i + 1]``; ``starts`` and ``ends`` are byte places in the joined texts, ``bases`` where each text begins there."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bases: np.ndarray

    @property
    def of_text(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(self.offsets.size - 1), np.diff(self.offsets))


def split_words(texts: Sequence[str | None], verbatim: bool = False) -> Words:
    """``verbatim``: words are the runs between white space instead, with their case."""
    raw = [(t or "").encode() if verbatim else (t or "").lower().encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes)])
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = (_IS_TOKEN if verbatim else _IS_WORD)[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        prefix = np.zeros(b.size + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, b.size, "up")[: b.size], out=prefix[1:])
        hashes = mix64((prefix[ends] - prefix[starts]) * _power(_INVERSE, b.size, "down")[starts] + (ends - starts).astype(np.uint64))
    offsets = np.searchsorted(starts, bases)
    return Words(hashes, offsets, starts, ends, bases[:-1])


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether they lie in one text."""
    total = w.hashes.size
    with np.errstate(over="ignore"):
        h = np.zeros(total, np.uint64)
        for k in range(min(n, total)):
            part = w.hashes[k:]
            h[: total - k] = h[: total - k] * np.uint64(0xD6E8FEB86659FD93) + part
    last = np.repeat(w.offsets[1:], np.diff(w.offsets))
    return mix64(h), np.arange(total) + n <= last


def char_places(text: str) -> Callable[[int], int]:
    """From a byte place of the lower-case text to a place of the text, whose characters may be longer or shorter."""
    if text.isascii():
        return int
    sizes = np.cumsum([0, *(len(c.lower().encode("utf-8", "surrogatepass")) for c in text)])
    return lambda byte: int(np.searchsorted(sizes, byte))
