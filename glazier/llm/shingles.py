"""Hashing of word shingles, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

from glazier.llm.common import mix64

# Words are runs of bytes other than space and \t\n\v\f\r; A-Z count as a-z.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_VALUES[ord("A"):ord("Z") + 1] = _VALUES[ord("a"):ord("z") + 1]
_BLOCK = 1 << 21  # bytes hashed at once
_powers = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:n], _powers["down"][:n]


def _block_words(data: np.ndarray) -> np.ndarray:
    spaces = np.ones(len(data) + 2, np.int8)
    spaces[1:-1] = _SPACES[data]
    edges = np.flatnonzero(np.diff(spaces))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= _BLOCK:
        return _block_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and not _SPACES[data[end]]:
            end += 1
        parts.append(_block_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; with fewer words, of the whole sequence."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    width = min(size, len(words))
    rolled = words[:len(words) - width + 1].copy()
    for i in range(1, width):
        rolled *= np.uint64(_BASE)
        rolled += words[i:len(words) - width + 1 + i]
    return np.unique(mix64(rolled + np.uint64(width)))
