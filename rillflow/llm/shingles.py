"""Word-shingle sets and b-bit MinHash signatures, vectorised over blocks of documents.

Words are the maximal runs of bytes other than space and 0x09-0x0D after
lower-casing A-Z.  A document's set holds its distinct five-word shingles; a
document with one to four words has its whole sequence as its only shingle; a
document without words (or with null text) has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
BLOCK_BYTES = 1 << 19

_GOLDEN = 0x9E3779B97F4A7C15
_MULT = 0xD1342543DE82EF95
_INVERSE = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash's multiplier, and of its inverse."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWER_CACHE:
        _POWER_CACHE.clear()
        _POWER_CACHE[size] = (_powers(_MULT, size), _powers(_INVERSE, size))
    return _POWER_CACHE[size]


def byte_sums(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums (n + 1) of a polynomial byte hash, and inverse powers: ``(sums[j] - sums[i]) * inverse[i]`` names bytes i to j."""
    joined = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
    power, inverse = power_tables(len(joined))
    running = np.empty(len(joined) + 1, dtype=np.uint64)
    running[0] = 0
    np.cumsum(_BYTE_VALUE[joined] * power[: len(joined)], out=running[1:])
    return running, inverse


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive documents, in blocks of about ``limit`` bytes; null becomes empty."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def locate_words(block: list[bytes], fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's folded (lower-cased) bytes, its words' starts, ends and 64-bit hashes, and where each document's words begin (n + 1 offsets)."""
    joined = fold[np.frombuffer(b" ".join(block) + b" ", dtype=np.uint8)]
    lengths = np.fromiter((len(x) + 1 for x in block), dtype=np.int64, count=len(block))
    solid = ~_SPACE[joined]
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    running, inverse = byte_sums(joined)
    names = mix64((running[ends] - running[starts]) * inverse[starts])
    return joined, starts, ends, names, np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths))])


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes, in order."""
    weights = _powers(0xC2B2AE3D27D4EB4F, width + 1)
    for block in blocks(texts):
        _, _, _, words, begins = locate_words(block)
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * weights[k]
        rolled = mix64(rolled)
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                few = (words[lo:hi] * weights[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
                yield mix64(few + weights[width:] * np.uint64(hi - lo))
            else:
                yield np.empty(0, dtype=np.uint64)


class MinHasher:
    """``n`` min-wise hash values per set, each cut to 16 bits (a b-bit signature with b = 16)."""

    def __init__(self, n: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """uint16 signature of a non-empty set."""
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(low, (self.a * x[None, at : at + 2048] + self.b).min(axis=1), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
