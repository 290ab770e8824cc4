"""Suffix arrays by the difference-cover algorithm (mod 3), vectorised in numpy.

The suffixes at places not divisible by three are the sample.  Their triples are
sorted and named; if names repeat, the string of names is sorted recursively.
The remaining suffixes are sorted by their first symbol and the rank of the
sampled suffix that follows, and merged with the sample by symbol-and-rank keys
that both kinds have in common.
"""

from __future__ import annotations

import numpy as np

_SMALL = 8


def _pack(*parts: np.ndarray) -> np.ndarray:
    """One integer per row that orders like the tuple of its parts."""
    key = parts[0].astype(np.int64)
    for part in parts[1:]:
        base = int(part.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // base:  # too wide: replace by ranks first
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + part
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order; symbols are positive integers, the end sorts first."""
    n = len(symbols)
    if n <= _SMALL:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    # one sampled place past the end keeps the two halves of the recursion apart
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = _pack(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(triples, kind="stable")
    fresh = np.concatenate([[True], triples[order][1:] != triples[order][:-1]])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_pack(s[rest], rank[rest + 1]), kind="stable")]
    # merge: how many sampled suffixes are smaller than each remaining one
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    keys = _pack(np.concatenate([s[first], s[rest]]), np.concatenate([rank[first + 1], rank[rest + 1]]))
    smaller = np.searchsorted(keys[: len(first)], keys[len(first) :])
    keys = _pack(*[np.concatenate([x, y]) for x, y in ((s[second], s[rest]), (s[second + 1], s[rest + 1]), (rank[second + 2], rank[rest + 2]))])
    smaller += np.searchsorted(keys[: len(second)], keys[len(second) :])
    out = np.empty(n, dtype=np.int64)
    at = np.arange(len(rest)) + smaller
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def repeated_prefixes(strings: list[bytes], starts: np.ndarray, string_of: np.ndarray, limit: int) -> np.ndarray:
    """Which starts (places inside their strings) begin ``limit`` bytes that another of the given starts begins, too.

    All strings are sorted in one suffix array; suffixes that share ``limit``
    bytes are neighbours in it, so adjacent prefixes are compared.  Every start
    has ``limit`` bytes in its string.
    """
    lengths = np.array([len(x) for x in strings], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    symbols = data.astype(np.int64) + 1
    symbols[begins + lengths] = 257 + np.arange(len(strings))  # every string has an end of its own
    places = begins[string_of] + starts
    wanted = np.zeros(len(data), bool)
    wanted[places] = True
    order = suffix_array(symbols)
    order = order[wanted[order]]
    windows = np.lib.stride_tricks.sliding_window_view(data, limit)
    equal = np.zeros(len(order) + 1, bool)
    for at in range(1, len(order), 50_000):
        pair = slice(at, min(at + 50_000, len(order)))
        equal[pair] = (windows[order[pair]] == windows[order[pair.start - 1 : pair.stop - 1]]).all(axis=1)
    again = np.zeros(len(data), bool)
    again[order] = equal[:-1] | equal[1:]
    return again[places]
