"""Words of many texts at once, as NumPy arrays: places and 64-bit hashes, without a loop over words or texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; one text may be longer.
BLOCK = 1 << 20
#: An odd multiplier for the polynomial over a word's bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    size, factor = 1, base
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * np.uint64(factor)
        size, factor = size + m, factor * factor % (1 << 64)
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of INVERSE, kept up to a block's size."""
    have = _cache.get("up")
    if have is None or len(have) < n:
        up, down = _powers(BASE, max(n, BLOCK + 1)), _powers(INVERSE, max(n, BLOCK + 1))
        if n > 4 * BLOCK:
            return up, down
        _cache["up"], _cache["down"] = up, down
    return _cache["up"], _cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: number of the first, bytes lower-cased in A-Z, offsets of each text in them. Null is empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[column.offset : column.offset + n + 1]
    octets = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield at, _LOWER[octets[offsets[at] : offsets[end]]], offsets[at : end + 1] - offsets[at]
        at = end


def word_places(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words lie before each text's start and the last one's end."""
    inside = ~_IS_SPACE[octets]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(octets))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes."""
    up, down = powers(len(octets) + 1)
    sums = np.zeros(len(octets) + 1, dtype=np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[: len(octets)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, over text borders too; entry i is the run that begins at word i."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(BASE) + words[k : k + count])
    return out


def runs_inside(first: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Whether the run of n words from each place lies in one text; first: words before each text."""
    count = max(0, n_words - n + 1)
    ok = np.ones(count, dtype=bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < count)]] = False
    return ok
