"""Numpy kernels on bytes: rolling hashes and content-chosen positions.

Every function works on one tile (a run of bytes of bounded length), so memory
is bounded by the tile and not by the document.  Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
POSITION_BITS = 21
TILE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


_LETTERS = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept for the next call."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        size = 1 << max(16, (n - 1).bit_length())
        had = np.empty(size, U64)
        had[0] = 1
        done, step = 1, base
        while done < size:
            had[done : 2 * done] = had[:done] * U64(step)
            step = step * step % (1 << 64)
            done *= 2
        _powers[base] = had
    return had[:n]


def prefixes(data: np.ndarray) -> np.ndarray:
    """Sums G with hash(i, j) = (G[j] - G[i]) * BASE**i for the bytes i..j-1."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_LETTERS[data] * powers(_INVERSE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end-1, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_BASE, len(sums))[start])


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * powers(_BASE, n)) if n > 0 else np.empty(0, U64)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has so many."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chosen_positions(grams: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the least of grams[i : i + width] stands (leftmost of equals)."""
    mask = U64((1 << POSITION_BITS) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=U64)
    return (sliding_minimum(packed, width) & mask).astype(np.int64)


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The four bytes from each position on as one number in byte order."""
    out = np.zeros(len(at), U64)
    for i in range(4):
        out = (out << U64(8)) | data[at + i].astype(U64)
    return out
