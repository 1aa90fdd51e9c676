"""Word and shingle hashes of whole texts, without a Python loop over words."""

from __future__ import annotations

import numpy as np

from .rolling import U64, mix, prefixes, span_hash

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = U64(0xD6E8FEB86659FD93)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """A hash of each word of one text; fold: A-Z count as a-z."""
    data = np.frombuffer(text, np.uint8)
    if fold:
        data = _FOLD[data]
    start, end = word_spans(data)
    return span_hash(prefixes(data), start, end)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; fewer words make one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    return _polynomial(mix(words), np.s_[:n], width, lambda i: np.s_[i : n + i])


def windows_at(words: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The hashes of ``windows`` at the given starts alone."""
    return _polynomial(mix(words), start, width, lambda i: start + i)


def _polynomial(words: np.ndarray, first, width: int, later) -> np.ndarray:
    out = words[first] * _STEP + U64(width)
    for i in range(1, width):
        out = out * _STEP + words[later(i)]
    return mix(out)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text; empty without words."""
    return np.unique(windows(word_hashes(text), width))
