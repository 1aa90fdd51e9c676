"""Records of numbers as compact blobs, so that millions of them cross a
shuffle as few rows.

A blob holds columns of equal length.  Each is cut into byte planes (all first
bytes, all second bytes, ...), which the shuffle's compression can use; a
sorted column is stored as differences first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .rolling import U64


def pack(columns: Sequence[np.ndarray], ascending: int | None = None) -> bytes:
    """ascending: which column, of uint64, is sorted and kept as differences."""
    parts = [np.array([len(columns), -1 if ascending is None else ascending], np.int64).tobytes()]
    for i, column in enumerate(columns):
        column = np.ascontiguousarray(column)
        if i == ascending:
            column = np.diff(column, prepend=U64(0))
        parts.append(column.dtype.str.encode().ljust(8) + np.int64(len(column)).tobytes())
        parts.append(column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes())
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, ascending = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for i in range(n):
        dtype, length = np.dtype(blob[at : at + 8].decode().strip()), int(np.frombuffer(blob, np.int64, 1, at + 8)[0])
        size = dtype.itemsize * length
        planes = np.frombuffer(blob, np.uint8, size, at + 16).reshape(dtype.itemsize, length)
        column = np.ascontiguousarray(planes.T).view(dtype).reshape(length)
        out.append(np.cumsum(column, dtype=U64) if i == ascending else column)
        at += 16 + size
    return out


def multikey_order(columns: Sequence[np.ndarray]) -> np.ndarray:
    """The order that sorts rows by several keys: quicksort by the first one,
    then by the next within the runs that are still equal, and so on.  Rows
    that the first keys tell apart are not touched again."""
    order = np.argsort(columns[0], kind="quicksort")
    if len(order) < 2:
        return order
    key = columns[0][order]
    run = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    for column in columns[1:]:
        same = run[1:] == run[:-1]
        still = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(still):
            break
        rows = order[still]
        inner = np.lexsort((column[rows], run[still]))
        order[still] = rows[inner]
        key = column[order]
        run = np.cumsum(np.concatenate(([False], (run[1:] != run[:-1]) | (key[1:] != key[:-1]))))
    return order


def bucket_of(splitters: Sequence[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which range a pair of keys falls into; equal pairs always share one.

    splitters: the two parts of the sorted pairs at which a new range starts.
    """
    heads, tails = splitters
    low = np.searchsorted(heads, first, "left")
    high = np.searchsorted(heads, first, "right")
    out = low.copy()
    tied = np.flatnonzero(high > low)
    if len(tied):
        for at in np.unique(low[tied]):
            mine = tied[low[tied] == at]
            out[mine] = at + np.searchsorted(tails[at : high[mine[0]]], second[mine], "right")
    return out


def choose_splitters(first: np.ndarray, second: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that cut a sorted sample into equal parts, repeats left out."""
    order = np.lexsort((second, first))
    at = np.unique((np.arange(1, buckets) * len(order)) // max(buckets, 1)) if len(order) else np.empty(0, int)
    first, second = first[order][at], second[order][at]
    if len(first):
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        first, second = first[new], second[new]
    return first, second


def slices(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, row numbers) for each bucket that occurs; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    values, start = np.unique(bucket[order], return_index=True)
    return [(int(v), rows) for v, rows in zip(values, np.split(order, start[1:]), strict=True)]
