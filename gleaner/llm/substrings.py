"""Exact removal of repeated byte strings by a sparse, distributed suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
in the corpus (smaller doc_id, or same document and earlier start).

Sorting every suffix would move a record per byte.  So only some suffixes are
sorted: in each stretch of ``length`` bytes the one whose first ``lead`` bytes
hash lowest.  Equal stretches choose the same suffix, and one suffix speaks for
the run of stretches (about 35 for 100 bytes) that chose it.

1. Sampled suffixes give splitters, and suffixes are dealt into ranges by their
   leading bytes, then by a hash of all bytes that their run of stretches spans.
2. Each range is sorted by multikey quicksort.  Runs with equal spans repeat
   each other whole: all but the earliest go.
3. Where runs share the leading bytes and not the span, they may share some
   stretches.  Only these fetch their bytes, are dealt and sorted again, and
   are compared stretch by stretch.
4. Leading bytes that stand at a boundary of ranges are compared across the
   ranges, by one aggregation over their stretches.

Before each exchange a task keeps one of each group of equals that it has, so a
passage in a third of all documents makes a row per task, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .packed import bucket_of, choose_splitters, multikey_order, pack, slices, unpack
from .rolling import TILE, U64
from .runtime import content_key, order_id, stored

_FOUND = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("hash", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("key", pa.int64())])
_FOUND_SQL = "kind byte, doc long, hash long, lo long, hi long, key long"
_BLOB_SQL = "bucket int, payload binary"
REMOVED, OPEN, ACROSS = 0, 1, 2
#: Runs that a task gathers before it deals them out, and bytes of leading suffix.
_GATHER = 1 << 21


def runs_of(data: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, span, start, count) of each run of stretches that choose one suffix.

    key: leading four bytes and hash of the ``lead`` bytes of the suffix; span:
    hash of all bytes of the run's stretches; start: first stretch; count:
    stretches.  Long texts are cut into tiles, which at most splits a run.
    """
    out = []
    for at in range(0, max(len(data) - length + 1, 0), TILE):
        tile = data[at : at + TILE + length - 1]
        sums = rolling.prefixes(tile)
        grams = rolling.gram_hashes(sums, lead)
        chosen = rolling.chosen_positions(grams, length - lead + 1)
        lo = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
        hi = np.concatenate((lo[1:] - 1, [len(chosen) - 1]))
        suffix = chosen[lo]
        key = (rolling.leading(tile, suffix) << U64(32)) | (grams[suffix] >> U64(32))
        shape = ((suffix - lo).astype(U64) << U64(16)) | (hi - lo).astype(U64)
        out.append((key, rolling.mix(rolling.span_hash(sums, lo, hi + length) ^ shape), lo + at, hi - lo + 1))
    if not out:
        return np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(doc: np.ndarray, hash_: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document, with those that touch or overlap made one."""
    order = np.lexsort((lo, hash_, doc))
    doc, hash_, lo, hi = doc[order], hash_[order], lo[order], hi[order]
    if not len(doc):
        return doc, hash_, lo, hi
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])))
    part = np.cumsum(new) - 1
    # Running maximum of the ends within a document: shift each document above the last.
    reach = np.maximum.accumulate(hi + part * (1 << 40)) - part * (1 << 40)
    new[1:] |= lo[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return doc[start], hash_[start], lo[start], np.maximum.reduceat(hi, start)


def _firsts(order: np.ndarray, same: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, with same[i] if row i equals row i-1 but for its place:
    the first of each group, and which rows stand at another place than it."""
    first = np.flatnonzero(~same)
    head = np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
    moved = np.zeros(len(order), bool)
    for column in place:
        column = column[order]
        moved |= column != column[head]
    return order[first], order[moved]


def _deal(cols: dict[str, np.ndarray], splitters, base: int, part: int) -> Iterator[tuple[int, bytes]]:
    """Keeps the earliest of equal runs and deals them out; the rest are removed spans."""
    place = [cols["doc"], cols["hash"], cols["start"]]
    order = multikey_order([cols["key"], cols["span"], *place])
    key, span = cols["key"][order], cols["span"][order]
    same = np.concatenate(([False], (key[1:] == key[:-1]) & (span[1:] == span[:-1])))
    keep, gone = _firsts(order, same, place)
    spans = merged(cols["doc"][gone], cols["hash"][gone], cols["start"][gone], cols["start"][gone] + cols["count"][gone] + cols["length"] - 1)
    if len(spans[0]):
        yield base + part % base, pack(spans)
    keep = keep[np.lexsort((cols["span"][keep], cols["key"][keep]))]
    for bucket, rows in slices(bucket_of(splitters, cols["key"][keep], cols["span"][keep])):
        rows = keep[rows]
        docs, index = np.unique(np.stack((cols["doc"][rows], cols["hash"][rows]), 1), axis=0, return_inverse=True)
        yield bucket, pack(
            [cols["key"][rows], cols["span"][rows], index.reshape(-1).astype(np.uint32), cols["start"][rows].astype(np.uint32), cols["count"][rows].astype(np.uint16), docs[:, 0].copy(), docs[:, 1].copy()],
            ascending=0,
        )


def _suffixes(length: int, lead: int, splitters, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = 0

        def flush():
            key, span, start, count, doc, hash_ = (np.concatenate(x) for x in zip(*held, strict=True))
            cols = {"key": key, "span": span, "start": start, "count": count, "doc": doc, "hash": hash_, "length": length}
            got = list(_deal(cols, splitters, base, part))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            docs, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "hash"))
            for text, doc, hash_ in zip(batch.column("text"), docs, hashes, strict=True):
                key, span, start, count = runs_of(np.frombuffer(text.as_buffer(), np.uint8), length, lead)
                if len(key):
                    held.append((key, span, start, count, np.full(len(key), doc), np.full(len(key), hash_)))
                    size += len(key)
                if size >= _GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _found(kind: int, doc, hash_, lo, hi, key=None) -> pa.Table:
    key = np.zeros(len(doc), np.int64) if key is None else key.view(np.int64)
    return pa.table([pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc), pa.array(hash_), pa.array(lo), pa.array(hi), pa.array(key)], schema=_FOUND)


def _compare_runs(length: int, splitters, base: int):
    """One range of suffixes: equal spans are resolved, shared leading bytes stay open."""
    boundary = np.unique(splitters[0])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        blobs = [unpack(x.as_py()) for x in group.column("payload")]
        if bucket >= base:
            return _found(REMOVED, *merged(*(np.concatenate(x) for x in zip(*blobs, strict=True))))
        k, span, start, count, doc, hash_ = [], [], [], [], [], []
        for a, b, index, c, d, docs, hashes in blobs:
            k.append(a), span.append(b), start.append(c.astype(np.int64)), count.append(d.astype(np.int64)), doc.append(docs[index]), hash_.append(hashes[index])
        k, span, start, count, doc, hash_ = (np.concatenate(x) for x in (k, span, start, count, doc, hash_))
        order = multikey_order([k, span, doc, hash_, start])
        a, b = k[order], span[order]
        same = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
        keep, gone = _firsts(order, same, [doc, hash_, start])
        out = [_found(REMOVED, *merged(doc[gone], hash_[gone], start[gone], start[gone] + count[gone] + length - 1))]
        lead = k[keep]
        again = lead[1:] == lead[:-1]
        shared = np.concatenate((again, [False])) | np.concatenate(([False], again)) | np.isin(lead, boundary)
        rows = keep[shared]
        out.append(_found(OPEN, doc[rows], hash_[rows], start[rows], start[rows] + count[rows] - 1, k[rows]))
        return pa.concat_tables(out)

    return run


def _contexts(length: int, splitters, base: int):
    """Fetches the bytes of open runs and deals them out by their leading bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            key, spread, start, count, doc, hash_, texts = ([] for _ in range(7))
            for text, d, h, runs in held:
                lo = np.array([r["lo"] for r in runs], np.int64)
                n = np.array([r["hi"] for r in runs], np.int64) - lo + 1
                key.append(np.array([r["key"] for r in runs], np.int64).view(U64))
                spread.append(rolling.mix(lo.astype(U64) + np.int64(h).view(U64)))
                start.append(lo), count.append(n), doc.append(np.full(len(lo), d)), hash_.append(np.full(len(lo), h))
                texts.extend(text[a:b] for a, b in zip(lo, lo + n + length - 1, strict=True))
            key, spread, start, count, doc, hash_ = (np.concatenate(x) for x in (key, spread, start, count, doc, hash_))
            got = []
            for bucket, rows in slices(bucket_of(splitters, key, spread)):
                body = b"".join(texts[i] for i in rows)
                got.append((bucket, pack([key[rows], start[rows], count[rows].astype(np.uint16), doc[rows], hash_[rows], np.frombuffer(body, np.uint8)])))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("text", "doc", "hash", "runs")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= _GATHER // 32:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _compare_stretches(length: int, splitters):
    """One range of open runs, stretch by stretch."""
    boundary = np.unique(splitters[0])

    def run(_: tuple, group: pa.Table) -> pa.Table:
        blobs = [unpack(x.as_py()) for x in group.column("payload")]
        key, start, count, doc, hash_, body = (np.concatenate(x) for x in zip(*blobs, strict=True))
        count = count.astype(np.int64)
        size = count + length - 1
        end = np.cumsum(size)
        value = np.empty(int(count.sum()), U64)
        at = done = 0
        while at < len(count):  # tiles of whole runs
            to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + TILE, "right")))
            low = end[at] - size[at]
            sums = rolling.prefixes(body[low : end[to - 1]])
            mine = count[at:to]
            place = np.repeat(end[at:to] - size[at:to] - low, mine) + _steps(mine)
            value[done : done + len(place)] = rolling.span_hash(sums, place, place + length)
            done, at = done + len(place), to
        owner = np.repeat(np.arange(len(count)), count)
        where = start[owner] + _steps(count)
        across = np.isin(key, boundary)[owner]
        doc, hash_ = doc[owner], hash_[owner]
        inside = np.flatnonzero(~across)
        order = inside[multikey_order([value[inside], doc[inside], hash_[inside], where[inside]])]
        v = value[order]
        _, gone = _firsts(order, np.concatenate(([False], v[1:] == v[:-1]))[: len(order)], [doc, hash_, where])
        out = [_found(REMOVED, *merged(doc[gone], hash_[gone], where[gone], where[gone] + length))]
        rows = np.flatnonzero(across)
        if len(rows):
            order = rows[multikey_order([value[rows], doc[rows], hash_[rows], where[rows]])]
            v = value[order]
            keep, gone = _firsts(order, np.concatenate(([False], v[1:] == v[:-1])), [doc, hash_, where])
            out.append(_found(REMOVED, *merged(doc[gone], hash_[gone], where[gone], where[gone] + length)))
            out.append(_found(ACROSS, doc[keep], hash_[keep], where[keep], where[keep] + length, value[keep]))
        return pa.concat_tables(out)

    return run


def _steps(count: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after the other."""
    end = np.cumsum(count)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - count, count)


def _sample(length: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                key, span, _, _ = runs_of(np.frombuffer(text.as_buffer(), np.uint8), length, lead)
                pick = np.flatnonzero(rolling.mix(span) % U64(16) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array(span[pick].view(np.int64))], ["first", "second"])

    return run


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toPandas()
    return got["first"].to_numpy(np.int64).view(U64), got["second"].to_numpy(np.int64).view(U64)


def repeated_spans(docs: DataFrame, length: int = 100, lead: int = 32, runs_per_range: int = 700_000, sample: int = 50_000) -> DataFrame:
    """(doc, hash, lo, hi): byte spans to remove of each document, not yet merged.

    docs: (doc long, hash long, text binary).  ``sample`` bounds the suffixes
    that set the splitters; they steer balance only.
    """

    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    expected = max(1, total * 2 // (length - lead + 2))
    buckets = max(1, -(-expected // runs_per_range))
    sample = max(sample, 8 * buckets)
    every = max(1, expected // 16 // sample)
    few = docs.where(F.pmod("hash", F.lit(every)) == 0).select("text").mapInArrow(_sample(length, lead), "first long, second long")
    splitters = choose_splitters(*_collected(few), buckets)
    base = len(splitters[0]) + 1

    dealt = docs.mapInArrow(_suffixes(length, lead, splitters, base), _BLOB_SQL)
    first = stored(dealt.groupBy("bucket").applyInArrow(_compare_runs(length, splitters, base), _FOUND_SQL), "runs")

    open_ = first.where(F.col("kind") == OPEN)
    n_open = open_.count()
    every = max(1, n_open // sample)
    spread = F.xxhash64("doc", "hash", "lo")
    few = open_.where(F.pmod(spread, F.lit(every)) == 0).select(F.col("key").alias("first"), spread.alias("second"))
    marks = choose_splitters(*_collected(few), max(1, -(-n_open * 16 // runs_per_range)))
    runs = open_.groupBy("doc", "hash").agg(F.collect_list(F.struct("lo", "hi", "key")).alias("runs"))
    joined = docs.join(runs.hint("shuffle_hash"), ["doc", "hash"]).select("text", "doc", "hash", "runs")
    dealt = joined.mapInArrow(_contexts(length, marks, len(marks[0]) + 1), _BLOB_SQL)
    second = stored(dealt.groupBy("bucket").applyInArrow(_compare_stretches(length, marks), _FOUND_SQL), "stretches")

    across = second.where(F.col("kind") == ACROSS)
    earliest = across.groupBy("key").agg(F.min(F.struct("doc", "hash", "lo")).alias("earliest"))
    later = across.join(earliest, "key").where(F.struct("doc", "hash", "lo") != F.col("earliest"))
    span = ["doc", "hash", "lo", "hi"]
    return first.where(F.col("kind") == REMOVED).select(span).unionAll(second.where(F.col("kind") == REMOVED).select(span)).unionAll(later.select(span))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            end, removed, n, kept = 0, 0, 0, []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if lo > end or not n:
                    kept.append(text[end:lo])
                    n += 1
                    removed += hi - lo
                    end = hi
                elif hi > end:
                    removed += hi - end
                    end = hi
            kept.append(text[end:])
            body = b"".join(kept)
            rows.append((doc_id, len(text), removed, n, hashlib.sha256(body).hexdigest(), body))
        yield pa.RecordBatch.from_pydict(dict(zip(_RESULT.names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in _RESULT.names}, _RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(documents: DataFrame, length: int = 100, lead: int = 32) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and kept (the bytes that stay).

    Null texts are empty; texts shorter than ``length`` keep every byte.  A null
    doc_id comes before all others.  Rows that share a doc_id and differ in text
    are documents of their own, in the order of a hash of the text; rows that
    repeat both are one document and get the same result.  Other columns of
    ``documents`` are not looked at.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), order_id("doc_id").alias("doc"), content_key("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(texts.select("doc", "hash", "text"), length, lead)
    per_doc = spans.groupBy("doc", "hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(per_doc.hint("shuffle_hash"), ["doc", "hash"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
