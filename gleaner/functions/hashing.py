"""64-bit hashes of records and their distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ; null if either is."""
    return F.bit_count(a.bitwiseXOR(b))


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def from_hex16(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(content_hash: Column) -> Column:
    return F.substring(content_hash, 1, 16)


def bits(flags: list[Column]) -> Column:
    """A long whose bit i is flags[i]."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(f, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i, f in enumerate(flags)))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((batch.num_rows, 2), np.int64)
        none = np.ones(batch.num_rows, bool)
        for row, text in enumerate(batch.column("text").to_pylist()):
            words = set((text or "").split(" ")) - {""}
            if words:
                digests = b"".join([hashlib.md5(w.encode()).digest() for w in words])
                ones = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
                out[row] = np.packbits(2 * ones > len(words)).view(">i8")
                none[row] = False
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out[:, 0], mask=none), pa.array(out[:, 1], mask=none)], [*(c for c in batch.schema.names if c != "text"), "h1", "h2"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, h1, h2): word votes over two independent 64-bit word
    hashes; texts without words have null hashes."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "text")
    out = rows.mapInArrow(_vote, "doc_id long, n_chars long, h1 long, h2 long")
    return out
