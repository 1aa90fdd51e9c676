import random

import pytest

from gleaner.llm import substrings

from . import brute

SCHEMA = "doc_id long, text string, lo long"


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcde é") for _ in range(rng.randint(20, 300))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts.append(p[a:b] if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(30)))
        rows.append((i, "".join(parts), 7))
    rows += [(100, "ab" * 400, 7), (101, "q" * 500, 7), (102, rows[3][1], 7), (103, "", 7), (104, None, 7)]
    return rows


@pytest.mark.parametrize("length,lead,ranges", [(100, 32, 700_000), (40, 8, 50), (30, 30, 9)])
def test_matches_brute_force(spark, length, lead, ranges):
    rows = corpus(length)
    want = brute.repeats([(d, (t or "").encode()) for d, t, _ in rows], length)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    from pyspark.sql import functions as F

    texts = docs.select("doc_id", F.col("doc_id").alias("doc"), substrings.content_key("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = substrings.repeated_spans(texts.select("doc", "hash", "text"), length, lead, ranges)
    got = {}
    by = {}
    for r in spans.collect():
        by.setdefault(r.doc, []).append((r.lo, r.hi))
    for d, t, _ in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for lo, hi in by.get(d, []):
            gone[lo:hi] = b"\1" * (hi - lo)
        got[d] = sum(gone)
    assert got == {d: w[1] for d, w in want.items()}


def test_whole_result(spark):
    rows = corpus(7)
    want = brute.repeats([(d, (t or "").encode()) for d, t, _ in rows], 100)
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert any(w[1] for w in want.values())


def test_long_text_is_cut_into_tiles(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "TILE", 512)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    key, span, start, count = substrings.runs_of(data, 100, 32)
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == 5000 - 99


def test_repeated_rows_and_missing_ids(spark):
    text = "abcdefghij" * 3 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, text, 0), (1, text, 0), (None, text, 0), (2, text + "!", 0)]
    got = sorted((r.doc_id or 0, r.n_removed, r.n_bytes) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    n = len(text)
    assert got == [(0, 0, n), (1, n, n), (1, n, n), (2, n, n + 1)]


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
