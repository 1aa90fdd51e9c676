import random
import zlib
from collections import Counter, defaultdict

import pytest

from gleaner.llm import sharding

SCHEMA = "doc_id long, source string, text string, shard string, part int"


@pytest.mark.parametrize("per_range", [1_000_000, 60])
def test_every_shard_matches_the_mixture(spark, per_range):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "="]), "é" * rng.randint(0, 9), "x", 1) for i in range(995)]
    rows += [(7, "a", None, "x", 1), (7, "a", None, "x", 1), (None, "b", "", "x", 1), (4, "b", "t", "x", 1), (5, "", "t", "x", 1)]
    got = sharding.interleave(spark.createDataFrame(rows, SCHEMA).repartition(4), 8, rows_per_range=per_range).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, _, t, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(125)) for s in slots.values())
    source = {d: s for d, s, *_ in rows[:995]}
    mixture = Counter(source[r.doc_id] for r in got if r.doc_id in source)
    for shard in range(8):
        here = Counter(source[r.doc_id] for r in got if r.doc_id in source and r.shard == shard)
        assert all(abs(here[s] - n / 8) <= 3 for s, n in mixture.items())


def test_same_rows_same_shards_whatever_the_partitions(spark):
    rows = [(i, "s%d" % (i % 3), "t" * (i % 5), "", 0) for i in range(300)]
    one = sharding.interleave(spark.createDataFrame(rows, SCHEMA).coalesce(1), 7).collect()
    two = sharding.interleave(spark.createDataFrame(rows[::-1], SCHEMA).repartition(9), 7, rows_per_range=40).collect()
    assert sorted(map(tuple, ((r.doc_id, r.shard, r.slot) for r in one))) == sorted(map(tuple, ((r.doc_id, r.shard, r.slot) for r in two)))


def test_few_rows_and_none(spark):
    rows = [(1, "a", "x", "", 0), (2, "b", "y", "", 0)]
    assert sorted(r.slot for r in sharding.interleave(spark.createDataFrame(rows, SCHEMA), 40).collect()) == [0, 0]
    assert sharding.interleave(spark.createDataFrame([], SCHEMA)).collect() == []
