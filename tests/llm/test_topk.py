import random
from math import floor

from gleaner.llm import topk

from . import brute

SCHEMA = "vec_id long, embedding array<float>, query_id int, score string"


def check(spark, rows, **given):
    got = topk.nearest(spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).repartition(5), **given).collect()
    want = brute.nearest([(i, spark_floats(e)) for i, e in rows], given.get("every", 100), given.get("k", 10))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def spark_floats(e):
    import numpy as np

    return e if e is None else [None if x is None else float(np.float32(x)) for x in e]


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]  # ties
    check(spark, rows, every=50, block=6)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0, -1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0]), (100, [1.0, 1.0, 1.0])]
    check(spark, rows, k=3)


def test_large_components(spark):
    rows = [(i, [float(i + 1) * 1e4, -float(i * i), 7.0]) for i in range(120)]
    check(spark, rows, every=40, k=4)


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0])]
    got = topk.nearest(spark.createDataFrame([(i, e, 1, "") for i, e in rows], SCHEMA), k=2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2048 * 1024), (2, 2, 512 * 1024)]


def test_several_vectors_of_one_id(spark):
    # Each of an id's rows is best in another list, but none on the whole.
    rng = random.Random(8)
    rows = [(0, [1.0] * 8)] + [(1, [5.0, 5.0, -9.0, -9.0, -9.0, -9.0, -9.0, -9.0]), (1, [-9.0, -9.0, -9.0, -9.0, -9.0, -9.0, 5.0, 5.0])] * 3
    rows += [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(2, 60)]
    got = topk.nearest(spark.createDataFrame([(i, e, 1, "") for i, e in rows], SCHEMA).repartition(3), k=10).collect()
    score = lambda e: sum(int(floor(1024 * x)) for x in spark_floats(e)) * 1024
    best = {}
    for i, e in rows[1:]:
        best[i] = max(best.get(i, -(10**18)), score(e))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_vectors_shorter_than_the_lists(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 5):
        check(spark, [(i, [rng.gauss(0, 1) for _ in range(n)]) for i in range(150)], every=50)


def test_empty_table(spark):
    assert topk.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
