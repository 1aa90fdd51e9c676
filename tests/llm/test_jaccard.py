import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from gleaner.llm import jaccard
from gleaner.llm.shingles import shingle_set, windows, word_hashes

SCHEMA = "text string, doc_id long, component_id int"


def plain(rows, width, percent):
    sets = []
    for text, doc, _ in rows:
        words = [w.lower() for w in (text or "").split()]
        if not words:
            sets.append(set())
        else:
            k = min(width, len(words))
            sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (_, doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least.get(root(i)) if s else doc) for i, ((_, doc, _), s) in enumerate(zip(rows, sets)) if doc is not None)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.sample(words, 30)
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not base:
            text = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 7, 9, 12, 15, 17, 30, 60, 200]))]
            if rng.random() < 0.5:
                at = rng.randrange(len(text) + 1)
                text[at:at] = passage
            base.append(text)
        else:
            text = list(rng.choice(base))
            for _ in range(rng.randint(0, 1 + len(text) // 25)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
        rows.append((" ".join(text).replace("w1", "W1"), i * 3, None))
    return rows + [(None, 9001, None), ("", 9002, None), ("  \n", 9003, None), (rows[4][0], 9004, None), (rows[4][0], 9004, 1), (rows[4][0], None, 1)]


@pytest.mark.parametrize("width,percent,limit,boundary", [(4, 85, 4_000_000, None), (5, 80, 600, None), (3, 60, 4_000_000, 12), (4, 85, 900, 1)])
def test_matches_brute_force(spark, width, percent, limit, boundary):
    rows = corpus(width + percent, 320)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = jaccard.link_components(docs, width, percent, cluster_shingles=limit, shingles_per_range=2_000, boundary=boundary).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == plain(rows, width, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85, 95):
        for boundary in (1, 8, 14):
            for _ in range(150):
                n = int(rng.integers(1, 90))
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                b = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.15])]
                b = np.unique(np.concatenate((b, rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64))))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
                    continue
                heavy = np.sort(rng.choice(a, len(a) * int(rng.integers(0, 4)) // 3, replace=False))
                x, y = (jaccard.signatures(s, percent, boundary, heavy) for s in (a, b))
                assert len(np.intersect1d(x, y)), (percent, boundary, len(a), len(b), both)


def test_words_and_shingles():
    assert len(word_hashes(b" a\tb\x0bC  c\n")) == 4
    a, b = word_hashes("É x".encode()), word_hashes("é X".encode())
    assert a[0] != b[0] and a[1] == b[1]
    assert len(windows(word_hashes(b"a b"), 4)) == 1 and not len(shingle_set(b" ", 4))
    assert len(shingle_set(b"a b c d a b c d a b c d", 4)) == 4


def test_boundary_follows_the_cost():
    assert jaccard.choose_boundary(85, {12: 1000}, scan=1000) >= 12
    assert jaccard.choose_boundary(85, {20: 1000}, scan=0.001) < 20


def test_empty_table(spark):
    assert jaccard.link_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_groups_of_copies_are_spread(spark):
    texts = ["a b c d e f g h i j"] * 700 + ["a b c d e f g h i k"] * 2 + [f"x{i} y{i} z{i} u{i} v{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, digest int, class int").repartition(6)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.link_components(docs, percent=70).collect()}
    assert got == {i: (0, 7) for i in range(702)} | {i: (i, 2) for i in range(702, 762)}
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(900)], "k int, v int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    plain = sorted(map(tuple, rows.join(table.drop("n"), "k").collect()))
    for share in (2, 5, 1000):
        assert sorted(map(tuple, jaccard._join_hot(rows, table, "k", "n", share).collect())) == plain


def test_clashing_columns_of_kept_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, 6, 7), (2, "a b c d e f g", 5, 6, 7)], "doc_id long, text string, _doc int, _hash int, hash int")
    got = jaccard.keep_one_of_each(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f g", 5, 6, 7)]
