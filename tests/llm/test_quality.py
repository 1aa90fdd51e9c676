import random
import zlib

import numpy as np

from gleaner.llm import quality


def texts(n, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(8, 120))]
        if not good:
            kind = i % 3
            words = [w + "###" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:5] for _ in range(12)]
        out.append((i, " ".join(words), int(good)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(t, i, "x", 3.0) for i, t, _ in rows], "text string, doc_id long, quality string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q, 0, "k") for i, _, q in rows], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = texts(900)
    got = {r.doc_id: r for r in quality.score_quality(*frames(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _, _ in held}
    assert np.mean([got[i].predicted == q for i, _, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = texts(300)
    other = [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, t, q in rows]
    one, two = (sorted((r.doc_id, r.score) for r in quality.score_quality(*frames(spark, x)).collect()) for x in (rows, other))
    assert one == two


def test_odd_rows(spark):
    rows = texts(60)
    docs, labels = frames(spark, rows)
    odd = spark.createDataFrame([(None, 1000, "", 0.0), ("", 1001, "", 0.0), ("a " * 100_000, 1002, "", 0.0), (rows[0][1], 0, "", 0.0), ("x", None, "", 0.0)], docs.schema)
    more = labels.union(spark.createDataFrame([(None, 1, 0, ""), (5, None, 0, ""), (6, 7, 0, "")], labels.schema))
    got = quality.score_quality(docs.union(odd), more).collect()
    assert len(got) == 65 and len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.score_quality(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_keep_good_keeps_columns_and_rows(spark):
    docs, labels = frames(spark, texts(300))
    kept = quality.keep_good(docs, labels)
    want = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_sample_bounds_the_fit(spark):
    docs, labels = frames(spark, texts(300))
    assert quality.train(docs, labels, sample=40).weights.any()


def test_measures_of_any_bytes():
    for text in (b"", b" ", b"\n\n", "é ü".encode(), b"a" * 10_000, b"a\x00b \xff", b"x\n" * 50):
        m = quality.measures(text)
        assert np.isfinite(m).all()


def test_repeated_ids_do_not_grow_the_fit(spark):
    rows = texts(200)
    docs, labels = frames(spark, rows)
    again = docs.where("doc_id < 20")
    for _ in range(4):
        again = again.union(again)
    one, two = quality.train(docs, labels), quality.train(docs.union(again).repartition(5), labels)
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut


def test_fit_against_a_plain_search():
    """Better texts rank above worse ones, and no other cut makes fewer errors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, len(quality.NAMES)))
    label = (x[:, 0] - x[:, 1] + rng.normal(size=80) > 0).astype(float)
    got = quality.fit(x, label, 0.3)
    scores = got.scores(x)
    wins = [(a > b) + (a == b) / 2 for a in scores[label == 1] for b in scores[label == 0]]
    assert np.mean(wins) > 0.9
    errors = lambda cut: int(((scores >= cut) != (label == 1)).sum())
    assert errors(0.3) == min(errors(c) for c in [*scores, 0.0, 1.1])


def test_scores_are_those_of_each_text_alone(spark):
    rows = texts(150)
    docs, labels = frames(spark, rows)
    ranking = quality.train(docs, labels)
    want = {i: float(ranking.scores(quality.measures(t.encode())[None])[0]) for i, t, _ in rows}
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
