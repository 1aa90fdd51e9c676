import random
import sys

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

from gleaner.llm import jaccard, packed  # noqa: E402
from gleaner.operators import graph  # noqa: E402


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 30)) for _ in range(60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {x: 100 for e in edges for x in e if 100 <= x < 200} | {200: 200, 201: 200}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_packed_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64)), rng.integers(0, 9, 7).astype(np.uint16), np.empty(0, np.int64)]
    for got, want in zip(packed.unpack(packed.pack(columns, ascending=0)), columns, strict=True):
        assert got.dtype == want.dtype and (got == want).all()
    keys = [rng.integers(0, 3, 200).astype(np.uint64) for _ in range(4)]
    order = packed.multikey_order(keys)
    rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert rows == sorted(rows)
    heads, tails = packed.choose_splitters(keys[0], keys[1], 5)
    where = packed.bucket_of((heads, tails), keys[0], keys[1])
    pairs = list(zip(heads.tolist(), tails.tolist(), strict=True))
    assert where.tolist() == [sum(p <= (a, b) for p in pairs) for a, b in zip(keys[0].tolist(), keys[1].tolist(), strict=True)]


def test_keep_one_of_each(spark):
    words = [f"w{i}" for i in range(40)]
    near = " ".join(words[:39] + ["other"])
    rows = [(" ".join(words), 5, 1), (near, 3, 1), (near, 3, 1), ("", 8, 1), (None, 9, 1), ("", 8, 1), ("alone in here", None, 1), ("alone in here", None, 1), (near, None, 1)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, hash int")
    got = sorted(((r.doc_id or 0), r.text or "") for r in jaccard.keep_one_of_each(docs).collect())
    assert got == [(0, "alone in here"), (3, near), (8, ""), (8, ""), (9, "")]
    assert jaccard.keep_one_of_each(docs.limit(0)).collect() == []


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = " ".join(w + "%%%" for w in text(60).split()) if bad else text(60)
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not bad), 0))
    rows.append((1000, rows[1][1] + " end", "en", "s", 0))
    rows.append((1001, f"{text(20)} {item} {text(20)}", "en", "s", 0))
    rows.append((1002, f"{text(40)} a.b@mail.example.com {text(9)}", "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 3:
            assert not docs.where("text like '%@%'").count()
    good = {i for i, t, *_ in rows if "%%%" not in t}
    assert kept[0] == good and kept[1] == good - {1000} and kept[2] == kept[3] == kept[4] == good - {1000, 1001}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_library_stands_without_the_subpackage():
    import __spark_entry__ as entry

    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in entry.queries() if k.startswith(("op", "pipeline")) and (k == "pipeline" or k[2].isdigit())}
    assert "gleaner.llm" in sys.modules
