from gleaner.config import EngineConfig
from gleaner.operators import manifest, ranking, telemetry

COLUMNS = "id long, group_id long, score double, sharpness double, focus double, is_raw boolean, area long, size long, path string"


def winner(spark, *rows):
    got = ranking.winners(spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], COLUMNS)).first()
    return got.winner, got.by_raw


def test_winners(spark):
    assert winner(spark, (1.0, 1.0, 1.0, False, 1, 1, "a"), (1.0, 1.0, 1.0, True, 1, 1, "b")) == (1, True)
    assert winner(spark, (0.55, 0.5, 1.0, True, 1, 1, "a"), (0.95, 1.0, 1.0, False, 1, 1, "b")) == (1, False)
    assert winner(spark, (5.0, 1.0, 1.0, False, 1, 100, "a"), (5.0, 1.0, 1.0, False, 1, 200, "b")) == (1, False)
    assert winner(spark, (1.0, 1.0, 1.0, True, 9, 1, "a"), (1.0, 1.0, 1.0, True, 4, 5, "b")) == (0, True)
    assert winner(spark, (1.0, 0.0, 1.0, True, 1, 1, "a"), (1.0, 0.0, 1.0, False, 1, 1, "b")) == (1, False)  # nothing is sharp
    assert winner(spark, (1.0, 1.0, 1.0, True, 1, 1, "d/a"), (1.0, 1.0, 1.0, True, 1, 1, "d.jpg")) == (1, True)  # paths by component


def test_scene_weights(spark):
    columns = "id long, group_id long, expression double, face double, sharpness double, exposure double, vibrancy double, dynamic_range double, focus double, blur double"
    rows = spark.createDataFrame([(0, 0, 100.0, 100.0, 20.0, 0.3, 0.2, 0.2, 1.0, 1.0), (1, 0, 5.0, 5.0, 100.0, 1.0, 1.0, 1.0, 1.0, 1.0)], columns)
    wide = {r.id: r.score for r in ranking.normalise(rows, "landscape").collect()}
    face = {r.id: r.score for r in ranking.normalise(rows, "portrait").collect()}
    assert wide[1] > wide[0] and face[0] > wide[0]
    assert [r.id for r in ranking.ranking(ranking.normalise(rows, "landscape")).orderBy("place").collect()] == [1, 0]


def test_manifest_and_names(spark, tmp_path):
    records = spark.createDataFrame([(i, f"f/{'ab'[i % 2]}.jpg") for i in range(5)], "id long, path string")
    groups = spark.createDataFrame([(0, 0), (2, 0)], "id long, group_id long")
    winners = spark.createDataFrame([(0, 2)], "group_id long, winner long")
    placed = manifest.outcomes(records, groups, winners)
    assert {r.id: r.outcome for r in placed.collect()} == {0: "rejected", 2: "kept", 1: "unique", 3: "unique", 4: "unique"}
    assert tuple(manifest.summary(placed).first()) == (5, 1, 4, 1, 3)
    assert tuple(manifest.summary(placed.limit(0)).first()) == (0, 0, 0, 0, 0)
    from pyspark.sql import functions as F

    named = manifest.destination_names(placed.withColumns({"destination": F.lit("x"), "name": F.element_at(F.split("path", "/"), -1)}), "name", "id")
    assert sorted(r.file_name for r in named.collect()) == ["a (2).jpg", "a (3).jpg", "a.jpg", "b (2).jpg", "b.jpg"]
    mixed = spark.createDataFrame([(i, "x", n) for i, n in enumerate(["a.jpg", "a.jpg", "a (2).jpg", "a.jpg", "a (2).jpg", ".hidden", ".hidden", "b.tar.gz", "b.tar.gz", "c.", "c.", None])], "id long, destination string, name string")
    got = {r.id: r.file_name for r in manifest.destination_names(mixed, "name", "id").collect()}
    assert [got[i] for i in range(11)] == ["a.jpg", "a (2).jpg", "a (2) (2).jpg", "a (3).jpg", "a (2) (3).jpg", ".hidden", ".hidden (2)", "b.tar.gz", "b.tar (2).gz", "c.", "c (2)."] and got[11] is None
    manifest.write_manifest(placed, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").where("outcome = 'kept'").count() == 1


def test_files_are_placed_under_free_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.jpg", "b.jpg"):
        (tmp_path / "in" / n).write_text(n)
    (tmp_path / "out/Images-Good").mkdir(parents=True)
    (tmp_path / "out/Images-Good/a.jpg").write_text("old")
    rows = spark.createDataFrame([(f"{tmp_path}/in/a.jpg", "kept"), (f"{tmp_path}/in/b.jpg", "rejected"), (f"{tmp_path}/in/none.jpg", "unique")], "path string, outcome string")
    done = manifest.place_files(rows, f"{tmp_path}/out")
    assert (tmp_path / "out/Images-Good/a (2).jpg").read_text() == "a.jpg" and (tmp_path / "out/Rejected/b.jpg").exists() and (tmp_path / "in/a.jpg").exists()
    assert [e is None for *_, e in done] == [True, True, False]
    manifest.place_file(f"{tmp_path}/in/b.jpg", f"{tmp_path}/moved", "move")
    assert not (tmp_path / "in/b.jpg").exists()


def test_telemetry_round_trip(spark, tmp_path):
    records = spark.createDataFrame([(1, "d/a.jpg", "ab" * 32, 255, None, 0, 10, 1.0), (2, "d/b.jpg", "cd" * 32, None, None, None, 20, 2.0)], "id long, path string, content_hash string, h1 long, h2 long, group_id long, size long, score double")
    parts = [telemetry.run_record(spark, "r1", EngineConfig(), 2, "/d/shoot"), telemetry.image_records(records, "r1")]
    telemetry.write_lines(parts, f"{tmp_path}/t")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert any('"folder":"shoot"' in x and '"hammingThreshold":7' in x for x in lines) and any('"path":"d/a.jpg"' in x and '"extension":"jpg"' in x for x in lines)
    assert len(lines) == 3 and any('"phash":"00000000000000ff"' in x for x in lines) and any('"groupIndex":null' in x for x in lines)
    assert telemetry.read_lines(spark, f"{tmp_path}/t", "image", "imageId long, fileName string").orderBy("imageId").first().fileName == "a.jpg"
    members = spark.createDataFrame([(0, 1, 'a,"b".jpg'), (0, 2, "c.jpg")], "group_id long, id long, file_name string")
    sheet = telemetry.label_sheet(members, spark.createDataFrame([(0, 1)], "group_id long, winner long"))
    telemetry.write_sheet(sheet, f"{tmp_path}/s")
    back = telemetry.read_sheet(spark, f"{tmp_path}/s")
    assert back.first().files == ['a,"b".jpg', "c.jpg"] and back.first().picked == 'a,"b".jpg'
    from pyspark.sql import functions as F

    assert tuple(telemetry.agreement(back.withColumn("your_pick", F.lit("c.jpg"))).first()) == (1, 0)
    names = spark.createDataFrame([(f"run-{i:02}.jsonl",) for i in range(25)] + [("other.txt",)], "name string")
    assert sorted(r.name for r in telemetry.to_prune(names).collect()) == [f"run-{i:02}.jsonl" for i in range(6)]
