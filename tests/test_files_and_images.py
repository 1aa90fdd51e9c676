import struct
import zlib

import numpy as np
import pytest

from gleaner.config import EngineConfig, Profile, Scene, Strength
from gleaner.functions import pixels
from gleaner.operators import cache, dedupe, editplan, eventlog, manifest
from gleaner.sources import files


def png(path, rgb):
    """Writes an 8-bit RGB image."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def grid(n, f):
    y, x = np.mgrid[:n, :n]
    return np.repeat(np.asarray(f(x, y)) * np.ones((n, n)), 1).reshape(n, n)[..., None].repeat(3, 2).astype(np.uint8)


FLAT, CHECKER = grid(64, lambda x, y: 128), grid(64, lambda x, y: (x + y) % 2 * 255)
GOOD, OVER = grid(64, lambda x, y: (4 * x + 3 * y) % 200 + 28), grid(64, lambda x, y: 251)


def test_features_order_images():
    g = pixels.grey
    assert pixels.sharpness(g(CHECKER)) > pixels.sharpness(g(FLAT)) == 0
    assert pixels.exposure(g(GOOD)) > pixels.exposure(g(OVER))
    assert pixels.dynamic_range(g(GOOD))[0] > 0.3 and pixels.vibrancy(FLAT) < 0.1
    assert pixels.dynamic_range(g(FLAT))[2:] == (127, 127) and pixels.dynamic_range(np.zeros((9, 9), np.uint8))[2:] == (0, 255)
    assert pixels.features(FLAT)["blur"] < 0.5
    skin = grid(240, lambda x, y: 0)
    skin[:, :80], skin[:, 80:] = (200, 140, 110), (20, 120, 30)
    (x, _, w, _), why = pixels.subject_box(skin)
    assert x + w / 2 < 120 and why["score"] > 0.08 and why["skin"] > 0.8 and not why["fallback"]
    box, why = pixels.subject_box(FLAT[:16, :20])
    assert box == (6, 2, 8, 8) and why["fallback"] and why["score"] == 0.0
    assert pixels.fallback_box(100, 50) == (30, 9, 40, 20)


def test_limits_of_regions():
    checker = grid(64, lambda x, y: (x // 2 + y // 2) % 2 * 200)[..., 0]
    assert [pixels.centre(checker[:a, :b]).shape for a, b in ((64, 64), (10, 12), (6, 64))] == [(32, 32), (8, 8), (6, 32)]
    assert pixels.gradient(checker[:3]) == 0.0 < pixels.gradient(checker[:4])
    assert pixels.border(checker) > 0 and pixels.regions(checker[:2, :2]) == [0.0] * 9
    only_centre = np.full((64, 64), 128, np.uint8)
    only_centre[24:40, 24:40] = checker[24:40, 24:40]
    assert pixels.border(only_centre) == 0.0 and pixels.regions(only_centre)[4] == max(pixels.regions(only_centre)) > 0


def test_details():
    found = pixels.details(GOOD)
    assert len(found) == 38 and len(found["regionSharpness"]) == 9 and abs(sum(found["frameLuma"]["histogram16"]) - 1) < 1e-9
    assert found["sharpnessMinRegion"] <= found["sharpnessTop3"] <= found["sharpnessMaxRegion"]
    land, face = pixels.features(GOOD, scene="landscape"), pixels.features(GOOD)
    assert land["blur"] == found["blurConfidenceGlobal"] and face["blur"] == found["blurConfidencePortrait"] and face["exposure"] == found["exposurePortrait"]
    assert pixels.features(GOOD, faces=False)["face"] == 0.0


def test_hashes():
    g = pixels.grey
    other = grid(64, lambda x, y: 255 - (4 * x + 3 * y) % 200)
    assert pixels.phash(g(GOOD)) == pixels.phash(g(GOOD.copy())) != pixels.phash(g(other))
    assert pixels.dhash(g(GOOD)) != pixels.dhash(g(other))
    slope = g(grid(64, lambda x, y: 255 - 4 * x))
    assert pixels.dhash(slope) == -1  # every pixel above its right neighbour
    assert pixels.shrunk(GOOD, 32).shape == (32, 32, 3) and pixels.shrunk(GOOD, 512) is GOOD
    assert (pixels.stretched(g(FLAT)) == g(FLAT)).all() and pixels.stretched(g(GOOD)).max() == 255


def test_run_over_a_folder(spark, tmp_path):
    for name, image in (("a.png", GOOD), ("b.png", GOOD), ("c.png", CHECKER), ("skip.txt", None), ("bad.png", None), ("Images-Good/d.png", GOOD), ("sub/UP.PNG", FLAT)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        png(tmp_path / name, image) if image is not None else (tmp_path / name).write_bytes(b"no image")
    found = files.scan(spark, str(tmp_path))
    name = lambda p: p.split(f"{tmp_path}/")[1]
    assert sorted(name(r.path) for r in found.collect()) == ["a.png", "b.png", "bad.png", "c.png", "sub/UP.PNG"]
    assert files.scan(spark, str(tmp_path), subfolders=False).count() == 4
    content = files.hashed(files.scan(spark, str(tmp_path), content=True))
    assert files.valid(content).count() == 5 and files.failed(content).count() == 0
    ids = {name(r.path): r.image_id for r in files.numbered(found).collect()}
    assert sorted(ids.values()) == list(range(5)) and ids["a.png"] < ids["b.png"] < ids["sub/UP.PNG"]
    got = {name(r.path): r for r in pixels.measured(files.images(spark, str(tmp_path))).collect() if r.path.lower().endswith("png")}
    assert got["a.png"].h1 == got["b.png"].h1 != got["c.png"].h1 and got["a.png"].preview_w == 64
    assert got["bad.png"].h1 is None and got["bad.png"].error and got["bad.png"].sharpness == 0
    want = pixels.features(GOOD)
    assert all(abs(got["a.png"][f] - want[f]) < 1e-9 for f in pixels.FEATURES)


def test_embedded_jpegs(spark, tmp_path):
    small, large = b"\xff\xd8" + b"s" * 130 + b"\xff\xd9", b"\xff\xd8" + b"l" * 900 + b"\xff\xd9"
    assert files.largest_jpeg(b"\0" * 100 + small + large + b"abc") == large
    assert files.largest_jpeg(b"\xff\xd8tiny\xff\xd9") is None and files.largest_jpeg(small[:-2]) is None
    (tmp_path / "x.arw").write_bytes(b"\0" * 100 + large + b"abc")
    rows = files.embedded_previews(files.scan(spark, str(tmp_path), content=True)).collect()
    assert [bytes(r.preview) for r in rows] == [large]
    huge = b"\xff\xd8" + b"h" * 40_000 + b"\xff\xd9"
    assert files.raw_preview(huge, lambda _: b"converted") == huge and files.raw_preview(large, lambda _: b"converted") == b"converted"
    assert files.raw_preview(large, lambda _: None) == large and files.raw_preview(b"none") is None and files.raw_preview(None) is None


def test_a_raw_file_is_seen_by_its_preview(spark, tmp_path):
    jpeg = spark._jvm.java.io.ByteArrayOutputStream()
    image = spark._jvm.java.awt.image.BufferedImage(48, 40, 1)
    for i in range(48):
        image.setRGB(i, i % 40, 0xFFFFFF)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", jpeg)
    (tmp_path / "x.ARW").write_bytes(b"\0" * 100 + bytes(jpeg.toByteArray()) + b"abc")
    (tmp_path / "y.nef").write_bytes(b"nothing")
    (tmp_path / "z.webp").write_bytes(b"nothing")
    (tmp_path / "Rejected").mkdir()
    png(tmp_path / "Rejected" / "old.png", FLAT)
    rows = {r.path.rsplit("/", 1)[1]: r for r in pixels.measured(files.images(spark, str(tmp_path)), trail=True).collect()}
    assert set(rows) == {"x.ARW", "y.nef", "z.webp"} and (rows["x.ARW"].preview_w, rows["x.ARW"].preview_h) == (48, 40) and rows["x.ARW"].diagnostics.width == 48
    assert rows["y.nef"].error == "no embedded preview" and rows["z.webp"].error == "no decoder" and rows["y.nef"].diagnostics is None


def test_a_whole_run(spark, tmp_path):
    near = np.clip(GOOD.astype(int) + np.random.default_rng(1).integers(0, 3, GOOD.shape), 0, 255)
    for name, image in (("a.png", GOOD), ("b.png", GOOD), ("sub/c.png", near), ("d.png", CHECKER), ("e.png", grid(64, lambda x, y: 255 - 3 * x))):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        png(tmp_path / "in" / name, image)
    (tmp_path / "in" / "bad.png").write_bytes(b"x")
    cfg = EngineConfig(telemetry=True, enable_ai_features=True, use_ai_for_dedup=True)
    found = dedupe.run(spark, str(tmp_path / "in"), cfg)
    names = {r.path.rsplit("/", 1)[1]: r for r in found.placements.collect()}
    assert {n for n, r in names.items() if r.group_id is not None} == {"a.png", "b.png", "c.png"} and sorted(r.outcome for r in names.values()) == ["kept", "rejected", "rejected", "unique", "unique", "unique"]
    assert tuple(found.summary.first()) == (6, 1, 4, 2, 3, 0) and names["bad.png"].decode_error and names["bad.png"].raw_score == 0.0
    lines = [r.line for part in found.telemetry() for r in part.collect()]
    assert len(lines) == 1 + 6 + 1 + 6 + 1 and sum('"roiUsedFallback"' in x for x in lines) == 5 and found.label_sheet().count() == 1
    done = manifest.place_files(found.placements, f"{tmp_path}/out")
    assert len(list((tmp_path / "out/Images-Good").iterdir())) == 4 and len(list((tmp_path / "out/Rejected").iterdir())) == 2 and all(e is None for *_, e in done)
    other = next(r.id for n, r in names.items() if r.outcome == "rejected")
    again = dedupe.run(spark, str(tmp_path / "in"), cfg, memo=found.memo, reranker=lambda members, winners: winners.selectExpr("group_id", f"{other}L AS ai_winner"))
    assert again.summary.first().ai_reranked == 1 and {r.id: r.outcome for r in again.placements.collect()}[other] == "kept"
    assert [tuple(r) for r in dedupe.asks_again(again.members, True).collect()] == [(0,)]
    (tmp_path / "none").mkdir()
    assert tuple(dedupe.run(spark, str(tmp_path / "none")).summary.first()) == (0, 0, 0, 0, 0, 0)


def test_logs_are_set_aside_and_cleared(spark, tmp_path):
    from pyspark.sql import functions as F

    log = tmp_path / "app.log"
    for n in range(7):
        log.write_text(f"{n}" * 100)
        assert eventlog.rotate(tmp_path, "app.log", 100) and not log.exists()
    assert sorted(f.name for f in tmp_path.iterdir()) == [f"app.log.{i}" for i in range(1, 5)] and (tmp_path / "app.log.1").read_text()[0] == "6"
    log.write_text("x")
    (tmp_path / "other").write_text("x")
    assert not eventlog.rotate(tmp_path, "app.log", 100) and eventlog.clear(tmp_path, "app.log") == 5 and (tmp_path / "other").exists()
    row = spark.range(1).select(eventlog.event(*[F.lit(x) for x in ("info", "dedupe", "ui", "scan", "start", "hello")], run_id=F.lit("r")).alias("e")).first().e
    assert row.level == "info" and row.run_id == "r" and row.error_code is None and row.timestamp is not None
    levels = spark.createDataFrame([("DEBUG",), ("debug",), (" warn",), ("error",), (None,)], "l string").select(eventlog.level(F.col("l")).alias("l"))
    assert [r.l for r in levels.collect()] == ["info", "debug", "info", "error", "info"]
    said = spark.range(1).select(eventlog.redacted(F.lit("see https://h/a/b and /tmp/x,y")).alias("m")).first().m
    assert said == "see https://h/a/b and [path],y"


def test_prompts(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(editplan.candidate_line(F.lit("a.jpg"), sharpness=F.lit(1), focus=F.lit(0.12345)).alias("l"), editplan.as_base64(F.lit(b"x" * 100)).alias("b"), editplan.generated(F.lit('{"response": " a "}')).alias("g"), editplan.chat_reply(F.lit("{")).alias("c")).first()
    assert row.l == "- a.jpg: sharpness=1.000, focus=0.123" and "\n" not in row.b and row.g == "a" and row.c is None


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"duplicateStrength": "strict", "unknown": 1, "ollamaTemperature": 1}')
    old = EngineConfig.load(path)
    assert old.threshold == 3 and old.profile is Profile.MEDIUM and old.scene is Scene.PORTRAIT
    EngineConfig(strength=Strength.LOOSE, keep_runs=3).save(path)
    assert EngineConfig.load(path) == EngineConfig(strength=Strength.LOOSE, keep_runs=3)
    assert '"duplicateStrength": "loose"' in path.read_text() and list(old.snapshot()) == ["sceneMode", "perfProfile", "duplicateStrength", "fileAction", "includeSubfolders", "enableAiFeatures", "useAiForDedup", "ollamaModel", "ollamaTemperature"]
    path.write_text("{")
    assert EngineConfig.load(path) == EngineConfig() == EngineConfig.load(tmp_path / "none")
    assert Profile.LOW.threads(8) == 2 and Profile.MEDIUM.threads(8) == 6 and not Profile.LOW.confirm and Profile.HIGH.max_edge == 1024


def test_memo(spark, tmp_path):
    assert cache.load(spark, f"{tmp_path}/none").count() == 0
    memo = spark.createDataFrame([("a", 1, 10, "h", 1, 2)], cache.SCHEMA)
    new = spark.createDataFrame([("a", 2, 11, "i", 3, 4), ("a", 2, 12, "j", 3, 4), ("b", 1, 1, "k", 5, 6)], cache.SCHEMA)
    cache.save(cache.upsert(memo, new), f"{tmp_path}/m")
    back = cache.load(spark, f"{tmp_path}/m")
    assert {(r.path, r.content_hash) for r in back.collect()} == {("a", "j"), ("b", "k")}
    now = spark.createDataFrame([("a", 2, 12), ("b", 1, 2)], "path string, size long, mtime_secs long")
    assert {(r.path, r.content_hash) for r in cache.look_up(now, back).collect()} == {("a", "j"), ("b", None)}
    assert [r.path for r in cache.misses(now, back).collect()] == ["b"]
    cache.clear(spark, f"{tmp_path}/m")
    assert cache.load(spark, f"{tmp_path}/m").count() == 0


def test_plans_and_chats(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    row = one.select(editplan.plan().alias("p"), editplan.sees_images(F.lit("LLaVA:7b")).alias("v"), editplan.sees_images(F.lit("qwen2.5vl:7b"), F.lit('["completion"]')).alias("w"), editplan.sees_images(F.lit("x"), F.lit('["vision"]')).alias("x")).first()
    assert row.p.settings["SharpenRadius"] == 1.0 and row.p.settings["SharpenEdgeMasking"] == 80.0 and row.p.settings["PostCropVignetteAmount"] == -20.0 and row.p.settings["PostCropVignetteStyle"] == 1.0
    assert row.p.texts == {"WhiteBalance": "Auto"} and row.p.subject_blur_strength == "medium" and len(row.p.warnings) == 1 and "LuminanceSmoothing" not in row.p.settings and row.v and row.w and row.x
    off = one.select(editplan.plan(eye_sharpen=False, vignette=False, subject_blur=False, optimal_crop=False, white_balance=False, color_tone=False, exposure_normalize=F.lit(None)).alias("p")).first().p
    assert off.settings == {} and off.texts == {} and off.subject_blur_strength is None and off.warnings == []
    answers = spark.createDataFrame([(0, '{"exposureDelta": 9, "vignetteStrength": "high"}'), (1, "[]"), (2, '{"vignetteStrength": "wild"}'), (3, "{}"), (4, None), (5, '{"exposureDelta": "x"}')], "i int, a string")
    got = {r.i: r.n for r in answers.withColumn("c", editplan.adjustments(F.col("a"))).select("i", F.when(F.col("c").isNotNull(), editplan.adjusted(editplan.plan(), F.col("c"))).alias("n")).collect()}
    assert got[0].settings["Exposure2012"] == 1.0 and got[0].settings["PostCropVignetteFeather"] == 70.0 and got[0].settings["PostCropVignetteStyle"] == 1.0
    assert got[3].settings == row.p.settings and [got[i] for i in (1, 2, 4, 5)] == [None] * 4
    files_ = spark.createDataFrame([("a.jpg",)], "path string")
    assert editplan.build(files_, EngineConfig()).first().plan.settings == row.p.settings
    allowed = EngineConfig(enable_ai_features=True, use_ai_for_edit=True)
    assert editplan.build(files_, allowed, '{"vibranceDelta": 30}').first().plan.settings["Vibrance"] == 20.0
    for rows, cfg, answer in ((files_.limit(0), EngineConfig(), None), (files_, EngineConfig(use_ai_for_edit=True), None), (files_, allowed, "no")):
        with pytest.raises(ValueError):
            editplan.build(rows, cfg, answer)
    chat = spark.createDataFrame([(1, i, "user", "x" * 2_000) for i in range(30)] + [(2, 0, "user", "y" * 40_000)], "conv_id long, turn long, role string, text string")
    kept = editplan.trim_chat(chat).collect()
    assert sorted(r.turn for r in kept if r.conv_id == 1) == list(range(14, 30)) and sum(r.conv_id == 2 for r in kept) == 1


def test_events(spark, tmp_path):
    from pyspark.sql import functions as F

    from gleaner.streaming import events

    rows = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02}", 1, "ab"[i % 2], 0.0, "{}") for i in range(20)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
    rows.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in")
    for _ in range(2):  # a restart adds nothing
        events.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/log").count() == 20
    query = events.ring(stream, size=3).writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", f"{tmp_path}/ring").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert {(r.event_type, r.event_id) for r in spark.table("ring").collect()} == {("a", 14), ("a", 16), ("a", 18), ("b", 15), ("b", 17), ("b", 19)}
    one = spark.range(1).select(eventlog.line_class(F.lit("x → Good")).alias("c"), eventlog.percent(F.lit(1), F.lit(0)).alias("p")).first()
    assert one.c == "good" and one.p == 0
