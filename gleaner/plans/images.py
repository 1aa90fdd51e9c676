"""Queries over real image files: a folder of drawings, one a supplier, is
written and then read, hashed, measured and thinned out as any folder is.

The SQL draws the same pixels and states every rule in numbers of its own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import hashing, pixels, scoring
from ..operators import dedupe
from ..sources import files
from ..tables import shared_folder, stored, table
from .registry import r6, register

Rows = Iterator[pa.RecordBatch]


def drawing(key: int, width: int, height: int) -> np.ndarray:
    """Three keys share a subject: the second is its exact copy, the third has
    some noise.  Stripes, checks, slopes and flat frames, half with a patch of skin."""
    b, variant = key // 3, key % 3
    y, x = np.mgrid[:height, :width].astype(np.int64)
    kind = b % 4
    if kind == 0:
        u = (b * 37 + x * (b % 7 + 1) * 3 + y * (b % 5 + 2)) % 256
    elif kind == 1:
        u = (x // (2 + b % 3) + y // (1 + b % 3)) % 2 * 200 + 20 + b % 30
    elif kind == 2:
        u = (x * 255 // width + y * (b % 9 + 1)) // 2 % 256
    else:
        u = 90 + b % 60 + (x * x + y * b) % 23
    rgb = np.stack([u, (u + b * 13) % 256, (u * 3 + y) % 256], axis=-1)
    patch = (b % 2 == 0) & (np.abs(x - b * 11 % width) < width // 5) & (np.abs(y - b * 5 % height) < height // 5)
    tone = (x + y) % 3 * 8
    rgb = np.where(patch[..., None], np.stack([200 + tone, 140 + tone, 110 + tone], axis=-1), rgb)
    if variant == 2:
        rgb[..., 0] = np.minimum(255, rgb[..., 0] + x * y % 3)
    return rgb.astype(np.uint8)


def _draw(folder: str, width: int, height: int):
    def run(batches: Rows) -> Rows:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for key in batch.column("key").to_pylist():
                with system.open_output_stream(f"{root}/{key:09}.png") as out:
                    out.write(pixels.png_bytes(drawing(key, width, height)))
            yield batch

    return run


def folder_of_drawings(spark: SparkSession, sf: str, width: int, height: int) -> str:
    folder = f"{shared_folder(spark)}/gleaner/{uuid.uuid4().hex}/drawings"
    keys = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    stored(keys.mapInArrow(_draw(folder, width, height), "key long"), "drawn")
    return folder


def _key():
    return F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long").alias("key")


def _measured(spark, sf, width, height, **options) -> DataFrame:
    return pixels.measured(files.images(spark, folder_of_drawings(spark, sf, width, height)), **options)


# --- the same in SQL ----------------------------------------------------------


def _drawn(w: int, h: int) -> str:
    """px(k, x, y, r, g, b, l): the pixels of all drawings and their luma."""
    return f"""ks AS (SELECT s_suppkey AS k, s_suppkey // 3 AS s, s_suppkey % 3 AS v FROM supplier),
    u AS (SELECT k, s, v, x, y, CASE s % 4 WHEN 0 THEN (s * 37 + x * (s % 7 + 1) * 3 + y * (s % 5 + 2)) % 256 WHEN 1 THEN (x // (2 + s % 3) + y // (1 + s % 3)) % 2 * 200 + 20 + s % 30
        WHEN 2 THEN (x * 255 // {w} + y * (s % 9 + 1)) // 2 % 256 ELSE 90 + s % 60 + (x * x + y * s) % 23 END AS u, s % 2 = 0 AND abs(x - s * 11 % {w}) < {w // 5} AND abs(y - s * 5 % {h}) < {h // 5} AS patch FROM ks, range({w}) a(x), range({h}) b(y)),
    c AS (SELECT k, v, x, y, CASE WHEN patch THEN 200 + (x + y) % 3 * 8 ELSE u END AS r, CASE WHEN patch THEN 140 + (x + y) % 3 * 8 ELSE (u + s * 13) % 256 END AS g, CASE WHEN patch THEN 110 + (x + y) % 3 * 8 ELSE (u * 3 + y) % 256 END AS b FROM u),
    d AS (SELECT k, x, y, CASE WHEN v = 2 THEN least(255, r + x * y % 3) ELSE r END AS r, g, b FROM c),
    px AS MATERIALIZED (SELECT *, (2126 * r + 7152 * g + 722 * b) // 10000 AS l FROM d)"""


def _hashes_sql() -> str:
    """fp(doc_id, h1, h2) of drawings of 32x32 as unsigned hashes."""
    bit = lambda flag, at: f"sum(CASE WHEN {flag} THEN 1::HUGEINT << ({at}) ELSE 0 END)::UBIGINT"
    weight = lambda n: f"(SELECT t, s, greatest(0, 64 - abs({n} * (2 * s + 1) - 32 * (2 * t + 1))) AS w FROM range({n}) a(t), range(32) b(s))"
    return f"""{_drawn(32, 32)},
    hist AS (SELECT k, l, count(*) AS n FROM px GROUP BY k, l),
    cum AS (SELECT k, l, sum(n) OVER (PARTITION BY k ORDER BY l) AS up, sum(n) OVER (PARTITION BY k ORDER BY l DESC) AS down FROM hist),
    cut AS (SELECT k, min(l) FILTER (WHERE up >= 10) AS lo, max(l) FILTER (WHERE down >= 10) AS hi FROM cum GROUP BY k),
    st AS MATERIALIZED (SELECT k, x, y, CASE WHEN hi <= lo THEN l ELSE floor((least(greatest(l, lo), hi) - lo) * 255.0::DOUBLE / (hi - lo) + 0.5) END AS p FROM px JOIN cut USING (k)),
    rows_ AS (SELECT k, y, f, sum(p * cos(pi() / 32 * (x + 0.5) * f)) AS p FROM st, range(8) t(f) GROUP BY k, y, f),
    co AS (SELECT k, f, q, sum(p * cos(pi() / 32 * (y + 0.5) * q)) AS p FROM rows_, range(8) t(q) GROUP BY k, f, q),
    av AS (SELECT k, sum(p) / 63 AS m FROM co WHERE f + q > 0 GROUP BY k),
    ph AS (SELECT k, {bit("p > m", "8 * q + f")} AS h1 FROM co JOIN av USING (k) GROUP BY k),
    w8 AS (SELECT t, s, w, sum(w) OVER (PARTITION BY t) AS whole FROM {weight(8)}), w9 AS (SELECT t, s, w, sum(w) OVER (PARTITION BY t) AS whole FROM {weight(9)}),
    tall AS (SELECT k, t AS y, x, whole, sum(p::HUGEINT * w) AS p FROM st JOIN w8 ON s = y WHERE w > 0 GROUP BY k, t, x, whole),
    small AS (SELECT k, y, t AS x, (2 * sum(p * w) + tall.whole * w9.whole) // (2 * tall.whole * w9.whole) AS p FROM tall JOIN w9 ON s = x WHERE w > 0 GROUP BY k, y, t, tall.whole, w9.whole),
    dh AS (SELECT a.k, {bit("a.p > b.p", "8 * a.y + a.x")} AS h2 FROM small a JOIN small b ON a.k = b.k AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.k),
    fp AS MATERIALIZED (SELECT k AS doc_id, h1, h2 FROM ph JOIN dh USING (k))"""


def _measures_sql(w: int, h: int) -> str:
    """m: one row a drawing with all that its score is made of."""
    bw, bh = max(w * 2 // 5, 16), max(h * 2 // 5, 16)
    cw, ch = max(w // 3, 16), max(h // 3, 16)
    fw, fh = max(w * 2 // 5, 8), max(h * 2 // 5, 8)
    boxes = ", ".join(f"('g{r}{c}', {c * ((w - cw) // 2)}, {r * ((h - ch) // 2)}, {cw}, {ch})" for r in range(3) for c in range(3))
    strips = f"('e1', 0, 0, {w}, {max(h // 8, 4)}), ('e2', 0, {h - max(h // 8, 4)}, {w}, {max(h // 8, 4)}), ('e3', 0, 0, {max(w // 8, 4)}, {h}), ('e4', {w - max(w // 8, 4)}, 0, {max(w // 8, 4)}, {h})"
    middle = f"('mid', {(w - w // 2) // 2}, {(h - h // 2) // 2}, {w // 2}, {h // 2})"
    exposure = lambda p: f"least(greatest((1 - 0.5 * (({p}m - 128) / 128) * (({p}m - 128) / 128)) * least(greatest(sqrt(greatest({p}s - {p}m * {p}m, 0)) / 60, 0.3), 1.0) * (1 - 1.5 * least({p}t, 0.5)), 0.0), 1.0)"
    luma = lambda p: f"sum(l)::DOUBLE / count(*) AS {p}m, sum(l * l)::DOUBLE / count(*) AS {p}s, count(*) FILTER (WHERE l < 6 OR l >= 250)::DOUBLE / count(*) AS {p}t"
    return f"""{_drawn(w, h)},
    hue AS (SELECT k, x, y, r, g, b, l, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
    hsv AS (SELECT *, CASE WHEN hi = lo THEN -1 WHEN hi = r THEN CASE WHEN g < b THEN 360 + 60.0::DOUBLE * (g - b) / (hi - lo) ELSE 60.0::DOUBLE * (g - b) / (hi - lo) END WHEN hi = g THEN 60 * ((b - r)::DOUBLE / (hi - lo) + 2) ELSE 60 * ((r - g)::DOUBLE / (hi - lo) + 4) END AS hue FROM hue),
    sk AS MATERIALIZED (SELECT k, x, y, 299 * r + 587 * g + 114 * b AS z, (r > 95 AND g > 40 AND b > 20 AND r > g AND r > b AND r - g > 15 AND hi - lo > 15)
        OR (hi > lo AND (hue <= 50 OR hue >= 340) AND (hi - lo)::DOUBLE / hi BETWEEN 0.08 AND 0.75 AND hi / 255.0::DOUBLE BETWEEN 0.18 AND 0.98) AS skin FROM hsv),
    cand AS (SELECT i, j, {w - bw} * i // 4 AS x0, {h - bh} * j // 3 AS y0 FROM range(5) a(i), range(4) b(j)),
    sums AS (SELECT k, i, j, x0, y0, count(*) AS n, sum(z) AS s1, sum(z * z) AS s2, count(*) FILTER (WHERE skin) AS ns FROM sk JOIN cand ON x >= x0 AND x < x0 + {bw} AND y >= y0 AND y < y0 + {bh} AND (x - x0) % 2 = 0 AND (y - y0) % 2 = 0 GROUP BY ALL),
    parts AS (SELECT k, i, j, x0, y0, ns::DOUBLE / n AS skin, least(1.0, sqrt((n * s2 - s1 * s1)::DOUBLE / (n * n) / 1e6) / 64) AS detail,
        greatest(1 - abs((x0 + {bw // 2})::DOUBLE / {w} - 0.5) * 1.4, 0.0) * greatest(1 - abs((y0 + {bh // 2})::DOUBLE / {h} - 0.38) * 1.6, 0.0) AS prior FROM sums),
    ranked AS (SELECT *, 0.5::DOUBLE * skin + 0.3::DOUBLE * detail + 0.2::DOUBLE * prior AS score FROM parts),
    best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, j, i) = 1),
    roi AS MATERIALIZED (SELECT k, score, skin, detail, prior, score < 0.08 AS fallback, CASE WHEN score < 0.08 THEN {(w - fw) // 2} ELSE x0 END AS x0, CASE WHEN score < 0.08 THEN {(h - fh) * 3 // 10} ELSE y0 END AS y0, CASE WHEN score < 0.08 THEN {fw} ELSE {bw} END AS rw, CASE WHEN score < 0.08 THEN {fh} ELSE {bh} END AS rh FROM best),
    side AS MATERIALIZED (SELECT k, x, y, l, lag(l) OVER q AS wl, lead(l) OVER q AS el, lag(l) OVER t AS nl, lead(l) OVER t AS sl FROM px WINDOW q AS (PARTITION BY k, y ORDER BY x), t AS (PARTITION BY k, x ORDER BY y)),
    lap AS MATERIALIZED (SELECT k, x, y, wl + el + nl + sl - 4 * l AS v, sqrt(((el - wl) * (el - wl) + (sl - nl) * (sl - nl))::DOUBLE) AS grad FROM side WHERE wl IS NOT NULL AND el IS NOT NULL AND nl IS NOT NULL AND sl IS NOT NULL),
    areas AS (SELECT k, a.* FROM ks, (VALUES {boxes}, {strips}, {middle}) a(name, x0, y0, rw, rh) UNION ALL SELECT k, 'roi', x0, y0, rw, rh FROM roi),
    var AS MATERIALIZED (SELECT k, name, sum(v * v)::DOUBLE / count(*) - (sum(v)::DOUBLE / count(*)) * (sum(v)::DOUBLE / count(*)) AS var, sum(grad) / count(*) AS grad FROM lap JOIN areas USING (k) WHERE x > x0 AND x < x0 + rw - 1 AND y > y0 AND y < y0 + rh - 1 GROUP BY k, name),
    nine AS (SELECT k, list(var ORDER BY var DESC) AS top, list(var ORDER BY name) AS cells FROM var WHERE name LIKE 'g%' GROUP BY k),
    sharp AS (SELECT k, cells, (top[1] + top[2] + top[3]) / 3 AS sharpness, top[1] AS most, top[9] AS least FROM nine),
    wide AS (SELECT k, avg(var) FILTER (WHERE name LIKE 'e%') AS border, max(var) FILTER (WHERE name = 'mid') AS centre, max(var) FILTER (WHERE name = 'roi') AS face, max(grad) FILTER (WHERE name = 'roi') AS expression FROM var GROUP BY k),
    whole AS (SELECT k, {luma("fr")}, avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END) AS sat, count(DISTINCT l) AS occupied FROM px GROUP BY k),
    inner_ AS (SELECT px.k, {luma("su")} FROM px JOIN roi ON px.k = roi.k AND x >= x0 AND x < x0 + rw AND y >= y0 AND y < y0 + rh GROUP BY px.k),
    bins AS (SELECT ks.k, bin, (SELECT count(*) FROM px WHERE px.k = ks.k AND px.l <= bin) AS cum FROM ks, range(256) t(bin)),
    pct AS (SELECT k, coalesce(max(bin) FILTER (WHERE cum * 100 <= 5 * {w * h}), 0) AS p5, coalesce(max(bin) FILTER (WHERE cum * 100 <= 95 * {w * h}), 255) AS p95 FROM bins GROUP BY k),
    j AS (SELECT *, 2 * face * centre / (face + centre + 1e-6) AS harmonic, {exposure("fr")} AS exposure_global, 0.7 * {exposure("su")} + 0.3 * {exposure("fr")} AS exposure_portrait, least(1.0, 2 * sat) AS vibrancy, least(greatest(0.4 * occupied / 256.0 + 0.6 * least(greatest((p95 - p5) / 255.0, 0.0), 1.0), 0.0), 1.0) AS dynamic_range,
        CASE WHEN sharpness >= 60 THEN 1.0 WHEN sharpness >= 20 THEN greatest((sharpness - 20) / 40, 0.3) ELSE sharpness / 20 * 0.3 END AS blur_global, CASE WHEN face >= 180 THEN 1.0 WHEN face >= 50 THEN 0.3 + (face - 50) / 130 * 0.7 ELSE face / 50 * 0.3 END AS own
        FROM sharp JOIN wide USING (k) JOIN whole USING (k) JOIN inner_ USING (k) JOIN pct USING (k)),
    m AS MATERIALIZED (SELECT *, least(blur_global, own) AS blur_portrait, 0.75 * least(greatest((harmonic - 12) / 108, 0.0), 1.0) + 0.25 * least(greatest((harmonic / (border + 1e-6) - 0.35) / 1.15, 0.0), 1.0) AS focus FROM j)"""


_HEX = "lower(lpad(to_hex({0}), 16, '0'))"


@register("image_hashes", f"WITH {_hashes_sql()} SELECT doc_id AS key, {_HEX.format('h1')} AS phash, {_HEX.format('h2')} AS dhash FROM fp")
def image_hashes(spark, sf):
    return _measured(spark, sf, 32, 32).select(_key(), hashing.hex16(F.col("h1")).alias("phash"), hashing.hex16(F.col("h2")).alias("dhash"))


@register("image_subject", f"WITH {_measures_sql(50, 40)} SELECT k AS key, x0 AS x, y0 AS y, rw AS w, rh AS h, round(score, 6) AS score, round(skin, 6) AS skin, round(detail, 6) AS detail, round(prior, 6) AS prior, fallback FROM roi")
def image_subject(spark, sf):
    d = F.col("diagnostics")
    return _measured(spark, sf, 50, 40, trail=True).select(
        _key(), d["roiX"].cast("long").alias("x"), d["roiY"].cast("long").alias("y"), d["roiW"].alias("w"), d["roiH"].alias("h"), r6(d["roiCandidateScore"]).alias("score"), r6(d["roiSkinFraction"]).alias("skin"), r6(d["roiDetail"]).alias("detail"), r6(d["roiPrior"]).alias("prior"), d["roiUsedFallback"].alias("fallback")
    )


@register("image_sharpness", f"WITH {_measures_sql(50, 40)} SELECT k AS key, list_transform(cells, lambda c: round(c, 4)) AS cells, round(sharpness, 4) AS top3, round(most, 4) AS most, round(least, 4) AS least, round(border, 4) AS border, round(centre, 4) AS centre, round(face, 4) AS subject, round(focus, 6) AS focus, round(blur_global, 6) AS blur_global, round(blur_portrait, 6) AS blur_portrait FROM m")
def image_sharpness(spark, sf):
    d, four = F.col("diagnostics"), lambda c: F.round(c, 4)
    return _measured(spark, sf, 50, 40, trail=True).select(
        _key(), F.transform(d["regionSharpness"], four).alias("cells"), four(d["sharpnessTop3"]).alias("top3"), four(d["sharpnessMaxRegion"]).alias("most"), four(d["sharpnessMinRegion"]).alias("least"), four(d["borderSharpness"]).alias("border"), four(d["centerLaplacian"]).alias("centre"), four(d["roiLaplacian"]).alias("subject"),
        r6(F.col("focus")).alias("focus"), r6(d["blurConfidenceGlobal"]).alias("blur_global"), r6(d["blurConfidencePortrait"]).alias("blur_portrait"),
    )


@register("image_exposure", f"WITH {_measures_sql(50, 40)} SELECT k AS key, round(frm, 6) AS mean, round(sqrt(greatest(frs - frm * frm, 0)), 6) AS deviation, round(exposure_global, 6) AS exposure_global, round(exposure_portrait, 6) AS exposure_portrait, round(expression, 6) AS expression, round(vibrancy, 6) AS vibrancy, CAST(occupied AS INTEGER) AS occupied, CAST(p5 AS INTEGER) AS p5, CAST(p95 AS INTEGER) AS p95, round(dynamic_range, 6) AS dynamic_range FROM m")
def image_exposure(spark, sf):
    d = F.col("diagnostics")
    return _measured(spark, sf, 50, 40, trail=True).select(
        _key(), r6(d["frameLuma"]["mean"]).alias("mean"), r6(d["frameLuma"]["stdDev"]).alias("deviation"), r6(d["exposureGlobal"]).alias("exposure_global"), r6(d["exposurePortrait"]).alias("exposure_portrait"), r6(F.col("expression")).alias("expression"), r6(F.col("vibrancy")).alias("vibrancy"), d["dynamicRangeOccupiedBins"].alias("occupied"), d["dynamicRangeP5"].alias("p5"), d["dynamicRangeP95"].alias("p95"), r6(F.col("dynamic_range")).alias("dynamic_range")
    )


_GATE = "least(greatest({0}, 0.05), 1.0) * least(greatest(focus, 0.05), 1.0)"
_LOW = f"(0.30 * expression + 0.20 * exposure_portrait + 0.10 * dynamic_range + 0.15 * sharpness + 0.10 * (focus * sharpness) + 0.15 * vibrancy) * {_GATE.format('blur_portrait')}"
_PORTRAIT = f"(0.25 * expression + 0.15 * face + 0.15 * exposure_portrait + 0.10 * dynamic_range + 0.10 * sharpness + 0.10 * (focus * sharpness) + 0.15 * vibrancy) * {_GATE.format('blur_portrait')}"
_LAND = f"(0.25 * dynamic_range + 0.20 * exposure_global + 0.20 * sharpness + 0.15 * (focus * sharpness) + 0.20 * vibrancy) * {_GATE.format('blur_global')}"


@register("image_scores", f"WITH {_measures_sql(50, 40)} SELECT k AS key, round({_PORTRAIT}, 4) AS portrait, round({_LOW}, 4) AS portrait_low, round({_LAND}, 4) AS landscape FROM m")
def image_scores(spark, sf):
    four = lambda branch: F.round(scoring.raw_score(branch), 4).alias(branch)
    images = files.images(spark, folder_of_drawings(spark, sf, 50, 40))
    seen = pixels.measured(images).select(_key(), four("portrait"), four("portrait_low"))
    return seen.join(pixels.measured(images, scene="landscape").select(_key(), four("landscape")), "key")


def _run_sql() -> str:
    """placed: what a run over drawings of 32x32 does with each."""
    from .catalog import linkage_of, reach_sql

    edges = "e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.h1, b.h1)) AS INTEGER) AS dist FROM fp a JOIN fp b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.h1, b.h1)) <= 7 AND bit_count(xor(a.h2, b.h2)) <= 11)"
    measures = _measures_sql(32, 32).split("px AS MATERIALIZED", 1)[1].split("\n", 1)[1]
    norm = ", ".join(f"{c} / greatest(max({c}) OVER g, 1e-9) AS n_{c}" for c in ("expression", "face", "exposure_portrait", "dynamic_range", "sharpness", "focus", "vibrancy"))
    score = _PORTRAIT.split(" * least", 1)[0]
    for c in ("expression", "face", "exposure_portrait", "dynamic_range", "sharpness", "vibrancy"):
        score = score.replace(f"* {c}", f"* n_{c}")
    score = score.replace("(focus * sharpness)", "(n_focus * n_sharpness)")
    return f"""WITH RECURSIVE {_hashes_sql()}, {measures}, {edges}, {reach_sql()}, {linkage_of()},
        ids AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS id FROM supplier),
        grouped AS (SELECT id AS k, group_id FROM sized WHERE n >= 2),
        normed AS (SELECT k, group_id, sharpness, focus, blur_portrait, {norm} FROM m JOIN grouped USING (k) WINDOW g AS (PARTITION BY group_id)),
        scored AS (SELECT k, group_id, sharpness, focus, {score} * {_GATE.format("blur_portrait")} AS score FROM normed),
        won AS (SELECT k, group_id, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, round(sharpness, 6) DESC, round(focus, 9) DESC, k DESC) = 1 AS won FROM scored),
        placed AS (SELECT ids.id, lpad(CAST(ids.k AS VARCHAR), 9, '0') || '.png' AS file_name, g.id AS group_id, CASE WHEN won THEN 'kept' WHEN won IS NULL THEN 'unique' ELSE 'rejected' END AS outcome FROM ids LEFT JOIN won USING (k) LEFT JOIN ids g ON g.k = won.group_id)"""


def register_runs() -> None:
    sql = _run_sql()

    @register("image_run", f"{sql} SELECT id, file_name, coalesce(group_id, -1) AS group_id, outcome, CASE outcome WHEN 'rejected' THEN 'Rejected' ELSE 'Images-Good' END AS destination FROM placed")
    def image_run(spark, sf):
        found = dedupe.run(spark, folder_of_drawings(spark, sf, 32, 32), EngineConfig())
        return found.placements.select("id", "file_name", F.coalesce("group_id", F.lit(-1)).alias("group_id"), "outcome", "destination")

    @register("image_run_summary", f"{sql} SELECT count(*) AS scanned, count(DISTINCT group_id) AS groups, count(*) FILTER (WHERE outcome <> 'rejected') AS kept, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'unique') AS \"unique\", 0::BIGINT AS ai_reranked FROM placed")
    def image_run_summary(spark, sf):
        return dedupe.run(spark, folder_of_drawings(spark, sf, 32, 32), EngineConfig()).summary.withColumn("ai_reranked", F.col("ai_reranked").cast("long"))
