"""Hashes and quality features of decoded images, in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma by the weights of Rec. 709."""
    wide = rgb.astype(np.int64)
    return ((2126 * wide[..., 0] + 7152 * wide[..., 1] + 722 * wide[..., 2]) // 10_000).astype(np.uint8)


@cache
def _weights(size: int, target: int) -> np.ndarray:
    """Triangle filter, widened by the ratio when shrinking, in whole numbers
    (the centres' distance, both axes stretched to size x target x 2)."""
    distance = np.abs(target * (2 * np.arange(size) + 1)[None, :] - size * (2 * np.arange(target) + 1)[:, None])
    return np.maximum(0, 2 * max(size, target) - distance).astype(float)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By the triangle filter, rounded half up.  The sums are whole numbers
    below 2^53, so no order of addition changes them."""
    down, across = _weights(image.shape[0], height), _weights(image.shape[1], width)
    out = (down @ image.astype(float).reshape(image.shape[0], -1)).reshape(height, *image.shape[1:])
    out = np.moveaxis(np.tensordot(across, out, (1, 1)), 0, 1).astype(np.int64)
    whole = (down.sum(1)[:, None] * across.sum(1)[None, :]).astype(np.int64).reshape(height, width, *[1] * (image.ndim - 2))
    return ((2 * out + whole) // (2 * whole)).astype(np.uint8)


def shrunk(image: np.ndarray, edge: int) -> np.ndarray:
    """At most ``edge`` pixels on the long side; never enlarged."""
    height, width = image.shape[:2]
    scale = np.float32(edge) / np.float32(max(height, width))
    if scale >= 1:
        return image
    return resize(image, max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5)))


def stretched(luma: np.ndarray) -> np.ndarray:
    """Contrast between the values where 1 percent of the pixels is reached from either end."""
    count = np.bincount(luma.reshape(-1), minlength=256)
    tail = max(luma.size // 100, 1)
    low = int(np.searchsorted(np.cumsum(count), tail))
    high = 255 - int(np.searchsorted(np.cumsum(count[::-1]), tail))
    if high <= low:
        return luma
    value = (np.clip(luma.astype(float), low, high) - low) * 255 / (high - low)
    return np.floor(value + 0.5).astype(np.uint8)


@cache
def _cosines(n: int = 32, keep: int = 8) -> np.ndarray:
    """Rows of the cosine transform as defined, without normalisation."""
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(keep)[:, None])


def _as_long(flags: np.ndarray) -> int:
    return int(np.packbits(flags.reshape(-1), bitorder="little").view("<i8")[0])


def phash(luma: np.ndarray) -> int:
    """Bit 8v+h: coefficient of vertical frequency v and horizontal h above the mean of all but the first."""
    c = _cosines()
    low = c @ resize(stretched(luma), 32, 32).astype(float) @ c.T
    return _as_long(low > low.reshape(-1)[1:].mean())


def dhash(luma: np.ndarray) -> int:
    small = resize(stretched(luma), 9, 8).astype(int)
    return _as_long(small[:, :-1] > small[:, 1:])


def laplacian_variance(luma: np.ndarray) -> float:
    if min(luma.shape) < 3:
        return 0.0
    x = luma.astype(np.int64)
    lap = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    mean = int(lap.sum()) / lap.size
    return int((lap * lap).sum()) / lap.size - mean * mean


def regions(luma: np.ndarray) -> list[float]:
    """Sharpness of nine cells, row by row: a third of a side each, 16 pixels
    at least, spread from edge to edge."""
    height, width = luma.shape
    h, w = max(height // 3, 16), max(width // 3, 16)
    dy, dx = max(height - h, 0) // 2, max(width - w, 0) // 2
    return [laplacian_variance(luma[r * dy : r * dy + h, c * dx : c * dx + w]) for r in range(3) for c in range(3)]


def sharpness(luma: np.ndarray) -> float:
    """Mean of the three sharpest regions."""
    return sum(sorted(regions(luma))[-3:]) / 3


def border(luma: np.ndarray) -> float:
    """Mean sharpness of the four edge strips, an eighth of a side wide, 4 pixels at least."""
    h, w = max(luma.shape[0] // 8, 4), max(luma.shape[1] // 8, 4)
    return sum(map(laplacian_variance, (luma[:h], luma[-h:], luma[:, :w], luma[:, -w:]))) / 4


def centre(luma: np.ndarray) -> np.ndarray:
    """The middle half of both sides, 8 pixels at least."""
    height, width = luma.shape
    h, w = max(height // 2, 8), max(width // 2, 8)
    y, x = max(height - h, 0) // 2, max(width - w, 0) // 2
    return luma[y : y + h, x : x + w]


def exposure(luma: np.ndarray) -> float:
    if not luma.size:
        return 0.5
    n = np.bincount(luma.reshape(-1), minlength=256)
    mean, std = luma.mean(), luma.std()
    tails = (n[:6].sum() + n[250:].sum()) / luma.size
    return float(np.clip((1 - 0.5 * ((mean - 128) / 128) ** 2) * np.clip(std / 60, 0.3, 1) * (1 - 1.5 * np.clip(tails, 0, 0.5)), 0, 1))


def dynamic_range(luma: np.ndarray) -> tuple[float, int, int, int]:
    """(quality, occupied bins, p5, p95); a percentile is the last bin that the share does not exceed."""
    count = np.bincount(luma.reshape(-1), minlength=256)
    cum = np.cumsum(count)
    low, high = np.flatnonzero(cum * 100 <= 5 * luma.size), np.flatnonzero(cum * 100 <= 95 * luma.size)
    p5, p95 = int(low[-1]) if len(low) else 0, int(high[-1]) if len(high) else 255
    occupied = int((count > 0).sum())
    return float(np.clip(0.4 * occupied / 256 + 0.6 * np.clip((p95 - p5) / 255, 0, 1), 0, 1)), occupied, p5, p95


def vibrancy(rgb: np.ndarray) -> float:
    """Twice the mean saturation, at most 1."""
    high, low = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    return float(min(1.0, 2 * np.where(high > 0, (high - low) / np.maximum(high, 1), 0).mean()))


def gradient(luma: np.ndarray) -> float:
    """Mean gradient magnitude of the inner pixels; 0 for sides under 4."""
    if min(luma.shape) < 4:
        return 0.0
    x = luma.astype(float)
    return float(np.sqrt((x[1:-1, 2:] - x[1:-1, :-2]) ** 2 + (x[2:, 1:-1] - x[:-2, 1:-1]) ** 2).mean())


def skin(rgb: np.ndarray) -> np.ndarray:
    """Where pixels look like skin, by a rule on RGB or one on hue, saturation and value."""
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    high, low = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    spread = high - low
    by_rgb = (r > 95) & (g > 40) & (b > 20) & (spread > 15) & (np.abs(r - g) > 15) & (r > g) & (r > b)
    safe = np.where(spread > 0, spread, 1)
    hue = 60 * np.where(high == r, np.fmod((g - b) / safe, 6), np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(hue < 0, hue + 360, hue)
    saturation, value = spread / np.maximum(high, 1), high / 255
    by_hue = (spread > 0) & ((hue <= 50) | (hue >= 340)) & (saturation >= 0.08) & (saturation <= 0.75) & (value >= 0.18) & (value <= 0.98)
    return by_rgb | by_hue


def fallback_box(width: int, height: int) -> tuple[int, int, int, int]:
    """The upper centre, as (x, y, w, h)."""
    w, h = min(max(width * 2 // 5, 8), width), min(max(height * 2 // 5, 8), height)
    return (width - w) // 2, (height - h) * 3 // 10, w, h


def box_parts(rgb: np.ndarray, x: int, y: int, w: int, h: int) -> dict[str, float]:
    """How like a subject a box is: its share of skin, contrast and place, every second pixel read."""
    height, width = rgb.shape[:2]
    part = rgb[y : y + h : 2, x : x + w : 2]
    luma = part.astype(np.int64) @ np.array([299, 587, 114])
    n, total, squares = luma.size, int(luma.sum()), int((luma * luma).sum())
    detail = min(1.0, ((n * squares - total * total) / (n * n) / 1e6) ** 0.5 / 64)
    limit = lambda v: min(max(v, 0.0), 1.0)
    prior = limit(1 - abs((x + w // 2) / width - 0.5) * 1.4) * limit(1 - abs((y + h // 2) / height - 0.38) * 1.6)
    share = float(skin(part).mean())
    return {"score": 0.5 * share + 0.3 * detail + 0.2 * prior, "skin": share, "detail": detail, "prior": prior}


def subject_box(rgb: np.ndarray) -> tuple[tuple[int, int, int, int], dict[str, float | bool | int]]:
    """The box (x, y, w, h) of the likeliest subject, and why: of 5x4 boxes of
    two fifths of a side (16 pixels at least) the first that scores best.  The
    upper centre if a side is under 32 or nothing scores 0.08; the parts are
    then still those of the best box."""
    height, width = rgb.shape[:2]
    if min(height, width) < 32:
        return fallback_box(width, height), {"score": 0.0, "skin": 0.0, "detail": 0.0, "prior": 0.0, "fallback": True, "candidates": 0}
    w, h = max(width * 2 // 5, 16), max(height * 2 // 5, 16)
    boxes = [((width - w) * column // 4, (height - h) * row // 3, w, h) for row in range(4) for column in range(5)]
    parts = [box_parts(rgb, *box) for box in boxes]
    best = max(range(len(boxes)), key=lambda i: parts[i]["score"])
    fallback = parts[best]["score"] < 0.08
    return fallback_box(width, height) if fallback else boxes[best], parts[best] | {"fallback": fallback, "candidates": len(boxes)}


FEATURES = ("sharpness", "focus", "face", "exposure", "expression", "vibrancy", "dynamic_range", "blur")


def luma_stats(luma: np.ndarray) -> dict:
    """Mean, deviation, clipped shares and a histogram of 16 bins as shares."""
    if not luma.size:
        return {"mean": 0.0, "stdDev": 0.0, "clippedDark": 0.0, "clippedBright": 0.0, "histogram16": [0.0] * 16}
    n = np.bincount(luma.reshape(-1), minlength=256) / luma.size
    return {"mean": float(luma.mean()), "stdDev": float(luma.std()), "clippedDark": float(n[:6].sum()), "clippedBright": float(n[250:].sum()), "histogram16": n.reshape(16, 16).sum(1).tolist()}


def clear_frame(sharp: float) -> float:
    """1 for sharp frames, falling to 0; flat at 0.3 in between."""
    return 1.0 if sharp >= 60 else min(max((sharp - 20) / 40, 0.3), 1.0) if sharp >= 20 else sharp / 20 * 0.3


def clear_subject(sharp: float, roi: float) -> float:
    own = 1.0 if roi >= 180 else 0.3 + (roi - 50) / 130 * 0.7 if roi >= 50 else roi / 50 * 0.3
    return min(clear_frame(sharp), own)


def details(rgb: np.ndarray) -> dict:
    """All that scores are made of: one image's whole trail of evidence."""
    height, width = rgb.shape[:2]
    luma = grey(rgb)
    (x, y, w, h), why = subject_box(rgb)
    subject = luma[y : y + h, x : x + w]
    cells = regions(luma)
    roi, mid, edge = laplacian_variance(subject), laplacian_variance(centre(luma)), border(luma)
    both = 2 * roi * mid / (roi + mid + 1e-6)
    ratio = both / (edge + 1e-6)
    limit = lambda v: min(max(v, 0.0), 1.0)
    sharp = sum(sorted(cells)[-3:]) / 3
    _, occupied, p5, p95 = dynamic_range(luma)
    return {
        "width": width, "height": height, "megapixels": width * height / 1e6, "aspectRatio": width / height,
        "roiX": x, "roiY": y, "roiW": w, "roiH": h, "roiCenterRelX": (x + w // 2) / width, "roiCenterRelY": (y + h // 2) / height, "roiAreaFraction": w * h / (width * height),
        "roiCandidateScore": why["score"], "roiSkinFraction": why["skin"], "roiDetail": why["detail"], "roiPrior": why["prior"], "roiUsedFallback": why["fallback"], "roiCandidatesEvaluated": why["candidates"],
        "regionSharpness": cells, "sharpnessTop3": sharp, "sharpnessMaxRegion": max(cells), "sharpnessMinRegion": min(cells), "borderSharpness": edge, "centerLaplacian": mid, "roiLaplacian": roi,
        "subjectHarmonic": both, "focusAbsoluteTerm": limit((both - 12) / 108), "focusRelativeTerm": limit((ratio - 0.35) / 1.15), "focusSubjectBorderRatio": ratio,
        "blurConfidenceGlobal": clear_frame(sharp), "blurConfidencePortrait": clear_subject(sharp, roi), "exposureGlobal": exposure(luma), "exposurePortrait": 0.7 * exposure(subject) + 0.3 * exposure(luma),
        "frameLuma": luma_stats(luma), "roiLuma": luma_stats(subject), "saturationMean": vibrancy(rgb) / 2, "dynamicRangeOccupiedBins": occupied, "dynamicRangeP5": p5, "dynamicRangeP95": p95,
    }


def features(rgb: np.ndarray, faces: bool = True, scene: str = "portrait", trail: dict | None = None) -> dict[str, float]:
    """The eight numbers of a score; landscapes are judged by the whole frame.
    ``trail``: the image's ``details``, if they are there already."""
    d = trail or details(rgb)
    x, y, w, h = (d[k] for k in ("roiX", "roiY", "roiW", "roiH"))
    luma = grey(rgb)
    portrait = scene == "portrait"
    return {
        "sharpness": d["sharpnessTop3"],
        "focus": 0.75 * d["focusAbsoluteTerm"] + 0.25 * d["focusRelativeTerm"],
        "face": d["roiLaplacian"] if faces else 0.0,
        "exposure": d["exposurePortrait"] if portrait else d["exposureGlobal"],
        "expression": gradient(luma[y : y + h, x : x + w]),
        "vibrancy": vibrancy(rgb),
        "dynamic_range": dynamic_range(luma)[0],
        "blur": d["blurConfidencePortrait"] if portrait else d["blurConfidenceGlobal"],
    }


def pixels_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """RGB of the bytes of Spark's image source, which are BGR or grey."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[..., 2::-1][..., :3]


_STATS = pa.struct([*((n, pa.float64()) for n in ("mean", "stdDev", "clippedDark", "clippedBright")), ("histogram16", pa.list_(pa.float64()))])
_WHOLE = ("width", "height", "roiX", "roiY", "roiW", "roiH", "roiCandidatesEvaluated", "dynamicRangeOccupiedBins", "dynamicRangeP5", "dynamicRangeP95")
_KINDS = dict.fromkeys(_WHOLE, pa.int32()) | {"roiUsedFallback": pa.bool_(), "regionSharpness": pa.list_(pa.float64()), "frameLuma": _STATS, "roiLuma": _STATS}
_DETAILS = pa.struct([(n, _KINDS.get(n, pa.float64())) for n in details(np.zeros((8, 8, 3), np.uint8))])


def _schema(trail: bool) -> pa.Schema:
    more = [("diagnostics", _DETAILS)] if trail else []
    return pa.schema([("path", pa.string()), ("preview_w", pa.int32()), ("preview_h", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), *((f, pa.float64()) for f in FEATURES), *more, ("error", pa.string())])


def _measure(edge: int, faces: bool, scene: str, trail: bool):
    schema = _schema(trail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time, since a batch of them decoded may be large
                r = batch.slice(i, 1).to_pylist()[0]
                row = {"path": r["path"], "preview_w": 0, "preview_h": 0, "h1": None, "h2": None, **dict.fromkeys(FEATURES, 0.0), "error": r["error"]}
                if r["pixels"] is not None:
                    try:
                        rgb = shrunk(pixels_of(r["pixels"], r["width"], r["height"], r["channels"]), edge)
                        luma = grey(rgb)
                        found = details(rgb)
                        row |= {"preview_w": rgb.shape[1], "preview_h": rgb.shape[0], "h1": phash(luma), "h2": dhash(luma), **features(rgb, faces, scene, found)}
                        row |= {"diagnostics": found} if trail else {}
                    except ValueError as e:
                        row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def measured(images: DataFrame, edge: int = 768, faces: bool = True, scene: str = "portrait", trail: bool = False) -> DataFrame:
    """Hashes and features of each image of ``sources.files.images``, decoded
    once; what fails keeps a row with null hashes, zeros and its error.
    ``trail`` adds the ``details`` of each as ``diagnostics``."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return images.mapInArrow(_measure(edge, faces, scene, trail), from_arrow_schema(_schema(trail)))


def png_bytes(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image as a PNG file."""
    height, width, _ = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.astype(np.uint8).reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
