"""Scores from features: piecewise confidences, focus, weighted sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the score, by branch.
WEIGHTS = {
    "portrait": {"expression": 0.25, "face": 0.15, "exposure": 0.15, "dynamic_range": 0.10, "sharpness": 0.10, "sharp_focus": 0.10, "vibrancy": 0.15},
    "portrait_low": {"expression": 0.30, "exposure": 0.20, "dynamic_range": 0.10, "sharpness": 0.15, "sharp_focus": 0.10, "vibrancy": 0.15},
    "landscape": {"dynamic_range": 0.25, "exposure": 0.20, "sharpness": 0.20, "sharp_focus": 0.15, "vibrancy": 0.20},
}


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def blur_confidence(sharpness: Column) -> Column:
    """1 for sharp frames, falling to 0; flat at 0.3 in between."""
    return F.when(sharpness >= 60, F.lit(1.0)).when(sharpness >= 20, clamp((sharpness - 20) / 40, 0.3, 1.0)).otherwise(sharpness / 20 * 0.3)


def subject_blur(sharpness: Column, subject: Column) -> Column:
    own = F.when(subject >= 180, F.lit(1.0)).when(subject >= 50, 0.3 + (subject - 50) / 130 * 0.7).otherwise(subject / 50 * 0.3)
    return F.least(blur_confidence(sharpness), own)


def focus(roi: Column, centre: Column, border: Column) -> Column:
    """Harmonic mean of subject and centre, in itself and against the border."""
    h = 2 * roi * centre / (roi + centre + 1e-6)
    return 0.75 * clamp((h - 12) / 108, 0.0, 1.0) + 0.25 * clamp((h / (border + 1e-6) - 0.35) / 1.15, 0.0, 1.0)


def weighted(branch: str, value) -> Column:
    """Sum of weights times ``value(feature)``; sharp_focus is the product of two."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS[branch].items():
        x = value("sharpness") * value("focus") if name == "sharp_focus" else value(name)
        total = total + weight * x
    return total


def gates(blur: Column, focus: Column) -> Column:
    return clamp(blur, 0.05, 1.0) * clamp(focus, 0.05, 1.0)


def raw_score(branch: str) -> Column:
    return weighted(branch, F.col) * gates(F.col("blur"), F.col("focus"))
