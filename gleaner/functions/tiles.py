"""Pixel features as Column expressions over an 8x8 tile of grey values.

Integers until the last step, so every engine gets the same numbers.  The
formulas hold for any tile; ``embedding`` vectors of 64 serve as tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import bits

SIDE = 8


def tile(embedding: str = "embedding") -> Column:
    """64 grey values of 0 to 255 from values of about -0.6 to 0.6."""
    scaled = lambda e: (e.cast("double") + F.lit(0.6)) / F.lit(1.2)
    return F.transform(embedding, lambda e: F.round(F.least(F.greatest(scaled(e), F.lit(0.0)), F.lit(1.0)) * F.lit(255.0)).cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def mean_hash(px: Column) -> Column:
    """Bit i: pixel i above the mean of all but the first."""
    total = _sum(F.slice(px, 2, SIDE * SIDE - 1))
    return bits([px[i].cast("long") * (SIDE * SIDE - 1) > total for i in range(SIDE * SIDE)])


def row_hash(px: Column) -> Column:
    """56 bits, 7 a row: pixel above its right neighbour."""
    return bits([px[r * SIDE + c] > px[r * SIDE + c + 1] for r in range(SIDE) for c in range(SIDE - 1)])


def laplacian(px: Column, low: int = 1, high: int = 6) -> Column:
    """Four-neighbour Laplacian of the cells low..high of both axes."""
    cells = [(r, c) for r in range(low, high + 1) for c in range(low, high + 1)]
    return F.array(*[px[(r - 1) * SIDE + c] + px[(r + 1) * SIDE + c] + px[r * SIDE + c - 1] + px[r * SIDE + c + 1] - 4 * px[r * SIDE + c] for r, c in cells])


def variance(values: Column) -> Column:
    """Population variance of whole numbers."""
    n = F.size(values)
    total, squares = _sum(values), _sum(F.transform(values, lambda x: x.cast("long") * x))
    mean = total / n
    return squares / n - mean * mean


def gradient(px: Column) -> Column:
    """Mean gradient magnitude of the inner cells by central differences."""
    cells = [(r, c) for r in range(1, SIDE - 1) for c in range(1, SIDE - 1)]
    d = lambda a, b: (px[a] - px[b]).cast("long")
    square = [d(r * SIDE + c + 1, r * SIDE + c - 1) * d(r * SIDE + c + 1, r * SIDE + c - 1) + d((r + 1) * SIDE + c, (r - 1) * SIDE + c) * d((r + 1) * SIDE + c, (r - 1) * SIDE + c) for r, c in cells]
    return F.aggregate(F.array(*square), F.lit(0.0), lambda a, x: a + F.sqrt(x)) / len(cells)


def histogram(px: Column) -> Column:
    """Counts of the 256 grey values."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.size(F.filter(px, lambda x: x == b)))


def exposure(px: Column) -> Column:
    n = F.size(px)
    mean, var = _sum(px) / n, variance(px)
    tails = F.size(F.filter(px, lambda x: (x <= 5) | (x >= 250))) / n
    off = (mean - 128) / 128
    value = (1 - 0.5 * off * off) * clamp(F.sqrt(F.greatest(var, F.lit(0.0))) / 60, 0.3, 1.0) * (1 - 1.5 * clamp(tails, 0.0, 0.5))
    return F.when(n == 0, F.lit(0.5)).otherwise(clamp(value, 0.0, 1.0))


def last_bin_below(px: Column, percent: int, default: int) -> Column:
    """The last of the 256 bins, empty ones too, up to which at most
    ``percent`` of the values lie; ``default`` if there is none.  It ends just
    below the value at which the share is first exceeded."""
    ordered = F.array_sort(px)
    n = F.size(px)
    # Rank of the first value that lifts the share above percent.
    first = F.floor(n * percent / 100).cast("int")
    value = F.get(ordered, first) - 1
    return F.when(value >= 0, value).otherwise(F.when(first >= n, F.lit(255)).otherwise(F.lit(default)))


def dynamic_range(px: Column) -> Column:
    spread = (last_bin_below(px, 95, 255) - last_bin_below(px, 5, 0)) / 255
    occupied = F.size(F.array_distinct(px)) / 256
    return clamp(0.4 * occupied + 0.6 * clamp(spread, 0.0, 1.0), 0.0, 1.0)


def stretch(px: Column) -> Column:
    """Contrast stretched between the values at which 1 percent of the pixels is reached from either end."""
    ordered = F.array_sort(px)
    n = F.size(px)
    tail = F.greatest(F.floor(n / 100), F.lit(1)).cast("int")
    low, high = F.get(ordered, tail - 1), F.get(ordered, n - tail)
    return F.when(high <= low, px).otherwise(F.transform(px, lambda x: F.floor((F.least(F.greatest(x, low), high) - low) * 255 / (high - low) + 0.5).cast("int")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def features(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, px) and the score features of each vector of 64."""
    from .scoring import blur_confidence, focus

    rows = embeddings.where("vec_id is not null and size(embedding) = 64").select("vec_id", "label", tile().alias("px"))
    px = F.col("px")
    rows = rows.select("*", variance(laplacian(px)).alias("sharpness"), variance(laplacian(px, 2, 5)).alias("face"), gradient(px).alias("expression"), exposure(px).alias("exposure"), dynamic_range(px).alias("dynamic_range"), (_sum(px) / 64 / 255).alias("vibrancy"))
    return rows.select("*", focus(F.col("face") / 100, F.col("sharpness") / 100, F.col("sharpness") / 200).alias("focus"), blur_confidence(F.col("sharpness") / 100).alias("blur"))
