"""Within each group: normalise features, rank members, pick a winner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import gates, weighted

METRICS = ("expression", "face", "exposure", "dynamic_range", "sharpness", "focus", "vibrancy")
NEAR_TIE = 0.02


def normalise(members: DataFrame, scene: str = "portrait", group: str = "group_id") -> DataFrame:
    """Adds raw_score's place ``score`` from features over their group's maximum.

    Whether faces count is told by the group: some member has one.  The gates
    use focus and blur as they are.  Landscapes have weights of their own.
    """
    w = Window.partitionBy(group)
    top = {m: F.greatest(F.max(F.nanvl(F.col(m), F.lit(None))).over(w), F.lit(1e-9)) for m in METRICS}
    some_face = F.max(F.col("face") != 0).over(w)
    rows = members.select("*", *[(F.col(m) / top[m]).alias(f"_{m}") for m in METRICS], some_face.alias("_some_face"))
    value = lambda m: F.col(f"_{m}")
    portrait = F.when(F.col("_some_face"), weighted("portrait", value)).otherwise(weighted("portrait_low", value))
    score = (weighted("landscape", value) if scene == "landscape" else portrait) * gates(F.col("blur"), F.col("focus"))
    return rows.withColumn("score", score).drop("_some_face", *[f"_{m}" for m in METRICS])


def winners(members: DataFrame, group: str = "group_id", member: str = "id") -> DataFrame:
    """(group, winner, by_raw): the best by score, sharpness, focus, the last
    of equals; but if records in raw format are nearly as good in score and in
    sharpness, the best of these by score, sharpness, area, size and path.
    Where nothing is sharp no record is nearly as sharp as the sharpest, whose
    sharpness counts as 1e-9 at least."""
    w = Window.partitionBy(group)
    known = lambda c: F.nanvl(F.col(c), F.lit(None))
    top, sharp = F.max(known("score")).over(w), F.greatest(F.max(known("sharpness")).over(w), F.lit(1e-9))
    near = (top - F.col("score") <= NEAR_TIE * F.abs(top) + 1e-9) & ((sharp - F.col("sharpness")) / sharp <= NEAR_TIE)
    rows = members.withColumn("_raw", F.col("is_raw") & near)
    best = F.max_by(member, F.struct("score", "sharpness", "focus", member))
    raw = F.max_by(member, F.when(F.col("_raw"), F.struct("score", "sharpness", "area", "size", F.split("path", "/"), member)))
    return rows.groupBy(group).agg(best.alias("_best"), raw.alias("_of_raw")).select(group, F.coalesce("_of_raw", "_best").alias("winner"), F.col("_of_raw").isNotNull().alias("by_raw"))


def ranking(members: DataFrame, group: str = "group_id", member: str = "id") -> DataFrame:
    """Adds place, from 1: by falling score, then by id."""
    return members.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), member)))


def close_scores(members: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, n_close): members within 15 percent of the best; two or more ask for another look."""
    top = F.max("score").over(Window.partitionBy(group))
    return members.withColumn("_close", top - F.col("score") < 0.15 * top + 1e-6).groupBy(group).agg(F.count_if("_close").alias("n_close"))
