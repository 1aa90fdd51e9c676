"""A whole run over a folder of images: from files to what is kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OUTPUT_FOLDERS, EngineConfig
from ..functions import pixels
from ..functions.scoring import raw_score
from ..sources import files
from ..tables import stored
from . import cache, manifest, neardup, ranking, telemetry

#: Given the scored members of all groups and their winners (group_id, winner),
#: returns (group_id, ai_winner): a model's choice where it makes one.
Reranker = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    """What a run finds, as tables.

    records: one row a file with hashes, features and group_id (null if alone).
    members: the rows of groups with their scores and place.
    winners: (group_id, winner, by_raw, ai_winner, final).
    placements: records with outcome, destination and file_name.
    summary: the counters.  failed: files that could not be read.
    memo: what is to be saved so that the next run need not hash again."""

    run_id: str
    root: str
    config: EngineConfig
    records: DataFrame
    members: DataFrame
    winners: DataFrame
    placements: DataFrame
    summary: DataFrame
    failed: DataFrame
    memo: DataFrame

    def telemetry(self) -> list[DataFrame]:
        """The run's JSON lines, kind by kind."""
        spark, full = self.records.sparkSession, self.config.full_paths
        scores = self.members.select("id", "score")
        images = self.records.join(scores, "id", "left")
        pairs = neardup.pair_distances(self.records.where("group_id is not null").select("id", "group_id", "h1", "h2", "content_hash"))
        chosen = self.winners.select("group_id", "winner", "ai_winner")
        return [
            telemetry.run_record(spark, self.run_id, self.config, self.records.count(), self.root),
            telemetry.image_records(images, self.run_id, self.root, full),
            telemetry.group_records(self.members, pairs, chosen, self.run_id),
            telemetry.placement_records(self.placements, self.run_id),
            telemetry.summary_record(self.summary, self.run_id),
        ]

    def label_sheet(self) -> DataFrame:
        named = self.members.select("group_id", "id", F.element_at(F.split("path", "/"), -1).alias("file_name"))
        return telemetry.label_sheet(named, self.winners.select("group_id", F.col("final").alias("winner")))


def asks_again(members: DataFrame, sees: bool) -> DataFrame:
    """(group_id) of the groups a model is asked about: all if it sees images,
    else those of two or more close scores."""
    return ranking.close_scores(members).where(F.lit(sees) | (F.col("n_close") >= 2)).select("group_id")


def fingerprinted(spark: SparkSession, root: str, cfg: EngineConfig, memo: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(records, failed): the files below ``root`` with content hash, image
    hashes and features, numbered in path order; and those that cannot be read.

    Only files that the memo does not know by path, size and second are read
    for their content hash.  A file that cannot be decoded stays, with null
    hashes and zeros."""
    found = files.scan(spark, root, cfg.extensions, cfg.include_subfolders)
    known = cache.look_up(found, memo) if memo is not None else found.withColumn("content_hash", F.lit(None).cast("string"))
    known = stored(known, "files")
    read = files.content_hashes(known.where("content_hash is null")).withColumnRenamed("content_hash", "read_hash")
    hashed = stored(known.join(read, "path", "left").select("path", "size", "mtime_secs", F.coalesce("content_hash", "read_hash").alias("content_hash"), "error"), "hashed")
    fine, failed = hashed.where("content_hash is not null").drop("error"), hashed.where("content_hash is null").select("path", "error")
    seen = pixels.measured(files.images(spark, root, cfg.include_subfolders, cfg.extensions), cfg.profile.max_edge, cfg.profile.faces, cfg.scene.value, cfg.telemetry)
    branch = "landscape" if cfg.scene.value == "landscape" else "portrait" if cfg.profile.faces else "portrait_low"
    seen = seen.withColumn("raw_score", raw_score(branch)).withColumnRenamed("error", "decode_error")
    if not cfg.profile.confirm:
        seen = seen.withColumn("h2", F.lit(None).cast("long"))
    numbered = files.numbered(fine).withColumnRenamed("image_id", "id")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("int" if c.startswith("preview") else "double")) for c in ("preview_w", "preview_h", "raw_score", *pixels.FEATURES)}
    return stored(numbered.join(seen, "path", "left").withColumns(zero).withColumn("is_raw", files.is_raw(F.col("path"))), "fingerprints"), failed


def run(spark: SparkSession, root: str, cfg: EngineConfig | None = None, memo: DataFrame | None = None, reranker: Reranker | None = None, run_id: str | None = None) -> Run:
    """Finds exact and near duplicates among the images below ``root``, scores
    the members of each group against each other and names the one to keep.

    Nothing is moved: ``manifest.place_files`` carries ``placements`` out.  An
    empty folder gives empty tables and zeros.  A reranker may overrule
    winners, if the settings allow it."""
    cfg = cfg or EngineConfig()
    records, failed = fingerprinted(spark, root, cfg, memo)
    groups = neardup.cluster(records.select("id", "content_hash", "h1", "h2"), cfg.threshold, cfg.profile.confirm)
    records = stored(records.join(groups, "id", "left"), "grouped")
    groups = records.where("group_id is not null").select("id", "group_id")
    scored = ranking.normalise(records.where("group_id is not null").withColumn("area", F.col("preview_w").cast("long") * F.col("preview_h")), cfg.scene.value)
    members = stored(ranking.ranking(scored), "members")
    winners = ranking.winners(members)
    if reranker is not None and cfg.enable_ai_features and cfg.use_ai_for_dedup:
        winners = winners.join(reranker(members, winners).select("group_id", "ai_winner"), "group_id", "left")
    else:
        winners = winners.withColumn("ai_winner", F.lit(None).cast("long"))
    winners = stored(winners.withColumn("final", F.coalesce("ai_winner", "winner")), "winners")
    placed = manifest.outcomes(records.drop("group_id"), groups, winners.select("group_id", F.col("final").alias("winner")))
    kept = F.col("outcome") != "rejected"
    placed = placed.withColumns({"destination": F.when(kept, F.lit(OUTPUT_FOLDERS[0])).otherwise(F.lit(OUTPUT_FOLDERS[1])), "name": F.element_at(F.split("path", "/"), -1)})
    placed = stored(manifest.destination_names(placed, "name", "id").drop("name"), "placements")
    counted = manifest.summary(placed).withColumn("ai_reranked", F.lit(winners.where("ai_winner <> winner").count()))
    known = records.select("path", "size", "mtime_secs", "content_hash", "h1", "h2")
    return Run(run_id or uuid.uuid4().hex, root, cfg, records, members, winners, placed, counted, failed, known)
