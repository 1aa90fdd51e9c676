"""A run as JSON lines, one object a record, and the sheet for human labels."""

from __future__ import annotations

import platform
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.hashing import hex16, short_hash
from ..sources.files import extension, folder_label

SCHEMA_VERSION = 1


def _line(kind: str, df: DataFrame, **columns) -> DataFrame:
    whole = F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in columns.items()])
    return df.select(F.lit(kind).alias("type"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("line"))


def run_record(spark: SparkSession, run_id: str, cfg: EngineConfig, total: int, folder: str = "", timestamp: str = "", version: str = "1") -> DataFrame:
    one = spark.range(1)
    label = folder if cfg.full_paths else folder.rstrip("/").rsplit("/", 1)[-1]
    lits = lambda values: {k: F.lit(v) for k, v in values.items()}
    settings = F.struct(*[v.alias(k) for k, v in lits(cfg.snapshot()).items()])
    return _line(
        "run", one, **lits({"schemaVersion": SCHEMA_VERSION, "runId": run_id, "timestamp": timestamp, "appVersion": version, "os": platform.system().lower(), "arch": platform.machine(), "folder": label, "totalImages": total, "maxEdge": cfg.profile.max_edge, "hammingThreshold": cfg.threshold, "confirmDhash": cfg.profile.confirm}), settings=settings
    )


METRICS = {"score": "score", "rawScore": "raw_score", "sharpness": "sharpness", "focus": "focus", "face": "face", "exposure": "exposure", "expression": "expression", "vibrancy": "vibrancy", "dynamicRange": "dynamic_range", "blurConfidence": "blur"}


def image_records(records: DataFrame, run_id: str, root: str = "", full_paths: bool = False) -> DataFrame:
    """records: id, path, content_hash, h1, h2, group_id, size, is_raw,
    preview_w, preview_h, and of the metrics and ``diagnostics`` whatever is
    there; the rest are null."""
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    metrics = F.struct(*[has(c, "double").alias(n) for n, c in METRICS.items()])
    return _line(
        "image", records, runId=F.lit(run_id), imageId=F.col("id"), fileName=F.element_at(F.split("path", "/"), -1), path=folder_label(F.col("path"), root, full_paths), extension=extension(F.col("path")), bytes=F.col("size"), isRawOrDng=has("is_raw", "boolean"), previewW=has("preview_w", "int"), previewH=has("preview_h", "int"),
        contentShort=short_hash(F.col("content_hash")), phash=hex16(F.col("h1")), dhash=hex16(F.col("h2")), groupIndex=F.col("group_id"), metrics=metrics, diagnostics=has("diagnostics", "string"),
    )


def group_records(ranked: DataFrame, pairs: DataFrame, winners: DataFrame, run_id: str = "") -> DataFrame:
    """ranked: (group_id, id, path, score, place); pairs: of pair_distances; winners:
    (group_id, winner, ai_winner)."""
    name = F.element_at(F.split("path", "/"), -1)
    by = F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("imageId"), name.alias("fileName"), F.col("score").alias("normalizedScore"))))
    by = F.transform(by, lambda r: r.dropFields("place"))
    names = F.map_from_entries(F.collect_list(F.struct("id", name)))
    groups = ranked.groupBy("group_id").agg(F.array_sort(F.collect_list("id")).alias("members"), by.alias("ranking"), names.alias("names"))
    pair = F.struct("a", "b", F.col("dist").alias("phashDistance"), F.col("dist2").alias("dhashDistance"), F.col("identical").alias("identicalContent"))
    edges = pairs.groupBy("group_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    rows = groups.join(edges, "group_id").join(winners, "group_id").withColumn("final", F.coalesce("ai_winner", "winner"))
    of = lambda c: F.try_element_at("names", F.col(c))
    return _line(
        "group", rows, runId=F.lit(run_id), groupIndex=F.col("group_id"), size=F.size("members"), members=F.col("members"), pairs=F.col("pairs"), ranking=F.col("ranking"), algoWinner=F.col("winner"), algoWinnerFile=of("winner"), aiWinner=F.col("ai_winner"), aiWinnerFile=of("ai_winner"), finalWinner=F.col("final"), finalWinnerFile=of("final"), decisionPath=decision(), humanKeeper=F.lit(None).cast("long"),
    )


def decision():
    """How a winner came about, from winner and ai_winner."""
    return F.when(F.col("ai_winner").isNull(), "algorithm").when(F.col("ai_winner") == F.col("winner"), "ai-agreed").otherwise("ai-override")


def placement_records(manifest: DataFrame, run_id: str = "") -> DataFrame:
    return _line("placement", manifest, runId=F.lit(run_id), imageId=F.col("id"), outcome=F.col("outcome"), destination=F.col("destination"))


def summary_record(summary: DataFrame, run_id: str = "", timestamp: str = "") -> DataFrame:
    return _line("summary", summary, runId=F.lit(run_id), timestamp=F.lit(timestamp), scanned=F.col("scanned"), duplicateGroups=F.col("groups"), keptGood=F.col("kept"), rejected=F.col("rejected"))


def write_lines(parts: list[DataFrame], path: str) -> None:
    reduce(DataFrame.unionByName, parts).select("line").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The records of one kind, with their fields as columns."""
    parsed = F.from_json("value", f"type string, {schema}")
    return spark.read.text(path).select(parsed.alias("r")).where(F.col("r.type") == kind).select("r.*")


def label_sheet(members: DataFrame, winners: DataFrame) -> DataFrame:
    """One row a group with three blank columns; members: (group_id, id, file_name)."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("id", "file_name"))), lambda x: x["file_name"])
    rows = members.groupBy("group_id").agg(F.array_join(names, " | ").alias("files_in_group"))
    picked = winners.join(members.select(F.col("id").alias("winner"), F.col("file_name").alias("picked")), "winner").select("group_id", "picked")
    return rows.join(picked, "group_id").select(F.col("group_id").alias("group"), "files_in_group", "picked", F.lit("").alias("your_pick"), F.lit("").alias("your_reason"), F.lit("").alias("confidence_1_to_5"))


def write_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumn("files", F.split("files_in_group", r" \| "))


def agreement(sheet: DataFrame) -> DataFrame:
    """(labelled, agreed) over the rows in which somebody picked."""
    asked = sheet.where("your_pick is not null and your_pick <> ''")
    return asked.agg(F.count("*").alias("labelled"), F.count_if(F.col("your_pick") == F.col("picked")).alias("agreed"))


def to_prune(files: DataFrame, keep: int = 20, name: str = "name") -> DataFrame:
    """The oldest run files by name, so many that one more makes ``keep``."""
    runs = files.where(F.col(name).startswith("run-") & F.col(name).endswith(".jsonl"))
    newest = runs.select(name).distinct().orderBy(F.desc(name)).limit(keep - 1)
    return runs.join(F.broadcast(newest), name, "left_anti")


def label_name(name: str):
    return F.regexp_replace(name, r"^run-(.*)\.jsonl$", "labels-$1.csv")
