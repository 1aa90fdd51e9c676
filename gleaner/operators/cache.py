"""Memo of content hashes: what a file's path, size and time in seconds know."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, size long, mtime_secs long, content_hash string, h1 long, h2 long"
KEY = ["path", "size", "mtime_secs"]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Whatever cannot be read is an empty memo."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def look_up(files: DataFrame, memo: DataFrame) -> DataFrame:
    """files (path, size, mtime_secs) with the hash that is known, null where it is to be made."""
    return files.join(memo.select(*KEY, "content_hash"), KEY, "left")


def misses(files: DataFrame, memo: DataFrame) -> DataFrame:
    return files.join(memo, KEY, "left_anti")


def upsert(memo: DataFrame, new: DataFrame) -> DataFrame:
    """One row a path, the new one first; of several new ones the latest."""
    w = Window.partitionBy("path").orderBy(F.desc("mtime_secs"), F.desc("size"), "content_hash")
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return memo.join(last, "path", "left_anti").unionByName(last)


def save(memo: DataFrame, path: str) -> None:
    memo.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Leaves an empty memo."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
