"""Shards that each match the mixture of sources, by proportional stratified
interleaving.

Rows are shuffled within their source by a seeded hash and ranked; the rank
over the source's count places them between 0 and 1; sorting by that place
interleaves the sources in proportion, and equal cuts of the order are shards.
Both ranks come from range-sorted tables, so a source of a third of all rows
is sorted by many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

_NUMBER_BITS = 33  # monotonically_increasing_id: partition above, row below


def _numbered(df: DataFrame, order: list[Column], partitions: int, name: str) -> DataFrame:
    """Range-sorts ``df`` and adds part and row, the place in its partition."""
    sorted_ = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    sorted_ = sorted_.withColumn("number", number)
    return stored(
        sorted_.withColumn("part", F.shiftrightunsigned("number", _NUMBER_BITS)).withColumn("row", F.col("number").bitwiseAND(F.lit((1 << _NUMBER_BITS) - 1))).drop("number"),
        name,
    )


def interleave(documents: DataFrame, shards: int = 40, seed: int = 17, rows_per_range: int = 1_000_000) -> DataFrame:
    """One row per row of ``documents``: doc_id, size (UTF-8 bytes of the text
    plus 16), text_crc32, law ('rows': counts at most one apart), shard, slot
    (gapless from 0) and grown_shard (null).

    Null texts have no bytes.  Rows without a source are a source of their own,
    rows without a doc_id are shuffled like others, and rows equal in all these
    columns change places freely.  With fewer rows than shards, some shards are
    empty.  Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Sixty bits of a hash that every engine has.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("shuffle", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    rows = stored(rows, "rows")
    total = rows.count()
    partitions = max(1, -(-total // rows_per_range), min(total // 2_000, rows.sparkSession.sparkContext.defaultParallelism))
    ties = ["shuffle", "doc_id", "text_crc32", "size"]

    placed = _numbered(rows, [F.col(c) for c in ("source", *ties)], partitions, "by_source")
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    sizes = counts.groupBy("source").agg(F.sum("n").alias("of"))
    counts = counts.select("source", "part", "before").join(sizes, "source")
    ranked = placed.join(counts, ["source", "part"]).withColumn("place", (F.col("before") + F.col("row") + 0.5) / F.col("of"))

    mixed = _numbered(ranked.drop("part", "row", "before", "of"), [F.col(c) for c in ("place", "source", *ties)], partitions, "mixed")
    parts = mixed.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition, so this window is small however many rows there are.
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = mixed.join(parts.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("row"))
    cut = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div {max(total, 1)}"))
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - (shard * {total} + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
