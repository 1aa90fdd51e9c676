"""What happens to each record: outcome, name at its destination, counters."""

from __future__ import annotations

import shutil
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import OUTPUT_FOLDERS


def outcomes(records: DataFrame, groups: DataFrame, winners: DataFrame, record_id: str = "id") -> DataFrame:
    """records with outcome 'kept' (winners), 'rejected' (others of a group) or
    'unique' (in no group), and group_id (null for the last).

    groups: (id, group_id); winners: (group_id, winner)."""
    placed = groups.join(winners.select("group_id", "winner"), "group_id").select(F.col("id").alias(record_id), "group_id", F.when(F.col("id") == F.col("winner"), "kept").otherwise("rejected").alias("outcome"))
    return records.join(placed, record_id, "left").withColumn("outcome", F.coalesce("outcome", F.lit("unique")))


def summary(manifest: DataFrame) -> DataFrame:
    """One row of counters, zeros for an empty manifest; uniques are kept too."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return manifest.agg(
        F.count("*").alias("scanned"), F.count_distinct("group_id").alias("groups"), (count("kept") + count("unique")).alias("kept"), count("rejected").alias("rejected"), count("unique").alias("unique")
    )


#: Stem and extension of a file name; a leading point begins no extension.
STEM, SUFFIX = r"^(.+?)(\.[^.]*)?$", r"^(.+?)(?: \([0-9]+\))+$"


def _free_names(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (family, folder, name, order...) sorted by family and order: the
    first free of name, 'stem (2).ext', ... for each, family by family."""
    family, taken, following = None, set(), {}
    for batch in rows:
        out = []
        for key, name, stem, ext in zip(*(batch.column(c).to_pylist() for c in ("_family", "_name", "_stem", "_ext")), strict=True):
            if key != family:
                family, taken, following = key, set(), {}
            n = following.get(name, 1)
            while (candidate := name if n == 1 else f"{stem} ({n}){ext}") in taken:
                n += 1
            following[name] = n + 1
            taken.add(candidate)
            out.append(candidate)
        yield batch.append_column("file_name", pa.array(out, pa.string()))


def destination_names(manifest: DataFrame, name: str, order: str, folder: str = "destination") -> DataFrame:
    """Adds file_name: ``name``, or the first of 'stem (2).ext', 'stem (3).ext', ...
    that no row before it in its folder has got, by ``order``.

    Names can only meet within a family, those of one folder that are alike but
    for ' (n)' at the end of the stem.  In families of one name, which are nearly
    all, the n-th row gets n, by a window; the others are walked through in
    order, a family in one task, as a stream that holds the names given so far."""
    private = lambda n: f"_{n}"
    stem, ext = F.regexp_extract(name, STEM, 1), F.regexp_extract(name, STEM, 2)
    base = F.when(stem.rlike(SUFFIX), F.regexp_extract(stem, SUFFIX, 1)).otherwise(stem)
    keyed = manifest.withColumns({private("stem"): stem, private("ext"): ext, private("name"): F.col(name), private("family"): F.to_json(F.struct(F.col(folder).alias("f"), base.alias("b"), ext.alias("e")))})
    names = Window.partitionBy("_family")
    keyed = keyed.withColumn("_mixed", F.min("_name").over(names) != F.max("_name").over(names))
    nth = F.row_number().over(Window.partitionBy("_family").orderBy(order))
    alone = keyed.where("not coalesce(_mixed, false)").withColumn("_n", nth)
    alone = alone.withColumn("file_name", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat("_stem", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), "_ext"))).drop("_n")
    mixed = keyed.where("_mixed").repartition("_family").sortWithinPartitions("_family", order)
    mixed = mixed.mapInArrow(_free_names, T.StructType([*mixed.schema.fields, T.StructField("file_name", T.StringType())]))
    return alone.unionByName(mixed).drop("_stem", "_ext", "_name", "_family", "_mixed")


def unique_name(folder: Path, name: str) -> Path:
    """The first free of name, 'stem (2).ext', 'stem (3).ext', ... in a folder."""
    path = Path(name)
    candidate, n = folder / name, 2
    while candidate.exists():
        candidate, n = folder / f"{path.stem} ({n}){path.suffix}", n + 1
    return candidate


def place_file(source: str, folder: str, action: str = "copy") -> str:
    """Copies or moves one file under a free name; returns where it is."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = unique_name(Path(folder), Path(source).name)
    if action == "move":
        try:
            Path(source).rename(target)
        except OSError:
            shutil.copy2(source, target)
            Path(source).unlink()
    else:
        shutil.copy2(source, target)
    return str(target)


def place_files(manifest: DataFrame, root: str, action: str = "copy") -> list[tuple[str, str | None, str | None]]:
    """Carries a manifest (path, outcome) out on a local file system, streaming
    it through the driver in path order so that names are free of races:
    (path, target, error).  The manifest, not this, is the distributed result."""
    folder = {"kept": OUTPUT_FOLDERS[0], "unique": OUTPUT_FOLDERS[0], "rejected": OUTPUT_FOLDERS[1]}
    done = []
    for row in manifest.select("path", "outcome").orderBy("path").toLocalIterator():
        source = row["path"].removeprefix("file://").removeprefix("file:")
        try:
            done.append((row["path"], place_file(source, f"{root}/{folder[row['outcome']]}", action), None))
        except OSError as e:
            done.append((row["path"], None, str(e)))
    return done


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").partitionBy("outcome").parquet(path)


def next_version(existing: DataFrame, base: str, most: int = 9_999) -> DataFrame:
    """(name): base, or the first free of base-2, base-3, ...; existing: (name)."""
    spark = existing.sparkSession
    n = F.when(F.col("name") == base, F.lit(1)).otherwise(F.regexp_extract("name", f"^{base}-([0-9]+)$", 1).try_cast("int"))
    taken = existing.select(n.alias("n")).where("n is not null").distinct()
    free = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n")).join(taken, "n", "left_anti").agg(F.min("n").alias("n"))
    return free.select(F.when(F.col("n") == 1, F.lit(base)).otherwise(F.concat(F.lit(f"{base}-"), F.col("n").cast("string"))).alias("name"))
