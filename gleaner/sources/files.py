"""Files as rows: listing, extensions, embedded previews, decoded images."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, OUTPUT_FOLDERS, RAW_EXTENSIONS
from ..tables import shared_folder, stored


def file_name(path: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("image"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def is_supported(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return extension(path).isin(*[e.lower() for e in extensions])


def is_output(relative: Column, folders: tuple[str, ...] = OUTPUT_FOLDERS) -> Column:
    """Whether some component of a path below the root is an output folder."""
    return F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(f) for f in folders]))


def component_order(path: Column) -> Column:
    """Sorts paths component by component, not byte by byte."""
    return F.split(path, "/")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, subfolders: bool = True, content: bool = False) -> DataFrame:
    """(path, size, mtime_secs[, content]) of the files below a folder, without
    output folders and other extensions.  content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(subfolders).lower()).load(root)
    relative = F.substring_index(F.col("path"), root.rstrip("/").removeprefix("file://"), -1)
    files = files.where(is_supported(F.col("path"), extensions) & ~is_output(relative))
    kept = [F.col("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_secs")]
    return files.select(*kept, *([F.col("content")] if content else []))


def hashed(files: DataFrame) -> DataFrame:
    """files with content, plus content_hash and error; an unreadable file has a
    null content and an error, and ``valid`` and ``failed`` part the two."""
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("error", F.when(F.col("content").isNull(), "unreadable"))


def valid(records: DataFrame) -> DataFrame:
    return records.where("error is null")


def failed(records: DataFrame) -> DataFrame:
    return records.where("error is not null")


def numbered(records: DataFrame, path: str = "path") -> DataFrame:
    """Adds image_id, dense from 0 in component order of the paths.

    A range sort and a count per partition; no task sees more than its range."""
    from pyspark.sql import Window

    key = component_order(F.col(path))
    placed = records.repartitionByRange(max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key).withColumn("_n", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftrightunsigned("_n", 33)).withColumn("_row", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n"), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return placed.join(sizes, "_part").withColumn("image_id", F.col("_before") + F.col("_row")).drop("_part", "_row", "_size", "_before")


def largest_jpeg(data: bytes, least: int = 128) -> bytes | None:
    """The longest stretch from a start to the next end mark, the first of
    equals, longer than ``least`` bytes; the search goes on after each end."""
    best, at = None, 0
    while (start := data.find(b"\xff\xd8", at)) >= 0:
        end = data.find(b"\xff\xd9", start + 2)
        if end < 0:
            break
        piece = data[start : end + 2]
        if len(piece) > least and (best is None or len(piece) > len(best)):
            best = piece
        at = end + 2
    return best


#: Extensions that the JVM decodes, and those that nothing here does.
DECODED = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif")
UNDECODED = ("webp", "heic", "heif")
#: An embedded preview of more bytes than this is taken before a converter is asked.
GOOD_PREVIEW = 32_768


def raw_preview(content: bytes | None, convert: Callable[[bytes], bytes | None] | None = None) -> bytes | None:
    """The JPEG that stands for a raw file: its largest embedded one if it has
    over 32,768 bytes, else what ``convert`` makes of the file, else the largest
    embedded one of whatever size; null if there is none."""
    if content is None:
        return None
    embedded = largest_jpeg(content)
    if embedded is not None and len(embedded) > GOOD_PREVIEW:
        return embedded
    return (convert(content) if convert else None) or embedded


def _previews(convert, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = batch.column("path").to_pylist(), (raw_preview(c.as_py(), convert) for c in batch.column("content"))
            if folder is None:
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.binary())], ["path", "preview"])
                continue
            system, root = fs.FileSystem.from_uri(folder)
            system.create_dir(root, recursive=True)
            names = []
            for path, preview in zip(paths, found, strict=True):
                names.append(None if preview is None else hashlib.sha256(path.encode()).hexdigest() + ".jpg")
                if preview is not None:
                    with system.open_output_stream(f"{root}/{names[-1]}") as out:
                        out.write(preview)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.string())], ["path", "name"])

    return run


def embedded_previews(files: DataFrame, convert: Callable[[bytes], bytes | None] | None = None) -> DataFrame:
    """(path, preview): the JPEG that stands for each raw file, null if none."""
    return files.select("path", "content").mapInArrow(_previews(convert, None), "path string, preview binary")


def _glob(extensions: tuple[str, ...]) -> str:
    """A pattern of file names, whatever the case of their extension."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(map(either, extensions)) + "}"


def _decoded(spark: SparkSession, root: str, subfolders: bool, glob: str) -> DataFrame:
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(subfolders).lower()).option("pathGlobFilter", glob).load(root)
    i = F.col("image")
    bad = i["width"] <= 0
    return read.select(
        F.regexp_replace(i["origin"], "^file:///", "file:/").alias("path"),
        F.when(bad, 0).otherwise(i["width"]).alias("width"),
        F.when(bad, 0).otherwise(i["height"]).alias("height"),
        i["nChannels"].alias("channels"),
        F.when(~bad, i["data"]).alias("pixels"),
        F.when(bad, F.lit("not decodable")).alias("error"),
    )


def images(spark: SparkSession, root: str, subfolders: bool = True, extensions: tuple[str, ...] = EXTENSIONS, convert: Callable[[bytes], bytes | None] | None = None) -> DataFrame:
    """(path, width, height, channels, pixels, error) of the images below a
    folder, by extension: bmp, gif, jpeg, png and tiff are decoded, raw files
    by the JPEG that stands for them (``raw_preview``), which is written to the
    shared folder for the JVM to decode.  What cannot be decoded (webp, heic
    and raw files without a preview among it) keeps a row with an error."""
    wanted = {e.lower() for e in extensions}
    of = lambda kinds: tuple(e for e in kinds if e in wanted)
    relative = F.substring_index(F.col("path"), root.rstrip("/").removeprefix("file://"), -1)
    nothing = [F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(0).alias("channels"), F.lit(None).cast("binary").alias("pixels")]
    parts = []
    if of(DECODED):
        parts.append(_decoded(spark, root, subfolders, _glob(of(DECODED))).where(~is_output(relative)))
    if of(UNDECODED):
        parts.append(scan(spark, root, of(UNDECODED), subfolders).select("path", *nothing, F.lit("no decoder").alias("error")))
    if of(RAW_EXTENSIONS):
        folder = f"{shared_folder(spark)}/gleaner/{uuid.uuid4().hex}/previews"
        raw = scan(spark, root, of(RAW_EXTENSIONS), subfolders, content=True).select("path", "content")
        named = stored(raw.mapInArrow(_previews(convert, folder), "path string, name string"), "preview_names")
        parts.append(named.where("name is null").select("path", *nothing, F.lit("no embedded preview").alias("error")))
        if not named.where("name is not null").isEmpty():
            previews = _decoded(spark, folder, False, "*.jpg").withColumn("name", F.element_at(F.split("path", "/"), -1)).drop("path")
            parts.append(named.join(previews, "name").select("path", "width", "height", "channels", "pixels", "error"))
    if not parts:
        return spark.createDataFrame([], "path string, width int, height int, channels int, pixels binary, error string")
    return reduce(DataFrame.unionByName, parts)


def folder_label(path: Column, root: str, full: bool = False) -> Column:
    """A path as telemetry names it: below its root, or the file's name if it
    is not there; as it is where ``full`` or where no root is named."""
    base = root.rstrip("/").removeprefix("file://") + "/" if root else ""
    plain = F.regexp_replace(path, "^file:(//)?", "")
    return plain if full else F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split(plain, "/"), -1))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, errors = [], []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            try:
                system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with system.open_input_stream(where) as file:
                    while block := file.read(1 << 20):
                        digest.update(block)
                hashes.append(digest.hexdigest())
                errors.append(None)
            except (OSError, ValueError) as e:
                hashes.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], ["path", "content_hash", "error"])


def content_hashes(paths: DataFrame) -> DataFrame:
    """(path, content_hash, error) of the files at ``path``, read block by
    block, so only files that no memo knows need be read and none is held whole."""
    return paths.select("path").mapInArrow(_hash, "path string, content_hash string, error string")


def documents_as_records(documents: DataFrame) -> DataFrame:
    """(id, path, content_hash, size) of a table of texts."""
    return documents.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
