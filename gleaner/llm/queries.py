"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, jaccard, licenses, packing, pii, quality, sharding, substrings, topk
from .runtime import table


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("sanitised")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no paths, so a document's is source/lang/doc_id.txt."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licenses.scan_licenses(files).withColumnRenamed("file_id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pack_sequences, op2_decontaminate, op3_quality, op4_suffix_dedup, op5_personal_data, op6_top_k, op7_jaccard_join, op8_extract, op9_shards, op10_licenses, pipeline)}

#: DuckDB SQL where it can express the operator.
ORACLE_SQL: dict[str, str] = {
    # CRC-32 byte by byte, by the table of its rule.
    "op9_shards": """
        WITH t AS (
            SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
        ), b AS (
            SELECT doc_id, coalesce('=' || source, '') AS source, octet_length(encode(coalesce(text, ''))) AS n,
                list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
        ), c AS (
            SELECT doc_id, source, n + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, t
        ), s AS (
            SELECT *, ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)), 1, 15))::BIGINT AS shuffle FROM c
        ), p AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffle, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS place, count(*) OVER () AS total FROM s
        ), r AS (
            SELECT *, row_number() OVER (ORDER BY place, source, shuffle, doc_id, text_crc32, size) - 1 AS rank FROM p
        ) SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(rank * 40 // total AS INTEGER) AS shard, rank - (rank * 40 // total * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r""",
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
