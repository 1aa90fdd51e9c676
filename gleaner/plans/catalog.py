"""The registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import hashing, scoring, tiles
from ..operators import cache, editplan, eventlog, manifest, neardup, ranking, telemetry
from ..sources import files
from ..tables import stored, table
from . import images
from .registry import ORACLE_SQL, QUERIES, Query, r6, register

__all__ = ["ORACLE_SQL", "QUERIES"]


# --- documents: exact groups ------------------------------------------------

_EXACT = "x AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS group_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL)"


def _exact(spark, sf):
    return neardup.exact_groups(table(spark, sf, "documents"), "doc_id", "text")


@register("exact_dup_groups", f"WITH {_EXACT} SELECT group_id, count(*) AS group_size, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM x WHERE n >= 2 GROUP BY group_id")
def exact_dup_groups(spark, sf):
    members = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return _exact(spark, sf).groupBy("group_id").agg(F.count("*").alias("group_size"), members.alias("members"))


@register("exact_dup_winner", f"WITH {_EXACT} SELECT group_id, max(doc_id) AS winner, max(n_chars) AS n_chars FROM x WHERE n >= 2 GROUP BY group_id")
def exact_dup_winner(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return _exact(spark, sf).join(docs, "doc_id").groupBy("group_id").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("winner"), F.max("n_chars").alias("n_chars"))


@register("unique_rows_anti", f"WITH {_EXACT} SELECT doc_id, source FROM x WHERE n = 1")
def unique_rows_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(_exact(spark, sf), "doc_id", "left_anti")


def _manifest(spark, sf):
    groups = _exact(spark, sf).select(F.col("doc_id").alias("id"), "group_id")
    winners = groups.groupBy("group_id").agg(F.max("id").alias("winner"))
    return manifest.outcomes(table(spark, sf, "documents").select("doc_id", "source", "lang"), groups, winners, "doc_id")


_OUTCOME = f"{_EXACT}, m AS (SELECT *, CASE WHEN n = 1 THEN 'unique' WHEN doc_id = max(doc_id) OVER (PARTITION BY group_id) THEN 'kept' ELSE 'rejected' END AS outcome FROM x)"


@register("outcome_manifest", f"WITH {_OUTCOME} SELECT doc_id, CASE WHEN n > 1 THEN group_id ELSE -1 END AS group_id, outcome FROM m")
def outcome_manifest(spark, sf):
    return _manifest(spark, sf).select("doc_id", F.coalesce("group_id", F.lit(-1)).alias("group_id"), "outcome")


@register(
    "run_summary",
    f"WITH {_OUTCOME} SELECT count(*) AS scanned, count(DISTINCT CASE WHEN n > 1 THEN group_id END) AS groups, count(*) FILTER (WHERE outcome <> 'rejected') AS kept, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'unique') AS \"unique\" FROM m",
)
def run_summary(spark, sf):
    return manifest.summary(_manifest(spark, sf))


@register(
    "dest_name_probe",
    """WITH RECURSIVE o AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'a (2).txt' ELSE 'a.txt' END AS name, row_number() OVER (PARTITION BY lang, doc_id // 64 ORDER BY doc_id) AS n, doc_id // 64 AS b FROM documents),
    t AS (SELECT lang, b, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS file_name, CAST([] AS VARCHAR[]) AS taken FROM o GROUP BY lang, b
        UNION ALL SELECT f.lang, f.b, f.n, f.doc_id, f.free, list_append(f.taken, f.free) FROM (SELECT o.lang, o.b, o.n, o.doc_id, t.taken, CASE WHEN NOT list_contains(t.taken, o.name) THEN o.name ELSE (SELECT replace(o.name, '.txt', '') || ' (' || CAST(min(i) AS VARCHAR) || ').txt' FROM range(2, 200) r(i) WHERE NOT list_contains(t.taken, replace(o.name, '.txt', '') || ' (' || CAST(i AS VARCHAR) || ').txt')) END AS free FROM t JOIN o ON o.lang = t.lang AND o.b = t.b AND o.n = t.n + 1) f)
    SELECT doc_id, file_name FROM t WHERE n > 0""",
)
def dest_name_probe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", F.floor(F.col("doc_id") / 64).cast("string")).alias("destination"), F.when(F.col("doc_id") % 4 == 0, "a (2).txt").otherwise("a.txt").alias("name"))
    return manifest.destination_names(docs, "name", "doc_id").select("doc_id", "file_name")


@register(
    "dest_name_suffix",
    "SELECT doc_id, lang AS destination, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1 THEN source || '.txt' ELSE source || ' (' || CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS VARCHAR) || ').txt' END AS file_name FROM documents",
)
def dest_name_suffix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("destination"), F.concat("source", F.lit(".txt")).alias("name"))
    return manifest.destination_names(docs, "name", "doc_id").select("doc_id", "destination", "file_name")


def _sheet(spark, sf):
    members = _exact(spark, sf).select("group_id", F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"))
    return telemetry.label_sheet(members, members.groupBy("group_id").agg(F.max("id").alias("winner")))


@register(
    "label_sheet",
    f"WITH {_EXACT} SELECT group_id AS \"group\", string_agg('d' || CAST(doc_id AS VARCHAR) || '.txt', ' | ' ORDER BY doc_id) AS files_in_group, 'd' || CAST(max(doc_id) AS VARCHAR) || '.txt' AS picked, '' AS your_pick, '' AS your_reason, '' AS confidence_1_to_5 FROM x WHERE n >= 2 GROUP BY group_id",
)
def label_sheet(spark, sf):
    return _sheet(spark, sf)


@register(
    "label_agreement",
    f"WITH {_OUTCOME}, l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT outcome, count(*) AS labelled, count(*) FILTER (WHERE (quality = 1) = (outcome <> 'rejected')) AS agreed FROM m JOIN l USING (doc_id) GROUP BY outcome",
)
def label_agreement(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = _manifest(spark, sf).join(labels, "doc_id")
    return rows.groupBy("outcome").agg(F.count("*").alias("labelled"), F.count_if((F.col("quality") == 1) == (F.col("outcome") != "rejected")).alias("agreed"))


# --- documents: fingerprints, pairs, clusters --------------------------------


def _vote_sql(x: str) -> str:
    return " + ".join(f"CASE WHEN sum(CASE WHEN ({x} >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))


_FP = f"""w AS (SELECT doc_id, n_chars, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents WHERE doc_id IS NOT NULL),
    h AS (SELECT doc_id, n_chars, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS x, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS y FROM w WHERE w <> ''),
    fp AS MATERIALIZED (SELECT doc_id, n_chars, {_vote_sql("x")} AS h1, {_vote_sql("y")} AS h2 FROM h GROUP BY doc_id, n_chars)"""


def _edges_sql(threshold: int, confirm: bool = False) -> str:
    more = f" AND (a.n_chars < 200 OR b.n_chars < 200 OR bit_count(xor(a.h2, b.h2)) <= {threshold + 4})" if confirm else ""
    return f"e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.h1, b.h1)) AS INTEGER) AS dist FROM fp a JOIN fp b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.h1, b.h1)) <= {threshold}{more})"


def reach_sql() -> str:
    return "sym AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, sym.y FROM r JOIN sym ON r.y = sym.x), comp AS MATERIALIZED (SELECT x AS node, least(x, min(y)) AS c FROM r GROUP BY x)"


_REACH = reach_sql()


def linkage_of() -> str:
    """sized(id, group_id, n): greedy complete linkage over the edges e, whose components are comp."""
    near = "(s.ls[q.i] = s.ls[num.i] AND s.ls[q.j] = s.ls[num.j]) OR (s.ls[q.i] = s.ls[num.j] AND s.ls[q.j] = s.ls[num.i])"
    size = lambda i: f"len(list_filter(s.ls, lambda l: l = s.ls[num.{i}]))"
    return f"""ms AS MATERIALIZED (SELECT c, list(node ORDER BY node) AS m FROM comp GROUP BY c),
        num AS MATERIALIZED (SELECT comp.c, row_number() OVER (PARTITION BY comp.c ORDER BY e.dist, e.a, e.b) AS k, list_position(ms.m, e.a) AS i, list_position(ms.m, e.b) AS j FROM e JOIN comp ON comp.node = e.a JOIN ms ON ms.c = comp.c),
        near AS MATERIALIZED (SELECT c, list({{'i': i, 'j': j}}) AS p FROM num GROUP BY c),
        s AS (
            SELECT c, 0::BIGINT AS k, m AS ls FROM ms
            UNION ALL
            SELECT s.c, s.k + 1, CASE WHEN s.ls[num.i] <> s.ls[num.j] AND len(list_filter(near.p, lambda q: {near})) = {size("i")} * {size("j")}
                THEN list_transform(s.ls, lambda l: CASE WHEN l = greatest(s.ls[num.i], s.ls[num.j]) THEN least(s.ls[num.i], s.ls[num.j]) ELSE l END) ELSE s.ls END
            FROM s JOIN num ON num.c = s.c AND num.k = s.k + 1 JOIN near ON near.c = s.c
        ),
        ended AS (SELECT c, arg_max(ls, k) AS ls FROM s GROUP BY c),
        flat AS (SELECT unnest(ms.m) AS id, unnest(ended.ls) AS group_id FROM ended JOIN ms USING (c)),
        sized AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM flat)"""


def _linkage_sql(threshold: int) -> str:
    return f"WITH RECURSIVE {_FP}, {_edges_sql(threshold)}, {_REACH}, {linkage_of()}"


def _hashes(spark, sf):
    """Written once: every pair query reads it several times."""
    fp = hashing.fingerprints(table(spark, sf, "documents"))
    return stored(fp.select(F.col("doc_id").alias("id"), "n_chars", "h1", F.when(F.col("n_chars") >= 200, F.col("h2")).alias("h2")), "fingerprints")


@register("doc_fingerprint", f"WITH {_FP} SELECT doc_id, lower(lpad(to_hex(h1), 16, '0')) AS fingerprint, lower(lpad(to_hex(h2), 16, '0')) AS second FROM fp")
def doc_fingerprint(spark, sf):
    fp = hashing.fingerprints(table(spark, sf, "documents")).where("h1 is not null")
    return fp.select("doc_id", hashing.hex16(F.col("h1")).alias("fingerprint"), hashing.hex16(F.col("h2")).alias("second"))


def _pairs(threshold: int, confirm: bool) -> Query:
    return lambda spark, sf: neardup.near_pairs(_hashes(spark, sf), threshold, confirm)


for _name, _t in (("strict", 3), ("balanced", 7), ("loose", 12)):
    register(f"near_pairs_{_name}", f"WITH {_FP}, {_edges_sql(_t)} SELECT a, b, dist FROM e")(_pairs(_t, False))
register("near_pairs_confirmed", f"WITH {_FP}, {_edges_sql(7, True)} SELECT a, b, dist FROM e")(_pairs(7, True))


@register("components", f"WITH RECURSIVE {_FP}, {_edges_sql(7)}, {_REACH} SELECT node, c AS component FROM comp")
def components(spark, sf):
    from ..operators.graph import components as connected

    return connected(neardup.near_pairs(_hashes(spark, sf), 7).select("a", "b"))


def _linkage(threshold: int) -> Query:
    return lambda spark, sf: neardup.cluster(_as_records(_hashes(spark, sf)), threshold)


def _as_records(hashes: DataFrame) -> DataFrame:
    return hashes.withColumn("content_hash", F.lit(None).cast("string"))


for _t in (3, 7, 12, 17):
    register(f"complete_linkage_{_t}", f"{_linkage_sql(_t)} SELECT id, group_id FROM sized WHERE n >= 2")(_linkage(_t))


@register(
    "dedupe_documents",
    f"{_linkage_sql(7)} SELECT s.group_id, count(*) AS group_size, arg_max(s.id, d.n_chars * 1000000000 - s.id) AS winner FROM sized s JOIN documents d ON d.doc_id = s.id WHERE s.n >= 2 GROUP BY s.group_id",
)
def dedupe_documents(spark, sf):
    """Near-duplicate groups of documents and the longest text of each, the first of equals."""
    hashes = _hashes(spark, sf)
    groups = neardup.cluster(_as_records(hashes), EngineConfig().threshold)
    return groups.join(hashes.select("id", "n_chars"), "id").groupBy("group_id").agg(F.count("*").alias("group_size"), F.max_by("id", F.struct("n_chars", -F.col("id"))).alias("winner"))


@register(
    "pair_distances_in_group",
    f"""WITH {_FP}, g AS (SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.lang, substr(d.text, 1, 40)) AS group_id, sha256(d.text) AS c, fp.h1 FROM documents d LEFT JOIN fp USING (doc_id))
    SELECT a.group_id, a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.h1, b.h1)) AS INTEGER) AS dist, a.c = b.c AS identical FROM g a JOIN g b ON a.group_id = b.group_id AND a.doc_id < b.doc_id""",
)
def pair_distances_in_group(spark, sf):
    first = F.min("doc_id").over(Window.partitionBy("lang", F.substring("text", 1, 40)))
    docs = table(spark, sf, "documents").select("doc_id", first.alias("group_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    fp = hashing.fingerprints(table(spark, sf, "documents")).select("doc_id", "h1")
    return neardup.pair_distances(docs.join(fp, "doc_id", "left").withColumnRenamed("doc_id", "id")).drop("dist2")


# --- tiles -------------------------------------------------------------------

_TILE = "t AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(round(least(greatest((CAST(e AS DOUBLE) + 0.6) / 1.2, 0.0), 1.0) * 255.0) AS INTEGER)) AS px FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64)"


def _at(r: int, c: int) -> str:
    return f"px[{r * 8 + c + 1}]"


def _lap_sql(low: int, high: int) -> str:
    return "[" + ", ".join(f"{_at(r - 1, c)} + {_at(r + 1, c)} + {_at(r, c - 1)} + {_at(r, c + 1)} - 4 * {_at(r, c)}" for r in range(low, high + 1) for c in range(low, high + 1)) + "]"


def _var_sql(values: str, n: int) -> str:
    mean = f"(list_sum({values}) / {n}.0)"
    return f"(list_sum(list_transform({values}, lambda x: CAST(x AS BIGINT) * x)) / {n}.0 - {mean} * {mean})"


def _clamp_sql(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low!r}), {high!r})"


_GRAD_SQL = "(list_sum(list_transform([" + ", ".join(f"({_at(r, c + 1)} - {_at(r, c - 1)}) * ({_at(r, c + 1)} - {_at(r, c - 1)}) + ({_at(r + 1, c)} - {_at(r - 1, c)}) * ({_at(r + 1, c)} - {_at(r - 1, c)})" for r in range(1, 7) for c in range(1, 7)) + "], lambda x: sqrt(x))) / 36)"
_MEAN_SQL = "(list_sum(px) / 64.0)"
_TAILS_SQL = "(len(list_filter(px, lambda x: x <= 5 OR x >= 250)) / 64.0)"
_EXPOSURE_SQL = _clamp_sql(f"(1 - 0.5 * (({_MEAN_SQL} - 128) / 128) * (({_MEAN_SQL} - 128) / 128)) * {_clamp_sql(f'sqrt(greatest({_var_sql("px", 64)}, 0.0)) / 60', 0.3, 1.0)} * (1 - 1.5 * {_clamp_sql(_TAILS_SQL, 0.0, 0.5)})", 0.0, 1.0)
_BIN_SQL = "coalesce(list_max(list_filter(range(0, 256), lambda b: len(list_filter(px, lambda x: x <= b)) * 100 <= {q} * 64)), {d})"
_P5, _P95 = _BIN_SQL.format(q=5, d=0), _BIN_SQL.format(q=95, d=255)
_RANGE_SQL = _clamp_sql(f"0.4 * (len(list_distinct(px)) / 256.0) + 0.6 * {_clamp_sql(f'({_P95} - {_P5}) / 255.0', 0.0, 1.0)}", 0.0, 1.0)


def _tiles(spark, sf):
    rows = table(spark, sf, "embeddings").where("vec_id is not null and size(embedding) = 64")
    return rows.select("vec_id", "label", tiles.tile().alias("px"))


@register("luma_tile", f"WITH {_TILE} SELECT vec_id, list_aggregate(px, 'string_agg', ' ') AS px FROM t")
def luma_tile(spark, sf):
    return _tiles(spark, sf).select("vec_id", F.array_join(F.transform("px", lambda x: x.cast("string")), " ").alias("px"))


def _bits_sql(flags: list[str]) -> str:
    return "lower(lpad(to_hex(" + " + ".join(f"CASE WHEN {f} THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i, f in enumerate(flags)) + "), 16, '0'))"


@register("tile_hash", f"WITH {_TILE} SELECT vec_id, {_bits_sql([f'px[{i + 1}] * 63 > list_sum(px) - px[1]' for i in range(64)])} AS hash FROM t")
def tile_hash(spark, sf):
    return _tiles(spark, sf).select("vec_id", hashing.hex16(tiles.mean_hash(F.col("px"))).alias("hash"))


@register("tile_dhash56", f"WITH {_TILE} SELECT vec_id, {_bits_sql([f'{_at(r, c)} > {_at(r, c + 1)}' for r in range(8) for c in range(7)])} AS hash FROM t")
def tile_dhash56(spark, sf):
    return _tiles(spark, sf).select("vec_id", hashing.hex16(tiles.row_hash(F.col("px"))).alias("hash"))


@register("tile_histogram", f"WITH {_TILE}, u AS (SELECT label, unnest(px) AS value FROM t) SELECT label, value, count(*) AS n FROM u GROUP BY label, value")
def tile_histogram(spark, sf):
    return _tiles(spark, sf).select("label", F.explode("px").alias("value")).groupBy("label", "value").agg(F.count("*").alias("n"))


@register("tile_hist16", f"WITH {_TILE}, u AS (SELECT vec_id, unnest(px) // 16 AS bin FROM t) SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(count(*) / 64.0, 6) AS share FROM u GROUP BY vec_id, bin")
def tile_hist16(spark, sf):
    rows = _tiles(spark, sf).select("vec_id", F.explode("px").alias("value"))
    return rows.groupBy("vec_id", F.floor(F.col("value") / 16).cast("int").alias("bin")).agg(r6(F.count("*") / 64).alias("share"))


@register("tile_luma_stats", f"WITH {_TILE} SELECT vec_id, round({_MEAN_SQL}, 6) AS mean, round({_var_sql('px', 64)}, 6) AS variance, CAST(len(list_distinct(px)) AS INTEGER) AS occupied, list_min(px) AS least, list_max(px) AS most FROM t")
def tile_luma_stats(spark, sf):
    px = F.col("px")
    return _tiles(spark, sf).select("vec_id", r6(tiles._sum(px) / 64).alias("mean"), r6(tiles.variance(px)).alias("variance"), F.size(F.array_distinct(px)).alias("occupied"), F.array_min(px).alias("least"), F.array_max(px).alias("most"))


@register("tile_laplacian_var", f"WITH {_TILE} SELECT vec_id, round({_var_sql(_lap_sql(1, 6), 36)}, 6) AS sharpness, round({_var_sql(_lap_sql(2, 5), 16)}, 6) AS centre FROM t")
def tile_laplacian_var(spark, sf):
    px = F.col("px")
    return _tiles(spark, sf).select("vec_id", r6(tiles.variance(tiles.laplacian(px))).alias("sharpness"), r6(tiles.variance(tiles.laplacian(px, 2, 5))).alias("centre"))


@register("tile_gradient_energy", f"WITH {_TILE} SELECT vec_id, round({_GRAD_SQL}, 6) AS energy FROM t")
def tile_gradient_energy(spark, sf):
    return _tiles(spark, sf).select("vec_id", r6(tiles.gradient(F.col("px"))).alias("energy"))


@register("tile_exposure", f"WITH {_TILE} SELECT vec_id, round({_EXPOSURE_SQL}, 6) AS exposure FROM t")
def tile_exposure(spark, sf):
    return _tiles(spark, sf).select("vec_id", r6(tiles.exposure(F.col("px"))).alias("exposure"))


@register("tile_dynamic_range", f"WITH {_TILE} SELECT vec_id, CAST({_P5} AS INTEGER) AS p5, CAST({_P95} AS INTEGER) AS p95, round({_RANGE_SQL}, 6) AS dynamic_range FROM t")
def tile_dynamic_range(spark, sf):
    px = F.col("px")
    return _tiles(spark, sf).select("vec_id", tiles.last_bin_below(px, 5, 0).alias("p5"), tiles.last_bin_below(px, 95, 255).alias("p95"), r6(tiles.dynamic_range(px)).alias("dynamic_range"))


@register("tile_stretch", f"WITH {_TILE} SELECT vec_id, list_aggregate(CASE WHEN list_max(px) <= list_min(px) THEN px ELSE list_transform(px, lambda x: CAST(floor((x - list_min(px)) * 255 / (list_max(px) - list_min(px)) + 0.5) AS INTEGER)) END, 'string_agg', ' ') AS px FROM t")
def tile_stretch(spark, sf):
    return _tiles(spark, sf).select("vec_id", F.array_join(F.transform(tiles.stretch(F.col("px")), lambda x: x.cast("string")), " ").alias("px"))


def _focus_sql(roi: str, centre: str, border: str) -> str:
    h = f"(2 * {roi} * {centre} / ({roi} + {centre} + 1e-6))"
    return f"0.75 * {_clamp_sql(f'({h} - 12) / 108', 0.0, 1.0)} + 0.25 * {_clamp_sql(f'({h} / ({border} + 1e-6) - 0.35) / 1.15', 0.0, 1.0)}"


def _blur_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 60 THEN 1.0 WHEN {x} >= 20 THEN {_clamp_sql(f'({x} - 20) / 40', 0.3, 1.0)} ELSE {x} / 20 * 0.3 END"


_FEATURES = f"""{_TILE}, f0 AS (SELECT vec_id, label, {_var_sql(_lap_sql(1, 6), 36)} AS sharpness, {_var_sql(_lap_sql(2, 5), 16)} AS face, {_GRAD_SQL} AS expression, {_EXPOSURE_SQL} AS exposure, {_RANGE_SQL} AS dynamic_range, {_MEAN_SQL} / 255 AS vibrancy FROM t),
    f AS MATERIALIZED (SELECT *, {_focus_sql("(face / 100)", "(sharpness / 100)", "(sharpness / 200)")} AS focus, {_blur_sql("(sharpness / 100)")} AS blur FROM f0)"""


def _features(spark, sf):
    return tiles.features(table(spark, sf, "embeddings"))


@register("blur_piecewise", f"WITH {_FEATURES} SELECT vec_id, round({_blur_sql('(sharpness / 100)')}, 6) AS blur, round(least({_blur_sql('(sharpness / 100)')}, CASE WHEN face / 50 >= 180 THEN 1.0 WHEN face / 50 >= 50 THEN 0.3 + (face / 50 - 50) / 130 * 0.7 ELSE face / 50 / 50 * 0.3 END), 6) AS subject_blur FROM f")
def blur_piecewise(spark, sf):
    s = F.col("sharpness") / 100
    return _features(spark, sf).select("vec_id", r6(scoring.blur_confidence(s)).alias("blur"), r6(scoring.subject_blur(s, F.col("face") / 50)).alias("subject_blur"))


@register("focus_terms", f"WITH {_FEATURES} SELECT vec_id, round(focus, 6) AS focus FROM f")
def focus_terms(spark, sf):
    return _features(spark, sf).select("vec_id", r6(F.col("focus")).alias("focus"))


def _weighted_sql(branch: str, value=lambda m: m) -> str:
    return "(0.0 + " + " + ".join(f"{w!r} * ({value('sharpness')} * {value('focus')})" if m == "sharp_focus" else f"{w!r} * {value(m)}" for m, w in scoring.WEIGHTS[branch].items()) + ")"


_GATES_SQL = f"{_clamp_sql('blur', 0.05, 1.0)} * {_clamp_sql('focus', 0.05, 1.0)}"


@register("raw_score", f"WITH {_FEATURES} SELECT vec_id, " + ", ".join(f"round({_weighted_sql(b)} * ({_GATES_SQL}), 6) AS {b}" for b in scoring.WEIGHTS) + " FROM f")
def raw_score(spark, sf):
    return _features(spark, sf).select("vec_id", *[r6(scoring.raw_score(b)).alias(b) for b in scoring.WEIGHTS])


_TOPS = ", ".join(f"{m} / greatest(max({m}) OVER (PARTITION BY label), 1e-9) AS n_{m}" for m in ranking.METRICS)
_N = lambda m: f"n_{m}"
_NORMAL = f"""{_FEATURES}, n AS (SELECT *, {_TOPS}, bool_or(face <> 0) OVER (PARTITION BY label) AS some_face FROM f),
    s AS MATERIALIZED (SELECT *, CASE WHEN some_face THEN {_weighted_sql("portrait", _N)} ELSE {_weighted_sql("portrait_low", _N)} END * ({_GATES_SQL}) AS score, {_weighted_sql("landscape", _N)} * ({_GATES_SQL}) AS land FROM n)"""


def _normal(spark, sf, scene="portrait"):
    return ranking.normalise(_features(spark, sf).withColumnsRenamed({"vec_id": "id", "label": "group_id"}), scene)


@register("normalized_score", f"WITH {_NORMAL} SELECT vec_id AS id, label AS group_id, round(score, 6) AS score FROM s")
def normalized_score(spark, sf):
    return _normal(spark, sf).select("id", "group_id", r6(F.col("score")).alias("score"))


@register("normalized_landscape", f"WITH {_NORMAL} SELECT vec_id AS id, label AS group_id, round(land, 6) AS score FROM s")
def normalized_landscape(spark, sf):
    return _normal(spark, sf, "landscape").select("id", "group_id", r6(F.col("score")).alias("score"))


@register(
    "group_winner",
    f"""WITH {_NORMAL}, w AS (SELECT *, vec_id % 3 = 0 AS is_raw, max(score) OVER (PARTITION BY label) AS top, greatest(max(sharpness) OVER (PARTITION BY label), 1e-9) AS sharp FROM s),
    v AS (SELECT *, is_raw AND top - score <= 0.02 * abs(top) + 1e-9 AND (sharp - sharpness) / sharp <= 0.02 AS r FROM w),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, sharpness DESC, focus DESC, vec_id DESC) AS a, row_number() OVER (PARTITION BY label ORDER BY r DESC, score DESC, sharpness DESC, vec_id * 10 % 97 DESC, 'p' || CAST(vec_id AS VARCHAR) DESC) AS b FROM v)
    SELECT label AS group_id, max(CASE WHEN b = 1 AND r THEN vec_id WHEN a = 1 AND NOT any_raw THEN vec_id END) AS winner, bool_or(r) AS by_raw FROM (SELECT *, bool_or(r) OVER (PARTITION BY label) AS any_raw FROM o) GROUP BY label""",
)
def group_winner(spark, sf):
    rows = _normal(spark, sf).withColumns({"is_raw": F.col("id") % 3 == 0, "area": F.lit(64), "size": F.col("id") * 10 % 97, "path": F.concat(F.lit("p"), F.col("id").cast("string"))})
    return ranking.winners(rows)


@register("group_ranking", f"WITH {_NORMAL} SELECT label AS group_id, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s")
def group_ranking(spark, sf):
    return ranking.ranking(_normal(spark, sf)).select("group_id", "id", "place")


@register("close_scores", f"WITH {_NORMAL}, c AS (SELECT label, max(score) OVER (PARTITION BY label) - score < 0.15 * max(score) OVER (PARTITION BY label) + 1e-6 AS near FROM s) SELECT label AS group_id, count(*) FILTER (WHERE near) AS n_close FROM c GROUP BY label")
def close_scores(spark, sf):
    return ranking.close_scores(_normal(spark, sf))


# --- files, memo -------------------------------------------------------------

_URL_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '')"


def _paths(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("JPG", "arw", "txt", "png", "Dng")]), (F.col("page_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 7 == 0, F.lit("Rejected/")).when(F.col("page_id") % 11 == 0, F.lit("rejected/")).otherwise(F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.concat(folder, path, F.lit("."), ext).alias("path"))


_PATHS = f"p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Rejected/' WHEN page_id % 11 = 0 THEN 'rejected/' ELSE '' END || {_URL_PATH} || '.' || (['JPG', 'arw', 'txt', 'png', 'Dng'])[page_id % 5 + 1] AS path FROM pages)"


@register("ext_filter", f"WITH {_PATHS} SELECT page_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('arw', 'dng') AS is_raw FROM p WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('arw', 'dng', 'jpg', 'png')")
def ext_filter(spark, sf):
    rows = _paths(spark, sf).where(files.is_supported(F.col("path")))
    return rows.select("page_id", "path", files.is_raw(F.col("path")).alias("is_raw"))


@register("path_skip_filter", f"WITH {_PATHS} SELECT page_id FROM p WHERE NOT list_has_any(string_split(path, '/'), ['Images-Good', 'Rejected'])")
def path_skip_filter(spark, sf):
    return _paths(spark, sf).where(~files.is_output(F.col("path"))).select("page_id")


@register("path_component_sort", f"WITH {_PATHS} SELECT page_id, row_number() OVER (ORDER BY string_split(path, '/'), page_id) - 1 AS image_id FROM p")
def path_component_sort(spark, sf):
    rows = _paths(spark, sf).withColumn("path", F.concat_ws("/", "path", F.lpad(F.col("page_id").cast("string"), 12, "0")))
    return files.numbered(rows).select("page_id", "image_id")


ORACLE_SQL["path_component_sort"] = f"WITH {_PATHS} SELECT page_id, row_number() OVER (ORDER BY string_split(path || '/' || lpad(CAST(page_id AS VARCHAR), 12, '0'), '/')) - 1 AS image_id FROM p"


def _memo(spark, sf):
    docs = table(spark, sf, "documents")
    now = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 7).alias("mtime_secs"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "doc_id")
    memo = now.where("doc_id % 3 <> 0").withColumn("mtime_secs", F.when(F.col("doc_id") % 5 == 0, F.col("mtime_secs") - 1).otherwise(F.col("mtime_secs"))).drop("doc_id")
    return now, memo


_MEMO_SQL = """now AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size, doc_id * 7 AS secs, sha256(text) AS h FROM documents),
    memo AS (SELECT path, size, CASE WHEN doc_id % 5 = 0 THEN secs - 1 ELSE secs END AS secs, h FROM now WHERE doc_id % 3 <> 0)"""


@register("cache_hits_misses", f"WITH {_MEMO_SQL} SELECT count(*) AS files, count(m.h) AS hits, count(*) FILTER (WHERE m.h IS NULL) AS misses FROM now n LEFT JOIN memo m ON m.path = n.path AND m.size = n.size AND m.secs = n.secs")
def cache_hits_misses(spark, sf):
    now, memo = _memo(spark, sf)
    found = cache.look_up(now.drop("content_hash"), memo)
    return found.agg(F.count("*").alias("files"), F.count("content_hash").alias("hits"), F.count_if(F.col("content_hash").isNull()).alias("misses"))


@register("cache_upsert", f"WITH {_MEMO_SQL}, fresh AS (SELECT path, secs FROM now WHERE doc_id % 2 = 0) SELECT coalesce(f.path, m.path) AS path, coalesce(f.secs, m.secs) AS mtime_secs FROM memo m FULL JOIN fresh f ON f.path = m.path")
def cache_upsert(spark, sf):
    now, memo = _memo(spark, sf)
    return cache.upsert(memo, now.where("doc_id % 2 = 0").drop("doc_id")).select("path", "mtime_secs")


# --- edit plans, chats, events ------------------------------------------------


_STRENGTH_SQL = "(['small', 'medium', 'high', 'off'])[{0} % 4 + 1]"
_SHARPEN_SQL = "(VALUES ('small', 25.0::DOUBLE, 1.0::DOUBLE, 25.0::DOUBLE, 70.0::DOUBLE), ('medium', 40.0, 1.0, 35.0, 80.0), ('high', 55.0, 1.2, 40.0, 85.0)) {0}(strength, amount, radius, detail, masking)"
_VIGNETTE_SQL = "(VALUES ('small', -10.0::DOUBLE, 50.0::DOUBLE, 0.0::DOUBLE, 50.0::DOUBLE), ('medium', -20.0, 45.0, 0.0, 60.0), ('high', -35.0, 40.0, 0.0, 70.0)) {0}(strength, amount, midpoint, roundness, feather)"


def _strength(by) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("small", "medium", "high", "off")]), (by % 4 + 1).cast("int"))


@register(
    "recipe_lookup",
    f"SELECT c_custkey, x.strength, s.amount AS sharpen_amount, s.radius AS sharpen_radius, s.detail AS sharpen_detail, s.masking AS sharpen_masking, v.amount AS vignette_amount, v.midpoint AS vignette_midpoint, v.roundness AS vignette_roundness, v.feather AS vignette_feather FROM (SELECT c_custkey, {_STRENGTH_SQL.format('c_nationkey')} AS strength FROM customer) x LEFT JOIN {_SHARPEN_SQL.format('s')} ON s.strength = x.strength LEFT JOIN {_VIGNETTE_SQL.format('v')} ON v.strength = x.strength",
)
def recipe_lookup(spark, sf):
    return editplan.with_recipe(table(spark, sf, "customer").select("c_custkey", _strength(F.col("c_nationkey")).alias("strength")))


def _settings_text(settings) -> F.Column:
    """A map of numbers as key=value, by key."""
    entries = F.array_sort(F.transform(F.map_entries(settings), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))))
    return F.array_join(entries, ";")


_PLAN_SQL = f"""q AS (SELECT c_custkey AS k, c_custkey // 256 AS more, {_STRENGTH_SQL.format('c_custkey')} AS ss, {_STRENGTH_SQL.format('(c_custkey // 4)')} AS vs, (['small', 'medium', 'high'])[c_custkey % 3 + 1] AS bs FROM customer),
    p AS (SELECT k, bs, s.strength AS known_s, v.strength AS known_v,
        CASE WHEN k & 1 > 0 THEN s.amount END AS "Sharpness", CASE WHEN k & 1 > 0 THEN s.radius END AS "SharpenRadius", CASE WHEN k & 1 > 0 THEN s.detail END AS "SharpenDetail", CASE WHEN k & 1 > 0 THEN s.masking END AS "SharpenEdgeMasking",
        CASE WHEN k & 2 > 0 THEN v.amount END AS "PostCropVignetteAmount", CASE WHEN k & 2 > 0 THEN v.midpoint END AS "PostCropVignetteMidpoint", CASE WHEN k & 2 > 0 THEN v.roundness END AS "PostCropVignetteRoundness", CASE WHEN k & 2 > 0 THEN v.feather END AS "PostCropVignetteFeather", CASE WHEN k & 2 > 0 THEN 1.0 END AS "PostCropVignetteStyle",
        CASE WHEN k & 4 > 0 THEN 8.0 END AS "Contrast2012", CASE WHEN k & 4 > 0 THEN 8.0 END AS "Vibrance", CASE WHEN k & 8 > 0 THEN 0.0 END AS "Exposure2012", CASE WHEN k & 8 > 0 THEN -10.0 END AS "Highlights2012", CASE WHEN k & 8 > 0 THEN 10.0 END AS "Shadows2012",
        CASE WHEN k & 16 > 0 THEN 20.0 END AS "LuminanceSmoothing", CASE WHEN k & 16 > 0 THEN 25.0 END AS "ColorNoiseReduction"
        FROM q LEFT JOIN {_SHARPEN_SQL.format('s')} ON s.strength = ss LEFT JOIN {_VIGNETTE_SQL.format('v')} ON v.strength = vs)"""
_PLAN_KEYS = ("ColorNoiseReduction", "Contrast2012", "Exposure2012", "Highlights2012", "LuminanceSmoothing", "PostCropVignetteAmount", "PostCropVignetteFeather", "PostCropVignetteMidpoint", "PostCropVignetteRoundness", "PostCropVignetteStyle", "Shadows2012", "SharpenDetail", "SharpenEdgeMasking", "SharpenRadius", "Sharpness", "Vibrance")
_PLAN_TEXT = "concat_ws(';', " + ", ".join(f"""CASE WHEN "{k}" IS NOT NULL THEN '{k}=' || printf('%.2f', CAST("{k}" AS DOUBLE)) END""" for k in _PLAN_KEYS) + ")"


def _customer_plan():
    k = F.col("c_custkey")
    bit = lambda n: k.bitwiseAND(F.lit(n)) > 0
    third = F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int"))
    return editplan.plan(
        eye_sharpen=bit(1), eye_sharpen_strength=_strength(k), vignette=bit(2), vignette_strength=_strength(F.floor(k / 4)), color_tone=bit(4), exposure_normalize=bit(8), noise_reduction=bit(16), white_balance=bit(32), optimal_crop=bit(64), subject_blur=bit(128), subject_blur_strength=third
    )


@register(
    "edit_plan",
    f"WITH {_PLAN_SQL} SELECT k AS c_custkey, {_PLAN_TEXT} AS settings, CASE WHEN k & 32 > 0 THEN 'Auto' END AS white_balance, CASE WHEN k & 64 > 0 THEN 1 ELSE 0 END AS warnings, CASE WHEN k & 128 > 0 THEN bs END AS subject_blur FROM p",
)
def edit_plan(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", _customer_plan().alias("p"))
    return rows.select("c_custkey", _settings_text(F.col("p.settings")).alias("settings"), F.try_element_at("p.texts", F.lit("WhiteBalance")).alias("white_balance"), F.size("p.warnings").alias("warnings"), F.col("p.subject_blur_strength").alias("subject_blur"))


_ANSWER_SQL = """CASE c_custkey % 6 WHEN 0 THEN '{"exposureDelta": 0.75, "contrastDelta": -30, "vibranceDelta": 5.5}' WHEN 1 THEN '{"eyeSharpenStrength": "high", "exposureDelta": -3}' WHEN 2 THEN '{"vignetteStrength": "small", "subjectBlurStrength": "high", "unknown": 1}'
    WHEN 3 THEN '{"eyeSharpenStrength": "extreme"}' WHEN 4 THEN 'no json' ELSE '{}' END"""


def _answer() -> F.Column:
    c = F.col("c_custkey") % 6
    given = ['{"exposureDelta": 0.75, "contrastDelta": -30, "vibranceDelta": 5.5}', '{"eyeSharpenStrength": "high", "exposureDelta": -3}', '{"vignetteStrength": "small", "subjectBlurStrength": "high", "unknown": 1}', '{"eyeSharpenStrength": "extreme"}', "no json", "{}"]
    return F.element_at(F.array(*[F.lit(x) for x in given]), (c + 1).cast("int"))


_NEW = {
    "Exposure2012": 'CASE k % 6 WHEN 0 THEN least(coalesce("Exposure2012", 0) + 0.75, 1.0) WHEN 1 THEN greatest(coalesce("Exposure2012", 0) - 3, -1.0) ELSE "Exposure2012" END',
    "Contrast2012": 'CASE k % 6 WHEN 0 THEN greatest(coalesce("Contrast2012", 0) - 30, -20.0) ELSE "Contrast2012" END',
    "Vibrance": 'CASE k % 6 WHEN 0 THEN coalesce("Vibrance", 0) + 5.5 ELSE "Vibrance" END',
} | {k: f'CASE k % 6 WHEN 1 THEN {v} ELSE "{k}" END' for k, v in (("Sharpness", 55.0), ("SharpenRadius", 1.2), ("SharpenDetail", 40.0), ("SharpenEdgeMasking", 85.0))}
_NEW |= {k: f'CASE k % 6 WHEN 2 THEN {v} ELSE "{k}" END' for k, v in (("PostCropVignetteAmount", -10.0), ("PostCropVignetteMidpoint", 50.0), ("PostCropVignetteRoundness", 0.0), ("PostCropVignetteFeather", 50.0))}


@register(
    "edit_plan_adjusted",
    f"WITH {_PLAN_SQL}, n AS (SELECT k, bs, " + ", ".join(f'{_NEW.get(c, chr(34) + c + chr(34))} AS "{c}"' for c in _PLAN_KEYS) + f" FROM p) SELECT k AS c_custkey, k % 6 IN (3, 4) AS refused, CASE WHEN k % 6 NOT IN (3, 4) THEN {_PLAN_TEXT} END AS settings, CASE WHEN k % 6 = 2 THEN 'high' WHEN k % 6 NOT IN (3, 4) AND k & 128 > 0 THEN bs END AS subject_blur FROM n",
)
def edit_plan_adjusted(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", _customer_plan().alias("p"), editplan.adjustments(_answer()).alias("a"))
    new = editplan.adjusted(F.col("p"), F.col("a"))
    rows = rows.select("c_custkey", F.col("a").isNull().alias("refused"), F.when(F.col("a").isNotNull(), new).alias("n"))
    return rows.select("c_custkey", "refused", F.when(~F.col("refused"), _settings_text(F.col("n.settings"))).alias("settings"), F.col("n.subject_blur_strength").alias("subject_blur"))


@register(
    "vision_models",
    "WITH m AS (SELECT p_partkey, (['qwen2.5vl:7b', 'LLaVA:13b', 'llama3', 'Gemma3:4b', 'mistral', 'minicpm-v', 'InternVL2', 'phi'])[p_partkey % 8 + 1] AS name, (['[\"vision\"]', '[\"completion\"]', NULL])[p_partkey % 3 + 1] AS caps FROM part) SELECT p_partkey, name, caps LIKE '%\"vision\"%' IS TRUE OR regexp_matches(lower(name), 'vl|vision|llava|moondream|minicpm-v|bakllava|gemma3|pixtral|internvl|cogvlm') AS sees FROM m",
)
def vision_models(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % n + 1).cast("int"))
    name = pick(("qwen2.5vl:7b", "LLaVA:13b", "llama3", "Gemma3:4b", "mistral", "minicpm-v", "InternVL2", "phi"), 8)
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), editplan.sees_images(name, pick(('["vision"]', '["completion"]', None), 3)).alias("sees"))


def _chat_sql(most: int, size: int) -> str:
    return f"WITH c AS (SELECT conv_id, turn, role, row_number() OVER w AS n, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, role FROM c WHERE n = 1 OR (n <= {most} AND b <= {size})"


@register("chat_trim", _chat_sql(4, 1500))
def chat_trim(spark, sf):
    return editplan.trim_chat(table(spark, sf, "conversations"), 4, 1500).select("conv_id", "turn", "role")


@register("chat_trim_reference_limits", _chat_sql(20, 32_000))
def chat_trim_reference_limits(spark, sf):
    return editplan.trim_chat(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@register("latest_user_message", "SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_user_message(spark, sf):
    return editplan.latest_user_message(table(spark, sf, "conversations"))


@register("event_last_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def event_last_n(spark, sf):
    return eventlog.last_events(table(spark, sf, "events")).select("event_id", "event_type")


@register("event_last_by_type", "WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id, event_type, CAST(n AS INTEGER) AS place FROM e WHERE n <= 50")
def event_last_by_type(spark, sf):
    return eventlog.last_events_by(table(spark, sf, "events"), "event_type", 50).select("event_id", "event_type", "place")


_LEVELS = ("DEBUG", " info", "warn", "error", "fatal", "debug")
_MESSAGE_SQL = "'E' || CAST(page_id % 9 AS VARCHAR) || ': saved ' || url || ' to ' || (['/Users/ann/Pictures/p', '/tmp/a', '/home/ann/p', '/Volumes/disk one/p', '/private/var/x;/tmp/y'])[page_id % 5 + 1] || CAST(page_id AS VARCHAR) || '.jpg, now'"


@register("event_levels", "SELECT CASE user_id % 6 WHEN 2 THEN 'warn' WHEN 3 THEN 'error' WHEN 5 THEN 'debug' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY 1")
def event_levels(spark, sf):
    given = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").groupBy(eventlog.level(given).alias("level")).agg(F.count("*").alias("n"))


@register("redact_paths", f"SELECT page_id, regexp_replace({_MESSAGE_SQL}, '/(Users|Volumes|private|tmp)/[^ \t\r\n,;)]+', '[path]', 'g') AS message, 'E' || CAST(page_id % 9 AS VARCHAR) AS code FROM pages")
def redact_paths(spark, sf):
    where = F.element_at(F.array(*[F.lit(x) for x in ("/Users/ann/Pictures/p", "/tmp/a", "/home/ann/p", "/Volumes/disk one/p", "/private/var/x;/tmp/y")]), (F.col("page_id") % 5 + 1).cast("int"))
    message = F.concat(F.lit("E"), (F.col("page_id") % 9).cast("string"), F.lit(": saved "), "url", F.lit(" to "), where, F.col("page_id").cast("string"), F.lit(".jpg, now"))
    return table(spark, sf, "pages").select("page_id", eventlog.redacted(message).alias("message"), eventlog.error_code(message).alias("code"))


@register("progress_percent", "SELECT event_id, CASE WHEN user_id % 50 = 0 THEN 0 ELSE least(100, CAST(round(100 * (event_id % 60) / (user_id % 50)) AS INTEGER)) END AS percent FROM events")
def progress_percent(spark, sf):
    return table(spark, sf, "events").select("event_id", eventlog.percent(F.col("event_id") % 60, F.col("user_id") % 50).alias("percent"))


@register("prune_keep_newest", "WITH f AS (SELECT DISTINCT 'run-' || strftime(ts, '%Y%m%dT%H') || '.jsonl' AS name FROM events), n AS (SELECT name, row_number() OVER (ORDER BY name DESC) AS n FROM f) SELECT name, 'labels-' || substr(name, 5, 11) || '.csv' AS labels FROM n WHERE n >= 20")
def prune_keep_newest(spark, sf):
    runs = table(spark, sf, "events").select(F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd'T'HH"), F.lit(".jsonl")).alias("name")).distinct()
    return telemetry.to_prune(runs).select("name", telemetry.label_name("name").alias("labels"))


@register("next_version", "WITH t AS (SELECT DISTINCT user_id % 97 + 1 AS n FROM events WHERE user_id % 97 < 60), f AS (SELECT min(i) AS n FROM range(1, 10000) r(i) WHERE i NOT IN (SELECT n FROM t)) SELECT CASE WHEN n = 1 THEN 'Processed-Images' ELSE 'Processed-Images-' || CAST(n AS VARCHAR) END AS name FROM f")
def next_version(spark, sf):
    n = F.col("user_id") % 97 + 1
    names = table(spark, sf, "events").where("user_id % 97 < 60").select(F.when(n == 1, F.lit("Processed-Images")).otherwise(F.concat(F.lit("Processed-Images-"), n.cast("string"))).alias("name"))
    return manifest.next_version(names, "Processed-Images")


_ANSWERS = ("2 is best", "I take b.jpg", "9", "none", " 3", "12 or a.jpg", "", "c.jpg.")


def _given(values, column: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


_ANSWERS_SQL = "c AS (SELECT event_id, (['2 is best', 'I take b.jpg', '9', 'none', ' 3', '12 or a.jpg', '', 'c.jpg.'])[event_id % 8 + 1] AS answer, list_transform([1, 2, 3], lambda i: chr(CAST(97 + (event_id + i) % (3 + event_id % 2) AS INTEGER)) || '.jpg') AS names FROM events), n AS (SELECT *, try_cast(nullif(regexp_extract(trim(answer), '^[0-9]+'), '') AS INTEGER) AS number FROM c)"


def _answers(spark, sf):
    names = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat(F.char(F.lit(97) + (F.col("event_id") + i) % (3 + F.col("event_id") % 2)), F.lit(".jpg")))
    return table(spark, sf, "events").select("event_id", _given(_ANSWERS, "event_id").alias("answer"), names.alias("names"))


@register("answer_match", f"WITH {_ANSWERS_SQL} SELECT event_id, CASE WHEN number BETWEEN 1 AND 3 THEN number ELSE (SELECT min(i) FROM range(1, 4) t(i) WHERE contains(answer, names[i])) END AS picked FROM n")
def answer_match(spark, sf):
    return _answers(spark, sf).select("event_id", editplan.answer_index(F.col("answer"), F.col("names")).cast("long").alias("picked"))


@register("score_answer_match", f"WITH {_ANSWERS_SQL} SELECT event_id, (SELECT min(i) FROM range(1, 4) t(i) WHERE contains(trim(answer), names[i]) OR contains(names[i], trim(answer))) AS picked FROM n")
def score_answer_match(spark, sf):
    return _answers(spark, sf).select("event_id", editplan.score_answer_index(F.col("answer"), F.col("names")).cast("long").alias("picked"))


@register("model_replies", "WITH r AS (SELECT conv_id, turn, json_object('message', json_object('role', role, 'content', '  ' || text || ' ')) AS reply FROM conversations) SELECT conv_id, turn, trim(reply->>'$.message.content') AS reply, reply->>'$.response' AS generated FROM r")
def model_replies(spark, sf):
    reply = F.to_json(F.struct(F.struct("role", F.concat(F.lit("  "), "text", F.lit(" ")).alias("content")).alias("message")))
    return table(spark, sf, "conversations").select("conv_id", "turn", editplan.chat_reply(reply).alias("reply"), editplan.generated(reply).alias("generated"))


_DECISION_SQL = "CASE WHEN e.event_id % 3 = 0 THEN 'algorithm' WHEN e.event_id % 3 = 1 THEN 'ai-agreed' ELSE 'ai-override' END"


@register("decision_paths", f"SELECT {_DECISION_SQL} AS decision, count(*) AS n FROM events e GROUP BY 1")
def decision_paths(spark, sf):
    third = F.col("event_id") % 3
    rows = table(spark, sf, "events").select(F.col("event_id").alias("winner"), F.when(third == 1, F.col("event_id")).when(third == 2, F.col("event_id") + 1).alias("ai_winner"))
    return rows.groupBy(telemetry.decision().alias("decision")).agg(F.count("*").alias("n"))


@register("folder_labels", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'x/p' || CAST(page_id AS VARCHAR) || '.jpg' ELSE 'p' || CAST(page_id AS VARCHAR) || '.jpg' END AS label, 'file:' || CASE page_id % 3 WHEN 0 THEN '/data/shoot/x' WHEN 1 THEN '/data/shoot' ELSE '/data/shooting' END || '/p' || CAST(page_id AS VARCHAR) || '.jpg' AS whole FROM pages")
def folder_labels(spark, sf):
    path = F.concat(F.lit("file:"), _given(("/data/shoot/x", "/data/shoot", "/data/shooting"), "page_id"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf, "pages").select("page_id", files.folder_label(path, "/data/shoot").alias("label"), F.concat(F.lit("file:"), files.folder_label(path, "/data/shoot", True)).alias("whole"))


_LINES_SQL = f"""WITH {_FP}, x AS (SELECT doc_id, source, n_chars, octet_length(encode(text)) AS size, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS g, count(*) OVER (PARTITION BY sha256(text)) AS n, max(doc_id) OVER (PARTITION BY sha256(text)) AS w FROM documents WHERE text IS NOT NULL),
    r AS (SELECT x.*, CASE WHEN n > 1 THEN g END AS grp, h1, CASE WHEN x.n_chars >= 200 THEN h2 END AS h2 FROM x LEFT JOIN fp USING (doc_id)),
    i AS (SELECT json_object('type', 'image', 'runId', 'run', 'imageId', doc_id, 'fileName', CAST(doc_id AS VARCHAR), 'path', source || '/' || CAST(doc_id AS VARCHAR), 'extension', '', 'bytes', size, 'isRawOrDng', NULL, 'previewW', NULL, 'previewH', NULL, 'contentShort', substr(h, 1, 16), 'phash', lower(lpad(to_hex(h1), 16, '0')), 'dhash', lower(lpad(to_hex(h2), 16, '0')), 'groupIndex', grp,
        'metrics', json_object('score', n_chars / 100, 'rawScore', NULL, 'sharpness', NULL, 'focus', NULL, 'face', NULL, 'exposure', NULL, 'expression', NULL, 'vibrancy', NULL, 'dynamicRange', NULL, 'blurConfidence', NULL), 'diagnostics', NULL) AS line FROM r),
    p AS (SELECT a.g, list(json_object('a', a.doc_id, 'b', b.doc_id, 'phashDistance', bit_count(xor(a.h1, b.h1)), 'dhashDistance', bit_count(xor(a.h2, b.h2)), 'identicalContent', true) ORDER BY a.doc_id, b.doc_id) AS pairs FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.g),
    m AS (SELECT g, list(doc_id ORDER BY doc_id) AS members, max(w) AS w, list(json_object('imageId', doc_id, 'fileName', CAST(doc_id AS VARCHAR), 'normalizedScore', n_chars / 100) ORDER BY n_chars DESC, doc_id) AS ranking FROM r WHERE n > 1 GROUP BY g),
    k AS (SELECT json_object('type', 'group', 'runId', 'run', 'groupIndex', g, 'size', len(members), 'members', members, 'pairs', pairs, 'ranking', ranking, 'algoWinner', w, 'algoWinnerFile', CAST(w AS VARCHAR), 'aiWinner', NULL, 'aiWinnerFile', NULL, 'finalWinner', w, 'finalWinnerFile', CAST(w AS VARCHAR), 'decisionPath', 'algorithm', 'humanKeeper', NULL) AS line FROM m JOIN p USING (g)),
    o AS (SELECT doc_id, CASE WHEN n = 1 THEN 'unique' WHEN doc_id = w THEN 'kept' ELSE 'rejected' END AS outcome FROM r),
    q AS (SELECT json_object('type', 'placement', 'runId', 'run', 'imageId', doc_id, 'outcome', outcome, 'destination', outcome) AS line FROM o),
    z AS (SELECT json_object('type', 'summary', 'runId', 'run', 'timestamp', '', 'scanned', (SELECT count(*) FROM r), 'duplicateGroups', (SELECT count(*) FROM m), 'keptGood', (SELECT count(*) FROM o WHERE outcome <> 'rejected'), 'rejected', (SELECT count(*) FROM o WHERE outcome = 'rejected')) AS line)
    SELECT 'image' AS type, CAST(line AS VARCHAR) AS line FROM i UNION ALL SELECT 'group', CAST(line AS VARCHAR) FROM k UNION ALL SELECT 'placement', CAST(line AS VARCHAR) FROM q UNION ALL SELECT 'summary', CAST(line AS VARCHAR) FROM z"""


@register("telemetry_jsonl", _LINES_SQL)
def telemetry_jsonl(spark, sf):
    """The JSON lines of a run over the exact groups, but for the run's own."""
    docs = files.documents_as_records(table(spark, sf, "documents").where("text is not null"))
    hashes = _hashes(spark, sf)
    groups = _exact(spark, sf).select(F.col("doc_id").alias("id"), "group_id")
    chars = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 100).alias("score"))
    records = docs.join(hashes.drop("n_chars"), "id", "left").join(groups, "id", "left").join(chars, "id")
    ranked = ranking.ranking(groups.join(records.select("id", "path", "score"), "id"))
    winners = groups.groupBy("group_id").agg(F.max("id").alias("winner")).withColumn("ai_winner", F.lit(None).cast("long"))
    pairs = neardup.pair_distances(records.where("group_id is not null").select("id", "group_id", "h1", "h2", "content_hash"))
    placed = manifest.outcomes(records.select("id"), groups, winners).withColumn("destination", F.col("outcome"))
    parts = [telemetry.image_records(records, "run"), telemetry.group_records(ranked, pairs, winners, "run"), telemetry.placement_records(placed, "run"), telemetry.summary_record(manifest.summary(placed), "run")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("run_settings", "SELECT 'run' AS type, 12 AS hammingThreshold, 512 AS maxEdge, false AS confirmDhash, 'shoot' AS folder, 'landscape' AS sceneMode, 'low' AS perfProfile, 'loose' AS duplicateStrength, 'move' AS fileAction, true AS includeSubfolders, false AS enableAiFeatures, false AS useAiForDedup, '' AS ollamaModel, 0.2::DOUBLE AS ollamaTemperature")
def run_settings(spark, sf):
    from ..config import Profile, Scene, Strength

    cfg = EngineConfig(scene=Scene.LANDSCAPE, profile=Profile.LOW, strength=Strength.LOOSE, action="move")
    line = telemetry.run_record(spark, "run", cfg, 0, "/data/shoot")
    kinds = "hammingThreshold int, maxEdge int, confirmDhash boolean, folder string, settings struct<sceneMode:string,perfProfile:string,duplicateStrength:string,fileAction:string,includeSubfolders:boolean,enableAiFeatures:boolean,useAiForDedup:boolean,ollamaModel:string,ollamaTemperature:double>"
    return line.select("type", F.from_json("line", kinds).alias("r")).select("type", "r.hammingThreshold", "r.maxEdge", "r.confirmDhash", "r.folder", "r.settings.*")


images.register_runs()
