"""Exact n-gram Jaccard join by a size-aware heavy-light scheme.

Texts are sets of distinct word n-grams.  Two texts link when the intersection
holds at least ``percent`` hundredths of the union.  The result is the classes
of the link graph, which need no list of all pairs.

1. Equal sets are one set from here on.
2. Sets of at most ``boundary`` shingles are small: similar ones share a subset
   of a fixed size, so each enumerates its subsets of those sizes.  Larger sets
   are entered in inverted lists and found by scanning these.  The boundary is
   where, over the counted sizes of the corpus, both together cost least.
3. A list per shingle would gather every text that quotes a common passage.  So
   the shingles are dealt by hash into more cells than two similar sets can
   differ in; then some cell is equal in both, and the lists are keyed by the
   content of a cell.  Shingles that many sets have (counted over all data) are
   heavy: cells are made of the light ones alone, which loses nothing, and only
   a set with too few light cells is also listed with all its shingles.
4. Members of a list are tied to its first member; connected components of
   these ties are candidate clusters.  Each is resolved exactly by a search
   that scans the rarest shingles of its members and counts intersections.
   A cluster over ``cluster_shingles`` is cut into blocks, and every pair of
   blocks is resolved in its own task.

Signatures are hashes of 64 bits; false candidates cost time only, and
intersections are counted on 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .packed import multikey_order, pack, slices, unpack
from .rolling import U64, mix
from .runtime import NO_ID, content_key, order_id, private, stored
from .shingles import shingle_set

DOC, TIE, SIGNATURE = 0, 1, 2
_GATHER = 1 << 20
_SMALL_LIMIT = 24


def needed(percent: int, total: int) -> int:
    """Least intersection of two linked sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def partner_limit(percent: int, n: int) -> int:
    """Size of the largest set that a set of n shingles can link with."""
    return 100 * n // percent


def overlap_of(percent: int, n: int) -> int:
    """Least intersection of any linked pair with a set of n shingles."""
    return -(-percent * n // 100)


@cache
def max_difference(percent: int, largest: int) -> int:
    """Most shingles that are in one only of two linked sets of at most ``largest``."""
    n = np.arange(overlap_of(percent, largest), largest + 1, dtype=np.int64)
    return int((n + largest - 2 * -(-percent * (n + largest) // (100 + percent))).max())


@cache
def size_classes(percent: int, boundary: int) -> tuple[tuple[int, int, int], ...]:
    """(largest size, most differences, cells) of each class of large sets."""
    growth = max(1.5, 101 / percent)
    out, top = [], boundary
    while top < 1 << 28:
        top = max(top + 1, partner_limit(percent, top), int(top * growth))
        # The difference grows with the size; its exact maximum matters for small sizes only.
        differ = max_difference(percent, top) if top < 1 << 22 else 2 * top * (100 - percent) // (100 + percent) + 2
        out.append((top, differ, int(1.06 * (differ + 1)) + 2))
    return tuple(out)


def subset_sizes(percent: int, boundary: int, n: int) -> list[int]:
    largest = min(boundary, partner_limit(percent, n))
    return sorted({overlap_of(percent, m) for m in range(n, largest + 1)} & set(range(1, n + 1)))


def choose_boundary(percent: int, counts: dict[int, int], scan: float = 4.0) -> int:
    """The size up to which enumerating subsets costs least, given how many
    sets there are of each small size; scan: cost of a list entry in subsets."""

    def cost(boundary: int) -> float:
        total = 0.0
        classes = size_classes(percent, boundary)
        for n, sets in counts.items():
            if n <= boundary:
                total += sets * sum(comb(n, s) for s in subset_sizes(percent, boundary, n))
            if partner_limit(percent, n) > boundary:
                total += sets * scan * sum(min(n, c) for _, _, c in _lists_of(percent, boundary, classes, n))
        return total

    return min(range(1, _SMALL_LIMIT + 1), key=cost)


def _lists_of(percent: int, boundary: int, classes, n: int):
    own = next(i for i, c in enumerate(classes) if n <= c[0])
    if n <= boundary:
        return classes[:1]
    return classes[own : own + 1 + (partner_limit(percent, n) > classes[own][0])]


def signatures(shingles: np.ndarray, percent: int, boundary: int, heavy: np.ndarray) -> np.ndarray:
    """Hashes of which two linked, unequal sets share at least one."""
    n = len(shingles)
    classes = size_classes(percent, boundary)
    weight = mix(shingles ^ U64(0x5851F42D4C957F2D))
    out = []
    if n <= boundary:
        whole = weight.sum(dtype=U64)
        for size in subset_sizes(percent, boundary, n):
            gone = list(combinations(range(n), n - size))
            less = weight[np.array(gone, np.int64)].sum(1, dtype=U64) if n > size else np.zeros(1, U64)
            out.append(mix((whole - less) ^ U64(size << 32 | 1)))
    if partner_limit(percent, n) > boundary:
        light = shingles
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
            light = shingles[heavy[at] != shingles]
        for top, _, cells in _lists_of(percent, boundary, classes, n):
            # What this set can differ in from a partner of this class, not the most that any pair can.
            differ = (n + min(top, partner_limit(percent, n))) * (100 - percent) // (100 + percent)
            found, filled = _cells(light, top, cells, 0)
            out.append(found)
            if filled <= differ:
                found, filled = _cells(shingles, top, cells, 1)
                out.append(found)
                if filled <= differ:
                    out.append(_cells(shingles, top, cells, 1, empty=True)[0])
    return np.unique(np.concatenate(out)) if out else np.empty(0, U64)


def _cells(shingles: np.ndarray, top: int, cells: int, tag: int, empty: bool = False) -> tuple[np.ndarray, int]:
    """A hash for each cell that has shingles (or has none), and how many have."""
    deal = mix(shingles + U64(top))
    cell = (((deal >> U64(32)) * U64(cells)) >> U64(32)).astype(np.int64)
    order = np.argsort(cell)
    cell = cell[order]
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    salt = U64((top << 1 | tag) * 0x2545F4914F6CDD1D % (1 << 64))
    if empty:
        rest = np.setdiff1d(np.arange(cells), cell[start]).astype(U64)
        return mix(mix(rest + salt) ^ U64(7)), len(start)
    content = np.add.reduceat(mix(deal[order] ^ U64(0x9E6C63D0876A9A99)), start) if len(start) else np.empty(0, U64)
    return mix(content + mix(cell[start].astype(U64) + salt)), len(start)


def digest_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = int(mix(shingles).sum(dtype=U64)) + len(shingles) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total % (1 << 64)], U64)).view(np.int64)[0])


def link_classes(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the number of a set of its class; the classes are exact.

    A search from one set to the next scans the postings of its rarest shingles
    (linked sets share one among them) and counts whole intersections with the
    sets that have no class yet, so that a group of near copies costs about
    one comparison a member and not one a pair.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    values, code, count = np.unique(np.concatenate(sets) if m else np.empty(0, U64), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    code = rank[code]
    code = code[np.lexsort((code, owner))]
    start = np.cumsum(size) - size
    rare = size - -(-percent * size // 100) + 1
    first = _ranges(start, rare)
    listed = code[first]
    who = np.repeat(np.arange(m), rare)
    by = np.argsort(listed, kind="stable")
    listed, who = listed[by], who[by]
    begin = np.searchsorted(listed, np.arange(len(values) + 1))
    label = np.full(m, -1)
    mark = np.zeros(len(values), bool)
    for seed in range(m):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        stack = [seed]
        while stack:
            x = stack.pop()
            own = code[start[x] : start[x] + size[x]]
            lists = own[: rare[x]]
            near = np.unique(who[_ranges(begin[lists], begin[lists + 1] - begin[lists])])
            near = near[(label[near] < 0) & (100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x]))]
            if not len(near):
                continue
            mark[own] = True
            hit = mark[code[_ranges(start[near], size[near])]]
            mark[own] = False
            both = np.add.reduceat(hit, np.cumsum(size[near]) - size[near], dtype=np.int64)
            new = near[100 * both >= percent * (size[x] + size[near] - both)]
            label[new] = seed
            stack.extend(new.tolist())
    return label


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each given length, one after the other."""
    end = np.cumsum(length)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)


def _count(width: int, least: int):
    """Shingles that many sets of one task have, and how many sets of each small size there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(_SMALL_LIMIT * 2 + 1, np.int64)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def flush():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= least
            return _rows(kind=np.zeros(often.sum(), np.int8), value=value[often].view(np.int64), n=count[often])

        for batch in batches:
            for text in batch.column("text"):
                shingles = shingle_set(text.as_buffer(), width)
                digest = digest_of(shingles)
                if digest in seen:
                    continue
                seen.add(digest)
                if len(shingles) < len(sizes):
                    sizes[len(shingles)] += 1
                held.append(shingles)
                total += len(shingles)
                if total >= 3 * _GATHER:
                    yield flush()
                    held, total = [], 0
                    seen.clear()
        if held:
            yield flush()
        yield _rows(kind=np.ones(len(sizes), np.int8), value=np.arange(len(sizes)), n=sizes)

    return run


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _sign(width: int, percent: int, boundary: int, heavy, base: int):
    """Signatures of all sets of a task, one member of each list, and the rest tied to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, part = heavy.value, TaskContext.get().partitionId()
        seen: dict[int, None] = {}
        docs: list[tuple[int, int, int, int]] = []
        signs: list[np.ndarray] = []
        owners: list[int] = []
        total = 0

        def flush():
            out = [(base + part % base, DOC, pack(list(np.array(docs, np.int64).reshape(-1, 4).T)))]
            if signs:
                sign = np.concatenate(signs)
                digest = np.repeat(np.array(owners, np.int64), [len(s) for s in signs])
                sign, digest, ties = _tie(sign, digest)
                out.append((base + part % base, TIE, pack(list(ties))))
                bucket = ((sign >> U64(32)) * U64(base)) >> U64(32)
                for b, rows in slices(bucket.astype(np.int64)):
                    names, index = np.unique(digest[rows], return_inverse=True)
                    out.append((b, SIGNATURE, pack([sign[rows], index.astype(np.uint32), names], ascending=0)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int8(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "hash"))
            for text, doc, hash_ in zip(batch.column("text"), ids, hashes, strict=True):
                shingles = shingle_set(text.as_buffer(), width)
                digest = digest_of(shingles)
                docs.append((doc, hash_, digest, len(shingles)))
                if len(shingles) and digest not in seen:
                    seen[digest] = None
                    signs.append(signatures(shingles, percent, boundary, common))
                    owners.append(digest)
                    total += len(signs[-1])
                if total >= _GATHER or len(docs) >= _GATHER:
                    yield flush()
                    docs, signs, owners, total = [], [], [], 0
                    seen.clear()
        if docs:
            yield flush()

    return run


def _tie(sign: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The first member of each list, in the order of lists, and ties of the others to it."""
    order = multikey_order([sign, digest])
    sign, digest = sign[order], digest[order]
    first = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
    head = np.repeat(digest[first], np.diff(np.concatenate((first, [len(sign)]))))
    ties = np.unique(np.stack((head, digest), 1)[head != digest], axis=0)
    return sign[first], digest[first], (ties[:, 0].copy(), ties[:, 1].copy())


_SIGNED = "kind byte, doc long, hash long, a long, b long"


def _scan(base: int):
    """One range of inverted lists."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        out, sign, digest = [], [], []
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("payload"), strict=True):
            columns = unpack(blob.as_py())
            if kind == DOC:
                out.append((DOC, *columns))
            elif kind == TIE:
                out.append((TIE, np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), np.int64), *columns))
            else:
                sign.append(columns[0])
                digest.append(columns[2][columns[1]])
        if sign:
            _, _, (a, b) = _tie(np.concatenate(sign), np.concatenate(digest))
            out.append((TIE, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b))
        tables = [pa.table({"kind": np.full(len(c[0]), kind, np.int8), **dict(zip(("doc", "hash", "a", "b"), c, strict=True))}) for kind, *c in out]
        return pa.concat_tables(tables)

    return run


def _resolve(width: int, percent: int):
    """The clusters of one task, exactly."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        cluster = group.column("cluster").to_numpy()
        digest = group.column("digest").to_numpy()
        text = group.column("text")
        found, label = [], []
        for _, rows in slices(cluster):
            digests, at = np.unique(digest[rows], return_index=True)
            sets = [shingle_set(text[int(rows[i])].as_buffer(), width) for i in at]
            found.append(digests)
            label.append(digests[link_classes(sets, percent)])
        return pa.table({"a": np.concatenate(found), "b": np.concatenate(label)})

    return run


def link_components(documents: DataFrame, width: int = 4, percent: int = 85, cluster_shingles: int = 4_000_000, shingles_per_range: int = 4_000_000, max_heavy: int = 1_000_000, boundary: int | None = None) -> DataFrame:
    """(doc_id, hash, n_shingles, component_id, class), one row per row of ``documents``.

    Texts with fewer than ``width`` words are one shingle, the whole sequence.
    Null texts, empty texts and texts of white space have none and link with
    nothing: component_id is their own doc_id.  A null doc_id stays null and
    counts as no id; a class of such rows alone has a null component_id.  Rows
    that repeat a doc_id are rows of their own, and repeated texts are linked.
    hash tells rows of one doc_id apart, and class names a class also where no
    row of it has an id (null: no shingles).  Other columns are not looked at.
    ``max_heavy`` bounds the heavy shingles that are sent to the executors (8
    bytes each); which ones they are changes the cost and not the result.
    """
    spark = documents.sparkSession
    texts = documents.select(order_id("doc_id").alias("doc"), content_key("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    counted = stored(texts.select("text").mapInArrow(_count(width, 2), "kind byte, value long, n long"), "counts").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    often = counted.where("kind = 0 and n >= 16").orderBy(F.desc("n"), "value").limit(max_heavy).select("value").toPandas()["value"]
    heavy = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(U64)))
    small = {r["value"]: r["n"] for r in counted.where("kind = 1 and value > 0").collect()}
    boundary = choose_boundary(percent, small) if boundary is None else boundary

    total = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    base = max(1, -(-total // 6 // shingles_per_range) * 2)
    signed = texts.mapInArrow(_sign(width, percent, boundary, heavy, base), "bucket int, kind byte, payload binary")
    signed = stored(signed.groupBy("bucket").applyInArrow(_scan(base), _SIGNED), "signed")
    docs = signed.where(F.col("kind") == DOC).select("doc", "hash", F.col("a").alias("digest"), F.col("b").alias("n_shingles"))
    clusters = components(signed.where(F.col("kind") == TIE).select("a", "b"))

    sets = docs.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc", "hash")).alias("at"), F.first("n_shingles").alias("n"))
    members = sets.join(clusters.withColumnRenamed("node", "digest"), "digest").select("digest", "n", F.col("component").alias("cluster"), "at.*")
    weights = members.groupBy("cluster").agg(F.sum("n").alias("weight"))
    members = stored(members.join(weights, "cluster"), "members")
    held = members.agg(F.sum("n").alias("n"), F.sum((F.col("weight") > cluster_shingles).cast("int")).alias("large")).first()
    tasks = max(1, -(-(held["n"] or 0) * 4 // cluster_shingles))
    blocks = F.ceil(F.col("weight") / F.lit(cluster_shingles)).cast("int")
    block = F.pmod(F.xxhash64("digest"), blocks)
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    common = members.where(F.col("weight") <= cluster_shingles).withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("string"))
    large = members.where(F.col("weight") > cluster_shingles).withColumn("other", other).withColumn("task", F.concat_ws(" ", "cluster", F.least(block, "other"), F.greatest(block, "other")))
    dealt = common if not held["large"] else common.unionByName(large.drop("other"))
    fetched = texts.join(dealt.select("doc", "hash", "digest", "cluster", "weight", "task").hint("shuffle_hash"), ["doc", "hash"])
    linked = stored(fetched.select("task", "cluster", "digest", "text", "weight").groupBy("task").applyInArrow(_resolve(width, percent), "a long, b long"), "linked")
    if held["large"]:
        labels = components(linked).select(F.col("node").alias("digest"), F.col("component").alias("class"))
    else:
        labels = linked.select(F.col("a").alias("digest"), F.col("b").alias("class"))

    # NO_ID is the least of all ids, so the least true one is looked for beside it.
    true_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    filled = docs.where("n_shingles > 0")
    copies = filled.groupBy("digest").agg(F.min(true_id).alias("least"), F.count("*").alias("copies"))
    named = stored(copies.join(labels, "digest", "left").withColumn("class", F.coalesce("class", "digest")), "named")
    classes = named.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    ids = _join_hot(named.drop("least"), classes, "class", "members").select("digest", "copies", "component_id", "class")
    out = _join_hot(filled, stored(ids, "ids"), "digest", "copies").select(true_id.alias("doc_id"), "hash", "n_shingles", "component_id", "class")
    empty = docs.where("n_shingles = 0").select(true_id.alias("doc_id"), "hash", "n_shingles", true_id.alias("component_id"), F.lit(None).cast("long").alias("class"))
    return out.unionAll(empty)


def _join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, share: int = 1_000) -> DataFrame:
    """rows joined with table, which has one row a key and in ``size`` how many
    rows that key has.  Keys of over a ``share``-th of all rows, which are fewer
    than ``share``, are sent to the rows, so no task gets a group of copies whole."""
    total = table.agg(F.sum(size).alias("n")).first()["n"] or 0
    is_hot = F.col(size) * share > F.lit(total)
    hot = table.where(is_hot).drop(size)
    if hot.isEmpty():
        return rows.join(table.drop(size), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot).drop(size), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def keep_one_of_each(documents: DataFrame, width: int = 5, percent: int = 80, **given) -> DataFrame:
    """``documents``, all columns, with one row of each class: that of the
    smallest doc_id, rows without one last.  Rows without shingles all stay."""
    linked = stored(link_components(documents, width, percent, **given).withColumn("doc", order_id("doc_id")), "linked")
    # Rows without an id come after all others of their class.
    first = linked.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc", "hash")).alias("at")).select("at.doc", "at.hash")
    doc, hash_ = private(documents, 2)
    stay = first.unionAll(linked.where("class is null").select("doc", "hash").distinct()).select(F.col("doc").alias(doc), F.col("hash").alias(hash_))
    keyed = documents.withColumns({doc: order_id("doc_id"), hash_: content_key("text")})
    kept = keyed.join(stored(stay, "stay").hint("shuffle_hash"), [doc, hash_], "left_semi")
    repeated = linked.where("class is not null").groupBy("doc", "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:  # equal rows with shingles are one class, so one of them stays
        bare = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", ""))
        kept = kept.where(bare != "").dropDuplicates([doc, hash_]).unionByName(kept.where(bare == ""))
    return kept.select(*documents.columns)
