"""Exact top-k inner products by the three-phase uniform threshold (TPUT).

The components are cut into a few lists; a local score is the part of the inner
product that one list gives.  For each block of queries:

1. Each task sends, for each query and list, its k highest local scores.  Sums
   of what was seen bound the k-th score from below.
2. That bound over the number of lists, a uniform threshold, is sent to all
   tasks.  Whatever can still reach the top k has a local score of at least the
   threshold in some list; a task collects these, and drops those whose upper
   bound (unseen lists count the threshold) lies below its k-th lower bound.
3. What remains is resolved exactly, and the k best of each query stay.

Local scores are shifted to be at least 0 by the largest norm in each list, as
the thresholds need.  Queries come in blocks of at most about ``block`` rows,
which is all that is broadcast; each block scans all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

_LONG = 1 << 63
#: Scores that a task holds at once.
_CELLS = 1 << 20


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<double>, row: a hash of v) of the vectors that take part, scaled; numpy floors
    them, since floor in SQL gives a long, which is too short for large ones."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("row", F.xxhash64("v"))


def _batches(batches: Iterator[pa.RecordBatch], queries: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, hashes, matrix) of vectors of each length that queries have, a few at a time."""
    for batch in batches:
        ids, hashes, lists = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy(), batch.column("v")
        length = lists.value_lengths().to_numpy()
        values = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
        start = np.cumsum(length) - length
        for n in np.unique(length):
            if int(n) in queries:
                few = max(1, _CELLS // len(queries[int(n)][0]))
                rows = np.flatnonzero(length == n)
                for low in range(0, len(rows), few):
                    mine = rows[low : low + few]
                    yield int(n), ids[mine], hashes[mine], values[start[mine][:, None] + np.arange(n)]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with that of b, as whole numbers: by
    doubles where these are exact, else by Python integers."""
    if np.abs(a).max(initial=1) * np.abs(b).max(initial=1) * a.shape[1] < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    out = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
    return np.array([min(max(x, -_LONG), _LONG - 1) for x in out], np.int64)


def _cuts(n: int, lists: int) -> list[tuple[int, slice]]:
    """The lists that are not empty, by number."""
    at = [n * i // lists for i in range(lists + 1)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]


def _local_lists(sent, lists: int, k: int):
    """Phase 1: (query_id, part, vec_id, row, local), k for each query and list of a task."""

    def run(batches):
        queries = sent.value
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for n, ids, hashes, rows in _batches(batches, queries):
            qid, q = queries[n]
            for part, cut in _cuts(n, lists):
                local = q[:, cut] @ rows[:, cut].T
                local[qid[:, None] == ids[None, :]] = -np.inf
                found = (local, np.broadcast_to(ids, local.shape), np.broadcast_to(hashes, local.shape))
                if (n, part) in best:
                    found = tuple(np.hstack(pair) for pair in zip(best[n, part], found, strict=True))
                keep = np.argpartition(-found[0], min(k, found[0].shape[1]) - 1, axis=1)[:, :k]
                best[n, part] = tuple(np.take_along_axis(x, keep, 1) for x in found)
        for (n, part), (local, names, hashes) in best.items():
            a, b = np.nonzero(np.isfinite(local))
            yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][a]), pa.array(np.full(len(a), part, np.int32)), pa.array(names[a, b]), pa.array(hashes[a, b]), pa.array(local[a, b])], ["query_id", "part", "vec_id", "row", "local"])

    return run


def _below(x: np.ndarray) -> np.ndarray:
    """Slightly less, for what rounding may have added."""
    return x - 1e-6 * np.maximum(1, np.abs(x))


def _collect(sent, bounds, floors, lists: int, k: int):
    """Phases 2 and 3: (query_id, vec_id, score) of all that can be among the best."""

    def run(batches):
        queries = sent.value
        floor = {n: bounds.value[n] - floors.value[n].sum(1) for n in queries}  # shifted bounds of the k-th score
        for n, ids, _, rows in _batches(batches, queries):
            qid, q = queries[n]
            cuts, least = _cuts(n, lists), floors.value[n]
            threshold = _below((bounds.value[n] - least.sum(1)) / len(cuts))[:, None]
            seen, upper, some = np.zeros((len(qid), len(ids))), np.zeros((len(qid), len(ids))), np.zeros((len(qid), len(ids)), bool)
            for part, (_, cut) in enumerate(cuts):
                local = q[:, cut] @ rows[:, cut].T - least[:, part : part + 1]
                high = local >= threshold
                seen += np.where(high, local, 0)
                upper += np.where(high, local, threshold)
                some |= high
            some &= qid[:, None] != ids[None, :]
            distinct = len(np.unique(ids)) == len(ids)
            if len(ids) > k and distinct:
                floor[n] = np.maximum(floor[n], np.partition(np.where(some, seen, 0), len(ids) - k, axis=1)[:, len(ids) - k])
            a, b = np.nonzero(some & (upper >= _below(floor[n])[:, None]))
            score = _exact(q[a], rows[b])
            if distinct:  # of one batch, only the k best of a query can stay
                order = np.lexsort((ids[b], -score, a))
                first = np.searchsorted(a[order], np.arange(len(qid)))
                order = order[np.arange(len(order)) - first[a[order]] < k]
                a, b, score = a[order], b[order], score[order]
            yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(ids[b]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _by_length(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the queries of each length; of rows with one id, the smallest vector."""
    one: dict[int, list[float]] = {}
    for r in rows:
        v = [float(np.floor(x)) for x in r["v"]]
        if r["vec_id"] not in one or v < one[r["vec_id"]]:
            one[r["vec_id"]] = v
    lengths = sorted({len(v) for v in one.values()})
    return {n: (np.array([i for i, v in one.items() if len(v) == n], np.int64), np.array([v for v in one.values() if len(v) == n])) for n in lengths}


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, lists: int = 4, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for
    each row whose vec_id is divisible by ``every``, without that row itself;
    ties go to the smaller vec_id.

    Vectors that are null, empty, or hold null or infinite components take no
    part, nor do rows without an id; a query meets vectors of its own length
    only.  Rows that repeat a vec_id count once for a query, with the best
    score; as a query, the smallest vector of the id is taken.  Scores beyond
    64 bits become the nearest long.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = _whole(vectors, scale)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    shape = rows.groupBy(F.size("v").alias("n")).agg(*[F.max(_norm(i, lists)).alias(f"m{i}") for i in range(lists)])
    norms = {r["n"]: np.array([r[f"m{i}"] or 0.0 for i in range(lists)]) for r in shape.collect()}
    blocks = max(1, -(-asked.count() // block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = []
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect() if blocks > 1 else asked.collect()
        queries = _by_length(mine)
        sent = spark.sparkContext.broadcast(queries)
        found = rows.mapInArrow(_local_lists(sent, lists, k), "query_id long, part int, vec_id long, row long, local double")
        place = Window.partitionBy("query_id", "part").orderBy(F.desc("local"), "vec_id", "row")
        found = found.distinct().withColumn("at", F.row_number().over(place)).where(F.col("at") <= k)
        floors = {n: -np.stack([np.linalg.norm(q[:, c], axis=1) * norms[n][j] for j, c in _cuts(n, lists)], 1) - 1.0 for n, (_, q) in queries.items()}
        least = spark.createDataFrame([(int(q), j, float(f)) for n in queries for q, fs in zip(queries[n][0], floors[n], strict=True) for (j, _), f in zip(_cuts(n, lists), fs, strict=True)], "query_id long, part int, least double")
        # Parts of one row add up to a lower bound of its score; an id counts with its best row.
        sums = found.join(least, ["query_id", "part"]).groupBy("query_id", "vec_id", "row").agg(F.sum(F.col("local") - F.col("least")).alias("seen"))
        sums = sums.groupBy("query_id", "vec_id").agg(F.max("seen").alias("seen"))
        kth = sums.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("seen"), "vec_id"))).where(F.col("at") == k)
        cutoff = {r["query_id"]: r["seen"] for r in kth.select("query_id", "seen").collect()}
        # Fewer than k seen: nothing may be left out, and a cutoff of 0 leaves nothing out.
        bounds = {n: np.array([cutoff.get(int(x), 0.0) for x in qid]) + floors[n].sum(1) for n, (qid, _) in queries.items()}
        known = spark.sparkContext.broadcast(bounds), spark.sparkContext.broadcast(floors)
        scores = rows.mapInArrow(_collect(sent, *known, lists, k), "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        out.append(stored(scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest"))
        for held in (sent, *known):  # one block's are all that executors hold at once
            held.destroy()
    return reduce(DataFrame.unionAll, out)


def _norm(i: int, lists: int):
    """At least the Euclidean norm of a row's floored components in list i."""
    low, high = (F.floor(F.size("v") * j / lists).cast("int") for j in (i, i + 1))
    part = F.slice("v", low + 1, high - low)
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)))
