"""Near-duplicate groups: exact groups, Hamming pairs, complete linkage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIRM_SLACK
from ..functions.hashing import hamming
from ..tables import stored
from .graph import components


#: Rows and comparisons from which a join of bands is dearer than arrays.
DEAR_JOIN = 100_000_000


def exact_groups(records: DataFrame, record_id: str, content: str) -> DataFrame:
    """(record_id, group_id, group_size) of the rows whose content others have too.

    Null contents are in no group.  The smallest id names the group."""
    key = F.sha2(F.col(content).cast("binary"), 256)
    keyed = records.where(F.col(content).isNotNull() & F.col(record_id).isNotNull()).select(F.col(record_id), key.alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.min(record_id).alias("group_id"), F.count("*").alias("group_size")).where("group_size >= 2")
    return keyed.join(sizes, "_key").drop("_key")


def is_near(h1a: Column, h1b: Column, h2a: Column, h2b: Column, threshold: int, confirm: bool) -> Column:
    """A missing first hash is never near; a missing second one always agrees."""
    near = F.coalesce(hamming(h1a, h1b) <= threshold, F.lit(False))
    return near & F.coalesce(hamming(h2a, h2b) <= threshold + CONFIRM_SLACK, F.lit(True)) if confirm else near


@dataclass(frozen=True)
class Bands:
    """A way to find all pairs within a distance: the bits cut into bands, and
    for each the radius within which one side is looked up.

    If two hashes differ in at most T bits and the radii r satisfy
    sum(r + 1) = T + 1, some band differs in at most its r bits."""

    edges: tuple[int, ...]
    radii: tuple[int, ...]

    @property
    def probes(self) -> list[int]:
        widths = [hi - lo for lo, hi in zip(self.edges, self.edges[1:], strict=False)]
        return [sum(comb(w, k) for k in range(r + 1)) for w, r in zip(widths, self.radii, strict=True)]

    def cost(self, n: int) -> float:
        """Rows of the join on both sides and the pairs it compares, for n hashes spread evenly."""
        widths = [hi - lo for lo, hi in zip(self.edges, self.edges[1:], strict=False)]
        return n * (len(widths) + sum(self.probes)) + n * n / 2 * sum(p / 2.0**w for p, w in zip(self.probes, widths, strict=True))

    @classmethod
    def of(cls, threshold: int, count: int) -> Bands:
        edges = tuple(64 * i // count for i in range(count + 1))
        more, radius = (threshold + 1) % count, (threshold + 1) // count - 1
        return cls(edges, tuple(radius + (i < more) for i in range(count)))

    @classmethod
    def best(cls, threshold: int, n: int) -> Bands:
        """The cheapest for n hashes: bands grow wider, and their radii larger, with n."""
        ways = [cls.of(threshold, m) for m in range(1, threshold + 2)]
        return min((w for w in ways if max(w.probes) <= 4_096), key=lambda w: w.cost(n))


def _masks(width: int, radius: int) -> Column:
    values = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def candidates(values: DataFrame, threshold: int, bands: Bands) -> DataFrame:
    """(ha, hb) with ha < hb of all distinct hashes ``h1`` within ``threshold``,
    each pair once: it comes from the first band that would find it."""
    x, y = F.col("x.h1"), F.col("y.h1")
    spans = list(zip(bands.edges, bands.edges[1:], bands.radii, strict=False))
    band = lambda h, lo, hi: F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
    held = values.select("h1", F.posexplode(F.array(*[band(F.col("h1"), lo, hi) for lo, hi, _ in spans])).alias("band", "value"))
    looked = []
    for i, (lo, hi, radius) in enumerate(spans):
        changed = values.select("h1", F.explode(_masks(hi - lo, radius)).alias("mask"))
        looked.append(changed.select("h1", F.lit(i).alias("band"), F.col("mask").bitwiseXOR(band(F.col("h1"), lo, hi)).alias("value")))
    within = [F.bit_count(band(x.bitwiseXOR(y), lo, hi)) <= r for lo, hi, r in spans]
    first = F.lit(len(spans))
    for i in reversed(range(len(spans))):
        first = F.when(within[i], F.lit(i)).otherwise(first)
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (x < y) & (hamming(x, y) <= threshold) & (F.col("x.band") == first)
    return reduce(DataFrame.unionAll, looked).alias("x").join(held.alias("y"), on).select(x.alias("ha"), y.alias("hb"))


@dataclass(frozen=True)
class _Cells:
    """Hashes sorted by one band, and where each value of the band begins."""

    hashes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> _Cells:
        value = (hashes >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        return cls(hashes[order], ids[order], np.searchsorted(value[order], np.arange((1 << hi - lo) + 1)))


#: Nanoseconds of a comparison, of a cell and of a hash picked for a cell, as
#: measured; pairs compared at once; hashes in a block; widest band with cells.
_COMPARE, _CELL, _PICK, _AT_ONCE, _BLOCK, _WIDEST = 2, 40_000, 10, 1 << 17, 1 << 17, 16


def _block_cost(bands: Bands, nx: int, ny: int) -> float:
    widths = [hi - lo for lo, hi in zip(bands.edges, bands.edges[1:], strict=False)]
    cells = [min(2**w, nx) for w in widths]
    return sum(c * _CELL + ny * p / 2**w * (nx * _COMPARE + c * _PICK) for c, p, w in zip(cells, bands.probes, widths, strict=True))


def _block_bands(threshold: int, nx: int, ny: int) -> Bands:
    """The cheapest way to compare two blocks; with no band narrow enough, one without a bit."""
    ways = [Bands.of(threshold, m) for m in range(1, threshold + 2)]
    ways = [w for w in ways if max(hi - lo for lo, hi in zip(w.edges, w.edges[1:], strict=False)) <= _WIDEST and max(w.probes) <= 4_096]
    return min([*ways, Bands((0, 0), (0,))], key=lambda w: _block_cost(w, nx, ny))


def block_pairs(hx: np.ndarray, ix: np.ndarray, hy: np.ndarray, iy: np.ndarray, threshold: int, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id of x, id of y, distance) of all hashes of two blocks within
    ``threshold``, each pair once: from the first band that finds it."""
    spans = list(zip(bands.edges, bands.edges[1:], bands.radii, strict=False))
    for band, (lo, hi, radius) in enumerate(spans):
        x, y = _Cells.of(hx, ix, lo, hi), _Cells.of(hy, iy, lo, hi)
        masks = np.array(sorted(sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(hi - lo), k)), np.int64)
        for value in np.flatnonzero(np.diff(x.starts)):
            near = value ^ masks
            start, count = y.starts[near], y.starts[near + 1] - y.starts[near]
            total = int(count.sum())
            if not total:
                continue
            place = np.repeat(start - np.cumsum(count) + count, count) + np.arange(total)
            other = y.hashes[place]
            first, last = x.starts[value], x.starts[value + 1]
            tall = max(1, min(last - first, 64))
            wide = _AT_ONCE // tall
            for i in range(first, last, tall):
                some = x.hashes[i : min(i + tall, last), None]
                for j in range(0, total, wide):
                    part = other[j : j + wide]
                    dist = np.bitwise_count(some ^ part)
                    at = np.flatnonzero(dist.reshape(-1) <= threshold)
                    if len(at):
                        r, c = at // len(part), at % len(part)
                        apart = some[r, 0] ^ part[c]
                        new = np.ones(len(at), bool)
                        for lo_, hi_, radius_ in spans[:band]:
                            new &= np.bitwise_count(apart >> np.uint64(lo_) & np.uint64((1 << hi_ - lo_) - 1)) > radius_
                        yield x.ids[i + r[new]], y.ids[place[j + c[new]]], dist.reshape(-1)[at[new]]


def _compare(threshold: int):
    def run(part: pa.Table) -> pa.Table:
        left = part.column("left").to_numpy()
        hashes, ids = part.column("h1").to_numpy().view(np.uint64), part.column("id").to_numpy()
        x = hashes[left], ids[left]
        alone = bool(left.all())  # a block with itself
        y = x if alone else (hashes[~left], ids[~left])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
        for a, b, dist in block_pairs(*x, *y, threshold, _block_bands(threshold, len(x[0]), len(y[0]))):
            out.append((a[a < b], b[a < b], dist[a < b]) if alone else (np.minimum(a, b), np.maximum(a, b), dist))
        a, b, dist = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "dist": dist.astype(np.int32)})

    return run


def compared(values: DataFrame, threshold: int, n: int) -> DataFrame:
    """(a, b, dist) with a < b of all of the n rows (id, h1), ids distinct, that are within ``threshold``.

    Blocks of up to 131,072 rows are compared, each two in one task, cell by
    cell of a few bands (``block_pairs``): the comparisons run over plain arrays
    and cost a small part of a join's."""
    blocks = max(12, -(-n // _BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = values.select("id", "h1", own.alias("own")).select("id", "h1", "own", other.alias("other"))
    dealt = dealt.select((F.least("own", "other") * F.lit(blocks).cast("long") + F.greatest("own", "other")).alias("task"), (F.col("own") <= F.col("other")).alias("left"), "id", "h1")
    return dealt.repartition(blocks * (blocks + 1) // 2, "task").groupBy("task").applyInArrow(_compare(threshold), "a long, b long, dist int")


def near_pairs(hashes: DataFrame, threshold: int, confirm: bool = False) -> DataFrame:
    """(a, b, dist) with a < b of all rows of (id, h1, h2) that are near.

    Two hashes within the threshold agree in some band but for a few bits, so
    an equi-join of bands with bands changed in up to so many bits finds all
    pairs; how many bands is chosen by cost from the number of distinct hashes
    (``Bands``).  Rows of one hash are one value in that join, and pairs are
    spelt out at the end, as many as the result has.  Where that join is dear,
    blocks of hashes are compared as arrays (``compared``)."""
    rows = hashes.where("id is not null and h1 is not null")
    values = stored(rows.groupBy("h1").agg(F.min("id").alias("id"), F.count("*").alias("n")), "values")
    n, most = values.agg(F.count("*"), F.max("n")).first()
    bands = Bands.best(threshold, n)
    dear = bands.cost(n) > DEAR_JOIN
    if dear and most == 1 and not confirm:
        return compared(values, threshold, n)
    if dear:
        of = lambda end: values.select(F.col("id").alias(end), F.col("h1").alias(f"h{end}"))
        near = compared(values, threshold, n).join(of("a"), "a").join(of("b"), "b").select("ha", "hb")
    else:
        near = candidates(values, threshold, bands)
    near = near.unionAll(values.select(F.col("h1").alias("ha"), F.col("h1").alias("hb")))
    left, right = rows.alias("l"), rows.alias("r")
    pairs = near.join(left, F.col("ha") == F.col("l.h1")).join(right, F.col("hb") == F.col("r.h1")).where((F.col("ha") != F.col("hb")) | (F.col("l.id") < F.col("r.id")))
    if confirm:
        pairs = pairs.where(is_near(F.col("l.h1"), F.col("r.h1"), F.col("l.h2"), F.col("r.h2"), threshold, True))
    return pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), hamming(F.col("ha"), F.col("hb")).cast("int").alias("dist"))


def _walk(x: np.ndarray, y: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, group) of links x-y in the order of their ranks, of which the
    first so many are followed, or all.  A link joins its groups if they have an
    open link, and another group keeps one with both together if it had one with
    each; so each link is dropped once."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    same = list(range(len(nodes)))  # one object per node
    links = [(same[i], same[j]) for i, j in zip(at[: len(x)], at[len(x) :], strict=True)]
    near: list[set[int]] = [set() for _ in same]
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    group, members = list(same), [[i] for i in same]
    for i, j in links[:first]:
        p, q = group[i], group[j]
        if q in near[p]:
            if len(members[p]) < len(members[q]):
                p, q = q, p
            both = near[p] & near[q]
            for z in near[p] - both:
                near[z].discard(p)
            for z in near[q]:
                near[z].discard(q)
            near[p], near[q] = both, set()
            for k in members[q]:
                group[k] = p
            members[p] += members[q]
    return nodes, nodes[group]


#: Nodes of which each can have a bit for every other: 32 MB.
_DENSE = 16_384


def _walk_dense(x: np.ndarray, y: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``_walk``, for up to ``_DENSE`` nodes with many links: a group has the
    bits of its members and of the nodes that are near to all of them."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    at, n, m = at.astype(np.int32), len(nodes), len(x)
    first = m if first is None else first
    order = np.argsort(at, kind="stable")
    other, ends = np.concatenate((at[m:], at[:m]))[order], np.cumsum(np.bincount(at, minlength=n))
    near = []
    for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
        row = np.zeros(n, bool)
        row[other[lo:hi]] = True
        near.append(int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little"))
    del order, other
    group, members, held = list(range(n)), [[i] for i in range(n)], [1 << i for i in range(n)]
    for lo in range(0, first, 100_000):
        hi = min(lo + 100_000, first)
        for i, j in zip(at[lo:hi].tolist(), at[m + lo : m + hi].tolist(), strict=True):
            p, q = group[i], group[j]
            if p != q and near[p] & held[q] == held[q]:
                if len(members[p]) < len(members[q]):
                    p, q = q, p
                near[p] &= near[q]
                held[p] |= held[q]
                for k in members[q]:
                    group[k] = p
                members[p] += members[q]
    return nodes, nodes[group]


def _link(part: pa.Table) -> pa.Table:
    """(old, new) of some components, each walked through by itself if it has many links."""
    component, followed = part.column("component").to_numpy(), part.column("followed").to_numpy()
    keys = [part.column(name).to_numpy() for name in sorted(part.column_names, reverse=True) if name.startswith("k")]
    order = np.lexsort([*keys, component])
    x, y, followed, component = (c[order] for c in (part.column("x").to_numpy(), part.column("y").to_numpy(), followed, component))
    starts = np.flatnonzero(np.concatenate(([True], component[1:] != component[:-1], [True])))
    many = np.diff(starts) > 1_000
    out = []
    for lo, hi in zip(starts[:-1][many], starts[1:][many], strict=True):
        dense = len(np.union1d(x[lo:hi], y[lo:hi])) <= _DENSE
        out.append((_walk_dense if dense else _walk)(x[lo:hi], y[lo:hi], int(followed[lo:hi].sum())))
    few = ~np.repeat(many, np.diff(starts))
    if few.any():  # their order within each is all that counts
        ahead = np.argsort(~followed[few], kind="stable")
        out.append(_walk(x[few][ahead], y[few][ahead], int(followed[few].sum())))
    nodes, group = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"old": nodes, "new": group}).filter(pa.array(nodes != group))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links a-b of a task."""
    held = list(batches)
    if held:
        a, b = (np.concatenate([part.column(c).to_numpy() for part in held]) for c in "ab")
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        i, j, least, old = at[: len(a)], at[len(a) :], np.arange(len(nodes)), None
        while old is None or (least != old).any():
            old = least
            lower = np.minimum(least[i], least[j])
            least = least.copy()
            for end in (old[i], old[j], i, j):
                np.minimum.at(least, end, lower)
            while (least[least] != least).any():
                least = least[least]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], ["node", "component"])


def _components(links: DataFrame, n: int, most: int) -> DataFrame:
    """(node, component) of n links (x, y): in one task, if they are few."""
    ends = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    return stored(ends.repartition(1).mapInArrow(_labelled, "node long, component long"), "components") if n <= most else components(ends)


def _merged(links: DataFrame) -> DataFrame:
    """(old, new) of all links that come before every other of both their groups.

    The greedy walk takes such a link before all others of its groups, so all
    of them are merged at once."""
    ends = links.select(F.col("x").alias("g"), "rank").unionAll(links.select(F.col("y").alias("g"), "rank"))
    best = ends.groupBy("g").agg(F.min("rank").alias("rank"))
    return best.groupBy("rank").agg(F.max("g").alias("old"), F.min("g").alias("new")).where("old <> new").select("old", "new")


def _contracted(links: DataFrame, changed: DataFrame, twos: bool) -> DataFrame:
    """Open links of the groups after ``changed`` (old, new): those of which
    every part has a link with every part of the other.  twos: no group has
    more than two parts."""
    if twos:
        own = changed.select(F.col("new").alias("old"), "new")
        parts = changed.unionAll(own).withColumn("parts", F.lit(2).cast("long"))
    else:
        sizes = changed.groupBy("new").agg((F.count("*") + 1).alias("parts"))
        parts = stored(changed.join(sizes, "new").select("old", "new", "parts").unionAll(sizes.select(F.col("new").alias("old"), "new", "parts")), "parts")
    parts = F.broadcast(parts) if parts.count() <= 500_000 else parts
    end = lambda e: parts.select(F.col("old").alias(e), F.col("new").alias(f"new_{e}"), F.col("parts").alias(f"parts_{e}"))
    moved = links.join(end("x"), "x", "left").join(end("y"), "y", "left")
    p, q, wanted = F.coalesce("new_x", "x"), F.coalesce("new_y", "y"), F.coalesce("parts_x", F.lit(1)) * F.coalesce("parts_y", F.lit(1))
    moved = moved.select(F.least(p, q).alias("x"), F.greatest(p, q).alias("y"), wanted.alias("wanted"), "rank").where("x <> y")
    summed = moved.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("wanted").alias("wanted"), F.min("rank").alias("rank"))
    return stored(summed.where("n = wanted").select("x", "y", "rank"), "links")


def _placed(member: DataFrame | None, changed: list[DataFrame]) -> DataFrame:
    """(id, g) of all ids that are in a group of two or more, after each of ``changed`` in turn."""
    ends = reduce(DataFrame.unionAll, (c.select(F.col(e).alias("id")) for c in changed for e in ("old", "new"))).distinct()
    own = ends if member is None else ends.join(member, "id", "left_anti")
    rows = own.select("id", F.col("id").alias("g"))
    rows = rows if member is None else member.unionAll(rows)
    for one in changed:
        rows = rows.join(one.withColumnRenamed("old", "g"), "g", "left").select("id", F.coalesce("new", "g").alias("g"))
    return stored(rows, "members")


def _early(links: DataFrame, dist: Column, nodes: int) -> list[int]:
    """The distances of links, up to the largest that has not so many links that
    these alone would tie most of the nodes together; the least in any case."""
    found = sorted(tuple(r) for r in links.groupBy(dist.alias("dist")).agg(F.count("*")).collect())
    last = max((d for d, n in found if 4 * n <= nodes), default=found[0][0])
    return [d for d, _ in found if d <= last]


def complete_linkage(edges: DataFrame, exact: DataFrame | None = None, most_edges: int = 1_000_000) -> DataFrame:
    """(id, group_id) of groups of two or more in which every pair is near.

    edges: all near pairs (a, b, dist).  exact: pairs (a, b) that are one group
    whatever their distance, such as a chain over equal contents.  Edges by
    (dist, a, b) join two groups if every pair across them is an edge.

    A link of two groups is open while every pair across them is an edge, its
    rank is the first of these edges, and a link that is no longer open can
    never open again; so after any merges the groups and their open links are a
    smaller case of the same.  Merges only follow links, so connected components
    are independent: those of up to ``most_edges`` links are walked through in
    one task each, and so are those of up to four times as many between at most
    16,384 groups, as large groups of near copies have, in which rounds merge
    little.

    Where there are more links than that, those up to some distance (``_early``)
    are followed first, in the components that these alone make, with all links
    within each; a later link cannot change what an earlier one did.  Where such
    a component is still too large, it is left for a smaller distance.  Then
    links are merged by rounds of joins (``_merged``), as long as each round
    takes a fifth of them, and looked at again; at last, links of components
    that are too large are merged by rounds until half of them are gone.
    Tables of each round are written to the shared folder.
    """
    edges = edges.select("a", "b", "dist")
    low, high, nodes = edges.agg(F.min(F.least("a", "b")), F.max(F.greatest("a", "b")), F.approx_count_distinct("a")).first()
    if low is not None and high - low < 1 << 28:  # a rank in one number is sorted much faster
        rank = F.shiftleft(F.col("dist").cast("long"), 56) + F.shiftleft(F.col("a") - F.lit(low), 28) + (F.col("b") - F.lit(low))
        keys, dist = [F.col("rank")], F.shiftright("rank", 56).cast("int")
    else:
        rank = F.struct("dist", "a", "b")
        keys, dist = [F.col("rank.dist"), F.col("rank.a"), F.col("rank.b")], F.col("rank.dist")
    keys = [k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
    links = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), rank.alias("rank"))
    member: DataFrame | None = None
    past: list[DataFrame] = []  # merges that are not yet in member

    def after(changed: DataFrame, twos: bool = False, contract: bool = True) -> None:
        nonlocal links, member
        if changed.isEmpty():
            return
        past.append(changed)
        if len(past) == 8:
            member = _placed(member, past)
            past.clear()
        if contract:
            links = _contracted(links, changed, twos)

    def walk(last: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Merges by links up to a distance, or by all, in the components they make; components too large for that; all links within one."""
        followed = F.lit(True) if last is None else dist <= last
        first = links.where(followed)
        placed = _components(first, first.count(), most_edges)
        ends = F.broadcast(placed) if last is not None and placed.count() <= 500_000 else placed
        work = links.join(ends.select(F.col("node").alias("x"), "component"), "x")
        if last is not None:
            work = work.join(ends.select(F.col("node").alias("y"), F.col("component").alias("_other")), "y").where("component = _other")
            work = stored(work.select("component", "x", "y", "rank"), "within")
        over = work.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > most_edges)
        over = over.join(placed.groupBy("component").agg(F.count("*").alias("_nodes")), "component")
        large = stored(over.where((F.col("_n") > 4 * most_edges) | (F.col("_nodes") > _DENSE)).select("component"), "large_components")
        small = work if large.isEmpty() else work.join(large, "component", "left_anti")
        task = F.pmod(F.xxhash64("component"), F.lit(max(48, n // 50_000)))
        merges = small.select(task.alias("task"), "component", "x", "y", followed.alias("followed"), *keys).groupBy("task").applyInArrow(_link, "old long, new long")
        return stored(merges, "walked"), large, work

    if exact is not None and not exact.isEmpty():
        after(stored(components(exact).select(F.col("node").alias("old"), F.col("component").alias("new")).where("old <> new"), "merged"))
    n, before, done = links.count(), None, None
    while n:
        if n > most_edges:
            if done is not None and (before is None or 5 * n <= 4 * before):
                before = n
                after(stored(_merged(links), "merged"), twos=True)
                n = links.count()
                continue
            ways = _early(links, dist, nodes)
            if done is None or ways[-1] > done:
                done, large = ways[-1], None
                while ways and (large is None or not large.isEmpty()):
                    walked, large, _ = walk(ways[-1])
                    after(walked)
                    ways = ways[: len(ways) // 2]
                n, before = links.count(), None
                continue
        walked, large, work = walk(None)
        after(walked, contract=False)
        if large.isEmpty():
            break
        links = stored(work.join(large, "component").select("x", "y", "rank"), "large_links")
        n = most = links.count()
        while 2 * n > most:
            after(stored(_merged(links), "merged"), twos=True)
            n = links.count()
        before = None
    if past:
        member = _placed(member, past)
    if member is None:
        return edges.sparkSession.createDataFrame([], "id long, group_id long")
    names = member.groupBy("g").agg(F.min("id").alias("group_id"))
    return member.join(names, "g").select("id", "group_id")


def cluster(records: DataFrame, threshold: int, confirm: bool = False) -> DataFrame:
    """(id, group_id) of the groups of records (id, content_hash, h1, h2): those
    of one content always, others by complete linkage of near pairs.

    Records of the same hashes have the same pairs, so each combination takes
    part once, by its smallest id, and the rest follow it (apart from those whose
    equals in content have other hashes, which stay by themselves).  Equal
    contents tie combinations together.  A record without a first hash is near
    to none."""
    rows = records.where("id is not null").select("id", "content_hash", "h1", *(["h2"] if confirm else [F.lit(None).cast("long").alias("h2")]))
    hashes = F.struct("h1", "h2")
    uneven = rows.where("content_hash is not null").groupBy("content_hash").agg(F.min(hashes).alias("least"), F.max(hashes).alias("most")).where("not least <=> most").select("content_hash", F.lit(True).alias("uneven"))
    rows = rows.join(uneven, "content_hash", "left").withColumn("apart", F.when(F.col("h1").isNull(), F.concat(F.lit("i"), F.col("id"))).when(F.col("uneven"), F.concat(F.lit("c"), F.col("content_hash"))))
    key = F.xxhash64("h1", "h2", "apart")  # deals the rows; equality is decided on all three
    rows = rows.withColumn("key", key)
    alike = rows.groupBy("key", "h1", "h2", "apart").agg(F.min("id").alias("rep")).select("key", F.struct("h1", "h2", "apart").alias("same"), "rep")
    rows = stored(rows.withColumn("this", F.struct("h1", "h2", "apart")).join(alike, "key").where("this <=> same").select("id", "content_hash", "h1", "h2", "rep"), "records")
    firsts = rows.where("id = rep")
    pairs = near_pairs(firsts.select("id", "h1", "h2"), threshold, confirm)
    first = rows.where("content_hash is not null").groupBy("content_hash").agg(F.min("rep").alias("b"))
    exact = rows.join(first, "content_hash").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    linked = complete_linkage(stored(pairs, "pairs"), exact)
    grouped = rows.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("group_id", "rep").alias("g"))
    several = grouped.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("group_id")).where("n > 1")
    return grouped.join(several, "g").select("id", "group_id")


def pair_distances(members: DataFrame) -> DataFrame:
    """(group_id, a, b, dist, dist2, identical) of every pair within a group, from
    (group_id, id, h1, h2, content_hash); a missing hash leaves its distance null."""
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.id") < F.col("b.id")))
    second = hamming(F.col("a.h2"), F.col("b.h2")).cast("int") if "h2" in members.columns else F.lit(None).cast("int")
    return pairs.select(
        F.col("a.group_id").alias("group_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming(F.col("a.h1"), F.col("b.h1")).cast("int").alias("dist"), second.alias("dist2"), (F.col("a.content_hash") == F.col("b.content_hash")).alias("identical")
    )
