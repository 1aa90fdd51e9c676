import itertools
import random

import pytest

from gleaner.functions.hashing import from_hex16, hamming, hex16
from gleaner.operators import neardup


def near(a, b, t):
    return bin((a ^ b) & (1 << 64) - 1).count("1") <= t


def plain_linkage(hashes, t):
    """Greedy complete linkage over a list of hashes, by definition."""
    edges = sorted((bin((x ^ y) & (1 << 64) - 1).count("1"), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(hashes), 2))
    groups = [{i} for i in range(len(hashes))]
    for d, i, j in edges:
        if d > t:
            break
        a, b = (next(g for g in groups if k in g) for k in (i, j))
        if a is not b and all(near(hashes[x], hashes[y], t) for x in a for y in b):
            groups.remove(b)
            a |= b
    return sorted(sorted(g) for g in groups if len(g) > 1)


def run(spark, hashes, t, exact=None):
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    rows = spark.createDataFrame([(i, h, None) for i, h in enumerate(signed)], "id long, h1 long, h2 long")
    pairs = neardup.near_pairs(rows, t)
    ties = spark.createDataFrame(exact, "a long, b long") if exact else None
    by = {}
    for r in neardup.complete_linkage(pairs, ties).collect():
        by.setdefault(r.group_id, []).append(r.id)
    assert all(min(v) == k for k, v in by.items())
    return sorted(sorted(v) for v in by.values())


@pytest.mark.parametrize(
    "hashes,t,want",
    [
        ([0, 0b11111, 0b1111111111], 7, [[0, 1]]),
        ([0, 0b111, 0b11000], 7, [[0, 1, 2]]),
        ([0x44028D1673E906F1, 0x44008D1613C902FD, 0x40004D1613C902FD, 0x04000D1613E9027D], 7, [[1, 2, 3]]),
        ([0, 0, 2**64 - 1], 3, [[0, 1]]),
    ],
)
def test_clusters(spark, hashes, t, want):
    assert run(spark, hashes, t) == want


def test_random_clusters(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for b in base for _ in range(6)]
    for t in (3, 7, 12):
        assert run(spark, hashes, t) == plain_linkage(hashes, t)


def test_exact_ties_join_whatever_the_hash(spark):
    # 0 and 2 are equal in content; 2 is near to 1 but 0 is not, so 1 stays alone.
    assert run(spark, [0, 0xFF00, 0xFF01], 7, [(0, 2)]) == [[0, 2]]
    assert run(spark, [0, 1, 3], 7, [(0, 2)]) == [[0, 1, 2]]


def plain_pairs(rows, t, confirm):
    """All pairs of (id, h1, h2), each compared."""
    known = sorted(r for r in rows if r[0] is not None and r[1] is not None)
    far = lambda x, y: x is not None and y is not None and not near(x, y, t + 4)
    return {(a[0], b[0]) for a, b in itertools.combinations(known, 2) if near(a[1], b[1], t) and not (confirm and far(a[2], b[2]))}


def test_pairs_null_rules(spark):
    rows = [(1, 0, 0), (2, 1, (1 << 12) - 1), (3, 3, None), (4, None, 0), (5, 0, 0)]
    table = spark.createDataFrame(rows, "id long, h1 long, h2 long")
    for confirm, want in ((False, {(1, 2), (1, 3), (2, 3), (1, 5), (2, 5), (3, 5)}), (True, {(1, 3), (2, 3), (1, 5), (3, 5)})):
        assert {(r.a, r.b) for r in neardup.near_pairs(table, 7, confirm).collect()} == want == plain_pairs(rows, 7, confirm)
    assert neardup.near_pairs(table.limit(0), 7).collect() == []


def some_hashes(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 14))) & (1 << 64) - 1 for b in base for _ in range(4)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


@pytest.mark.parametrize("t", [0, 7, 12])
def test_every_number_of_bands_finds_all_pairs_once(spark, t):
    hashes = sorted(set(some_hashes(80, t)))
    values = spark.createDataFrame([(h,) for h in hashes], "h1 long").cache()
    want = sorted((a, b) for a, b in itertools.combinations(hashes, 2) if near(a, b, t))
    for count in sorted({1, 3, 4, t + 1}):
        bands = neardup.Bands.of(t, count) if 1 <= count <= t + 1 else None
        if bands and max(bands.probes) <= 4_096:
            assert sum(r + 1 for r in bands.radii) == t + 1
            assert sorted(tuple(r) for r in neardup.candidates(values, t, bands).collect()) == want


@pytest.mark.parametrize("t,power", [(3, 1.35), (7, 1.45), (12, 1.95)])
def test_the_cost_of_pairs_grows_more_slowly_than_their_number(t, power):
    costs = [neardup.Bands.best(t, n).cost(n) for n in (10**4, 10**6, 10**8)]
    assert costs[0] < 10**8 / 2 and costs[1] < 10**12 / 60 and costs[1] / costs[0] < 100**power


@pytest.mark.parametrize("t,confirm", [(3, False), (12, False), (12, True), (17, False)])
def test_a_dear_join_compares_arrays_to_the_same_pairs(spark, monkeypatch, t, confirm):
    """At 12 and 17 bits a join of bands over the hashes of 1 GB is dear."""
    assert all(neardup.Bands.best(b, 400_000).cost(400_000) > neardup.DEAR_JOIN for b in (12, 17))
    monkeypatch.setattr(neardup, "DEAR_JOIN", 0)
    monkeypatch.setattr(neardup, "candidates", None)
    rng = random.Random(t)
    hashes = some_hashes(160, t)
    shared = [*hashes, *hashes[:9], None] if confirm else [*hashes, None]
    rows = [(3 * i - 40, h, rng.choice([0, 7, -1, None])) for i, h in enumerate(shared)] + [(None, 5, 5)]
    got = neardup.near_pairs(spark.createDataFrame(rows, "id long, h1 long, h2 long"), t, confirm).collect()
    known = dict((r[0], r[1]) for r in rows)
    assert all(r.dist == bin((known[r.a] ^ known[r.b]) & (1 << 64) - 1).count("1") for r in got)
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == plain_pairs(rows, t, confirm)


@pytest.mark.parametrize("t", [0, 3, 7, 12, 17, 30])
def test_blocks_are_compared_by_any_bands(t):
    import numpy as np

    hashes = np.array(some_hashes(240, t + 50), np.int64).view(np.uint64)
    x, y, ids = hashes[:100], hashes[100:], np.arange(240)
    want = sorted((i, 100 + j) for i, a in enumerate(x.tolist()) for j, b in enumerate(y.tolist()) if near(a, b, t))
    some = [neardup.Bands((0, 0), (0,)), neardup._block_bands(t, 100, 140), neardup._block_bands(t, 130_000, 130_000)]
    for bands in [*some, *(neardup.Bands.of(t, m) for m in range(5, t + 2))]:
        found = [(int(a), int(b)) for part in neardup.block_pairs(x, ids[:100], y, ids[100:], t, bands) for a, b in zip(part[0], part[1], strict=True)]
        assert sorted(found) == want


def test_a_dense_component_is_not_linked_by_rounds(spark, monkeypatch):
    """A component of 219,000 edges, as 0.5 GB has, is walked through; all of its links are one group but for one pair."""
    rounds, merged = [], neardup._merged if hasattr(neardup, "_merged") else None
    monkeypatch.setattr(neardup, "_merged", lambda links: rounds.append(1) or merged(links), raising=False)
    by_joins = getattr(neardup, "_link_by_rounds", None)
    monkeypatch.setattr(neardup, "_link_by_rounds", lambda *a: rounds.append(1) or by_joins(*a), raising=False)
    n = 663
    edges = spark.range(n).alias("a").crossJoin(spark.range(n).alias("b")).where("a.id < b.id and not (a.id = 0 and b.id = 5)").selectExpr("a.id as a", "b.id as b", "1 as dist")
    got = {r.id: r.group_id for r in neardup.complete_linkage(edges).collect()}
    assert not rounds and got == {i: 0 for i in range(n) if i != 5}


def test_walks_with_sets_and_with_bits_agree():
    import numpy as np

    rng = np.random.default_rng(4)
    for share in (0.05, 0.6, 0.97):
        x, y = np.nonzero(np.triu(rng.random((90, 90)) < share, 1))
        order = rng.permutation(len(x))
        x, y = x[order] * 5 - 7, y[order] * 5 - 7
        groups = []
        for walk in (neardup._walk, neardup._walk_dense):
            nodes, group = walk(x, y)
            groups.append(sorted(sorted(nodes[group == g].tolist()) for g in set(group.tolist())))
        # By definition.
        edges, own = set(zip(x.tolist(), y.tolist(), strict=True)), {int(k): [int(k)] for k in {*x.tolist(), *y.tolist()}}
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            p, q = own[a], own[b]
            if p is not q and all((i, j) in edges or (j, i) in edges for i in p for j in q):
                own.update(dict.fromkeys(p + q, p + q))
        assert groups[0] == groups[1] == sorted({tuple(sorted(g)): sorted(g) for g in own.values()}.values())


def test_ids_too_far_apart_for_ranks_of_one_number(spark):
    close = [(i << 40, j << 40, (i * 7 + j) % 5) for i, j in itertools.combinations(range(-4, 14), 2) if (i + j) % 4]
    near_by = [(a >> 40, b >> 40, d) for a, b, d in close]
    link = lambda edges, m: sorted(tuple(r) for r in neardup.complete_linkage(spark.createDataFrame(edges, "a long, b long, dist int"), most_edges=m).collect())
    assert link(close, 10**9) == link(close, 0) == [(i << 40, g << 40) for i, g in link(near_by, 0)]


def test_rounds_link_as_the_walk_does(spark):
    hashes = some_hashes(160, 5)
    pairs = [(i, j, bin((a ^ b) & (1 << 64) - 1).count("1")) for (i, a), (j, b) in itertools.combinations(enumerate(hashes), 2) if near(a, b, 12)]
    ties = [(0, 5), (5, 9), (20, 21)]
    edges, exact = spark.createDataFrame(pairs, "a long, b long, dist int"), spark.createDataFrame(ties, "a long, b long")
    for tied in (None, exact):
        one, many = (sorted(tuple(r) for r in neardup.complete_linkage(edges, tied, most_edges=m).collect()) for m in (10**9, 0))
        assert one == many and len(one) > 20
    close = [(i, j, (i * 7 + j) % 5) for i, j in itertools.combinations(range(18), 2) if (i + j) % 4]
    edges = spark.createDataFrame(close, "a long, b long, dist int")
    one, many = (sorted(tuple(r) for r in neardup.complete_linkage(edges, most_edges=m).collect()) for m in (10**9, 0))
    assert one == many


def test_large_groups_in_one_web_are_walked_and_not_merged_by_rounds(spark, monkeypatch):
    """Three dense groups in one component of too many links: rounds would add one member at a time."""
    rounds, merged = [], neardup._merged
    monkeypatch.setattr(neardup, "_merged", lambda links: rounds.append(1) or merged(links))
    rng = random.Random(8)
    dense = [(40 * g + i, 40 * g + j, 1 + (i > 20)) for g in range(3) for i, j in itertools.combinations(range(40), 2) if (i, j) != (2, 7)]
    web = sorted({(a, b, 5) for a in range(80) for b in rng.sample(range(40 * (a // 40 + 1), 200), 6)})
    edges = spark.createDataFrame(dense + web, "a long, b long, dist int")
    got = sorted(tuple(r) for r in neardup.complete_linkage(edges, most_edges=400).collect())
    assert len(rounds) <= 8
    assert got == sorted(tuple(r) for r in neardup.complete_linkage(edges, most_edges=10**9).collect()) and len(got) > 120


def test_links_up_to_a_distance_first_give_what_one_walk_gives(spark):
    rng = random.Random(3)
    pairs = [(i * 3, j * 3, rng.choice([1, 2, 3, 3, 4, 4, 4])) for i, j in itertools.combinations(range(60), 2) if i // 6 == j // 6 or rng.random() < 0.2]
    order = sorted((d, a, b) for a, b, d in pairs)
    near_by, own = {(a, b) for a, b, _ in pairs}, {i * 3: [i * 3] for i in range(60)}
    for _, a, b in order:  # by definition
        p, q = own[a], own[b]
        if p is not q and all((min(i, j), max(i, j)) in near_by for i in p for j in q):
            own.update(dict.fromkeys(p + q, p + q))
    want = sorted((i, min(g)) for i, g in own.items() if len(g) > 1)
    edges = spark.createDataFrame(pairs, "a long, b long, dist int")
    for most in (0, 20, 60, 10**9):
        assert sorted(tuple(r) for r in neardup.complete_linkage(edges, most_edges=most).collect()) == want


def test_cluster_of_records(spark):
    rows = [(0, "x", 5, 0), (1, "y", 5, 0), (2, "y", None, None), (3, "z", 4, 0), (4, None, None, None), (5, "z", 4, 0), (6, "w", -1, 0), (7, "w", -1, 0), (8, "v", None, None), (9, "v", None, None), (None, "x", 5, 0)]
    table = spark.createDataFrame(rows, "id long, content_hash string, h1 long, h2 long")
    by = {}
    for r in neardup.cluster(table, 3, True).collect():
        by.setdefault(r.group_id, set()).add(r.id)
    # 1 and 2 are equal in content, and 2 has no hash, so nothing else joins them.
    assert by == {0: {0, 3, 5}, 1: {1, 2}, 6: {6, 7}, 8: {8, 9}}
    assert neardup.cluster(table.limit(0), 3).count() == 0


def test_hex(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(hex16(F.lit(-1)).alias("a"), from_hex16(F.lit("00000000000000ff")).alias("b"), hamming(F.lit(0), F.lit(-1)).alias("c"), from_hex16(F.lit("ffffffffffffffff")).alias("d")).first()
    assert tuple(r) == ("f" * 16, 255, 64, -1)
