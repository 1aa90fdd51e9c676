"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is
    the least node that can be reached.

    Alternates the large-star and small-star contractions of Kiveris et al.
    (2014), each a map-side combined minimum and an equi-join, until no edge
    changes.  Each round is written to the shared folder; only the number of
    changed edges reaches the driver.  Nodes without an edge to another node
    are in no row; self loops and repeated edges do no harm.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(lowest.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        small = stored(small, "small")
        # Stars whose edges a round leaves as they were are final.
        changed = small.join(current, ["a", "b"], "left_anti").limit(1).count() + current.join(small, ["a", "b"], "left_anti").limit(1).count()
        current = small
        if not changed:
            break
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stored(leaves.unionAll(roots), "components")
