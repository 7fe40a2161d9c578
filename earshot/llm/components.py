"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node that is reachable.

    Alternates the large-star and small-star steps: each node links its larger neighbours to its
    smallest one, then all its smaller ones to the smallest. The number of rounds grows with the
    logarithm of the number of nodes. Each round is cut by a checkpoint. No links give no rows.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m"))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        large = both.select(F.col("hi").alias("u"), F.col("lo").alias("v")).where("v > u").join(low, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        ).distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        small_low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_low, "hi")
        edges = cut(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small_low.select("hi", F.col("m").alias("lo")))
            .where("hi > lo")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
