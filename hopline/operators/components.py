"""Connected components of an edge list by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return (node, component) for each node that has an edge; component is the smallest node id reachable.

    Nulls and self loops are ignored (a node with self loops only is not returned). Each round is two aggregations and
    joins over at most as many edges as the first; it is written to the shared folder, so a lost executor costs one
    round; it ends when a round changes nothing. The driver sees two numbers a round. Around a hub the join is skewed, which AQE splits.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc"
    )
    before = None
    while True:
        after = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if after == before:
            break
        before = after
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u are hung on the least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its neighbours below are hung on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        nxt = materialize(small, "cc")
        discard(now)
        now = nxt
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
