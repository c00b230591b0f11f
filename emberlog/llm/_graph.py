"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, stored


def _toward_least(both: DataFrame) -> DataFrame:
    """(u, v, m): every directed edge with the least vertex of u's closed neighbourhood.

    The minimum is a partial aggregate: of a hub's edges one row for each task goes on. The result is dealt out
    anew before it meets the edges; so the join is of two exchanged sides, of which adaptive execution splits a
    hub's. Without that the minimum would be taken in the join's own stage, which can't be split.
    """
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).repartition(parts)
    return both.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (a, b); root is the component's least vertex.

    Each round is written to the shared folder, which cuts the lineage; rounds grow with the logarithm of
    the components' diameter. Loops and repeated edges are harmless; no edges give no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _toward_least(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = stored(linked.filter("u <> v").distinct(), "edges")
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(now)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
