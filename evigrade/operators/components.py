"""Connected components by alternating large-star and small-star joins.

Every round is two grouped minima and two joins over the edge table and is staged to the shared folder, so no component
is ever gathered in one task: a component with a third of all nodes ends as that many (node, root) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrade.sources.staging import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge, root the smallest node that it reaches.

    Null ends and self-loops carry no link and are dropped; repeated edges count once; without edges there are no rows.
    Rounds grow with the logarithm of the longest path; not converging in ``max_rounds`` is an error, never a cut-off.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut(e, "cc")
    for _ in range(max_rounds):
        if _is_settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged, so that both sides of the join are plain exchanges and a hub's partition can be split.
        lowest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-lowest")
        large = cut(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_settled(e: DataFrame) -> bool:
    """Whether all edges lead straight to roots: no node has two, and none that is led to has one of its own."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return each.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty()
