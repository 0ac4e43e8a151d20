"""Connected components by alternating large-star and small-star rounds.

Each round is two joins of the edges with the least neighbour of each vertex, so a hub of any degree is a key of a
join and never a list in one task. Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.shared import drop_stored, stored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex in edges (u, v: long); component is the least vertex that it reaches.

    Loops, nulls and repeated edges count for nothing; no edges give no rows.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        was, edges = edges, stored(small_star(large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(edges.sparkSession, was)
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
        mark = now
