"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations with map-side combine and two joins on node
ids; nothing but one row of convergence counts reaches the driver.  The centre
of a large star holds a great share of the edges, so the few nodes with very
many edges get their minimum by a broadcast of at most ``2 * HEAVY`` rows, and
only the others are dealt by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

HEAVY, LEAST_HEAVY = 50_000, 128


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(edges: DataFrame, many: int) -> DataFrame:
    """``u, v, m``: each edge with the smallest ``v`` of its ``u``; nodes with over ``many`` edges are few."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    heavy = F.broadcast(low.where(F.col("n") > many).select("u", "m"))  # below edges / many rows
    light = low.where(F.col("n") <= many).select("u", "m")
    return edges.join(heavy, "u").unionByName(edges.join(heavy, "u", "left_anti").join(light, "u")).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another node.

    ``component`` is the smallest node id reachable.  Self links, nulls and
    repeated links are ignored; an empty table gives an empty table.
    """
    edges = (
        links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    )
    edges = cut(edges, "links")
    seen = None
    now = _digest(edges)
    while now[0] and now != seen:
        many = max(LEAST_HEAVY, now[0] // HEAVY)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest neighbour of a node that is its own minimum still needs its edge
        large = _with_least(both, many).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()
        small = _with_least(cut(large, "large"), many).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges, seen = cut(small, "stars"), now
        now = _digest(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
