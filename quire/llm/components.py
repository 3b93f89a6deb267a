"""Connected components by randomised contraction, entirely in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge to another node.

    In each round every node hooks to its neighbour of least hashed priority if that is lower than its
    own; the edges are then rewritten between hook targets. Hashed priorities make the number of
    remaining nodes fall geometrically whatever the shape of the graph, so rounds are logarithmic.
    Minima are combined on the map side and both sides of each join are plain scans, which lets
    adaptive execution split a hub's rows. Null ends and self-links are ignored; no edges, no rows.
    """
    pair = edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    left = materialize(pair, "links")
    roots: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        hook = materialize(least.select("u", F.least("m", own)["v"].alias("p")), "hooks")
        to = lambda end: hook.select(F.col("u").alias(end), F.col("p").alias(f"p_{end}"))
        moved = left.join(to("u"), "u").join(to("v"), "v").where(F.col("p_u") != F.col("p_v"))
        left = materialize(moved.select(F.least("p_u", "p_v").alias("u"), F.greatest("p_u", "p_v").alias("v")).distinct(), "links")
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = materialize(
                roots.join(hook.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")),
                "roots",
            )
    if roots is None:
        roots = left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
