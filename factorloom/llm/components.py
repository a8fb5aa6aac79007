"""Connected components by alternating star contractions; nothing is gathered on the driver but a count and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_from, join_spread, written


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Large star: link larger neighbours to the least neighbour. Small star: link smaller ones and the node itself."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # each node with its smaller neighbours
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = join_spread(both, least, "u", "n", most)
    out = joined.filter(F.col("v") > F.col("u")) if large else joined
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's least node.

    Any orderable node type. Self-links are ignored, nulls aren't allowed, no edges give no rows. Each round is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain; groups may have any size, since
    a node's neighbours are only ever reduced to their least one, and go back to it by broadcast where there are very many.
    """
    edges = written(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    state, most = None, hot_from(edges.count())
    while True:
        edges = written(_star(written(_star(edges, True, most), "edges"), False, most), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now
