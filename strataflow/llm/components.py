"""Connected components of a graph that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node that has a link.

    Alternates large-star and small-star steps: every step hangs neighbours on the smallest one known.
    A node's neighbours are only ever reduced to their minimum, so no neighbour list is gathered.
    Links with a null end or from a node to itself are ignored.  Rounds end when a round changes nothing; their number
    rises with the logarithm of the longest path.
    """
    edges = kept(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = signature(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours move to the smallest neighbour.
        large = (
            both.join(least, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .filter("u != v")
            .distinct()
        )
        edges = kept(small)
        now = signature(edges)
        if now == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def signature(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())
