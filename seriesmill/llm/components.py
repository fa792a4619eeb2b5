"""Connected components over a table of links, by alternating large-star and small-star rounds.

Links live in tables of the shared folder, never on the driver; hot nodes are handled by aggregating first and joining
after (a join Spark can split), not by gathering a node's neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): every node of a link with the smallest node that it reaches.

    Nulls and self-links are left out; repeated and reversed links count once; no links give an empty table. Rounds grow
    with the logarithm of the longest path; it is an error if max_rounds don't do.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(max_rounds if state[0] else 0):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        last, edges = edges, materialise(small, "links")
        drop(last)
        was, state = state, _state(edges)
        if was == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
