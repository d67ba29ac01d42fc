"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins on the edges left; every node ends linked to the smallest of its
component after a number of rounds that grows with the logarithm of the longest chain. Hubs are safe: minima combine on
the map side, and the joins back are ones that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another one, roots themselves left out; root is the least node."""
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        before = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, "least")  # a table, so that the join can split a hub's rows
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = large.join(least, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(pairs.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before, large, least)
