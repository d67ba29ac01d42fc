"""Sets of intervals by key: union and difference by one sweep over their ends, and overlaps of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ends(df: DataFrame, key: str, side: int) -> DataFrame:
    return df.where("begin < stop").select(key, F.inline(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("step")))), F.lit(side).alias("side"))


def combined(a: DataFrame, b: DataFrame, how: str, key: str = "seq_name") -> DataFrame:
    """(key, begin, stop): the places in ``a`` or ``b`` (union), in both (intersect), or in ``a`` only (subtract), in half-open intervals that do not touch.

    The ends are added up by place first, so an interval that many rows share is one row in the sweep.
    """
    ends = _ends(a, key, 0).unionByName(_ends(b, key, 1))
    steps = ends.groupBy(key, "at").agg(F.sum(F.when(F.col("side") == 0, F.col("step"))).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("step"))).alias("b"))
    w = W.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    depth = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(upto), F.lit(0)) > 0
    in_a, in_b = F.col("in_a"), F.col("in_b")
    inside = {"union": in_a | in_b, "intersect": in_a & in_b, "subtract": in_a & ~in_b}[how]
    pieces = steps.select(key, "at", depth("a").alias("in_a"), depth("b").alias("in_b")).withColumn("inside", inside)
    turns = pieces.withColumn("before", F.coalesce(F.lag("inside").over(w), F.lit(False))).where("inside <> before")
    return turns.select(key, F.col("at").alias("begin"), F.lead("at").over(w).alias("stop"), "inside").where("inside").drop("inside")


def overlap(begin1: Column, stop1: Column, begin2: Column, stop2: Column) -> Column:
    """Bases that two half-open blocks share."""
    return F.greatest(F.least(stop1, stop2) - F.greatest(begin1, begin2), F.lit(0))
