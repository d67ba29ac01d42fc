"""Chains and scaffolds of matching regions, segments of split maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_chain(regions: DataFrame, key: tuple[str, ...] = ("tag", "seq_name")) -> DataFrame:
    """(key, coverage, n): the chain of regions (begin, stop) in order and without overlap that covers most bases; of equals the one of fewest regions.

    A fold over the sorted regions of a read and sequence, which are few: to each the best chain that ends before it is added.
    """
    row = F.struct(F.col("begin").cast("long").alias("begin"), F.col("stop").cast("long").alias("stop"))
    start = F.expr("cast(array() as array<struct<coverage:bigint,fewer:int,stop:bigint>>)")

    def step(done: Column, x: Column) -> Column:
        before = F.array_max(F.transform(F.filter(done, lambda d: d["stop"] <= x["begin"]), lambda d: F.struct(d["coverage"].alias("c"), d["fewer"].alias("f"))))
        new = F.struct((F.coalesce(before["c"], F.lit(0)) + x["stop"] - x["begin"]).alias("coverage"), (F.coalesce(before["f"], F.lit(0)) - 1).alias("fewer"), x["stop"].alias("stop"))
        return F.concat(done, F.array(new))

    per = regions.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("r"))
    best = F.array_max(F.transform(F.aggregate("r", start, step), lambda d: F.struct(d["coverage"].alias("c"), d["fewer"].alias("f"))))
    return per.select(*key, best["c"].alias("coverage"), (-best["f"]).alias("n"))


def composed(hits: DataFrame, k: int) -> DataFrame:
    """(tag, seq_name, at, offset, len): exact hits (tag, seq_name, at, offset) of k-mers, those that follow one another on a diagonal made one region."""
    diagonal = hits.withColumn("diagonal", F.col("offset") - F.col("at"))
    w = W.partitionBy("tag", "seq_name", "diagonal").orderBy("at")
    fresh = F.coalesce((F.col("at") > F.lag("at").over(w) + k).cast("int"), F.lit(1))
    runs = diagonal.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("tag", "seq_name", "diagonal", "run").agg(F.min("at").alias("at"), F.min("offset").alias("offset"), (F.max("at") + k - F.min("at")).alias("len"))
    return out.select("tag", "seq_name", "at", "offset", "len")


def regrouped(segments: DataFrame) -> DataFrame:
    """(tag, text, n) of segments (tag, segment, text) numbered from 0; a number that is missing or repeated fails the job."""
    parts = segments.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("segment", "text"))).alias("s"))
    right = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(0), F.size("s") - 1)
    return parts.where(F.assert_true(right, "segments of a read are missing or repeated").isNull()).select("tag", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.size("s").alias("n"))


def split_segments(blocks: DataFrame) -> DataFrame:
    """(tag, segment, seq_name, strand, begin, stop, blocks): runs of blocks (tag, block, seq_name, strand, begin, stop) of a map that go on along a sequence."""
    w = W.partitionBy("tag").orderBy("block")
    on = (F.lag("seq_name").over(w) == F.col("seq_name")) & (F.lag("strand").over(w) == F.col("strand")) & (F.lag("stop").over(w) <= F.col("begin"))
    rows = blocks.withColumn("fresh", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("segment", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return rows.groupBy("tag", "segment", "seq_name", "strand").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.count("*").alias("blocks"))
