"""Per-read counters, classes, ranks and cuts. All windows are partitioned by read, whose maps are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The whole row breaks ties, so that results do not depend on partitioning.
_KEYS = ("event_distance", "-phred", "seq_name", "position", "strand", "length", "score")


def best_first(skip: int = 0) -> list:
    """Sort columns, the first ``skip`` of them left out."""
    return [F.desc(k[1:]) if k.startswith("-") else F.col(k) for k in _KEYS[skip:]]


def ranked(maps: DataFrame) -> DataFrame:
    """Adds rank (1: the best map of the read)."""
    return maps.withColumn("rank", F.row_number().over(W.partitionBy("tag").orderBy(*best_first())))


def top_k(maps: DataFrame, k: int) -> DataFrame:
    return ranked(maps).where(F.col("rank") <= k)


def counters(maps: DataFrame) -> DataFrame:
    """(tag, counters): counters[d] maps at distance d, dense up to the largest distance."""
    per = maps.groupBy("tag", "event_distance").agg(F.count("*").alias("n"))
    by = per.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("event_distance", "n"))).alias("m"), F.max("event_distance").alias("top"))
    return by.select("tag", F.transform(F.sequence(F.lit(0), "top"), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0))).alias("counters"))


def two_best(maps: DataFrame) -> DataFrame:
    """(tag, n_maps, min1, min2, max1, max2): the two least distances and two best scores, ties included."""
    w = W.partitionBy("tag")
    placed = maps.select(
        "tag", "event_distance", "phred",
        F.row_number().over(w.orderBy("event_distance")).alias("near"), F.row_number().over(w.orderBy(F.desc("phred"))).alias("good"),
    )
    at = lambda value, place, k: F.max(F.when(F.col(place) == k, F.col(value)))
    return placed.groupBy("tag").agg(
        F.count("*").alias("n_maps"), at("event_distance", "near", 1).alias("min1"), at("event_distance", "near", 2).alias("min2"),
        at("phred", "good", 1).alias("max1"), at("phred", "good", 2).alias("max2"),
    )


def classified(templates: DataFrame, maps: DataFrame) -> DataFrame:
    """(tag, n_maps, class, delta): unmapped, tie, mmap (the second best within a distance of one) or unique."""
    best = templates.join(two_best(maps), "tag", "left")
    delta = F.col("min2") - F.col("min1")
    kind = F.when(F.col("n_maps").isNull(), "unmapped").when(delta == 0, "tie").when(delta <= 1, "mmap").otherwise("unique")
    return best.select("tag", F.coalesce("n_maps", F.lit(0)).alias("n_maps"), kind.alias("class"), delta.alias("delta"))


def strata_after_best(maps: DataFrame, n: int) -> DataFrame:
    best = F.min("event_distance").over(W.partitionBy("tag"))
    return maps.withColumn("best", best).where(F.col("event_distance") - F.col("best") <= n).drop("best")


def cumulative_strata(maps: DataFrame, most: int) -> DataFrame:
    """(tag, event_distance, n, upto, kept): whole strata stay until ``most`` maps are reached; the first always stays."""
    per = maps.groupBy("tag", "event_distance").agg(F.count("*").alias("n"))
    w = W.partitionBy("tag").orderBy("event_distance")
    per = per.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return per.withColumn("kept", (F.col("upto") <= most) | (F.row_number().over(w) == 1))


def softmax_scores(maps: DataFrame, cap: int = 254) -> DataFrame:
    """Adds p and mapq: exp(-ln10/10 * (distance - best)) shared out over the distinct positions of the read."""
    w = W.partitionBy("tag")
    one = maps.groupBy("tag", "seq_name", "strand", "position").agg(F.min("event_distance").alias("event_distance"))
    weight = F.exp(-F.log(F.lit(10.0)) / 10 * (F.col("event_distance") - F.min("event_distance").over(w)))
    p = one.withColumn("weight", weight).withColumn("p", F.col("weight") / F.sum("weight").over(w)).drop("weight")
    phred = F.floor(-10 * F.log10(F.greatest(1 - F.col("p"), F.lit(1e-26))) + 0.5)
    return p.withColumn("mapq", F.least(F.lit(cap), phred.cast("int")))


def regions(positions: DataFrame, bandwidth: int) -> DataFrame:
    """(tag, seq_name, begin, end, n): positions grouped while they lie within ``bandwidth`` of the group's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over rows in order; the group that is open is all that is held."""
        key, group, schema = None, None, None
        for b in batches:
            out, schema = [], b.schema
            for tag, seq_name, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and (tag, seq_name) == key and x - group[0] <= bandwidth:
                    group[1], group[2] = x, group[2] + 1
                    continue
                if group:
                    out.append((*key, *group))
                key, group = (tag, seq_name), [x, x, 1]
            yield _rows(out, b.schema)
        if group:
            yield _rows([(*key, *group)], schema)

    rows = positions.select("tag", "seq_name", F.col("position").cast("bigint").alias("position"))
    ordered = rows.repartition("tag", "seq_name").sortWithinPartitions("tag", "seq_name", "position")
    return ordered.mapInArrow(run, f"tag {rows.schema['tag'].dataType.simpleString()}, seq_name string, begin bigint, end bigint, n bigint")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * 5
    types = [schema.field(0).type, schema.field(1).type, pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["tag", "seq_name", "begin", "end", "n"])


def subdominant_truth(maps: DataFrame, true: Column) -> DataFrame:
    """True maps of reads with several maps that are farther off than the read's nearest one, with that distance as best."""
    w = W.partitionBy("tag")
    rows = maps.withColumn("best", F.min("event_distance").over(w)).withColumn("readloom_n", F.count("*").over(w))
    return rows.where((F.col("readloom_n") > 1) & true & (F.col("event_distance") > F.col("best"))).drop("readloom_n")
