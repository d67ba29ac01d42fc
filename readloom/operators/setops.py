"""Set operations on the maps of two files, read by read, under an injected comparator.

Strict comparison is an equi-join on the whole key; tolerant comparison joins on read, sequence and strand and leaves
the position to a residual condition, so both stay hash or merge joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.operators.ranking import best_first

STRICT = ("tag", "seq_name", "strand", "position", "length")
Comparator = Callable[[str, str], Column]


def strict(a: str, b: str) -> Column:
    return _all([F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in STRICT])


def tolerant(tolerance: int) -> Comparator:
    """Same sequence and strand, begin or end within ``tolerance``."""

    def same(a: str, b: str) -> Column:
        begin = F.abs(F.col(f"{a}.position") - F.col(f"{b}.position")) <= tolerance
        end = F.abs(F.col(f"{a}.position") + F.col(f"{a}.length") - F.col(f"{b}.position") - F.col(f"{b}.length")) <= tolerance
        return _all([F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("tag", "seq_name", "strand")]) & (begin | end)

    return same


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def intersection(a: DataFrame, b: DataFrame, same: Comparator = strict) -> DataFrame:
    return a.alias("a").join(b.alias("b"), same("a", "b"), "left_semi")


def difference(a: DataFrame, b: DataFrame, same: Comparator = strict) -> DataFrame:
    return a.alias("a").join(b.alias("b"), same("a", "b"), "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Maps of both, one per strict key: the one of the least distance, of ``a`` if they tie."""
    both = a.withColumn("file", F.lit(0)).unionByName(b.withColumn("file", F.lit(1)))
    w = W.partitionBy(*STRICT).orderBy("event_distance", "file", *best_first(1))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "file")


def union_tolerant(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """All maps of ``a`` and those of ``b`` that no map of ``a`` equals under the tolerance."""
    return a.unionByName(difference(b, a, tolerant(tolerance)))


def compare(a: DataFrame, b: DataFrame, same: Comparator = strict) -> DataFrame:
    """(tag, only_a, only_b, both): numbers of maps of each kind."""
    parts = [difference(a, b, same), difference(b, a, same), intersection(a, b, same)]
    rows = [p.select("tag", F.lit(k).alias("kind")) for k, p in enumerate(parts)]
    kinds = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return kinds.groupBy("tag").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(("only_a", "only_b", "both"))])


def one_per_end(maps: DataFrame) -> DataFrame:
    """Maps of a read that share begin or end count once: the better one stays, by begin first, then by end."""
    end = maps.withColumn("stop", F.col("position") + F.col("length"))
    for key in ("position", "stop"):
        w = W.partitionBy("tag", "seq_name", "strand", key).orderBy(*best_first())
        end = end.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return end.drop("stop")


def merged(files: list[tuple[DataFrame, int]]) -> DataFrame:
    """Maps of any number of files (maps, complete strata), one per strict key: least distance, number of files, least strata of these files."""
    rows = None
    for i, (maps, mcs) in enumerate(files):
        own = maps.select(*STRICT, "event_distance", F.lit(i).alias("file"), F.lit(mcs).alias("mcs"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*STRICT).agg(F.min("event_distance").alias("event_distance"), F.count_distinct("file").alias("files"), F.min("mcs").alias("mcs"))


def in_any_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ``a`` (tag, seq_name, strand1, position1, length1, strand2, ...) with met: ``b`` has them with their ends in either order.

    Both sides are put in one order of ends, so the comparison stays an equi-join.
    """
    ends = [F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("strand", "position", "length")]) for i in (1, 2)]
    ordered = lambda p: p.withColumn("readloom_low", F.least(*ends)).withColumn("readloom_high", F.greatest(*ends))
    key = ["tag", "seq_name", "readloom_low", "readloom_high"]
    there = ordered(b).select(*key).distinct().withColumn("met", F.lit(True))
    return ordered(a).join(there, key, "left").withColumn("met", F.coalesce("met", F.lit(False))).drop("readloom_low", "readloom_high")


OPERATIONS = {"union": union, "intersection": intersection, "difference": difference, "compare": compare}


def operation(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The operation of a name or of the beginning of one, in any case."""
    found = [f for n, f in OPERATIONS.items() if n.startswith(name.lower())]
    if len(found) != 1 or not name:
        raise ValueError(f"{name!r} is no operation, or several: {', '.join(OPERATIONS)}")
    return found[0]
