"""Filters of whole records by options, in the order in which they apply, and filters that need the reference or other maps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import pairs as P
from readloom.functions import scores as S
from readloom.functions import sequence as Q


@dataclass
class MapFilter:
    """What to keep of maps (tag, seq_name, strand, event_distance, phred, ...); an option that is not set keeps all."""

    names: tuple[str, ...] = ()
    strands: tuple[str, ...] = ()
    strata_after_best: int | None = None
    distances: tuple[int, int] | None = None
    qualities: tuple[tuple[int, int], ...] = ()
    first_only: bool = False
    keep_first: bool = False
    order: tuple[str, ...] = field(default=("event_distance", "seq_name", "position", "strand", "length", "score", "phred"))

    def apply(self, maps: DataFrame) -> DataFrame:
        """The cut by strata counts from the nearest map of the record as it came in; the first map is found before any other filter."""
        w = W.partitionBy("tag")
        rows = maps.withColumn("readloom_best", F.min("event_distance").over(w))
        rows = rows.withColumn("readloom_place", F.row_number().over(w.orderBy(*self.order)))
        good = F.lit(True)
        if self.strata_after_best is not None:
            good = good & (F.col("event_distance") - F.col("readloom_best") <= self.strata_after_best)
        if self.names:
            good = good & F.col("seq_name").isin(*self.names)
        if self.strands:
            good = good & F.col("strand").isin(*self.strands)
        if self.distances:
            good = good & F.col("event_distance").between(*self.distances)
        if self.qualities:
            near = [F.col("phred").between(*q) for q in self.qualities]
            some = near[0]
            for q in near[1:]:
                some = some | q
            good = good & some
        rows = rows.withColumn("readloom_good", good)
        keep = F.col("readloom_good")
        if self.keep_first:
            keep = keep | ((F.col("readloom_place") == 1) & ~F.max("readloom_good").over(w))
        rows = rows.withColumn("readloom_keep", keep).where("readloom_keep")
        if self.first_only:
            rows = rows.withColumn("readloom_n", F.row_number().over(w.orderBy("readloom_place"))).where("readloom_n = 1").drop("readloom_n")
        return rows.drop("readloom_best", "readloom_place", "readloom_good", "readloom_keep")


def pair_filter(pairs: DataFrame, distances: tuple[int, int], insert_sizes: tuple[int, int], orientations: tuple[str, ...]) -> DataFrame:
    """Pairs by the sum of both distances, the insert size (0 where it is not defined) and the strands in order of position."""
    c = F.col
    size = S.insert_size(c("strand1"), c("position1"), c("length1"), c("strand2"), c("position2"), c("length2"))
    return pairs.where(c("distance").between(*distances) & size.between(*insert_sizes) & P.orientation(c("strand1"), c("strand2"), c("position1"), c("position2")).isin(*orientations))


def introns(blocks: Column) -> Column:
    """Lengths of the gaps between the blocks (begin, len) of a map, in order."""
    n = F.size(blocks)
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.get(blocks, i + 1)["begin"] - F.get(blocks, i)["begin"] - F.get(blocks, i)["len"])


def split_filter(maps: DataFrame, blocks: str = "blocks", split: bool | None = None, min_intron: int = 0, min_block: int = 0) -> DataFrame:
    """Maps by their blocks: only split ones or none, with gaps of ``min_intron`` and blocks of ``min_block`` bases or more."""
    b = F.col(blocks)
    good = F.forall(b, lambda x: x["len"] >= min_block) & F.forall(introns(b), lambda x: x >= min_intron)
    if split is not None:
        good = good & ((F.size(b) > 1) == split)
    return maps.where(good)


def checked(reads: DataFrame, claimed: str = "claimed", read: str = "read", text: str = "window") -> DataFrame:
    """Records all of whose maps have as many mismatches as they claim; one that does not takes its record with it."""
    right = F.bool_and(Q.hamming(F.col(read), F.col(text)).eqNullSafe(F.col(claimed))).over(W.partitionBy("tag"))
    return reads.withColumn("readloom_right", right).where("readloom_right").drop("readloom_right")


def can_enter(candidates: DataFrame, k: int, bound: str = "bound", distance: str = "distance") -> DataFrame:
    """Candidates whose least possible distance does not exceed the k-th best distance known of their read; all, if fewer are known."""
    w = W.partitionBy("tag")
    known = candidates.withColumn("readloom_place", F.when(F.col(distance).isNotNull(), F.row_number().over(w.orderBy(F.col(distance).asc_nulls_last()))))
    limit = F.max(F.when(F.col("readloom_place") == k, F.col(distance))).over(w)
    return known.withColumn("readloom_limit", limit).where(F.col("readloom_limit").isNull() | (F.col(bound) <= F.col("readloom_limit"))).drop("readloom_place", "readloom_limit")


def shared_kmers(a: Column, b: Column, k: int) -> Column:
    """How many k-mers two texts share, each as often as both have it."""
    left, right = (F.transform(Q.kmers(t, k), lambda x: x["kmer"]) for t in (a, b))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(left), F.lit(0), lambda s, x: s + F.least(count(left, x), count(right, x)))


def least_errors(a: Column, b: Column, k: int) -> Column:
    """A bound on the edits between a text and any text around it: an edit spoils k of its k-mers at most."""
    return F.greatest(F.lit(0), F.ceil((F.length(a) - k + 1 - shared_kmers(a, b, k)) / k)).cast("int")


def routed(rows: DataFrame, keep: Column) -> DataFrame:
    """Adds sink: kept or rejected, so that one pass feeds both."""
    return rows.withColumn("sink", F.when(keep, "kept").otherwise("rejected"))
