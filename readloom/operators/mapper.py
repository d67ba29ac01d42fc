"""From reads and a reference to ranked alignments: the search modes, end by end and in pairs.

A mode is a choice of seeds and of what happens to reads that are not searched deeply enough; all of them end in the same verification, alignment and ranking.
Every step is a join or a window over the whole table of reads, so a read that maps to many places costs rows, not memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.functions.alignment import affine, edit_alignment, semi_global_distance
from readloom.operators import seeds

MODES = ("exact", "fast", "sensitive", "complete")


@dataclass(frozen=True)
class Search:
    """Parameters as fractions of the read length, or as numbers from one on."""

    mode: str = "fast"
    max_error: float = 0.12
    complete_error: float = 0.04
    seed_length: int = 12
    reported: int = 5
    local_score: int = 20

    def errors(self, length: int) -> int:
        return 0 if self.mode == "exact" else self._whole(self.max_error, length)

    def complete(self, length: int) -> int:
        return 0 if self.mode == "exact" else self._whole(self.complete_error, length)

    @staticmethod
    def _whole(x: float, length: int) -> int:
        return int(x * length) if x < 1 else int(x)


def both_strands(reads: DataFrame) -> DataFrame:
    """(tag, strand, read)."""
    two = F.array(F.struct(F.lit("+").alias("strand"), F.col("read").alias("read")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col("read")).alias("read")))
    return reads.select("tag", F.inline(two))


def verified(candidates: DataFrame, ref: DataFrame, errors: int, length: int) -> DataFrame:
    """(tag, strand, seq_name, position, distance, cigar) of candidate places (tag, strand, read, seq_name, offset); each window is aligned once."""
    bins = candidates.select("tag", "strand", "read", "seq_name", F.greatest(F.col("offset"), F.lit(0)).alias("offset")).distinct()
    begin = F.greatest(F.col("offset") - errors, F.lit(0))
    found = bins.join(ref, "seq_name").select("tag", "strand", "seq_name", begin.alias("shift"), edit_alignment(F.col("read"), F.substring("text", begin + 1, F.lit(length + 2 * errors))).alias("a"))
    good = found.where(-F.col("a.score") <= errors)
    rows = good.select("tag", "strand", "seq_name", (F.col("shift") + F.col("a.begin") + 1).alias("position"), (-F.col("a.score")).alias("distance"), F.col("a.cigar").alias("cigar"))
    w = W.partitionBy("tag", "strand", "seq_name", "position").orderBy("distance", "cigar")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def direct_candidates(stranded: DataFrame, ref: DataFrame, cuts: Column, sizes: list[int]) -> DataFrame:
    """Places (tag, strand, read, seq_name, offset) that a cut (at, kmer) of a read points to, by a join with the k-mers of each size."""
    cut = stranded.select("tag", "strand", "read", F.inline(cuts).alias("at", "kmer"))
    out = None
    for k in sizes:
        hits = cut.where(F.length("kmer") == k).join(seeds.kmer_index(ref, k), "kmer")
        out = hits if out is None else out.unionByName(hits)
    return out.select("tag", "strand", "read", "seq_name", (F.col("offset") - F.col("at")).alias("offset"))


def verifiable_candidates(stranded: DataFrame, ref: DataFrame, cuts: Column, sizes: list[int], errors: int, length: int) -> DataFrame:
    """The same, but for places in plain texts about which the read does not lie with up to ``errors`` edits, as verified() would drop what they give.

    Cuts much shorter than the pieces of seeds.near_places point to many such places: their number follows reads times text. Here the places of
    matches come first; a cut that points to a window with such a match does so within the distances tried.
    """
    if min(sizes) >= min(length // (errors // 2 + 1), seeds.KEY) - 1:
        return direct_candidates(stranded, ref, cuts, sizes)
    near = seeds.near_places(stranded, ref, errors, length, indels=True).join(ref, "seq_name")
    begin = F.greatest(F.col("offset") - 2 * errors, F.lit(0))
    fits = semi_global_distance(F.col("read"), F.substring("text", begin + 1, F.lit(length + 5 * errors)), errors)
    near = near.withColumn("hit", fits).where("hit.distance is not null")
    least = F.when(F.col("offset") <= 4 * errors, F.lit(-length)).otherwise(F.col("offset") - 4 * errors)
    tried = near.withColumn("offset", F.explode(F.sequence(least, F.col("offset") + 2 * errors)))
    there = lambda c: (F.col("offset") + c["at"] >= 0) & (F.substring("text", F.col("offset") + c["at"] + 1, F.length(c["kmer"])) == c["kmer"])
    cut = F.transform(cuts, lambda c: F.struct(c["offset"].alias("at"), c["kmer"].alias("kmer")))
    exact = tried.where(F.exists(F.filter(cut, lambda c: ~c["kmer"].contains("N")), there)).select("tag", "strand", "read", "seq_name", "offset").distinct()
    return exact.unionByName(direct_candidates(stranded, ref.where(~seeds.is_plain()), cuts, sizes))


def seed_candidates(stranded: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """Places that a seed of k without overlap points to."""
    return direct_candidates(stranded, ref, S.kmers(F.col("read"), k, k), [k])


def neighborhood_candidates(stranded: DataFrame, ref: DataFrame, errors: int, length: int) -> DataFrame:
    """Places that one of errors + 1 pieces points to and that verified() does not drop: none with up to ``errors`` edits is missing."""
    sizes = sorted({((i + 1) * length) // (errors + 1) - (i * length) // (errors + 1) for i in range(errors + 1)})
    return verifiable_candidates(stranded, ref, S.pieces(F.col("read"), errors + 1), sizes, errors, length)


def map_reads(reads: DataFrame, ref: DataFrame, length: int, search: Search = Search()) -> DataFrame:  # noqa: B008
    """(tag, strand, seq_name, position, distance, cigar, mcs, rank) of reads (tag, read) of ``length`` bases.

    ``mcs`` is the number of complete strata: no match with fewer errors is missing. Fast search seeds by pieces of a fixed length; sensitive
    search goes on with the neighborhood of the reads that it leaves without a match within their complete strata; complete searches the neighborhood of all.
    """
    if search.mode not in MODES:
        raise ValueError(f"no mode {search.mode!r}")
    errors, stranded = search.errors(length), both_strands(reads)
    k = min(search.seed_length, length)
    if search.mode == "complete" or search.mode == "exact":
        found = verified(neighborhood_candidates(stranded, ref, errors, length), ref, errors, length).withColumn("mcs", F.lit(errors + 1))
    else:
        found = verified(verifiable_candidates(stranded, ref, S.kmers(F.col("read"), k, k), [k], errors, length), ref, errors, length).withColumn("mcs", F.lit(length // k))
        if search.mode == "sensitive":
            deep = found.where(F.col("distance") < F.col("mcs")).select("tag").distinct()
            rest = stranded.join(deep, "tag", "left_anti")
            more = verified(neighborhood_candidates(rest, ref, errors, length), ref, errors, length).withColumn("mcs", F.lit(errors + 1))
            found = found.join(deep, "tag", "left_semi").unionByName(more)
    w = W.partitionBy("tag").orderBy("distance", "seq_name", "position", "strand")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= search.reported)


def map_unmapped_locally(reads: DataFrame, mapped: DataFrame, ref: DataFrame, search: Search = Search()) -> DataFrame:  # noqa: B008
    """(tag, strand, seq_name, position, score, cigar): the best local alignment of reads without a match, where a seed points, if its score suffices."""
    rest = both_strands(reads.join(mapped.select("tag").distinct(), "tag", "left_anti"))
    near = seed_candidates(rest, ref, search.seed_length).select("tag", "strand", "read", "seq_name").distinct().join(ref, "seq_name")
    found = near.select("tag", "strand", "seq_name", affine(F.col("read"), F.col("text"), "local").alias("a")).where(F.col("a.score") >= search.local_score)
    w = W.partitionBy("tag").orderBy(F.desc("a.score"), "seq_name", "strand")
    best = found.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("tag", "strand", "seq_name", (F.col("a.begin") + 1).alias("position"), F.col("a.score").alias("score"), F.col("a.cigar").alias("cigar"))


def map_pairs(end1: DataFrame, end2: DataFrame, ref: DataFrame, length: int, search: Search, sizes: tuple[int, int]) -> DataFrame:
    """(tag, kind, seq_name, position1, strand1, position2, strand2, distance): the best pair of each template.

    Both ends are mapped; pairs on opposite strands whose template length lies within ``sizes`` are concordant. A template without one takes its best two
    matches as discordant, and one with a single mapped end stays unpaired.
    """
    a, b = (map_reads(e, ref, length, search).select("tag", "seq_name", *[F.col(c).alias(f"{c}{i}") for c in ("position", "strand", "distance")]) for i, e in ((1, end1), (2, end2)))
    template = F.greatest(F.col("position1"), F.col("position2")) + length - F.least(F.col("position1"), F.col("position2"))
    good = a.join(b, ["tag", "seq_name"]).where((F.col("strand1") != F.col("strand2")) & template.between(*sizes)).withColumn("kind", F.lit("concordant"))
    left, right = a.withColumnRenamed("seq_name", "seq_name1"), b.withColumnRenamed("seq_name", "seq_name2")
    other = left.join(right, "tag", "full").withColumn("kind", F.when(F.col("seq_name1").isNull() | F.col("seq_name2").isNull(), "unpaired").otherwise("discordant"))
    other = other.join(good.select("tag").distinct(), "tag", "left_anti").withColumn("seq_name", F.coalesce("seq_name1", "seq_name2"))
    cols = ["tag", "kind", "seq_name", "position1", "strand1", "position2", "strand2", (F.coalesce("distance1", F.lit(0)) + F.coalesce("distance2", F.lit(0))).alias("distance")]
    every = good.select(*cols).unionByName(other.select(*cols))
    w = W.partitionBy("tag").orderBy("distance", "seq_name", "position1", "position2", "strand1", "strand2")
    return every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
