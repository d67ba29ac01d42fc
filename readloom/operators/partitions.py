"""Seed selection that is more than cutting: optimal partitions, adaptive growth, maximal matches, schedules.

The occurrences of pieces come from joins with the k-mer table; what is done per read is a fold over a read's own short arrays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import seeds


#: Pieces as long as this at most are looked up in a table of all k-mers, which has 4^12 rows at most however long the text is.
SHORT = 12


def short_counts(ref: DataFrame, ks: list[int]) -> DataFrame:
    """(kmer, n) of the k-mers without N of all lengths in ``ks``: those of the longest are counted, and added up by their first bases."""
    at = F.explode(F.sequence(F.lit(0), F.length("text") - 1))
    top = ref.where(F.length("text") > 0).select("text", at.alias("at")).select(F.substring("text", F.col("at") + 1, F.lit(max(ks))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    cut = top.select("n", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k <= F.length("kmer"))).alias("k"), "kmer").select(F.substring("kmer", F.lit(1), F.col("k")).alias("kmer"), "n")
    return cut.where(~F.col("kmer").contains("N")).groupBy("kmer").agg(F.sum("n").alias("n"))


def long_counts(reads: DataFrame, ref: DataFrame, ks: list[int]) -> DataFrame:
    """(read, at, k, n) of the pieces without N of a read that occur, of all lengths in ``ks``: where the shortest one occurs, the text is compared on."""
    k = min(ks)
    cut = reads.select("read").distinct().select("read", F.inline(S.kmers(F.col("read"), k)).alias("at", "kmer"))
    hits = cut.join(seeds.kmer_index(ref, k), "kmer").select("read", "at", "seq_name", "offset").join(ref, "seq_name")
    piece = lambda c, at, n: F.substring(c, at + 1, n)
    same = lambda n: (piece(F.col("read"), F.col("at"), n) == piece(F.col("text"), F.col("offset"), n)) & (F.length(piece(F.col("read"), F.col("at"), n)) == n)
    met = hits.select("read", "at", F.explode(F.filter(F.array(*map(F.lit, ks)), same)).alias("k"))
    return met.groupBy("read", "at", "k").agg(F.count("*").alias("n")).where(~piece(F.col("read"), F.col("at"), F.col("k")).contains("N"))


def piece_counts(reads: DataFrame, ref: DataFrame, ks: Iterable[int]) -> DataFrame:
    """(tag, at, k, n): occurrences in the reference (seq_name, text) of each piece of a read (tag, read), for each length in ``ks``.

    The reference is read once for the short pieces and once for the long ones, whatever the number of lengths.
    """
    parts = [[k for k in ks if k <= SHORT], [k for k in ks if k > SHORT]]
    out = None
    for lengths, counts, key in zip(parts, (short_counts, lambda x, y: long_counts(reads, x, y)), (["kmer"], ["read", "at", "k"]), strict=True):
        if lengths:
            rows = reads.select("tag", "read", F.explode(F.array(*map(F.lit, lengths))).alias("k")).where(F.length("read") >= F.col("k"))
            rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("read") - F.col("k"))).alias("at")).withColumn("kmer", F.substring("read", F.col("at") + 1, F.col("k")))
            rows = rows.join(counts(ref, lengths).hint("merge"), key, "left").select("tag", "at", "k", F.coalesce("n", F.lit(0)).alias("n"))
            out = rows if out is None else out.unionByName(rows)
    return out


def optimal_seeds(counts: DataFrame, k: int, seeds: int) -> DataFrame:
    """(tag, total): the fewest occurrences in all that ``seeds`` pieces of k without overlap can have; null if the read is too short.

    Dynamic program over the places of a read: after place i, best[j] is the least total of j pieces that end at i or before.
    """
    per = counts.where(F.col("k") == k).groupBy("tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("n"))
    none = F.lit(None).cast("bigint")
    start = F.array(F.array(F.lit(0).cast("bigint"), *[none] * seeds))

    def step(rows: Column, n: Column) -> Column:
        """``rows`` has the state after each place; the piece that begins here ends k - 1 places on."""
        last, back = F.element_at(rows, -1), F.element_at(rows, -F.least(F.size(rows), F.lit(k)))
        enough = F.size(rows) >= k
        new = F.transform(F.sequence(F.lit(0), F.lit(seeds)), lambda j: F.when(j == 0, F.lit(0).cast("bigint")).otherwise(
            F.least(F.get(last, j), F.when(enough | (j == 1), F.get(F.when(enough, back).otherwise(F.get(rows, F.lit(0))), j - 1) + n))))
        return F.concat(rows, F.array(new))

    return per.select("tag", F.get(F.element_at(F.aggregate("n", start, step), -1), F.lit(seeds)).alias("total"))


def optimal_partition(counts: DataFrame, length: int, seeds: int) -> DataFrame:
    """(tag, total): the fewest occurrences in all of ``seeds`` pieces that cover the read without gap, of the lengths that ``counts`` has."""
    state = counts.where("at = 0").select("tag", F.col("k").alias("stop"), F.col("n").alias("total"))
    for _ in range(seeds - 1):
        grown = state.join(counts, (state.tag == counts.tag) & (state.stop == counts.at)).select(state.tag, (F.col("stop") + F.col("k")).alias("stop"), (F.col("total") + F.col("n")).alias("total"))
        state = grown.groupBy("tag", "stop").agg(F.min("total").alias("total"))
    return state.where(F.col("stop") == length).select("tag", "total")


def adaptive_regions(counts: DataFrame, length: int, threshold: int, steps: int, most: int | None = None) -> DataFrame:
    """(tag, begin, stop, n): regions that grow from the right end to the left until a piece has ``threshold`` occurrences or fewer.

    Then up to ``steps`` more bases are taken while that makes the piece rarer. A region is as long as ``most`` at most (the limited
    form); a last one that never gets rare enough is left out. ``counts`` has the pieces of all lengths that may be asked for.
    """
    per = counts.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("at", "k"), "n"))).alias("m"))
    begin = F.struct(F.lit(length).alias("stop"), F.lit(-1).alias("found"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("more"), F.expr("cast(array() as array<struct<begin:int,stop:int,n:bigint>>)").alias("out"))

    def close(s: Column) -> Column:
        region = F.array(F.struct(s["found"].alias("begin"), s["stop"].alias("stop"), s["n"].alias("n")))
        return F.struct(s["found"].alias("stop"), F.lit(-1).alias("found"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("more"), F.concat(s["out"], region).alias("out"))

    def grow(s: Column, at: Column) -> Column:
        n = F.coalesce(F.try_element_at("m", F.struct(at.alias("at"), (s["stop"] - at).alias("k"))), F.lit(1 << 40)).cast("bigint")
        short = F.lit(True) if most is None else s["stop"] - at <= most
        held = F.struct(s["stop"].alias("stop"), at.alias("found"), n.alias("n"), F.when(s["found"] < 0, 0).otherwise(s["more"] + 1).alias("more"), s["out"].alias("out"))
        return F.when((s["found"] < 0) & (n <= threshold), held).when((s["found"] >= 0) & (s["more"] < steps) & (n < s["n"]) & short, held).otherwise(s)

    def step(s: Column, at: Column) -> Column:
        """A region that did not grow at this place is closed, and the next one begins with it."""
        grown = grow(s, at)
        stays = (grown["found"] == at) | (s["found"] < 0)
        return F.when(stays, grown).otherwise(grow(close(s), at))

    done = F.aggregate(F.sequence(F.lit(length - 1), F.lit(0)), begin, step, lambda s: F.when(s["found"] >= 0, close(s)["out"]).otherwise(s["out"]))
    return per.select("tag", F.inline(done))


def maximal_matches(counts: DataFrame) -> DataFrame:
    """(tag, begin, stop): for each end the longest piece to its left that occurs (MEM)."""
    found = counts.where("n > 0").withColumn("stop", F.col("at") + F.col("k"))
    return found.groupBy("tag", "stop").agg(F.min("at").alias("begin")).select("tag", "begin", "stop")


def super_maximal(mems: DataFrame) -> DataFrame:
    """Those that no other one contains (SMEM)."""
    w = W.partitionBy("tag").orderBy("begin", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    return mems.withColumn("reach", F.max("stop").over(w)).where("reach is null or stop > reach").drop("reach")


def scheduled(regions: DataFrame, errors: int, threshold: int) -> DataFrame:
    """Adds degree: how many errors the search of each region may hold at most, plus one; rare regions first, until ``errors`` + 1 are dealt out.

    A region of more than ``threshold`` occurrences gets no more than one.
    """
    w = W.partitionBy("tag").orderBy("n", "begin")
    order = F.row_number().over(w)
    count = F.count("*").over(W.partitionBy("tag"))
    whole, rest = F.floor((errors + 1) / count), (errors + 1) % count
    return regions.withColumn("degree", F.when(F.col("n") > threshold, F.least(whole + F.when(order <= rest, 1).otherwise(0), F.lit(1))).otherwise(whole + F.when(order <= rest, 1).otherwise(0)).cast("int"))


def complete_strata(scheduled_regions: DataFrame) -> DataFrame:
    """(tag, mcs): every match with fewer errors than the sum of the degrees is found."""
    return scheduled_regions.groupBy("tag").agg(F.sum("degree").cast("int").alias("mcs"))


def filled(regions: DataFrame, length: int) -> DataFrame:
    """Regions stretched to the left so that they cover the read: each begins where the one before stops, the last one ends at the read's end."""
    w = W.partitionBy("tag").orderBy("begin")
    begin = F.coalesce(F.lag("stop").over(w), F.lit(0))
    stop = F.when(F.lead("begin").over(w).isNull(), F.lit(length)).otherwise(F.col("stop"))
    return regions.select("tag", begin.alias("begin"), stop.alias("stop"), "n")
