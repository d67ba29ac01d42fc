"""Suffix order and what is read off it: suffix array, BWT, rank table, exact regions with their occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "$"  # sorts before the bases


def suffix_array(ref: DataFrame, bucket: int = 4, depth: int = 1000) -> DataFrame:
    """(rank, seq_name, offset, bwt) of all suffixes of a reference, compared on their first ``depth`` bases, then by name and offset.

    An external bucket sort: suffixes are dealt by their first ``bucket`` bases, ranked in their bucket, and moved by the number of suffixes in
    the buckets before, which is a table of 5^bucket rows at most. No sort meets all suffixes in one task.
    """
    text = F.concat("text", F.lit(END))
    at = F.sequence(F.lit(0), F.length("text") - 1)
    rows = ref.where(F.length("text") > 0).select("seq_name", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("offset"), F.substring(text, i + 1, F.lit(depth)).alias("suffix"), F.when(i == 0, END).otherwise(F.substring("text", i, F.lit(1))).alias("bwt"),
    ))).alias("s")).select("seq_name", "s.*", F.substring("s.suffix", 1, bucket).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    w = W.partitionBy("bucket").orderBy("suffix", "seq_name", "offset")
    ranked = rows.withColumn("own", F.row_number().over(w)).join(F.broadcast(before), "bucket")
    return ranked.select((F.col("before") + F.col("own") - 1).alias("rank"), "seq_name", "offset", "bwt")


def rank_table(index: DataFrame) -> DataFrame:
    """(kmer, lo, hi): the interval of each k-mer among the sorted occurrences of a k-mer index. One row per k-mer, so the running sum is over 4^k rows at most."""
    counts = index.groupBy("kmer").agg(F.count("*").alias("n"))
    hi = F.sum("n").over(W.orderBy("kmer").rowsBetween(W.unboundedPreceding, 0))
    return counts.select("kmer", (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def capped_hits(seeds: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """The first ``most`` occurrences (by sequence and offset) of each seed (tag, at, kmer): the limit of exact hits that a search is given.

    Occurrences behind the first ``most`` of their k-mer are left out before the join, as no seed is given them; else its rows follow seeds times text.
    """
    own = W.partitionBy("kmer").orderBy("seq_name", "offset")
    first = index.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= most).drop("rn")
    w = W.partitionBy("tag", "at").orderBy("seq_name", "offset")
    return seeds.join(first.hint("merge"), "kmer").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("tag", "at", "seq_name", "offset")


def frequency(n: Column) -> Column:
    """log4 of a k-mer's occurrences; 0 for those that occur once or never."""
    return F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(4.0))
