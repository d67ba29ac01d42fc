"""Records of several files side by side: by line, interleaved, by tag; what does not fit is an error of the job, not a lost row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _must(condition: Column, message: str) -> Column:
    return F.assert_true(condition, message).isNull()


def interleaved(lines: DataFrame) -> DataFrame:
    """(tag1, tag2, read1, read2) of records (line, tag, read), lines from 0: two in turn are a pair. A record without its mate fails the job."""
    pairs = lines.groupBy(F.floor(F.col("line") / 2).alias("pair")).agg(
        *[F.max(F.when(F.col("line") % 2 == i, F.col(c))).alias(f"{c}{i + 1}") for c in ("tag", "read") for i in (0, 1)], F.count("*").alias("n")
    )
    return pairs.where(_must(F.col("n") == 2, "a record has no mate")).select("tag1", "tag2", "read1", "read2")


def lockstep(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records (line, tag, read) of two files by line; they must have the same lines."""
    x = a.select("line", F.col("tag").alias("tag1"), F.col("read").alias("read1"))
    y = b.select("line", F.col("tag").alias("tag2"), F.col("read").alias("read2"))
    both = x.join(y, "line", "full")
    return both.where(_must(F.col("tag1").isNotNull() & F.col("tag2").isNotNull(), "the files differ in length"))


def common(master: DataFrame, slave: DataFrame, key: str) -> DataFrame:
    """``master`` with what ``slave`` has of its reads; a read that the slave lacks fails the job."""
    there = slave.withColumn("readloom_there", F.lit(True))
    both = master.join(there, key, "left")
    return both.where(_must(F.col("readloom_there").isNotNull(), "a read of the master is not in the slave")).drop("readloom_there")


def pending_mates(rows: DataFrame) -> DataFrame:
    """Pairs of SAM rows (tag, flag, rname, pos, pnext): first ends with the second ends that lie where they say, and say where they lie."""
    first, second = (rows.where(F.col("flag").bitwiseAND(F.lit(bit)) > 0) for bit in (64, 128))
    mate = second.select("tag", "rname", F.col("pos").alias("pnext"), F.col("pnext").alias("pos"))
    return first.drop("flag").distinct().join(mate.distinct(), ["tag", "rname", "pos", "pnext"])
