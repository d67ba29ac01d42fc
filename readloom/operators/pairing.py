"""Pairs of the two ends of a template: join, geometry, proper-pair test, fallbacks and template-size statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import pairs as P
from readloom.functions import sequence as S
from readloom.functions.alignment import edit_alignment


def candidate_pairs(end1: DataFrame, end2: DataFrame) -> DataFrame:
    """All pairs of maps of both ends on the same sequence, with orientation, layout and template length."""
    a = end1.select("tag", "seq_name", *[F.col(c).alias(f"{c}1") for c in ("strand", "position", "length", "event_distance", "phred")])
    b = end2.select("tag", "seq_name", *[F.col(c).alias(f"{c}2") for c in ("strand", "position", "length", "event_distance", "phred")])
    stop1, stop2 = F.col("position1") + F.col("length1"), F.col("position2") + F.col("length2")
    geometry = (F.col("position1"), stop1, F.col("position2"), stop2)
    return a.join(b, ["tag", "seq_name"]).select(
        "*",
        P.orientation(F.col("strand1"), F.col("strand2"), F.col("position1"), F.col("position2")).alias("orientation"),
        P.layout(*geometry).alias("layout"),
        P.template_length(*geometry).alias("template_length"),
        (F.col("event_distance1") + F.col("event_distance2")).alias("distance"),
    )


def with_relation(pairs: DataFrame, least: int = 0, most: int = 1000, orientations=("FR",)) -> DataFrame:
    good = F.col("orientation").isin(*orientations) & F.col("template_length").between(least, most)
    return pairs.withColumn("relation", F.when(good, "concordant").otherwise("discordant"))


def discordant_fallback(pairs: DataFrame) -> DataFrame:
    """Concordant pairs, and discordant ones of the templates that have no concordant pair."""
    good = pairs.where("relation = 'concordant'")
    rest = pairs.where("relation = 'discordant'").join(good.select("tag").distinct(), "tag", "left_anti")
    return good.unionByName(rest)


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    w = W.partitionBy("tag").orderBy(
        F.col("relation") != "concordant", "distance", "template_length", "seq_name", "position1", "position2", "strand1", "strand2",
        "length1", "length2", "event_distance1", "phred1", "phred2",
    )
    return pairs.withColumn("rank", F.row_number().over(w))


def template_size(pairs: DataFrame) -> DataFrame:
    """One row: n, mean, sd of the template length of templates with a single concordant pair; the range is six sd wide either way."""
    one = pairs.where("relation = 'concordant'").groupBy("tag").agg(F.count("*").alias("n"), F.min("template_length").alias("len")).where("n = 1")
    mean, sd = F.avg("len"), F.stddev_samp("len")
    return one.agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.greatest(F.lit(0.0), F.round(mean - 6 * sd, 4)).alias("least"), F.round(mean + 6 * sd, 4).alias("most"))


def ends_in_pairs(end: DataFrame, pairs: DataFrame, side: int) -> DataFrame:
    """Maps of one end that take part in a pair."""
    keys = [F.col(f"e.{c}") == F.col(f"p.{c}{side}") for c in ("strand", "position", "length", "event_distance", "phred")]
    same = (F.col("e.tag") == F.col("p.tag")) & (F.col("e.seq_name") == F.col("p.seq_name"))
    for k in keys:
        same = same & k
    return end.alias("e").join(pairs.alias("p"), same, "left_semi")


def rescued(mapped: DataFrame, text: str, begin: str, mate: str, ahead: int, most: int) -> DataFrame:
    """Adds distance and begin (from 1) of the mate, searched on the other strand in the ``ahead`` bases from a mapped end on; rows without one within ``most`` edits go."""
    window = F.substring(F.col(text), F.col(begin) + 1, F.lit(ahead))
    found = edit_alignment(S.reverse_complement(F.col(mate)), window)
    rows = mapped.withColumn("readloom_hit", found).where(-F.col("readloom_hit.score") <= most)
    return rows.withColumn("distance", -F.col("readloom_hit.score")).withColumn("begin", F.col(begin) + F.col("readloom_hit.begin") + 1).drop("readloom_hit")
