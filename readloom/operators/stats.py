"""Statistics of maps and sequences: one aggregation each, combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def cross_tab(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts by both keys, by each and in all; null marks a margin."""
    return df.select(a.alias("a"), b.alias("b")).cube("a", "b").agg(F.count("*").alias("n"))


def template_stats(templates: DataFrame, maps: DataFrame) -> DataFrame:
    """One row of totals: templates, mapped, maps, unique, most maps of one."""
    per = maps.groupBy("tag").agg(F.count("*").alias("n"))
    both = templates.join(per, "tag", "left")
    return both.agg(
        F.count("*").alias("templates"), F.count("n").alias("mapped"), F.coalesce(F.sum("n"), F.lit(0)).alias("maps"),
        F.count_if(F.col("n") == 1).alias("single"), F.max("n").alias("most"),
    )


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.round(F.avg(value), 6).alias("mean"), F.round(F.var_samp(value), 6).alias("variance"),
    )


def base_counts(seqs: DataFrame, text: str) -> DataFrame:
    """Histogram of characters: counted inside each row first, so one row per sequence and base is exploded."""
    bases = F.array(*[F.struct(F.lit(b).alias("base"), (F.length(text) - F.length(F.replace(F.col(text), F.lit(b), F.lit("")))).alias("n")) for b in "ACGTN"])
    return seqs.select(F.inline(bases)).groupBy("base").agg(F.sum("n").cast("bigint").alias("n"))


def context_counts(seqs: DataFrame, text: str, width: int = 2) -> DataFrame:
    at = F.sequence(F.lit(1), F.length(text) - width + 1)
    grams = seqs.where(F.length(text) >= width).select(F.explode(F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(width)))).alias("context"))
    return grams.groupBy("context").agg(F.count("*").alias("n"))


def diversity(maps: DataFrame) -> DataFrame:
    """(tag, sequences, dominant): distinct sequences a read maps to and the count of the most frequent."""
    per = maps.groupBy("tag", "seq_name").agg(F.count("*").alias("n"))
    return per.groupBy("tag").agg(F.count("*").alias("sequences"), F.max("n").alias("dominant"))


def roc(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, tp, fp, all_tp, all_fp): hits and misses at each score and from the highest down to it."""
    per = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth)).alias("tp"), F.count_if(~F.col(truth)).alias("fp"))
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)  # one row per score value
    return per.select("*", F.sum("tp").over(w).alias("all_tp"), F.sum("fp").over(w).alias("all_fp"))


def partial_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """What merged_moments() adds up: count, sums of values and squares, least and most."""
    v = F.col(value)
    return df.groupBy(key).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v.cast("double") * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged_moments(parts: list[DataFrame], key: str) -> DataFrame:
    """The moments of all parts together, as one pass over their rows would give them."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    all_ = rows.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))
    variance = F.when(F.col("n") > 1, (F.col("squares") - F.col("total").cast("double") * F.col("total") / F.col("n")) / (F.col("n") - 1))
    return all_.select(key, "n", "total", "least", "most", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round(variance, 6).alias("variance"))
