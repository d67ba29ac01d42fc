"""Profiles of maps, errors and counters, reports: each one aggregation of narrow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import edits as E
from readloom.operators.filters import introns


def counter_facts(counters: DataFrame) -> DataFrame:
    """(tag, total, first, second, delta, subdominant, uniq) of counters by stratum.

    first and second are the nearest strata with maps, subdominant the maps of the second; uniq is the number of empty strata behind a first one
    of exactly one map, 0 if there is no other, -1 if the first has more.
    """
    c = F.col("counters")
    at = F.filter(F.transform(c, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    first, second = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    return counters.select(
        "tag", F.aggregate(c, F.lit(0).cast("bigint"), lambda s, n: s + n).alias("total"), first.alias("first"), second.alias("second"), (second - first).alias("delta"),
        F.coalesce(F.get(c, second), F.lit(0)).alias("subdominant"), F.when(F.get(c, first) != 1, -1).otherwise(F.coalesce(second - first - 1, F.lit(0))).alias("uniq"),
    )


def _bases(text: str) -> Column:
    return F.filter(F.split(F.col(text), ""), lambda c: c != "")


def errors_by_offset(pairs: DataFrame, read: str, text: str) -> DataFrame:
    """(at, mismatches, n): bases compared and mismatched at each offset of the read."""
    differ = F.zip_with(_bases(read), _bases(text), lambda a, b: (a != b).cast("int"))
    return pairs.select(F.posexplode(differ).alias("at", "bad")).groupBy("at").agg(F.sum("bad").alias("mismatches"), F.count("*").alias("n"))


def substitutions(pairs: DataFrame, read: str, text: str, context: int) -> DataFrame:
    """(of, read_as, n): what each base of the text is read as, with ``context`` bases of the text on either side."""
    at = F.sequence(F.lit(context + 1), F.length(text) - context)
    one = F.transform(at, lambda i: F.struct(F.substring(F.col(text), i - context, F.lit(2 * context + 1)).alias("of"), F.substring(F.col(read), i, F.lit(1)).alias("read_as")))
    return pairs.where(F.length(text) > 2 * context).select(F.inline(one)).groupBy("of", "read_as").agg(F.count("*").alias("n"))


def script_errors(rows: DataFrame, script: str) -> DataFrame:
    """One row of totals: events, edits, mismatches, inserted and deleted bases."""
    x = F.col(script)
    of = lambda op: F.sum(F.aggregate(F.filter(x, lambda e: e["op"] == op), F.lit(0), lambda s, e: s + e["len"]))
    return rows.agg(F.sum(E.event_distance(x)).alias("events"), F.sum(E.edit_distance(x)).alias("edits"), of("X").alias("mismatches"), of("I").alias("inserted"), of("D").alias("deleted"))


def split_profile(maps: DataFrame, blocks: str) -> DataFrame:
    """(junctions, maps, total): maps by their number of junctions, and the junctions' lengths added up."""
    gaps = introns(F.col(blocks))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return maps.select(F.size(gaps).cast("bigint").alias("junctions"), total.alias("t")).groupBy("junctions").agg(F.count("*").alias("maps"), F.sum("t").alias("total"))


def chimeras(end1: DataFrame, end2: DataFrame) -> DataFrame:
    """Templates with both ends mapped, and those of them whose ends share no sequence. Ends are reduced to their sequences first."""
    a, b = (e.select("tag", "seq_name").distinct() for e in (end1, end2))
    both = a.select("tag").distinct().join(b.select("tag").distinct(), "tag")
    same = a.join(b, ["tag", "seq_name"]).select("tag").distinct().withColumn("same", F.lit(True))
    return both.join(same, "tag", "left").agg(F.count("*").alias("templates"), F.count_if(F.col("same").isNull()).alias("chimeric"))


def search_depth(best: DataFrame, mcs: Column, strata: int) -> DataFrame:
    """(tag, needed, missing, deep): complete strata that a read needs for ``strata`` beyond its best, how many it lacks, whether it has them."""
    needed = (F.col("min1") + strata + 1).cast("bigint")
    return best.select("tag", needed.alias("needed"), F.greatest(needed - mcs, F.lit(0)).cast("bigint").alias("missing"), (mcs >= needed).alias("deep"))


def combined(counters: DataFrame, key: str, value: str) -> DataFrame:
    return counters.groupBy(key).agg(F.sum(value).alias("total"), F.max(value).alias("most"), F.min(value).alias("least"), F.round(F.avg(value), 6).alias("mean"))


def nested(rows: DataFrame, outer: str, inner: str, values: list[str]) -> DataFrame:
    """A histogram of ``inner`` for each value of ``outer``; the columns are the given values."""
    return rows.groupBy(outer).pivot(inner, values).agg(F.count(F.lit(1))).fillna(0, values)


def plot_values(rows: DataFrame, x: Column) -> DataFrame:
    """(x, n, upto, share) of a distribution over buckets, which are few."""
    per = rows.groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    return per.select("x", "n", F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


def mapping_report(maps: DataFrame) -> DataFrame:
    """Maps by kind of read, strand and bisulfite conversion, with mean quality and longest map."""
    kind = F.when(F.count("*").over(W.partitionBy("tag")) == 1, "unique").otherwise("multi")
    return maps.withColumn("kind", kind).groupBy("kind", "strand", "bisulfite").agg(F.count("*").alias("n"), F.round(F.avg("phred"), 6).alias("mapq"), F.max("length").alias("longest"))


def report(templates: DataFrame, maps: DataFrame) -> DataFrame:
    """(section, name, value) of the general, map and population sections."""
    per = maps.groupBy("tag").agg(F.count("*").alias("n")).agg(F.count("*").alias("mapped"), F.sum("n").alias("all"), F.round(F.avg("n"), 6).alias("mean"))

    def items(df: DataFrame, *names: tuple[str, str]) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("name"), F.col(b).cast("double").alias("value")) for a, b in names])))

    out = items(templates.agg(F.count("*").alias("reads")), ("general", "reads"))
    out = out.unionByName(items(per, ("general", "mapped"), ("maps", "all"), ("maps", "mean")))
    return out.unionByName(items(maps.agg(F.count_distinct("seq_name").alias("sequences")), ("population", "sequences")))


def failure_class(best: DataFrame) -> DataFrame:
    """Adds class: unmapped, tie, unique, d1 to d5 by the distance to the next map, or more."""
    delta = F.col("min2") - F.col("min1")
    kind = F.when(F.col("n_maps").isNull(), "unmapped").when(delta == 0, "tie").when(F.col("n_maps") == 1, "unique").when(delta <= 5, F.concat(F.lit("d"), delta.cast("string"))).otherwise("more")
    return best.withColumn("class", kind)


#: Search parameters as fractions of the read length.
FRACTIONS = {"max_error": 0.12, "complete_error": 0.04, "bandwidth": 0.2, "min_identity": 0.8}
LIMITS = {"reported_single": 5, "searched_end": 100, "searched_pairs": 20}


def instantiated(length: Column) -> dict[str, Column]:
    """The parameters as numbers for reads of a length, rounded down, and the limits of single ends and pairs."""
    return {**{n: F.floor(length * x + 1e-9).cast("int") for n, x in FRACTIONS.items()}, **{n: F.lit(x) for n, x in LIMITS.items()}}
