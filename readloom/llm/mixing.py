"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

A source's target is its weight's share of all words, but never more than ``max_epochs`` times what it has; what
the capped sources leave is shared again by weight among the others. The water level is found in closed form: with
the sources ordered by cap / weight, the first k are full exactly if the level that the rest then reach does not
exceed the next ratio, so running sums over the table of sources suffice.

A document is taken floor(target / source size) times, and once more if it lies in the seeded sample that makes up
the fraction: documents of a source are put in the order of a seeded hash of id and text and taken until the fraction
of the source's words is reached. Where the order is cut is found digit by digit: the sizes are added up by the next ten bits of
the hash among the rows that agree in the ones before, which leaves a table of 1,024 rows a source at most to
run over. The last digit is of a hash of the row itself, so that equal rows part as well, and the rows that agree in all four
are a trillionth of a source. So no source's rows meet in one task, and no group of equal rows.

Defined cases: null texts have size 0; null is a source of its own, ordered last; sources of size 0 have target
0; with no words at all every target is 0; documents of size 0 are taken for 0 words; rows that repeat an id are
drawn one by one, and rows equal in id and text are interchangeable; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import ROW, WORD, materialize, text_or_empty, with_row_key

DIGITS, DIGIT_BITS = 4, 10
_TIMES, _COPY = "readloom_times", "readloom_copy"


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Adds weight: the given ones in turn, sources in code point order, null last. One row per source comes in."""
    turn = (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds target to a table (source, source_size, weight) with one row per source."""
    order = W.orderBy("ratio", F.col("source").isNull(), "source")
    upto, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(1, W.unboundedFollowing)
    everything = W.partitionBy()
    caps = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", F.sum("cap").over(upto))
        .withColumn("rest", F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
        .withColumn("next_ratio", F.lead("ratio").over(order))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("least_ratio", F.min("ratio").over(everything))
    )
    # The level if the sources up to this one are full; it holds for the first of them at which it is consistent.
    level = F.when((F.col("rest") > 0), (F.col("total") - F.col("full")) / F.col("rest"))
    level = F.when((level <= F.col("next_ratio")) & (level >= F.col("ratio")), level)
    none_full = F.col("total") / F.col("all_weight")
    caps = caps.withColumn("level", F.min(level).over(everything))
    level = F.when(none_full <= F.col("least_ratio"), none_full).otherwise(F.col("level"))
    filled = F.least(F.col("cap"), level * F.col("weight"))
    return caps.select("source", "source_size", "weight", F.coalesce(filled, F.col("cap")).alias("target"))


def seeded_draw(seed: int, doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of seed, id and the text's MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(15)), 16, 10).cast("long")


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the digits c0.. of the place where the fraction of each source ends (null if it is none), and ``left``, the words of the fraction there."""
    cuts = plan.withColumn("left", F.col("part"))
    for k in range(DIGITS):
        inside = rows
        if k:
            same = _same_source("r", "c")
            for i in range(k):
                same = same & (F.col(f"r.d{i}") == F.col(f"c.c{i}"))
            inside = rows.alias("r").join(cuts.alias("c"), same).select("r.*")
        run = W.partitionBy("source").orderBy(f"d{k}").rowsBetween(W.unboundedPreceding, 0)
        sums = inside.groupBy("source", f"d{k}").agg(F.sum("size").alias("words")).withColumn("end", F.sum("words").over(run))
        found = (
            sums.alias("s")
            .join(cuts.alias("c"), _same_source("s", "c"))
            .where("s.end - s.words < c.left and c.left <= s.end")
            .select("s.source", F.col(f"s.d{k}").alias(f"c{k}"), (F.col("c.left") - F.col("s.end") + F.col("s.words")).alias("rest"))
        )
        both = cuts.alias("p").join(found.alias("f"), _same_source("p", "f"), "left")
        cuts = materialize(both.select("p.*", f"c{k}", "rest").withColumn("left", F.col("rest")).drop("rest"), f"mix-cut{k}")
    return cuts


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, repeats, taken, and the row key of ``docs`` if it has one."""
    given = [ROW] if ROW in docs.columns else []
    doc_id, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    rows = materialize(
        docs.select(
            doc_id.alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            seeded_draw(seed, doc_id, text).alias("draw"),
            F.xxhash64(F.col(ROW) if given else F.monotonically_increasing_id()).alias("tie"),
            *given,
        ),
        "mix-sizes",
    )
    low = (1 << DIGIT_BITS) - 1
    digits = [F.shiftright("draw", 60 - DIGIT_BITS * (k + 1)).bitwiseAND(F.lit(low)) for k in range(DIGITS - 1)]
    digits.append(F.col("tie").bitwiseAND(F.lit(low)))
    rows = rows.withColumns({f"d{k}": d.cast("int") for k, d in enumerate(digits)})
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(cyclic_weights(sizes, weights), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs)
    plan = plan.withColumn("whole", whole).withColumn("part", F.col("target") - whole * F.col("source_size"))
    cuts = _cuts(rows, materialize(plan, "mix-plan"))  # a table, so that the join can split the rows of a hot source
    here, cut = (F.struct(*[F.col(f"{c}{k}") for k in range(DIGITS)]) for c in "dc")
    side = F.when(F.col("c0").isNull() | (here > cut), 1).when(here < cut, -1).otherwise(0)
    at = rows.alias("r").join(cuts.alias("p"), _same_source("r", "p"))
    at = at.select("r.*", "source_size", "target", "whole", "left", *[f"c{k}" for k in range(DIGITS)]).withColumn("side", side)
    within = W.partitionBy("source").orderBy("draw", "tie", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    # nearest: the document on which the cut falls is taken if at least half of it lies before the cut
    edge = at.where("side = 0").withColumn("more", (F.sum("size").over(within) - F.col("size") / 2 <= F.col("left")).cast("long"))
    out = at.where("side <> 0").withColumn("more", (F.col("side") < 0).cast("long")).unionByName(edge)
    repeats = F.col("whole") + F.col("more")
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), *given)


def repeat_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source and what else they have), each as often as it is taken."""
    keyed = with_row_key(docs)
    times = mixed(keyed, **how).where("repeats > 0").select(ROW, F.col("repeats").cast("int").alias(_TIMES))
    copies = keyed.join(times, ROW).withColumn(_COPY, F.explode(F.array_repeat(F.lit(0), F.col(_TIMES))))
    return copies.select(*docs.columns)
