"""What keeps seconds and memory of a task in proportion to the input: rows dealt over the cores, cheap scripts, sized parts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import edits as E
from readloom.functions import sequence as S
from readloom.plans import catalog
from readloom.plans import views as V


@pytest.mark.parametrize("view", [V.reads, V.ref, V.planted_reads])
def test_small_files_are_dealt_over_the_cores(spark, data, view):
    """A file of one row group is one task; the texts made of it are made by many."""
    assert view(spark, data).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def joined(elements):
    return [(op, sum(n for _, n in g)) for op, g in itertools.groupby((x for x in elements if x[1] > 0), lambda x: x[0])]


def trimmed(elements, least):
    at = [i for i, (op, n) in enumerate(elements) if op == "M" and n >= least]
    size = lambda part: ("S", sum(n for op, n in part if op in "MXIS"))
    return joined([size(elements[: at[0]]), *elements[at[0] : at[-1] + 1], size(elements[at[-1] + 1 :])] if at else [size(elements)])


def test_scripts(spark):
    """Scripts of all kinds, empty and missing ones among them, merged and trimmed without a fold of lambda functions."""
    r = random.Random(4)
    rows = [(i, [(r.choice("MXIDSN"), r.randrange(4) * r.randrange(6)) for _ in range(r.randrange(9))]) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "id int, x array<struct<op:string,len:int>>").repartition(7)
    out = df.select("id", E.merged(F.col("x")).alias("m"), E.curated(F.col("x"), 5).alias("c"), E.render_sam_cigar(F.col("x")).alias("t"))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x.id: (x.m and [tuple(e) for e in x.m], x.c and [tuple(e) for e in x.c], x.t) for x in out.collect()}
    assert got.pop(500) == (None, None, None)
    for i, x in rows[:-1]:
        runs = [(op, sum(n for _, n in g)) for op, g in itertools.groupby((("M" if op == "X" else op, n) for op, n in x), lambda e: e[0])]
        assert got[i] == (joined(x), trimmed(x, 5), "".join(f"{n}{op}" for op, n in runs if n > 0))


def test_runs(spark, data):
    rows = [("AACCCGT",), ("",), ("T",), (None,)]
    got = [x.r and [tuple(e) for e in x.r] for x in spark.createDataFrame(rows, "s string").select(S.runs(F.col("s")).alias("r")).collect()]
    assert got == [[(0, 2), (2, 3), (5, 1), (6, 1)], [], [(0, 1)], None]
    plan = catalog.QUERIES["STR_15_run_lengths"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1 and "regexp_extract_all" not in plan


def test_parts_follow_the_input(spark, data):
    m = V.maps(spark, data)
    few, many = (V.parted(m, "tag", mb).rdd.getNumPartitions() for mb in (1 << 10, 0.01))
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many > few
