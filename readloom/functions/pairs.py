"""Pair geometry, SAM flags and mapping qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = {
    "mmap": (0, 1, 5, 10, 50, 100, 500, 1000),
    "read_length": (5, 40, 80, 100, 150, 300, 800, 1000, 2000, 5000),
    "uniq": (-1, 0, 1, 2, 3, 10, 50, 100, 500),
    "delta_edit": tuple(range(11)),
    "delta_swg": (0, 1, 2, 3, 4, 5, 10, 20),
    "mapq": tuple(range(61)),
    "junctions": (1, 2, 3),
    "inss": tuple(range(-1000, 50010, 10)),
}


def orientation(s1: Column, s2: Column, p1: Column, p2: Column) -> Column:
    """FR, RF, FF or RR by strands in order of position."""
    first = F.when(p1 <= p2, s1).otherwise(s2)
    last = F.when(p1 <= p2, s2).otherwise(s1)
    return F.concat(F.when(first == "+", "F").otherwise("R"), F.when(last == "+", "F").otherwise("R"))


def layout(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """separate, overlap or contain, for half-open intervals."""
    inside = ((b1 <= b2) & (e2 <= e1)) | ((b2 <= b1) & (e1 <= e2))
    return F.when((e1 <= b2) | (e2 <= b1), "separate").when(inside, "contain").otherwise("overlap")


def template_length(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return F.greatest(e1, e2) - F.least(b1, b2)


def sam_flag(paired: Column, mapped: Column, reverse: Column, mate_mapped: Column, mate_reverse: Column, proper: Column, first: Column, secondary: Column) -> Column:
    bits = F.when(~mapped, 4).otherwise(0) + F.when(mapped & reverse, 16).otherwise(0) + F.when(secondary, 256).otherwise(0)
    mate = (
        F.lit(1) + F.when(proper, 2).otherwise(0) + F.when(~mate_mapped, 8).otherwise(0)
        + F.when(mate_mapped & mate_reverse, 32).otherwise(0) + F.when(first, 64).otherwise(128)
    )
    return bits + F.when(paired, mate).otherwise(0)


def logistic_mapq(z: Column, cap: int = 59) -> Column:
    """Phred of the error probability 1 - sigmoid(z), between 1 and ``cap``."""
    p = 1.0 / (1.0 + F.exp(z))
    return F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(-10.0 * F.log10(p)).cast("int")))


def bucket(x: Column, edges: tuple[int, ...]) -> Column:
    """Index of the first edge that x does not exceed; the number of edges beyond the last."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[i], i).otherwise(out)
    return out


def width_bucket(x: Column, least: int, most: int, step: int) -> Column:
    """Index of the step that x lies in, the ends included in the first and the last one."""
    return F.floor((F.greatest(F.lit(least), F.least(F.lit(most - step), x)) - least) / step).cast("int")
