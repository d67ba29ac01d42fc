"""Mapping qualities: predictors, logistic models and the cases in which they apply; statistics of template lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the linear predictor that are not zero, for reads with one match and with more.
UNIQUE_FAST = {"one": -222.88906, "edit": 30.22311, "event": 169.06895, "swg": 16.16693, "quality": -0.02592, "accepted": 1.0973, "mcs": 6.32597, "mean_region": 1.18261, "most_region": -1.64119, "kmer": 1.06775}
MANY_FAST = {"one": -83.10499, "wdelta": 1.2532, "edit": -69.5877, "event": 183.12527, "swg": 13.6389, "quality": -0.02174, "edit2": -37.64175, "swg2": -9.02421, "subdominant": -0.182, "accepted": 0.06244, "mcs": 1.77801, "mean_region": 0.54612, "kmer": 0.12584}
UNIQUE_SENSITIVE = {"one": -35.76634, "swg": 30.18393, "quality": -0.09304, "accepted": 1.18547, "mcs": 1.85906, "mean_region": -3.10824, "most_region": 2.89171, "kmer": 1.21661}
MANY_SENSITIVE = {"one": -136.4, "edit": 89.79, "event": 40.58, "swg": 15.28, "quality": -0.006194, "swg2": -10.32, "subdominant": -0.1313, "accepted": -0.0009171, "mcs": 1.75, "mean_region": -0.389, "most_region": 0.6126, "kmer": 0.2264}
PAIRS = {"one": 3.97843, "edit": 138.46925, "event": 345.56584, "swg": 27.90942, "mapq1": 0.98446, "mapq2": 0.90512, "edit2": -149.63586, "event2": -339.78928, "swg2": -26.80168, "subdominant": -0.01971, "wdelta": 0.1796, "mean_region": -0.20189}
Z_MOST = 300.0


def distance_norm(distance: Column, length: Column) -> Column:
    return (length - distance) / length.cast("double")


def score_norm(score: Column, length: Column, match: int = 1) -> Column:
    return score / (length * match).cast("double")


def linear(model: dict[str, float], terms: dict[str, Column]) -> Column:
    """The linear predictor, of the terms that the model names."""
    z = F.lit(model["one"])
    for name, weight in model.items():
        if name != "one":
            z = z + F.lit(weight) * terms[name].cast("double")
    return z


def logit_mapq(z: Column, cap: int = 59) -> Column:
    """-10 log10 of 1 - sigmoid(z), rounded, at most ``cap``."""
    return F.least(F.lit(cap), F.round(10.0 * F.log10(1.0 + F.exp(F.least(z, F.lit(Z_MOST))))).cast("int"))


def deltas(n: Column, mcs: Column, primary_edit: Column, primary_swg: Column, min1: Column, min2: Column, max1: Column, max2: Column) -> tuple[Column, Column]:
    """(delta, wdelta) of a read: delta is -1 for a single match, 0 for a tie (the best match is not best in all respects, or the next equals it in one)."""
    tie = (primary_swg != max1) | (primary_edit != min1) | (max1 == max2) | (min1 == min2)
    delta = F.when(n == 0, 0).when(n == 1, -1).when(tie, 0).otherwise(min2 - min1)
    wdelta = F.when(n == 0, 0).when(n == 1, mcs - min1).otherwise(F.least(mcs, min2) - min1)
    return delta, wdelta


def mapq_single(delta: Column, wdelta: Column, unique: Column, many: Column, local_length: Column | None = None) -> Column:
    """0 for a tie, 60 if no match of the next stratum was found, else by the model; 1 for local matches of fewer than 40 bases."""
    out = F.when(delta == 0, 0).when(wdelta > 1, 60).when(delta == -1, unique).otherwise(many)
    return out if local_length is None else F.when(local_length < 40, 1).otherwise(out)


def mapq_pair(discordant: Column, end_tied: Column, delta: Column, wdelta: Column, sigma2: Column, mapq1: Column, mapq2: Column) -> Column:
    tied = F.when(delta == 0, F.least(F.floor(sigma2).cast("int"), F.lit(4))).otherwise(5 + F.least(F.greatest(wdelta, F.lit(0)), F.lit(10)))
    free = F.when(delta == 0, 0).when(wdelta > 1, 60).otherwise(F.floor((mapq1 + mapq2) / 2).cast("int"))
    return F.when(discordant, 0).when(end_tied, tied).otherwise(free)


def sigma(length: Column, mean: Column, sd: Column) -> Column:
    """How many standard deviations a template length is off the mean."""
    return F.abs(length - mean) / sd


def samples_needed(sd: Column, margin: float = 20.0) -> Column:
    """Samples for which the mean's 95 % interval is within ``margin``."""
    return F.floor(F.pow(1.96 * sd / margin, F.lit(2.0))).cast("bigint") + 1


def reliable(n: Column, sd: Column, least: int = 100) -> Column:
    return (n > samples_needed(sd)) & (n >= least)


def insert_size(strand1: Column, position1: Column, length1: Column, strand2: Column, position2: Column, length2: Column) -> Column:
    """1 + end of the reverse map - begin of the forward one, for maps of one block on a sequence; 0 on equal strands."""
    return F.when(strand1 == strand2, 0).when(strand1 == "+", 1 + position2 + length2 - position1).otherwise(1 + position1 + length1 - position2)


def observed_size(position1: Column, length1: Column, position2: Column, length2: Column) -> Column:
    """Rightmost less leftmost place, negative if the second map is the leftmost one or begins where the first does."""
    most = F.greatest(position1 + length1, position2 + length2)
    return F.when(position1 < position2, most - position1).otherwise(-(most - position2))
