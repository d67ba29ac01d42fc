"""Alignment kernels against plain dynamic programming, the mapper against its own exhaustive mode, seeds against enumeration."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from readloom.functions import alignment as A
from readloom.operators import mapper, partitions, seeds, suffixes

NONE = -(10**9)


def texts(rng, n, longest, shortest=0):
    return ["".join(rng.choice("ACGT") for _ in range(rng.randint(shortest, longest))) for _ in range(n)]


def test_edit_columns():
    rng = random.Random(2)
    keys = ["".join(rng.choice("ACGT") for _ in range(rng.choice([1, 5, 30, 63, 64, 90, 130]))) for _ in range(50)]
    others = texts(rng, 50, 150, 1)
    got = A.edit_columns(keys, others)
    for row, k, t in zip(got, keys, others, strict=True):
        before = [0] * (len(t) + 1)
        for i in range(1, len(k) + 1):
            now = [i]
            for j in range(1, len(t) + 1):
                now.append(min(before[j - 1] + (k[i - 1] != t[j - 1]), before[j] + 1, now[-1] + 1))
            before = now
        assert row[: len(t)].tolist() == before[1:]


def best_score(k, t, mode, scores):
    match, mismatch, gap_open, extend = scores
    free, m, n = mode != "global", len(k), len(t)
    h = [[0 if free or j == 0 else -(gap_open + extend * j) for j in range(n + 1)]] + [[0 if mode == "local" else -(gap_open + extend * i)] + [0] * n for i in range(1, m + 1)]
    e, f = ([[NONE] * (n + 1) for _ in range(m + 1)] for _ in range(2))
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] - gap_open, e[i][j - 1]) - extend
            f[i][j] = max(h[i - 1][j] - gap_open, f[i - 1][j]) - extend
            h[i][j] = max(h[i - 1][j - 1] + (match if k[i - 1] == t[j - 1] else -mismatch), e[i][j], f[i][j], 0 if mode == "local" else NONE)
    return h[m][n] if mode == "global" else max(h[m]) if mode == "glocal" else max(map(max, h))


@pytest.mark.parametrize("mode", ["global", "glocal", "local"])
def test_affine(mode):
    rng = random.Random(3)
    keys, others = texts(rng, 60, 25), texts(rng, 60, 40)
    others[:20] = [k[:5] + k[7:15] + "GG" + k[15:] for k in keys[:20]]
    for scores in ((1, 4, 6, 1), (0, 1, 0, 1), (2, 1, 1, 1)):
        for k, t, (score, begin, stop, cigar) in zip(keys, others, A.affine_batch(keys, others, mode, scores, None), strict=True):
            total, at, used = 0, begin, 0
            for n, op in re.findall(r"(\d+)([MXID])", cigar):
                n = int(n)
                total += {"M": scores[0] * n, "X": -scores[1] * n}.get(op, -scores[2] - scores[3] * n)
                used, at = used + n * (op != "D"), at + n * (op != "I")
            assert score == best_score(k, t, mode, scores) == total and at == stop and (mode == "local" or used == len(k))


def test_banded_equals_full_within_the_band():
    rng = random.Random(4)
    keys = texts(rng, 30, 40, 30)
    others = [k[:10] + k[12:20] + "A" + k[20:] for k in keys]
    full, band = (A.affine_batch(keys, others, "global", (1, 4, 6, 1), b) for b in (None, 12))
    assert [x[0] for x in full] == [x[0] for x in band]


def test_scripts_fit(spark):
    df = spark.createDataFrame([("ACGT", "ACGT", "4M"), ("ACGT", "AGGT", "1M1X2M"), ("ACGT", "AGGT", "4M"), ("ACGT", "ACT", "2M1I1M"), ("", "", ""), (None, None, None), ("ACGT", "ACGT", "3M")], "k string, t string, c string")
    assert [r.x for r in df.select(A.script_fits(F.col("k"), F.col("t"), F.col("c")).alias("x")).collect()] == [True, True, False, True, True, True, False]


def test_suffix_array(spark):
    rng = random.Random(5)
    ref = [(f"s{i}", x) for i, x in enumerate(texts(rng, 5, 60, 1) + ["AAAA", "AAAA"])]
    got = suffixes.suffix_array(spark.createDataFrame(ref, "seq_name string, text string"), bucket=2).orderBy("rank").collect()
    want = sorted((t[i:] + "$", n, i) for n, t in ref for i in range(len(t)))
    assert [(r.seq_name, r.offset) for r in got] == [(n, i) for _, n, i in want] and [r.rank for r in got] == list(range(len(want)))


def test_optimal_seeds(spark):
    rng = random.Random(6)
    rows = [(tag, at, 4, rng.randint(0, 30)) for tag in range(6) for at in range(13)]
    got = {r.tag: r.total for r in partitions.optimal_seeds(spark.createDataFrame(rows, "tag long, at int, k int, n long"), 4, 3).collect()}
    for tag in range(6):
        n = [x[3] for x in rows if x[0] == tag]
        assert got[tag] == min(n[a] + n[b] + n[c] for a, b, c in combinations(range(13), 3) if b >= a + 4 and c >= b + 4)


def test_modes_agree(spark):
    """Where fast search finds a read at all within its complete strata, it finds what the exhaustive search finds; reads of all kinds of errors."""
    rng = random.Random(7)
    ref = [(f"s{i}", x) for i, x in enumerate(texts(rng, 6, 300, 300))]
    reads = []
    for tag in range(40):
        name, text = rng.choice(ref)
        at = rng.randint(0, 250)
        r = list(text[at : at + 40])
        for _ in range(tag % 4):
            i = rng.randrange(len(r))
            r[i : i + 1] = rng.choice([["A"], ["C", "G"], []])
        reads.append((tag, ("".join(r) + "ACGT" * 3)[:36]))
    df, table = spark.createDataFrame(reads, "tag long, read string"), spark.createDataFrame(ref, "seq_name string, text string")
    full, fast, deep = ({r.tag: (r.distance, r.mcs) for r in mapper.map_reads(df, table, 36, mapper.Search(mode=m, max_error=4, seed_length=9)).where("rank = 1").collect()} for m in ("complete", "fast", "sensitive"))
    assert {t: x[0] for t, x in deep.items()} == {t: x[0] for t, x in full.items()}
    assert all(full[t][0] == d for t, (d, mcs) in fast.items() if d < mcs)
    found = seeds.edit_matches(df, table, 4, 36).groupBy("tag").agg(F.min("distance").alias("d")).collect()
    plus = {r.tag: r.d for r in found}
    assert all(full[t][0] <= d for t, d in plus.items())
