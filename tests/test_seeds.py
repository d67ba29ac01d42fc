"""Searches by seeds: none is missing, and no table of k-mers is broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import mapper, partitions, seeds, suffixes
from readloom.plans import catalog


def texts(n, size, letters, seed):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(size)) for _ in range(n)]


def edited(text, errors, r, indels):
    for _ in range(errors):
        at, b = r.randrange(len(text)), r.choice("ACGTN")
        text = r.choice([text[:at] + b + text[at + 1 :], *([text[:at] + b + text[at:], text[:at] + text[at + 1 :]] if indels else [])])
    return text


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def nearest_piece(read, text):
    row = [0] * (len(text) + 1)
    for x in read:
        last, row = row, [row[0] + 1]
        for j, y in enumerate(text):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return min(row)


@pytest.fixture(scope="module")
def world(spark):
    """Random reads of 24 from texts of which one in five has N; the reads have errors of all kinds."""
    r = random.Random(5)
    ref = [(f"p{i}", t if i % 5 else t[:30] + "N" + t[31:]) for i, t in enumerate(texts(20, 70, "ACGT", 1))]
    reads = []
    for i in range(120):
        text = ref[i % 20][1]
        at = r.randrange(len(text) - 30)
        cut = edited(text[at : at + 30], i % 4, r, i % 2 == 1)
        reads.append((i, cut[:24]))
    return spark.createDataFrame(reads, "tag long, read string"), spark.createDataFrame(ref, "seq_name string, text string"), reads, ref


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_searches_miss_nothing(world, errors):
    reads, ref, plain_reads, plain_ref = world
    got = {tuple(x) for x in seeds.hamming_matches(reads, ref, errors, 24).collect()}
    want = {(i, n, at, hamming(r, t[at : at + 24])) for i, r in plain_reads for n, t in plain_ref for at in range(len(t) - 23) if hamming(r, t[at : at + 24]) <= errors}
    assert got == want and len(want) > 20
    got = {(x.tag, x.seq_name, x.distance) for x in seeds.edit_matches(reads, ref, errors, 24).collect()}
    want = {(i, n, nearest_piece(r, t)) for i, r in plain_reads for n, t in plain_ref if nearest_piece(r, t) <= errors}
    assert got == want and len(want) > 20


def test_few_places_are_looked_at(spark):
    """Of reads without a match next to none is verified; pieces of eight bases without error, as before, met some 5,000 places here."""
    reads = spark.createDataFrame(list(enumerate(texts(100, 32, "ACGT", 2))), "tag long, read string")
    ref = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts(100, 10000, "ACGT", 3))], "seq_name string, text string")
    assert seeds.piece_places(reads, ref, 3, 32).count() > 3000
    assert seeds.places(reads, ref, 3, 32).count() < 50
    assert seeds.places(reads, ref, 3, 32, indels=True).count() < 100


def broadcast_generators(df):
    """Broadcasts in the plan whose rows are made by a generator: their estimate is that of the file, not of the rows."""
    found, stack = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        stack = [x for x in stack if x < depth]
        if "BroadcastExchange" in line:
            stack.append(depth)
        found += bool(stack) and "Generate" in line
    return found


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith(("JON_10_", "JON_11_", "JON_1_", "JON_3_", "ORC_1_", "ORC_2_", "ORC_4_", "ORC_8_", "SED_6", "SED_7", "SED_8", "SED_9", "SED_10", "WIN_10"))])
def test_no_table_of_kmers_is_broadcast(spark, data, name):
    assert broadcast_generators(catalog.QUERIES[name](spark, data)) == 0


def test_places_that_are_not_verified_are_left_out(world):
    """Of all that short seeds point to the mapper takes those that verified() keeps something of; what is kept is the same."""
    reads, ref, _, _ = world
    stranded, cuts = mapper.both_strands(reads), S.pieces(F.col("read"), 3)
    every = mapper.direct_candidates(stranded, ref, cuts, [8])
    few = mapper.verifiable_candidates(stranded, ref, cuts, [8], 2, 24)
    assert sorted(mapper.verified(few, ref, 2, 24).collect()) == sorted(mapper.verified(every, ref, 2, 24).collect())
    assert few.count() < every.distinct().count()


def test_piece_counts(spark):
    """Pieces of all lengths, short ones at the end of a text and such with N among them."""
    ref = [("a", "ACGTACGTACGTACGTACNTACGTACGTACGTACGTACG"), ("b", "TTTTTTTTTTTTTTTTTTTT"), ("c", "ACG"), ("d", "")]
    reads = [(1, "CGTACGTACGTACGTACNT"), (2, "TTTTTTTTTTTTTTTT"), (2, "TTTTTTTTTTTTTTTT"), (3, "GG")]
    got = partitions.piece_counts(spark.createDataFrame(reads, "tag long, read string"), spark.createDataFrame(ref, "seq_name string, text string"), range(1, 17)).collect()
    places = lambda x, t: 0 if "N" in x else sum(t[i : i + len(x)] == x for i in range(len(t) - len(x) + 1))
    want = [(tag, at, k, sum(places(r[at : at + k], t) for _, t in ref)) for tag, r in reads for k in range(1, 17) for at in range(len(r) - k + 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_hits_behind_the_cap_are_not_joined(spark):
    """Of 20,000 occurrences of a k-mer three are joined with each of its seeds."""
    index = spark.range(20000).selectExpr("if(id < 0, '', 'ACGT') AS kmer", "concat('p', lpad(id, 5, '0')) AS seq_name", "7 AS offset")
    some = spark.range(50).selectExpr("id AS tag", "8 AS at", "if(id < 0, '', 'ACGT') AS kmer")
    df = suffixes.capped_hits(some, index, 3)
    assert sorted((x.tag, x.seq_name) for x in df.collect()) == [(i, f"p{j:05d}") for i in range(50) for j in range(3)]
    assert df._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].count("row_number") > 0  # under the join


def test_regions_longer_than_twelve(spark, data):
    """A piece that occurs more than 20 times at twelve bases grows on; all lengths of a read's pieces are counted, in code and in SQL."""
    rare = "ACGTTGCAAGCTTAGCCATGCATGGATCCTAG"
    ref = spark.createDataFrame([(f"p{i}", "TTTTTTTTTT" + rare[18:]) for i in range(25)] + [("q", rare)], "seq_name string, text string")
    reads = spark.createDataFrame([(1, rare)], "tag long, read string")
    got = sorted(map(tuple, partitions.adaptive_regions(partitions.piece_counts(reads, ref, range(1, 33)), 32, 20, 4).where("stop = 32").collect()))
    assert got == [(1, 17, 32, 1)]
    for name in ("SED_7_adaptive_regions", "SED_10_11_12_13_scheduled_regions"):
        assert "11, 12, 13, 14" in catalog.ORACLES[name]
    assert "tag <= 20" not in catalog.ORACLES["SED_9_maximal_matches"]


def test_maximal_matches_of_all_reads(spark, data):
    assert catalog.QUERIES["SED_9_maximal_matches"](spark, data.replace("sf0.001", "sf0.01")).select("tag").distinct().count() == 100
