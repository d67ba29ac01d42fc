"""Registered queries on joins, intervals, seeds, suffixes, sets and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import alignment as A
from readloom.functions import sequence as Q
from readloom.operators import intervals, pairing, partitions, ranking, records_join, seeds, setops, suffixes
from readloom.plans import views as V
from readloom.plans.catalog import MAP, PAIRS, query, related, simple

KMERS = "idx AS (SELECT seq_name, text, (i - 1)::INT AS off, substr(text, i, {k}) AS kmer FROM (SELECT seq_name, text, unnest(range(1, 130 - {k})) AS i FROM ref))"

# Index and exact regions


@query("IDX_5_SRT_7_suffix_array", "WITH s AS (SELECT seq_name, text, (i - 1)::INT AS \"offset\", substr(text || '$', i) AS suffix, CASE WHEN i = 1 THEN '$' ELSE text[i - 1] END AS bwt FROM (SELECT seq_name, text, unnest(range(1, 129)) AS i FROM ref WHERE length(seq_name) < 4)) SELECT row_number() OVER (ORDER BY suffix, seq_name, \"offset\") - 1 AS rank, seq_name, \"offset\", bwt FROM s", "ref")
def suffix_array(s, d):
    return suffixes.suffix_array(V.ref(s, d).where(F.length("seq_name") < 4))


@query("IDX_6_rank_table", f"WITH {KMERS.format(k=6)}, c AS (SELECT kmer, count(*) AS n FROM idx GROUP BY kmer) SELECT kmer, (sum(n) OVER (ORDER BY kmer) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY kmer))::BIGINT AS hi FROM c", "ref")
def rank_table(s, d):
    return suffixes.rank_table(seeds.kmer_index(V.ref(s, d), 6))


@query("JON_1_4_capped_hits", f"WITH {KMERS.format(k=8)}, h AS (SELECT tag, off, seq_name, row_number() OVER (PARTITION BY tag ORDER BY seq_name, off) AS rn FROM planted_reads JOIN idx ON kmer = substr(read, 9, 8)) SELECT tag, 8 AS at, seq_name, off AS \"offset\" FROM h WHERE rn <= 3", "planted_reads", "ref")
def capped(s, d):
    r = V.planted_reads(s, d).select("tag", F.lit(8).alias("at"), F.substring("read", 9, 8).alias("kmer"))
    return suffixes.capped_hits(r, seeds.kmer_index(V.ref(s, d), 8), 3)


@query("AGG_25_kmer_frequency", f"WITH {KMERS.format(k=4)}, c AS (SELECT kmer, count(*) AS n FROM idx GROUP BY kmer) SELECT r.tag, round(avg(ln(greatest(coalesce(n, 1), 1)) / ln(4)), 6) AS frequency FROM (SELECT tag, substr(read, i, 4) AS kmer FROM (SELECT tag, read, unnest(range(1, 30, 4)) AS i FROM planted_reads)) r LEFT JOIN c USING (kmer) GROUP BY r.tag", "planted_reads", "ref")
def kmer_frequency(s, d):
    counts = seeds.kmer_counts(seeds.kmer_index(V.ref(s, d), 4))
    r = V.planted_reads(s, d).select("tag", F.inline(Q.kmers(F.col("read"), 4, 4)))
    return r.join(counts, "kmer", "left").groupBy("tag").agg(F.round(F.avg(suffixes.frequency(F.coalesce("n", F.lit(1)))), 6).alias("frequency"))


@query("JON_7_8_positions_and_windows", "WITH l AS (SELECT seq_name, (row_number() OVER (ORDER BY seq_name) - 1) * 128 AS begin FROM ref) SELECT tag, begin + tag % 128 AS pos, greatest(begin, begin + tag % 128 - 10) AS least, least(begin + 128, begin + tag % 128 + 42) AS most FROM reads JOIN l ON seq_name = 'p' || (tag % 50 + 1)", "reads", "ref")
def positions(s, d):
    located = seeds.locator(V.ref(s, d))
    at = V.reads(s, d).select("tag", F.concat(F.lit("p"), (F.col("tag") % 50 + 1).cast("string")).alias("seq_name"), (F.col("tag") % 128).alias("offset"))
    return seeds.candidate_windows(seeds.to_position(at, located), 32, 10).select("tag", "pos", "least", "most")


NEAR_REF = f"""WITH {KMERS.format(k=8)}, p AS (SELECT tag, read, unnest([0, 8, 16, 24]) AS o FROM planted_reads),
c AS (SELECT DISTINCT tag, read, seq_name, text FROM p JOIN idx ON kmer = substr(read, o + 1, 8)) """


@query("JON_11_12_levenshtein_search", NEAR_REF + "SELECT tag, seq_name, min(levenshtein(read, substr(text, i, j)))::INT AS distance FROM (SELECT *, unnest(range(1, 129)) AS i FROM c), (SELECT unnest(range(29, 36)) AS j) GROUP BY tag, seq_name HAVING min(levenshtein(read, substr(text, i, j))) <= 3", "planted_reads", "ref")
def levenshtein_search(s, d):
    return seeds.edit_matches(V.planted_reads(s, d), V.ref(s, d), 3, 32).select("tag", "seq_name", "distance")


@query("JON_3_approximate_seeds", f"WITH {KMERS.format(k=8)}, h AS (SELECT tag, seq_name, off AS o, substr(read, 1, 16) AS r, substr(text, off + 1, 16) AS w FROM planted_reads JOIN idx ON kmer = substr(read, 1, 8) UNION SELECT tag, seq_name, off - 8, substr(read, 1, 16), substr(text, off - 7, 16) FROM planted_reads JOIN idx ON kmer = substr(read, 9, 8) WHERE off >= 8) SELECT tag, seq_name, o AS \"offset\", hamming(r, w)::INT AS distance FROM h WHERE length(w) = 16 AND hamming(r, w) <= 1", "planted_reads", "ref")
def approximate_seeds(s, d):
    """A region of degree two: searched with one mismatch."""
    return seeds.hamming_matches(V.planted_reads(s, d).select("tag", F.substring("read", 1, 16).alias("read")), V.ref(s, d), 1, 16)


@query("JON_16_mate_rescue", "SELECT tag, 0 AS distance, (tag * 7 % 90 + 1 + 20)::INT AS begin FROM planted WHERE tag * 7 % 90 + 20 + 16 <= 128", "planted")
def mate_rescue(s, d):
    """The mate lies on the other strand, 20 bases on: it is found in the window around the mapped end."""
    r = V.planted_reads(s, d).select("tag", F.concat(F.lit("p"), F.col("tag").cast("string")).alias("seq_name")).join(V.ref(s, d), "seq_name")
    at = (F.col("tag") * 7 % 90).cast("int")
    r = r.select("tag", "text", at.alias("begin"), Q.reverse_complement(F.substring("text", at + 21, F.lit(16))).alias("mate")).where(F.length("mate") == 16)
    return pairing.rescued(r, "text", "begin", "mate", ahead=60, most=2).select("tag", "distance", "begin")


# Seeds

P_KMERS = "pk AS (SELECT tag, (i - 1)::INT AS o, k, substr(read, i, k) AS kmer FROM (SELECT tag, read, k, unnest(range(1, 34 - k)) AS i FROM planted_reads, (SELECT unnest([{ks}]) AS k))), rk AS (SELECT k, kmer, count(*) AS n FROM (SELECT k, substr(text, i, k) AS kmer FROM (SELECT text, k, unnest(range(1, 130 - k)) AS i FROM ref, (SELECT unnest([{ks}]) AS k))) GROUP BY ALL), pc AS (SELECT tag, o, k, coalesce(n, 0) AS n FROM pk LEFT JOIN rk USING (k, kmer))"


def counts_of(s, d, ks):
    return partitions.piece_counts(V.planted_reads(s, d), V.ref(s, d), list(ks))


@query("SED_5_optimal_fixed_seeds", f"WITH {P_KMERS.format(ks='8')} SELECT a.tag, min(a.n + b.n + c.n)::BIGINT AS total FROM pc a JOIN pc b ON a.tag = b.tag AND b.o >= a.o + 8 JOIN pc c ON c.tag = b.tag AND c.o >= b.o + 8 GROUP BY a.tag", "planted_reads", "ref")
def optimal_fixed(s, d):
    return partitions.optimal_seeds(counts_of(s, d, [8]), 8, 3)


@query("SED_6_optimal_partition", f"WITH {P_KMERS.format(ks='8, 10, 12, 14, 16')} SELECT a.tag, min(a.n + b.n + c.n)::BIGINT AS total FROM pc a JOIN pc b ON a.tag = b.tag AND b.o = a.k JOIN pc c ON c.tag = b.tag AND c.o = b.o + b.k WHERE a.o = 0 AND c.o + c.k = 32 GROUP BY a.tag", "planted_reads", "ref")
def optimal_variable(s, d):
    return partitions.optimal_partition(counts_of(s, d, [8, 10, 12, 14, 16]), 32, 3)


ADAPTIVE = "WITH RECURSIVE " + P_KMERS.format(ks="{ks}") + """, g AS (
    SELECT tag, 32 AS stop, 31 AS o, -1 AS found, 0::BIGINT AS n, 0 AS more, 0 AS closed, 0 AS c_begin, 0 AS c_stop, 0::BIGINT AS c_n FROM planted_reads
    UNION ALL
    SELECT g.tag, CASE WHEN close THEN found ELSE stop END, CASE WHEN close THEN o ELSE o - 1 END,
        CASE WHEN close THEN -1 WHEN take THEN o ELSE found END, CASE WHEN close THEN 0 WHEN take THEN here ELSE n END, CASE WHEN close THEN 0 WHEN take AND found >= 0 THEN more + 1 ELSE more END,
        CASE WHEN close THEN 1 ELSE 0 END, found, stop, n
    FROM (SELECT g.*, coalesce(pc.n, 1099511627776) AS here, found < 0 AND coalesce(pc.n, 1099511627776) <= {th} OR found >= 0 AND more < {steps} AND coalesce(pc.n, 1099511627776) < g.n {short} AS take,
            found >= 0 AND NOT (more < {steps} AND coalesce(pc.n, 1099511627776) < g.n {short}) AS close
        FROM g LEFT JOIN pc ON pc.tag = g.tag AND pc.o = g.o AND pc.k = g.stop - g.o WHERE g.o >= 0) g)
"""
ALL_K, SHORT_K = (", ".join(map(str, range(1, n))) for n in (33, 13))
DONE = "SELECT tag, c_begin AS begin, c_stop AS stop, c_n AS n FROM g WHERE closed = 1 UNION ALL SELECT tag, found, stop, n FROM g WHERE o = -1 AND found >= 0"


@query("SED_7_adaptive_regions", ADAPTIVE.format(ks=ALL_K, th=20, steps=4, short="") + DONE, "planted_reads", "ref")
def adaptive(s, d):
    return partitions.adaptive_regions(counts_of(s, d, range(1, 33)), 32, 20, 4)


@query("SED_8_adaptive_limited", ADAPTIVE.format(ks=SHORT_K, th=20, steps=4, short="AND g.stop - g.o <= 8") + DONE, "planted_reads", "ref")
def adaptive_limited(s, d):
    return partitions.adaptive_regions(counts_of(s, d, range(1, 13)), 32, 20, 4, most=8)


@query("SED_10_11_12_13_scheduled_regions", ADAPTIVE.format(ks=ALL_K, th=20, steps=4, short="") + f", r AS ({DONE}), o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n, begin) AS rn, count(*) OVER (PARTITION BY tag) AS c, lag(stop) OVER (PARTITION BY tag ORDER BY begin) AS before, lead(begin) OVER (PARTITION BY tag ORDER BY begin) AS next FROM r), e AS (SELECT *, 4 // c + CASE WHEN rn <= 4 % c THEN 1 ELSE 0 END AS deg FROM o) SELECT tag, coalesce(before, 0)::INT AS begin, CASE WHEN next IS NULL THEN 32 ELSE stop END::INT AS stop, CASE WHEN n > 10 THEN least(deg, 1) ELSE deg END::INT AS degree, (sum(CASE WHEN n > 10 THEN least(deg, 1) ELSE deg END) OVER (PARTITION BY tag))::INT AS mcs FROM e", "planted_reads", "ref")
def scheduled(s, d):
    """Regions are scheduled for three errors, then stretched over the gaps between them."""
    r = partitions.scheduled(partitions.adaptive_regions(counts_of(s, d, range(1, 33)), 32, 20, 4), 3, 10)
    mcs = partitions.complete_strata(r)
    w = W.partitionBy("tag").orderBy("begin")
    whole = partitions.filled(r, 32).select("tag", F.col("begin").alias("from"), F.col("stop").alias("to"), "n")
    whole = whole.withColumn("i", F.row_number().over(W.partitionBy("tag").orderBy("from")))
    r = r.withColumn("i", F.row_number().over(w)).select("tag", "i", "degree")
    return whole.join(r, ["tag", "i"]).join(mcs, "tag").select("tag", F.col("from").alias("begin"), F.col("to").alias("stop"), "degree", "mcs")


@query("SED_9_maximal_matches", f"WITH {P_KMERS.format(ks=', '.join(map(str, range(4, 33))))}, m AS (SELECT tag, min(o) AS begin, o + k AS stop FROM pc WHERE n > 0 GROUP BY tag, o + k) SELECT tag, begin::INT AS begin, stop::INT AS stop, NOT EXISTS (SELECT 1 FROM m b WHERE a.tag = b.tag AND b.begin <= a.begin AND b.stop >= a.stop AND (b.begin, b.stop) <> (a.begin, a.stop)) AS super FROM m a", "planted_reads", "ref")
def maximal(s, d):
    m = partitions.maximal_matches(counts_of(s, d, range(4, 33)))
    top = partitions.super_maximal(m).withColumn("super", F.lit(True))
    return m.join(top, ["tag", "begin", "stop"], "left").select("tag", "begin", "stop", F.coalesce("super", F.lit(False)).alias("super"))


@query("SED_1_strategies", "SELECT kind, tag, n FROM (SELECT tag, unnest(['fixed', 'factor', 'cheapest']) AS kind, unnest([4, 3, 2])::BIGINT AS n FROM planted_reads)", "planted_reads")
def strategies(s, d):
    r, out = V.planted_reads(s, d), None
    counts = seeds.kmer_counts(seeds.kmer_index(V.ref(s, d), 8))
    for kind, how in (("fixed", {"k": 8}), ("factor", {"n": 3}), ("cheapest", {"k": 8, "n": 2})):
        rows = seeds.select_seeds(r, kind, counts=counts, **how).groupBy("tag").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "tag", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


simple("AGG_27_region_status", V.maps, lambda m: m.select(F.when(F.col("event_distance") <= 2, "verified").when(F.col("phred") < 10, "pending").otherwise("discarded").alias("status")).groupBy("status").agg(F.count("*").alias("n")),
       "SELECT CASE WHEN event_distance <= 2 THEN 'verified' WHEN phred < 10 THEN 'pending' ELSE 'discarded' END AS status, count(*) AS n FROM maps GROUP BY 1", "maps")


@query("SRT_6_12_region_orders", "SELECT * FROM (SELECT tag, position, length, phred, score, row_number() OVER (PARTITION BY tag ORDER BY length, position, phred, score) AS by_candidates, row_number() OVER (PARTITION BY tag ORDER BY position, length, phred, score) AS by_place, row_number() OVER (PARTITION BY tag ORDER BY event_distance, phred DESC, position, length, score) AS by_distance FROM maps) WHERE by_candidates <= 3", "maps")
def region_orders(s, d):
    n = lambda *k: F.row_number().over(W.partitionBy("tag").orderBy(*k))
    return V.maps(s, d).select("tag", "position", "length", "phred", "score", n("length", "position", "phred", "score").alias("by_candidates"), n("position", "length", "phred", "score").alias("by_place"), n("event_distance", F.desc("phred"), "position", "length", "score").alias("by_distance")).where("by_candidates <= 3")


simple("SRT_4_genomic_order", V.maps, lambda m: m.groupBy("seq_name", "position").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(W.partitionBy("seq_name").orderBy("position"))),
       "SELECT seq_name, position, n, row_number() OVER (PARTITION BY seq_name ORDER BY position) AS place FROM (SELECT seq_name, position, count(*) AS n FROM maps GROUP BY ALL)", "maps")
simple("SRT_10_printable_maps", V.maps, lambda m: ranking.top_k(m, 4).groupBy("tag").agg(F.count("*").alias("printed"), F.max("event_distance").alias("worst")),
       "SELECT tag, count(*) AS printed, max(event_distance) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY event_distance, phred DESC) AS rn FROM maps) WHERE rn <= 4 GROUP BY tag", "maps")

# Intervals and blocks

BLOCKS = "WITH x AS (SELECT seq_name || tag % 40 AS seq_name, position AS begin, position + length AS stop FROM maps WHERE phred <= 3), y AS (SELECT seq_name || tag % 40 AS seq_name, position AS begin, position + length AS stop FROM maps WHERE phred = 4), px AS (SELECT DISTINCT seq_name, unnest(range(begin, stop)) AS p FROM x), py AS (SELECT DISTINCT seq_name, unnest(range(begin, stop)) AS p FROM y), "
ISLANDS = "SELECT seq_name, min(p) AS begin, max(p) + 1 AS stop FROM (SELECT seq_name, p, p - row_number() OVER (PARTITION BY seq_name ORDER BY p) AS g FROM q) GROUP BY seq_name, g"


def blocks(s, d, low, high):
    m = V.maps(s, d).where(F.col("phred").between(low, high))
    return m.select(F.concat("seq_name", (F.col("tag") % 40).cast("string")).alias("seq_name"), F.col("position").alias("begin"), (F.col("position") + F.col("length")).alias("stop"))


for _how, _points in (("subtract", "SELECT * FROM px EXCEPT SELECT * FROM py"), ("union", "SELECT * FROM px UNION SELECT * FROM py"), ("intersect", "SELECT * FROM px INTERSECT SELECT * FROM py")):
    query(f"JON_28_interval_{_how}", BLOCKS + f"q AS ({_points}) " + ISLANDS, "maps")(lambda s, d, how=_how: intervals.combined(blocks(s, d, 0, 3), blocks(s, d, 4, 4), how))


@query("JON_29_block_overlap", "SELECT tag, a.position AS p1, b.position AS p2, a.length AS l1, b.length AS l2, a.phred AS q1, b.phred AS q2, greatest(0, least(a.position + a.length, b.position + b.length) - greatest(a.position, b.position)) AS shared FROM end1 a JOIN end2 b USING (tag, seq_name)", "end1", "end2")
def block_overlap(s, d):
    p = pairing.candidate_pairs(V.end1(s, d), V.end2(s, d))
    return p.select("tag", F.col("position1").alias("p1"), F.col("position2").alias("p2"), F.col("length1").alias("l1"), F.col("length2").alias("l2"), F.col("phred1").alias("q1"), F.col("phred2").alias("q2"), intervals.overlap(F.col("position1"), F.col("position1") + F.col("length1"), F.col("position2"), F.col("position2") + F.col("length2")).alias("shared"))


# Joins of records


def read_file(s, d, shift):
    return V.reads(s, d).select(F.col("tag").alias("line"), F.concat(F.lit("t"), (F.col("tag") + shift).cast("string")).alias("tag"), "read")


@query("SRC_6_interleaved_pairs", "SELECT 't' || (a.tag - 2) AS tag1, 't' || (b.tag - 2) AS tag2, a.read AS read1, b.read AS read2 FROM reads a JOIN reads b ON b.tag = a.tag + 1 WHERE a.tag % 2 = 0 AND a.tag >= 2", "reads")
def interleaved(s, d):
    n = V.reads(s, d).count()
    lines = read_file(s, d, -2).where(F.col("line").between(2, n // 2 * 2 - 1 if n % 2 else n - 1)).withColumn("line", F.col("line") - 2)
    return records_join.interleaved(lines)


@query("SRC_7_JON_20_lockstep", "SELECT tag - 1 AS line, 't' || tag AS tag1, 't' || (tag + 5) AS tag2, read AS read1, read AS read2 FROM reads", "reads")
def lockstep(s, d):
    a, b = (read_file(s, d, k).withColumn("line", F.col("line") - 1) for k in (0, 5))
    return records_join.lockstep(a, b)


@query("JON_18_21_common_reads", "SELECT tag, count(*) AS n FROM maps_b GROUP BY tag", "maps_b")
def common(s, d):
    """Every read of the master must be in the slave; the slave's others are passed over."""
    master = V.maps_b(s, d).groupBy("tag").agg(F.count("*").alias("n"))
    return records_join.common(master, V.templates(s, d), "tag").select("tag", "n")


@query("SRC_19_pending_mates", "SELECT a.tag, a.seq_name AS rname, a.position AS pos, b.position AS pnext FROM (SELECT DISTINCT tag, seq_name, position FROM end1) a JOIN (SELECT DISTINCT tag, seq_name, position FROM end2) b USING (tag, seq_name)", "end1", "end2")
def pending_mates(s, d):
    """SAM rows of both ends name the place of their mate; they are joined by it whatever their order."""
    e1, e2 = (v(s, d).select("tag", "seq_name", "position").distinct() for v in (V.end1, V.end2))
    both = e1.withColumnRenamed("position", "pos").join(e2.withColumnRenamed("position", "pnext"), ["tag", "seq_name"])
    side = lambda first: both.select("tag", F.lit(64 if first else 128).alias("flag"), F.col("seq_name").alias("rname"), F.col("pos" if first else "pnext").alias("pos"), F.col("pnext" if first else "pos").alias("pnext"))
    return records_join.pending_mates(side(True).unionByName(side(False))).select("tag", "rname", "pos", "pnext")


@query("JON_22_containment", f"SELECT {MAP} FROM maps a WHERE EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND (abs(a.position - b.position) <= 1 OR abs(a.position + a.length - b.position - b.length) <= 1))", "maps", "maps_b")
def containment(s, d):
    return setops.intersection(V.maps(s, d), V.maps_b(s, d), setops.tolerant(1))


@query("JON_25_mates_in_any_order", PAIRS + "SELECT count(*) AS pairs, count(*) AS met FROM (SELECT DISTINCT tag, seq_name, strand1, position1, length1, strand2, position2, length2 FROM rel)", "end1", "end2")
def any_order(s, d):
    key = ["tag", "seq_name", *(f"{c}{i}" for i in (1, 2) for c in ("strand", "position", "length"))]
    p = related(s, d).select(*key).distinct()
    swapped = p.select("tag", "seq_name", *[F.col(f"{c}{3 - i}").alias(f"{c}{i}") for i in (1, 2) for c in ("strand", "position", "length")])
    return setops.in_any_order(p, swapped).agg(F.count("*").alias("pairs"), F.count_if("met").alias("met"))


@query("JON_26_subdominant_truth", "SELECT tag, event_distance AS distance, best FROM (SELECT *, min(event_distance) OVER (PARTITION BY tag) AS best, count(*) OVER (PARTITION BY tag) AS n FROM maps) WHERE n > 1 AND phred = 17 AND event_distance > best", "maps")
def subdominant(s, d):
    """Reads of several maps whose true one (here: of quality 17) is not among the nearest."""
    return ranking.subdominant_truth(V.maps(s, d), F.col("phred") == 17).select("tag", F.col("event_distance").alias("distance"), "best")


# Sets of more than two files

MERGED = "SELECT tag, seq_name, strand, position, length, min(event_distance) AS event_distance, count(*) AS files FROM (SELECT DISTINCT 0 AS f, tag, seq_name, strand, position, length, event_distance FROM maps UNION SELECT 1, tag, seq_name, strand, position, length, event_distance FROM maps_b UNION SELECT 2, tag, seq_name, strand, position, length, event_distance FROM end1) "


@query("SET_5_9_merge_files", "WITH f AS (SELECT 0 AS f, * FROM maps UNION ALL SELECT 1, * FROM maps_b UNION ALL SELECT 2, * FROM end1) SELECT tag, seq_name, strand, position, length, min(event_distance) AS event_distance, count(DISTINCT f) AS files, min(CASE f WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 5 END) AS mcs FROM f GROUP BY tag, seq_name, strand, position, length", "maps", "maps_b", "end1")
def merge_files(s, d):
    return setops.merged([(V.maps(s, d), 4), (V.maps_b(s, d), 3), (V.end1(s, d), 5)])


@query("SET_6_merge_subset", "WITH f AS (SELECT * FROM maps UNION ALL SELECT * FROM maps_b) SELECT tag, count(*) AS n FROM (SELECT DISTINCT tag, seq_name, strand, position, length FROM f) GROUP BY tag", "maps", "maps_b")
def merge_subset(s, d):
    """Reads that the second file lacks pass through."""
    m = setops.merged([(V.maps(s, d), 4), (V.maps_b(s, d), 3)])
    return m.groupBy("tag").agg(F.count("*").alias("n"))


@query("SET_11_operations_by_name", "SELECT 'union' AS op, (SELECT count(*) FROM (SELECT DISTINCT tag, seq_name, strand, position, length FROM (SELECT * FROM maps UNION ALL SELECT * FROM maps_b))) AS n UNION ALL SELECT 'I', (SELECT count(*) FROM maps a WHERE EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length)) UNION ALL SELECT 'D', (SELECT count(*) FROM maps a WHERE NOT EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length))", "maps", "maps_b")
def by_name(s, d):
    out = None
    for op in ("union", "I", "D"):
        n = setops.operation(op)(V.maps(s, d), V.maps_b(s, d)).agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("JON_23_strict_comparator", "SELECT tag, count(*) AS met FROM maps a WHERE EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length) GROUP BY tag", "maps", "maps_b")
def strict_comparator(s, d):
    return setops.intersection(V.maps(s, d), V.maps_b(s, d), setops.strict).groupBy("tag").agg(F.count("*").alias("met"))


@query("UDF_1_injected_comparator", f"SELECT {MAP} FROM maps_b a WHERE EXISTS (SELECT 1 FROM maps b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND abs(a.event_distance - b.event_distance) <= 1 AND a.phred = b.phred)", "maps", "maps_b")
def injected(s, d):
    def near(a, b):
        same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("tag", "seq_name", "phred")]
        return same[0] & same[1] & same[2] & (F.abs(F.col(f"{a}.event_distance") - F.col(f"{b}.event_distance")) <= 1)

    return setops.intersection(V.maps_b(s, d), V.maps(s, d), near)


@query("MTH_9_10_verified_by_kind", "SELECT a.tag, hamming(a.read, b.read)::INT AS hamming, levenshtein(a.read, b.read)::INT AS edit FROM reads a JOIN reads b ON b.tag = a.tag + 1", "reads")
def by_kind(s, d):
    r = V.reads(s, d)
    j = r.alias("a").join(r.select((F.col("tag") - 1).alias("tag"), F.col("read").alias("other")), "tag")
    return j.select("tag", Q.hamming(F.col("read"), F.col("other")).alias("hamming"), (-A.edit_alignment(F.col("read"), F.col("other"), "global")["score"]).alias("edit"))
