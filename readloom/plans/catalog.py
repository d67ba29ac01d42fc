"""Registered queries: one or more for each operator family, named by the inventory, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import edits as E
from readloom.functions import pairs as P
from readloom.functions import sequence as S
from readloom.operators import pairing, ranking, seeds, setops, stats
from readloom.plans import views as V
from readloom.sources import records as R
from readloom.streaming.template_length import windowed_template_size

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "AGG_16_class_of_best"
MAP = "tag, seq_name, strand, position, event_distance, phred, length, score"
RANK = "event_distance, phred DESC, seq_name, position, strand, length, score"


def query(name: str, sql: str, *views: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, V.sql(sql, *views)
        return f

    return add


def simple(name: str, view, make: Callable[[DataFrame], DataFrame], sql: str, *views: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return make(view(spark, d))

    run.__name__ = name
    query(name, sql, *views)(run)


# Filters

@query("FLT_2_mapped", "SELECT tag FROM templates WHERE tag IN (SELECT tag FROM maps)", "templates", "maps")
def mapped(s, d):
    return V.templates(s, d).join(V.maps(s, d), "tag", "left_semi")


@query("FLT_2_unmapped", "SELECT tag FROM templates WHERE tag NOT IN (SELECT tag FROM maps)", "templates", "maps")
def unmapped(s, d):
    return V.templates(s, d).join(V.maps(s, d), "tag", "left_anti")


simple("FLT_3_threshold_mapped", V.maps, lambda m: m.groupBy("tag").agg(F.min("event_distance").alias("best")).where("best <= 2"),
       "SELECT tag, min(event_distance) AS best FROM maps GROUP BY tag HAVING min(event_distance) <= 2", "maps")
simple("FLT_4_unique_level", V.maps, lambda m: ranking.two_best(m).where("min2 is null or min2 - min1 >= 2").select("tag", "min1"),
       "SELECT tag, min1 FROM (SELECT tag, list_sort(list(event_distance)) AS l, l[1] AS min1, l[2] AS min2 FROM maps GROUP BY tag) WHERE min2 IS NULL OR min2 - min1 >= 2", "maps")
simple("FLT_5_read_length", V.reads, lambda r: r.where(F.length(S.run_length(F.col("read"))).between(20, 25)).select("tag"),
       r"SELECT tag FROM reads WHERE length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(read, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')) BETWEEN 20 AND 25", "reads")
simple("FLT_6_number_of_maps", V.maps, lambda m: m.groupBy("tag").agg(F.count("*").alias("n")).where("n between 2 and 4"),
       "SELECT tag, count(*) AS n FROM maps GROUP BY tag HAVING count(*) BETWEEN 2 AND 4", "maps")
simple("FLT_7_allow_list", V.maps, lambda m: m.where(F.col("seq_name").isin("A", "R")), f"SELECT {MAP} FROM maps WHERE seq_name IN ('A', 'R')", "maps")
simple("FLT_8_quality_ranges", V.maps, lambda m: m.where(F.col("phred").between(1, 9) | F.col("phred").between(40, 45)),
       f"SELECT {MAP} FROM maps WHERE phred BETWEEN 1 AND 9 OR phred BETWEEN 40 AND 45", "maps")
simple("FLT_9_map_filter", V.maps, lambda m: ranking.strata_after_best(m, 1).where("strand = '+' and phred >= 10 and event_distance between 1 and 4"),
       f"SELECT {MAP} FROM (SELECT *, min(event_distance) OVER (PARTITION BY tag) AS best FROM maps) WHERE event_distance - best <= 1 AND strand = '+' AND phred >= 10 AND event_distance BETWEEN 1 AND 4", "maps")
simple("FLT_12_strata_after_best", V.maps, lambda m: ranking.strata_after_best(m, 2),
       f"SELECT {MAP} FROM (SELECT *, min(event_distance) OVER (PARTITION BY tag) AS best FROM maps) WHERE event_distance - best <= 2", "maps")
simple("FLT_14_viable_pattern", V.reads, lambda r: r.where((F.length("read") > 0) & F.col("read").rlike("[ACGT]")).select("tag"),
       "SELECT tag FROM reads WHERE regexp_matches(read, '[ACGT]')", "reads")
simple("FLT_15_global_or_local", V.maps, lambda m: m.select("tag", "position", "length", "phred", F.when((F.col("length") - F.col("event_distance") < 0.2 * F.col("length")) | (F.col("phred") < 5), "local").otherwise("regular").alias("kind")),
       "SELECT tag, position, length, phred, CASE WHEN length - event_distance < 0.2 * length OR phred < 5 THEN 'local' ELSE 'regular' END AS kind FROM maps", "maps")
simple("FLT_19_select_strata", V.maps, lambda m: ranking.strata_after_best(m, 0), f"SELECT {MAP} FROM (SELECT *, min(event_distance) OVER (PARTITION BY tag) AS best FROM maps) WHERE event_distance = best", "maps")

# Sequences

simple("STR_1_2_3_complements", V.reads, lambda r: r.select("tag", S.complement(F.col("read")).alias("c"), S.reverse_complement(F.col("read")).alias("rc"), F.reverse("qualities").alias("rq")),
       "SELECT tag, translate(read, 'ACGT', 'TGCA') AS c, reverse(translate(read, 'ACGT', 'TGCA')) AS rc, reverse(qualities) AS rq FROM reads", "reads")
simple("STR_4_is_dna", V.reads, lambda r: r.select("tag", S.is_dna(F.col("read")).alias("dna"), S.is_dna(F.col("qualities")).alias("hex")),
       "SELECT tag, regexp_full_match(read, '[ACGTNacgtn]+') AS dna, regexp_full_match(qualities, '[ACGTNacgtn]+') AS hex FROM reads", "reads")
simple("STR_5_uniform_content", V.reads, lambda r: r.select("tag", S.uniform_content(F.col("qualities")).alias("u")),
       "SELECT tag, regexp_replace(regexp_replace(regexp_replace(upper(qualities), '[^ACGT]', 'N', 'g'), '^N+', ''), 'N+$', '') AS u FROM reads", "reads")
simple("STR_6_7_8_trim_restore", V.reads, lambda r: r.withColumn("t", S.hard_trim(F.col("read"), 3, 5, 10)).withColumn("lt", S.trim_tag(F.col("read"), F.col("qualities"), 3)).select("tag", "t", "lt", S.restore_trim(F.col("t"), F.col("lt")).alias("back")),
       "SELECT tag, substr(read, 4, 24) AS t, '3:' || substr(read, 1, 3) || ':' || substr(qualities, 1, 3) AS lt, substr(read, 1, 27) AS back FROM reads", "reads")
simple("STR_10_shift_qualities", V.reads, lambda r: r.select("tag", S.shift_qualities(F.col("qualities"), 1).alias("q")),
       "SELECT tag, translate(qualities, '0123456789abcdef', '123456789:bcdefg') AS q FROM reads", "reads")
simple("STR_11_13_quality_values", V.reads, lambda r: r.withColumn("v", S.quality_values(F.col("qualities"))).select("tag", F.array_min("v").alias("least"), F.array_max("v").alias("most"), F.expr("aggregate(v, 0, (s, x) -> s + x) div size(v)").alias("mean"), S.quality_offset(F.array_min("v") + 33).alias("base")),
       "SELECT tag, list_min(v) AS least, list_max(v) AS most, list_sum(v)::BIGINT // 32 AS mean, CASE WHEN list_min(v) + 33 < 59 THEN 33 ELSE 64 END AS base FROM (SELECT tag, list_transform(string_split(qualities, ''), lambda c: ascii(c) - 33) AS v FROM reads)", "reads")
simple("STR_12_fill_qualities", V.reads, lambda r: r.select("tag", F.repeat(F.lit("~"), F.length("read")).alias("q")), "SELECT tag, repeat('~', 32) AS q FROM reads", "reads")
simple("STR_16_17_bisulfite", V.reads, lambda r: r.select("tag", S.bisulfite(F.col("read")).alias("c2t"), S.bisulfite(F.col("read"), "G2A").alias("g2a"), (S.count_base(F.col("read"), "C") > S.count_base(F.col("read"), "G")).alias("more_c")),
       "SELECT tag, replace(read, 'C', 'T') AS c2t, replace(read, 'G', 'A') AS g2a, length(replace(read, 'C', '')) < length(replace(read, 'G', '')) AS more_c FROM reads", "reads")
simple("STR_18_chunks", V.reads, lambda r: r.select("tag", F.inline(S.chunks(F.col("read"), 12, 10))),
       "SELECT tag, (i / 10)::INT AS segment, substr(read, i + 1, 12) AS text FROM (SELECT tag, read, unnest([0, 10, 20])::INT AS i FROM reads)", "reads")


@query("STR_19_substring_by_location", "SELECT tag, 'p' || (tag % 50 + 1) AS seq_name, CASE WHEN tag % 2 = 0 THEN substr(text, (tag % 100 + 1)::INT, 20) ELSE reverse(translate(substr(text, (tag % 100 + 1)::INT, 20), 'ACGT', 'TGCA')) END AS piece FROM reads JOIN ref ON ref.seq_name = 'p' || (tag % 50 + 1)", "reads", "ref")
def retrieve(s, d):
    at = V.reads(s, d).select("tag", F.concat(F.lit("p"), (F.col("tag") % 50 + 1).cast("string")).alias("seq_name"))
    piece = F.substring("text", (F.col("tag") % 100 + 1).cast("int"), F.lit(20))
    return at.join(V.ref(s, d), "seq_name").select("tag", "seq_name", F.when(F.col("tag") % 2 == 0, piece).otherwise(S.reverse_complement(piece)).alias("piece"))


simple("STR_22_location_query", V.maps, lambda m: m.select("tag", F.concat_ws(":", "seq_name", "strand", "position", "length").alias("raw")).select("tag", F.split_part("raw", F.lit(":"), F.lit(1)).alias("seq"), F.split_part("raw", F.lit(":"), F.lit(2)).alias("strand"), F.split_part("raw", F.lit(":"), F.lit(3)).cast("bigint").alias("pos"), F.split_part("raw", F.lit(":"), F.lit(4)).cast("bigint").alias("len")),
       "SELECT tag, seq_name AS seq, strand, position AS pos, length AS len FROM maps", "maps")

# Edit scripts, scores, geometry


def script(m: DataFrame) -> DataFrame:
    text = F.concat(F.col("position").cast("string"), F.lit("A"), F.col("length").cast("string"), F.lit(">"), F.col("event_distance").cast("string"), F.lit("-"), F.lit("4C>2+"), F.col("phred").cast("string"))
    return m.withColumn("x", E.parse_mismatches(text))


simple("SRC_12_mismatch_string", V.maps, lambda m: script(m).select("tag", "position", "length", "phred", F.size("x").alias("n"), F.get("x", F.lit(0))["len"].alias("first"), F.get("x", F.lit(3))["op"].alias("fourth")),
       "SELECT tag, position, length, phred, 8 - 0 AS n, position::INT AS first, 'D' AS fourth FROM maps", "maps")
simple("MTH_1_2_4_distances", V.maps, lambda m: script(m).select("tag", "position", "length", "phred", E.event_distance(F.col("x")).alias("events"), E.edit_distance(F.col("x")).alias("edits"), E.edit_distance_inner(F.col("x")).alias("inner"), E.matching_bases(F.col("x")).alias("matches")),
       "SELECT tag, position, length, phred, 4 AS events, 4 + event_distance AS edits, 4 + event_distance AS inner, (position + length + 4 + phred)::INT AS matches FROM maps", "maps")
simple("MTH_5_lengths", V.maps, lambda m: script(m).select("tag", "position", "length", "phred", E.read_length(F.col("x")).alias("read_len"), E.reference_length(F.col("x")).alias("ref_len")),
       "SELECT tag, position, length, phred, (position + length + phred + 8)::INT AS read_len, (position + length + phred + 6 + event_distance)::INT AS ref_len FROM maps", "maps")
simple("MTH_6_affine_score", V.maps, lambda m: script(m).select("tag", "position", "length", "phred", E.affine_score(F.col("x")).alias("swg")),
       "SELECT tag, position, length, phred, (position + length + 4 + phred - 8 - (event_distance + 6) - 8)::INT AS swg FROM maps", "maps")
simple("MTH_8_score_bounds", V.maps, lambda m: m.select("tag", "position", "phred", *[c.alias(n) for c, n in zip(E.score_bounds(F.col("length"), F.col("event_distance")), ("least", "most"), strict=True)]),
       "SELECT tag, position, phred, length - event_distance * 8 AS least, greatest(length - event_distance * 5, length - 6 - event_distance) AS most FROM maps", "maps")


@query("MTH_9_hamming", "SELECT a.tag, hamming(a.read, b.read) AS distance FROM reads a JOIN reads b ON b.tag = a.tag + 1", "reads")
def hamming(s, d):
    r = V.reads(s, d)
    return r.alias("a").join(r.select((F.col("tag") - 1).alias("tag"), F.col("read").alias("other")), "tag").select("tag", S.hamming(F.col("read"), F.col("other")).alias("distance"))


@query("MTH_10_11_levenshtein", "SELECT a.tag, levenshtein(a.read, b.read) AS distance, CASE WHEN levenshtein(a.read, b.read) <= 18 THEN levenshtein(a.read, b.read) ELSE -1 END AS cut FROM reads a JOIN reads b ON b.tag = a.tag + 1", "reads")
def levenshtein(s, d):
    r = V.reads(s, d)
    return r.alias("a").join(r.select((F.col("tag") - 1).alias("tag"), F.col("read").alias("other")), "tag").select("tag", F.levenshtein("read", "other").alias("distance"), F.levenshtein("read", "other", 18).alias("cut"))


simple("MTH_33_34_mapq", V.maps, lambda m: ranking.two_best(m).select("tag", F.when(F.col("min2") == F.col("min1"), 0).when(F.col("min2") - F.col("min1") > 3, 60).otherwise(P.logistic_mapq((F.col("max1") - F.coalesce("max2", F.lit(0))) / 10.0 - 1)).alias("mapq")),
       "SELECT tag, CASE WHEN d[2] = d[1] THEN 0 WHEN d[2] - d[1] > 3 THEN 60 ELSE greatest(1, least(59, floor(-10 * log10(1 / (1 + exp((p[1] - coalesce(p[2], 0)) / 10.0 - 1))))::INT)) END AS mapq"
       " FROM (SELECT tag, list_sort(list(event_distance)) AS d, list_reverse_sort(list(phred)) AS p FROM maps GROUP BY tag)", "maps")
simple("MTH_37_sam_flag", V.maps, lambda m: ranking.ranked(m).select("tag", "position", "length", "phred", "score", P.sam_flag(F.col("seq_name") != "N", F.lit(True), F.col("strand") == "-", F.col("event_distance") != 4, F.col("seq_name") == "A", F.col("phred") > 25, F.col("event_distance") % 2 == 1, F.col("rank") > 1).alias("flag")),
       f"SELECT tag, position, length, phred, score, (CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN rn > 1 THEN 256 ELSE 0 END + CASE WHEN seq_name <> 'N' THEN 1 + CASE WHEN phred > 25 THEN 2 ELSE 0 END + CASE WHEN event_distance = 4 THEN 8 ELSE 0 END + CASE WHEN event_distance <> 4 AND seq_name = 'A' THEN 32 ELSE 0 END + CASE WHEN event_distance % 2 = 1 THEN 64 ELSE 128 END ELSE 0 END)::INT AS flag FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY {RANK}) AS rn FROM maps)", "maps")
simple("MTH_38_sam_cigar", V.maps, lambda m: script(m).select("tag", "position", "length", "phred", E.render_sam_cigar(F.col("x")).alias("cigar")),
       "SELECT tag, position, length, phred, (position + 1 + length)::VARCHAR || 'M' || event_distance || 'D5M2I' || phred || 'M' AS cigar FROM maps", "maps")
simple("MTH_41_buckets", V.maps, lambda m: m.groupBy("tag").agg(F.count("*").alias("n")).select("tag", P.bucket(F.col("n"), P.BUCKETS["mmap"]).alias("bucket")),
       "SELECT tag, CASE WHEN count(*) <= 0 THEN 0 WHEN count(*) <= 1 THEN 1 WHEN count(*) <= 5 THEN 2 WHEN count(*) <= 10 THEN 3 WHEN count(*) <= 50 THEN 4 ELSE 5 END AS bucket FROM maps GROUP BY tag", "maps")

# Pairs

PAIRS = """WITH pairs AS (
    SELECT a.tag, a.seq_name, a.strand AS strand1, a.position AS position1, a.length AS length1, a.event_distance AS event_distance1, a.phred AS phred1,
        b.strand AS strand2, b.position AS position2, b.length AS length2, b.event_distance AS event_distance2, b.phred AS phred2,
        CASE WHEN a.position <= b.position THEN translate(a.strand || b.strand, '+-', 'FR') ELSE translate(b.strand || a.strand, '+-', 'FR') END AS orientation,
        CASE WHEN a.position + a.length <= b.position OR b.position + b.length <= a.position THEN 'separate'
            WHEN (a.position <= b.position AND b.position + b.length <= a.position + a.length) OR (b.position <= a.position AND a.position + a.length <= b.position + b.length) THEN 'contain' ELSE 'overlap' END AS layout,
        greatest(a.position + a.length, b.position + b.length) - least(a.position, b.position) AS template_length,
        a.event_distance + b.event_distance AS distance
    FROM end1 a JOIN end2 b USING (tag, seq_name)),
rel AS (SELECT *, CASE WHEN orientation IN ('FR', 'RF', 'FF', 'RR') AND template_length BETWEEN 0 AND 800 THEN 'concordant' ELSE 'discordant' END AS relation FROM pairs) """
PAIR = "tag, seq_name, strand1, position1, length1, event_distance1, phred1, strand2, position2, length2, event_distance2, phred2, orientation, layout, template_length, distance, relation"


def related(s, d) -> DataFrame:
    return pairing.with_relation(pairing.candidate_pairs(V.end1(s, d), V.end2(s, d)), 0, 800, ("FR", "RF", "FF", "RR"))


@query("JON_14_MTH_29_30_pairs", PAIRS + f"SELECT {PAIR} FROM rel", "end1", "end2")
def pairs(s, d):
    return related(s, d)


@query("JON_15_discordant_fallback", PAIRS + f"SELECT {PAIR} FROM rel WHERE relation = 'concordant' OR tag NOT IN (SELECT tag FROM rel WHERE relation = 'concordant')", "end1", "end2")
def fallback(s, d):
    return pairing.discordant_fallback(related(s, d))


@query("WIN_2_3_best_pair", PAIRS + "SELECT tag, relation, distance, template_length FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY relation <> 'concordant', distance, template_length, seq_name, position1, position2, strand1, strand2, length1, length2, event_distance1, phred1, phred2) AS rn FROM rel) WHERE rn = 1", "end1", "end2")
def best_pair(s, d):
    return pairing.ranked_pairs(related(s, d)).where("rank = 1").select("tag", "relation", "distance", "template_length")


@query("STM_1_template_size", PAIRS + "SELECT count(*) AS n, round(avg(len), 6) AS mean, round(stddev_samp(len), 6) AS sd, greatest(0.0, round(avg(len) - 6 * stddev_samp(len), 4)) AS least, round(avg(len) + 6 * stddev_samp(len), 4) AS most FROM (SELECT tag, count(*) AS n, min(template_length) AS len FROM rel WHERE relation = 'concordant' GROUP BY tag HAVING count(*) = 1)", "end1", "end2")
def size_estimate(s, d):
    return pairing.template_size(related(s, d))


@query("JON_27_ends_in_pairs", PAIRS + "SELECT 1 AS side, tag, seq_name, strand, position, length, phred FROM end1 a WHERE EXISTS (SELECT 1 FROM end2 b WHERE a.tag = b.tag AND a.seq_name = b.seq_name) UNION ALL SELECT 2, tag, seq_name, strand, position, length, phred FROM end2 a WHERE EXISTS (SELECT 1 FROM end1 b WHERE a.tag = b.tag AND a.seq_name = b.seq_name)", "end1", "end2")
def pe_to_se(s, d):
    p = pairing.candidate_pairs(V.end1(s, d), V.end2(s, d))
    cols = ("tag", "seq_name", "strand", "position", "length", "phred")
    return pairing.ends_in_pairs(V.end1(s, d), p, 1).select(F.lit(1).alias("side"), *cols).unionByName(pairing.ends_in_pairs(V.end2(s, d), p, 2).select(F.lit(2).alias("side"), *cols))


# Joins and set operations

@query("JON_17_19_join_counters", "SELECT tag, a.n AS n_a, b.n AS n_b FROM (SELECT tag, count(*) AS n FROM maps GROUP BY tag) a LEFT JOIN (SELECT tag, count(*) AS n FROM maps_b GROUP BY tag) b USING (tag)", "maps", "maps_b")
def join_counters(s, d):
    count = lambda m, n: m.groupBy("tag").agg(F.count("*").alias(n))
    return count(V.maps(s, d), "n_a").join(count(V.maps_b(s, d), "n_b"), "tag", "left")


@query("SET_2_intersection", f"SELECT {MAP} FROM maps a WHERE EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length)", "maps", "maps_b")
def intersection(s, d):
    return setops.intersection(V.maps(s, d), V.maps_b(s, d))


@query("SET_3_difference", f"SELECT {MAP} FROM maps a WHERE NOT EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length)", "maps", "maps_b")
def difference(s, d):
    return setops.difference(V.maps(s, d), V.maps_b(s, d))


CLOSE = "a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND (abs(a.position - b.position) <= 2 OR abs(a.position + a.length - b.position - b.length) <= 2)"


@query("SET_2_JON_24_tolerant_intersection", f"SELECT {MAP} FROM maps_b a WHERE EXISTS (SELECT 1 FROM maps b WHERE {CLOSE})", "maps", "maps_b")
def tolerant_intersection(s, d):
    return setops.intersection(V.maps_b(s, d), V.maps(s, d), setops.tolerant(2))


@query("SET_1_tolerant_union", f"SELECT {MAP} FROM maps_b UNION ALL SELECT {MAP} FROM maps a WHERE NOT EXISTS (SELECT 1 FROM maps_b b WHERE {CLOSE})", "maps", "maps_b")
def tolerant_union(s, d):
    return setops.union_tolerant(V.maps_b(s, d), V.maps(s, d), 2)


@query("SET_1_7_union", f"SELECT {MAP} FROM (SELECT *, row_number() OVER (PARTITION BY tag, seq_name, strand, position, length ORDER BY event_distance, file, phred DESC, seq_name, position, strand, length, score) AS rn FROM (SELECT *, 0 AS file FROM maps UNION ALL SELECT *, 1 FROM maps_b)) WHERE rn = 1", "maps", "maps_b")
def union(s, d):
    return setops.union(V.maps(s, d), V.maps_b(s, d))


@query("SET_4_compare", "SELECT tag, count(*) FILTER (k = 0) AS only_a, count(*) FILTER (k = 1) AS only_b, count(*) FILTER (k = 2) AS both FROM ("
       "SELECT tag, CASE WHEN EXISTS (SELECT 1 FROM maps_b b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length) THEN 2 ELSE 0 END AS k FROM maps a UNION ALL "
       "SELECT tag, 1 FROM maps_b a WHERE NOT EXISTS (SELECT 1 FROM maps b WHERE a.tag = b.tag AND a.seq_name = b.seq_name AND a.strand = b.strand AND a.position = b.position AND a.length = b.length)) GROUP BY tag", "maps", "maps_b")
def compare(s, d):
    return setops.compare(V.maps(s, d), V.maps_b(s, d))


simple("SET_10_one_per_end", V.maps, setops.one_per_end,
       f"SELECT {MAP} FROM (SELECT *, row_number() OVER (PARTITION BY tag, seq_name, strand, position + length ORDER BY {RANK}) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY tag, seq_name, strand, position ORDER BY {RANK}) AS r1 FROM maps) WHERE r1 = 1) WHERE r2 = 1", "maps")

# Counters, classes, statistics

simple("AGG_1_template_stats", lambda s, d: (V.templates(s, d), V.maps(s, d)), lambda x: stats.template_stats(*x),
       "SELECT count(*) AS templates, count(n) AS mapped, coalesce(sum(n), 0)::BIGINT AS maps, count(*) FILTER (n = 1) AS single, max(n) AS most FROM templates LEFT JOIN (SELECT tag, count(*) AS n FROM maps GROUP BY tag) USING (tag)", "templates", "maps")
simple("AGG_13_strata_counters", V.maps, lambda m: ranking.counters(m).select("tag", R.render_counters(F.col("counters")).alias("counters")),
       "SELECT tag, array_to_string(list_transform(range(0, top + 1), lambda d: len(list_filter(l, lambda x: x = d))), ':') AS counters FROM (SELECT tag, list(event_distance) AS l, max(event_distance) AS top FROM maps GROUP BY tag)", "maps")
simple("SRC_10_counters_round_trip", V.maps, lambda m: ranking.counters(m).select("tag", F.size("counters").alias("n"), R.parse_counters(R.render_counters(F.col("counters"), 2))["counters"].alias("c"), R.parse_counters(R.render_counters(F.col("counters"), 2))["mcs"].alias("mcs")).select("tag", "n", F.size("c").alias("m"), F.expr("aggregate(c, 0L, (s, x) -> s + x)").alias("maps"), "mcs"),
       "SELECT tag, max(event_distance) + 1 AS n, max(event_distance) + 1 AS m, count(*) AS maps, CASE WHEN max(event_distance) + 1 > 2 THEN 2 END AS mcs FROM maps GROUP BY tag", "maps")
simple("AGG_15_two_best", V.maps, ranking.two_best,
       "SELECT tag, count(*) AS n_maps, list_sort(list(event_distance))[1] AS min1, list_sort(list(event_distance))[2] AS min2, list_reverse_sort(list(phred))[1] AS max1, list_reverse_sort(list(phred))[2] AS max2 FROM maps GROUP BY tag", "maps")
CLASS = "WITH c AS (SELECT tag, coalesce(n, 0) AS n_maps, CASE WHEN n IS NULL THEN 'unmapped' WHEN d[2] = d[1] THEN 'tie' WHEN d[2] - d[1] <= 1 THEN 'mmap' ELSE 'unique' END AS class, d[2] - d[1] AS delta FROM templates LEFT JOIN (SELECT tag, count(*) AS n, list_sort(list(event_distance)) AS d FROM maps GROUP BY tag) USING (tag)) "


@query("AGG_16_classified", CLASS + "SELECT tag, n_maps, class, delta FROM c", "templates", "maps")
def classified(s, d):
    return ranking.classified(V.templates(s, d), V.maps(s, d))


@query(FLAGSHIP, CLASS + "SELECT class, count(*) AS n, sum(n_maps)::BIGINT AS maps FROM c GROUP BY class", "templates", "maps")
def class_of_best(s, d):
    return classified(s, d).groupBy("class").agg(F.count("*").alias("n"), F.sum("n_maps").alias("maps"))


simple("AGG_4_strand_profile", V.maps, lambda m: m.groupBy("seq_name", "strand").agg(F.count("*").alias("n"), F.countDistinct("tag").alias("reads")),
       "SELECT seq_name, strand, count(*) AS n, count(DISTINCT tag) AS reads FROM maps GROUP BY ALL", "maps")
simple("AGG_8_9_cross_tab", V.maps, lambda m: stats.cross_tab(m, F.col("seq_name"), F.col("event_distance")),
       "SELECT seq_name AS a, event_distance AS b, count(*) AS n FROM maps GROUP BY CUBE (seq_name, event_distance)", "maps")
simple("AGG_10_diversity", V.maps, stats.diversity, "SELECT tag, count(*) AS sequences, max(n) AS dominant FROM (SELECT tag, seq_name, count(*) AS n FROM maps GROUP BY ALL) GROUP BY tag", "maps")
simple("AGG_7_base_counts", V.ref, lambda r: stats.base_counts(r, "text"),
       "SELECT base, sum(length(text) - length(replace(text, base, '')))::BIGINT AS n FROM ref, (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) b(base) GROUP BY base", "ref")
simple("AGG_6_context_counts", V.reads, lambda r: stats.context_counts(r, "read", 2),
       "SELECT substr(read, i::INT, 2) AS context, count(*) AS n FROM reads, range(1, 32) t(i) GROUP BY 1", "reads")
simple("AGG_18_moments", V.maps, lambda m: stats.moments(m, "seq_name", "phred"),
       "SELECT seq_name, count(phred) AS n, sum(phred)::BIGINT AS total, min(phred) AS least, max(phred) AS most, round(avg(phred), 6) AS mean, round(var_samp(phred), 6) AS variance FROM maps GROUP BY seq_name", "maps")
simple("AGG_20_histogram", V.maps, lambda m: stats.histogram(m, F.floor(F.col("phred") / 5) * 5), "SELECT (phred // 5 * 5)::BIGINT AS bucket, count(*) AS n FROM maps GROUP BY 1", "maps")
simple("AGG_22_WIN_6_roc", V.maps, lambda m: stats.roc(ranking.top_k(m, 1).withColumn("ok", F.col("seq_name") == "N"), "phred", "ok"),
       f"WITH p AS (SELECT phred AS score, count(*) FILTER (seq_name = 'N') AS tp, count(*) FILTER (seq_name <> 'N') AS fp FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY {RANK}) AS rn FROM maps) WHERE rn = 1 GROUP BY phred) "
       "SELECT score, tp, fp, (sum(tp) OVER w)::BIGINT AS all_tp, (sum(fp) OVER w)::BIGINT AS all_fp FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)", "maps")

# Ranks, windows, sorts

simple("WIN_1_ranked", V.maps, ranking.ranked, f"SELECT {MAP}, row_number() OVER (PARTITION BY tag ORDER BY {RANK}) AS rank FROM maps", "maps")
simple("WIN_4_SRT_9_cumulative_strata", V.maps, lambda m: ranking.cumulative_strata(m, 3),
       "SELECT tag, event_distance, n, upto, upto <= 3 OR rn = 1 AS kept FROM (SELECT tag, event_distance, count(*) AS n, (sum(count(*)) OVER w)::BIGINT AS upto, row_number() OVER w AS rn FROM maps GROUP BY tag, event_distance WINDOW w AS (PARTITION BY tag ORDER BY event_distance ROWS UNBOUNDED PRECEDING))", "maps")
simple("WIN_7_softmax", V.maps, lambda m: ranking.softmax_scores(m).select("tag", "seq_name", "strand", "position", F.round("p", 6).alias("p")),
       "WITH o AS (SELECT tag, seq_name, strand, position, min(event_distance) AS e FROM maps GROUP BY ALL), x AS (SELECT *, exp(-ln(10.0) / 10 * (e - min(e) OVER (PARTITION BY tag))) AS w FROM o) SELECT tag, seq_name, strand, position, round(w / sum(w) OVER (PARTITION BY tag), 6) AS p FROM x", "maps")
simple("WIN_8_regions", V.maps, lambda m: ranking.regions(m, 200),
       "WITH RECURSIVE p AS (SELECT tag, seq_name, list_sort(list(position)) AS l FROM maps GROUP BY ALL), r AS ("
       "SELECT tag, seq_name, l, l[1] AS begin, len(list_filter(l, lambda x: x <= l[1] + 200)) AS n, 0 AS done FROM p UNION ALL "
       "SELECT tag, seq_name, l, l[done + n + 1], len(list_filter(l, lambda x: x <= l[done + n + 1] + 200)) - done - n, done + n FROM r WHERE done + n < len(l)) "
       'SELECT tag, seq_name, begin, l[done + n] AS "end", n FROM r', "maps")
simple("SRT_8_top_k", V.maps, lambda m: ranking.top_k(m, 2), f"SELECT * FROM (SELECT {MAP}, row_number() OVER (PARTITION BY tag ORDER BY {RANK}) AS rank FROM maps) WHERE rank <= 2", "maps")
simple("SRT_5_karyotypic", V.maps, lambda m: m.groupBy("seq_name").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(ranking.W.orderBy(F.when(F.col("seq_name") == "N", 1).otherwise(0), "seq_name"))),
       "SELECT seq_name, count(*) AS n, row_number() OVER (ORDER BY seq_name = 'N', seq_name) AS place FROM maps GROUP BY seq_name", "maps")

# Index, seeds, approximate join

simple("IDX_5_AGG_24_kmer_counts", V.ref, lambda r: seeds.kmer_counts(seeds.kmer_index(r, 8)),
       "SELECT substr(text, i::INT, 8) AS kmer, count(*) AS n FROM ref, range(1, 122) t(i) GROUP BY 1", "ref")
simple("IDX_4_locator", V.ref, seeds.locator, 'SELECT seq_name, (row_number() OVER (ORDER BY seq_name) - 1) * 128 AS begin, row_number() OVER (ORDER BY seq_name) * 128 AS "end" FROM ref', "ref")


@query("JON_6_position_to_location", 'SELECT pos, seq_name, pos - begin AS "offset" FROM (SELECT DISTINCT position * 13 AS pos FROM maps) JOIN (SELECT seq_name, (row_number() OVER (ORDER BY seq_name) - 1) * 128 AS begin FROM ref) ON pos >= begin AND pos < begin + 128', "maps", "ref")
def position_to_location(s, d):
    at = V.maps(s, d).select((F.col("position") * 13).alias("pos")).distinct()
    return seeds.to_location(at, seeds.locator(V.ref(s, d)))


simple("SED_2_fixed_seeds", V.reads, lambda r: r.select("tag", F.inline(S.kmers(F.col("read"), 10, 5))),
       'SELECT tag, i::INT AS "offset", substr(read, i::INT + 1, 10) AS kmer FROM reads, range(0, 23, 5) t(i)', "reads")
simple("SED_3_factor_pieces", V.reads, lambda r: r.select("tag", F.inline(S.pieces(F.col("read"), 5))),
       'SELECT tag, (i * 32 // 5)::INT AS "offset", substr(read, (i * 32 // 5)::INT + 1, ((i + 1) * 32 // 5 - i * 32 // 5)::INT) AS kmer FROM reads, range(0, 5) t(i)', "reads")
KC = "WITH k AS (SELECT substr(text, i::INT, 8) AS kmer, count(*) AS n FROM ref, range(1, 122) t(i) GROUP BY 1), x AS (SELECT tag, i * 8 AS o, substr(read, (i * 8 + 1)::INT, 8) AS kmer FROM reads, range(0, 4) t(i)) "


@query("SED_4_cheapest_seeds", KC + 'SELECT tag, o::INT AS "offset", kmer, n FROM (SELECT tag, o, kmer, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY tag ORDER BY coalesce(n, 0), o) AS rn FROM x LEFT JOIN k USING (kmer)) WHERE rn <= 2', "ref", "reads")
def cheapest(s, d):
    return seeds.cheapest_seeds(V.reads(s, d), seeds.kmer_counts(seeds.kmer_index(V.ref(s, d), 8)), 8, 2)


@query("AGG_26_region_profile", KC + "SELECT tag, count(*) AS n_regions, sum(coalesce(n, 0))::BIGINT AS candidates, max(coalesce(n, 0)) AS most FROM x LEFT JOIN k USING (kmer) GROUP BY tag", "ref", "reads")
def profile(s, d):
    return seeds.region_profile(V.reads(s, d), seeds.kmer_counts(seeds.kmer_index(V.ref(s, d), 8)), 8)


@query("JON_10_hamming_search", 'SELECT tag, seq_name, i AS "offset", hamming(read, substr(text, (i + 1)::INT, 32)) AS distance FROM planted_reads, ref, range(0, 97) t(i) WHERE hamming(read, substr(text, (i + 1)::INT, 32)) <= 3', "planted_reads")
def hamming_search(s, d):
    return seeds.hamming_matches(V.planted_reads(s, d), V.ref(s, d), 3, V.READ)


# Text formats and sinks

@query("SNK_5_SRC_9_map_round_trip", "SELECT tag::VARCHAR AS tag, seq_name, strand, position, count(*) AS n FROM maps GROUP BY ALL", "maps")
def map_round_trip(s, d):
    m = V.maps(s, d)
    item = F.concat_ws(":", "seq_name", "strand", F.col("position").cast("string"), F.col("length").cast("string"))
    text = m.groupBy("tag").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("maps"), F.count("*").cast("string").alias("n"))
    lines = text.select(F.concat_ws("\t", F.concat(F.col("tag").cast("string"), F.lit("/1")), F.lit("ACGT"), F.lit("####"), "n", "maps").alias("value"))
    back = R.parse_map_lines(lines).select("tag", F.inline("maps"))
    return back.groupBy("tag", "seq_name", "strand", "position").agg(F.count("*").alias("n"))


@query("SNK_2_4_SRC_14_17_sam_round_trip", f"SELECT qname, flag, rname, pos, mapq, ref_len, xa FROM (SELECT tag::VARCHAR AS qname, CASE WHEN strand = '-' THEN 16 ELSE 0 END::BIGINT AS flag, seq_name AS rname, position AS pos, phred::BIGINT AS mapq, (length + 3)::INT AS ref_len, row_number() OVER w AS rn, count(*) OVER (PARTITION BY tag) - 1 AS xa FROM maps WINDOW w AS (PARTITION BY tag ORDER BY {RANK})) WHERE rn = 1", "maps")
def sam_round_trip(s, d):
    m = ranking.ranked(V.maps(s, d))
    alt = F.concat_ws(",", "seq_name", F.concat("strand", F.col("position").cast("string")), F.lit("4M"), F.col("event_distance").cast("string"))
    own = F.struct(*[F.col(c) for c in ("strand", "seq_name", "position", "phred", "length")])
    xa = F.array_join(F.sort_array(F.collect_list(F.when(F.col("rank") > 1, alt))), ";")
    best = m.groupBy("tag").agg(F.min_by(own, "rank").alias("best"), F.when(F.count("*") > 1, xa).alias("xa")).select("tag", "best.*", "xa")
    line = R.sam_line(
        qname=F.col("tag"), flag=F.when(F.col("strand") == "-", 16).otherwise(0), rname=F.col("seq_name"), pos=F.col("position"), mapq=F.col("phred"),
        cigar=F.concat(F.col("length").cast("string"), F.lit("M2I3D")), rnext=F.lit("*"), pnext=F.lit(0), tlen=F.lit(0), seq=F.lit("*"), qual=F.lit("*"),
        tags=F.concat(F.lit("NM:i:0"), F.coalesce(F.concat(F.lit("\tXA:Z:"), F.col("xa")), F.lit(""))),
    )
    back = R.parse_sam_lines(best.select(line.alias("value")))
    n = F.when(F.col("tags")["XA"].isNull(), 0).otherwise(F.size(F.split(F.col("tags")["XA"], ";")))
    return back.select("qname", "flag", "rname", "pos", "mapq", E.reference_length(F.col("script")).alias("ref_len"), n.cast("bigint").alias("xa"))


simple("SRC_2_read_tags", V.reads, lambda r: r.select(F.concat(F.lit("r"), F.col("tag").cast("string"), F.when(F.col("tag") % 2 == 0, "/1 X").otherwise(" 2:Y:18:ATCACG B T")).alias("raw")).select("raw", *[c.alias(n) for n, c in S.read_tag(F.col("raw")).items()]),
       "SELECT 'r' || tag || CASE WHEN tag % 2 = 0 THEN '/1 X' ELSE ' 2:Y:18:ATCACG B T' END AS raw, 'r' || tag AS tag, CASE WHEN tag % 2 = 0 THEN 1 ELSE 2 END AS pair, CASE WHEN tag % 2 = 1 THEN '2:Y:18:ATCACG' END AS casava, CASE WHEN tag % 2 = 0 THEN 'X' ELSE 'B T' END AS extra FROM reads", "reads")
simple("SNK_1_sam_header", V.ref, lambda r: r.select(F.concat(F.lit("@SQ\tSN:"), "seq_name", F.lit("\tLN:"), F.length("text").cast("string")).alias("line")),
       "SELECT '@SQ' || chr(9) || 'SN:' || seq_name || chr(9) || 'LN:128' AS line FROM ref", "ref")
simple("SNK_6_fastq_echo", V.reads, lambda r: r.select("tag", R.fastq_record(F.col("tag").cast("string"), F.col("read"), F.col("qualities")).alias("record")),
       "SELECT tag, '@' || tag || chr(10) || read || chr(10) || '+' || chr(10) || qualities AS record FROM reads", "reads")


@query("STM_1_windowed_template_size", "SELECT date_trunc('day', ts) AS begin, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def windowed(s, d):
    return windowed_template_size(V.load(s, d, "events").select(F.col("ts"), F.col("value").alias("template_length")))


from readloom.plans import joined, scored, whole  # noqa: E402, F401 (they register their queries here)
