"""Registered queries on filters, statistics, chains, sinks and sources, streams, and the mapper as a whole."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import edits as E
from readloom.functions import pairs as P
from readloom.functions import sequence as Q
from readloom.operators import chaining, filters, mapper, pairing, profiles, ranking, seeds, stats
from readloom.plans import views as V
from readloom.plans.catalog import MAP, PAIRS, RANK, query, related, simple
from readloom.plans.joined import KMERS
from readloom.plans.scored import against_reference
from readloom.sources import records as R
from readloom.sources import sam as M
from readloom.sources.scratch import fresh_path
from readloom.streaming import files as SF

# Filters

simple("FLT_1_9_filter_driver", V.maps, lambda m: filters.MapFilter(names=("A", "N"), strands=("+",), strata_after_best=2, distances=(1, 4), qualities=((5, 20), (40, 50)), keep_first=True).apply(m),
       f"WITH r AS (SELECT *, min(event_distance) OVER (PARTITION BY tag) AS best, row_number() OVER (PARTITION BY tag ORDER BY event_distance, seq_name, position, strand, length, score, phred) AS rn FROM maps), g AS (SELECT *, event_distance - best <= 2 AND seq_name IN ('A', 'N') AND strand = '+' AND event_distance BETWEEN 1 AND 4 AND (phred BETWEEN 5 AND 20 OR phred BETWEEN 40 AND 50) AS good FROM r) SELECT {MAP} FROM (SELECT *, bool_or(good) OVER (PARTITION BY tag) AS any_good FROM g) WHERE good OR rn = 1 AND NOT any_good", "maps")
simple("WIN_5_first_map", V.maps, lambda m: filters.MapFilter(distances=(2, 3), first_only=True).apply(m),
       f"SELECT {MAP} FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY event_distance, seq_name, position, strand, length, score, phred) AS rn FROM maps WHERE event_distance BETWEEN 2 AND 3) WHERE rn = 1", "maps")


@query("FLT_10_pair_filter", PAIRS + "SELECT tag, seq_name, position1, position2, strand1, strand2, length1, length2, phred1, phred2, distance FROM rel WHERE distance BETWEEN 3 AND 7 AND orientation IN ('FR', 'RF', 'FF') AND CASE WHEN strand1 = strand2 THEN 0 WHEN strand1 = '+' THEN 1 + position2 + length2 - position1 ELSE 1 + position1 + length1 - position2 END BETWEEN 0 AND 900", "end1", "end2")
def pair_filter(s, d):
    p = filters.pair_filter(pairing.candidate_pairs(V.end1(s, d), V.end2(s, d)), (3, 7), (0, 900), ("FR", "RF", "FF"))
    return p.select("tag", "seq_name", "position1", "position2", "strand1", "strand2", "length1", "length2", "phred1", "phred2", "distance")


def split(s, d):
    """Maps of one, two or three blocks, by their distance."""
    e = lambda at, n: F.struct((F.col("position") + at).alias("begin"), n.cast("bigint").alias("len"))
    b = F.array(e(F.lit(0), F.col("length")), e(F.col("length") + F.col("phred"), F.col("length")), e(3 * F.col("length") + F.col("phred"), F.lit(7)))
    return V.maps(s, d).withColumn("blocks", F.slice(b, F.lit(1), (F.col("event_distance") % 3 + 1).cast("int")))


@query("FLT_11_rna_filter", "SELECT tag, position, length, phred, score FROM maps WHERE event_distance % 3 > 0 AND phred >= 20 AND length >= 5 AND (event_distance % 3 < 2 OR length >= 20)", "maps")
def rna_filter(s, d):
    return filters.split_filter(split(s, d), split=True, min_intron=20, min_block=5).select("tag", "position", "length", "phred", "score")


@query("AGG_12_split_profile", "SELECT n AS junctions, count(*) AS maps, coalesce(sum(CASE n WHEN 1 THEN phred WHEN 2 THEN phred + length END), 0)::BIGINT AS total FROM (SELECT *, event_distance % 3 AS n FROM maps) GROUP BY n", "maps")
def split_profile(s, d):
    return profiles.split_profile(split(s, d), "blocks")


@query("WIN_12_split_segments", "SELECT tag, position, phred, score, seg AS segment, CASE seg WHEN 0 THEN position ELSE position + 5000 END AS begin, CASE seg WHEN 0 THEN 2 ELSE 1 END::BIGINT AS blocks FROM (SELECT *, unnest([0, 1])::BIGINT AS seg FROM maps WHERE phred = 11)", "maps")
def split_segments(s, d):
    m = V.maps(s, d).where("phred = 11").withColumn("key", F.struct("tag", "position", "phred", "score", "length", "event_distance"))
    part = lambda i, name, at: F.struct(F.lit(i).alias("block"), F.lit(name).alias("seq_name"), (F.col("position") + at).alias("begin"), (F.col("position") + at + 5).alias("stop"))
    b = m.select(F.col("key").alias("tag"), "strand", F.inline(F.array(part(0, "x", 0), part(1, "x", 9), part(2, "y", 5000))))
    return chaining.split_segments(b).select("tag.tag", "tag.position", "tag.phred", "tag.score", "segment", "begin", "blocks")


@query("FLT_13_correctness_check", "SELECT tag FROM planted_reads JOIN planted USING (tag) WHERE hamming(read, w) = tag % 3 + CASE WHEN tag % 5 = 0 THEN 1 ELSE 0 END", "planted", "planted_reads")
def correctness(s, d):
    r = against_reference(s, d).withColumn("window", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    claim = (F.col("tag") % 3 + F.when(F.col("tag") % 5 == 0, 1).otherwise(0)).cast("int")
    return filters.checked(r.withColumn("claimed", claim)).select("tag")


simple("FLT_16_17_subdominant_pruning", V.maps, lambda m: filters.can_enter(m.select("tag", "position", "phred", "score", F.col("event_distance").alias("distance"), (F.col("event_distance") - F.col("phred") % 3).alias("bound")), 2),
       "SELECT tag, position, phred, score, event_distance AS distance, event_distance - phred % 3 AS bound FROM (SELECT *, list_sort(list(event_distance) OVER (PARTITION BY tag))[2] AS lim FROM maps) WHERE lim IS NULL OR event_distance - phred % 3 <= lim", "maps")


@query("FLT_18_kmer_counting", "WITH k AS (SELECT tag, substr(read, i, 6) AS a, substr(w, i, 6) AS b FROM (SELECT tag, read, w, unnest(range(1, 28)) AS i FROM planted_reads JOIN planted USING (tag))), x AS (SELECT tag, a AS k, count(*) AS n FROM k GROUP BY ALL), y AS (SELECT tag, b AS k, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT p.tag, coalesce(sum(least(x.n, coalesce(y.n, 0))), 0) AS shared FROM planted p LEFT JOIN x ON x.tag = p.tag LEFT JOIN y ON y.tag = x.tag AND y.k = x.k GROUP BY p.tag) SELECT tag, shared::INT AS shared, greatest(0, ceil((27 - shared) / 6.0))::INT AS least FROM s", "planted", "planted_reads")
def kmer_counting(s, d):
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    return r.select("tag", filters.shared_kmers(F.col("read"), F.col("w"), 6).alias("shared"), filters.least_errors(F.col("read"), F.col("w"), 6).alias("least"))


simple("FLT_20_proper_pair", lambda s, d: related(s, d), lambda p: p.groupBy("orientation", "layout", "relation").agg(F.count("*").alias("n")),
       PAIRS + "SELECT orientation, layout, relation, count(*) AS n FROM rel GROUP BY ALL", "end1", "end2")
simple("SNK_12_rejected_rows", V.maps, lambda m: filters.routed(m, F.col("phred") >= 20).groupBy("sink").agg(F.count("*").alias("n"), F.sum("phred").alias("total")),
       "SELECT CASE WHEN phred >= 20 THEN 'kept' ELSE 'rejected' END AS sink, count(*) AS n, sum(phred)::BIGINT AS total FROM maps GROUP BY 1", "maps")

# Statistics

simple("AGG_2_merged_statistics", V.maps, lambda m: stats.merged_moments([stats.partial_moments(m.where(f"tag % 3 = {i}"), "seq_name", "phred") for i in range(3)], "seq_name"),
       "SELECT seq_name, count(phred) AS n, sum(phred)::BIGINT AS total, min(phred) AS least, max(phred) AS most, round(avg(phred), 6) AS mean, round(var_samp(phred), 6) AS variance FROM maps GROUP BY 1", "maps")
simple("AGG_3_14_uniq_and_deltas", V.maps, lambda m: profiles.counter_facts(ranking.counters(m)),
       "WITH c AS (SELECT tag, list_sort(list(event_distance)) AS l, list_sort(list_distinct(list(event_distance))) AS u FROM maps GROUP BY tag) SELECT tag, len(l)::BIGINT AS total, u[1]::INT AS first, u[2]::INT AS second, (u[2] - u[1])::INT AS delta, len(list_filter(l, lambda x: x = u[2]))::BIGINT AS subdominant, CASE WHEN len(list_filter(l, lambda x: x = u[1])) <> 1 THEN -1 ELSE coalesce(u[2] - u[1] - 1, 0) END::INT AS uniq FROM c", "maps")
simple("AGG_3_distribution_profile", V.maps, lambda m: profiles.counter_facts(ranking.counters(m)).groupBy(P.bucket(F.col("uniq"), P.BUCKETS["uniq"]).alias("bucket")).agg(F.count("*").alias("n")),
       "WITH c AS (SELECT list_sort(list(event_distance)) AS l, list_sort(list_distinct(list(event_distance))) AS u FROM maps GROUP BY tag), q AS (SELECT CASE WHEN len(list_filter(l, lambda x: x = u[1])) <> 1 THEN -1 ELSE coalesce(u[2] - u[1] - 1, 0) END AS uniq FROM c) SELECT CASE WHEN uniq <= -1 THEN 0 WHEN uniq <= 3 THEN uniq + 1 WHEN uniq <= 10 THEN 5 ELSE 6 END::INT AS bucket, count(*) AS n FROM q GROUP BY 1", "maps")


@query("AGG_5_error_profile", "WITH x AS (SELECT tag, unnest(range(1, 33)) AS i, read, w FROM planted_reads JOIN planted USING (tag)) SELECT (i - 1)::INT AS at, count(*) FILTER (read[i] <> w[i]) AS mismatches, count(*) AS n FROM x GROUP BY i", "planted", "planted_reads")
def error_profile(s, d):
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    return profiles.errors_by_offset(r, "read", "w")


@query("AGG_5_script_errors", "SELECT 4 * count(*) AS events, 7 * count(*) + 0 * sum(phred)::BIGINT AS edits, count(*) AS mismatches, 2 * count(*) AS inserted, 4 * count(*) AS deleted FROM maps", "maps")
def script_errors(s, d):
    e = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    x = F.array(e("D", F.lit(3)), e("M", F.col("position")), e("X", F.lit(1)), e("M", F.col("length")), e("I", F.lit(2)), e("M", F.col("phred")), e("D", F.lit(1)))
    return profiles.script_errors(V.maps(s, d).select(x.alias("x")), "x")


@query("AGG_6_substitution_matrix", "WITH x AS (SELECT unnest(range(1, 33)) AS i, read, w FROM planted_reads JOIN planted USING (tag)) SELECT w[i] AS of, read[i] AS read_as, count(*) AS n FROM x GROUP BY ALL", "planted", "planted_reads")
def substitutions(s, d):
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    return profiles.substitutions(r, "read", "w", 0)


@query("AGG_6_substitutions_in_context", "WITH x AS (SELECT unnest(range(2, 32)) AS i, read, w FROM planted_reads JOIN planted USING (tag)) SELECT substr(w, i - 1, 3) AS of, read[i] AS read_as, count(*) AS n FROM x GROUP BY ALL", "planted", "planted_reads")
def substitutions_in_context(s, d):
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    return profiles.substitutions(r, "read", "w", 1)


@query("AGG_11_chimeras", "SELECT count(*) AS templates, count(*) FILTER (NOT same) AS chimeric FROM (SELECT tag, bool_or(a.seq_name = b.seq_name) AS same FROM end1 a JOIN end2 b USING (tag) GROUP BY tag)", "end1", "end2")
def chimeras(s, d):
    return profiles.chimeras(V.end1(s, d), V.end2(s, d))


simple("AGG_17_search_depth", V.maps, lambda m: profiles.search_depth(ranking.two_best(m), F.col("tag") % 4, 1),
       "WITH b AS (SELECT tag, min(event_distance) AS m FROM maps GROUP BY tag) SELECT tag, (m + 2)::BIGINT AS needed, greatest(m + 2 - tag % 4, 0)::BIGINT AS missing, tag % 4 >= m + 2 AS deep FROM b", "maps")
simple("AGG_19_combined_counters", V.maps, lambda m: profiles.combined(m.groupBy("tag", "seq_name").agg(F.count("*").alias("n")), "seq_name", "n"),
       "SELECT seq_name, sum(n)::BIGINT AS total, max(n) AS most, min(n) AS least, round(avg(n), 6) AS mean FROM (SELECT tag, seq_name, count(*) AS n FROM maps GROUP BY ALL) GROUP BY 1", "maps")
simple("AGG_21_UDF_5_nested_histograms", V.maps, lambda m: profiles.nested(m, "seq_name", "strand", ["+", "-"]).select("seq_name", F.col("+").alias("plus"), F.col("-").alias("minus")),
       "SELECT seq_name, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus FROM maps GROUP BY 1", "maps")
simple("AGG_28_plot_values", V.maps, lambda m: profiles.plot_values(m, P.width_bucket(F.col("length"), 0, 100, 10)),
       "SELECT x, n, sum(n) OVER (ORDER BY x)::BIGINT AS upto, round(n / sum(n) OVER (), 6) AS share FROM (SELECT least(9, length // 10)::INT AS x, count(*) AS n FROM maps GROUP BY 1)", "maps")


@query("AGG_23_mapping_report", "SELECT kind, strand, bisulfite, count(*) AS n, round(avg(phred), 6) AS mapq, max(length) AS longest FROM (SELECT *, CASE WHEN c = 1 THEN 'unique' ELSE 'multi' END AS kind, CASE WHEN length % 2 = 0 THEN 'C2T' ELSE 'G2A' END AS bisulfite FROM (SELECT *, count(*) OVER (PARTITION BY tag) AS c FROM maps)) GROUP BY ALL", "maps")
def mapping_report(s, d):
    return profiles.mapping_report(V.maps(s, d).withColumn("bisulfite", F.when(F.col("length") % 2 == 0, "C2T").otherwise("G2A")))


@query("AGG_29_reports", "WITH p AS (SELECT tag, count(*) AS n FROM maps GROUP BY tag) SELECT 'general' AS section, 'reads' AS name, (SELECT count(*) FROM templates)::DOUBLE AS value UNION ALL SELECT 'general', 'mapped', (SELECT count(*) FROM p) UNION ALL SELECT 'maps', 'all', (SELECT count(*) FROM maps) UNION ALL SELECT 'maps', 'mean', (SELECT round(avg(n), 6) FROM p) UNION ALL SELECT 'population', 'sequences', (SELECT count(DISTINCT seq_name) FROM maps)", "templates", "maps")
def reports(s, d):
    return profiles.report(V.templates(s, d), V.maps(s, d))


@query("SNK_9_json_report", "WITH p AS (SELECT tag, count(*) AS n FROM maps GROUP BY tag) SELECT '{\"reads\":' || (SELECT count(*) FROM templates) || ',\"mapped\":' || (SELECT count(*) FROM p) || ',\"maps\":' || (SELECT count(*) FROM maps) || ',\"most\":' || (SELECT max(n) FROM p) || '}' AS report", "templates", "maps")
def json_report(s, d):
    t = stats.template_stats(V.templates(s, d), V.maps(s, d))
    return t.select(F.to_json(F.struct(F.col("templates").alias("reads"), "mapped", "maps", "most")).alias("report"))


@query("SNK_16_failures_by_class", "SELECT CASE WHEN n IS NULL THEN 'unmapped' WHEN d[1] = d[2] THEN 'tie' WHEN n = 1 THEN 'unique' WHEN d[2] - d[1] <= 5 THEN 'd' || d[2] - d[1] ELSE 'more' END AS class, count(*) AS n FROM templates LEFT JOIN (SELECT tag, count(*) AS n, list_sort(list(event_distance)) AS d FROM maps WHERE event_distance > 1 GROUP BY tag) USING (tag) GROUP BY 1", "templates", "maps")
def failures(s, d):
    b = V.templates(s, d).join(ranking.two_best(V.maps(s, d).where("event_distance > 1")), "tag", "left")
    return profiles.failure_class(b).groupBy("class").agg(F.count("*").alias("n"))


# Chains and segments


@query("WIN_9_region_chain", "WITH RECURSIVE r AS (SELECT tag, seq_name, position AS begin, position + length AS stop FROM maps WHERE length > 0), c AS (SELECT tag, seq_name, stop, (stop - begin)::BIGINT AS coverage, 1 AS n FROM r UNION ALL SELECT c.tag, c.seq_name, r.stop, c.coverage + r.stop - r.begin, c.n + 1 FROM c JOIN r ON r.tag = c.tag AND r.seq_name = c.seq_name AND r.begin >= c.stop) SELECT tag, seq_name, coverage, n FROM (SELECT *, row_number() OVER (PARTITION BY tag, seq_name ORDER BY coverage DESC, n) AS rn FROM c) WHERE rn = 1", "maps")
def chain(s, d):
    return chaining.best_chain(V.maps(s, d).where("length > 0").select("tag", "seq_name", F.col("position").alias("begin"), (F.col("position") + F.col("length")).alias("stop")))


@query("WIN_10_composed_regions", f"WITH {KMERS.format(k=8)}, h AS (SELECT tag, seq_name, i AS a, off AS o FROM (SELECT tag, read, unnest(range(0, 25)) AS i FROM planted_reads) JOIN idx ON kmer = substr(read, (i + 1)::INT, 8)), f AS (SELECT *, CASE WHEN a <= lag(a) OVER w + 8 THEN 0 ELSE 1 END AS fresh FROM h WINDOW w AS (PARTITION BY tag, seq_name, o - a ORDER BY a)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY tag, seq_name, o - a ORDER BY a) AS run FROM f) SELECT tag, seq_name, min(a)::INT AS at, min(o)::INT AS \"offset\", (max(a) + 8 - min(a))::INT AS len FROM g GROUP BY tag, seq_name, o - a, run", "planted_reads", "ref")
def composed(s, d):
    cut = V.planted_reads(s, d).select("tag", F.inline(Q.kmers(F.col("read"), 8)).alias("at", "kmer"))
    return chaining.composed(cut.join(seeds.kmer_index(V.ref(s, d), 8), "kmer").select("tag", "seq_name", "at", "offset"), 8)


simple("WIN_11_regrouped_segments", V.reads, lambda r: chaining.regrouped(r.select("tag", F.inline(Q.chunks(F.col("read"), 8, 8)))),
       "SELECT tag, read AS text, 4 AS n FROM reads", "reads")

# Sources and sinks


@query("SRC_1_3_4_5_20_21_SNK_7_8_files", "SELECT 'fasta' AS kind, seq_name AS name, md5(text) AS digest FROM ref UNION ALL SELECT 'fastq', 'r' || tag, md5(read || qualities) FROM reads", "ref", "reads")
def files(s, d):
    """A reference as FASTA and reads as gzipped FASTQ, written in order, the formats found out, and read back."""
    fasta, fastq = fresh_path(s, "fasta"), fresh_path(s, "fastq")
    R.write_text(V.ref(s, d).select(R.fasta_record(F.col("seq_name"), F.col("text")).alias("value"), "seq_name"), fasta, "seq_name")
    R.write_text(V.reads(s, d).select(R.fastq_record(F.concat(F.lit("r"), "tag"), F.col("read"), F.col("qualities")).alias("value"), "tag"), fastq, "tag", compression="gzip")
    a = R.read_alignments(s, fasta).select(F.lit(R.detect_format(s, fasta)).alias("kind"), F.col("seq_name").alias("name"), F.md5("text").alias("digest"))
    b = R.read_alignments(s, fastq).select(F.lit(R.detect_format(s, fastq)).alias("kind"), F.col("tag").alias("name"), F.md5(F.concat("read", "qualities")).alias("digest"))
    return a.unionByName(b)


@query("SNK_7_ordered_writer", "SELECT count(*) AS n, 0::BIGINT AS out_of_order FROM maps", "maps")
def ordered_writer(s, d):
    """Lines of part files in the order of the files' names are in the order of the key."""
    path = fresh_path(s, "ordered")
    m = V.maps(s, d)
    R.write_text(m.select(F.concat_ws("\t", F.lpad(F.col("tag").cast("string"), 12, "0"), "seq_name", "position").alias("value"), "tag", "seq_name", "position"), path, "tag", "seq_name", "position")
    rows = s.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.substring("value", 1, 12).alias("key"))
    ends = rows.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
    w = W.orderBy("file")  # one row per file
    return ends.select("n", (F.col("first") < F.coalesce(F.lag("last").over(w), F.lit(""))).cast("bigint").alias("bad")).agg(F.sum("n").alias("n"), F.sum("bad").alias("out_of_order"))


@query("SNK_13_SRC_8_stored_index", f"WITH {KMERS.format(k=10)} SELECT kmer, count(*) AS n FROM idx WHERE kmer LIKE 'ACG%' GROUP BY kmer", "ref")
def stored_index(s, d):
    """The k-mer index as a table partitioned by its first bases: a look-up reads the parts that it needs."""
    path = fresh_path(s, "index")
    seeds.write_index(seeds.kmer_index(V.ref(s, d), 10), path)
    return seeds.read_index(s, path, "ACG").groupBy("kmer").agg(F.count("*").alias("n"))


simple("SNK_15_sequence_list", V.ref, lambda r: r.select("seq_name", F.length("text").cast("bigint").alias("length")).unionByName(r.agg(F.sum(F.length("text")).alias("length")).select(F.lit("total").alias("seq_name"), "length")),
       "SELECT seq_name, 128::BIGINT AS length FROM ref UNION ALL SELECT 'total', count(*) * 128 FROM ref", "ref")
simple("SNK_1_11_full_sam_header", V.ref, lambda r: M.header(r.select("seq_name", F.length("text").alias("length")), sort_order="unsorted", read_group={"ID": "g1", "SM": "x"}, program={"ID": "readloom", "VN": "2"}),
       "SELECT 0 AS place, '' AS name, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' AS line UNION ALL SELECT 1, seq_name, '@SQ' || chr(9) || 'SN:' || seq_name || chr(9) || 'LN:128' FROM ref UNION ALL SELECT 2, '', '@RG' || chr(9) || 'ID:g1' || chr(9) || 'SM:x' UNION ALL SELECT 3, '', '@PG' || chr(9) || 'ID:readloom' || chr(9) || 'VN:2'", "ref")
simple("SRC_14_sam_header_rows", V.ref, lambda r: M.parse_header(M.header(r.select("seq_name", F.length("text").alias("length"))).select(F.col("line").alias("value"))).select("kind", F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].cast("int").alias("length")),
       "SELECT 'HD' AS kind, NULL::VARCHAR AS name, NULL::INT AS length UNION ALL SELECT 'SQ', seq_name, 128 FROM ref", "ref")


@query("SNK_3_paired_sam_rows", PAIRS + f", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY relation <> 'concordant', distance, template_length, seq_name, position1, position2, strand1, strand2, length1, length2, event_distance1, phred1, phred2) AS rn FROM rel) WHERE rn = 1) SELECT tag::VARCHAR AS qname, (1 + CASE WHEN relation = 'concordant' THEN 2 ELSE 0 END + CASE WHEN strand1 = '-' THEN 16 ELSE 0 END + CASE WHEN strand2 = '-' THEN 32 ELSE 0 END + 64)::BIGINT AS flag, seq_name AS rname, position1 AS pos, position2 AS pnext, CASE WHEN position1 <= position2 THEN template_length ELSE -template_length END::BIGINT AS tlen FROM best UNION ALL SELECT tag::VARCHAR, (1 + CASE WHEN relation = 'concordant' THEN 2 ELSE 0 END + CASE WHEN strand2 = '-' THEN 16 ELSE 0 END + CASE WHEN strand1 = '-' THEN 32 ELSE 0 END + 128)::BIGINT, seq_name, position2, position1, CASE WHEN position1 <= position2 THEN -template_length ELSE template_length END FROM best", "end1", "end2")
def paired_sam(s, d):
    best = pairing.ranked_pairs(related(s, d)).where("rank = 1")
    return R.parse_sam_lines(M.paired_lines(best)).select("qname", "flag", "rname", "pos", "pnext", "tlen")


simple("SRC_17_xa_expansion", V.maps, lambda m: M.expand_xa(m.select("tag", F.concat("seq_name", F.lit(","), "strand", F.col("position").cast("string"), F.lit(",4M1D"), F.col("length").cast("string"), F.lit("M,"), F.col("event_distance").cast("string"), F.lit(";x,-7,9M,0;")).alias("xa"))).select("tag", "seq_name", "strand", "position", "distance", E.reference_length(E.parse_cigar(F.col("cigar"))).alias("ref_len")),
       "SELECT tag, seq_name, strand, position, event_distance::INT AS distance, (length + 5)::INT AS ref_len FROM maps UNION ALL SELECT tag, 'x', '-', 7, 0, 9 FROM maps", "maps")
simple("SRC_18_optional_fields", V.maps, lambda m: m.select("tag", "position", M.optional_fields(F.split(F.concat(F.lit("NM:i:"), F.col("event_distance").cast("string"), F.lit("\tMD:Z:a:b\tXF:f:0.5")), "\t")).alias("f")).select("tag", "position", F.col("f")["NM"]["value"].cast("int").alias("nm"), F.col("f")["MD"]["value"].alias("md"), F.col("f")["XF"]["type"].alias("kind")),
       "SELECT tag, position, event_distance::INT AS nm, 'a:b' AS md, 'f' AS kind FROM maps", "maps")
simple("SRC_13_old_split_maps", V.maps, lambda m: m.select("tag", "length", R.parse_old_split(F.concat(F.lit("["), F.col("length").cast("string"), F.lit("]=chr7:R"), F.col("position").cast("string"), F.lit("~chr8:F"), F.col("phred").cast("string"))).alias("x")).select("tag", "length", F.col("x.at").alias("at"), F.col("x.donor.seq_name").alias("from"), F.col("x.donor.strand").alias("strand1"), F.col("x.donor.position").alias("p1"), F.col("x.acceptor.strand").alias("strand2"), F.col("x.acceptor.position").alias("p2")),
       "SELECT tag, length, length::INT AS at, 'chr7' AS \"from\", '-' AS strand1, position AS p1, '+' AS strand2, phred::BIGINT AS p2 FROM maps", "maps")
simple("SRC_12_mismatch_string_v0", V.maps, lambda m: m.select("tag", "position", "length", R.parse_mismatches_v0(F.concat(F.lit("A"), (F.col("length") + 1).cast("string"), F.lit("C"), (F.col("length") + 5).cast("string")), F.col("length") + 9).alias("x")).select("tag", "position", "length", E.render(F.col("x")).alias("script")),
       "SELECT tag, position, length, CASE WHEN length > 0 THEN length || 'M' ELSE '' END || '1X3M1X4M' AS script FROM maps", "maps")
simple("SRC_22_sequence_dictionary", V.ref, lambda r: R.parse_bed(r.select(F.concat_ws("\t", "seq_name", F.lit("0"), F.length("text").cast("string"), F.lit("x")).alias("value"))),
       "SELECT seq_name, 0::BIGINT AS begin, 128::BIGINT AS \"end\" FROM ref", "ref")
simple("SRC_23_candidates_scan", V.reads, lambda r: R.parse_candidates(r.select(F.concat_ws("\t", "read", F.concat(F.lit("p1:+:"), F.col("tag").cast("string")), F.lit("p2:-:9")).alias("value"))),
       "SELECT read, 'p1' AS seq_name, '+' AS strand, tag AS position FROM reads UNION ALL SELECT read, 'p2', '-', 9 FROM reads", "reads")
simple("SRC_11_paired_and_scored_maps", V.maps, lambda m: m.select("tag", "phred", "score", F.inline(R.parse_templates(F.concat(F.concat_ws(":", "seq_name", "strand", F.col("position").cast("string"), F.lit("9:30")), F.lit("::"), F.lit("x:-:5:3A4"), F.lit(":::77"))))),
       "SELECT tag, phred, score, seq_name AS seq1, strand AS strand1, position AS pos1, 30::BIGINT AS score1, 'x' AS seq2, '-' AS strand2, 5::BIGINT AS pos2, 77::BIGINT AS total FROM maps", "maps")
simple("SNK_10_maps_by_stratum", V.maps, lambda m: R.maps_by_stratum(m),
       "SELECT tag, string_agg(k, ',' ORDER BY event_distance, k) AS maps, any_value(c) AS counters FROM (SELECT tag, event_distance, seq_name || ':' || strand || ':' || position AS k, NULL AS c FROM maps) GROUP BY tag" if False else
       "WITH c AS (SELECT tag, list_transform(range(0, max(event_distance) + 1), lambda i: i) AS r, list(event_distance) AS l FROM maps GROUP BY tag), m AS (SELECT tag, string_agg(seq_name || ':' || strand || ':' || position, ',' ORDER BY event_distance, seq_name || ':' || strand || ':' || position) AS maps FROM maps GROUP BY tag) SELECT tag, maps, array_to_string(list_transform(r, lambda i: len(list_filter(l, lambda x: x = i))), ':') AS counters FROM c JOIN m USING (tag)", "maps")
simple("MTH_39_40_UDF_2_sam_tags", V.maps, lambda m: ranking.ranked(m).withColumn("n", F.count("*").over(W.partitionBy("tag"))).select("tag", "position", "length", "phred", "score", M.tags({"NH": F.col("n"), "NM": F.col("event_distance"), "AS": F.col("length") - 5 * F.col("event_distance"), "XT": F.when(F.col("n") == 1, "U").otherwise("R"), "MQ": F.when(F.col("rank") == 1, F.col("phred")), "RG": F.lit("g1")}).alias("tags")),
       f"SELECT tag, position, length, phred, score, 'NH:i:' || n || chr(9) || 'NM:i:' || event_distance || chr(9) || 'AS:i:' || length - 5 * event_distance || chr(9) || 'XT:A:' || CASE WHEN n = 1 THEN 'U' ELSE 'R' END || CASE WHEN rn = 1 THEN chr(9) || 'MQ:i:' || phred ELSE '' END || chr(9) || 'RG:Z:g1' AS tags FROM (SELECT *, count(*) OVER (PARTITION BY tag) AS n, row_number() OVER (PARTITION BY tag ORDER BY {RANK}) AS rn FROM maps)", "maps")
simple("UDF_3_4_printed_attributes", V.maps, lambda m: m.select("tag", "position", "length", "phred", "score", M.printed(F.create_map(F.lit("a"), F.col("phred").cast("string"), F.lit("b"), F.col("seq_name"))).alias("text")),
       "SELECT tag, position, length, phred, score, 'a=' || phred || ' b=' || seq_name AS text FROM maps", "maps")

# Streams


@query("STM_2_3_record_stream", "SELECT seq_name, strand, count(*) AS n, sum(phred)::BIGINT AS total FROM maps WHERE phred >= 10 GROUP BY ALL", "maps")
def record_stream(s, d):
    """Rows come as a stream until there are no more, are filtered, and leave as files; what has left is added up."""
    rows = SF.read_stream(s, f"{d}/lineitem.parquet").where("l_quantity >= 10")
    out = SF.run_to_files(rows.select(F.col("l_returnflag").alias("seq_name"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), F.col("l_quantity").cast("int").alias("phred")), fresh_path(s, "stream"))
    return out.groupBy("seq_name", "strand").agg(F.count("*").alias("n"), F.sum("phred").alias("total"))


@query("STM_4_verified_once", "SELECT tag, hamming(read, w)::INT AS distance, 3 AS asked FROM planted_reads JOIN planted USING (tag)", "planted", "planted_reads")
def verified_once(s, d):
    """Candidates that ask for the same pair of texts are verified together."""
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    c = r.select("tag", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "read", "w")
    return seeds.verified_once(c, "read", "w").groupBy("tag").agg(F.max("distance").alias("distance"), F.count("*").cast("int").alias("asked"))


# The mapper

TRUE_PLACE = "SELECT tag, '{strand}' AS strand, 'p' || tag AS seq_name, (tag * 7 % 90 + 1)::INT AS position, hamming(read, w)::INT AS distance FROM planted_reads JOIN planted USING (tag)"


def nearest(s, d, mode, strand="+", **how):
    reads = V.planted_reads(s, d)
    if strand == "-":
        reads = reads.select("tag", Q.reverse_complement(F.col("read")).alias("read"))
    found = mapper.map_reads(reads, V.ref(s, d), 32, mapper.Search(mode=mode, **how))
    return found.where("rank = 1").select("tag", "strand", "seq_name", "position", "distance")


for _mode, _strand, _where in (("exact", "+", " WHERE tag % 3 = 0"), ("complete", "-", ""), ("sensitive", "+", "")):
    query(f"ORC_1_2_5_{_mode}_search", TRUE_PLACE.format(strand=_strand) + _where, "planted", "planted_reads")(lambda s, d, m=_mode, t=_strand: nearest(s, d, m, t, max_error=2, seed_length=16))
query("ORC_2_fast_search", TRUE_PLACE.format(strand="+") + " WHERE read[1:10] = w[1:10] OR read[11:20] = w[11:20] OR read[21:30] = w[21:30]", "planted", "planted_reads")(lambda s, d: nearest(s, d, "fast", max_error=2, seed_length=10))


@query("ORC_4_6_11_hybrid_depth", "SELECT count(*) AS reads, count(*) FILTER (tag % 3 = 2) AS deeper FROM planted_reads", "planted_reads")
def hybrid(s, d):
    """Of seeds of sixteen two are laid: reads of two errors may have none left and are searched again with three pieces."""
    found = mapper.map_reads(V.planted_reads(s, d), V.ref(s, d), 32, mapper.Search(mode="sensitive", max_error=2, seed_length=16)).where("rank = 1")
    return found.agg(F.count("*").alias("reads"), F.count_if(F.col("mcs") == 3).alias("deeper"))


simple("ORC_7_9_parameters", V.reads, lambda r: r.select("tag", (F.lit(20) + F.col("tag") % 100).alias("length")).select("tag", *[c.alias(n) for n, c in profiles.instantiated(F.col("length")).items()]),
       "SELECT tag, floor((20 + tag % 100) * 0.12 + 1e-9)::INT AS max_error, floor((20 + tag % 100) * 0.04 + 1e-9)::INT AS complete_error, floor((20 + tag % 100) * 0.2 + 1e-9)::INT AS bandwidth, floor((20 + tag % 100) * 0.8 + 1e-9)::INT AS min_identity, 5 AS reported_single, 100 AS searched_end, 20 AS searched_pairs FROM reads", "reads")


@query("ORC_8_pair_states", "SELECT tag, CASE WHEN tag % 4 = 0 THEN 'unpaired' WHEN tag % 4 = 1 THEN 'discordant' ELSE 'concordant' END AS kind, hamming(read, w)::INT AS distance FROM planted_reads JOIN planted USING (tag) WHERE tag * 7 % 90 + 60 <= 128 AND tag > 1", "planted", "planted_reads")
def pair_states(s, d):
    """The second end lies 28 bases on, on the other strand; or on another sequence; or nowhere."""
    at = (F.col("tag") * 7 % 90).cast("int")
    r = against_reference(s, d).where((at + 60 <= 128) & (F.col("tag") > 1))
    other = V.ref(s, d).where("seq_name = 'p1'").select(F.col("seq_name").alias("one"), F.substring("text", 40, 32).alias("far"))
    mate = F.when(F.col("tag") % 4 == 0, F.repeat(F.lit("N"), 32)).when(F.col("tag") % 4 == 1, F.col("far")).otherwise(Q.reverse_complement(F.substring("text", at + 29, F.lit(32))))
    ends = r.withColumn("one", F.concat(F.lit("p"), (F.col("tag") % 1 + 1).cast("string"))).join(other, "one").select("tag", "read", mate.alias("mate"))
    found = mapper.map_pairs(ends.select("tag", "read"), ends.select("tag", F.col("mate").alias("read")), V.ref(s, d), 32, mapper.Search(mode="complete", max_error=2), (33, 100))
    return found.select("tag", "kind", "distance")
