"""Registered queries on edit scripts, scores, mapping qualities and text utilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import alignment as A
from readloom.functions import edits as E
from readloom.functions import pairs as P
from readloom.functions import scores as S
from readloom.functions import sequence as Q
from readloom.functions import text as T
from readloom.operators import ranking
from readloom.plans import views as V
from readloom.plans.catalog import query, simple

# Sequences and text

simple("STR_9_trim_attribute", V.reads, lambda r: r.select("tag", F.concat(F.lit("lt:Z:3:"), F.substring("read", 1, 3), F.lit(":"), F.substring("qualities", 1, 3)).alias("raw")).select("tag", *[c.alias(n) for n, c in T.trim_attribute(F.col("raw")).items()]),
       "SELECT tag, 'lt' AS side, 3 AS n, substr(read, 1, 3) AS bases, substr(qualities, 1, 3) AS quals FROM reads", "reads")
simple("STR_14_clipping", V.reads, lambda r: r.select("tag", F.concat(F.repeat(F.lit("N"), (F.col("tag") % 3).cast("int")), F.lit("ANA"), "read", F.lit("N")).alias("u"), F.concat(F.lower(F.substring("read", 1, 4)), F.substring("read", 5, 32)).alias("m")).select("tag", Q.clipped(F.col("u"), "uncalled").alias("uncalled"), Q.clipped(F.col("m"), "masked").alias("masked"), Q.clipped(F.col("m"), "fixed", 3, 5).alias("fixed"), Q.wildcards(Q.clipped(F.col("u"), "uncalled")).alias("wild")),
       "SELECT tag, 'ANA' || read AS uncalled, substr(read, 5) AS masked, lower(substr(read, 4, 1)) || substr(read, 5, 23) AS fixed, 1 AS wild FROM reads", "reads")
simple("STR_15_run_lengths", V.reads, lambda r: r.select("tag", "read", Q.runs(F.col("read")).alias("runs")).select("tag", Q.run_length(F.col("read"), 2).alias("rl"), F.array_join(F.transform("runs", lambda x: x["begin"].cast("string")), ",").alias("begins"), F.size("runs").alias("n")),
       "SELECT tag, list_aggregate(list_transform(list_filter(range(1, 33), lambda i: i < 3 OR read[i] <> read[i-1] OR read[i-1] <> read[i-2]), lambda i: read[i]), 'string_agg', '') AS rl,"
       " array_to_string(list_transform(list_filter(range(1, 33), lambda i: i = 1 OR read[i] <> read[i-1]), lambda i: i - 1), ',') AS begins, len(list_filter(range(1, 33), lambda i: i = 1 OR read[i] <> read[i-1]))::INT AS n FROM reads", "reads")
simple("STR_20_string_utilities", V.reads, lambda r: r.select("tag", F.when(F.col("read") < F.col("qualities"), -1).when(F.col("read") > F.col("qualities"), 1).otherwise(0).alias("compared"), F.trim(F.concat(F.lit("  "), "read", F.lit(" "))).alias("trimmed"), F.format_string("%s-%05d", F.substring("read", 1, 4), "tag").alias("printed")),
       "SELECT tag, CASE WHEN read < qualities THEN -1 WHEN read > qualities THEN 1 ELSE 0 END AS compared, read AS trimmed, substr(read, 1, 4) || '-' || lpad(tag::VARCHAR, greatest(5, length(tag::VARCHAR))::INT, '0') AS printed FROM reads", "reads")
simple("STR_21_sizes_and_lists", V.reads, lambda r: r.select("tag", T.parse_size(F.concat(F.col("tag").cast("string"), F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("M"), F.lit("G")), (F.col("tag") % 4 + 1).cast("int")))).alias("size"), T.parse_fraction(F.concat((F.col("tag") % 100).cast("string"), F.lit("%")), F.lit(200)).alias("part"), T.parse_fraction(F.lit("0.25"), F.lit(200)).alias("share"), T.parse_fraction(F.lit("7"), F.lit(200)).alias("whole"), F.size(T.parse_list(F.concat_ws(",", "tag", F.lit("b"), F.lit("c")))).alias("n")),
       "SELECT tag, tag::BIGINT * (1024 ** (tag % 4))::BIGINT AS size, (tag % 100 * 2)::BIGINT AS part, 50::BIGINT AS share, 7::BIGINT AS whole, 3 AS n FROM reads", "reads")
simple("STR_22_location_tokens", V.maps, lambda m: m.select("tag", "position", "length", "phred", "score", F.concat_ws(":", "seq_name", F.when(F.col("strand") == "+", "F").otherwise("R"), F.when(F.col("phred") % 2 == 0, F.lit("C2T")), F.col("position").cast("string"), F.col("length").cast("string")).alias("raw")).select("tag", "phred", "score", *[c.alias(n) for n, c in T.location(F.col("raw")).items()]),
       "SELECT tag, phred, score, seq_name AS seq, strand, CASE WHEN phred % 2 = 0 THEN 'C2T' END AS bisulfite, position AS pos, length AS len FROM maps", "maps")
simple("IDX_2_strand_and_bisulfite_texts", V.ref, lambda r: r.select("seq_name", F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.md5(c).alias("digest")) for n, c in Q.index_texts(F.col("text")).items()]))),
       "SELECT seq_name, unnest(['F', 'R', 'F:C2T', 'R:C2T', 'F:G2A', 'R:G2A']) AS kind, unnest([md5(text), md5(rc), md5(replace(text, 'C', 'T')), md5(replace(rc, 'C', 'T')), md5(replace(text, 'G', 'A')), md5(replace(rc, 'G', 'A'))]) AS digest FROM (SELECT *, reverse(translate(text, 'ACGT', 'TGCA')) AS rc FROM ref)", "ref")
simple("IDX_1_uncalled_intervals", V.ref, lambda r: r.withColumn("t", F.concat(F.substring("text", 1, 20), F.repeat(F.lit("N"), (30 + F.length("seq_name") * 8).cast("int")), F.substring("text", 21, 108))).select("seq_name", F.inline(Q.called_intervals(F.col("t"), 50))),
       "SELECT seq_name, unnest(CASE WHEN n >= 50 THEN [0, 20, 20 + n] ELSE [0] END)::INT AS begin, unnest(CASE WHEN n >= 50 THEN [20, 20 + n, 128 + n] ELSE [128 + n] END)::INT AS stop, unnest(CASE WHEN n >= 50 THEN [true, false, true] ELSE [true] END) AS called FROM (SELECT seq_name, 30 + length(seq_name) * 8 AS n FROM ref)", "ref")
simple("IDX_3_run_length_text", V.ref, lambda r: r.select("seq_name", F.length(Q.run_length(F.col("text"))).alias("rl_length"), F.md5(Q.run_length(F.col("text"))).alias("digest")),
       r"SELECT seq_name, length(t)::INT AS rl_length, md5(t) AS digest FROM (SELECT seq_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS t FROM ref)", "ref")

# Scripts


def script2(m):
    """Xs, indels inside, and a deletion at the end of every other script: 3D <position>M 1X <length>M 2I <phred>M [1D]."""
    e = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    body = F.array(e("D", F.lit(3)), e("M", F.col("position")), e("X", F.lit(1)), e("M", F.col("length")), e("I", F.lit(2)), e("M", F.col("phred")))
    return m.withColumn("x", F.when(F.col("phred") % 2 == 0, F.concat(body, F.array(e("D", F.lit(1))))).otherwise(body))


simple("MTH_3_inner_edit_distance", V.maps, lambda m: script2(m).select("tag", "position", "length", "phred", "score", E.edit_distance(F.col("x")).alias("edits"), E.edit_distance_inner(F.col("x")).alias("inner")),
       "SELECT tag, position, length, phred, score, (6 + CASE WHEN phred % 2 = 0 THEN 1 ELSE 0 END)::INT AS edits, 3 AS inner FROM maps", "maps")
simple("MTH_4_42_error_qualities", V.reads, lambda r: r.withColumn("x", F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in (("I", 1), ("M", 3), ("X", 1), ("M", 4), ("D", 2), ("X", 1), ("M", 22))])).select("tag", F.round(E.error_quality(F.col("x"), F.col("qualities")), 6).alias("mean"), F.aggregate(E.mismatch_qualities(F.col("x"), F.col("qualities")), F.lit(0), lambda s, q: s + q).alias("total"), F.array_max(E.mismatch_qualities(F.col("x"), F.col("qualities"))).alias("most"), E.error_quality(F.slice("x", 2, 1), F.col("qualities")).alias("none")),
       "SELECT tag, round((ascii(q[5]) + ascii(q[10]) + ascii(q[10]) - 99) / 3.0, 6) AS mean, ascii(q[5]) + ascii(q[10]) - 66 AS total, greatest(ascii(q[5]), ascii(q[10])) - 33 AS most, 60.0::DOUBLE AS none FROM (SELECT tag, qualities AS q FROM reads)", "reads")
simple("MTH_7_fixed_score", V.maps, lambda m: script2(m).select("tag", "position", "length", "phred", "score", E.fixed_score(F.col("x"), E.read_length(F.col("x"))).alias("fixed"), *[c.alias(n) for n, c in zip(("insertions", "deletions"), E.indel_counts(F.col("x")), strict=True)]),
       "SELECT tag, position, length, phred, score, (position + length + phred + 3 - 4 - 9 - 8 - CASE WHEN phred % 2 = 0 THEN 7 ELSE 0 END)::INT AS fixed, 1 AS insertions, CASE WHEN phred % 2 = 0 THEN 2 ELSE 1 END AS deletions FROM maps", "maps")
simple("MTH_23_curated_script", V.maps, lambda m: script2(m).select("tag", "position", "length", "phred", "score", E.render_sam_cigar(E.curated(F.col("x"), 10)).alias("cigar")),
       "SELECT tag, position, length, phred, score, CASE WHEN c = '' THEN (position + length + phred + 3)::VARCHAR || 'S' ELSE c END AS cigar FROM (SELECT *, CASE"
       " WHEN position >= 10 AND phred >= 10 THEN position + 1 + length || 'M2I' || phred || 'M'"
       " WHEN position >= 10 AND length >= 10 THEN position + 1 + length || 'M' || phred + 2 || 'S'"
       " WHEN position >= 10 THEN position || 'M' || length + phred + 3 || 'S'"
       " WHEN length >= 10 AND phred >= 10 THEN position + 1 || 'S' || length || 'M2I' || phred || 'M'"
       " WHEN length >= 10 THEN position + 1 || 'S' || length || 'M' || phred + 2 || 'S'"
       " WHEN phred >= 10 THEN position + length + 3 || 'S' || phred || 'M' ELSE '' END AS c FROM maps)", "maps")
simple("MTH_24_script_building", V.maps, lambda m: script2(m).withColumn("two", E.merged(F.concat("x", F.reverse("x")))).select("tag", "position", "length", "phred", "score", E.render_sam_cigar(F.col("two")).alias("twice"), (F.reverse(F.reverse("x")) == F.col("x")).alias("same"), F.size("two").alias("n")),
       "SELECT tag, position, length, phred, score, '3D' || position + 1 + length || 'M2I' || CASE WHEN phred % 2 = 0 THEN phred || 'M2D' || phred ELSE (2 * phred)::VARCHAR END || 'M2I' || position + 1 + length || 'M3D' AS twice, true AS same, CASE WHEN phred % 2 = 0 THEN 13 ELSE 11 END - CASE WHEN length = 0 THEN 2 ELSE 0 END - CASE WHEN position = 0 THEN 2 ELSE 0 END AS n FROM maps", "maps")
simple("SRC_16_MTH_38_md", V.maps, lambda m: m.select("tag", "position", "length", "phred", "score", F.concat(F.col("position").cast("string"), F.lit("A"), F.col("length").cast("string"), F.lit("^AC0T"), F.col("phred").cast("string")).alias("md")).withColumn("x", E.parse_md(F.col("md"))).select("tag", "position", "length", "phred", "score", F.size("x").alias("n"), E.edit_distance(F.col("x")).alias("edits"), F.array_join(F.filter(F.transform("x", lambda e: e["base"]), lambda b: b.isNotNull()), "").alias("bases"), E.render_md(F.col("x"), F.transform("x", lambda e: e["base"])).alias("back")),
       "SELECT tag, position, length, phred, score, 6 - CASE WHEN position = 0 THEN 1 ELSE 0 END - CASE WHEN length = 0 THEN 1 ELSE 0 END AS n, 4 AS edits, 'AACT' AS bases, position || 'A' || length || '^AC0T' || phred AS back FROM maps", "maps")

# Scores and qualities


def best_of(m):
    """(tag, n, min1, min2, max1, max2, best): the two best distances and scores, and the best match by score, then distance."""
    best = m.groupBy("tag").agg(F.max(F.struct("phred", (-F.col("event_distance")).alias("d"))).alias("best"))
    return ranking.two_best(m).join(best, "tag")


def mapq_terms(m):
    b = best_of(m).withColumns({"edit": -F.col("best.d"), "swg": F.col("best.phred"), "mcs": F.col("tag") % 3, "length": F.lit(100)})
    delta, wdelta = S.deltas(F.col("n_maps"), F.col("mcs"), F.col("edit"), F.col("swg"), F.col("min1"), F.col("min2"), F.col("max1"), F.col("max2"))
    many = F.col("n_maps") > 1
    return b.withColumns({
        "delta": delta, "wdelta": wdelta, "edit_n": S.distance_norm(F.col("edit"), F.col("length")), "swg_n": S.score_norm(F.col("swg"), F.col("length")),
        "edit2": F.when(many, S.distance_norm(F.col("min2"), F.col("length"))).otherwise(0.0), "swg2": F.when(many, S.score_norm(F.col("max2"), F.col("length"))).otherwise(0.0),
    })


def z_of(model: dict) -> Column:
    c = F.col
    return S.linear(model, {"edit": c("edit_n"), "event": c("edit_n"), "swg": c("swg_n"), "quality": F.lit(30.0), "accepted": c("n_maps"), "mcs": c("mcs"), "mean_region": F.lit(0.5), "most_region": F.lit(0.75), "kmer": c("tag") % 7 / 10.0, "wdelta": c("wdelta"), "edit2": c("edit2"), "event2": c("edit2"), "swg2": c("swg2"), "subdominant": c("n_maps") - 1, "mapq1": F.lit(20), "mapq2": F.lit(30)})


def z_sql(model: dict) -> str:
    terms = {"edit": "edit_n", "event": "edit_n", "swg": "swg_n", "quality": "30.0", "accepted": "n", "mcs": "mcs", "mean_region": "0.5", "most_region": "0.75", "kmer": "(tag % 7 / 10.0)", "wdelta": "wdelta", "edit2": "edit2", "event2": "edit2", "swg2": "swg2", "subdominant": "(n - 1)", "mapq1": "20", "mapq2": "30"}
    return f"({model['one']}::DOUBLE " + "".join(f" + {w}::DOUBLE * {terms[k]}" for k, w in model.items() if k != "one") + ")"


TERMS = """WITH l AS (SELECT tag, count(*) AS n, list_sort(list(event_distance)) AS d, list_reverse_sort(list(phred)) AS p, max({'p': phred, 'd': -event_distance}) AS b, tag % 3 AS mcs FROM maps_b GROUP BY tag),
t AS (SELECT tag, n, mcs, -b.d AS edit, b.p AS swg, d[1] AS min1, d[2] AS min2, p[1] AS max1, p[2] AS max2 FROM l),
u AS (SELECT *, CASE WHEN n = 1 THEN -1 WHEN edit <> min1 OR max1 = max2 OR min1 = min2 THEN 0 ELSE min2 - min1 END AS delta,
    CASE WHEN n = 1 THEN mcs - min1 ELSE least(mcs, min2) - min1 END AS wdelta, (100 - edit) / 100.0::DOUBLE AS edit_n, swg / 100.0::DOUBLE AS swg_n,
    CASE WHEN n > 1 THEN (100 - min2) / 100.0::DOUBLE ELSE 0 END AS edit2, CASE WHEN n > 1 THEN max2 / 100.0::DOUBLE ELSE 0 END AS swg2 FROM t) """


def mapq_sql(z: str) -> str:
    return f"least(59, round(10 * log10(1 + exp(least({z}, 300.0))))::INT)"


@query("MTH_33_34_36_AGG_16_mapq_single", TERMS + f"SELECT tag, delta, wdelta, round(edit_n, 6) AS edit_n, round({z_sql(S.UNIQUE_SENSITIVE)}, 4) AS z, CASE WHEN delta = 0 THEN 0 WHEN wdelta > 1 THEN 60 WHEN delta = -1 THEN {mapq_sql(z_sql(S.UNIQUE_FAST))} ELSE {mapq_sql(z_sql(S.MANY_FAST))} END AS mapq, CASE WHEN tag % 50 < 40 THEN 1 WHEN delta = 0 THEN 0 WHEN wdelta > 1 THEN 60 WHEN delta = -1 THEN {mapq_sql(z_sql(S.UNIQUE_SENSITIVE))} ELSE {mapq_sql(z_sql(S.MANY_SENSITIVE))} END AS local FROM u", "maps_b")
def mapq_single(s, d):
    t, delta, wdelta = mapq_terms(V.maps_b(s, d)), F.col("delta"), F.col("wdelta")
    q = lambda model: S.logit_mapq(z_of(model))
    return t.select("tag", "delta", "wdelta", F.round("edit_n", 6).alias("edit_n"), F.round(z_of(S.UNIQUE_SENSITIVE), 4).alias("z"), S.mapq_single(delta, wdelta, q(S.UNIQUE_FAST), q(S.MANY_FAST)).alias("mapq"), S.mapq_single(delta, wdelta, q(S.UNIQUE_SENSITIVE), q(S.MANY_SENSITIVE), F.col("tag") % 50).alias("local"))


@query("MTH_35_mapq_pair", TERMS + f"SELECT tag, CASE WHEN tag % 11 = 0 THEN 0 WHEN tag % 2 = 0 THEN CASE WHEN delta = 0 THEN least(tag % 9, 4) ELSE 5 + least(greatest(wdelta, 0), 10) END WHEN delta = 0 THEN 0 WHEN wdelta > 1 THEN 60 ELSE ((swg + tag % 60) // 2) END::BIGINT AS mapq, {mapq_sql(z_sql(S.PAIRS))}::BIGINT AS by_model FROM u", "maps_b")
def mapq_pair(s, d):
    t = mapq_terms(V.maps_b(s, d))
    m = S.mapq_pair(F.col("tag") % 11 == 0, F.col("tag") % 2 == 0, F.col("delta"), F.col("wdelta"), F.col("tag") % 9, F.col("swg"), F.col("tag") % 60)
    return t.select("tag", m.cast("bigint").alias("mapq"), S.logit_mapq(z_of(S.PAIRS)).cast("bigint").alias("by_model"))


@query("MTH_27_28_31_template_sizes", "SELECT tag, a.position AS p1, b.position AS p2, a.length AS l1, b.length AS l2, a.strand AS s1, b.strand AS s2, a.score AS c1, b.score AS c2, CASE WHEN a.strand = b.strand THEN 0 WHEN a.strand = '+' THEN 1 + b.position + b.length - a.position ELSE 1 + a.position + a.length - b.position END AS insert_size, CASE WHEN a.position < b.position THEN greatest(a.position + a.length, b.position + b.length) - a.position ELSE b.position - greatest(a.position + a.length, b.position + b.length) END AS observed, round(abs(a.length - 50) / 7.5, 6) AS sigma FROM end1 a JOIN end2 b USING (tag, seq_name)", "end1", "end2")
def sizes(s, d):
    a, b = V.end1(s, d), V.end2(s, d)
    j = a.select("tag", "seq_name", *[F.col(x).alias(y) for x, y in (("position", "p1"), ("length", "l1"), ("strand", "s1"), ("score", "c1"))]).join(b.select("tag", "seq_name", *[F.col(x).alias(y) for x, y in (("position", "p2"), ("length", "l2"), ("strand", "s2"), ("score", "c2"))]), ["tag", "seq_name"])
    c = F.col
    return j.select("tag", "p1", "p2", "l1", "l2", "s1", "s2", "c1", "c2", S.insert_size(c("s1"), c("p1"), c("l1"), c("s2"), c("p2"), c("l2")).alias("insert_size"), S.observed_size(c("p1"), c("l1"), c("p2"), c("l2")).alias("observed"), F.round(S.sigma(c("l1"), F.lit(50.0), F.lit(7.5)), 6).alias("sigma"))


simple("MTH_32_reliable_sizes", V.maps, lambda m: m.groupBy("seq_name", "strand").agg(F.count("*").alias("n"), F.stddev_samp("length").alias("sd")).select("seq_name", "strand", "n", S.samples_needed(F.col("sd"), 3.0).alias("needed"), S.reliable(F.col("n"), F.col("sd")).alias("reliable")),
       "SELECT seq_name, strand, n, floor((1.96 * sd / 3) ** 2)::BIGINT + 1 AS needed, n > floor((1.96 * sd / 20) ** 2)::BIGINT + 1 AND n >= 100 AS reliable FROM (SELECT seq_name, strand, count(*) AS n, stddev_samp(length) AS sd FROM maps GROUP BY ALL)", "maps")
simple("MTH_41_all_buckets", V.maps, lambda m: m.select("tag", "position", "length", "phred", "score", *[P.bucket(F.col(c), P.BUCKETS[b]).alias(b) for c, b in (("length", "read_length"), ("event_distance", "delta_edit"), ("event_distance", "delta_swg"), ("phred", "mapq"), ("event_distance", "junctions"))], P.width_bucket(F.col("position") - 1200, -1000, 50010, 10).alias("inss")),
       "SELECT tag, position, length, phred, score, CASE WHEN length <= 5 THEN 0 WHEN length <= 40 THEN 1 WHEN length <= 80 THEN 2 WHEN length <= 100 THEN 3 WHEN length <= 150 THEN 4 WHEN length <= 300 THEN 5 WHEN length <= 800 THEN 6 WHEN length <= 1000 THEN 7 WHEN length <= 2000 THEN 8 WHEN length <= 5000 THEN 9 ELSE 10 END AS read_length,"
       " least(event_distance, 11)::INT AS delta_edit, CASE WHEN event_distance <= 5 THEN event_distance WHEN event_distance <= 10 THEN 6 ELSE 7 END::INT AS delta_swg, least(phred, 61)::INT AS mapq, least(event_distance - 1, 3)::INT AS junctions, greatest(0, least(5100, (position - 200) // 10))::INT AS inss FROM maps", "maps")

# Alignment


def against_reference(s, d):
    """Planted reads with the text of their sequence."""
    name = F.concat(F.lit("p"), F.col("tag").cast("string"))
    return V.planted_reads(s, d).withColumn("seq_name", name).join(V.ref(s, d), "seq_name")


NEAREST = """WITH w AS (SELECT tag, read, i, j, levenshtein(read, substr(text, i, j - i + 1)) AS e FROM (SELECT tag, read, text, unnest(range(1, 129)) AS i FROM planted_reads JOIN ref ON seq_name = 'p' || tag), (SELECT unnest(range(1, 129)) AS j) WHERE j - i BETWEEN 27 AND 35) """


@query("MTH_11_13_JON_9_30_nearest_piece", NEAREST + "SELECT tag, min(e)::INT AS distance, min(e)::INT AS by_matrix, min(e)::INT AS by_script, true AS valid FROM w GROUP BY tag HAVING min(e) <= 4", "planted_reads", "ref")
def nearest_piece(s, d):
    """Bit-parallel distance, the dynamic program and the script that it gives, side by side."""
    r = against_reference(s, d).withColumn("b", A.semi_global_distance(F.col("read"), F.col("text"), 4)).withColumn("a", A.edit_alignment(F.col("read"), F.col("text")))
    piece = F.substring("text", F.col("a.begin") + 1, F.col("a.stop") - F.col("a.begin"))
    return r.where("b.distance is not null").select("tag", F.col("b.distance").alias("distance"), (-F.col("a.score")).alias("by_matrix"), E.edit_distance(E.parse_cigar(F.col("a.cigar"))).alias("by_script"), A.script_fits(F.col("read"), piece, F.col("a.cigar")).alias("valid"))


@query("MTH_12_all_matches", "SELECT tag, CASE WHEN tag % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN d = 0 THEN 1 ELSE 0 END AS n, d::INT AS first FROM (SELECT tag, hamming(read, w) AS d FROM planted_reads JOIN planted USING (tag))", "planted", "planted_reads")
def all_matches(s, d):
    """The text of half of the reads holds the read's window a second time, at its end; behind an exact hit the next columns are near ones."""
    r = against_reference(s, d)
    w = F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32))
    t = F.concat(F.substring("text", F.lit(1), (F.col("tag") * 7 % 90 + 32).cast("int")), F.lit("N" * 40), F.when(F.col("tag") % 2 == 0, w).otherwise(F.lit("")))
    hits = r.select("tag", A.all_matches(F.col("read"), t, 2).alias("hits"))
    return hits.select("tag", F.size("hits").alias("n"), F.get("hits", F.lit(0))["distance"].alias("first"))


GAPPED = """WITH b AS (SELECT tag, w, substr(w, 1, 14) || substr(w, 15 + tag % 3 + 1) AS read FROM planted),
g AS (SELECT tag, 32 - (tag % 3 + 1) - (6 + tag % 3 + 1) AS planted_score, read, w FROM b),
c AS (SELECT tag, planted_score, unnest(range(0, 33)) AS o, read, w FROM g) """


@query("MTH_15_18_20_affine_gap", GAPPED + "SELECT tag, max(length(read) - (6 + 32 - length(read)) - 5 * (hamming(substr(read, 1, o), substr(w, 1, o)) + hamming(substr(read, o + 1), right(w, length(read) - o))))::INT AS score, (32 - any_value(length(read)))::INT AS deleted FROM c WHERE o BETWEEN 1 AND length(read) - 1 GROUP BY tag", "planted")
def affine_gap(s, d):
    """Reads that lack one to three bases of their window, aligned with it: the best place of the gap, by all of them in SQL."""
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    r = r.withColumn("key", F.concat(F.substring("w", 1, 14), F.substring("w", (16 + F.col("tag") % 3).cast("int"), F.lit(32))))
    a = r.select("tag", A.affine(F.col("key"), F.col("w"), "global").alias("a"))
    x = E.parse_cigar(F.col("a.cigar"))
    return a.select("tag", F.col("a.score").alias("score"), F.aggregate(F.filter(x, lambda e: e["op"] == "D"), F.lit(0), lambda t, e: t + e["len"]).alias("deleted"))


@query("MTH_16_22_local_alignment", "SELECT tag, 24 AS score, '24M' AS cigar FROM planted", "planted")
def local_alignment(s, d):
    """24 bases of the window between others that match nothing: the local alignment is these bases."""
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(24)))
    key, text = F.concat(F.repeat(F.lit("x"), 9), "w", F.repeat(F.lit("y"), 7)), F.concat(F.repeat(F.lit("N"), 12), "w", F.repeat(F.lit("n"), 5))
    return r.select("tag", A.affine(key, text, "local").alias("a")).select("tag", "a.score", "a.cigar")


@query("MTH_14_25_26_realigned", "SELECT tag, hamming(read, w)::INT AS mismatches, hamming(read, w)::INT AS edits, true AS valid FROM planted_reads JOIN planted USING (tag)", "planted", "planted_reads")
def realigned(s, d):
    """Mismatches recovered from the reference at the known place, as a Hamming script; the edit script of the same pair, checked."""
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    x = E.hamming_script(F.col("read"), F.col("w"))
    r = r.withColumn("x", x).withColumn("a", A.affine(F.col("read"), F.col("w"), "global", 0, 1, 0, 1, band=4))
    return r.select("tag", E.edit_distance(F.col("x")).alias("mismatches"), (-F.col("a.score")).alias("edits"), (A.script_fits(F.col("read"), F.col("w"), F.col("a.cigar")) & A.script_fits(F.col("read"), F.col("w"), E.render(F.col("x")))).alias("valid"))


@query("SNK_14_pretty_alignment", "SELECT tag, read || chr(10) || list_aggregate(list_transform(range(1, 33), lambda i: CASE WHEN read[i] = w[i] THEN '|' ELSE ' ' END), 'string_agg', '') || chr(10) || w AS shown FROM planted_reads JOIN planted USING (tag)", "planted", "planted_reads")
def shown(s, d):
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    return r.select("tag", T.pretty(F.col("read"), F.col("w")).alias("shown"))


@query("MTH_19_local_of_unmapped", "SELECT tag, 20 AS score FROM planted WHERE tag % 4 = 0", "planted")
def local_of_unmapped(s, d):
    """Reads with no piece of the text within four edits are aligned locally."""
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    r = r.withColumn("key", F.when(F.col("tag") % 4 == 0, F.concat(F.substring("w", 1, 20), F.repeat(F.lit("n"), 12))).otherwise(F.col("w")))
    r = r.withColumn("b", A.semi_global_distance(F.col("key"), F.col("text"), 4))
    return r.where("b.distance is null").select("tag", A.affine(F.col("key"), F.col("text"), "local")["score"].alias("score"))


@query("SRT_1_2_3_map_orders", "SELECT tag, seq_name, position, length, score, phred, row_number() OVER (PARTITION BY tag ORDER BY event_distance, score DESC, position, length, phred) AS by_distance, row_number() OVER (PARTITION BY tag ORDER BY seq_name, position, length, score, phred) AS by_place, row_number() OVER (PARTITION BY tag ORDER BY phred DESC, score, position, length) AS by_phred, row_number() OVER (PARTITION BY tag ORDER BY score, phred, position, length) AS by_score FROM maps", "maps")
def orders(s, d):
    n = lambda *k: F.row_number().over(W.partitionBy("tag").orderBy(*k))
    return V.parted(V.maps(s, d), "tag").select("tag", "seq_name", "position", "length", "score", "phred", n("event_distance", F.desc("score"), "position", "length", "phred").alias("by_distance"), n("seq_name", "position", "length", "score", "phred").alias("by_place"), n(F.desc("phred"), "score", "position", "length").alias("by_phred"), n("score", "phred", "position", "length").alias("by_score"))


@query("MTH_21_chained_alignment", GAPPED + "SELECT tag, max(length(read) - (6 + 32 - length(read)) - 5 * (hamming(substr(read, 1, o), substr(w, 1, o)) + hamming(substr(read, o + 1), right(w, length(read) - o))))::INT AS score, any_value(length(read))::INT AS read_length FROM c WHERE o BETWEEN 10 AND length(read) - 10 GROUP BY tag", "planted")
def chained(s, d):
    """The ends of a read are anchored; only what lies between is aligned, and its script stands between those of the anchors."""
    r = against_reference(s, d).withColumn("w", F.substring("text", (F.col("tag") * 7 % 90 + 1).cast("int"), F.lit(32)))
    r = r.withColumn("key", F.concat(F.substring("w", 1, 14), F.substring("w", (16 + F.col("tag") % 3).cast("int"), F.lit(32))))
    x = r.select("tag", A.chained(F.col("key"), F.col("w"), 10, 10).alias("x"))
    return x.select("tag", E.affine_score(F.col("x")).alias("score"), E.read_length(F.col("x")).alias("read_length"))


simple("SRC_15_cigar_parser", V.maps, lambda m: m.select("tag", "position", "length", "phred", "score", E.parse_cigar(F.concat(F.col("position").cast("string"), F.lit("M2I"), F.col("length").cast("string"), F.lit("=1X3D5S"))).alias("x")).select("tag", "position", "length", "phred", "score", F.size("x").alias("n"), F.get("x", F.lit(2))["len"].alias("third"), F.get("x", F.lit(5))["op"].alias("last")),
       "SELECT tag, position, length, phred, score, 6 AS n, length::INT AS third, 'S' AS last FROM maps", "maps")
