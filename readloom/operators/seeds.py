"""Approximate string joins: seeds by equality, then verification.

A pattern within e errors of a piece of text, cut into e // 2 + 1 pieces, has a piece that occurs with one error at most (pigeonhole). All texts
that a piece becomes by one error are looked up in the k-mer table, so the keys are long and few places other than matches have one: their
number follows reads times text only far below the k-th power of four. Texts with letters other than A, C, G and T, whose errors cannot be
listed, are met by e + 1 pieces without error. Each candidate window is then verified once.

A k-mer table has many rows a text; it is joined by merging, never broadcast, as estimates are those of the file that the texts come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.functions.alignment import semi_global_distance


def kmer_index(ref: DataFrame, k: int, wild: bool = False) -> DataFrame:
    """(kmer, seq_name, offset) of a reference (seq_name, text); k-mers with N are left out unless ``wild``."""
    at = ref.select("seq_name", F.inline(S.kmers(F.col("text"), k)))
    return (at if wild else at.where(~F.col("kmer").contains("N"))).hint("merge")


def kmer_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("kmer").agg(F.count("*").alias("n"))


def locator(ref: DataFrame) -> DataFrame:
    """(seq_name, begin, end): where each sequence lies in the concatenated text, in order of its name."""
    from pyspark.sql import Window as W

    w = W.orderBy("seq_name").rowsBetween(W.unboundedPreceding, 0)  # one row per sequence
    n = F.length("text").cast("long")
    return ref.select("seq_name", n.alias("n"), F.sum(n).over(w).alias("end")).select("seq_name", (F.col("end") - F.col("n")).alias("begin"), "end")


def to_location(positions: DataFrame, located: DataFrame, width: int = 4096) -> DataFrame:
    """Range join by bins: (pos) -> (pos, seq_name, offset). Sequences are exploded into the bins that they cover."""
    bins = located.withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    p = positions.withColumn("bin", F.floor(F.col("pos") / width))
    hit = p.join(bins, "bin").where((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("end")))
    return hit.select("pos", "seq_name", (F.col("pos") - F.col("begin")).alias("offset"))


KEY = 20  # bases of a key at most


def is_plain(text: str = "text") -> F.Column:
    return ~F.col(text).rlike("[^ACGT]")


def near_places(reads: DataFrame, ref: DataFrame, errors: int, length: int, indels: bool = False) -> DataFrame:
    """Columns of ``reads`` with (seq_name, offset): where a read of ``length`` begins if one of errors // 2 + 1 pieces lies in a plain text with one error at most.

    None within ``errors`` mismatches (edits, if ``indels``) is missing; edits before the piece move the read's begin by as many places.
    """
    parts = errors // 2 + 1
    size = length // parts
    k = min(size, KEY)
    piece = F.substring("read", F.col("at") + 1, F.lit(k))
    keys = F.array(piece) if errors == 0 else S.one_edit(piece) if indels else S.one_mismatch(piece)
    cut = reads.withColumn("at", F.explode(F.array(*[F.lit(i * size) for i in range(parts)]))).withColumn("kmer", F.explode(keys))
    hits = cut.join(kmer_index(ref.where(is_plain()), k - 1 if indels and errors else k, wild=True), "kmer")
    return hits.select(*reads.columns, "seq_name", (F.col("offset") - F.col("at")).alias("offset")).distinct()


def piece_places(reads: DataFrame, ref: DataFrame, errors: int, length: int) -> DataFrame:
    """The same by errors + 1 pieces without error, whatever the letters."""
    sizes = sorted({((i + 1) * length) // (errors + 1) - (i * length) // (errors + 1) for i in range(errors + 1)})
    cut = reads.select("*", F.inline(S.pieces(F.col("read"), errors + 1)).alias("at", "kmer"))
    found = None
    for k in sizes:
        hits = cut.where(F.length("kmer") == k).join(kmer_index(ref, k, wild=True), "kmer")
        found = hits if found is None else found.unionByName(hits)
    return found.select(*reads.columns, "seq_name", (F.col("offset") - F.col("at")).alias("offset")).distinct()


def places(reads: DataFrame, ref: DataFrame, errors: int, length: int, indels: bool = False) -> DataFrame:
    """Where reads may lie with up to ``errors`` errors: near_places in plain texts, piece_places in others."""
    return near_places(reads, ref, errors, length, indels).unionByName(piece_places(reads, ref.where(~is_plain()), errors, length))


def hamming_matches(reads: DataFrame, ref: DataFrame, errors: int, length: int) -> DataFrame:
    """(tag, seq_name, offset, distance) of all windows within ``errors`` mismatches of reads (tag, read) of ``length``."""
    windows = places(reads.select("tag", "read"), ref, errors, length).where("offset >= 0")
    texts = windows.join(ref, "seq_name").withColumn("window", F.substring("text", F.col("offset") + 1, F.lit(length)))
    plain = ~F.concat("read", "window").rlike("[^ACGT]") & (F.length("window") == length)
    exact = S.packed_hamming(S.packed(F.col("read"), length), S.packed(F.col("window"), length))
    distance = F.when(plain, exact).otherwise(S.hamming(F.col("read"), F.col("window")))
    return texts.withColumn("distance", distance).where(F.col("distance") <= errors).select("tag", "seq_name", "offset", "distance")


def region_profile(reads: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(tag, n_regions, candidates, most): fixed seeds of k with the number of their occurrences."""
    seeds = reads.select("tag", F.inline(S.kmers(F.col("read"), k, k)))
    met = seeds.join(counts, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.groupBy("tag").agg(F.count("*").alias("n_regions"), F.sum("n").alias("candidates"), F.max("n").alias("most"))


def cheapest_seeds(reads: DataFrame, counts: DataFrame, k: int, n: int) -> DataFrame:
    """The n seeds of each read with the fewest occurrences."""
    from pyspark.sql import Window as W

    seeds = reads.select("tag", F.inline(S.kmers(F.col("read"), k, k)))
    met = seeds.join(counts, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy("tag").orderBy("n", "offset")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("tag", "offset", "kmer", "n")


def to_position(places: DataFrame, located: DataFrame) -> DataFrame:
    """(seq_name, offset) -> pos in the concatenated text, with the sequence's begin and end."""
    return places.join(located, "seq_name").withColumn("pos", F.col("begin") + F.col("offset"))


def candidate_windows(placed: DataFrame, length: int, errors: int) -> DataFrame:
    """Adds least and most: the text in which a read at pos with up to ``errors`` edits lies, within its sequence."""
    return placed.withColumn("least", F.greatest("begin", F.col("pos") - errors)).withColumn("most", F.least("end", F.col("pos") + length + errors))


def edit_matches(reads: DataFrame, ref: DataFrame, errors: int, length: int) -> DataFrame:
    """(tag, seq_name, distance, stop) of each sequence with a piece within ``errors`` edits of a read, the nearest piece.

    Windows of candidates near each other are verified once, and each by a bit-parallel pass.
    """
    found = places(reads.select("tag", "read"), ref, errors, length, indels=True)
    step = length
    near = found.select("tag", "read", "seq_name", F.floor(F.greatest(F.col("offset"), F.lit(0)) / step).cast("int").alias("bin")).distinct()
    window = F.substring("text", F.greatest(F.col("bin") * step - errors, F.lit(0)) + 1, F.lit(2 * length + 3 * errors))
    checked = near.join(ref, "seq_name").select("tag", "seq_name", semi_global_distance(F.col("read"), window, errors).alias("hit"), (F.greatest(F.col("bin") * step - errors, F.lit(0))).alias("shift"))
    best = checked.where("hit.distance is not null").groupBy("tag", "seq_name").agg(F.min(F.struct(F.col("hit.distance").alias("distance"), (F.col("hit.stop") + F.col("shift")).alias("stop"))).alias("best"))
    return best.select("tag", "seq_name", "best.distance", "best.stop")


def select_seeds(reads: DataFrame, kind: str, counts: DataFrame | None = None, k: int = 20, n: int = 5) -> DataFrame:
    """(tag, offset, kmer) of the seeds of a strategy by name: fixed, factor or cheapest."""
    if kind == "fixed":
        return reads.select("tag", F.inline(S.kmers(F.col("read"), k, k)))
    if kind == "factor":
        return reads.select("tag", F.inline(S.pieces(F.col("read"), n)))
    if kind == "cheapest":
        return cheapest_seeds(reads, counts, k, n).select("tag", "offset", "kmer")
    raise ValueError(f"no seed strategy {kind!r}")


def write_index(index: DataFrame, path: str, by: int = 3) -> None:
    """A k-mer index as Parquet in parts by the first bases of the k-mer, sorted within, so that a look-up prunes parts and row groups."""
    index.withColumn("part", F.substring("kmer", 1, by)).repartition("part").sortWithinPartitions("part", "kmer").write.partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return (rows if part is None else rows.where(F.col("part") == part)).drop("part")


def verified_once(candidates: DataFrame, read: str, text: str) -> DataFrame:
    """Adds distance (mismatches): each different pair of texts is compared once, whatever the number of candidates that have it."""
    pairs = candidates.select(read, text).distinct().withColumn("distance", S.hamming(F.col(read), F.col(text)))
    return candidates.join(pairs, [read, text])
