"""Text records: FASTQ, MAP and SAM lines as columns and back, and readers of files of them.

Lines are read by Spark's text source, which splits files and decompresses by extension; parsing is column functions.
FASTA records are split by the source itself (``lineSep``), FASTQ records are put together by line number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions import edits as E
from readloom.functions.sequence import read_tag


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, text) of multi-line FASTA records."""
    record = F.regexp_replace("value", r"^>|\r", "")
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    name = F.regexp_extract(record, r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1), r"\s+", "")
    return rows.select(name.alias("seq_name"), F.upper(body).alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 0, however the files are split.

    A split yields its lines in order and knows its file and place. Lines are counted by split first, which gives each split the number of its first line.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for b in batches:
            out = []
            for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, at = k, at + 1 if k == key else 0
                out.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "own"])

    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    return rows.mapInArrow(number, "file string, block long, value string, own long").join(first, ["file", "block"]).select("file", (F.col("first") + F.col("own")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(tag, pair, casava, extra, read, qualities) of records of four lines.

    Quality lines may begin with @, so a split of a file cannot tell where a record begins; line numbers can. Splits stay as small as Spark makes them.
    """
    lines = numbered_lines(spark, path)
    of = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(of(0).alias("name"), of(1).alias("read"), of(3).alias("qualities"))
    records = records.where(F.col("name").startswith("@")).withColumn("name", F.substring("name", F.lit(2), F.length("name")))
    tag = read_tag(F.col("name"))
    return records.select(*[c.alias(n) for n, c in tag.items()], "read", "qualities")


def fasta_record(name: Column, text: Column, width: int = 60) -> Column:
    lines = F.regexp_replace(text, rf"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), name, F.lit("\n"), lines)


def write_text(rows: DataFrame, path: str, *order: str, compression: str = "none") -> None:
    """Write the column value as text files whose names are in the order of the sort columns, as are their lines."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.option("compression", compression).text(path)


def fastq_record(tag: Column, read: Column, qualities: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), tag), read, F.lit("+"), qualities)


def map_text(seq_name: str, strand: str, position: str, mismatches: str) -> Column:
    return F.concat_ws(":", seq_name, strand, F.col(position).cast("string"), mismatches)


def render_counters(counters: Column, complete: int | None = None) -> Column:
    """0:1+0: strata joined by colons; + follows the last complete stratum."""
    out = F.array_join(F.transform(counters, lambda x: x.cast("string")), ":")
    if complete is None:
        return out
    head = F.array_join(F.transform(F.slice(counters, 1, complete), lambda x: x.cast("string")), ":")
    tail = F.array_join(F.transform(F.slice(counters, F.lit(complete + 1), F.size(counters)), lambda x: x.cast("string")), ":")
    return F.when(F.size(counters) > complete, F.concat(head, F.lit("+"), tail)).otherwise(out)


def parse_counters(text: Column) -> dict[str, Column]:
    """Counters, the number of complete strata (null without +) and the not-unique flag of 0:1+0x3 or !."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:x\d+)?)"), F.lit(1))

    def spread(t: Column) -> Column:
        n = F.regexp_extract(t, r"^(\d+)", 1).cast("bigint")
        times = F.regexp_extract(t, r"x(\d+)$", 1)
        return F.array_repeat(n, F.when(times == "", 1).otherwise(times.cast("int")))

    before = F.regexp_extract(text, r"^([^+]*)\+", 1)
    complete = F.size(F.flatten(F.transform(F.regexp_extract_all(before, F.lit(r"(\d+(?:x\d+)?)"), F.lit(1)), spread)))
    return {
        "counters": F.flatten(F.transform(parts, spread)),
        "mcs": F.when(text.contains("+"), complete),
        "not_unique": text == "!",
    }


def parse_maps(text: Column) -> Column:
    """Array of (seq_name, strand, position, mismatches) of a maps field; empty for -."""
    items = F.filter(F.split(text, ","), lambda m: (m != "-") & (m != ""))

    def one(m: Column) -> Column:
        f = F.split(m, ":")
        return F.struct(
            f[0].alias("seq_name"), f[1].alias("strand"), f[2].cast("bigint").alias("position"), F.get(f, F.lit(3)).alias("mismatches")
        )

    return F.transform(items, one)


def parse_map_lines(lines: DataFrame) -> DataFrame:
    """(tag, pair, read, qualities, counters, mcs, not_unique, maps) of MAP lines in the column value; qualities may be absent."""
    f = F.split("value", "\t")
    full = F.size(f) >= 5
    tag = read_tag(f[0])
    at = parse_counters(F.when(full, F.get(f, F.lit(3))).otherwise(F.get(f, F.lit(2))))
    maps = parse_maps(F.when(full, F.get(f, F.lit(4))).otherwise(F.get(f, F.lit(3))))
    return lines.select(
        tag["tag"].alias("tag"), tag["pair"].alias("pair"), f[1].alias("read"), F.when(full, f[2]).alias("qualities"),
        *[c.alias(n) for n, c in at.items()], maps.alias("maps"),
    )


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_map_lines(spark.read.text(path).where(F.trim("value") != ""))


def sam_line(**fields: Column) -> Column:
    order = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")
    return F.concat_ws("\t", *[fields[n].cast("string") for n in order if n in fields])


def parse_sam_lines(lines: DataFrame) -> DataFrame:
    """The eleven core columns, script (of the CIGAR) and tags (name -> value) of SAM lines; header lines are left out."""
    f = F.split("value", "\t")
    text = {n: f[i] for i, n in ((0, "qname"), (2, "rname"), (5, "cigar"), (6, "rnext"), (9, "seq"), (10, "qual"))}
    whole = {n: f[i].cast("bigint") for i, n in ((1, "flag"), (3, "pos"), (4, "mapq"), (7, "pnext"), (8, "tlen"))}
    pairs = F.transform(F.filter(f, lambda x, i: i >= 11), lambda t: F.struct(F.split(t, ":", 3)[0], F.split(t, ":", 3)[2]))
    cols = {**text, **whole, "script": E.parse_cigar(f[5]), "tags": F.map_from_entries(pairs)}
    return lines.where(~F.col("value").startswith("@")).select(*[c.alias(n) for n, c in cols.items()])


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam_lines(spark.read.text(path).where(F.trim("value") != ""))


def detect_format(spark: SparkSession, path: str) -> str:
    """fasta, fastq, sam or map, by the first line that is not blank."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    line = "" if first is None else first.value
    if line.startswith(">"):
        return "fasta"
    if line.startswith("@"):
        return "sam" if line[1:3] in ("HD", "SQ", "RG", "PG", "CO") and line[3:4] == "\t" else "fastq"
    return "sam" if len(line.split("\t")) >= 11 else "map"


def read_alignments(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    readers = {"fasta": read_fasta, "fastq": read_fastq, "sam": read_sam, "map": read_map}
    return readers[kind or detect_format(spark, path)](spark, path)


def parse_old_split(text: Column) -> Column:
    """[26]=chr7:R1203797~chr8:F5 -> struct (at, donor, acceptor), each of these a (seq_name, strand, position)."""

    def place(t: Column) -> Column:
        strand = F.when(F.regexp_extract(t, ":([FR])", 1) == "F", "+").otherwise("-")
        return F.struct(F.regexp_extract(t, "^([^:]*):", 1).alias("seq_name"), strand.alias("strand"), F.regexp_extract(t, r":[FR](\d+)", 1).try_cast("bigint").alias("position"))

    both = F.split(F.regexp_extract(text, r"^\[\d+\]=(.*)$", 1), "~")
    return F.struct(F.regexp_extract(text, r"^\[(\d+)\]", 1).try_cast("int").alias("at"), place(F.get(both, F.lit(0))).alias("donor"), place(F.get(both, F.lit(1))).alias("acceptor"))


def parse_mismatches_v0(text: Column, length: Column) -> Column:
    """A30C34 -> array of (op, len) for a read of ``length``: each mismatch by its base and its place from 1."""
    at = F.transform(F.regexp_extract_all(text, F.lit(r"[ACGTN](\d+)"), F.lit(1)), lambda x: x.cast("int"))
    ends = F.concat(at, F.array((length + 1).cast("int")))
    one = lambda x, i: F.array(F.struct(F.lit("M").alias("op"), (x - 1 - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))).alias("len")), F.struct(F.lit("X").alias("op"), F.when(i < F.size(at), 1).otherwise(0).alias("len")))
    return E.merged(F.flatten(F.transform(ends, one)))


def parse_bed(lines: DataFrame) -> DataFrame:
    """(seq_name, begin, end) of BED lines in the column value; further fields are left out."""
    f = F.split("value", "\t")
    return lines.where(~F.col("value").rlike("^(#|track|browser)")).select(f[0].alias("seq_name"), f[1].cast("bigint").alias("begin"), f[2].cast("bigint").alias("end"))


def parse_candidates(lines: DataFrame) -> DataFrame:
    """(read, seq_name, strand, position): lines of a read and its candidate places, apart by tabs."""
    f = F.split("value", "\t")
    rows = lines.select(f[0].alias("read"), F.explode(F.slice(f, F.lit(2), F.size(f))).alias("place"))
    p = F.split("place", ":")
    return rows.select("read", p[0].alias("seq_name"), p[1].alias("strand"), p[2].cast("bigint").alias("position"))


def parse_templates(text: Column) -> Column:
    """Array of paired maps a::b:::score of a maps field, each end seq:strand:pos:mismatches[:score]."""

    def one(t: Column) -> Column:
        total = F.get(F.split(t, ":::"), F.lit(1)).try_cast("bigint")
        ends = F.split(F.get(F.split(t, ":::"), F.lit(0)), "::")
        a, b = (F.split(F.get(ends, F.lit(i)), ":") for i in (0, 1))
        return F.struct(
            a[0].alias("seq1"), a[1].alias("strand1"), a[2].cast("bigint").alias("pos1"), F.get(a, F.lit(4)).try_cast("bigint").alias("score1"),
            F.get(b, F.lit(0)).alias("seq2"), F.get(b, F.lit(1)).alias("strand2"), F.get(b, F.lit(2)).try_cast("bigint").alias("pos2"), total.alias("total"),
        )

    return F.transform(F.filter(F.split(text, ","), lambda t: (t != "-") & (t != "")), one)


def maps_by_stratum(maps: DataFrame) -> DataFrame:
    """(tag, maps, counters): the maps of a read stratum by stratum, and their number in each."""
    text = F.concat_ws(":", "seq_name", "strand", F.col("position").cast("string"))
    per = maps.groupBy("tag", "event_distance").agg(F.sort_array(F.collect_list(text)).alias("m"))
    rows = per.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("event_distance", "m"))).alias("s"))
    at = F.sequence(F.lit(0), F.array_max(F.transform("s", lambda x: x["event_distance"])))
    count = lambda d: F.aggregate(F.filter(F.col("s"), lambda x: x["event_distance"] == d), F.lit(0), lambda n, x: n + F.size(x["m"]))
    return rows.select("tag", F.array_join(F.flatten(F.transform("s", lambda x: x["m"])), ",").alias("maps"), F.array_join(F.transform(at, lambda d: count(d).cast("string")), ":").alias("counters"))
