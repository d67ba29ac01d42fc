"""SAM headers, paired rows, optional fields and alternative hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import pairs as P
from readloom.sources.records import sam_line


def header(sequences: DataFrame, sort_order: str = "unknown", read_group: dict[str, str] | None = None, program: dict[str, str] | None = None) -> DataFrame:
    """(place, name, line) of a header for sequences (seq_name, length); sort by place and name to write it."""
    fields = lambda d: "".join(f"\t{k}:{v}" for k, v in d.items())
    own = [(0, "@HD" + fields({"VN": "1.6", "SO": sort_order})), *[(i, k + fields(d)) for i, k, d in ((2, "@RG", read_group), (3, "@PG", program)) if d]]
    fixed = sequences.sparkSession.createDataFrame([(i, "", x) for i, x in own], "place int, name string, line string")
    line = F.concat(F.lit("@SQ\tSN:"), "seq_name", F.lit("\tLN:"), F.col("length").cast("string"))
    return sequences.select(F.lit(1).alias("place"), F.col("seq_name").alias("name"), line.alias("line")).unionByName(fixed)


def parse_header(lines: DataFrame) -> DataFrame:
    """(kind, fields) of the header lines among SAM lines in the column value."""
    parts = F.split("value", "\t")
    pairs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(4), F.length(x))))
    return lines.where(F.col("value").rlike("^@(HD|SQ|RG|PG)\t")).select(F.substring(parts[0], 2, 2).alias("kind"), F.map_from_entries(pairs).alias("fields"))


def optional_fields(texts: Column) -> Column:
    """Map from tag to (type, value) of fields TG:T:value; the value may hold colons."""
    split = lambda t: F.split(t, ":", 3)
    return F.map_from_entries(F.transform(texts, lambda t: F.struct(split(t)[0], F.struct(split(t)[1].alias("type"), split(t)[2].alias("value")))))


def expand_xa(rows: DataFrame) -> DataFrame:
    """A row for each alternative hit name,+position,cigar,distance; of the column xa, with the row's other columns."""
    hits = F.filter(F.split("xa", ";"), lambda x: x != "")
    f = F.split("readloom_hit", ",")
    rows = rows.withColumn("readloom_hit", F.explode(hits)).withColumns({
        "seq_name": f[0], "strand": F.substring(f[1], 1, 1), "position": F.substring(f[1], F.lit(2), F.length(f[1])).cast("bigint"), "cigar": f[2], "distance": f[3].cast("int"),
    })
    return rows.drop("readloom_hit", "xa")


_TYPES = {"NH": "i", "NM": "i", "AS": "i", "MQ": "i", "XT": "A", "RG": "Z", "MD": "Z", "XA": "Z", "XS": "A"}


def tags(values: dict[str, Column]) -> Column:
    """TG:T:value fields apart by tabs; those whose value is null are left out. What a tag holds is computed only where it is asked for."""
    return F.concat_ws("\t", *[F.concat(F.lit(f"{n}:{_TYPES.get(n, 'Z')}:"), v.cast("string")) for n, v in values.items()])


def printed(bag: Column) -> Column:
    """The attributes of a map column as name=value, in order of their names."""
    names = F.array_sort(F.map_keys(bag))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), F.element_at(bag, n))), " ")


def paired_lines(pairs: DataFrame) -> DataFrame:
    """Two lines (value) for each pair of candidate_pairs(): flags of both ends, the mate's place, the signed template length."""

    def line(i: int) -> Column:
        own, mate = (lambda c, k=k: F.col(f"{c}{k}") for k in (i, 3 - i))
        yes = F.lit(True)
        flag = P.sam_flag(yes, yes, own("strand") == "-", yes, mate("strand") == "-", F.col("relation") == "concordant", F.lit(i == 1), F.lit(False))
        first = F.col("position1") <= F.col("position2") if i == 1 else F.col("position1") > F.col("position2")
        return sam_line(
            qname=F.col("tag"), flag=flag, rname=F.col("seq_name"), pos=own("position"), mapq=own("phred"), cigar=F.concat(own("length").cast("string"), F.lit("M")), rnext=F.lit("="),
            pnext=mate("position"), tlen=F.when(first, F.col("template_length")).otherwise(-F.col("template_length")), seq=F.lit("*"), qual=F.lit("*"), tags=F.concat(F.lit("NM:i:"), own("event_distance").cast("string")),
        )

    return pairs.select(F.explode(F.array(line(1), line(2))).alias("value"))
