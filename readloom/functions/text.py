"""Small text formats: sizes, fractions, lists, locations, trim attributes, alignments for reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_size(text: Column) -> Column:
    """4M -> 4194304: a number with K, M or G; null if it is none."""
    n = F.regexp_extract(text, r"^(\d+)[KMG]?$", 1).try_cast("bigint")
    unit = F.upper(F.regexp_extract(text, r"([KMG]?)$", 1))
    return n * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(F.lit(1)).cast("bigint")


def parse_fraction(text: Column, whole: Column) -> Column:
    """20% and 0.2 of ``whole``; a number of one or more as it is. Fractions are rounded down."""
    number = F.regexp_extract(text, r"^([\d.]+)%?$", 1).try_cast("double")
    share = F.when(text.endswith("%"), number / 100).when(number < 1, number)
    return F.coalesce(F.floor(share * whole + 1e-9), F.floor(number)).cast("bigint")


def parse_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def trim_attribute(raw: Column) -> dict[str, Column]:
    """lt:Z:3:ACG:III -> side (lt or rt), n, bases, quals."""
    part = lambda i: F.get(F.split(raw, ":"), F.lit(i))
    return {"side": part(0), "n": part(2).try_cast("int"), "bases": part(3), "quals": part(4)}


def location(raw: Column) -> dict[str, Column]:
    """seq:strand[:C2T or G2A]:pos:len, or the same apart by tabs; the strand as + and - or F and R."""
    f = F.split(raw, r"[:\t]")
    strand, third = F.get(f, F.lit(1)), F.get(f, F.lit(2))
    kind = F.when(third.rlike("^(C2T|G2A)"), F.substring(third, 1, 3))
    at = F.when(kind.isNotNull(), 3).otherwise(2)
    return {
        "seq": F.get(f, F.lit(0)), "strand": F.when(strand.isin("+", "F"), "+").when(strand.isin("-", "R"), "-"), "bisulfite": kind,
        "pos": F.get(f, at).try_cast("bigint"), "len": F.get(f, at + 1).try_cast("bigint"),
    }


def pretty(a: Column, b: Column) -> Column:
    """Three lines: both texts and a bar where they agree. A gap is a - in either."""
    bars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == "") & (y == ""), "").when(x == y, "|").otherwise(" "))
    return F.concat_ws("\n", a, F.array_join(bars, ""), b)
