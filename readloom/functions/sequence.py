"""String functions on DNA sequences and quality strings; all built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def is_dna(s: Column) -> Column:
    return s.rlike("^[ACGTNacgtn]+$")


def uniform_content(s: Column) -> Column:
    """Upper case, everything but ACGT as N, without leading and trailing N."""
    return F.regexp_replace(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), "^N+|N+$", "")


def hard_trim(s: Column, left: int, right: int, least: int = 0) -> Column:
    """Cut both ends if at least ``least`` bases remain."""
    n = F.length(s) - left - right
    return F.when(n >= max(least, 1), F.substring(s, F.lit(left + 1), n)).otherwise(s if least else F.lit(""))


def trim_tag(s: Column, quals: Column, left: int) -> Column:
    """What a left trim cut, as an annotation n:BASES:QUALS."""
    return F.concat_ws(":", F.lit(str(left)), F.substring(s, 1, left), F.substring(quals, 1, left))


def restore_trim(s: Column, tag: Column) -> Column:
    return F.concat(F.split_part(tag, F.lit(":"), F.lit(2)), s)


def shift_qualities(q: Column, by: int) -> Column:
    """Every quality character moved by ``by`` (-31: offset 64 to 33)."""
    return F.array_join(F.transform(F.split(q, ""), lambda c: F.when(c == "", c).otherwise(F.char(F.ascii(c) + by))), "")


def quality_values(q: Column, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def quality_offset(lowest: Column) -> Column:
    """33 or 64 by the lowest character code of a file."""
    return F.when(lowest < 59, F.lit(33)).otherwise(F.lit(64))


def run_length(s: Column, most: int = 1) -> Column:
    """Homopolymers longer than ``most`` shortened to it."""
    return F.regexp_replace(s, rf"(.)\1{{{most},}}", "$1" * most)


def bisulfite(s: Column, kind: str = "C2T") -> Column:
    return F.translate(s, "C", "T") if kind == "C2T" else F.translate(s, "G", "A")


def count_base(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def chunks(s: Column, size: int, step: int) -> Column:
    """Array of (segment, text): windows of ``size`` each ``step``, whole ones only; the read itself if it is shorter."""
    last = F.greatest(F.length(s) - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i, k: F.struct(k.alias("segment"), F.substring(s, i + 1, F.lit(size)).alias("text")))


def kmers(s: Column, k: int, step: int = 1) -> Column:
    """Array of (offset, kmer), offsets from 0; empty if the sequence is shorter than k."""
    n = F.length(s)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("offset"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))


def pieces(s: Column, n: int) -> Column:
    """Array of (offset, kmer): n near-equal pieces that cover the sequence (remaining length / remaining pieces)."""
    length = F.length(s)

    def piece(i: Column) -> Column:
        begin, end = F.floor(i * length / n).cast("int"), F.floor((i + 1) * length / n).cast("int")
        return F.struct(begin.alias("offset"), F.substring(s, begin + 1, end - begin).alias("kmer"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), piece)


def one_mismatch(s: Column) -> Column:
    """Array of the sequence and of all that one base A, C, G or T in place of another makes of it."""
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    swap = lambda i, b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.length(s)))
    each = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.transform(F.filter(bases, lambda b: b != F.substring(s, i, F.lit(1))), lambda b: swap(i, b)))
    return F.concat(F.array(s), F.flatten(each))


def one_edit(s: Column) -> Column:
    """Array of the first k - 1 bases of the sequence of k and of all that one edit makes of it; what begins with another base inserted is left out, as the sequence itself follows."""
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    cut = F.length(s) - 1
    put = lambda i, b: F.concat(F.substring(s, F.lit(1), i), b, F.substring(s, i + 1, cut - i - 1))
    swapped = F.transform(one_mismatch(s), lambda t: F.substring(t, F.lit(1), cut))
    without = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    longer = F.flatten(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.transform(bases, lambda b: put(i, b))))
    return F.array_distinct(F.concat(swapped, without, longer))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two sequences of the same length; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


_WORD_BASES = 31


def packed(s: Column, length: int) -> list[Column]:
    """Two bits a base, as many bigints as ``length`` bases need; for sequences of A, C, G and T alone."""
    parts = range(0, length, _WORD_BASES)
    return [F.conv(F.translate(F.substring(s, at + 1, min(_WORD_BASES, length - at)), "ACGT", "0123"), 4, 10).cast("bigint") for at in parts]


def packed_hamming(a: list[Column], b: list[Column]) -> Column:
    """Mismatches of two packed sequences: pairs of bits that differ."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        out = out + F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(F.lit(0x1555555555555555)))
    return out.cast("int")


def read_tag(raw: Column) -> dict[str, Column]:
    """Tag, mate (0, 1, 2, 3), CASAVA field and the rest of a record's name line."""
    first = F.regexp_extract(raw, r"^(\S+)", 1)
    second = F.regexp_extract(raw, r"^\S+\s+(\S+)", 1)
    casava = F.when(second.rlike("^[123]:[^:]*:[^:]*:[^:]*$"), second)
    own = F.regexp_extract(first, "/([123])$", 1)
    extra = F.regexp_extract(raw, r"^\S+\s+(.*)$", 1)
    extra = F.when(casava.isNotNull(), F.regexp_extract(raw, r"^\S+\s+\S+\s+(.*)$", 1)).otherwise(extra)
    return {
        "tag": F.regexp_replace(first, "/[123]$", ""),
        "pair": F.when(own != "", own.cast("int")).when(casava.isNotNull(), F.substring(casava, 1, 1).cast("int")).otherwise(0),
        "casava": casava,
        "extra": F.when(extra != "", extra),
    }


def clipped(s: Column, mode: str, left: int = 0, right: int = 0) -> Column:
    """The effective part of a read: without N ends (uncalled), without lower-case ends (masked), without fixed ends, or whole (none)."""
    if mode == "uncalled":
        return F.regexp_replace(s, "^N+|N+$", "")
    if mode == "masked":
        return F.regexp_replace(s, "^[a-z]+|[a-z]+$", "")
    return F.substring(s, F.lit(left + 1), F.greatest(F.length(s) - left - right, F.lit(0))) if mode == "fixed" else s


def wildcards(s: Column) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, "[^ACGTacgt]", ""))


def runs(s: Column) -> Column:
    """Array of (begin, len) of the homopolymers of a sequence."""
    n = F.length(s)
    base = lambda i: F.substring(s, i + 1, F.lit(1))
    begins = F.filter(F.sequence(F.lit(0), F.when(n > 0, n - 1).otherwise(n)), lambda i: (i < n) & ((i == 0) | (base(i) != base(i - 1))))
    last = lambda t, i: F.coalesce(F.get(t, i + 1), n)
    return F.get(F.transform(F.array(begins), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("begin"), (last(t, i) - x).alias("len")))), F.lit(0))


def index_texts(s: Column) -> dict[str, Column]:
    """The texts that an index holds of a sequence: both strands, and each with C as T and with G as A."""
    both = {"F": s, "R": reverse_complement(s)}
    return {**both, **{f"{n}:{k}": bisulfite(t, k) for k in ("C2T", "G2A") for n, t in both.items()}}


def called_intervals(s: Column, least: int = 50) -> Column:
    """Array of (begin, stop, called): runs of ``least`` N or more are uncalled, what lies between is called."""
    parts = F.regexp_extract_all(s, F.lit(rf"(N{{{least},}}|(?:(?!N{{{least},}}).)+)"), F.lit(1))
    at = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda t, x: t + F.length(x))
    return F.transform(parts, lambda p, i: F.struct(at(i).alias("begin"), (at(i) + F.length(p)).alias("stop"), (~p.rlike(f"^N{{{least},}}$")).alias("called")))
