"""Folds over edit scripts: arrays of struct(op, len, base) with op in M, X, I, D, S, and CIGAR and mismatch strings.

What merges neighbours runs over Arrow batches: as a fold of lambda functions it takes some 50 us a script.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cigar(cigar: Column) -> Column:
    """12M1D3M -> array of (op, len)."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def parse_mismatches(text: Column) -> Column:
    """5A3>2+1 -> array of (op, len): match runs, mismatches (X), insertions (I), deletions (D), splices (N), trims (S)."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\d+|[ACGTN]|>\d+[-+*/]|\(\d+\))"), F.lit(1))

    def element(t: Column) -> Column:
        n = F.regexp_extract(t, r"(\d+)", 1)
        op = (
            F.when(t.rlike("^[ACGTN]$"), "X").when(t.rlike(r"^>\d+\+$"), "I").when(t.rlike("^>\\d+-$"), "D")
            .when(t.rlike("^>"), "N").when(t.startswith("("), "S").otherwise("M")
        )
        return F.struct(op.alias("op"), F.when(n == "", 1).otherwise(n.cast("int")).alias("len"))

    return F.transform(tokens, element)


def _total(script: Column, weight) -> Column:
    return F.aggregate(F.transform(script, weight), F.lit(0), lambda s, x: s + x)


def _in(e: Column, ops: str) -> Column:
    return e["op"].isin(*ops)


def parse_md(md: Column) -> Column:
    """10A5^AC6 -> array of (op, len, base): matches, mismatches (X) and deletions (D) with the bases of the reference."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))

    def element(t: Column) -> Column:
        op = F.when(t.rlike("^[0-9]"), "M").when(t.startswith("^"), "D").otherwise("X")
        size = F.when(op == "M", t.try_cast("int")).otherwise(F.length(F.replace(t, F.lit("^"), F.lit(""))))
        return F.struct(op.alias("op"), size.alias("len"), F.when(op != "M", F.replace(t, F.lit("^"), F.lit(""))).alias("base"))

    return F.filter(F.transform(tokens, element), lambda e: e["len"] > 0)


class Scripts:
    """A batch of scripts as flat arrays: the row, kind (a number among ``names``) and length of each element."""

    def __init__(self, lists: pa.Array) -> None:
        self.n, self.none = len(lists), np.asarray(lists.is_null())
        flat = lists.flatten()
        kinds = flat.field("op").dictionary_encode()
        self.names, self.op, self.len = kinds.dictionary.to_pylist(), np.asarray(kinds.indices), np.asarray(flat.field("len"))
        self.row = np.repeat(np.arange(self.n), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))

    def kind(self, *names: str) -> np.ndarray:
        return np.isin(self.op, [i for i, n in enumerate(self.names) if n in names])

    def number(self, name: str) -> int:
        if name not in self.names:
            self.names.append(name)
        return self.names.index(name)

    def kept(self, which: np.ndarray) -> None:
        self.row, self.op, self.len = self.row[which], self.op[which], self.len[which]

    def join(self) -> None:
        """Neighbours of one kind become one element."""
        if len(self.row):
            fresh = np.ones(len(self.row), bool)
            fresh[1:] = (self.row[1:] != self.row[:-1]) | (self.op[1:] != self.op[:-1])
            at = np.flatnonzero(fresh)
            self.row, self.op, self.len = self.row[at], self.op[at], np.add.reduceat(self.len, at)

    def lists(self, values: pa.Array) -> pa.Array:
        """``values``, one for each element, as a list for each row."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=self.n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(self.none) if self.none.any() else None)

    def ops(self) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(self.op))

    def out(self) -> pa.Array:
        return self.lists(pa.StructArray.from_arrays([self.ops(), pa.array(self.len.astype(np.int32))], ["op", "len"]))


def merged(script: Column) -> Column:
    """Neighbours of one kind as one element, empty elements left out."""

    @F.arrow_udf("array<struct<op:string,len:int>>")
    def run(lists: pa.Array) -> pa.Array:
        x = Scripts(lists)
        x.kept(x.len > 0)
        x.join()
        return x.out()

    return run(script)


def curated(script: Column, least: int) -> Column:
    """Weak ends as trims: what lies before the first and behind the last match of ``least`` bases; neighbours merged. Without such a match all is one trim."""

    @F.arrow_udf("array<struct<op:string,len:int>>")
    def run(lists: pa.Array) -> pa.Array:
        x = Scripts(lists)
        strong = np.flatnonzero(x.kind("M") & (x.len >= least))
        first, last = np.full(x.n, len(x.row)), np.full(x.n, -1)
        np.minimum.at(first, x.row[strong], strong)
        np.maximum.at(last, x.row[strong], strong)
        at = np.arange(len(x.row))
        weak = (at < first[x.row]) | (at > last[x.row])
        x.len = np.where(weak & ~x.kind("M", "X", "I", "S"), 0, x.len)
        x.op = np.where(weak, x.number("S"), x.op)
        x.kept(x.len > 0)
        x.join()
        return x.out()

    return run(script)


def fixed_score(script: Column, length: Column) -> Column:
    """length - 4 a mismatch - (6 + n) an indel of n; matches are not counted again."""
    return length - _total(script, lambda e: F.when(_in(e, "X"), e["len"] * 4).when(_in(e, "ID"), e["len"] + 6).otherwise(0))


def indel_counts(script: Column) -> tuple[Column, Column]:
    return F.size(F.filter(script, lambda e: _in(e, "I"))), F.size(F.filter(script, lambda e: _in(e, "D")))


def read_offsets(script: Column) -> Column:
    """Offset in the read at which each element begins."""
    return F.transform(script, lambda e, i: F.aggregate(F.slice(script, F.lit(1), i), F.lit(0), lambda s, x: s + F.when(_in(x, "MXIS"), x["len"]).otherwise(0)))


def mismatch_qualities(script: Column, qualities: Column, offset: int = 33) -> Column:
    """Array of the qualities of mismatched bases (X elements are one base each)."""
    at = F.filter(F.zip_with(script, read_offsets(script), lambda e, o: F.when(_in(e, "X"), o)), lambda o: o.isNotNull())
    return F.transform(at, lambda o: F.ascii(F.substring(qualities, o + 1, F.lit(1))) - offset)


def error_quality(script: Column, qualities: Column, most: int = 60, offset: int = 33) -> Column:
    """Mean quality of the bases at mismatches and indels, those at either end left out; ``most`` if there is none."""
    inner = F.zip_with(script, read_offsets(script), lambda e, o: F.struct(e["op"].alias("op"), o.alias("at")))
    n = F.size(script)
    inner = F.filter(inner, lambda e, i: (e["op"] == "X") | (e["op"].isin("I", "D") & (i > 0) & (i < n - 1)))
    values = F.transform(inner, lambda e: (F.ascii(F.substring(qualities, e["at"] + 1, F.lit(1))) - offset).cast("double"))
    return F.when(F.size(values) == 0, F.lit(float(most))).otherwise(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def render_md(script: Column, bases: Column) -> Column:
    """MD text of a script whose X and D elements have the reference's bases in ``bases``, element by element."""
    kinds = F.zip_with(script, bases, lambda e, b: F.struct(e["op"].alias("op"), e["len"].alias("len"), b.alias("base")))
    init = F.struct(F.lit("").alias("done"), F.lit(0).alias("run"))

    def step(s: Column, e: Column) -> Column:
        mark = F.when(e["op"] == "D", F.concat(F.lit("^"), e["base"])).otherwise(e["base"])
        more = F.struct(F.concat(s["done"], s["run"].cast("string"), mark).alias("done"), F.lit(0).alias("run"))
        same = F.struct(s["done"].alias("done"), (s["run"] + F.when(e["op"] == "M", e["len"]).otherwise(0)).alias("run"))
        return F.when(e["op"].isin("X", "D"), more).otherwise(same)

    return F.aggregate(kinds, init, step, lambda s: F.concat(s["done"], s["run"].cast("string")))


def event_distance(script: Column) -> Column:
    """Number of elements that are neither match nor trim."""
    return F.size(F.filter(script, lambda e: _in(e, "XIDN")))


def edit_distance(script: Column) -> Column:
    """Mismatches count 1 each, insertions and deletions their length."""
    return _total(script, lambda e: F.when(_in(e, "XID"), e["len"]).otherwise(0))


def edit_distance_inner(script: Column) -> Column:
    """The same without deletions at either end."""
    n = F.size(script)
    return F.aggregate(
        F.transform(script, lambda e, i: F.when(_in(e, "XI") | (_in(e, "D") & (i > 0) & (i < n - 1)), e["len"]).otherwise(0)),
        F.lit(0), lambda s, x: s + x,
    )


def matching_bases(script: Column) -> Column:
    return _total(script, lambda e: F.when(_in(e, "M"), e["len"]).otherwise(0))


def read_length(script: Column) -> Column:
    return _total(script, lambda e: F.when(_in(e, "MXIS"), e["len"]).otherwise(0))


def reference_length(script: Column) -> Column:
    return _total(script, lambda e: F.when(_in(e, "MXDN"), e["len"]).otherwise(0))


def affine_score(script: Column, match: int = 1, mismatch: int = 4, gap_open: int = 6, gap_extend: int = 1) -> Column:
    return _total(
        script,
        lambda e: F.when(_in(e, "M"), e["len"] * match).when(_in(e, "X"), e["len"] * -mismatch)
        .when(_in(e, "ID"), -(e["len"] * gap_extend + gap_open)).otherwise(0),
    )


def score_bounds(length: Column, edits: Column, match: int = 1, mismatch: int = 4, gap_open: int = 6, gap_extend: int = 1) -> tuple[Column, Column]:
    """(least, most) affine score of an alignment of ``length`` read bases with ``edits`` edits."""
    worst = max(mismatch + match, gap_open + gap_extend + match)
    best = min(mismatch + match, gap_extend)
    one_gap = F.when(edits > 0, F.lit(gap_open)).otherwise(F.lit(0))
    return length * match - edits * worst, F.greatest(length * match - edits * (mismatch + match), length * match - one_gap - edits * best)


def render_sam_cigar(script: Column) -> Column:
    """CIGAR with mismatches as M; neighbours of one kind are merged."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        x = Scripts(lists)
        x.op = np.where(x.kind("X"), x.number("M"), x.op)
        x.join()
        x.kept(x.len > 0)
        return pc.binary_join(x.lists(pc.binary_join_element_wise(pa.array(x.len).cast(pa.string()), x.ops(), "")), "")

    return run(script)


def hamming_script(read: Column, text: Column) -> Column:
    """The script of a read and a text of its length: matches and mismatches only."""
    pairs = F.zip_with(F.filter(F.split(read, ""), lambda c: c != ""), F.filter(F.split(text, ""), lambda c: c != ""), lambda a, b: F.struct(F.when(a == b, "M").otherwise("X").alias("op"), F.lit(1).alias("len")))
    return merged(pairs)


def render(script: Column) -> Column:
    """The script as text, operation by operation."""
    return F.array_join(F.transform(script, lambda e: F.concat(e["len"].cast("string"), e["op"])), "")
