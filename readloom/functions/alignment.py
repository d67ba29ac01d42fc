"""Alignment of reads to texts in Arrow batches: bit-parallel edit distance and affine-gap dynamic programming.

Both run over all rows of a batch at once, column by column of the matrix, so a cell costs a few vector operations for a whole batch. Spark has
built-in functions for the global edit distance only; these are the semi-global, local and affine forms, and their edit scripts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import edits as E

CELLS = 1 << 25  # of the trace that is held at once
_NONE = -(1 << 28)
ALIGNED = "score int, begin int, stop int, cigar string"


def codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of characters for each text, padded; lengths)."""
    lens = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), max(int(lens.max(initial=0)), 1)), pad, np.uint8)
    for i, t in enumerate(texts):
        out[i, : lens[i]] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
    return out, lens


def edit_columns(keys: list[str], texts: list[str]) -> np.ndarray:
    """Least edit distance of each key to any piece of its text that ends at each column; row i holds as many as text i has, then a large number.

    Myers' bit-parallel form in words of 63 bits; the carry of the addition passes from word to word.
    """
    k, lens = codes(keys, 0)
    t, text_lens = codes(texts, 1)
    n, words = len(keys), max(1, -(-int(lens.max(initial=1)) // 63))
    one, low = np.uint64(1), np.uint64((1 << 63) - 1)
    alphabet = np.unique(t)
    equal = np.zeros((len(alphabet), words, n), np.uint64)
    for i in range(k.shape[1]):
        equal[:, i // 63] |= (k[:, i] == alphabet[:, None]).astype(np.uint64) << np.uint64(i % 63)
    which = np.searchsorted(alphabet, t)
    plus, minus = np.full((words, n), low, np.uint64), np.zeros((words, n), np.uint64)
    score, rows = lens.copy(), np.arange(n)
    last_word, last_bit = (np.maximum(lens - 1, 0) // 63), (np.maximum(lens - 1, 0) % 63).astype(np.uint64)
    out = np.full((n, t.shape[1]), 1 << 30, np.int64)
    for j in range(t.shape[1]):
        carry = up = down = np.zeros(n, np.uint64)
        for w in range(words):
            eq = equal[which[:, j], w, rows]
            xv = eq | minus[w]
            total = (eq & plus[w]) + plus[w] + carry
            carry = total >> np.uint64(63)
            xh = ((total & low) ^ plus[w]) | eq
            ph, mh = minus[w] | (~(xh | plus[w]) & low), plus[w] & xh
            here = last_word == w
            score += here * ((ph >> last_bit & one).astype(np.int64) - (mh >> last_bit & one).astype(np.int64))
            next_up, next_down = ph >> np.uint64(62), mh >> np.uint64(62)
            ph, mh = (ph << one | up) & low, (mh << one | down) & low
            up, down = next_up, next_down
            plus[w], minus[w] = mh | (~(xv | ph) & low), ph & xv
        out[:, j] = np.where(j < text_lens, np.where(lens > 0, score, 0), 1 << 30)
    return out


def affine_batch(keys: list[str], texts: list[str], mode: str, scores: tuple[int, int, int, int], band: int | None) -> list[tuple]:
    """(score, begin, stop, cigar) of each pair. See affine()."""
    match, mismatch, gap_open, gap_extend = scores
    k, m = codes(keys, 0)
    t, width = codes(texts, 1)
    n, most, wide = len(keys), k.shape[1], t.shape[1]
    local, free = mode == "local", mode != "global"
    trace = np.zeros((most + 1, wide + 1, n), np.uint8)
    gap = lambda x: -(gap_open + gap_extend * x) if x else 0
    h = [np.full(n, 0 if free else gap(j)) for j in range(wide + 1)]
    trace[0, 1:] = 3 if free else 1 | 4
    trace[0, 0] = 3
    if wide and not free:
        trace[0, 1] = 1
    f = [np.full(n, _NONE) for _ in range(wide + 1)]
    best, at_i, at_j = np.full(n, 0 if local else _NONE), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def consider(i: int, j: int, value: np.ndarray) -> None:
        ends = (j <= width) & (i <= m) if local else (i == m) & ((j <= width) if free else (j == width))
        better = ends & (value > best)
        best[better], at_i[better], at_j[better] = value[better], i, j

    for j in range(wide + 1):
        consider(0, j, h[j])
    for i in range(1, most + 1):
        diagonal = h[0]
        h[0] = np.full(n, 0 if local else gap(i))
        trace[i, 0] = 3 if local else 2 | (8 if i > 1 else 0)
        e = np.full(n, _NONE)
        consider(i, 0, h[0])
        for j in range(1, wide + 1):
            if band is not None and mode == "global" and abs(j - i) > band:
                diagonal, h[j] = h[j], np.full(n, _NONE)
                e, f[j] = np.full(n, _NONE), np.full(n, _NONE)
                continue
            opened, extended = h[j - 1] - gap_open - gap_extend, e - gap_extend
            e_on = extended > opened
            e = np.maximum(opened, extended)
            opened, extended = h[j] - gap_open - gap_extend, f[j] - gap_extend
            f_on = extended > opened
            f[j] = np.maximum(opened, extended)
            d = diagonal + np.where(k[:, i - 1] == t[:, j - 1], match, -mismatch)
            diagonal = h[j]
            value, how = d, np.zeros(n, np.uint8)
            for other, label in ((e, 1), (f[j], 2)):
                how = np.where(other > value, label, how).astype(np.uint8)
                value = np.maximum(value, other)
            if local:
                how = np.where(value <= 0, 3, how).astype(np.uint8)
                value = np.maximum(value, 0)
            h[j] = value
            trace[i, j] = how | e_on.astype(np.uint8) << 2 | f_on.astype(np.uint8) << 3
            consider(i, j, value)
    return [(int(best[r]), *_walk(trace[:, :, r], k[r], t[r], int(at_i[r]), int(at_j[r]))) for r in range(n)]


def _walk(trace: np.ndarray, key: np.ndarray, text: np.ndarray, i: int, j: int) -> tuple[int, int, str]:
    """(begin, stop, cigar) of the way back from a cell."""
    stop, ops, inside = j, [], 0
    while True:
        cell = int(trace[i, j])
        how = inside or cell & 3
        if how == 3 or (i == 0 and j == 0):
            break
        if how == 0:
            i, j = i - 1, j - 1
            ops.append("M" if key[i] == text[j] else "X")
        elif how == 1:
            inside = 1 if cell & 4 else 0
            j -= 1
            ops.append("D")
        else:
            inside = 2 if cell & 8 else 0
            i -= 1
            ops.append("I")
    return j, stop, cigar_of(ops[::-1])


def cigar_of(ops: list[str]) -> str:
    out, at = [], 0
    for x in range(1, len(ops) + 1):
        if x == len(ops) or ops[x] != ops[at]:
            out.append(f"{x - at}{ops[at]}")
            at = x
    return "".join(out)


def _chunks(keys: list[str], texts: list[str]) -> Iterator[slice]:
    size = (max(map(len, keys), default=0) + 1) * (max(map(len, texts), default=0) + 1)
    rows = max(1, CELLS // size)
    return (slice(at, at + rows) for at in range(0, len(keys), rows))


def affine(key: Column, text: Column, mode: str = "glocal", match: int = 1, mismatch: int = 4, gap_open: int = 6, gap_extend: int = 1, band: int | None = None) -> Column:
    """Struct (score, begin, stop, cigar) of the best affine-gap alignment; a gap of n costs gap_open + n * gap_extend.

    ``mode`` is global, glocal (the whole key to any piece of the text) or local. The cigar has M, X (mismatch), I (only in the key) and D (only in
    the text); begin and stop are offsets in the text. Of equal scores the first end counts, and on the way back a pair before a gap.
    ``band`` bounds the distance from the diagonal of a global alignment.
    """

    @F.pandas_udf(ALIGNED)
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        a, b = keys.fillna("").tolist(), texts.fillna("").tolist()
        rows = [r for s in _chunks(a, b) for r in affine_batch(a[s], b[s], mode, (match, mismatch, gap_open, gap_extend), band)]
        return pd.DataFrame(rows, columns=["score", "begin", "stop", "cigar"])

    return run(key, text)


def edit_alignment(key: Column, text: Column, mode: str = "glocal") -> Column:
    """The same by edit distance: score is the distance, negated."""
    return affine(key, text, mode, 0, 1, 0, 1)


def semi_global_distance(key: Column, text: Column, most: int) -> Column:
    """Struct (distance, stop) of the piece of the text nearest to the key, the first of equals; nulls if it is beyond ``most``."""

    @F.pandas_udf("distance int, stop int")
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        columns = edit_columns(keys.fillna("").tolist(), texts.fillna("").tolist())
        at = columns.argmin(axis=1)
        best = columns[np.arange(len(at)), at]
        fits = pd.Series(best <= most)
        return pd.DataFrame({"distance": pd.Series(best, dtype="Int64").where(fits), "stop": pd.Series(at + 1, dtype="Int64").where(fits)})

    return run(key, text)


def all_matches(key: Column, text: Column, most: int) -> Column:
    """Array of (distance, stop): of each stretch of columns within ``most`` the least of the next ``most`` columns; exact ones at once."""

    @F.pandas_udf("array<struct<distance:int,stop:int>>")
    def run(keys: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for row in edit_columns(keys.fillna("").tolist(), texts.fillna("").tolist()).tolist():
            hits, j = [], 0
            while j < len(row):
                if row[j] > most:
                    j += 1
                    continue
                ahead = row[j : j + most + 1] if row[j] else row[j : j + 1]
                least = min(ahead)
                at = j + ahead.index(least)
                hits.append({"distance": least, "stop": at + 1})
                j = at + 1 if least == 0 else j + len(ahead)
            out.append(hits)
        return pd.Series(out)

    return run(key, text)


def script_fits(key: Column, text: Column, cigar: Column) -> Column:
    """Whether a cigar of M, X, I and D turns the whole key into the whole text: lengths add up, M are equal and X differ."""

    @F.pandas_udf("boolean")
    def run(keys: pd.Series, texts: pd.Series, cigars: pd.Series) -> pd.Series:
        import re

        out = []
        for k, t, c in zip(keys.fillna(""), texts.fillna(""), cigars.fillna(""), strict=True):
            i = j = 0
            good = re.fullmatch(r"(\d+[MXID])*", c) is not None
            for n, op in re.findall(r"(\d+)([MXID])", c):
                n = int(n)
                if op in "MX":
                    pairs = list(zip(k[i : i + n], t[j : j + n], strict=False))
                    good &= len(pairs) == n and all((a == b) == (op == "M") for a, b in pairs)
                i += n * (op != "D")
                j += n * (op != "I")
            out.append(bool(good and i == len(k) and j == len(t)))
        return pd.Series(out)

    return run(key, text, cigar)


def chained(key: Column, text: Column, left: int, right: int) -> Column:
    """The script (array of op and len) of a key whose first ``left`` and last ``right`` bases are known to match the ends of the text: what lies between is aligned globally."""
    inner = lambda t: F.substring(t, F.lit(left + 1), F.length(t) - left - right)
    gap = E.parse_cigar(affine(inner(key), inner(text), "global")["cigar"])
    anchor = lambda n: F.array(F.struct(F.lit("M").alias("op"), F.lit(n).alias("len")))
    return E.merged(F.concat(anchor(left), gap, anchor(right)))
