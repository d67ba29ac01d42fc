"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves.

Items are dealt into classes by their number n of distinct five-word shingles (powers of two). An item is represented
by its k smallest shingle hashes with k = floor((1 - t) * N) + 1, N the largest n of its class: a document that holds a
share t of the item's shingles misses at most floor((1 - t) * n) of them, so it holds at least one of any k. The search
for items whose minimum hashes occur among a document's hashes therefore misses nothing, at any length of the
document; each candidate is then verified by looking up every shingle of the item in the document's words.

Items are searched in blocks of a fixed number of characters (one block up to ``block_chars``), each sent to the
executors once; the documents are read once per block and not shuffled.

Words are runs of letters, digits and non-ASCII characters after lower-casing; ASCII punctuation separates. Defined
cases: a text of fewer than five words has one shingle, all its words, so a short item is found in a document of just
these words only; items and documents without words match nothing; null texts have no words; rows that repeat an id
are searched one by one (items that repeat an id are one item per row); other columns are ignored; either table may be empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import portions, releasing, text_or_empty

WIDTH = 5
_APART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


def shingles_of(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Space-joined shingles, repeats included; all words if they are fewer than ``width``."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


class Hasher:
    """Shingle hashes from word hashes that are kept for words already seen."""

    def __init__(self, width: int, keep: int = 500_000):
        self.width, self.keep = width, keep
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.known = np.empty(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.keep:
            self.forget()
        had = len(self.known)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > len(self.known):
            new = words if not had else [w for w, i in zip(words, at.tolist(), strict=True) if i >= had]
            grown = np.empty(max(len(self.index), 1), np.uint64)
            grown[:had] = self.known
            for w in new:
                grown[self.index[w]] = xxhash.xxh64_intdigest(w)
            self.known = grown
        h = self.known[at]
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + n]) * _MIX
            out ^= out >> np.uint64(31)
        return out


class Items:
    """A block of items: their minimum hashes sorted, and each item's shingles for verification."""

    def __init__(self, rows: list[tuple[int, str]], share: float, width: int):
        self.share, self.width = share, width
        self.ids = [r[0] for r in rows]
        self.shingles = [sorted(set(shingles_of(words_of(r[1]), width))) for r in rows]
        hasher, hashes, owners = Hasher(width), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, s in enumerate(self.shingles):
            if s:
                n = len(s)
                largest = (1 << n.bit_length()) - 1  # of the class of n
                k = min(n, int((1 - share) * largest + 1e-9) + 1)
                mins = np.unique(hasher(words_of(rows[i][1])))[:k]
                hashes.append(mins)
                owners.append(np.full(len(mins), i))
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        # A bitmap over the leading bits settles most hashes of documents.
        self.bits = max(16, int(np.ceil(np.log2(len(hashes) + 1))) + 6)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True

    def find(self, words: list[bytes], hasher: Hasher) -> list[tuple[int, float]]:
        """(item, share of its shingles that occur), of those with at least the wanted share."""
        if not words or not len(self.hashes):
            return []
        h = hasher(words)
        h = h[self.seen[h >> np.uint64(64 - self.bits)]]
        if not len(h):
            return []
        h = np.unique(h)
        first, last = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        found = {int(o) for i, j in zip(first, last, strict=True) if i < j for o in self.owners[i:j]}
        if not found:
            return []
        line, out = b" " + b" ".join(words) + b" ", []
        for i in sorted(found):
            s = self.shingles[i]
            if len(words) < self.width:
                hits = int(s == [line[1:-1]])
            elif s[0].count(b" ") < self.width - 1:
                hits = 0  # a short item's shingle is not one of a longer document
            else:
                hits = sum(b" " + x + b" " in line for x in s)
            if hits >= self.share * len(s) - 1e-9:
                out.append((i, hits / len(s)))
        return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; each block is collected on its own."""
    chars = items.agg(F.sum(F.char_length("text") + 16)).first()[0] or 0
    n = int(chars // block_chars) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r.item_id, r.text) for r in part.collect()]
        if rows:
            yield rows


def contained_items(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.8, width: int = WIDTH, block_chars: int = 16_000_000
) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) for each document that holds ``share`` or more of an item's shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    schema = "doc_id long, item_id long, containment double, n_shingles long"
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
    out = None
    for block in _blocks(_items(benchmark), block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, share, width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            hasher = Hasher(width)
            for b in batches:
                found = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for i, held in known.find(words_of(text.as_py()), hasher):
                        found.append((doc_id, known.ids[i], held, len(known.shingles[i])))
                cols = list(zip(*found, strict=True)) or [[] for _ in types]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "containment", "n_shingles"]
                )

        found = rows.mapInArrow(releasing(run), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, width: int = WIDTH, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; each row is judged as it passes, whatever its id."""
    at = docs.columns.index("text")
    for block in _blocks(_items(benchmark), block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, share, width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, hasher = sent.value, Hasher(width)
            for b in batches:
                for part in portions(b):
                    yield part.filter(pa.array([not known.find(words_of(t.as_py()), hasher) for t in part.column(at)], pa.bool_()))

        docs = docs.mapInArrow(releasing(run), docs.schema)
    return docs
