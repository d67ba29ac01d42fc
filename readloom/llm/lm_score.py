"""Language-model scores by stupid backoff, from n-gram count tables partitioned by hash.

S(w | u v) = c(u v w) / c(u v) if the corpus has u v w, else ``alpha`` times the score with a shorter history, down to the share
of w among all words. Counts come from all documents but the scored one, so that a text does not vouch for itself; a word
that no other document has scores as one occurrence among all words. A document's score is the sum of ln S over its words.

The join of counts to n-grams is relational, but rows are packed: documents are dealt by hash into chunks of a bounded number of
bytes, and a chunk sends each of its distinct n-grams once, with its count, to the hash bucket that owns it (map-side combining:
an n-gram that every document has costs a row entry per chunk). A bucket adds up the counts of its n-grams and
answers every chunk in the order asked. Chunks and answers are joined on the chunk, where the scores are summed per
document. Chunks and buckets grow in number, not in size, with the input.

Orders one and two are asked together, each further order on its own: an n-gram can occur in another document only if the two
(n-1)-grams in it do, so only those are sent. A document that shares an n-gram with another one sees both of these in that other one, so every
occurrence that can matter to anyone is counted, and the scores are those of the full tables.

Words are runs without ASCII white space in lower case; n-grams are compared by hashes of 48 to 64 bits, wider for larger inputs. Defined cases: null and empty texts have
no words, a score of 0 and no perplexity; rows that repeat an id are documents of their own; null ids are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import WORD, text_or_empty

CHUNK_BYTES = 8 << 20
BUCKET_GRAMS = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _narrowest(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def pack_sorted(a: np.ndarray) -> tuple[bytes, int]:
    """Ascending 64-bit numbers as gaps of as many bytes as the largest needs."""
    gaps = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpack_sorted(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, number of words of each text), by one polynomial over all bytes."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    first, last = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)
    word = sums[last - 1] - np.where(first > 0, sums[first - 1], np.uint64(0))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    lens = np.diff(np.searchsorted(first, begins))
    return _mixed(word * _powers(_UNBASE, len(data))[first] ^ (last - first).astype(np.uint64)), lens


class Chunk:
    """The words of some documents; what other documents hold of their n-grams, as far as it has been answered."""

    def __init__(self, texts: list[bytes], width: int = 64):
        self.word, self.lens = word_hashes(texts)
        self.narrow = np.uint64(64 - width)
        self.doc = np.repeat(np.arange(len(texts)), self.lens)
        self.at = np.arange(len(self.word)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.left: list[np.ndarray] = []  # by order: occurrences, in other documents, of the n-gram that ends at each word

    def _hashes(self, n: int, where: np.ndarray) -> np.ndarray:
        h = np.full(len(where), n, np.uint64)
        for back in range(n - 1, -1, -1):
            h = _mixed(h ^ self.word[where - back])
        return h >> self.narrow

    def _wanted(self) -> list[tuple[int, np.ndarray]]:
        """(order, words at which an n-gram of it ends) that are asked next."""
        if not self.left:
            return [(n, np.nonzero(self.at >= n - 1)[0]) for n in (1, 2)]
        n = len(self.left) + 1
        both = (self.left[-1] > 0) & (np.roll(self.left[-1], 1) > 0) & (self.at >= n - 1)
        return [(n, np.nonzero(both)[0])]

    def ask(self) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams in ascending order, their counts here) that are asked next."""
        self.open = self._wanted()
        every = np.concatenate([self._hashes(n, where) for n, where in self.open])
        grams, self.ids, counts = np.unique(every, return_inverse=True, return_counts=True)
        return grams, counts

    def tell(self, totals: np.ndarray) -> None:
        """Take the counts in all documents of what ask() returned."""
        begin = 0
        for _, where in self.open:
            ids = self.ids[begin : begin + len(where)]
            begin += len(where)
            left = np.zeros(len(self.word), np.int64)
            known = totals[ids] if len(ids) else np.empty(0, np.int64)
            shared = np.nonzero(known > 1)[0]  # what occurs once occurs here
            pair = self.doc[where[shared]] * (len(totals) + 1) + ids[shared]
            _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
            left[where[shared]] = known[shared] - counts[inverse]
            self.left.append(left)

    def scores(self, words: int, alpha: float) -> np.ndarray:
        """Sum of ln S of each document; ``words`` are the words of all documents."""
        n_words, order = len(self.word), len(self.left)
        rest = np.maximum(words - self.lens[self.doc], 1)  # words of the other documents
        best, penalty, unset = np.zeros(n_words), np.zeros(n_words), np.ones(n_words, bool)
        for n in range(order, 1, -1):
            # the history of the n-gram that ends at word i is the (n-1)-gram that ends at word i-1 of the same document
            history = np.roll(self.left[n - 2], 1)
            here = unset & (self.at >= n - 1)
            hit = here & (self.left[n - 1] > 0)
            best[hit] = np.log(self.left[n - 1][hit] / history[hit])
            unset &= ~hit
            penalty[here & ~hit] += math.log(alpha)
        best[unset] = np.log(np.maximum(self.left[0][unset], 1) / rest[unset])
        return np.bincount(self.doc, weights=best + penalty, minlength=len(self.lens))


_PACKED = "chunk int, doc_ids array<bigint>, lens array<int>, texts binary"
_ASKED = "bucket long, chunk int, grams binary, width int, counts binary, size int"
_ANSWERED = "level int, chunk int, bucket long, totals binary, size int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a batch: its texts in lower case, compressed together."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        by_chunk: dict[int, list[int]] = {}
        for i, c in enumerate(b.column(0).to_pylist()):
            by_chunk.setdefault(c, []).append(i)
        ids, out = b.column(1).to_pylist(), []
        for c, rows in by_chunk.items():
            raw = [b.column(2)[i].as_py().lower().encode() for i in rows]
            out.append((c, [ids[i] for i in rows], [len(r) for r in raw], press.compress(b"".join(raw))))
        types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["chunk", "doc_ids", "lens", "texts"])


def _texts(group: pa.Table) -> list[bytes]:
    out, unpress = [], zstandard.ZstdDecompressor()
    for lens, data in zip(group.column("lens").to_pylist(), group.column("texts"), strict=True):
        raw = unpress.decompress(data.as_py()) if sum(lens) else b""
        ends = np.cumsum(lens).tolist()
        out += [raw[e - n : e] for e, n in zip(ends, lens, strict=True)]
    return out


def _send(chunk: int, grams: np.ndarray, counts: np.ndarray, bits: int, width: int) -> pa.Table:
    """A row for each bucket that owns some of the n-grams: the leading bits of their hashes."""
    buckets = (grams >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    kinds, begins = np.unique(buckets, return_index=True)
    ends = np.append(begins[1:], len(grams))
    packed = [pack_sorted(grams[i:j]) for i, j in zip(begins, ends, strict=True)]
    parts = [_narrowest(counts[i:j]) for i, j in zip(begins, ends, strict=True)]
    return pa.table({
        "bucket": pa.array(kinds), "chunk": pa.array([chunk] * len(kinds), pa.int32()),
        "grams": pa.array([p[0] for p in packed], pa.binary()), "width": pa.array([p[1] for p in packed], pa.int32()),
        "counts": pa.array([x.tobytes() for x in parts], pa.binary()), "size": pa.array([x.itemsize for x in parts], pa.int32()),
    })


def _answer(group: pa.Table, level: int) -> pa.Table:
    """The totals of a bucket's n-grams, to each chunk in the order asked."""
    press = zstandard.ZstdCompressor(level=3)
    grams = [unpack_sorted(g.as_py(), w.as_py()) for g, w in zip(group.column("grams"), group.column("width"), strict=True)]
    counts = [np.frombuffer(c.as_py(), f"<u{s.as_py()}") for c, s in zip(group.column("counts"), group.column("size"), strict=True)]
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)[inverse]
    parts = [_narrowest(t) for t in np.split(totals, np.cumsum([len(g) for g in grams])[:-1])]
    return pa.table({
        "level": pa.array([level] * len(grams), pa.int32()), "chunk": group.column("chunk"), "bucket": group.column("bucket"),
        "totals": pa.array([press.compress(x.tobytes()) for x in parts], pa.binary()), "size": pa.array([x.itemsize for x in parts], pa.int32()),
    })


def _told(group: pa.Table, answers: pa.Table, levels: Iterable[int], width: int) -> Chunk:
    """The chunk with the answers of these levels."""
    chunk, unpress = Chunk(_texts(group), width), zstandard.ZstdDecompressor()
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "totals", "size")), strict=True))
    for level in levels:
        chunk.ask()
        parts = [np.frombuffer(unpress.decompress(t), f"<u{s}").astype(np.int64) for k, _, t, s in rows if k == level]
        chunk.tell(np.concatenate([np.empty(0, np.int64), *parts]))
    return chunk


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """One row per input row: doc_id, n_words, log_score, mean_log_score, perplexity. ``order`` is 2 or more."""
    text = text_or_empty("text")
    size = docs.select(F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.regexp_count(text, F.lit(WORD))).alias("words")).first()
    n_bytes, n_words = size.bytes or 0, size.words or 0
    chunks = int(n_bytes // CHUNK_BYTES) + 1
    bits = max(0, math.ceil(math.log2(max(1, n_words * 2 / BUCKET_GRAMS))))
    # As many bits that an n-gram shares its hash with another one in fewer than 2^-20 of all cases, at any size.
    width = min(64, max(48, math.ceil(math.log2(n_words * 2 + 1)) + 20))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text"
    )
    # One exchange of the texts serves all rounds, as the plans below it are the same.
    rows = rows.mapInArrow(_pack, _PACKED).repartition("chunk")

    def ask_first(group: pa.Table) -> pa.Table:
        return _send(group.column("chunk")[0].as_py(), *Chunk(_texts(group), width).ask(), bits, width)

    def answers_of(asked: DataFrame, level: int) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(lambda group: _answer(group, level), _ANSWERED)

    answered = answers_of(rows.groupBy("chunk").applyInArrow(ask_first, _ASKED), 0)
    def ask_next(level: int):
        def run(group: pa.Table, answers: pa.Table) -> pa.Table:
            return _send(group.column("chunk")[0].as_py(), *_told(group, answers, range(level), width).ask(), bits, width)

        return run

    for level in range(1, order - 1):
        asked = rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(ask_next(level), _ASKED)
        answered = answered.unionByName(answers_of(asked, level))

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _told(group, answers, range(order - 1), width)
        ids = [i for part in group.column("doc_ids").to_pylist() for i in part]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(chunk.lens), "log_score": pa.array(chunk.scores(n_words, alpha)),
        })

    joined = rows.groupBy("chunk").cogroup(answered.groupBy("chunk"))
    out = joined.applyInArrow(score, "doc_id long, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.withColumn("mean_log_score", mean).withColumn("perplexity", F.exp(-F.col("mean_log_score")))
