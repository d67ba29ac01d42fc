"""Token-id output: documents as ids of a public tokenizer, in range-coded block files in ascending order of doc_id.

File (little-endian): ``RLT1``, version u16 (2), block length u32, numbers of documents, ids and blocks u64, then the
document index (zlib: per document a null flag u8, doc_id i64, ids u32), its length u32 and CRC-32 ahead of it, then the
blocks: ids u32, CRC-32 of the ids as little-endian u32, bytes u32, CRC-32 of the bytes, bytes. Each block is coded
from a fresh model (rangecoder.py), so it can be read alone, and a damaged one is detected by either sum.

The documents are range-partitioned and sorted by id; each task streams its partition into files of a bounded number of
ids. The manifest (one row per file) gives each file its place by a running sum, and the files are read back by as many tasks.

Defined cases: null texts are empty and consist of the end id alone; null ids come first; rows that repeat an id are all
written, in order of their texts; other columns are ignored; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import batches_of, materialize, release_memory, releasing, scratch_path, text_or_empty
from readloom.llm.files import read_file, write_file
from readloom.llm.rangecoder import LONGEST, decode_blocks, encode_blocks

MAGIC = b"RLT1"
#: Ids of a block, less in small files: so many that there are WIDE blocks to code side by side. Blocks coded at once.
BLOCK, SHORTEST, WIDE, LANES = LONGEST, 256, 1024, 4096
HEAD = struct.Struct("<4sHIQQQII")
BLOCK_HEAD = struct.Struct("<IIII")
_LETTER, _DIGIT, _OTHER, _BLANK, _LINE, _END = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
for _chars, _class in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3", _LETTER), (b"0123456789", _DIGIT), (b" ", _BLANK), (b"\n", _LINE), (b"\xff", _END)):
    _CLASS[list(_chars)] = _class
#: Bytes of plain texts: line feeds, printable ASCII, and U+00A1 to U+00FF, of which _plain_docs() takes the letters and two signs.
_FINE = np.zeros(256, bool)
_FINE[[10, *range(32, 127), *range(0x80, 0xC0), 0xC2, 0xC3, 0xFF]] = True
_LINES = 1000
_SHORT = 16  # bytes of the longest piece that the table holds
_FEW_BITS = 16  # of the slots of a table without pieces
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def cut_pieces(data: np.ndarray) -> np.ndarray:
    """Where the pieces of plain texts begin, as the GPT-2 pattern cuts them; ``data`` are bytes in which 0xFF stands around each text.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|white space but for its last before a word|white space.
    """
    c = _CLASS.take(data)
    tail = ((data & 0xC0) == 0x80).nonzero()[0]
    c[tail] = c[tail - 1]
    white = (c == _BLANK) | (c == _LINE)
    start = np.ones(len(c), bool)
    # A blank before letters, digits or others is the beginning of their piece.
    start[1:] = (c[1:] != c[:-1]) & (c[:-1] != _BLANK) & ~white[1:]
    start[1:] |= white[1:] & ~white[:-1]
    start[:-1] |= white[:-1] & ~white[1:] & (c[1:] != _END)
    start |= c == _END
    marks = (data[:-2] == 39).nonzero()[0]
    if len(marks):
        marks = marks[(c[marks - 1] != _OTHER) & (c[marks - 1] != _BLANK)]
        one, two = data[marks + 1], data[marks + 2]
        short = marks[np.isin(one, list(b"stmd"))]
        long_ = marks[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]
        start[short + 1] = start[long_ + 1] = False
        start[short + 2] = start[long_ + 3] = True
    return start.nonzero()[0]


def _plain_docs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the texts that end at ``ends`` are plain: ASCII, Latin letters, and the two inverted marks, without control characters."""
    bad = ~_FINE.take(data)
    two = (data[:-1] == 0xC2) & (data[1:] != 0xA1) & (data[1:] != 0xBF) | (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad[:-1] |= two
    plain = np.ones(len(ends), bool)
    plain[np.searchsorted(ends, bad.nonzero()[0])] = False
    return plain


class Encoder:
    """Ids of whole texts by the tokenizers library. The ids of a piece (as the tokenizer splits texts first) are kept once it was seen.

    Pieces are cut here only in plain texts, where the tokenizer's own splitting pattern has one meaning, and only if
    the tokenizer is a byte-level BPE with that pattern; all other texts, and texts that may hold one of its special tokens, go to
    the tokenizer whole. Pieces of up to 16 bytes are found in a hash table of their bytes, all of a batch at once; it grows with
    the pieces seen.
    """

    def __init__(self, path: str, keep: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.by_piece = bool(self.by_piece and spec.get("normalizer") is None)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        line_feed = self._ids(["\n"])[0]
        self.line_feed = line_feed[0] if len(line_feed) == 1 else -1
        self.forget()

    def forget(self) -> None:
        self._make_table(_FEW_BITS)
        self.long: dict[bytes, int] = {}
        self.flat, self.begins, self.known, self.filled = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def _make_table(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys = np.zeros((1 << bits, 2), np.uint64)
        self.numbers = np.zeros(1 << bits, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of each text's) of texts in UTF-8."""
        if self.known > self.keep:
            self.forget()
        plain = np.zeros(len(texts), bool)
        if self.by_piece:
            joined = b"\xff".join(texts) + b"\xff"
            plain = _plain_docs(np.frombuffer(joined, np.uint8), np.cumsum([len(t) + 1 for t in texts]) - 1)
            if any(x in joined for x in self.special):
                plain &= [not any(x in t for x in self.special) for t in texts]
        counts = np.zeros(len(texts), np.int64)
        others = [np.array(x, np.uint32) for x in self._ids([texts[i].decode() for i in (~plain).nonzero()[0]])]
        counts[~plain] = [len(x) for x in others]
        pieces = np.empty(0, np.int64)
        if plain.any():
            pieces, per_text = self._pieces([texts[i] for i in plain.nonzero()[0]])
            first, lens = self.begins[pieces], self.begins[pieces + 1] - self.begins[pieces]
            upto = np.concatenate(([0], np.cumsum(lens)))
            counts[plain] = np.diff(upto[np.concatenate(([0], np.cumsum(per_text)))])
            own = self.flat[np.repeat(first - upto[:-1], lens) + np.arange(upto[-1])]
            if plain.all():
                return own, counts
        out = np.empty(int(counts.sum()), np.uint32)
        of_plain = np.repeat(plain, counts)
        if len(pieces):
            out[of_plain] = own
        out[~of_plain] = np.concatenate([np.empty(0, np.uint32), *others])
        return out, counts

    def _pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, how many each has)."""
        raw = b"\xff" + b"\xff".join(texts) + b"\xff" * (_SHORT + 2)
        data = np.frombuffer(raw, np.uint8)
        begin = cut_pieces(data[: len(raw) - _SHORT - 1])
        edges = (data[begin] == 0xFF).nonzero()[0]
        per_text = np.diff(edges) - 1
        inside = np.ones(len(begin), bool)
        inside[edges] = False
        inside = inside.nonzero()[0]
        end, begin = begin[inside + 1], begin[inside]
        size = end - begin
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        w0 = words[begin] & _MASKS.take(np.minimum(size, 8))
        w1 = words[begin + 8] & _MASKS.take(np.clip(size - 8, 0, 8))
        number = self._find(w0, w1)
        number[size > _SHORT] = -1
        lost = (number < 0).nonzero()[0]
        if len(lost):
            fresh: dict[bytes, int] = {}
            at = []
            for i, j in zip(begin[lost].tolist(), end[lost].tolist(), strict=True):
                piece = raw[i:j]
                k = self.long.get(piece) if j - i > _SHORT else None
                at.append(fresh.setdefault(piece, self.known + len(fresh)) if k is None else k)
            number[lost] = at
            if fresh:
                self._learn(fresh)
                short = size[lost] <= _SHORT
                one, first = np.unique(number[lost][short], return_index=True)
                first = lost[short][first]
                self._insert(w0[first], w1[first], one)
        return number, per_text

    def _learn(self, fresh: dict[bytes, int]) -> None:
        """Take the ids of new pieces, which are numbered in their order."""
        texts = [x.decode() for x in fresh]
        for at in range(0, len(texts), _LINES):
            flat, lens = self._ids_of_lines(texts[at : at + _LINES])
            end = self.filled + len(flat)
            while len(self.flat) < end:
                self.flat = np.append(self.flat, np.empty_like(self.flat))
            while len(self.begins) <= self.known + len(lens):
                self.begins = np.append(self.begins, np.empty_like(self.begins))
            self.flat[self.filled : end] = flat
            self.begins[self.known + 1 : self.known + len(lens) + 1] = self.filled + np.cumsum(lens)
            self.filled, self.known = end, self.known + len(lens)
        self.long.update((x, k) for x, k in fresh.items() if len(x) > _SHORT)

    def _ids_of_lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each piece's): pieces are given as the lines of one text, which is faster, where line feeds are ids of their own."""
        if not any(p.isspace() for p in pieces):
            flat = np.array(self._ids(["\n".join(pieces) + "\n"])[0], np.uint32)
            ends = (flat == self.line_feed).nonzero()[0]
            if len(ends) == len(pieces):
                return flat[flat != self.line_feed], np.diff(ends, prepend=-1) - 1
        ids = self._ids(pieces)
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _slot(self, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        h = (w0 ^ (w1 * _MIX1)) * _MIX2
        h ^= h >> np.uint64(31)
        return (h * _MIX1 >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """The numbers of pieces; -1 where the table has none."""
        slot, left = self._slot(w0, w1), None
        number = np.full(len(w0), -1, np.int64)
        while len(w0):
            got = self.keys.take(slot, axis=0)
            same = (got[:, 0] == w0) & (got[:, 1] == w1)
            at = same.nonzero()[0]
            number[at if left is None else left[at]] = self.numbers[slot[at]]
            go = (~same & (got[:, 0] != 0)).nonzero()[0]  # taken by another piece
            left = go if left is None else left[go]
            w0, w1, slot = w0[go], w1[go], slot[go] + 1 & (1 << self.bits) - 1
        return number

    def _insert(self, w0: np.ndarray, w1: np.ndarray, number: np.ndarray) -> None:
        """Put new pieces into the table, which is made larger before it is over half full."""
        if 2 * (self.held + len(w0)) > 1 << self.bits:
            old = self.keys[:, 0].nonzero()[0]
            keys, numbers = self.keys[old], self.numbers[old]
            self._make_table((2 * (self.held + len(w0))).bit_length())  # twice to four times the pieces
            self._insert(keys[:, 0], keys[:, 1], numbers)
        self.held += len(w0)
        slot = self._slot(w0, w1)
        while len(slot):
            free = (self.keys[slot, 0] == 0).nonzero()[0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won], 0], self.keys[slot[won], 1], self.numbers[slot[won]] = w0[won], w1[won], number[won]
            rest = np.ones(len(slot), bool)
            rest[won] = False
            w0, w1, number, slot = w0[rest], w1[rest], number[rest], slot[rest] + 1 & (1 << self.bits) - 1


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary; a Python worker keeps it, with the pieces that it has seen, from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def narrow(ids: np.ndarray) -> np.ndarray:
    """The ids in 16 bits; ValueError for one that they do not hold."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError(f"id {int(ids.max())}: the format holds ids below 65536")
    return ids.astype(np.uint16, copy=False)


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file with these documents and their ids in turn; ValueError for an id that 16 bits do not hold."""
    ids = narrow(ids)
    block = SHORTEST
    while block < BLOCK and len(ids) > block * WIDE:
        block *= 2
    index = zlib.compress(
        b"".join(
            (
                np.array([i is None for i in doc_ids], "u1").tobytes(),
                np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
                np.array(lengths, "<u4").tobytes(),
            )
        ),
        6,
    )
    blocks = [ids[at : at + block] for at in range(0, len(ids), block)]
    out = [HEAD.pack(MAGIC, 2, block, len(doc_ids), len(ids), len(blocks), len(index), zlib.crc32(index)), index]
    for at in range(0, len(blocks), LANES):
        group = blocks[at : at + LANES]
        for b, code in zip(group, encode_blocks(group), strict=True):
            out += [BLOCK_HEAD.pack(len(b), crc_of(b), len(code), zlib.crc32(code)), code]
    return b"".join(out)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; ValueError if any sum is wrong."""
    magic, version, _, n, total, n_blocks, size, crc = HEAD.unpack_from(data)
    index = data[HEAD.size : HEAD.size + size]
    if magic != MAGIC or version != 2 or zlib.crc32(index) != crc:
        raise ValueError("not a token file, or its index is damaged")
    raw, at = zlib.decompress(index), HEAD.size + size
    none, doc_ids = np.frombuffer(raw, "u1", n), np.frombuffer(raw, "<i8", n, n).tolist()
    lengths = np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)
    heads, codes = [], []
    for k in range(n_blocks):
        count_, ids_crc, size, code_crc = BLOCK_HEAD.unpack_from(data, at)
        code = data[at + BLOCK_HEAD.size : at + BLOCK_HEAD.size + size]
        if zlib.crc32(code) != code_crc:
            raise ValueError(f"block {k} is damaged")
        heads.append((count_, ids_crc))
        codes.append(code)
        at += BLOCK_HEAD.size + size
    ids = np.empty(total, np.uint32)
    filled = 0
    for at in range(0, n_blocks, LANES):
        group = heads[at : at + LANES]
        for k, b in enumerate(decode_blocks(codes[at : at + LANES], [h[0] for h in group])):
            if crc_of(b) != group[k][1]:
                raise ValueError(f"block {at + k} is damaged")
            ids[filled : filled + len(b)] = b
            filled += len(b)
    return [None if z else i for i, z in zip(doc_ids, none.tolist(), strict=True)], lengths, ids


def _portions(b: pa.RecordBatch, rows: int = 256, n_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, up to ``rows`` at a time and, unless a single one is longer, ``n_bytes`` of text."""
    ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + n_bytes, "right"))
        n = max(1, min(rows, most - at))
        yield b.slice(at, n)
        at += n


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, file_ids: int = BLOCK * LANES) -> DataFrame:
    """Encode ``docs`` into files under ``folder``; the manifest: name, part, seq, n_docs, n_ids, base."""
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()  # these ids are not to be held twice while they are coded
            release_memory()  # of the encoder
            data = pack_file(doc_ids, lengths, ids)
            row = {"name": write_file(folder, data, ".tok"), "part": part, "seq": seq, "n_docs": len(doc_ids), "n_ids": size, "n_bytes": len(data)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("name", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for b in batches:
            for piece in _portions(b):
                ids, counts = encode(piece.column(1).cast(pa.binary()).to_pylist())
                ends = np.cumsum(counts + 1)
                line = np.full(ends[-1], end_id, np.uint32)
                inside = np.ones(len(line), bool)
                inside[ends - 1] = False
                line[inside] = ids
                doc_ids += piece.column(0).to_pylist()
                held.append(narrow(line))
                lengths += (counts + 1).tolist()
                size += len(line)
                if size >= file_ids:
                    yield flush()
                    doc_ids, held, lengths, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    with batches_of(docs.sparkSession, 512):  # else a batch holds the texts of a whole partition, here and in the JVM
        files = materialize(
            rows.mapInArrow(releasing(run), "name string, part int, seq int, n_docs long, n_ids long, n_bytes long"), "tok-manifest"
        )
    # One row per file of millions of ids.
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame, folder: str, n_files: int) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # the worker has written its files; what follows needs the memory
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = unpack_file(read_file(folder, name))
                ends = np.cumsum(lengths)
                crcs = [crc_of(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("name", "base").repartition(max(1, min(n_files, 10_000)))
    return files.mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all texts as token files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    manifest = materialize(write_tokens(docs, tokenizer_path, end_id, folder), "tok-files")
    return read_tokens(manifest, folder, manifest.count())
