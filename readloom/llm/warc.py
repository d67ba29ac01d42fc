"""WARC archives of pages, one Zstandard frame per record, with a dictionary built from the records themselves.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is then a frame of its own,
so any record can be read with the dictionary and its offset alone. The dictionary is trained on records spread over the whole
file (about ``SAMPLE_BYTES`` of them, a bounded sample); where they are too few or too uniform to train on, their own bytes are the dictionary.

Of the records with equal payloads of at least ``least`` bytes the one with the largest page_id is written as response;
the others are revisit records without payload that name it (WARC-Refers-To) and carry its digest and length. Equality
is decided by SHA-256 and length together, grouped with map-side combining; the digest that records carry is base32 SHA-1.

Defined cases: null html is an empty payload; null urls are written as an empty target; null page_ids are written as such and are never
referred to: rows with null ids alone in their group are all responses; rows that repeat the largest id of a group are all
responses; other columns are ignored; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, scratch_path, text_or_empty
from readloom.llm.files import read_file, write_file

SKIPPABLE = 0x184D2A5D
SAMPLE_BYTES, DICT_BYTES, FILE_BYTES = 4 << 20, 112 << 10, 24 << 20
LEVEL = 3
CHUNK = 1 << 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_LINE_BREAKS = re.compile(r"[\r\n]+")


def record_urn(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{salt}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """The bytes of a WARC/1.1 record; a revisit if ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_LINE_BREAKS.sub(' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_urn(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload), names in lower case; ValueError if a length or digest is wrong."""

    def fields(block: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in block.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    size = int(warc["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    if warc["warc-type"] == "response" and "sha1:" + digest_of(payload) != warc["warc-payload-digest"]:
        raise ValueError("payload of a wrong digest")
    return warc, fields(http), payload


def build_dictionary(records: list[bytes]) -> bytes:
    """At most an eighth of the records' size: trained on records spread over all of them, else the bytes of these."""
    size = sum(map(len, records))
    sample, most = records[:: max(1, -(-size // SAMPLE_BYTES))], min(DICT_BYTES, size // 8)
    try:
        return zstandard.train_dictionary(most, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:most]


def pack_archive(records: list[bytes]) -> bytes:
    """The bytes of a file: the dictionary in a skippable frame, then a frame for each record."""
    raw = build_dictionary(records)
    known = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **known)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(press.compress, records)])


def unpack_archive(data: bytes) -> Iterator[bytes]:
    """The records of a file, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    raw, at = data[8 : 8 + size], 8 + size
    known = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    unpress = zstandard.ZstdDecompressor(**known)
    while at < len(data):
        one, parts = unpress.decompressobj(), []
        while not one.eof and at < len(data):
            parts.append(one.decompress(data[at : at + CHUNK]))
            at += min(CHUNK, len(data) - at) - len(one.unused_data)
        if not one.eof:
            raise ValueError("the last record is cut off")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; the manifest: name, n_records, n_bytes."""
    html = text_or_empty("html")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("key"), F.octet_length(html).alias("size"),
    )
    first = rows.where(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("first_id"))
    first = materialize(first, "warc-first")  # a table, so that the join can split the rows of a hot payload
    dealt = rows.join(first, ["key", "size"], "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("first_id"), F.col("first_id")).when(F.col("page_id").isNull(), F.col("first_id")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = pack_archive(held)
            return pa.RecordBatch.from_pylist(
                [{"name": write_file(folder, data, ".warc.zst"), "n_records": len(held), "n_bytes": len(data)}],
                pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]),
            )

        for b in batches:
            for page_id, url, text, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                payload = text.as_py().encode()
                held.append(make_record(page_id, url, payload, refers_to, digest_of(payload), date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialize(dealt.mapInArrow(run, "name string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record of the files: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                out = []
                for record in unpack_archive(read_file(folder, name)):
                    warc, http, _ = parse_record(record)
                    page, of = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
                    out.append((
                        None if page is None else int(page), warc["warc-target-uri"], int(http["content-length"]),
                        warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], None if of is None else int(of),
                    ))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    files = manifest.select("name").repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least), folder)
