"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import create_file, open_file, record_batch, text_slices
from gradeframe.session import materialise, work_dir

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_PAYLOAD = 100  # bytes from which on equal payloads are stored once
ARCHIVE_BYTES = 256 << 20  # an archive that has reached this size is closed
READ_BYTES = 1 << 16
DICTIONARY_BYTES = 1 << 15
DICTIONARY_PAGES, DICTIONARY_PAGE_LETTERS = 300, 8_000  # bounds of the sample for the dictionary
LEVEL = 3
PAGE_ID, REFERS_TO = "X-Page-Id", "X-Refers-To-Page-Id"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "page")

_FILES = pa.schema([("uri", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every page.

    Of pages with equal payloads of at least ``LEAST_PAYLOAD`` bytes, the one with the smallest id is
    the response and the others revisit it. Rows that repeat that smallest id are responses as well. A
    null payload is empty. A page with a null id revisits the smallest id that is there, if any.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    # Only payloads met more than once need a partner. They are counted before anything is shuffled.
    repeated = (
        rows.filter(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    revisits = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_page")).alias("refers_to"),
    )


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages; a plain list of usual headers if the sample is too small."""
    sample = pages.select(F.substring(F.col(html_col), 1, DICTIONARY_PAGE_LETTERS).alias("html")).filter("html != ''").limit(DICTIONARY_PAGES)
    texts = [_record("response", n, "http://host/path", "2000-01-01T00:00:00Z", r.html.encode(), len(r.html), "0" * 64, None) for n, r in enumerate(sample.collect())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return _record("response", 0, "http://", "2000-01-01T00:00:00Z", b"<!DOCTYPE html><html><head><title>", 0, "0" * 64, None)


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def _record(kind: str, page_id: int | None, url: str | None, date: str, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """A whole WARC record. A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id), "WARC-Date": date}
    if url:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    fields["WARC-Payload-Digest"] = f"sha256:{digest}"
    if kind == "revisit":
        fields |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": REVISIT_PROFILE, REFERS_TO: str(refers_to)}
    if page_id is not None:
        fields[PAGE_ID] = str(page_id)
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write(records: DataFrame, dictionary_bytes: bytes, date: str = "2000-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write the rows of ``record_types`` as archives in the shared folder; returns their list (uri, n_records, n_bytes).

    Each task writes archives of its own. Only files on the list count, and the list is written to the
    shared folder as well, so what a lost task has left does no harm. No rows give no archive.
    """
    folder = folder or work_dir(records.sparkSession, "warc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A revisit needs no payload, so it is compressed like any other record, only shorter.
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(dictionary_bytes), write_content_size=True)
        file: Any = None
        uri, n_records, n_bytes = "", 0, 0

        def listed() -> pa.RecordBatch:
            file.close()
            return record_batch(_FILES, uri=[uri], n_records=[n_records], n_bytes=[n_bytes])

        for rows in text_slices(batches, column="html"):
            for row in rows.to_pylist():
                if file is None:
                    file, uri = create_file(folder, ".warc.zst")
                    head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary_bytes)) + dictionary_bytes
                    file.write(head)
                    n_records, n_bytes = 0, len(head)
                frame = press.compress(_record(
                    row["record_type"], row["page_id"], row["url"], date, row["html"].encode(), row["payload_bytes"], row["payload_digest"], row["refers_to"]
                ))
                file.write(frame)
                n_records, n_bytes = n_records + 1, n_bytes + len(frame)
                if n_bytes >= ARCHIVE_BYTES:
                    yield listed()
                    file = None
        if file is not None:
            yield listed()

    return materialise(records.mapInArrow(run, "uri string, n_records long, n_bytes long"), "warc-list")


def frames(file: BinaryIO) -> Iterator[bytes]:
    """The content of every frame of an archive, one at a time."""
    head = file.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the archive ends within its dictionary")
    if data[:4] == FRAME_MAGIC:
        data = zstandard.ZstdDecompressor().decompress(data)
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary(data))
    left = file.read(READ_BYTES)
    while left:
        one, parts = unpack.decompressobj(), []
        try:
            parts.append(one.decompress(left))
            while not one.eof:
                left = file.read(READ_BYTES)
                if not left:
                    raise ValueError("the archive ends within a frame")
                parts.append(one.decompress(left))
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame cannot be decoded: {e}") from e
        yield b"".join(parts)
        left = one.unused_data or file.read(READ_BYTES)


@dataclass
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Record:
    """One record per frame. Raises ValueError unless its headers and lengths are right."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    missing = [f for f in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length") if f.lower() not in fields]
    if missing:
        raise ValueError(f"a record lacks {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError("a record's length is not a number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    status, _, payload = rest[:size].partition(b"\r\n\r\n")
    first, *lines = status.decode().split("\r\n")
    if not first.startswith("HTTP/"):
        raise ValueError("a record does not hold an HTTP message")
    return Record(fields, _fields(lines), payload)


def _fields(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, found, value = line.partition(":")
        if not found:
            raise ValueError("a header line has no colon")
        out[name.strip().lower()] = value.strip()
    return out


_READ = [
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
]


def _row(record: Record) -> tuple:
    f = record.fields
    kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(record.http.get("content-length", len(record.payload)))
    if kind == "response":
        if size != len(record.payload):
            raise ValueError("a payload's length is not what its header says")
        if hashlib.sha256(record.payload).hexdigest() != digest:
            raise ValueError("a payload does not match its digest")
    elif kind != "revisit" or REFERS_TO.lower() not in f or record.payload:
        raise ValueError(f"unexpected record of type {kind}")
    page, refers = f.get(PAGE_ID.lower()), f.get(REFERS_TO.lower())
    return (None if page is None else int(page), f.get("warc-target-uri"), size, digest, kind, None if refers is None else int(refers), record.payload if kind == "response" else None)


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each archive is one task, which holds a record at a time and checks headers, lengths and digests;
    a wrong one ends the job with an error. ``payload_bytes`` and ``payload_digest`` of a revisit are
    those of the full payload, which it does not hold (null).
    """
    schema = pa.schema(_READ if with_payload else _READ[:-1])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for b in batches for u in b.column("uri").to_pylist()):
            with open_file(uri) as file:
                rows, held = [], 0
                for data in frames(file):
                    rows.append(_row(parse(data)))
                    held += len(data) if with_payload else 200
                    if held >= 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    one_each = files.select("uri").repartitionByRange(max(1, files.count()), "uri")
    return one_each.mapInArrow(run, ddl + (", payload binary" if with_payload else ""))
