"""Token-id files: whole texts as ids in document order, range-coded in independent blocks.

File format (little-endian), one file per range of document ids:

* ``GFTOKEN1``
* segments, each: a header (``HEADER``), then the sections documents, order-0 table, block table
  and words, of the byte lengths in the header. A section other than the words is compressed by zlib
  and preceded by its crc32; every block has the crc32 of its ids in the block table.
* a header of zeros

Documents are never split between segments; blocks are, and each can be decoded without the others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm import range_coder
from gradeframe.llm.bpe import byte_bpe
from gradeframe.llm.shared import create_file, id_and_text, open_file, record_batch, text_slices, texts_of
from gradeframe.session import materialise, work_dir

MAGIC = b"GFTOKEN1"
HEADER = "<IQIBIIII"  # documents, ids, blocks, order-0 bits, bytes of the four sections
HEADER_BYTES = struct.calcsize(HEADER)
SEGMENT_IDS = 8 << 20  # ids coded side by side; a segment ends with the document that reaches it

FILES = "part long, uri string, n_docs long, n_ids long, n_bytes long"
_FILES = pa.schema([("part", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _section(data: bytes) -> bytes:
    packed = zlib.compress(data, 1)
    return struct.pack("<I", zlib.crc32(packed)) + packed


def _opened(data: bytes, what: str) -> bytes:
    if len(data) < 4 or zlib.crc32(data[4:]) != struct.unpack("<I", data[:4])[0]:
        raise ValueError(f"the {what} of a segment do not match their checksum")
    return zlib.decompress(data[4:])


def write_segment(out: BinaryIO, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> int:
    """Append a segment; returns its bytes."""
    coded = range_coder.encode(ids)
    documents = b"".join([
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u4").tobytes(),
    ])
    sections = [
        _section(documents),
        _section(coded.ids.astype("<u4").tobytes() + coded.freqs.astype("<u4").tobytes()),
        _section(coded.checksums.astype("<u4").tobytes() + coded.n_words.astype("<u4").tobytes()),
        coded.words.astype("<u4").tobytes(),
    ]
    header = struct.pack(HEADER, len(doc_ids), len(ids), len(coded.checksums), coded.bits, *map(len, sections))
    return sum(out.write(x) and len(x) for x in (header, *sections) if x)


def read_segments(file: BinaryIO) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, their numbers of ids, and all ids of each segment of an open file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while True:
        header = file.read(HEADER_BYTES)
        if len(header) < HEADER_BYTES:
            raise ValueError("the file ends before its last segment")
        n_docs, n_ids, n_blocks, bits, *sizes = struct.unpack(HEADER, header)
        if not n_docs:
            return
        parts = [file.read(size) for size in sizes]
        if any(len(p) != size for p, size in zip(parts, sizes, strict=True)):
            raise ValueError("the file ends within a segment")
        documents, table, blocks = (_opened(p, n) for p, n in zip(parts, ("documents", "frequencies", "blocks"), strict=False))
        null = np.frombuffer(documents, "u1", n_docs)
        doc_ids = np.frombuffer(documents, "<i8", n_docs, n_docs).tolist()
        lengths = np.frombuffer(documents, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        table, blocks = np.frombuffer(table, "<u4"), np.frombuffer(blocks, "<u4")
        coded = range_coder.Segment(
            table[: len(table) // 2], table[len(table) // 2 :], bits, n_ids,
            blocks[:n_blocks], blocks[n_blocks:], np.frombuffer(parts[3], "<u4"),
        )
        yield [None if z else d for z, d in zip(null, doc_ids, strict=True)], lengths, range_coder.decode(coded)


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending document order.

    Documents are dealt to ranges of ids, and each range becomes a file; ``part`` numbers the files in
    that order. Returns the list of files (part, uri, n_docs, n_ids, n_bytes), written to the shared
    folder as well: only files on it count, so what a lost task has left does no harm. Null ids come
    first, a null text is empty, rows with the same id are ordered by text. An empty table has no files.
    """
    folder = folder or work_dir(docs.sparkSession, "token-files")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        file: Any = None
        doc_ids: list[int | None] = []
        pending: list[bytes] = []
        total = {"n_docs": 0, "n_ids": 0, "n_bytes": 0}

        def flush() -> None:
            lengths = [len(x) // 4 for x in pending]
            ids = np.frombuffer(b"".join(pending), "<u4")
            total["n_bytes"] += write_segment(file, doc_ids, lengths, ids)
            total["n_docs"] += len(doc_ids)
            total["n_ids"] += len(ids)
            doc_ids.clear()
            pending.clear()

        held = 0
        for rows in text_slices(batches):
            if file is None:
                file, uri = create_file(folder, ".tokens")
                total["n_bytes"] += file.write(MAGIC) or len(MAGIC)
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts_of(rows), strict=True):
                doc_ids.append(doc_id)
                pending.append(bpe.encode(text) + end)
                held += len(pending[-1]) // 4
                if held >= SEGMENT_IDS:
                    flush()
                    held = 0
        if file is not None:
            if pending:
                flush()
            file.write(bytes(HEADER_BYTES))
            file.close()
            total["n_bytes"] += HEADER_BYTES
            yield record_batch(_FILES, part=[TaskContext.get().partitionId()], uri=[uri], **{k: [v] for k, v in total.items()})

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, FILES), "token-list")


def read(files: DataFrame) -> DataFrame:
    """Read listed files back: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32).

    Each file is one task, which holds a segment at a time. ``files`` has one row per file.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri in zip(batch.column("part").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                before = 0
                with open_file(uri) as file:
                    for doc_ids, lengths, ids in read_segments(file):
                        ends = np.cumsum(lengths)
                        raw = ids.astype("<u4").tobytes()
                        for a in range(0, len(doc_ids), 1000):
                            some = slice(a, a + 1000)
                            starts = ends[some] - lengths[some]
                            yield record_batch(
                                _READ, part=[part] * len(starts), doc_id=doc_ids[some], start=before + starts, n_tokens=lengths[some],
                                ids=[raw[4 * x : 4 * y] for x, y in zip(starts, ends[some], strict=True)],
                            )
                        before += int(ends[-1])

    # One row per file: the running count over them is as small as the list itself.
    n_files = files.count()
    offsets = files.select("part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = files.select("part", "uri").repartitionByRange(max(1, n_files), "part").mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(offsets, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
