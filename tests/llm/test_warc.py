"""Archives read back whole, and damaged ones refused."""

import hashlib
import io
import struct

import pytest
import zstandard

from gradeframe.llm import warc
from gradeframe.llm.queries import op4_warc


def plain(pages):
    first = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=repr)


def test_op4_whole_table(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = op4_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=repr) == plain(pages)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    same = "<p>same ü</p>" * 20
    pages = [
        (1, "http://a/ü x\r\ny", same), (2, None, same), (-3, "http://b", same), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
        (None, "n", same), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "long", "words " * 200_000),
        (13, "crlf", "a\r\n\r\nb" * 40), (14, "twice", "t" * 200), (14, "twice", "t" * 200),
    ]
    frame = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, payload string, record_type string")
    files = warc.write(warc.record_types(frame), warc.train_dictionary(frame))
    rows = warc.read(files).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == plain(pages)
    assert sum(r.n_records for r in files.collect()) == len(pages)
    texts = {r.page_id: r.payload for r in rows if r.record_type == "response"}
    assert bytes(texts[13]).decode() == pages[13][2] and bytes(texts[-3]).decode() == same
    assert {r.page_id: r.url for r in rows}[1] == "http://a/%C3%BC%20x%0D%0Ay"
    empty = frame.limit(0)
    assert warc.read(warc.write(warc.record_types(empty), warc.train_dictionary(empty))).collect() == []


def archive(records, data=b"WARC/1.1 raw content", compressed=False):
    press = zstandard.ZstdCompressor(dict_data=warc.dictionary(data))
    stored = zstandard.ZstdCompressor().compress(data) if compressed else data
    return struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored + b"".join(press.compress(r) for r in records)


def test_damage_is_found():
    def record(n, text=b"payload"):
        return warc._record("response", n, "http://h", "2000-01-01T00:00:00Z", text, len(text), hashlib.sha256(text).hexdigest(), None)

    good = archive([record(1), record(2)])
    assert [warc._row(warc.parse(f))[0] for f in warc.frames(io.BytesIO(good))] == [1, 2]
    assert [warc._row(warc.parse(f))[0] for f in warc.frames(io.BytesIO(archive([record(1)], compressed=True)))] == [1]
    for bad in (good[8:], good[:-3], b"", good[:12]):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(bad)))
    one = record(1)
    for bad in (
        one[:-1], one + b"x", one.replace(b"WARC/1.1", b"WARC/9.9"), one.replace(b"WARC-Date", b"Date"), one.replace(b"payload", b"PAYLOAD"),
        one.replace(b"Content-Length: 7", b"Content-Length: 8"), one.replace(b"WARC-Type: response", b"WARC-Type: resource"),
    ):
        with pytest.raises(ValueError):
            warc._row(warc.parse(bad))
