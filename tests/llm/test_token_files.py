"""Round trips of the range coder and the token files, and the query against the tokenizer itself."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeframe.llm import range_coder, token_files
from gradeframe.llm.queries import op10_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 5, 4095, 4096, 4097, 9001])
@pytest.mark.parametrize("high", [1, 2, 60, 70_000, 1 << 32])
def test_coder_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    coded = range_coder.encode(ids)
    assert (range_coder.decode(coded) == ids).all()
    assert len(coded.checksums) == -(-n // range_coder.BLOCK_IDS)


def test_coder_format_stays():
    # Words that the coder wrote before its steps kept to one type per array.
    ids = (np.random.default_rng(5).zipf(1.3, 30_000).clip(0, 5000) % 701).astype(np.uint32)
    coded = range_coder.encode(ids)
    assert (len(coded.words), zlib.crc32(coded.words.astype("<u4").tobytes())) == (5657, 1315472450)
    assert (range_coder.decode(coded) == ids).all()
    model = range_coder.Model(3)
    assert {x.dtype for x in (model.base, *model.tables, model.weights, *model.last, model.weight)} == {np.dtype(np.uint32)}


def test_coder_learns_contexts():
    ids = np.tile(np.random.default_rng(0).integers(0, 5000, 200), 60).astype(np.uint32)
    coded = range_coder.encode(ids)
    assert len(coded.words) * 32 / len(ids) < 2  # 7.6 bits by order 0 alone
    assert (range_coder.decode(coded) == ids).all()


def test_damage_is_found():
    out = io.BytesIO()
    out.write(token_files.MAGIC)
    ids = np.random.default_rng(0).integers(0, 300, 9000).astype(np.uint32)
    token_files.write_segment(out, [1, None], [4000, 5000], ids)
    out.write(bytes(token_files.HEADER_BYTES))
    good = out.getvalue()
    ((doc_ids, lengths, back),) = token_files.read_segments(io.BytesIO(good))
    assert doc_ids == [1, None] and lengths.tolist() == [4000, 5000] and (back == ids).all()
    for at in (60, 500, len(good) // 2, len(good) - token_files.HEADER_BYTES - 500):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.read_segments(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(token_files.read_segments(io.BytesIO(good[:-5])))


def expected(docs):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op10_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op10_token_files(spark, sf).collect())) == expected(docs)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    docs = [(None, "null id"), (-5, None), (0, ""), (1, "word " * 3000), (2, "same"), (2, "same"), (2, "other"), (9, "ü\n<|endoftext|>")]
    frame = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, ids string, part int")
    from pyspark.sql import functions as F

    rows = token_files.read(token_files.write(frame, PATH)).withColumn("crc", F.crc32("ids")).drop("ids").collect()
    in_order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected(in_order)
    assert token_files.read(token_files.write(frame.limit(0), PATH)).collect() == []
