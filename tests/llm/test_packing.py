"""Token pieces against the tokenizer itself, and packing against its own rules and a lower bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeframe.llm import packing
from gradeframe.llm.bpe import ByteBpe
from gradeframe.llm.queries import op1_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", " a ", "a\n b", "a \n b  c   d ", "foo\n ", "it's 'll don't", "x<|endoftext|> y <|endoftext|>",
    "tab\t x   y　z", "a\x1c b \x1c c", "日本語 テスト  \n\n 12 3", "é é 🎉 🎉🎉", "a-b_c.d,, ..\r\n!!  ??", "ÀÖØ ɏ× ÷ªµ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def reference_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizers(tokenizer):
    bpe = ByteBpe(PATH, limit=5)
    for text in ODD * 2:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference_ids(tokenizer, text)[:-1], text


def check(rows, docs, tokenizer, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, text in docs:
        ids = reference_ids(tokenizer, text)
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            part = ids[at : at + r.length]
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    return len(bins)


def test_op1_whole_table(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op1_packing(spark, sf).collect()
    total = sum(r.length for r in rows)
    assert check(rows, docs, tokenizer, 2048) <= 1.02 * total / 2048 + 1


def test_edge_cases(spark, tokenizer):
    texts = [*ODD, None, "word " * 5000, "same", "same"]
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, length int")
    cut = packing.cut(frame, PATH, capacity=64)
    from pyspark.sql import functions as F

    rows = packing.place(cut.withColumn("ids_crc32", F.crc32("ids")), 64, group_pieces=8).collect()
    check(rows, docs, tokenizer, 64)
    repeated = spark.createDataFrame([(None, "a b c")] * 50, "doc_id long, text string")
    rows = packing.place(packing.cut(repeated, PATH), group_pieces=8).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50
    assert packing.place(packing.cut(frame.limit(0), PATH)).collect() == []


def test_sum_of_squares_is_least():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 20, 300)
    bins, offsets, fill = packing.sum_of_squares(lengths, 20)
    level = {}
    for size, b, o in zip(lengths, bins, offsets, strict=True):
        def total(where, level=level, size=size):
            after = dict(level)
            after[where] = after.get(where, 0) + int(size)
            values = [v for v in after.values() if v < 20]
            return sum(values.count(v) ** 2 for v in set(values))

        choices = [k for k, v in level.items() if v + size <= 20] + [max(level, default=-1) + 1]
        assert level.get(b, 0) == o and total(b) == min(map(total, choices))
        level[b] = level.get(b, 0) + int(size)
    assert [level[b] for b in range(len(fill))] == fill.tolist()
