"""Ids and texts against the sentencepiece library, and the merge rounds against one merge after another."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from gradeframe.llm import piece_bpe
from gradeframe.llm.queries import op13_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a ", "Hello  world\n é 🎉", "\n", "\n\n a\n", "▁x ▁ y", "▁▁", "a▁", "тест 日本語 ", "x" * 3000,
    "aaaaaaaaaaaaaaaaaaaaaaaaa", "      deep   spaces      ", "tab\tx\r\ny", "𝔘𝔫𝔦 ﬁ", "</s><s><unk><0x41>", "\x00 \x7f﻿", " " * 500,
    "abababababab banana ananas nananana", "0000000000001111", "=" * 77, "é" * 50, "é̂", "�​",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(PATH, limit=50)


def ids_of(bpe, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in bpe.encode(texts)]


def test_ids_equal_the_library(bpe, library):
    for texts in (ODD, ODD[::-1]):
        assert ids_of(bpe, texts) == library.encode(texts)


def test_random_letters_equal_the_library(bpe, library):
    rng = random.Random(5)
    letters = ["ab ", "aeinrst  ", "▁ a\n", "üéß日本🎉 ab", "=-_./ 01", "".join(map(chr, range(32, 127)))]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    texts += ["".join(rng.choice(group) for _ in range(rng.randint(0, 200))) for group in letters for _ in range(300)]
    assert ids_of(bpe, texts) == library.encode(texts)


def test_whole_text_as_one_word(library):
    whole = piece_bpe.PieceBpe(PATH)
    whole.words_of = lambda t: [t] if t else []
    assert ids_of(whole, ODD) == library.encode(ODD)


def one_by_one(bpe, symbols):
    """The plain rule: the pair of least rank, the leftmost of several, one merge at a time."""
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, joined = bpe.merges.pairs(np.array(symbols[:-1]), np.array(symbols[1:]))
        at = int(np.argmin(rank))
        if rank[at] == piece_bpe.NO_PAIR:
            break
        symbols[at : at + 2] = [int(joined[at])]
    return symbols


def test_ranks_that_fall_are_merged_in_turn():
    """A vocabulary whose later pieces come before their parts, where merging all at once goes wrong."""
    rng = random.Random(9)
    for _ in range(60):
        pieces = ["a", "b", "c", *{"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)}]
        bpe = piece_bpe.PieceBpe.__new__(piece_bpe.PieceBpe)
        bpe.size = len(pieces)
        bpe._prepare({p: i for i, p in enumerate(pieces)}, np.array([float(rng.randint(0, 12)) for _ in pieces]))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(40)]
        merged = bpe._merge(words)
        for word, data in zip(words, merged, strict=True):
            assert np.frombuffer(data, "<u4").tolist() == one_by_one(bpe, [pieces.index(c) for c in word]), (pieces, word)


def test_texts_of_any_ids_equal_the_library(bpe, library):
    rng = random.Random(7)
    lists = [[], [2], [1, 2], [0], [2, 0, 5], [29871], [29871, 29871], [1, 29871, 259], [3, 29871], [198, 130, 200], [227, 131, 175, 13, 230]]
    lists += [[rng.choice([rng.randrange(3, 259), rng.randrange(bpe.size), 1, 0, 29871]) for _ in range(rng.randint(1, 12))] for _ in range(4000)]
    for ids in lists:
        assert bpe.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_op13_whole_table(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = [*library.encode(docs[r.doc_id] or ""), 2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_cases(spark):
    frame = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (3, "b c"), (3, "b c")], "doc_id long, text string")
    frame = frame.selectExpr("*", "1 AS ids", "text AS n_tokens")
    rows = piece_bpe.decode(piece_bpe.encode(frame, PATH), PATH).collect()
    assert sorted(r.text for r in rows) == ["", "", "a", "b c", "b c"]
    assert sorted(len(r.ids) for r in rows) == [1, 1, 2, 3, 3]
    assert all(r.ids[-1] == 2 for r in rows)
    assert piece_bpe.decode(piece_bpe.encode(frame.limit(0), PATH), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in piece_bpe.decode(nothing, PATH).collect()] == ["", ""]


def test_a_long_text_without_spaces(bpe, library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30_000))
    assert ids_of(bpe, [text]) == library.encode([text])
