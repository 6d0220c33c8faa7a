"""Counts against the Unigram model of the tokenizers library, over the same pieces and scores."""

import public_tokenizers
import pytest
from tokenizers.models import Unigram

from gradeframe.llm import viterbi
from gradeframe.llm.queries import op9_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a ", "Hello  world\n é 🎉", "\n", "\n\n a\n", "▁x ▁ y", "unbelievable thing", "тест 日本語 ",
    "aaaaaaaaaaaaaaaaaaaaaaaaa", "      deep   spaces      ", "tab\tx\r\ny", "𝔘𝔫𝔦 ﬁ", "x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    vocab = viterbi.vocabulary(PATH)
    pieces = [("<unk>", 0.0), *vocab.pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    return Unigram(pieces, 0, True)


def expected(library, text):
    return len(library.tokenize("▁" + text.replace(" ", "▁"))) if text else 0


def test_counts_equal_the_library(library):
    counter = viterbi.Counter(viterbi.vocabulary(PATH), limit=3)
    for text in ODD * 2:
        assert counter.count(text) == expected(library, text), text


def test_ties_go_to_the_longest_last_piece():
    tied = viterbi.Vocabulary((("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.0)), -3.0)
    library = Unigram([("<unk>", 0.0), *tied.pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))], 0, True)
    counter = viterbi.Counter(tied)
    for text in ("ab", "aba", "abab", "ababab ab aba", "cab é b"):
        assert counter.count(text) == expected(library, text), text


def test_pieces_across_words_are_kept_whole():
    across = viterbi.Vocabulary((("▁", -1.0), ("a", -5.0), ("a▁a", -1.0), ("▁a", -2.0)), -5.0)
    assert viterbi.Counter(across).count("a a") == 2  # "▁", "a▁a"


def test_op9_whole_table(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.n_tokens == expected(library, docs[r.doc_id]) for r in rows)


def test_edge_cases(spark):
    frame = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (3, "b"), (3, "b")], "doc_id long, text string")
    frame = frame.selectExpr("*", "1 AS n_tokens")
    assert sorted(r.n_tokens for r in viterbi.token_counts(frame, PATH).collect()) == [0, 0, 1, 1, 1]
    assert viterbi.token_counts(frame.limit(0), PATH).collect() == []
