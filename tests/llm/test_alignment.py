"""Alignment and counts against a plain version over the libraries' own tokens, and the perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from gradeframe.llm import alignment, perfect_hash
from gradeframe.llm.queries import op11_alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", " a ", "Hello  world\n é 🎉", "\n", "\n\n a\n", "x▁y", "plain words\nnext line", "a\n b \n\nc\td", "it's 1234's",
    "<|endoftext|> and </s><unk>", "тест 日本語   x y", "\x1c a\x1cb \x85 c", "      deep   spaces      ", "x" * 500, "don't won't\r\nx", "a　b 'll",
    "Hello  world\n é 🎉", "<0x41>", "\x00", "﻿ bom",
]


@pytest.fixture(scope="module")
def plain():
    """Plain results of texts: dictionaries as the query returns, in order."""
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECES)
    letters = {}
    for i in range(a.get_vocab_size()):
        letters[i] = a.id_to_token(i)
    alphabet = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    n = 0
    for byte in range(256):
        alphabet[chr(byte) if byte in printable else chr(256 + n)] = byte
        n += byte not in printable
    assert ByteLevel().decode(["Ġé".replace("é", "Ã©")]) == " é"

    def tokens(text):
        if not text:
            return [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in letters[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], []
        return list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True))

    def spans(side):
        out, at = [], 0
        for i, data in side:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def run(texts):
        linked, rows = [], []
        for text in texts:
            left, right = (spans(s) for s in tokens(text))
            links, j = [], 0
            for i, s, e in left:
                while j < len(right) and right[j][2] <= s:
                    j += 1
                k = j
                while k < len(right) and right[k][1] < e:
                    links.append((i, right[k][0]))
                    k += 1
            both = sorted({e for _, _, e in left} & {e for _, _, e in right})
            groups, start = [], 0
            for end in both:
                groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (left, right)))
                start = end
            linked.append(links)
            rows.append({"n_a": len(left), "n_b": len(right), "n_groups": len(groups), "n_links": len(links), "groups": ";".join(groups)})
        counts = Counter(p for links in linked for p in links)
        most = {}
        for (_, y), c in counts.items():
            most[y] = max(most.get(y, 0), c)
        for row, links in zip(rows, linked, strict=True):
            row["n_best"] = sum(counts[p] == most[p[1]] for p in links)
            row["count_sum"] = sum(counts[p] for p in links)
        return rows

    return run


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        hashed = perfect_hash.PerfectHash.build(keys)
        assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
        again, columns = perfect_hash.load(perfect_hash.dump(hashed, keys=keys))
        assert (again.index(keys) == hashed.index(keys)).all() and (columns["keys"] == keys).all()
        others = hashed.index(keys + (1 << 41))
        assert ((others >= -1) & (others < max(1, len(keys)))).all()


def rows_of(frame):
    return [r.asDict() for r in frame.orderBy("n").collect()]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, plain, monkeypatch, small):
    if small:  # many shards, vectors and steps of the tree, a cache that holds one shard, several blocks of a task
        for name, value in (("SHARD_KEYS", 8), ("VECTOR_ROWS", 1), ("FAN_IN", 2), ("CACHE_BYTES", 1), ("KEPT_PAIRS", 5), ("SLICE", 40)):
            monkeypatch.setattr(alignment, name, value)
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, key long").repartition(3)
    found = {r.doc_id: r.asDict() for r in alignment.align(frame, BYTES, PIECES).collect()}
    for i, row in enumerate(plain(ODD)):
        for name, value in row.items():
            assert found[i][name] == value, (ODD[i], name)


def test_op11_whole_table(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: r.asDict() for r in op11_alignment(spark, sf).collect()}
    assert found.keys() == docs.keys()
    for doc_id, row in zip(docs, plain(docs.values()), strict=True):
        groups = row.pop("groups")
        assert {k: found[doc_id][k] for k in row} == row
        assert found[doc_id]["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_edge_cases(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = alignment.align(frame, BYTES, PIECES).collect()
    assert sorted((r.n_links, r.count_sum, r.n_best) for r in rows) == [(0, 0, 0), (2, 6, 2), (2, 6, 2), (2, 6, 2)]
    assert alignment.align(frame.limit(0), BYTES, PIECES).collect() == []
    assert [r.n_a for r in alignment.align(frame.where("text IS NULL"), BYTES, PIECES).collect()] == [0]
