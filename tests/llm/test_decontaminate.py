"""The FM-index and the query against plain searches."""

import hashlib
import re

import numpy as np

from gradeframe.llm import decontaminate as dc
from gradeframe.llm.fm_index import FmIndex, suffix_order
from gradeframe.llm.queries import op8_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = sorted({len(w) for w in wanted})
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[key]
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def result(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()}


def test_suffix_order():
    rng = np.random.default_rng(0)
    for high in (2, 4, 500):
        s = np.concatenate([rng.integers(1, high, 300), [0]])
        order = suffix_order(s).tolist()
        assert order == sorted(range(301), key=lambda i: s[i:].tolist())


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    segments = [rng.integers(2, 5, n) for n in (1, 2, 30, 200, 200)] + [np.full(90, 3)] * 2
    index = FmIndex(segments, 6)
    for length in (1, 2, 3, 7):
        phrases = np.unique(np.array([rng.integers(2, 6, length) for _ in range(60)]), axis=0)
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high, strict=True):
            segment, offset = index.locate(np.arange(a, b))
            expected = [(n, i) for n, s in enumerate(segments) for i in range(len(s) - length + 1) if (s[i : i + length] == phrase).all()]
            assert sorted(zip(segment.tolist(), offset.tolist(), strict=True)) == expected


def test_op8_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = plain(docs, items)
    assert result(op8_decontamination(spark, sf)) == expected
    assert any(x[4] for x in expected.values())


def contaminated(docs, benchmark):
    from pyspark.sql import functions as F

    return dc.contamination(docs, benchmark).selectExpr(
        "doc_id", "n_words", "n_hit", "size(items) AS n_items", "sha2(concat_ws(',', items), 256) AS items_sha256", "n_hit > 0 AS contaminated"
    ).withColumn("n_items", F.col("n_items").cast("long"))


def test_edge_cases(spark, monkeypatch):
    items = [
        (3, "Alpha beta, gamma"), (10, "one two three four five six seven eight nine ten ELEVEN twelve"), (2, None), (4, "..."),
        (5, "Übung ÉÉ"), (3, "delta epsilon"), (None, "zeta eta"), (6, "a a a a a a a a a a"),
    ]
    docs = [
        (1, "x alpha BETA-gamma y alpha beta gamma"), (2, None), (3, ""), (4, "One two three four five six seven eight nine ten, eleven"),
        (5, "two three four five six seven eight nine ten"), (6, "übung Übung ÉÉ éé"), (7, "delta epsilon. zeta ETA"), (8, "a " * 500),
        (9, "alpha beta " * 3000 + "gamma"), (10, "  alpha beta gamma"), (11, "a " * 500),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n_hit int, items string")
    expected = plain(docs, [("null" if i is None else i, t) for i, t in items])
    assert result(contaminated(frame, benchmark)) == expected
    monkeypatch.setattr(dc, "BLOCK_WORDS", 4)
    monkeypatch.setattr(dc, "SHARD_BYTES", 300)
    monkeypatch.setattr(dc, "ROWS_AT_ONCE", 7)
    assert result(contaminated(frame, benchmark)) == expected
    assert all(r.n_hit == 0 for r in contaminated(frame, benchmark.limit(0)).collect())
    assert contaminated(frame.limit(0), benchmark).collect() == []
    cut = dc.without_benchmark(frame, benchmark)
    assert cut.columns == frame.columns and cut.count() == len(docs)
    assert {r.doc_id: r.text for r in cut.collect()}[1] == "x  y "
    assert not any(x[1] for x in result(contaminated(cut, benchmark)).values())
    spans = {r.doc_id: r.spans for r in dc.contamination(frame, benchmark).collect()}
    assert [docs[0][1][s.start : s.end] for s in spans[1]] == ["alpha BETA-gamma", "alpha beta gamma"]
