"""Fingerprints against true shingle similarity, and the query against a plain walk over the table."""

import hashlib

import numpy as np

from gradeframe.llm import fingerprints as fp
from gradeframe.llm.queries import op5_fingerprints


def true_likeness(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, docs):
    assert len(rows) == len(docs)
    rows = {r.doc_id: r for r in rows}
    errors = []
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        text, following, r = text or "", following or "", rows[doc_id]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fp.shown(*fp.fingerprints([text]))[0]
        assert r.edited_fingerprint == fp.shown(*fp.fingerprints([changed]))[0]
        errors += [r.near_edited - true_likeness(text, changed), r.near_next - true_likeness(text, following)]
    return np.array(errors)


def test_op5_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    errors = check(op5_fingerprints(spark, sf).collect(), docs)
    assert abs(errors.mean()) < 0.01 and np.sqrt((errors**2).mean()) < 0.06 and abs(errors).max() < 0.3


def test_edge_cases(spark):
    docs = [(None, "null id comes first of all"), (1, None), (2, ""), (3, "few words"), (4, "word " * 4000), (5, "ü🎉" * 99), (6, "few words")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, following string").repartition(5)
    errors = check(fp.with_edits(frame).collect(), docs)
    assert abs(errors).max() < 0.5  # two shingles against two others
    alone = fp.with_edits(frame.filter("doc_id = 3")).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(3, 1.0)]
    assert fp.with_edits(frame.limit(0)).collect() == []
    repeated = fp.with_edits(spark.createDataFrame([(7, "a b c d e f")] * 9, "doc_id long, text string")).collect()
    assert len(repeated) == 9 and {r.near_next for r in repeated} == {1.0}


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(4000)]
    errors = []
    for _ in range(30):
        a = rng.choice(words, 900)
        b = a.copy()
        b[rng.choice(900, 40, replace=False)] = "changed"
        a, b = " ".join(a), " ".join(b)
        prints, has = fp.fingerprints([a, b])
        errors.append(fp.likeness(prints[:1], has[:1], prints[1:], has[1:])[0] - true_likeness(a, b))
    assert abs(np.mean(errors)) < 0.015


def test_packed_size():
    (text,) = fp.shown(*fp.fingerprints(["one two three four five six"]))
    assert len(bytes.fromhex(text)) == fp.BINS * fp.BITS // 8
    assert fp.shown(*fp.fingerprints([""])) == [""]
