"""Held-out accuracy of the ranking, and its edge cases."""

import zlib

import numpy as np

from gradeframe.llm import quality
from gradeframe.llm.queries import op2_quality


def test_op2_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op2_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.7) for r in rows.values())
    held = [x for x in labels if rows[x.doc_id].held_out]
    good = [rows[x.doc_id].score for x in held if x.quality == 1]
    bad = [rows[x.doc_id].score for x in held if x.quality == 0]
    assert np.mean([rows[x.doc_id].predicted == x.quality for x in held]) > 0.97
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.99


def test_fit_ranks_pairs():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, quality._N**2 + 6))
    labels = (rows[:, 3] + 0.3 * rng.normal(size=400) > 0.5).astype(int)
    ranking = quality.fit(rows, labels, 1 - labels.mean())
    scores = ranking.scores(rows)
    assert abs((scores >= quality.GOOD).mean() - labels.mean()) < 0.01
    assert np.mean((scores >= quality.GOOD) == labels) > 0.9
    assert np.argmax(np.abs(ranking.weights)) == 3


def test_edge_cases(spark):
    texts = ["Plain words in a row, and more of them.", "$$$ ### @@@ || !! %%"]
    rows = [(i, texts[i % 2] * (i % 7 + 1), 0.5) for i in range(200)] + [(None, None, 0.1), (900, "", 0.1), (901, "x" * 100_000, 0.2), (5, texts[1], 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(200)] + [(None, 1, 1), (7, None, 1), (8, 5, 0)], "doc_id long, quality int, text string")
    scored = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(scored) == len(rows)
    by_id = {r.doc_id: r for r in scored}
    assert all(by_id[i].predicted == 1 - i % 2 for i in range(200))
    for known, predicted in ((labels.limit(0), 0), (labels.filter("quality = 1"), 1), (labels.filter("quality = 0"), 0)):
        assert {r.predicted for r in quality.score(docs, quality.learn(docs, known)).collect()} == {predicted}
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels)).collect() == []


def test_fit_equals_plain_gradient_descent():
    """The same loss on the same pairs, minimised by small plain steps."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(120, quality._N**2 + 6))
    rows[:, 10:] = 0
    labels = (rows[:, 1] - rows[:, 4] + rng.normal(size=120) > 0).astype(int)
    ranking = quality.fit(rows, labels, 0.5, seed=3)
    x = (rows - rows.mean(axis=0)) / np.maximum(rows.std(axis=0), 1e-3)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    n = quality.PAIRS_PER_ROW
    # draws of fit come in the order of its two calls
    draw = np.random.default_rng(3)
    against_good = draw.choice(good, len(bad) * n)
    against_bad = draw.choice(bad, len(good) * n)
    first = np.concatenate([np.repeat(good, n), against_good])
    second = np.concatenate([against_bad, np.repeat(bad, n)])
    def loss(w):
        s = x @ w
        return np.mean(np.log1p(np.exp(s[second] - s[first]))) + 0.5 * quality.RIDGE * w @ w

    w = np.zeros(x.shape[1])
    for _ in range(4000):
        p = 1 / (1 + np.exp(x[first] @ w - x[second] @ w))
        w -= 0.5 * ((p[:, None] * (x[second] - x[first])).mean(axis=0) + quality.RIDGE * w)
    assert abs(loss(ranking.weights) - loss(w)) < 1e-5
    assert np.abs(ranking.weights - w).max() < 0.02
    scores = np.sort(x @ ranking.weights)
    assert scores[59] < ranking.cut < scores[60]


def test_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows of one label join several small groups; sums, pairs and cut cover all rows, whatever their number."""
    monkeypatch.setattr(quality, "GROUP_ROWS", 64)
    monkeypatch.setattr(quality, "GROUP_PARTNERS", 4)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(12_000):
        good = i % 10 < 9
        words = ["".join(rng.choice(list("abcdefgh" if good else "aBc1$#/."), 5)) for _ in range(6)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 < 9)) for i, _ in rows], "doc_id long, quality int")
    ranking = quality.learn(docs, labels)
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    known = np.array([int(i % 10 < 9) for i, _ in used])
    all_features = quality.features([t for _, t in used]).astype(np.float64)
    np.testing.assert_allclose(ranking.middle, all_features.mean(axis=0), atol=1e-6)
    np.testing.assert_allclose(ranking.scale, np.maximum(all_features.std(axis=0), 1e-3), rtol=1e-4)
    scores = np.sort((all_features - ranking.middle) / ranking.scale @ ranking.weights)
    below = round((known == 0).mean() * len(used))
    assert abs(ranking.cut - scores[below - 1 : below + 1].mean()) < 1e-4
    predicted = {r.doc_id: r.predicted for r in quality.score(docs, ranking).collect()}
    assert np.mean([predicted[i] == int(i % 10 < 9) for i, _ in rows]) > 0.99


def test_each_row_is_paired_once_and_lent_rows_only_as_partners():
    labels, own = np.array([1, 1, 0, 0, 1]), np.array([True, True, True, False, True])
    first, second = quality._partners(labels, own, np.random.default_rng(0))
    n = quality.PAIRS_PER_ROW
    assert len(first) == 4 * n and set(labels[first]) == {1} and set(labels[second]) == {0}
    assert np.array_equal(first[: 3 * n], np.repeat([0, 1, 4], n)) and np.array_equal(second[3 * n :], [2] * n)
