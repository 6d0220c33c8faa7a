"""Held-out accuracy, and the Kneser-Ney tables against a plain calculation."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeframe.llm import langid
from gradeframe.llm.queries import op7_langid


def plain_probability(counts, key):
    """Interpolated Kneser-Ney by the book, on tuples of symbols."""
    levels = [None] * 4
    levels[3] = dict(counts)
    for n in (2, 1, 0):
        levels[n] = Counter(k[1:] for k in levels[n + 1])

    def discount(level):
        ones, twos = (sum(1 for v in level.values() if v == x) for x in (1, 2))
        return min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95)

    size = len(levels[0]) + 1

    def p(key, n):
        level, d = levels[n], discount(levels[n])
        if n == 0:
            return (max(level.get(key, 0) - d, 0) + d * len(level) / size) / sum(level.values())
        same = {k: v for k, v in level.items() if k[:-1] == key[:-1]}
        lower = p(key[1:], n - 1)
        if not same:
            return lower
        return (max(level.get(key, 0) - d, 0) + d * len(same) * lower) / sum(same.values())

    return p(key, 3)


def unpack(key):
    return tuple(int(key) >> s & 0xFFFF for s in (48, 32, 16, 0))


def test_grams_stay_within_texts():
    keys, owner = langid.grams(["Ab", "", "...", "c, d!"])
    assert owner.tolist() == [0, 0, 0, 3, 3, 3, 3]
    a, b, c, d = (ord(x) for x in "abcd")
    assert [unpack(k) for k in keys] == [(0, 0, 0, a), (0, 0, a, b), (0, a, b, 0), (0, 0, 0, c), (0, 0, c, 0), (0, c, 0, d), (c, 0, d, 0)]


def test_probabilities_are_those_of_the_book():
    text = "the hen then ate the other ten anthers in the heath"
    keys, _ = langid.grams([text])
    distinct, counts = np.unique(keys, return_counts=True)
    model = langid.build(["xx"], np.zeros(len(distinct), int), distinct, counts.astype(float))
    table = {unpack(k): int(n) for k, n in zip(distinct, counts, strict=True)}
    others, _ = langid.grams(["then he hit zeta nah", "the"])
    asked = np.concatenate([distinct, others])
    got = np.exp(model.log_probabilities(asked)[:, 0])
    for key, value in zip(asked, got, strict=True):
        key = unpack(key)
        if all(s in {k[-1] for k in table} for s in key[-1:]):
            assert value == pytest.approx(plain_probability(table, key), rel=1e-4)
    # After one context, all symbols together have probability 1.
    context = int(distinct[5]) >> 16 << 16
    every = np.array([context | s for s in {k[-1] for k in table}], np.uint64)
    total = np.exp(model.log_probabilities(every)[:, 0]).sum()
    assert total <= 1 + 1e-4 and total > 0.9


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_langid(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in known]) > 0.98
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)


def test_edge_cases(spark):
    texts = {"aa": "anna ate a large apple at alma and all ", "bb": "bob both boo hobby lobby knob bobbin "}
    rows = [(i, texts["aa" if i % 2 else "bb"] * (i % 5 + 1), "aa" if i % 2 else "bb", 0.5) for i in range(60)]
    rows += [(100, None, "aa", 0.1), (101, "123 ... !!", "bb", 0.1), (None, "bobbin hobby", None, 0.2), (103, "", "aa", 1.0), (104, "жжж щщщ ыыы " * 50, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.learn(docs)
    got = defaultdict(list)
    for r in langid.predict(docs, model).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].lang_pred == ("aa" if i % 2 else "bb") and not got[i][0].rejected for i in range(60))
    assert [got[i][0].lang_pred for i in (100, 101, 103)] == ["und"] * 3 and got[None][0].lang_pred == "bb"
    assert all(got[i][0].rejected for i in (100, 101, 103, 104))
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 61
    nothing = docs.limit(0)
    assert langid.learn(nothing) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_no_ngram_is_lost_beyond_the_cells_of_a_task(spark, monkeypatch):
    # A language of few rows among larger ones, with a model of many files: the same costs as from one table.
    texts = {"aa": "anna ate a large apple at alma and all ", "bb": "bob both boo hobby lobby knob bobbin ", "cc": "zwölf öxte jüggeln über zäune "}
    rows = [(i, texts["aa" if i % 2 else "bb"] * (i % 5 + 1), "aa" if i % 2 else "bb") for i in range(80)] + [(100 + i, texts["cc"], "cc") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.learn(docs)
    monkeypatch.setattr(langid, "MAX_CELLS", 30)
    monkeypatch.setattr(langid, "SHARD_ENTRIES", 20)
    model = langid.learn(docs)
    asked = [*texts.values(), "an apple über bob", "жжж"]
    assert langid.entropies(model, asked)[0] == pytest.approx(langid.entropies(whole, asked)[0], rel=1e-4)
    assert len(model.files["gram", 4]) > 3
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_rejection_in_a_rare_language(spark):
    # 12 of 6,018 texts are "cc"; nonsense whose cheapest language is "cc" is rejected all the same.
    texts = {"aa": "anna ate a large apple at alma and all ", "bb": "bob both boo hobby lobby knob bobbin ", "cc": "жук жужжит над лужей ", "dd": "ξένος λόγος "}
    rows = [(i, texts["aa" if i % 2 else "bb"] * (i % 3 + 1), "aa" if i % 2 else "bb") for i in range(6000)]
    rows += [(7000 + i, texts["cc"] * (i % 3 + 1), "cc") for i in range(12)] + [(8000 + 4 * i, texts["dd"], "dd") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert np.isfinite(model.mean).all()
    strange = spark.createDataFrame([(1, "жщуэ дфыж лщъу кзжн " * 40), (2, texts["cc"] * 2)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(strange, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "cc"
    assert got[1].rejected and not got[2].rejected
    # The statistics are those of all learning rows of the language.
    own = [t for d, t, lang in rows if lang == "cc" and zlib.crc32(str(d).encode()) % 4 != 2]
    h, n = langid.entropies(model, own)
    k = model.languages.index("cc")
    assert model.mean[k] == pytest.approx(np.average(h[:, k], weights=n)) and model.spread[k] == pytest.approx(h[:, k].std(), abs=1e-6)
