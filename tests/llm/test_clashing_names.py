"""Columns of documents may have any name, also those that operators use themselves; item ids may have any letters."""

import hashlib

from gradeframe.llm import near_dedup, secret_scan
from gradeframe.llm import decontaminate as dc

ODD = ["wanted", "secret_spans", "__text", "__merged", "__digest", "__id", "digest", "kept", "label", "v", "column_0", "own_digest", "__candidate"]
SECRET = "a token: abcdef123456 here"


def frame(spark, texts):
    rows = [(i, t, *(f"{c}{i}" for c in ODD)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in ODD))


def test_no_secret_is_left_under_any_name(spark):
    docs = frame(spark, [SECRET, "clean", None])
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "a [SECRET] here" or "abcdef123456" not in rows[0].text
    assert rows[1].text == "clean" and rows[2].text is None
    for i, r in rows.items():
        assert [r[c] for c in ODD] == [f"{c}{i}" for c in ODD]


def test_other_id_and_text_columns(spark):
    docs = spark.createDataFrame([("x", SECRET, "t", "i")], "key string, body string, text string, doc_id string")
    row = secret_scan.redacted(docs, "key", "body").first()
    assert "abcdef123456" not in row.body and (row.text, row.doc_id, row.key) == ("t", "i", "x")


def test_near_copies_keep_their_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = frame(spark, [text, text, text + " more", "another text of its own", None])
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [0, 3, 4]
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in ODD)


def test_item_ids_with_line_breaks_stay_apart(spark):
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([("a\nb", words), ("a b", words), ("c,d", words), ('e"\\', words)], "item_id string, text string")
    docs = spark.createDataFrame([(1, words), (2, "nothing")], "doc_id long, text string")
    rows = {r.doc_id: r for r in dc.contamination(docs, items).collect()}
    assert list(rows[1]["items"]) == sorted(["a\nb", "a b", "c,d", 'e"\\']) and list(rows[2]["items"]) == []
    assert hashlib.sha256(",".join(rows[1]["items"]).encode()).hexdigest()
