"""Spans against plain regular expressions, trigram queries against matches, and the SQL of the query."""

import hashlib
import random
import re

import duckdb
import pytest

from gradeframe.llm import secret_scan as ss
from gradeframe.llm.queries import ORACLES, op3_secret_scan
from gradeframe.llm.trigram_query import trigram_query


def plain(text):
    spans = []
    for n, rule in enumerate(ss.RULES):
        for m in re.finditer(rule.pattern, text or "", re.I | re.A if rule.any_case else re.A):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), n, m.end()))
    spans.sort()
    counts = [sum(s[1] == n for s in spans) for n in range(3)]

    def join(some):
        return ",".join(f"{ss.RULES[n].kind}:{a}:{b}" for a, n, b in some)

    return (*counts, hashlib.sha256(join(s for s in spans if s[1] < 3).encode()).hexdigest(), join(spans))


def test_queries_of_the_rules():
    assert trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert trigram_query("[0-9a-f]+") is None and trigram_query("(abcd)*") is None and trigram_query("ab") is None
    assert trigram_query("(abcd|xyz)+") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert trigram_query("a(bc)?d.*efg") == {frozenset({"efg"})}
    assert trigram_query("x[ab]{2}y") == {frozenset({f"x{a}{b}", f"{a}{b}y"}) for a in "ab" for b in "ab"}
    assert trigram_query("(ab)+cd") is None
    query = trigram_query(ss.BASE_RULES[0].pattern)
    assert {frozenset({"tok", "oke", "ken"}), frozenset({"sec", "ecr", "cre", "ret"}), frozenset({"api", "pik", "ike", "key"})} <= query
    assert len(query) == 6


def test_queries_hold_for_matches():
    rng = random.Random(3)
    samples = {
        "assign": ["password=abcdef", "ApiKey: 'x.y-z=1'", 'API_KEY" = "aaaaaaaa', "passwd:123456", "TOKEN =abcdef"], "access": ["AKIA" + "X1" * 10],
        "github": ["gh" + c + "_" + "a1" * 18 for c in "pousr"], "slack": [f"xox{c}-1234567890a" for c in "abprs"], "google": ["AIza" + "_" * 35],
        "jwt": ["eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10], "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----"],
    }
    for rule in ss.RULES:
        query = trigram_query(rule.pattern)
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text, re.I if rule.any_case else 0)
            shown = f"{rng.random()} {text} {rng.random()}".lower()
            assert query is not None and any(all(t in shown for t in s) for s in query), (rule.kind, text)


def test_op3_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r.doc_id: r for r in op3_secret_scan(spark, sf).collect()}
    assert len(rows) == len(docs)
    expected = {d.doc_id: plain(d.text) for d in docs}
    assert {k: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for k, r in rows.items()} == expected
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = con.sql(ORACLES["op3_secret_scan"]).fetchall()
    assert {r[0]: r[1:] for r in sql} == expected


@pytest.fixture(scope="module")
def texts():
    return [
        None, "", "token=abc token=abcdef", "secret=token:abcdefg", 'api_key" : "a+b/c_d" é🎉 ApiKey=\'zzzzzz', "AKIAxAKIA" + "A" * 16, "AKIA" * 7,
        "deadbeef" * 3, "é" * 5 + "deadbeef" * 5 + " password:" + "deadbeef" * 4, "x" * 90_000 + " token = '" + "0a" * 20 + "' " + "y" * 50_000,
        "ghp_" + "a1" * 18 + " xoxb-123456789012 -----BEGIN RSA PRIVATE KEY-----\nabc", "tok oke ken AKI KIA", "PASSWORD=SECRET=TOKEN=abcdef",
        "token: " + "a" * 6 + "token: " + "b" * 7, "passwd  =   \"hunter22\" passwd=hunte", "a\n" * 300 + "secret:zzzzzz" + "\n",
        "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "token=abcdef " * 400, "K" + "İ token=ſecret1 ſecret=abcdef",
    ]


def test_edge_cases(spark, texts):
    docs = [(None if i == 4 else i % 17, t, "x", 5, [1]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans string, wanted int, secret array<int>")
    got = sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in ss.secrets(frame).collect())
    assert got == sorted(plain(t) for t in texts)
    assert ss.secrets(frame.limit(0)).collect() == []


def test_redaction(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __other string")
    clean = ss.redacted(frame)
    assert clean.columns == frame.columns
    for row in clean.collect():
        text = texts[row.doc_id]
        spans = [tuple(map(int, s.split(":")[1:])) for s in plain(text)[4].split(",") if s]
        if not spans:
            assert row.text == text
            continue
        hidden = {i for a, b in spans for i in range(a, b)}
        runs = "".join("\0" if i in hidden else c for i, c in enumerate(text))
        assert row.text == re.sub("\0+", ss.REDACTED, runs)


def test_very_many_matches_in_one_text(spark):
    """Spans of a text with more matches than a chunk holds, and at a cost that does not grow with their square."""
    import time

    text = "".join(f"token={i:08d} x{'é' if i % 3 else '🎉'} " for i in range(20_000))
    frame = spark.createDataFrame([(1, text), (2, "token=" + "a" * 9)], "doc_id long, text string")
    begin = time.time()
    rows = {r.doc_id: r for r in ss.secrets(frame).collect()}
    assert time.time() - begin < 60
    spans = []
    for m in re.finditer(r"token=\d{8}", text):
        spans.append(f"assign:{m.start()}:{m.end()}")
    assert rows[1].n_assign == 20_000 and rows[2].n_assign == 1
    assert rows[1].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_redaction_of_many_spans_that_meet_and_overlap(spark):
    rng = random.Random(5)
    parts = ["token=", "0123456789abcdef" * 2, " ", "é", "AKIA" + "Q" * 20, "🎉 word ", "secret: ", "x" * 7, "f" * 24]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 5, 40, 700, 3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in ss.secrets(frame).collect()}
    for r in ss.redacted(frame).collect():
        merged = []
        for s in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[r.doc_id].split(",") if x):
            if merged and merged[-1][1] >= s[0]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        text, out, at = texts[r.doc_id], [], 0
        for start, end in merged:
            out += [text[at:start], ss.REDACTED]
            at = end
        assert r.text == "".join(out) + text[at:]
