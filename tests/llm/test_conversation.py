"""Repairs against a search over all edits, and against a plain parse that tries every split of every span."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from gradeframe.llm import conversation
from gradeframe.llm.queries import op12_conversation_repair

TARGET = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """Faults of (turn, role, text) rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        left = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows):
    """Least (cost, audit) by Dijkstra's search over (rows read, form so far), and the lines it gives."""
    fault = faulty(rows)
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, form, lines = heapq.heappop(heap)
        state = form[:1] == "s" and len(form) == 1, form[-1:]
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and TARGET.fullmatch(form):
            return cost, audit, lines
        ways = [(5, "I", at, r[0], f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            ways.append((2, "D", at + 1, "", None))
            if fault[at] not in ("blank", "duplicate"):
                extra = 5 if fault[at] == "truncated" else 0
                if role:
                    ways.append((extra, "K", at + 1, role[0], f"{role}:{text}"))
                ways += [(extra + 1, "R", at + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for more, letter, to, initial, line in ways:
            new = form + initial
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + letter, to, new, lines if line is None else (*lines, line)))
    raise AssertionError("no repair")


def expected(rows):
    """The contract's columns for the rows of a conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    cost, audit, lines = search(rows)
    turns = {r[0] for r in rows if r[0] is not None}
    fault = faulty(rows)
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{name: fault.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damage(rows):
    """(conv_id, turn, role, text) rows to conversations after damage."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        here += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def every_split(kinds):
    """Cells of all spans by the classic scheme, with every split of each."""
    cells = {(i, i + 1): conversation.leaf(k) for i, k in enumerate(kinds)}
    for length in range(2, len(kinds) + 1):
        for i in range(len(kinds) - length + 1):
            found = [conversation.combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            assert len(set(found)) == 1
            cells[i, i + length] = found[0]
    return cells[0, len(kinds)] if kinds else conversation.EMPTY


def test_every_split_gives_the_same_cells():
    rng = random.Random(2)
    for _ in range(60):
        kinds = "".join(rng.choice("dsuaoSUAO") for _ in range(rng.randint(0, 14)))
        assert conversation.span(kinds) == every_split(kinds), kinds


def test_cheapest_edits_equal_a_search():
    rng = random.Random(4)
    texts = ["yes.", "no!", "cut", "", " \t", "what?", "cut off \n"]
    for _ in range(1500):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(texts)) for i in range(rng.randint(0, 9))]
        fault = faulty(rows)
        kinds = "".join(
            "d" if f in ("blank", "duplicate") else (k := r[:1] if r[:1] in ("s", "u", "a") else "o", k.upper() if f else k)[1]
            for (_, r, _), f in zip(rows, fault, strict=True)
        )
        assert conversation.cheapest(conversation.span(kinds)) == search(rows)[:2], rows


def test_long_spans_are_parsed_in_pieces():
    rng = random.Random(6)
    kinds = "".join(rng.choice("uauauaoUAd") for _ in range(3000))
    whole = conversation.span(kinds)
    parts = conversation.parse([conversation.span(kinds[i : i + 37]) for i in range(0, 3000, 37)])
    assert whole == parts
    cost, audit = conversation.cheapest(whole)
    assert sum(c != "I" for c in audit) == 3000 and cost > 0


def rows_of(frame):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


def test_op12_whole_table(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = rows_of(op12_conversation_repair(spark, sf))
    assert found == {conv: expected(rows) for conv, rows in damage(given).items()}


ODD = [
    (None, 0, "user", "a."), (None, None, None, None), (7, None, "user", "x."), (7, None, "user", "x."), (7, 3, "user", "x."), (7, 9, "assistant", "y."),
    (8, 2, "", "z."), (8, 2, "Assistant", "q"), (8, 2, "assistant", "q"), (8, 2, "assistant", "q"), (9, None, "tool", "t!"), (10, 5, None, " "),
    *((20 + i, t, r, x) for i in range(40) for t, r, x in [(0, "system", "s."), (1, "user", "u"), (2, "assistant", "a?"), (2, "user", "b."), (5, "user", "u")]),
]


@pytest.mark.parametrize("piece", [1024, 1])
def test_nulls_ties_repeats_and_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation, "PIECE", piece)
    frame = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "1 AS kind", "'c' AS digest", "0 AS first", "'k' AS audit", "2 AS cost").repartition(5)
    rows = conversation.damaged(frame)
    reports = conversation.report(rows)
    found = rows_of(conversation.with_digest(rows, reports))
    assert found == {conv: expected(r) for conv, r in damage(ODD).items()}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "a."), (1, 3, "tool", "t."), (2, 0, "user", "cut")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in conversation.repaired(frame).orderBy("conv_id", "position").collect()]
    assert found == [(1, 0, "Keep", "system", "s."), (1, 1, "Rerole", "user", "a."), (1, 2, "Rerole", "assistant", "t.")]


def test_one_long_conversation_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversation, "PIECE", 50)
    rng = random.Random(8)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"c{i}.", f"d{i}"])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = rows_of(conversation.with_digest(frame, conversation.report(frame)))
    assert found == {1: expected([r[1:] for r in rows])}


def test_empty_and_text_ids(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.report(conversation.damaged(frame)).collect() == []
    assert conversation.repaired(frame).collect() == []
    named = spark.createDataFrame([("x", 1, "user", "a."), ("x", 2, "assistant", "b.")], "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, r.audit) for r in conversation.report(named).collect()] == [("x", "KK")]
