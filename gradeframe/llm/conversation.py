"""Repair of conversations: the cheapest edits that give ``(s?(ua)+)?``, by weighted parsing of spans.

The repair grammar in Chomsky normal form has a nonterminal N(p, q) for each two states of the target
form: "the edits of this span lead from p to q". Its rules are N(p, q) -> N(p, r) N(r, q), a row kept,
reroled or deleted as terminal, and insertions as closure of every span. A cell of a span holds the
least (cost, audit) of a nonterminal. Spans are combined bottom-up, from single rows to twice the
length each time. As insertions are closed on both sides and the rules are associative, every split of
a span gives the same cells, so one split is enough and a long conversation may be parsed in pieces,
each in another task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import record_batch
from gradeframe.session import materialise

# Fixed values of the contract: costs, blanks, closing letters.
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
CLOSING = (".", "!", "?")

PIECE = 1024  # rows of one span that a task parses at once
STATES = range(4)  # nothing yet, after s, after u, after a
ENDS = (0, 3)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
ROLE_OF = {2: "user", 3: "assistant"}

Cells = tuple[tuple[int, str] | None, ...]  # by 4 * p + q


def combine(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans as one: least cost, then the audit that is ASCII-least.

    Audits of one span and cost are never prefixes of one another, as what an audit costs is fixed by
    its letters, so the least audit of a whole is made of least audits of its parts.
    """
    out: list[tuple[int, str] | None] = []
    for p in STATES:
        for q in STATES:
            ways = [(x, y) for r in STATES if (x := left[4 * p + r]) and (y := right[4 * r + q])]
            cost = min((x[0] + y[0] for x, y in ways), default=None)
            out.append(None if cost is None else (cost, min(x[1] + y[1] for x, y in ways if x[0] + y[0] == cost)))
    return tuple(out)


def _cells(ways: Iterable[tuple[int, int, int, str]]) -> Cells:
    """Cells from (p, q, cost, audit)."""
    out: list[tuple[int, str] | None] = [None] * 16
    for p, q, cost, audit in ways:
        if out[4 * p + q] is None or (cost, audit) < out[4 * p + q]:
            out[4 * p + q] = (cost, audit)
    return tuple(out)


def _closure() -> Cells:
    """The empty span: any number of inserted turns."""
    one = [(p, q, INSERT, "I") for role in "ua" for p, q in STEPS[role].items()]
    cells = _cells([(p, p, 0, "") for p in STATES] + one)
    while (more := combine(cells, cells)) != cells:
        cells = more
    return cells


EMPTY = _closure()


@functools.cache
def leaf(kind: str) -> Cells:
    """One row with insertions around it. ``kind``: d for rows that must go; else the role's initial
    s, u, a or o for any other, in upper case if the text is cut off."""
    ways = [(p, p, DELETE, "D") for p in STATES]
    if kind != "d":
        extra = CUT if kind.isupper() else 0
        ways += [(p, q, extra, "K") for p, q in STEPS.get(kind.lower(), {}).items()]
        ways += [(p, q, REROLE + extra, "R") for role in "ua" for p, q in STEPS[role].items()]
    return combine(combine(EMPTY, _cells(ways)), EMPTY)


def parse(spans: list[Cells]) -> Cells:
    """The cells of neighbouring spans as one, combined by doubling their length."""
    while len(spans) > 1:
        odd = spans[-1:] if len(spans) % 2 else []
        spans = [combine(a, b) for a, b in zip(spans[::2], spans[1::2], strict=False)] + odd
    return spans[0] if spans else EMPTY


@functools.lru_cache(maxsize=50_000)
def _short(kinds: str) -> Cells:
    return parse([leaf(k) for k in kinds])


def span(kinds: str) -> Cells:
    """Cells of the rows of these kinds; those of short spans, which come again and again, are remembered."""
    return parse([_short(kinds[i : i + 16]) for i in range(0, len(kinds), 16)])


def cheapest(cells: Cells) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    return min(c for q in ENDS if (c := cells[q]))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table with faults planted by crc32 of ``conv_id:turn`` modulo 20.

    Columns conv_id, turn, role, text (nulls of the last two: one space) and ``copies``: 0 for a row
    that is dropped, 2 for a repeated one.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(conversations: DataFrame) -> DataFrame:
    """The columns that are read; nulls of role and text are one space, a table without copies has one of each row."""
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"),
        F.unhex(F.md5(text)).alias("digest"),
    )


def faults(conversations: DataFrame) -> DataFrame:
    """One row per different (conv_id, turn, role, text), without its text: copies, blank, cut, first.

    ``first``: no equal role and text comes earlier in the conversation. Equal rows are added up before
    and while they are shuffled, and only texts met more than once are joined, so neither a row nor a
    text that is repeated without end reaches one task.
    """
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = _rows(conversations).select(
        "conv_id", "turn", "role", "digest", "copies", (left == "").alias("blank"),
        ((left != "") & ~F.right(left, F.lit(1)).isin(*CLOSING)).alias("cut"),
    )
    light = materialise(light.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies")), "turns")
    repeated = light.where(~F.col("blank") & (F.col("copies") > 0)).groupBy(
        F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest")
    ).agg(
        F.count("*").alias("places"), F.bool_or(F.col("turn").isNull()).alias("in_null"), F.min("turn").alias("least_turn")
    ).where("places > 1")
    here = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    first = F.when(F.col("in_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least_turn"))
    joined = light.join(repeated, here, "left").withColumn("first", F.coalesce(first, F.lit(True)))
    return joined.select("conv_id", "turn", "role", "digest", "copies", "blank", "cut", "first")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


@dataclass
class Piece:
    """What is known of some neighbouring rows of a conversation."""

    cells: Cells
    counts: dict[str, int]
    first: str | None = None  # initials of the first and last row
    last: str | None = None
    low: int | None = None  # first and last turn that is no null
    high: int | None = None
    turns: int = 0

    def row(self) -> dict:
        costs = [None if c is None else c[0] for c in self.cells]
        ends = {name: getattr(self, name) for name in ("first", "last", "low", "high", "turns")}
        return {"costs": costs, "audits": [None if c is None else c[1] for c in self.cells], **self.counts, **ends}

    @classmethod
    def of(cls, row: dict) -> Piece:
        cells = tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True))
        ends = {name: row[name] for name in ("first", "last", "low", "high", "turns")}
        return cls(cells, {name: row[name] for name in _COUNTS}, **ends)


class Reader:
    """Rows of one conversation in order, up to ``PIECE`` of them."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.n = 0
        self.piece = Piece(EMPTY, dict.fromkeys(_COUNTS, 0))

    def add(self, turn: int | None, role: str, copies: int, blank: bool, cut: bool, first: bool) -> None:
        """Take some equal rows; all but the first of a text are duplicates."""
        if not copies:
            return
        piece, initial = self.piece, role[:1]
        kept = 1 if first and not blank else 0
        kind = initial if initial in STEPS else "o"
        self.kinds.append((kind.upper() if cut else kind) * kept + "d" * (copies - kept))
        self.n += copies
        piece.counts["blank"] += copies if blank else 0
        piece.counts["duplicate"] += 0 if blank else copies - kept
        piece.counts["truncated"] += kept if cut else 0
        piece.counts["illegal"] += _illegal(piece.last, initial) + (copies - 1) * _illegal(initial, initial)
        piece.first, piece.last = initial if piece.first is None else piece.first, initial
        if turn is not None and turn != piece.high:
            piece.low, piece.high, piece.turns = turn if piece.low is None else piece.low, turn, piece.turns + 1

    def close(self) -> dict:
        self.piece.cells = span("".join(self.kinds))
        return self.piece.row()


def _illegal(before: str | None, after: str | None) -> int:
    return int(before is not None and after is not None and before + after not in LEGAL)


def joined(pieces: list[Piece]) -> Piece:
    """Neighbouring pieces as one."""
    out = Piece(parse([p.cells for p in pieces]), dict.fromkeys(_COUNTS, 0))
    for p in pieces:
        for name in _COUNTS:
            out.counts[name] += p.counts[name]
        out.counts["illegal"] += _illegal(out.last, p.first)
        out.first, out.last = out.first if out.first is not None else p.first, p.last if p.last is not None else out.last
        out.turns += p.turns - int(p.low is not None and p.low == out.high)
        out.low, out.high = out.low if out.low is not None else p.low, p.high if p.high is not None else out.high
    return out


_PIECE_FIELDS = [
    ("part", pa.int64()), ("seq", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    *((name, pa.int64()) for name in _COUNTS), ("first", pa.string()), ("last", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
]
_REPORT_FIELDS = [("gaps", pa.int64()), *((name, pa.int64()) for name in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())]
_PIECES = (
    "part long, seq long, costs array<long>, audits array<string>, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", first string, last string, low long, high long, turns long"
)
_REPORT = "gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _out(rows: list[dict], id_type: pa.DataType, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", id_type), *fields])
    return record_batch(schema, **{f.name: [r[f.name] for r in rows] for f in schema})


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, reader, now, id_type = TaskContext.get().partitionId(), 0, None, None, None
    for batch in batches:
        id_type, rows = batch.schema.field("conv_id").type, []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "copies", "blank", "cut", "first"))
        for conv, *row in zip(*columns, strict=True):
            if reader is not None and (conv != now or reader.n >= PIECE):
                rows.append({"conv_id": now, "part": part, "seq": seq, **reader.close()})
                reader, seq = None, seq + 1
            reader, now = reader or Reader(), conv
            reader.add(*row)
        if rows:
            yield _out(rows, id_type, _PIECE_FIELDS)
    if reader is not None:
        yield _out([{"conv_id": now, "part": part, "seq": seq, **reader.close()}], id_type, _PIECE_FIELDS)


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[Piece] = []
    now, id_type = None, None

    def close() -> dict:
        whole = joined(held)
        cost, audit = cheapest(whole.cells)
        gaps = 0 if whole.low is None else whole.high - whole.low + 1 - whole.turns
        return {"conv_id": now, "gaps": gaps, **whole.counts, "cost": cost, "audit": audit}

    for batch in batches:
        id_type, rows = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if held and row["conv_id"] != now:
                rows.append(close())
                held = []
            now = row["conv_id"]
            held.append(Piece.of(row))
        if rows:
            yield _out(rows, id_type, _REPORT_FIELDS)
    if held:
        yield _out([close()], id_type, _REPORT_FIELDS)


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation.

    A conversation's rows are taken by turn, nulls first; those of one turn by role and then by the md5
    of the text. Rows are dealt by ranges of that order, so a long conversation spreads over tasks, each
    parses its pieces, and pieces of a conversation are combined at the end. A null conv_id is a
    conversation, an empty role has no initial and cannot be kept; a conversation all of whose rows have
    no copies has zeros and an empty audit. Other columns are not read; an empty table gives an empty one.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = faults(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = _id_type(conversations)
    pieces = rows.mapInArrow(_pieces, f"conv_id {id_type}, {_PIECES}")
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return pieces.mapInArrow(_reports, f"conv_id {id_type}, {_REPORT}")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
    """("begin", report), ("turn", edit, role and text) for each row or insertion, ("end", report) of each conversation."""
    now, audit, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple[str, dict]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = 3 if state == 2 else 2
            at += 1
            yield "turn", {"edit": "Insert", "role": ROLE_OF[state], "text": ""}

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if now is not None:
                    yield from inserted()
                    yield "end", now
                now, audit, at, state = row, row["audit"], 0, 0
                yield "begin", now
                continue
            for _ in range(row["copies"]):
                yield from inserted()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "K":
                    state, role = STEPS[row["role"][0]][state], row["role"]
                else:
                    state = 3 if state == 2 else 2
                    role = ROLE_OF[state]
                yield "turn", {"edit": "Keep" if letter == "K" else "Rerole", "role": role, "text": row["text"]}
    if now is not None:
        yield from inserted()
        yield "end", now


def _with_reports(conversations: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its rows in order; a conversation is walked in one task, row by row."""
    heads = reports.select("conv_id", F.lit(0).alias("kind"), *(f.name for f in reports.schema if f.name != "conv_id"))
    rows = _rows(conversations).where("copies > 0").withColumn("kind", F.lit(1))
    both = heads.unionByName(rows, allowMissingColumns=True)
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).drop("digest")


def repaired(conversations: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position from 0, edit (Keep, Rerole, Insert), role, text."""
    fields = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    reports = report(conversations) if reports is None else reports

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        conv, position, id_type = None, 0, None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield batch

        for what, row in _walk(typed()):
            if what == "begin":
                conv, position = row["conv_id"], 0
            elif what == "turn":
                held.append({"conv_id": conv, "position": position, **row})
                position += 1
                if len(held) == PIECE:
                    yield _out(held, id_type, fields)
                    held = []
        if held:
            yield _out(held, id_type, fields)

    schema = f"conv_id {_id_type(conversations)}, position long, edit string, role string, text string"
    return _with_reports(conversations, reports).mapInArrow(run, schema)


def with_digest(conversations: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256`` of ``role:text`` lines, taken up line by line without holding the text."""
    fields = [*_REPORT_FIELDS, ("repaired_sha256", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        digest, between, id_type = None, b"", None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield batch

        for what, row in _walk(typed()):
            if what == "begin":
                digest, between = hashlib.sha256(), b""
            elif what == "turn":
                digest.update(between + f"{row['role']}:{row['text']}".encode())
                between = b"\n"
            else:
                held.append({**row, "repaired_sha256": digest.hexdigest()})
                if len(held) == PIECE:
                    yield _out(held, id_type, fields)
                    held = []
        if held:
            yield _out(held, id_type, fields)

    schema = f"conv_id {_id_type(conversations)}, {_REPORT}, repaired_sha256 string"
    return _with_reports(conversations, reports).mapInArrow(run, schema)
