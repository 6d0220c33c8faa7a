"""Secrets in texts: an inverted index of trigrams chooses the candidates of each rule, its regex verifies them.

Everything runs as DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import id_and_text, numbered
from gradeframe.llm.trigram_query import Query, trigram_query
from gradeframe.session import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of ``pattern`` (leftmost, not overlapping) count if the group is long enough.

    ``any_case``: ASCII letters match in either case.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The base rules, then widely used public formats of keys.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
REDACTED = "[SECRET]"
_CHUNK = 128  # matches whose spans are appended one by one
_MASK_BITS = 60  # trigrams per integer of a text's set


def _whole_runs(rule: Rule) -> str:
    """The same spans in one step, where a rule is a run of one class with a least length.

    A run that is too short has no part that is long enough, so the length can go into the pattern.
    """
    if rule.pattern.endswith("]+") and rule.group == 0 and rule.least > 1:
        prefix = rule.pattern[: rule.pattern.rindex("[")]
        if not any(c in prefix for c in r"\.[](){}*+?|^$"):
            return f"{rule.pattern[:-1]}{{{rule.least - len(prefix)},}}"
    return rule.regex


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id) for each of the trigrams that a text holds, in any case.

    ``trigram`` is the place in the list, which is as long as the rules are, whatever the corpus.
    """
    lower = docs.select("doc_id", F.lower("text").alias("lower"))
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams)]))
    return lower.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """(doc_id, wanted): bit n of ``wanted`` says that the text may match the rule of the n-th query.

    The postings of a text are intersected and united as its rules' queries say; the sets of trigrams
    are combined before the shuffle. Only texts with a candidate are returned. Rows that share an id
    share their postings, which can only add candidates.
    """
    trigrams = sorted({t for q in queries if q is not None for s in q for t in s})
    number = {t: n for n, t in enumerate(trigrams)}
    n_masks = -(-len(trigrams) // _MASK_BITS)

    def bit(mask: int) -> Column:
        inside = (F.floor(F.col("trigram") / _MASK_BITS) == mask)
        return F.when(inside, F.expr(f"shiftleft(1L, trigram % {_MASK_BITS})")).otherwise(F.lit(0).cast("long"))

    sets = postings(docs, trigrams).groupBy("doc_id").agg(*[F.bit_or(bit(m)).alias(f"mask{m}") for m in range(n_masks)])

    def all_of(wanted: frozenset[str]) -> Column:
        masks = [0] * n_masks
        for t in wanted:
            masks[number[t] // _MASK_BITS] |= 1 << number[t] % _MASK_BITS
        out = F.lit(True)
        for m, need in enumerate(masks):
            if need:
                out = out & (F.col(f"mask{m}").bitwiseAND(F.lit(need)) == F.lit(need))
        return out

    wanted = F.lit(0)
    for n, query in enumerate(queries):
        if query is not None:
            any_of = F.lit(False)
            for alternative in sorted(query, key=sorted):
                any_of = any_of | all_of(alternative)
            wanted = wanted + F.when(any_of, F.lit(1 << n)).otherwise(F.lit(0))
    return sets.select("doc_id", wanted.cast("long").alias("wanted")).filter("wanted != 0")


def _long_enough(groups: Column, least: int) -> Column:
    return F.transform(groups, lambda g: F.length(g) >= least)


def _chunks(size: Column) -> Column:
    """Numbers of the chunks of so many elements."""
    return F.sequence(F.lit(0), F.floor((size - 1) / F.lit(_CHUNK)).cast("int"))


def _members(chunk: Column, size: Column) -> Column:
    """Numbers of the elements of a chunk."""
    return F.sequence(chunk * _CHUNK, F.least(size, (chunk + 1) * _CHUNK) - 1)


def _spans(rule: int) -> Column:
    """(start, rule, end) of the matches of one rule, from its matches and the pieces between them.

    Matches are taken in chunks: a chunk begins where the lengths of all chunks before it end, and only
    within a chunk are spans appended one by one. So a text with very many matches costs little more
    than its matches.
    """
    found, pieces, kept = f"__found{rule}", f"__pieces{rule}", f"__kept{rule}"
    size = F.size(found)
    empty = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    chunks = _chunks(size)

    def members(chunk: Column) -> Column:
        return _members(chunk, size)

    def length(chunk: Column) -> Column:
        return F.aggregate(members(chunk), F.lit(0).cast("long"), lambda sum_, n: sum_ + F.length(F.get(pieces, n)) + F.length(F.get(found, n)))

    begins = F.aggregate(
        F.transform(chunks, length), F.array(F.lit(0).cast("long")), lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n))
    )

    def add(state: Column, n: Column) -> Column:
        start = state["at"] + F.length(F.get(pieces, n))
        end = start + F.length(F.get(found, n))
        span = F.struct(start.alias("start"), F.lit(rule).alias("rule"), end.alias("end"))
        spans = F.when(F.get(kept, n), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def chunk_spans(at: Column, chunk: Column) -> Column:
        return F.aggregate(members(chunk), F.struct(at.alias("at"), empty.alias("spans")), add, lambda state: state["spans"])

    # the last entry of the begins is the end of the text's last match
    per_chunk = F.zip_with(F.slice(begins, F.lit(1), F.size(chunks)), chunks, chunk_spans)
    return F.when(size > 0, F.flatten(per_chunk)).otherwise(empty)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``secret_spans``: array of (start, rule, end) in code points, sorted.

    The regex of each rule gives a Boolean query over trigrams. The index over those trigrams gives the
    candidates; it is written to the shared folder, so that Spark knows its size when it joins it with
    the texts. Rules without a mandatory trigram look through all texts. A null text is an empty one;
    rows with null or repeated ids are searched each for itself. The end of a span is exclusive.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    rows = id_and_text(docs, id_col, text_col)
    wanted = materialise(candidates(rows.filter("text IS NOT NULL"), queries), "candidates").withColumnRenamed("doc_id", "__candidate")
    joined = docs.join(wanted, docs[id_col].eqNullSafe(wanted["__candidate"]), "left").drop("__candidate")
    joined = joined.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    nothing = F.array().cast("array<string>")
    found = joined.select(*docs.columns, "__text", *[
        F.when(F.lit(True) if queries[n] is None else F.col("wanted").bitwiseAND(F.lit(1 << n)) != 0, F.regexp_extract_all("__text", F.lit(_whole_runs(r)), F.lit(0)))
        .otherwise(nothing).alias(f"__found{n}") for n, r in enumerate(rules)
    ])
    some = [F.size(f"__found{n}") > 0 for n in range(len(rules))]
    parts = found.select(*docs.columns, *[f"__found{n}" for n in range(len(rules))], *[
        c for n, r in enumerate(rules) for c in (
            F.when(some[n], F.split("__text", _whole_runs(r), -1)).otherwise(nothing).alias(f"__pieces{n}"),
            F.when(some[n], _long_enough(F.regexp_extract_all("__text", F.lit(_whole_runs(r)), F.lit(r.group)), r.least))
            .otherwise(F.array().cast("array<boolean>")).alias(f"__kept{n}"),
        )
    ])
    return parts.select(*docs.columns, F.array_sort(F.concat(*[_spans(n) for n in range(len(rules))])).alias("secret_spans"))


def shown(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document, by the rules of this module."""
    found = with_spans(id_and_text(docs, id_col, text_col))
    spans = F.col("secret_spans")

    def count(n: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rule"] == n)).cast("long")

    base = F.filter(spans, lambda s: s["rule"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every secret in their texts replaced by ``REDACTED``; spans that touch become one.

    All columns come back under their names, whatever these are.
    """
    safe, (safe_id, safe_text) = numbered(docs, id_col, text_col)
    return _redacted(safe, safe_id, safe_text).toDF(*docs.columns)


def _redacted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans are united where a start lies behind all ends before it, and the text between them is cut out.

    Both go by chunks, as ends before and places in a text are else looked for from the beginning each time.
    """
    spans, long = F.col("secret_spans"), "array<bigint>"
    size = F.size(spans)
    mark = "array<struct<start:bigint,until:bigint>>"

    def furthest(chunk: Column) -> Column:
        return F.array_max(F.transform(_members(chunk, size), lambda n: F.get(spans, n)["end"]))

    until = F.aggregate(
        F.transform(_chunks(size), furthest), F.array(F.lit(-1).cast("long")),
        lambda all_, end: F.concat(all_, F.array(F.greatest(F.element_at(all_, -1), end))),
    )

    def add(state: Column, n: Column) -> Column:
        span = F.get(spans, n)
        marks = F.concat(state["marks"], F.array(F.struct(span["start"].alias("start"), state["at"].alias("until"))))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), marks.alias("marks"))

    def chunk_marks(at: Column, chunk: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast(mark).alias("marks"))
        return F.aggregate(_members(chunk, size), begin, add, lambda state: state["marks"])

    some = F.size("secret_spans") > 0
    found = with_spans(docs, id_col, text_col).withColumn("until", F.when(some, until))
    marks = F.flatten(F.zip_with(F.slice("until", F.lit(1), F.size("until") - 1), _chunks(size), chunk_marks))
    found = found.withColumn("opens", F.when(some, F.filter(marks, lambda m: m["start"] > m["until"])))
    ends = F.concat(F.slice(F.col("opens.until"), F.lit(2), F.size("opens")), F.array(F.element_at("until", -1)))
    found = found.withColumns({
        "froms": F.concat(F.array(F.lit(0).cast("long")), ends).cast(long),
        "tos": F.concat(F.col("opens.start"), F.array(F.length(text_col).cast("long"))).cast(long),
    })
    n_gaps = F.size("froms")

    def gaps(chunk: Column) -> Column:
        first, last = chunk * _CHUNK, F.least(n_gaps, (chunk + 1) * _CHUNK) - 1
        base = F.get("froms", first)
        part = F.substr(F.col(text_col), (base + 1).cast("int"), (F.get("tos", last) - base).cast("int"))

        def cut(part: Column) -> Column:
            return F.transform(_members(chunk, n_gaps), lambda n: F.substr(
                part, (F.get("froms", n) - base + 1).cast("int"), (F.get("tos", n) - F.get("froms", n)).cast("int")
            ))

        return F.flatten(F.transform(F.array(part), cut))  # the part is made once

    text = F.when(some, F.array_join(F.flatten(F.transform(_chunks(n_gaps), gaps)), REDACTED)).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(docs.columns)
