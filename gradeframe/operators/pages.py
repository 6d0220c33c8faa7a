"""Exam pages: tables of text lines turned into questions, one row per document.

Everything is expressed with array functions over the lines of a row, so documents are parsed
independently on the executors. Positions are 1-based as in Spark's arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.extract import answer_from_solution, figure_refs, image_list, strip_images
from gradeframe.functions.text import blank_to_null, ellipsize, ellipsize_words, matched, remove, strip

def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    Projections of array expressions are merged by the optimizer, which copies an expression to
    every place that uses it. A one-row generator keeps the step apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


# --- array helpers ------------------------------------------------------------------------


def positions(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Positions of the lines that pass a test."""
    numbered = F.transform(lines, lambda x, i: F.when(test(x), i + 1))
    return F.filter(numbered, lambda p: p.isNotNull())


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _line_is(lines: Column, pattern: str) -> Callable[[Column], Column]:
    """Test on a position: its line matches."""
    return lambda p: at(lines, p).rlike(pattern)


def _behind(position: Column) -> Callable[[Column], Column]:
    return lambda p: p > position


def lines_between(lines: Column, start: Column, stop: Column) -> Column:
    """Lines from ``start`` up to but without ``stop``."""
    return F.slice(lines, start, F.greatest(stop - start, F.lit(0)))


def at(lines: Column, position: Column) -> Column:
    return F.get(lines, position - 1)


def page_lines(text: Column) -> Column:
    """Stripped non-blank lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


# --- boilerplate --------------------------------------------------------------------------


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _contains_any(text: Column, fragments: Sequence[str]) -> Column:
    return _any([F.contains(text, F.lit(x)) for x in fragments])


def without_markers(line: Column) -> Column:
    return strip(F.when(F.contains(line, F.lit(K.IMAGE_OPENING)), remove(line, K.IMAGE_MARKER)).otherwise(line))


def is_boilerplate(raw: Column) -> Column:
    """Test on a line without image markers."""
    return _contains_any(raw, K.BOILERPLATE_FRAGMENTS) | (
        (F.lower(F.substring(raw, 1, 13)) == "next question") & raw.rlike(K.NEXT_QUESTION)
    )


def keep_where(lines: Column, raw: Column, test: Callable[[Column], Column]) -> Column:
    """Lines whose counterpart in ``raw`` passes a test."""
    kept = F.filter(F.arrays_zip(lines.alias("line"), raw.alias("raw")), lambda p: test(p["raw"]))
    return F.transform(kept, lambda p: p["line"])


def drop_boilerplate(lines: Column) -> Column:
    return keep_where(lines, F.transform(lines, without_markers), lambda r: ~is_boilerplate(r))


def trim_page(lines: Column) -> Column:
    """Lines behind the leading header lines and before the first footer line."""
    heads = F.transform(lines, lambda x: _any([F.startswith(x, F.lit(m)) for m in K.HEADER_MARKERS]))
    begin = F.array_position(heads, False).cast("int")
    body = F.when(begin > 0, F.slice(lines, begin, F.size(lines))).otherwise(F.slice(lines, 1, 0))
    feet = F.transform(body, lambda x: _contains_any(x, K.FOOTER_MARKERS))
    end = F.array_position(feet, True).cast("int")
    return F.when(end > 0, F.slice(body, F.lit(1), end - 1)).otherwise(body)


def before_solution(text: Column) -> Column:
    return F.substring_index(text, "\nSolution:", 1)


# --- first layout: lettered lines ---------------------------------------------------------


def choice_lines(lines: Column) -> Column:
    """Per line a struct (letter, text), both null when the line opens no choice.

    A letter alone takes the next line unless that opens a choice itself; then the choice is an
    image. A consumed line never opens a choice, so each line is judged with its successor only.
    """
    clean = F.transform(lines, strip)
    following = F.concat(F.slice(clean, 2, F.size(clean)), F.array(F.lit(None).cast("string")))
    pairs = F.arrays_zip(clean.alias("line"), following.alias("next"))

    def judge(p):
        line, after = p["line"], p["next"]
        dotted = F.substring(line, 2, 1) == "."
        bare, inline = dotted & line.rlike(K.BARE_CHOICE), dotted & line.rlike(K.INLINE_CHOICE)
        taken = F.when(after.isNotNull() & ~F.substring(after, 1, 2).rlike(K.ANY_CHOICE), after).otherwise(F.lit(K.IMAGE_CHOICE))
        return F.struct(
            F.when(bare | inline, F.substring(line, 1, 1)).alias("letter"),
            F.when(bare, taken).when(inline, strip(F.regexp_extract(line, K.INLINE_CHOICE, 2))).alias("text"),
        )

    return F.transform(F.when(F.size(lines) > 0, pairs), judge)


def _opens(letter: str) -> Callable[[Column], Column]:
    return lambda c: c["letter"] == letter


def parse_choices(opened: Column) -> Column:
    """Map from letter to text from the output of ``choice_lines``; the last duplicate wins."""
    texts = [last(F.filter(opened, _opens(x)))["text"] for x in K.LABELS]
    return _letter_map(F.array(*texts))


def _asks(line: Column) -> Column:
    return F.substring(strip(line), -1, 1).isin("?", ":")


def passage_before(pre: Column, asks: Column) -> Column:
    """Everything before the question line; all lines when there is none."""
    return F.when(
        asks.isNotNull(), strip(F.array_join(F.slice(pre, F.lit(1), asks - 1), "\n"))
    ).otherwise(F.array_join(pre, "\n"))


def split_passage(before: Column) -> Column:
    """Struct (passage, question): the last line ending in ? or : and everything before it."""
    pre = F.split(strip(F.array_join(before, "\n")), "\n")
    asks = last(positions(pre, _asks))
    return F.struct(
        passage_before(pre, asks).alias("passage"), F.coalesce(strip(at(pre, asks)), F.lit("")).alias("question")
    )


def parse_pages(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Passage, question, choices and answer of pages in the first layout."""
    rest = [c for c in df.columns if c != lines]
    step = staged(df, __text=F.array_join(trim_page(F.col(lines)), "\n"))
    step = staged(step, __lines=F.split(before_solution(F.col("__text")), "\n"))
    step = staged(step, __opened=choice_lines(F.col("__lines")))
    step = staged(step, __start=first(positions(F.col("__opened"), lambda c: c["letter"].isNotNull())))
    before = F.when(
        F.col("__start").isNotNull(), F.slice(F.col("__lines"), F.lit(1), F.col("__start") - 1)
    ).otherwise(F.col("__lines"))
    step = staged(step, __pre=F.split(strip(F.array_join(before, "\n")), "\n"))
    step = staged(step, __asks=last(positions(F.col("__pre"), _asks)))
    return step.select(
        *rest,
        passage_before(F.col("__pre"), F.col("__asks")).alias("passage"),
        F.coalesce(strip(at(F.col("__pre"), F.col("__asks"))), F.lit("")).alias("question"),
        parse_choices(F.col("__opened")).alias("choices"),
        F.upper(matched(F.col("__text"), K.PAGE_ANSWER_IS)).alias("answer"),
    )


# --- second layout: marker lines ----------------------------------------------------------

def _is_solution(x: Column) -> Column:
    return _any([F.startswith(x, F.lit(t)) for t in K.SOLUTION_STARTS])


def find_markers(raw: Column) -> Column:
    """Struct of marker positions over lines without image markers; null where absent."""
    solutions = positions(raw, _is_solution)
    verdicts = positions(raw, lambda x: x.isin(*K.VERDICT_LINES))
    return F.struct(
        *[last(positions(raw, lambda x, t=text: x == t)).alias(name) for name, text in K.PAGE_MARKERS.items()],
        last(solutions).alias("solution"),
        first(F.filter(verdicts, lambda p: p > first(solutions))).alias("verdict"),
    )


def _letter_line(x: Column) -> Column:
    return x.isin(*K.LABELS)


def extract_fields(df: DataFrame, lines: str = "lines", folder: str = "folder") -> DataFrame:
    """Fields of pages in the second layout, located by their marker lines.

    ``skipped`` names why a page cannot be parsed: no markers or no choices.
    """
    rest = [c for c in df.columns if c != lines]
    L, R = F.col("__l"), F.col("__r")
    step = staged(df, __l=F.filter(F.transform(
        F.col(lines), lambda x: strip(F.replace(x, F.lit("\xa0"), F.lit(" ")))), lambda x: x != ""))
    step = staged(step, __r=F.transform(L, strip_images))
    names = [*K.PAGE_MARKERS, "solution", "verdict"]
    step = staged(step, __m=find_markers(R))
    step = staged(step, **{f"__m_{f}": F.col(f"__m.{f}") for f in names})
    m = {f: F.col(f"__m_{f}") for f in names}
    size = F.size(L)
    step = staged(step, __head=F.slice(R, F.lit(1), F.least(m["question"], m["separator"]) - 1))
    numbered = F.transform(F.col("__head"), lambda x, i: F.struct(x.alias("t"), (i + 1).alias("p")))
    titles = F.filter(numbered, lambda c: ~(
        is_boilerplate(c["t"]) | c["t"].isin(*K.NAVIGATION_WORDS) | F.startswith(c["t"], F.lit(K.TIME_SPENT))
        | c["t"].rlike(K.QUESTION_NUMBER)
    ))
    step = staged(
        step, __titles=titles, __letters=positions(R, _letter_line),
        __opens=first(positions(F.col("__head"), lambda x: F.startswith(x, F.lit("Passage")) & x.rlike(K.PASSAGE_HEAD))),
    )
    title = F.when(F.get("__titles", F.lit(0))["p"] <= 4, F.get("__titles", F.lit(0))["t"])
    section = F.when(title.isNotNull() & (F.get("__titles", F.lit(1))["p"] <= 7), F.get("__titles", F.lit(1))["t"])
    diagnostic = first(F.filter(
        F.col("__head"), lambda x: F.contains(x, F.lit("Diagnostic")) & F.contains(x, F.lit("Step"))
    ))
    is_diagnostic = F.startswith(F.col(folder), F.lit("CARS_d"))

    opens = F.col("__opens")
    passage_end = F.when(m["separator"] > opens + 1, m["separator"]).otherwise(m["question"])
    passage = keep_where(
        lines_between(L, opens + 1, passage_end), lines_between(R, opens + 1, passage_end),
        lambda r: ~(
            (r == "_") | is_boilerplate(r) | F.startswith(r, F.lit(K.MATERIAL_USED))
            | (F.startswith(r, F.lit(K.ADAPTED_FROM)) & r.rlike("^" + K.ADAPTED_FROM + K.NO_WORD_AFTER))
        ),
    )

    step = staged(step, __stem_end=first(F.filter("__letters", _behind(m["question"]))))
    stem = F.filter(
        lines_between(L, m["question"] + 1, F.col("__stem_end")), lambda t: strip_images(t) != "_"
    )
    step = staged(step, __blocks=F.filter(
        "__letters", lambda p: (p >= F.col("__stem_end")) & (p < m["solution"])
    ))
    step = _with_block_choices(step, L, R, m["solution"])

    stop = F.coalesce(m["verdict"], m["your_answer"], size + 1)
    spoken = F.transform(lines_between(R, m["solution"], stop), lambda x: F.when(
        _is_solution(x),
        blank_to_null(reduce(remove, K.SOLUTION_PREFIXES, x)),
    ).when(~x.isin(K.PAGE_MARKERS["item_rationale"], K.PAGE_MARKERS["option_rationale"]), x))
    parts = F.filter(spoken, lambda x: x.isNotNull())

    def letter_after(marker):
        value = at(R, marker + 1)
        return F.when(value.rlike("^[A-D]$"), value)

    confidence = at(R, m["confidence"] + 1)
    step = staged(step, __tail=F.when(m["skills"].isNotNull(), F.slice(R, m["skills"] + 1, F.greatest(size - m["skills"], F.lit(0)))))
    tail = F.col("__tail")
    stops = positions(tail, lambda x: is_boilerplate(x) | _any([x.rlike(p) for p in K.SKILLS_END]))
    tags = F.transform(
        F.slice(tail, F.lit(1), F.coalesce(first(stops) - 1, F.size(tail))), lambda x: strip(remove(x, K.SKILL_PREFIX))
    )
    skills = F.filter(tags, lambda x: x != "")

    empty = F.array().cast("array<string>")
    fields = {
        "raw_lines": R,
        "markers": F.col("__m"),
        "source_title": title,
        "section": F.when(is_diagnostic, F.coalesce(section, diagnostic)).otherwise(section),
        "question_id": F.substring_index(last(F.filter("__head", lambda x: x.rlike(K.QUESTION_NUMBER))), "/", 1),
        "passage_parts": F.coalesce(passage, empty),
        "question": F.array_join(stem, " "),
        "solution_parts": F.coalesce(parts, empty),
        "correct_answer": F.coalesce(answer_from_solution(at(R, m["solution"])), letter_after(m["correct_answer"])),
        "user_answer": letter_after(m["your_answer"]),
        "confidence": F.when(
            ~F.startswith(confidence, F.lit("Content")) & (confidence != K.NOT_SELECTED), confidence
        ),
        "content_skills": F.coalesce(skills, empty),
        "images": F.flatten(F.transform(F.filter(L, lambda x: F.contains(x, F.lit(K.IMAGE_OPENING))), image_list)),
        "skipped": F.when(m["question"].isNull() | m["solution"].isNull(), F.lit("missing marker"))
        .when(F.col("__stem_end").isNull(), F.lit("no answer choices"))
        .when(F.size("choices") == 0, F.lit("no choices extracted")),
    }
    out = staged(step, **fields).select(*rest, "choices", *fields)
    return staged(out, subject_code=subject_code(F.col("content_skills"), F.col(folder)))


def _with_block_choices(df: DataFrame, lines: Column, raw: Column, end: Column) -> DataFrame:
    """Choices opened by a letter alone: the letter's own image and the lines up to the next."""
    blocks = F.col("__blocks")
    step = staged(df, **{f"__at_{x}": last(F.filter(blocks, _line_is(raw, f"^{x}$"))) for x in K.LABELS})
    texts = {}
    for x in K.LABELS:
        opened = F.col(f"__at_{x}")
        closed = F.coalesce(first(F.filter(blocks, _behind(opened))), end)
        own = strip(F.substr(at(lines, opened), F.lit(2)))
        body = F.filter(lines_between(lines, opened + 1, closed), lambda t: strip_images(t) != K.ELIMINATED_LINE)
        texts[f"__text_{x}"] = strip(F.concat_ws(" ", F.nullif(own, F.lit("")), F.array_join(body, " ")))
    step = staged(step, **texts)
    found = F.array(*[
        F.when(F.col(f"__at_{x}").isNotNull(), F.coalesce(F.nullif(f"__text_{x}", F.lit("")), F.lit(K.IMAGE_CHOICE)))
        for x in K.LABELS
    ])
    return staged(step, choices=_letter_map(found))


def _letter_map(values: Column) -> Column:
    """Map from letter to text for the letters that have one."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in K.LABELS]), values), lambda k, v: v.isNotNull())


def subject_code(skills: Column, folder: Column) -> Column:
    """The last skill tag that is a subject code, else a rule on the folder."""
    codes = F.filter(F.transform(skills, F.upper), lambda x: x.isin(*K.SUBJECT_CODES))
    return F.coalesce(
        last(codes),
        F.when(F.startswith(folder, F.lit("CARS")), "CARS").when(folder == "Physics", "PHY").when(folder == "CP", "GCH"),
    )


# --- reasoning per choice -----------------------------------------------------------------


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda s: s.rlike(pattern)


def without_verdict(c: Column) -> Column:
    return remove(c, K.VERDICT)


def _with_rationales(df: DataFrame) -> DataFrame:
    """Add the cleaned text of the explicit option block per letter, null when there is none."""
    R = F.col("raw_lines")
    step = staged(
        df, __stop=F.coalesce(F.col("markers.verdict"), F.size(R) + 1),
        __begin=F.col("markers.option_rationale") + 1,
    )
    step = staged(step, __heads=F.filter(
        positions(R, lambda x: F.startswith(x, F.lit("Option")) & x.rlike(K.OPTION_HEAD)),
        lambda p: (p >= F.col("__begin")) & (p < F.col("__stop")),
    ))
    heads = F.col("__heads")
    step = staged(step, **{f"__on_{x}": last(F.filter(heads, _line_is(R, rf"(?U)^Option\s+{x}:"))) for x in K.LABELS})
    texts = {}
    for x in K.LABELS:
        opened = F.col(f"__on_{x}")
        closed = F.coalesce(first(F.filter(heads, _behind(opened))), F.col("__stop"))
        own = F.nullif(F.regexp_extract(at(R, opened), K.OPTION_TEXT, 1), F.lit(""))
        body = F.nullif(F.array_join(lines_between(R, opened + 1, closed), " "), F.lit(""))
        texts[f"__raw_{x}"] = without_verdict(strip(F.concat_ws(" ", own, body)))
        texts[f"__choice_{x}"] = strip(
            remove(F.coalesce(F.try_element_at(F.col("choices"), F.lit(x)), F.lit("")), K.IMAGE_MARKER)
        )
    step = staged(step, **texts)
    # the block often repeats the choice in front of the reason
    step = staged(step, **{
        f"__rest_{x}": F.when(
            (F.col(f"__choice_{x}") != "") & F.startswith(f"__raw_{x}", F.col(f"__choice_{x}")),
            remove(strip(F.substr(F.col(f"__raw_{x}"), F.length(f"__choice_{x}") + 1)), r"(?U)^\.\s*"),
        ).otherwise(F.col(f"__raw_{x}"))
        for x in K.LABELS
    })
    verdict = {x: F.when(F.col("correct_answer") == x, "Correct.").otherwise("Incorrect.") for x in K.LABELS}
    return staged(step, **{
        f"__opt_{x}": F.when(
            F.col(f"__on_{x}").isNotNull(),
            F.concat_ws(" ", verdict[x], F.nullif(strip(without_verdict(F.col(f"__rest_{x}"))), F.lit(""))),
        )
        for x in K.LABELS
    })


def _names(letters: str) -> str:
    """Pattern of a sentence that names a choice: a letter, or a class of letters for any of them."""
    return rf"(?iU)\({letters}\)|(?:choice|option|answer)\s+{letters}" + K.NO_WORD_AFTER


def _named(sentence: Column) -> Column:
    """The sentence with a bit per choice that it names; the letters are told apart only if it names any."""
    bits = reduce(add, [F.when(sentence.rlike(_names(x)), 1 << i).otherwise(0) for i, x in enumerate(K.LABELS)])
    any_of = "[" + "".join(K.LABELS) + "]"
    return F.struct(sentence.alias("text"), F.when(sentence.rlike(_names(any_of)), bits).otherwise(0).alias("letters"))


def eliminate(df: DataFrame, folder: str = "folder") -> DataFrame:
    """Reason per choice, as a map.

    Option blocks come first. Otherwise paragraphs are dealt to the choices when their numbers
    match (or exceed by one), else sentences that name a wrong choice go to it and the others to
    the right one. A choice left without text gets a default.
    """
    parts, n = F.col("solution_parts"), F.size("choices")
    step = _with_rationales(df)
    step = staged(
        step,
        __explicit=F.startswith(F.col(folder), F.lit("CARS_d")) & F.col("__begin").isNotNull()
        & F.coalesce(*[F.col(f"__opt_{x}") for x in K.LABELS]).isNotNull(),
        __offset=F.when(F.size(parts) == n, 0).when(F.size(parts) == n + 1, 1),
        __letters=F.array_sort(F.map_keys("choices")),
    )
    step = staged(
        step,
        # sentences count only where neither blocks nor paragraphs do
        __sentences=F.when(
            ~F.col("__explicit") & F.col("__offset").isNull() & F.col("__letters").isNotNull(), F.transform(F.split(F.array_join(parts, " "), K.SENTENCE_END), _named)
        ),
        **{
            f"__is_wrong_{x}": F.array_contains("__letters", x) & ~F.coalesce(F.col("correct_answer") == x, F.lit(False))
            for x in K.LABELS
        },
    )
    wrong = reduce(add, [F.when(F.col(f"__is_wrong_{x}"), 1 << i).otherwise(0) for i, x in enumerate(K.LABELS)])
    kept = F.filter(
        F.transform(F.filter("__sentences", lambda s: s["letters"].bitwiseAND(F.col("__wrong")) == 0), lambda s: strip(s["text"])),
        lambda s: (s != "") & ~_any([s.rlike(p) for p in K.STOCK_SENTENCES]),
    )

    def naming(bit: int) -> Column:
        found = F.filter("__sentences", lambda s: s["letters"].bitwiseAND(F.lit(bit)) != 0)
        return F.array_join(F.transform(found, lambda s: s["text"]), " ")

    step = staged(step, __wrong=wrong)
    step = staged(
        step, __kept=F.array_join(kept, " "),
        **{f"__wrong_{x}": F.when(F.col(f"__is_wrong_{x}"), naming(1 << i)) for i, x in enumerate(K.LABELS)},
    )
    values = {}
    for x in K.LABELS:
        index = F.array_position("__letters", x).cast("int")
        dealt = F.when(index > 0, without_verdict(strip(F.get(parts, index - 1 + F.col("__offset")))))
        named = F.when(F.col(f"__wrong_{x}") != "", ellipsize(without_verdict(F.col(f"__wrong_{x}")), 400))
        right = F.when(
            (F.col("correct_answer") == x) & (F.col("__kept") != ""),
            F.concat(F.lit("Correct. "), ellipsize(F.col("__kept"), 500)),
        )
        values[f"__value_{x}"] = (
            F.when(F.col("__explicit"), F.col(f"__opt_{x}"))
            .when(F.col("__offset").isNotNull(), dealt)
            .otherwise(F.coalesce(right, named))
        )
    step = staged(step, **values)
    final = []
    for x in K.LABELS:
        present, text = F.array_contains("__letters", x), F.col(f"__value_{x}")
        default = F.when(F.col("correct_answer") == x, K.DEFAULT_RIGHT).otherwise(
            K.DEFAULT_WRONG
        )
        final.append(F.when(present, F.coalesce(F.nullif(text, F.lit("")), default)).otherwise(text))
    return staged(step, elimination=_letter_map(F.array(*final))).select(*df.columns, "elimination")


def concept(df: DataFrame) -> DataFrame:
    """Subject name and the sentence that says what the question is about."""
    code_name = F.lit(K.DEFAULT_CODE_NAME)
    for code, name in K.SUBJECT_CODE_NAMES.items():
        code_name = F.when(F.col("subject_code") == code, name).otherwise(code_name)
    full = F.array_join("solution_parts", " ")
    step = staged(
        df, __name=code_name, __sentence=F.coalesce(*[matched(full, p) for p in K.CONCEPT_SENTENCES]),
        __stem=strip(remove(F.col("question"), K.IMAGE_MARKER)),
    )
    cleaned = remove(F.col("__sentence"), K.CONCEPT_PREFIX)
    cleaned = blank_to_null(F.regexp_replace(cleaned, K.QUOTED_CONCEPT, "$1. "))
    stem = F.when(F.col("question") != "", ellipsize_words(F.col("__stem"), 120))
    return staged(step, concept=F.coalesce(
        F.concat("__name", F.lit(" \u2014 "), cleaned),
        F.concat("__name", F.lit(" \u2014 reasoning about: "), stem),
        F.concat("__name", F.lit(" concept application.")),
    )).select(*df.columns, "concept")


def why(df: DataFrame, folder: str = "folder") -> DataFrame:
    """The explanation behind the answer, freed of stock phrases."""
    parts = F.col("solution_parts")
    reason = without_verdict(F.try_element_at(F.col("elimination"), F.col("correct_answer")))
    step = staged(
        df,
        __everything=strip(F.array_join(parts, " ")),
        __starts=positions(parts, lambda x: x.rlike(K.RATIONALE_START)),
        __options=positions(parts, lambda x: x.rlike(K.OPTION_HEAD)),
        __reason=F.nullif(reason, F.lit("")),
    )

    def latest(where, i):
        return F.coalesce(F.array_max(F.filter(where, lambda p: p <= i + 1)), F.lit(0))

    # a part belongs to the rationale when its last start is behind the last option block
    rationale = F.filter(
        F.transform(parts, lambda x, i: F.when(latest("__starts", i) > latest("__options", i), x)),
        lambda x: x.isNotNull(),
    )
    step = staged(step, __rationale=F.when(F.size("__starts") > 0, F.array_join(rationale, " ")))
    diagnostic = blank_to_null(F.concat_ws(" ", "__rationale", "__reason"))
    full = F.when(
        F.startswith(F.col(folder), F.lit("CARS_d")), F.coalesce(diagnostic, F.col("__everything"))
    ).otherwise(F.col("__everything"))
    full = reduce(remove, K.WHY_STOCK, full)
    step = staged(step, __full=F.nullif(strip(remove(strip(full), K.WHY_CONCLUSION)), F.lit("")))
    text = F.coalesce("__full", "__reason", F.lit(K.DEFAULT_WHY))
    return staged(step, why=ellipsize(text, 1500)).select(*df.columns, "why")


def image_note() -> Column:
    """What is known about figures: references in the text and embedded images."""
    text = F.concat_ws(
        " ", F.col("question"), F.array_join(F.map_values("choices"), " "), F.array_join("solution_parts", " "),
        F.array_join("passage_parts", " "),
    )
    refs = figure_refs(text)
    n = F.size("images")
    names = F.array_join(refs, ", ")
    return (
        F.when((n > 0) & (F.size(refs) > 0), F.concat(F.lit("Contains "), names, F.lit("; "), n, F.lit(" image(s) extracted")))
        .when(n > 0, F.concat(n, F.lit(" embedded image(s) extracted")))
        .when(F.size(refs) > 0, F.concat(F.lit("References "), names, F.lit(" but no embedded images found")))
    )


def parse_records(df: DataFrame, lines: str = "lines", folder: str = "folder") -> DataFrame:
    """Second-layout pages as chat records; pages that cannot be parsed keep their reason."""
    from gradeframe.operators.chat import parsed_messages, validate_records

    fields = extract_fields(df, lines, folder)
    full = staged(why(concept(eliminate(fields, folder)), folder), image_note=image_note())
    return validate_records(parsed_messages(full)).drop("raw_lines", "markers")


def parse_report(records: DataFrame) -> DataFrame:
    """Pages in total, written, skipped, written with violations, images of written pages."""
    written = F.col("skipped").isNull()
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(written).alias("written"),
        F.count_if(~written).alias("skipped"),
        F.count_if(written & ~F.col("valid")).alias("warnings"),
        F.coalesce(F.sum(F.when(written, F.size("images"))), F.lit(0)).cast("bigint").alias("images"),
    )
