"""The answer letter in free model text.

Five rule sets coexist and disagree (first or last match, which tag wins). Each belongs to the
definition of a benchmark, so each is kept, behind one parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.text import last_matched, matched, remove, strip

RULES = ("direct_first", "cot_first", "tagged_last", "explained", "letter_only")


def after_think(c: Column) -> Column:
    """Text behind the last closing think tag, stripped."""
    return strip(F.substring_index(strip(c), K.THINK_END, -1))


def without_think(c: Column) -> Column:
    """Text without any complete think block, stripped."""
    return strip(remove(c, K.THINK_BLOCK))


def prepared(c: Column, rule: str, strip_think: bool = True) -> Column:
    """The part of the raw text that a rule set looks at."""
    if rule in ("direct_first", "cot_first", "tagged_last"):
        return after_think(c)
    if rule == "explained" and strip_think:
        return without_think(c)
    return c


def letter_in(text: Column, rule: str) -> Column:
    """Letter in prepared text, null when the rule set finds none."""
    upper = F.upper(text)
    whole = F.when(upper.isin(*K.LABELS), upper)
    if rule == "direct_first":
        return F.coalesce(whole, matched(upper, K.STANDALONE_LETTER), matched(upper, K.ANSWER_UPPER))
    if rule == "cot_first":
        tagged = [F.upper(matched(text, p)) for p in (K.FINAL_ANSWER, K.ANSWER_TAG, K.THE_ANSWER_IS)]
        return F.coalesce(*tagged, _letter_line(text), last_matched(upper, K.STANDALONE_LETTER))
    if rule == "tagged_last":
        tagged = [F.upper(last_matched(text, p)) for p in (K.ANSWER_TAG, K.THE_ANSWER_IS)]
        return F.coalesce(whole, *tagged, last_matched(upper, K.STANDALONE_LETTER))
    if rule == "explained":
        return F.coalesce(
            F.upper(matched(text, K.ANSWER_COLON)), last_matched(upper, K.STANDALONE_LETTER)
        )
    if rule == "letter_only":
        return matched(upper, K.STANDALONE_LETTER)
    raise ValueError(f"unknown rule set {rule!r}; one of {RULES}")


def _letter_line(text: Column) -> Column:
    """The lowest of the last three lines that is nothing but a letter."""
    lines = F.split(text, "\n")
    last_three = F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3))
    bare = F.transform(
        F.reverse(last_three),
        lambda x: F.upper(strip(remove(strip(F.rtrim(strip(x), F.lit("."))), r"\*+"))),
    )
    return F.try_element_at(F.filter(bare, lambda x: x.isin(*K.LABELS)), F.lit(1))


def extract_letter(c: Column, rule: str, strip_think: bool = True) -> Column:
    return letter_in(prepared(c, rule, strip_think), rule)


def with_letter(df: DataFrame, text: str, rule: str, out: str = "pred_answer") -> DataFrame:
    """Add the letter as a column; the think block is cut once, not once per pattern."""
    part = f"__{out}_text"
    return (
        df.withColumn(part, prepared(F.col(text), rule))
        .withColumn(out, letter_in(F.col(part), rule))
        .drop(part)
    )


def extract_explanation(c: Column, limit: int | None = K.EXPLANATION_LIMIT) -> Column:
    """Text between the explanation tag and the answer line, else the start of the text."""
    clean = without_think(c)
    fallback = F.substring(clean, 1, limit) if limit else clean
    return F.coalesce(strip(matched(clean, K.EXPLANATION)), fallback)


def answer_from_solution(c: Column) -> Column:
    """Correct letter named in a solution text."""
    return F.upper(F.coalesce(matched(c, K.CORRECT_ANSWER_IS), matched(c, K.SOLUTION_IS)))


def figure_refs(c: Column) -> Column:
    """Sorted distinct references to figures, tables and graphs."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in K.FIGURE_REFERENCES]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), strip)))


def strip_images(c: Column) -> Column:
    """Text without image markers; the pattern runs only where a marker is."""
    return strip(F.when(F.contains(c, F.lit(K.IMAGE_OPENING)), remove(c, K.SPACED_IMAGE_MARKER)).otherwise(c))


def image_list(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(K.IMAGE_PATH), F.lit(1))


def top_label(scores: Column) -> Column:
    """Letter of the highest-scored label in an array of (label, score); the first wins a tie."""
    ranked = F.transform(
        scores,
        lambda x, i: F.struct(F.coalesce(x["score"], F.lit(0.0)).alias("s"), (-i).alias("p"), x["label"].alias("label")),
    )
    return extract_letter(F.array_max(ranked)["label"], "letter_only")
