"""Answer labels: the normalisations that coexist, scoring of single rows, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.constants import LABELS, SUBJECT_COLUMNS
from gradeframe.functions.numeric import round_even
from gradeframe.functions.text import blank_to_null, strip


def cop_to_letter(c: Column, default: str | None = "A") -> Column:
    """1..4 to A..D. Anything else becomes ``default``; pass None to keep unlabelled rows null."""
    letter = F.try_element_at(F.array(*[F.lit(x) for x in LABELS]), c.cast("int"))
    return F.when(c.between(1, len(LABELS)), letter).otherwise(F.lit(default).cast("string"))


def label0(c: Column, null_as: int = 0) -> Column:
    """1..4 to 0..3, null to ``null_as`` (-1 marks rows to skip), other values unchanged."""
    return (
        F.when(c.isNull(), F.lit(null_as))
        .when(c.between(1, len(LABELS)), c.cast("int") - 1)
        .otherwise(c.cast("int"))
    )


def letter_to_label1(c: Column) -> Column:
    """First letter of an answer to a 1-based label."""
    return F.ascii(F.upper(c)) - F.lit(ord("A")) + 1


def letter_at(index: Column) -> Column:
    """0-based option index to its letter."""
    return F.try_element_at(F.array(*[F.lit(x) for x in LABELS]), index.cast("int") + 1)


def gold_letter(c: Column) -> Column:
    return F.nullif(F.upper(strip(c)), F.lit(""))


def is_valid_letter(c: Column) -> Column:
    """True or false, never null."""
    return F.coalesce(c.isin(*LABELS), F.lit(False))


def is_correct(pred: Column, gold: Column) -> Column:
    """Equal and both present."""
    return F.coalesce(pred == gold, F.lit(False))


def tokens_per_sec(tokens: Column, latency: Column) -> Column:
    return F.when((tokens != 0) & (latency > 0), round_even(tokens.cast("double") / latency, 2))


def score_band(c: Column) -> Column:
    return _first_rule([(c >= low, name) for low, name in K.SCORE_BANDS], K.LOWEST_BAND)


def _first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """Value of the first rule that holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def infer_subject(df: DataFrame, columns: list[str] | None = None) -> Column:
    """First non-blank of the candidate columns that the table has, stripped."""
    present = [c for c in (columns or SUBJECT_COLUMNS) if c in df.columns]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in present])


def precision_label(model: Column) -> Column:
    return _first_rule([(model.contains(x), v) for x, v in K.PRECISION_RULES], K.DEFAULT_PRECISION)


def hardware_label(category: Column) -> Column:
    return _first_rule([(category.contains(x), v) for x, v in K.HARDWARE_RULES], K.DEFAULT_HARDWARE)
