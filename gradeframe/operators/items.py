"""Question items: required keys, quality, subjects, profiles of a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.labels import infer_subject, letter_to_label1


def has_keys(raw: Column, keys: Sequence[str] = tuple(K.REQUIRED_ITEM_KEYS)) -> Column:
    """Whether a JSON object has all keys; a key with a null value counts as present."""
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.coalesce(F.size(F.array_except(wanted, F.json_object_keys(raw))) == 0, F.lit(False))


def require_keys(raw: DataFrame, keys: Sequence[str] = tuple(K.REQUIRED_ITEM_KEYS), column: str = "value") -> DataFrame:
    """Raw JSON rows that have all keys."""
    return raw.where(has_keys(F.col(column), keys))


def key_report(raw: DataFrame, keys: Sequence[str] = tuple(K.REQUIRED_ITEM_KEYS), column: str = "value") -> DataFrame:
    """Kept and dropped rows."""
    return raw.agg(
        F.count_if(has_keys(F.col(column), keys)).alias("kept"),
        F.count_if(~has_keys(F.col(column), keys)).alias("dropped"),
    )


def fill_text(df: DataFrame, columns: Sequence[str] = ("exp", "question", "opa", "opb", "opc", "opd")) -> DataFrame:
    """Null text to empty text."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns if c in df.columns})


def with_subject(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumn("subject_category", infer_subject(df, list(columns) if columns else None))


def records_to_mcq(df: DataFrame) -> DataFrame:
    """Records (article, question, options array, answer letter) as item columns."""
    option = [F.try_element_at("options", F.lit(i + 1)).alias(c) for i, c in enumerate(("opa", "opb", "opc", "opd"))]
    answer = F.coalesce("answer", F.lit("A")) if "answer" in df.columns else F.lit("A")
    article = F.coalesce("article", F.lit("")) if "article" in df.columns else F.lit("")
    rest = [c for c in df.columns if c not in ("article", "question", "options", "answer")]
    return df.select(*rest, article.alias("exp"), "question", *option, letter_to_label1(answer).alias("cop"))


def text_only(df: DataFrame) -> DataFrame:
    """Questions without images."""
    return df.where(F.coalesce(F.size("images"), F.lit(0)) <= 0)


def quality_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of missing answers, missing questions, short choice sets, images."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(empty("answer")).alias("missing_answers"),
        F.count_if(empty("question")).alias("missing_questions"),
        F.count_if(F.coalesce(F.size("choices"), F.lit(0)) < len(K.LABELS)).alias("incomplete_choices"),
        F.count_if(F.coalesce(F.size("images"), F.lit(0)) > 0).alias("with_images"),
    )


def top_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values; values beyond the top are summed up in one last row.

    The list is a distributed top-k. Only the number of distinct values is needed for the rest.
    """
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(K.UNKNOWN_SUBJECT)).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = counts.orderBy(F.desc("n"), "value").limit(top)
    more = counts.agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("n")).where("n > 0")
    return best.select("value", "n", F.lit(False).alias("is_rest")).unionByName(
        more.select(F.lit("... more").alias("value"), "n", F.lit(True).alias("is_rest"))
    )


def split_profile(
    df: DataFrame, question: str = "question", answers: Sequence[str] = (), by: Sequence[str] = ("split",)
) -> DataFrame:
    """Rows, distinct words, longest question and longest answer (in words) per split.

    The vocabulary is counted over (split, word) pairs, which are distinct before the shuffle,
    so a split that holds most rows does not end in one task.
    """
    words = F.filter(F.split(F.col(question), r"(?U)\s+"), lambda w: w != "")
    answer_words = [F.size(F.filter(F.split(F.col(c), r"(?U)\s+"), lambda w: w != "")) for c in answers]
    longest = F.greatest(*answer_words) if len(answer_words) > 1 else (answer_words or [F.lit(None).cast("int")])[0]
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.max(F.size(words)).cast("bigint").alias("max_question_tokens"),
        F.max(longest).cast("bigint").alias("max_answer_tokens"),
    )
    vocabulary = (
        df.select(*by, F.explode(words).alias("__w")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("vocabulary"))
    )
    return sizes.join(vocabulary, list(by), "left")
