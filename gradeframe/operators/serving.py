"""Exam serving: scoring answers, merging graded questions, scoreboards, question listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.numeric import round_even
from gradeframe.functions.text import blank_to_null, short_name


def explode_answers(submissions: DataFrame) -> DataFrame:
    """One row per answer of submissions that carry an answers map."""
    keep = [c for c in submissions.columns if c != "answers"]
    return submissions.select(*keep, F.explode("answers").alias("question_id", "student_answer"))


def score_answers(answers: DataFrame, bank: DataFrame, unknown: str = "skip") -> DataFrame:
    """Answers joined with the question bank and marked.

    ``unknown='skip'`` drops answers to questions the bank does not have; ``'count'`` keeps them
    as error rows that count in the total. The join strategy is left to the optimizer: a small
    bank is broadcast by its size, a large one is shuffled and a hot question is split by the
    adaptive skew join.
    """
    columns = [c for c in bank.columns if c in (
        "question", "option_a", "option_b", "option_c", "option_d", "correct_answer", "image_url"
    )]
    known = bank.select("question_id", *columns, F.lit(True).alias("__known"))
    joined = answers.join(known, "question_id", "inner" if unknown == "skip" else "left")
    right = F.upper(F.coalesce("correct_answer", F.lit("")))
    given = F.upper(F.coalesce("student_answer", F.lit("")))
    found = F.col("__known").isNotNull()
    marked = joined.withColumn("is_correct", found & (right == given))
    if unknown == "count":
        marked = marked.withColumn("error", F.when(~found, "Question not found"))
    return marked.drop("__known")


def score_submission(marked: DataFrame, mode: str = "integer", by: Sequence[str] = ("submission_id",)) -> DataFrame:
    """Correct, total and percent per submission: whole percent or one decimal, half-even."""
    out = marked.groupBy(*by).agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total_questions")
    )
    share = F.try_divide(F.col("correct").cast("double"), F.col("total_questions"))
    if mode == "integer":
        score = round_even(share * 100).cast("int")
    else:
        score = round_even(F.try_divide(F.col("correct") * 100.0, F.col("total_questions")), 1)
    return out.withColumn("score_percent", score)


def score_maps(submissions: DataFrame, bank: DataFrame, unknown: str = "skip", mode: str = "integer") -> DataFrame:
    """Scores of submissions that carry a map; one without any scored answer gets 0."""
    scored = score_submission(score_answers(explode_answers(submissions), bank, unknown), mode)
    keep = [c for c in submissions.columns if c != "answers"]
    joined = submissions.select(*keep).join(scored, "submission_id", "left")
    return joined.na.fill(0, ["correct", "total_questions", "score_percent"])


def merge_explanations(submissions: DataFrame, graded: DataFrame, recency: str = "event_time") -> DataFrame:
    """Put explanations into the results array of submissions; a missing one becomes ''.

    The array is unfolded with its positions, joined, and folded again. It came from one row,
    so what is collected is bounded by what that row held. The last event of a question wins;
    of events at the same time, the one whose text sorts last.
    """
    last = graded.groupBy("submission_id", "question_id").agg(
        F.max_by("explanation", F.struct(recency, "explanation")).alias("__explanation")
    )
    rest = [c for c in submissions.columns if c not in ("results", "submission_id")]
    fields = [f for f in submissions.schema["results"].dataType.elementType.fieldNames() if f != "explanation"]
    opened = submissions.select(
        "submission_id", F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"),
        F.posexplode_outer("results").alias("__pos", "__r"),
    ).withColumn("question_id", F.col("__r.question_id"))
    joined = opened.join(last, ["submission_id", "question_id"], "left")
    result = F.struct(
        "__pos", *[F.col(f"__r.{f}").alias(f) for f in fields],
        F.coalesce("__explanation", F.lit("")).alias("explanation"),
    )
    folded = joined.groupBy("submission_id").agg(
        F.first("__rest").alias("__rest"),
        F.array_sort(F.collect_list(F.when(F.col("__pos").isNotNull(), result))).alias("__sorted"),
    )
    return folded.select(
        "submission_id", *([F.col(f"__rest.{c}").alias(c) for c in rest]),
        F.transform("__sorted", lambda x: F.struct(*[x[f].alias(f) for f in [*fields, "explanation"]])).alias("results"),
    )


def merge_explanation_rows(marked: DataFrame, graded: DataFrame, recency: Column) -> DataFrame:
    """The same on the long form: one row per submission and question."""
    last = graded.groupBy("submission_id", "question_id").agg(F.max_by("explanation", recency).alias("explanation"))
    return marked.drop("explanation").join(last, ["submission_id", "question_id"], "left").withColumn(
        "explanation", F.coalesce("explanation", F.lit(""))
    )


def model_scoreboard(graded: DataFrame, by: Sequence[str] = (), sort: bool = True) -> DataFrame:
    """Correct, total and whole percent per model over graded questions, best first unless not to be sorted."""
    answers = graded.select(*by, F.inline("model_answers")).where(
        F.coalesce(F.col("model"), F.lit("")) != ""
    )
    out = answers.groupBy(*by, "model").agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    board = out.select(
        *by, "model", short_name(F.col("model")).alias("short_name"), "correct", "total",
        round_even(F.lit(100.0) * F.col("correct") / F.col("total")).cast("int").alias("accuracy_pct"),
    )
    return board.orderBy(*by, F.desc("accuracy_pct"), "model") if sort else board


def scoreboard_with_student(scores: DataFrame, submissions: DataFrame, label: str = "You") -> DataFrame:
    """The models of a submission and its student, ranked by percent.

    The student comes first among equals, models keep their given order (by name here). A
    partition holds the models of one submission and one student.
    """
    student = submissions.select(
        "submission_id", F.lit(label).alias("name"), F.col("score_percent").cast("int").alias("accuracy_pct"),
        F.lit(True).alias("is_student"),
    )
    models = scores.select(
        "submission_id", F.coalesce(F.nullif("short_name", F.lit("")), F.col("model")).alias("name"), "accuracy_pct",
        F.lit(False).alias("is_student"), "correct", "total",
    )
    both = student.unionByName(models, allowMissingColumns=True)
    order = Window.partitionBy("submission_id").orderBy(F.desc("accuracy_pct"), F.desc("is_student"), "name")
    return both.withColumn("rank", F.row_number().over(order))


def submission_list(submissions: DataFrame, user_id: str | None = None) -> DataFrame:
    """Listing without the bulky results, newest first, optionally of one user."""
    rows = submissions if user_id is None else submissions.where(F.col("user_id") == user_id)
    return rows.drop("results").orderBy(F.desc_nulls_last("submitted_at"))


def missing_fields(df: DataFrame, columns: Sequence[str] = tuple(K.REQUIRED_QUESTION_FIELDS), trimmed: bool = False) -> DataFrame:
    """Add the names of required fields that are absent or empty (or blank, when trimmed)."""
    def absent(c):
        value = F.col(c) if c in df.columns else F.lit(None).cast("string")
        return (blank_to_null(value) if trimmed else F.nullif(value, F.lit(""))).isNull()

    names = F.array(*[F.when(absent(c), F.lit(c)) for c in columns])
    return df.withColumn("missing", F.filter(names, lambda x: x.isNotNull()))


def search_questions(df: DataFrame, text: str, columns: Sequence[str] = ("question", "subject", "topic")) -> DataFrame:
    """Rows in which any of the columns contains the text, whatever the case; '' passes all."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return df.where(hit)


def filter_results(results: DataFrame, mode: str = "all") -> DataFrame:
    """All, only correct or only wrong results."""
    ok = F.coalesce(F.col("is_correct"), F.lit(False))
    if mode == "correct":
        return results.where(ok)
    if mode == "wrong":
        return results.where(~ok)
    return results


def result_counts(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ok = F.coalesce(F.col("is_correct"), F.lit(False))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("wrong")
    )


def group_questions(groups: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank rows that any exam group names."""
    named = groups.select(F.explode("question_ids").alias("question_id")).distinct()
    return bank.join(named, "question_id", "left_semi")


def users_with_group(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Users with the name of their assigned group, null when unassigned."""
    return users.join(groups.select("group_id", F.col("name").alias("group_name")), "group_id", "left")


def _topics(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    return df.select(*by, column).where(F.nullif(column, F.lit("")).isNotNull()).distinct()


def topics(df: DataFrame, column: str = "subject", by: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct non-empty values per group, one row each."""
    return _topics(df, column, by).orderBy(*by, column)


def topic_array(df: DataFrame, column: str = "subject", by: Sequence[str] = ()) -> DataFrame:
    """The same as an array per group; the distinct values are formed before collecting, and only arrays are sorted."""
    return _topics(df, column, by).groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("topics"))
