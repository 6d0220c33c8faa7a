"""Prompts and chat messages rendered as columns."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.labels import cop_to_letter
from gradeframe.functions.text import blank_to_null, render, strip

OPTION_COLUMNS = ("opa", "opb", "opc", "opd")
BANK_OPTION_COLUMNS = ("option_a", "option_b", "option_c", "option_d")


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _options(columns: Sequence[str]) -> dict[str, Column]:
    return dict(zip("abcd", [F.col(c) for c in columns]))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _choices() -> dict[str, Column]:
    """Texts of a choices map; an absent letter is empty."""
    return {x.lower(): F.try_element_at(F.col("choices"), F.lit(x)) for x in K.LABELS}


def _when_present(template: str, value: Column) -> Column:
    """The template around a text, or nothing when the text is null."""
    (name,) = [n for _, n, _, _ in Formatter().parse(template) if n]
    return F.when(value.isNotNull(), render(template, **{name: value}))


def eval_prompt(image_line: bool = False) -> Column:
    """Evaluation prompt over the four option columns."""
    line = F.lit(K.IMAGE_LINE if image_line else "")
    return render(K.EVAL_PROMPT, question=F.col("question"), image_line=line, **_options(OPTION_COLUMNS))


def training_answer() -> Column:
    """Expected reply: the explanation, or a default sentence, and the answer letter."""
    letter = cop_to_letter(F.col("cop"))
    explanation = F.coalesce(blank_to_null(F.col("exp")), render(K.DEFAULT_EXPLANATION, letter=letter))
    return render(K.TRAINING_ANSWER, explanation=explanation, letter=letter)


def to_chat(df: DataFrame) -> DataFrame:
    """Training samples: id, subject, topic and three messages."""
    return df.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("subject_name", F.lit(K.UNKNOWN_SUBJECT)).alias("subject_name"),
        _text("topic_name").alias("topic_name"),
        F.array(
            message("system", F.lit(K.TUTOR_SYSTEM)),
            message("user", eval_prompt(image_line=True)),
            message("assistant", training_answer()),
        ).alias("messages"),
    )


def passage_prompt() -> Column:
    """Direct-answer prompt over a passage and a choices map."""
    return render(K.PASSAGE_PROMPT, passage=strip(F.col("passage")), question=strip(F.col("question")), **_choices())


def _by_subject(texts: dict[str, str], default: str) -> Column:
    subject = F.upper(_text("subject_category"))
    out = F.lit(default)
    for code, text in texts.items():
        out = F.when(subject == code, F.lit(text)).otherwise(out)
    return out


def cot_messages(
    systems: dict[str, str] | None = None, instructions: dict[str, str] | None = None
) -> Column:
    """Step-by-step messages whose texts depend on the subject, with a default for the rest."""
    system = _by_subject(systems or K.SUBJECT_SYSTEM_PROMPTS, K.DEFAULT_SYSTEM_PROMPT)
    user = render(
        K.COT_PROMPT, instructions=_by_subject(instructions or K.SUBJECT_INSTRUCTIONS, K.DEFAULT_INSTRUCTIONS),
        passage=strip(F.col("passage")), question=strip(F.col("question")), **_choices(),
    )
    return F.array(message("system", system), message("user", user))


def tuned_messages() -> Column:
    """Messages in the fine-tuning format; a blank passage is left out."""
    user = render(
        K.TUNED_PROMPT, passage_part=_when_present(K.TUNED_PASSAGE, blank_to_null(F.col("passage"))),
        question=strip(F.col("question")), **_choices(),
    )
    return F.array(message("system", F.lit(K.TUNED_SYSTEM)), message("user", user))


def option_pairs(df: DataFrame, options: Sequence[str] = OPTION_COLUMNS, context: str = "exp") -> DataFrame:
    """One row per option: optional context, and the question followed by the option."""
    rest = [c for c in df.columns if c not in {*options, context, "question"}]
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("option_index"), F.lit(x).alias("letter"),
            F.concat_ws(" ", _text("question"), _text(c)).alias("text"),
        )
        for i, (x, c) in enumerate(zip(K.LABELS, options))
    ])
    return df.select(*rest, blank_to_null(F.col(context)).alias("context"), F.inline(pairs))


def cross_text(options: Sequence[str] = OPTION_COLUMNS, context: str | None = "exp") -> Column:
    """Question and all options in one text, led by the context when there is one."""
    text = render(K.CROSS_TEXT, question=F.col("question"), **_options(options))
    if context is None:
        return text
    given = F.when(blank_to_null(F.col(context)).isNotNull(), F.col(context))
    return F.concat(F.coalesce(_when_present(K.CROSS_CONTEXT, given), F.lit("")), text)


def explain_prompt() -> Column:
    """Why the right answer is right and, where it differs, the given one wrong."""
    values = {
        "question": F.col("question"), "right": F.col("correct_answer"), "given": F.col("student_answer"),
        **_options(BANK_OPTION_COLUMNS),
    }
    good = F.coalesce(F.col("is_correct"), F.lit(False))
    return F.when(good, render(K.EXPLAIN_RIGHT, **values)).otherwise(render(K.EXPLAIN_WRONG, **values))


def answer_prompt() -> Column:
    return render(K.ANSWER_PROMPT, question=F.col("question"), **_options(BANK_OPTION_COLUMNS))


def independent_prompt(context: str = "exp") -> Column:
    """Reason without a pre-selected answer; a blank context is left out."""
    part = _when_present(K.INDEPENDENT_CONTEXT, blank_to_null(F.col(context)))
    return render(K.INDEPENDENT_PROMPT, question=F.col("question"), context_part=part, **_options(OPTION_COLUMNS))


def educator_prompt(context: str = "exp") -> Column:
    """Explain a selected answer, with the context when there is one."""
    part = _when_present(K.EDUCATOR_CONTEXT, blank_to_null(F.col(context)))
    return render(
        K.EDUCATOR_PROMPT, question=F.col("question"), letter=F.col("predicted_letter"), context_part=part,
        **_options(OPTION_COLUMNS),
    )


def _by_letter(texts: str) -> Column:
    """One line per letter of a map, letters in order."""
    lines = F.transform(
        F.array_sort(F.map_keys(texts)), lambda x: F.concat(x, F.lit(". "), F.try_element_at(F.col(texts), x))
    )
    return F.array_join(lines, "\n")


def parsed_user_message() -> Column:
    """User message from parsed parts: passage (when present), question, choices by letter."""
    passage = F.when(F.size("passage_parts") > 0, F.array_join("passage_parts", "\n"))
    return render(
        K.PARSED_USER, passage_part=_when_present(K.PARSED_PASSAGE, passage), question=F.col("question"),
        choices=_by_letter("choices"),
    )


def parsed_assistant_message() -> Column:
    """Concept, elimination by letter, answer and reason."""
    return render(
        K.PARSED_ASSISTANT, concept=F.col("concept"), elimination=_by_letter("elimination"),
        answer=F.coalesce("correct_answer", F.lit("Unknown")), why=F.col("why"),
    )


def parsed_messages(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", F.array(
        message("system", F.lit(K.PAGE_SYSTEM)),
        message("user", parsed_user_message()),
        message("assistant", parsed_assistant_message()),
    ))


def group_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns of each conversation as an ordered array of messages.

    A conversation is one output row by definition, so its turns must fit in one.
    """
    entry = F.struct(F.col(turn).alias("turn"), F.col("role"), F.col("text").alias("content"))
    grouped = df.groupBy(conversation).agg(F.array_sort(F.collect_list(entry)).alias("__t"))
    return grouped.select(
        conversation,
        F.transform("__t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
    )


EXPECTED_ROLES = ("system", "user", "assistant")


def violations(correct_answer: Column) -> Column:
    """Names of the rules that a three-message record breaks."""
    role = lambda i: F.try_element_at(F.col("messages"), F.lit(i + 1))["role"]
    content = lambda i: F.try_element_at(F.col("messages"), F.lit(i + 1))["content"]
    stated = strip(F.nullif(F.regexp_extract(_text(content(2)), r"(?md)^Answer:\n(.+)$", 1), F.lit("")))
    rules = [
        F.when(F.size("messages") != 3, F.lit("message_count")),
        *[
            F.when(~F.coalesce(role(i) == r, F.lit(False)), F.lit(f"role_{i}_not_{r}"))
            for i, r in enumerate(EXPECTED_ROLES)
        ],
        F.when(correct_answer.isNull(), F.lit("missing_answer")),
        F.when(F.coalesce(stated != correct_answer, F.lit(False)), F.lit("answer_mismatch")),
        F.when(~F.contains(_text(content(1)), F.lit("Choices:")), F.lit("missing_choices")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def validate_records(df: DataFrame, correct_answer: str = "correct_answer") -> DataFrame:
    """Add the violations and whether there are none."""
    answer = F.col(correct_answer) if correct_answer in df.columns else F.lit(None).cast("string")
    return df.withColumn("violations", violations(answer)).withColumn("valid", F.size("violations") == 0)


def violation_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
