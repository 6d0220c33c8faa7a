"""Scores over the four options: softmax and arg max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.functions.labels import letter_at


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the maximum is subtracted first."""
    values = F.transform(logits, lambda x: x.cast("double"))
    # one-element arrays bind the maximum and the total, so each is computed once per row
    shifted = F.transform(
        F.array(F.struct(values.alias("v"), F.array_max(values).alias("m"))),
        lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"])),
    )[0]
    return F.transform(
        F.array(F.struct(shifted.alias("e"), F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x).alias("t"))),
        lambda s: F.transform(s["e"], lambda x: x / s["t"]),
    )[0]


def argmax_index(scores: Column) -> Column:
    """0-based index of the highest score; the first wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_option(probs: Column) -> Column:
    """Struct of predicted index, letter, confidence."""
    index = argmax_index(probs)
    return F.struct(
        index.alias("predicted_index"),
        letter_at(index).alias("predicted_letter"),
        F.array_max(probs).alias("confidence"),
    )
