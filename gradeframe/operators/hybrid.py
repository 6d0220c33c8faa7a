"""Decisions over two predictors: confidence gate, combined answer, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.numeric import rate

AGREE, OVERRIDE, PREFERRED, ENCODER = "encoder+llm_agree", "llm_override", "encoder_preferred", "encoder"


def needs_ensemble(confidence: Column, mode: str = "auto", threshold: float = K.GATE_THRESHOLD) -> Column:
    """Whether the second predictor is asked: always, never, or below the threshold."""
    if mode == "always":
        return F.lit(True)
    return confidence < threshold if mode == "auto" else F.lit(False)


def gate(df: DataFrame, mode: str = "auto", threshold: float = K.GATE_THRESHOLD) -> DataFrame:
    return df.withColumn("needs_ensemble", needs_ensemble(F.col("confidence"), mode, threshold))


def hybrid_answer(
    df: DataFrame, mode: str = "auto", threshold: float = K.GATE_THRESHOLD, override: float = K.OVERRIDE_THRESHOLD
) -> DataFrame:
    """Final answer and its source from predicted_letter, confidence and llm_answer."""
    second = F.nullif(F.col("llm_answer"), F.lit(""))
    asked = needs_ensemble(F.col("confidence"), mode, threshold)
    source = (
        F.when(~asked, ENCODER)
        .when(second == F.col("predicted_letter"), AGREE)
        .when(second.isNotNull() & (F.col("confidence") < override), OVERRIDE)
        .otherwise(PREFERRED)
    )
    return df.withColumn("answer_source", source).withColumn(
        "final_answer", F.when(F.col("answer_source") == OVERRIDE, second).otherwise(F.col("predicted_letter"))
    )


def gate_report(df: DataFrame, gold: str = "gold_answer", by: Sequence[str] = ()) -> DataFrame:
    """Rows, correct rows and accuracy per answer source."""
    ok = F.coalesce(F.col("final_answer") == F.col(gold), F.lit(False))
    return df.groupBy(*by, "answer_source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), rate(ok).alias("accuracy")
    )
