"""Confusion matrices, pivots and grids with zero-filled cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.labels import is_valid_letter
from gradeframe.functions.numeric import mean, rate, round_even
from gradeframe.operators.quantiles import exact_quantiles, join_on


def confusion(df: DataFrame, by: Sequence[str] = (), none_col: bool = False) -> DataFrame:
    """Counts per gold and predicted letter, every cell present.

    The cells are counted in one aggregate per group and unfolded afterwards, so zero cells
    need no grid join. ``none_col`` adds a column for anything that is not a letter.
    """
    gold = F.col("gold_answer")
    pred = F.col("pred_answer")
    columns = [*K.LABELS, K.NO_PREDICTION] if none_col else K.LABELS
    pred = F.when(is_valid_letter(pred), pred).otherwise(F.lit(K.NO_PREDICTION))
    cells = [(g, p) for g in K.LABELS for p in columns]
    counts = df.groupBy(*by).agg(
        *[F.count_if((gold == g) & (pred == p)).alias(f"__{g}{p}") for g, p in cells]
    )
    return counts.select(
        *by,
        F.inline(F.array(*[
            F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred"), F.col(f"__{g}{p}").alias("n"))
            for g, p in cells
        ])),
    )


def confusion_grid(keys: DataFrame, labels: Sequence[str] = tuple(K.LABELS), none_col: bool = True) -> DataFrame:
    """Zero-filled gold x predicted cells for each row of a key table."""
    columns = [*labels, K.NO_PREDICTION] if none_col else list(labels)
    return keys.distinct().select(
        *keys.columns, F.explode(F.array(*[F.lit(x) for x in labels])).alias("gold")
    ).select(
        *keys.columns, "gold", F.explode(F.array(*[F.lit(x) for x in columns])).alias("pred"),
        F.lit(0).cast("bigint").alias("n"),
    )


def pivot_split_model(by_split: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean accuracy, splits as rows and the named models as columns; missing pairs are 0."""
    return (
        by_split.groupBy("eval_split_name")
        .pivot("model_display_name", list(models))
        .agg(mean(F.col("accuracy")))
        .na.fill(0.0)
        .orderBy("eval_split_name")
    )


def pivot_subject_model(df: DataFrame, models: Sequence[str], with_n: bool = True) -> DataFrame:
    """Accuracy (and row count) from prediction rows, subjects as rows, models as columns."""
    measures = [rate(F.col("correct")).alias("accuracy")]
    if with_n:
        measures.append(F.count("correct").alias("n"))
    return (
        df.where(F.col("subject_category").isNotNull())
        .groupBy("subject_category")
        .pivot("model_display_name", list(models))
        .agg(*measures)
        .orderBy("subject_category")
    )


def subject_grid(df: DataFrame, models: Sequence[str], per_split: bool = False) -> DataFrame:
    """Accuracy in percent for every subject (and split) x model, 0 where there are no rows."""
    keys = ["subject_category", "eval_split_name"] if per_split else ["subject_category"]
    named = F.array(*[F.lit(m) for m in models])
    counted = (
        df.where(F.col("subject_category").isNotNull())
        .groupBy(*keys, "model_display_name")
        .agg(rate(F.col("correct")).alias("__acc"))
    )
    grid = counted.select(*keys).distinct().select(*keys, F.explode(named).alias("model_display_name"))
    joined = grid.join(counted, [*keys, "model_display_name"], "left")
    return joined.select(
        *keys, "model_display_name",
        (F.coalesce(F.col("__acc"), F.lit(0.0)) * 100.0).alias("accuracy_pct"),
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ("model_display_name",), places: int = 6) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and mean per group, outliers left out.

    The whiskers are the extreme values inside the fences: a second narrow pass joined with
    the one-row-per-group fences.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    quartiles = exact_quantiles(
        rows, by, {"q1": ("__v", 0.25), "median": ("__v", 0.5), "q3": ("__v", 0.75)}
    )
    fences = quartiles.withColumn("__low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "__high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    )
    inside = join_on(rows, fences, by, "inner")
    stats = inside.groupBy(*by, "q1", "median", "q3").agg(
        # the whisker never ends inside the box
        F.min(F.when(F.col("__v") >= F.col("__low"), F.col("__v"))).alias("__w0"),
        F.max(F.when(F.col("__v") <= F.col("__high"), F.col("__v"))).alias("__w1"),
        mean(F.col("__v")).alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )
    return stats.select(
        *by, "n",
        *[round_even(F.col(c), places).alias(c) for c in ("mean", "q1", "median", "q3")],
        round_even(F.least("__w0", "q1"), places).alias("whisker_low"),
        round_even(F.greatest("__w1", "q3"), places).alias("whisker_high"),
    ).orderBy("mean")
