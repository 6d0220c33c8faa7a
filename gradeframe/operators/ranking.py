"""Top rows per group, leaderboards, model choice, exam sampling, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions.numeric import round_even
from gradeframe.operators.quantiles import join_on

def sample_key(df: DataFrame, id_columns: Sequence[str], seed: int) -> Column:
    """The md5 of the seed and the row's id: a shuffle order that no partitioning and no engine can change."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_columns]))


def stratified_cap(
    df: DataFrame, by: Sequence[str], n: int, seed: int = 42, id_columns: Sequence[str] = ("id",)
) -> DataFrame:
    """At most ``n`` rows per stratum, drawn by a seeded hash; a null stratum is its own.

    The rows of each (stratum, slice of the hash range) are counted first. Slices wholly below the cut
    are kept, and rows are ranked only within their slice, so no task sees a whole stratum whatever ``n``
    is. Rows above the cut are dropped where they are read.
    """
    by, ids = list(by), list(id_columns)
    keyed = df.withColumn("__h", sample_key(df, ids, seed))
    sliced = keyed.withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    running = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        sliced.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__end", F.sum("__c").over(running))
        .where((F.col("__end") - F.col("__c") < n))
        .groupBy(*by)
        .agg(
            F.max("__b").alias("__cut"),
            F.max_by(F.lit(n) - (F.col("__end") - F.col("__c")), "__b").alias("__room"),
        )
    )
    joined = join_on(sliced, cuts, by, "inner").where(F.col("__b") <= F.col("__cut"))
    order = Window.partitionBy(*by, "__b").orderBy("__h", *ids)
    ranked = joined.withColumn("__rn", F.row_number().over(order))
    return ranked.where((F.col("__b") < F.col("__cut")) | (F.col("__rn") <= F.col("__room"))).select(*df.columns)


def shuffled(df: DataFrame, seed: int = 42, id_columns: Sequence[str] = ("id",)) -> DataFrame:
    """Seeded shuffle as a distributed sort by a hash."""
    return df.orderBy(sample_key(df, id_columns, seed), *id_columns)


def cap(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by an explicit order, overall or per group.

    Overall it is a distributed top-n. Per group Spark limits each task's rows before the
    shuffle up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); raise that setting
    with a larger ``n``. For random caps of any size use ``stratified_cap``.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    ranked = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(ranked)).where(F.col("__rn") <= n).drop("__rn")


def error_sample(df: DataFrame, order: Sequence[str], n: int = K.ERROR_SAMPLE_ROWS, correct: str = "correct") -> DataFrame:
    """The first ``n`` wrong rows, for the error report."""
    return cap(df.where(~F.coalesce(F.col(correct), F.lit(False))), n, order)


def sample_exam(bank: DataFrame, k: int = K.EXAM_QUESTIONS, seed: int = 0, id_column: str = "question_id") -> DataFrame:
    """``k`` questions drawn by the md5 of seed and id; a distributed top-k, not a sort."""
    return bank.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), id_column)), id_column).limit(k)


def newest_first(df: DataFrame, ts: str, *tie: str) -> DataFrame:
    """Newest first; rows without a time come last."""
    return df.orderBy(F.desc_nulls_last(ts), *tie)


def leaderboard(
    df: DataFrame, metric: str = "mean_accuracy", best_metric: str | None = None, tie: str = "model_display_name"
) -> DataFrame:
    """Rank by a metric, with the bar width relative to the best accuracy plus five percent.

    The input is a summary with one row per model. The reference value of the bars is the
    accuracy (``best_metric``) of the row that leads the chosen order.
    """
    best_metric = best_metric or metric
    lead = Window.orderBy(F.desc_nulls_last(metric), tie)
    best = F.first(best_metric).over(lead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    width = F.floor(F.try_divide(F.col(best_metric), best * 1.05) * 100 + 0.5)
    return df.select(
        F.row_number().over(lead).alias("rank"), *df.columns, width.cast("int").alias("bar_width"),
        F.floor(F.col(best_metric) * 100 + 0.5).cast("int").alias("bar_pct"),
    ).orderBy("rank")


def select_model(runs: DataFrame, macro: str = "macro_avg_acc", overall: str = "overall_acc") -> DataFrame:
    """Runs ranked by macro then overall accuracy, the winner marked, margin to the next run.

    The input has one row per run.
    """
    order = Window.orderBy(F.desc_nulls_last(macro), F.desc_nulls_last(overall), "run")
    return (
        runs.withColumn("rank", F.row_number().over(order))
        .withColumn("selected", F.col("rank") == 1)
        .withColumn("margin", round_even(F.col(macro) - F.lead(macro).over(order), 4))
        .orderBy("rank")
    )


def with_trainer_state(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Run metrics with the best evaluation loss and steps of the run's trainer state."""
    context = states.select(
        "run", F.col("best_metric").alias("best_eval_loss"), F.col("global_step").alias("train_steps")
    )
    return runs.join(context, "run", "left")


def early_stop(epochs: DataFrame, patience: int, by: Sequence[str] = ("run",), metric: str = "val_acc") -> DataFrame:
    """Running best, epochs since the last improvement, and whether the epoch was reached.

    An epoch improves when it beats every earlier one and zero. Training stops after the first
    epoch whose counter reaches the patience. A run's epochs form the window partition; there
    is one row per epoch.
    """
    order = Window.partitionBy(*by).orderBy("epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    best_before = F.coalesce(F.max(metric).over(before), F.lit(0.0))
    marked = epochs.withColumn("improved", F.col(metric) > F.greatest(best_before, F.lit(0.0)))
    counted = marked.withColumn("__island", F.sum(F.col("improved").cast("int")).over(to_here))
    in_island = Window.partitionBy(*by, "__island").orderBy("epoch")
    counter = F.row_number().over(in_island) - F.when(F.col("__island") > 0, 1).otherwise(0)
    counted = counted.withColumn("patience_counter", counter)
    stopped = F.coalesce(F.max((F.col("patience_counter") >= patience).cast("int")).over(before), F.lit(0))
    return counted.withColumn("reached", stopped == 0).drop("__island")


def best_epoch(epochs: DataFrame, patience: int, by: Sequence[str] = ("run",), metric: str = "val_acc") -> DataFrame:
    """Per run: best epoch and its metric, the epoch training stopped at, total time."""
    ran = early_stop(epochs, patience, by, metric).where("reached")
    return ran.groupBy(*by).agg(
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col(metric))).alias("best_metric"),
        F.max("epoch").alias("last_epoch"),
        F.max((F.col("patience_counter") >= patience)).alias("stopped_early"),
        F.sum("time_s").alias("total_time_s"),
    )


def training_status(states: DataFrame) -> DataFrame:
    """Per run: last training log entry, last evaluation entry, best evaluation entry."""
    position = F.posexplode_outer("log_history").alias("__pos", "__e")
    log = states.select("run", "max_steps", "num_train_epochs", position)
    entry = F.col("__e")
    is_eval = entry["eval_loss"].isNotNull()
    is_train = entry["loss"].isNotNull() & ~is_eval
    last_train = F.max_by(F.when(is_train, entry), F.when(is_train, F.col("__pos")))
    last_eval = F.max_by(F.when(is_eval, entry), F.when(is_eval, F.col("__pos")))
    best_eval = F.min_by(F.when(is_eval, entry), F.when(is_eval, F.struct(entry["eval_loss"], F.col("__pos"))))
    out = log.groupBy("run").agg(
        F.max("max_steps").alias("max_steps"), F.max("num_train_epochs").alias("num_train_epochs"),
        last_train.alias("__t"), last_eval.alias("__e"), best_eval.alias("__b"),
    )
    return out.select(
        "run", "max_steps", "num_train_epochs",
        F.col("__t.step").alias("step"), F.col("__t.epoch").alias("epoch"), F.col("__t.loss").alias("train_loss"),
        F.col("__t.learning_rate").alias("learning_rate"),
        F.col("__e.step").alias("last_eval_step"), F.col("__e.eval_loss").alias("last_eval_loss"),
        F.col("__b.step").alias("best_eval_step"), F.col("__b.eval_loss").alias("best_eval_loss"),
    )
