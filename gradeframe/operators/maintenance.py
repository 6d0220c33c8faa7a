"""The prediction table: newest row per key, what is finished, what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.constants import COMPLETE_ROWS, PREDICTION_KEYS


def newest(df: DataFrame, keys: Sequence[str] = tuple(PREDICTION_KEYS), recency: Sequence[str] = ("run_seq",)) -> DataFrame:
    """The newest row per key.

    Rank 1 is limited before the shuffle, so a key with very many copies sends one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in recency])
    return df.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") == 1).drop("__rn")


def upsert(
    existing: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(PREDICTION_KEYS),
    recency: Sequence[str] = ("run_seq",),
) -> DataFrame:
    """Union of both tables with the newest row per key."""
    return newest(existing.unionByName(new, allowMissingColumns=True), keys, recency)


def merge_batch(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str] = tuple(PREDICTION_KEYS),
    recency: Sequence[str] = ("run_seq",),
) -> DataFrame:
    """Upsert a batch into a table that already has one row per key.

    The wide rows of the table are not shuffled when the batch's keys fit a broadcast: they are
    only tested against the newest batch row of their key. Equal recency goes to the batch.
    """
    # the keys as one struct, in which nulls are equal: what the newest rows were found by also joins them
    key = F.struct(*keys)
    winners = newest(batch.withColumn("__key", key), ["__key"], recency)
    marks = winners.select(F.col("__key").alias("__k"), F.struct(*recency).alias("__newest"), F.lit(True).alias("__hit"))
    table = existing.withColumn("__key", key)
    same = F.col("__key") == F.col("__k")
    stays = F.col("__hit").isNull() | (F.struct(*recency) > F.col("__newest"))
    kept = table.join(marks, same, "left").where(stays).select(*existing.columns)
    newer = table.select("__key", F.struct(*recency).alias("__old")).join(marks, same).where(F.col("__old") > F.col("__newest")).select("__k")
    entering = winners.join(newer, same, "left_anti").drop("__key")
    return kept.unionByName(entering, allowMissingColumns=True)


def pending_questions(
    samples: DataFrame, predictions: DataFrame, on: Sequence[str] = ("question_id",)
) -> DataFrame:
    """Samples without a prediction; predictions with a null id count for nothing."""
    done = predictions.select(*on)
    for c in on:
        done = done.where(F.col(c).isNotNull())
    # distinct keeps one row per id and task, so copies of one id do not pile up in the join
    return samples.join(done.distinct(), list(on), "left_anti")


def completed(
    predictions: DataFrame, min_rows: int = COMPLETE_ROWS, by: Sequence[str] = ("eval_split_name", "model_key")
) -> DataFrame:
    """Groups with at least ``min_rows`` predictions; null keys form no group."""
    keyed = predictions
    for c in by:
        keyed = keyed.where(F.col(c).isNotNull())
    return keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)


def combinations(splits: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every split with every configured model."""
    return splits.select("eval_split_name").distinct().select(
        "eval_split_name", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_key")
    )


def pending_combos(
    splits: DataFrame, models: Sequence[str], predictions: DataFrame, min_rows: int = COMPLETE_ROWS
) -> DataFrame:
    """Split and model pairs still to run."""
    return remaining(combinations(splits, models), completed(predictions, min_rows), ["eval_split_name", "model_key"])


def remaining(everything: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones."""
    return everything.join(done.select(*keys), list(keys), "left_anti")


def resolve_models(served: DataFrame, specs: dict[str, Sequence[str]]) -> DataFrame:
    """Match configured models to served ids.

    ``served`` has (position, id). A spec matches when each of its normalised tokens occurs in
    the normalised id; the lowest position wins. The specs are configuration, so they travel as
    an array literal and every served id is looked at once.
    """
    import re

    from gradeframe.functions.text import normalize_text

    literal = F.array(*[
        F.struct(
            F.lit(key).alias("model_key"),
            F.array(*[F.lit(re.sub("[^a-z0-9]+", "", str(t).lower())) for t in tokens]).alias("tokens"),
        )
        for key, tokens in specs.items()
    ])
    named = served.withColumn("__nid", normalize_text(F.col("id")))
    matches = named.select(
        "position", "id",
        F.explode(F.filter(literal, lambda s: F.forall(s["tokens"], lambda t: F.contains(F.col("__nid"), t)))).alias("__s"),
    )
    return matches.groupBy(F.col("__s.model_key").alias("model_key")).agg(
        F.min_by("id", F.struct("position", "id")).alias("server_model_id")
    )


def models_to_run(pending: DataFrame) -> DataFrame:
    """Models with at least one split left, with the number of splits left."""
    return pending.groupBy("model_key").agg(F.count(F.lit(1)).alias("splits_left"))


