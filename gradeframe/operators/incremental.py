"""Summaries kept as a stored state per partition, which merges and is renewed only where predictions changed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.functions import labels as L
from gradeframe.functions.numeric import NOISE_PLACES, known, round_even
from gradeframe.operators.metrics import _macro_counts, _with_macro

KEYS = ("experiment_tag", "eval_split_name", "model_key", "model_display_name")
SKETCH_K = 400  # a rank is off by about 0.7 % of the rows at most
_SUMS = ("latency_s", "tokens_per_sec", "prompt_tokens", "completion_tokens", "total_tokens")
_SKETCHES = ("latency_s", "tokens_per_sec")


def summary_state(predictions: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Counts, sums and quantile sketches of each group: all that its summary needs, of bounded size."""
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"),
        F.count_if(~L.is_valid_letter(F.col("pred_answer"))).alias("n_invalid"),
        *[F.sum(known(F.col(c))).alias(f"sum_{c}") for c in _SUMS], *[F.count(known(F.col(c))).alias(f"n_{c}") for c in _SUMS],
        *[F.kll_sketch_agg_double(known(F.col(c)), F.lit(SKETCH_K)).alias(f"sketch_{c}") for c in _SKETCHES],
        *_macro_counts(),
    )


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of finer groups as states of coarser ones."""
    sketches = [f"sketch_{c}" for c in _SKETCHES]
    sums = [c for c in states.columns if c.startswith(("n", "sum_", "__"))]
    counted = [c for c in sums if c not in by]
    return states.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in counted], *[F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in sketches]
    )


def summary_of(states: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """The summary that states give. Counts, shares and means are exact; quantiles are those of the sketches."""
    def mean(c: str):
        return round_even(F.try_divide(F.col(f"sum_{c}").cast("double"), F.col(f"n_{c}")), NOISE_PLACES)

    def quantile(c: str, p: float):
        return F.when(F.col(f"n_{c}") > 0, F.kll_sketch_get_quantile_double(f"sketch_{c}", F.lit(p)))

    return _with_macro(states).select(
        *by, F.col("n").alias("n_questions"), "n_correct",
        round_even(F.try_divide(F.col("n_correct").cast("double"), F.col("n")), 4).alias("accuracy"),
        round_even(F.try_divide(F.col("n_invalid").cast("double"), F.col("n")), 4).alias("invalid_prediction_rate"),
        round_even(mean("latency_s"), 4).alias("mean_latency_s"),
        quantile("latency_s", 0.5).alias("median_latency_s"), quantile("latency_s", 0.9).alias("p90_latency_s"),
        *[F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")).alias(f"mean_{c}") for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        round_even(mean("tokens_per_sec"), 6).alias("mean_tokens_per_sec"),
        quantile("tokens_per_sec", 0.5).alias("median_tokens_per_sec"),
        *[round_even(F.col(f"macro_{c}"), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )


def renew(states, predictions, stream: str, batch: int, touched: Iterable[Sequence]) -> bool:
    """Renew the stored states of some (split, model) partitions from the table of predictions.

    ``states`` and ``predictions`` are ledger tables with the same partitions. Only the touched ones are
    read and replaced, and a batch that counts already changes nothing.
    """
    touched = list(touched)
    return states.apply(stream, batch, summary_state(predictions.read(touched).drop("version")), lambda rows, *_: (rows, True))
