"""Scoring of predictions and the summary tables at every grain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions import labels as L
from gradeframe.functions.numeric import int_mean, mean, rate, round_even, share, total
from gradeframe.functions.options import argmax_option
from gradeframe.operators.quantiles import approx_quantiles, exact_quantiles, join_on

# Two configurations of one model are two rows.
SPLIT_KEYS = [
    "experiment_tag", "eval_split_name", "model_key", "model_display_name",
    "server_model_id", "hf_repo", "hf_file", "temperature", "max_tokens",
]
MODEL_KEYS = ["experiment_tag", "model_key", "model_display_name", "hf_repo", "hf_file"]
SUBJECT_KEYS = ["experiment_tag", "eval_split_name", "model_key", "model_display_name"]


def present(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys that a table has; tables of older runs lack those of the configuration."""
    return [k for k in keys if k in df.columns]


def score_rows(df: DataFrame, answer: str = "answer", pred: str = "pred_answer") -> DataFrame:
    """Gold letter, correctness and throughput of raw prediction rows."""
    scored = df.withColumn("gold_answer", L.gold_letter(F.col(answer))).withColumn(
        "correct", L.is_correct(F.col(pred), F.col("gold_answer"))
    )
    if {"completion_tokens", "latency_s"} <= set(df.columns):
        scored = scored.withColumn(
            "tokens_per_sec", L.tokens_per_sec(F.col("completion_tokens"), F.col("latency_s"))
        )
    return scored


def _macro_counts() -> list[Column]:
    gold = F.coalesce(F.col("gold_answer"), F.lit(K.INVALID))
    pred = F.coalesce(F.col("pred_answer"), F.lit(K.INVALID))
    out = []
    for x in K.LABELS:
        out += [
            F.count_if((gold == x) & (pred == x)).alias(f"__tp_{x}"),
            F.count_if((gold != x) & (pred == x)).alias(f"__fp_{x}"),
            F.count_if((gold == x) & (pred != x)).alias(f"__fn_{x}"),
        ]
    return out


def _with_macro(counts: DataFrame) -> DataFrame:
    """Per-label precision, recall and F1 from the counts, then the plain mean of four labels."""
    c = {f"{k}_{x}": F.col(f"__{k}_{x}") for k in ("tp", "fp", "fn") for x in K.LABELS}
    counts = counts.withColumns({
        f"__{name}_{x}": share(c[f"tp_{x}"], c[f"tp_{x}"] + c[f"{other}_{x}"])
        for x in K.LABELS for name, other in (("p", "fp"), ("r", "fn"))
    })
    precision, recall = ([F.col(f"__{k}_{x}") for x in K.LABELS] for k in "pr")
    f1 = [share(2 * p * r, p + r) for p, r in zip(precision, recall)]
    out = counts.withColumns({
        f"macro_{name}": reduce(add, values) / F.lit(float(len(K.LABELS)))
        for name, values in (("precision", precision), ("recall", recall), ("f1", f1))
    })
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def macro_metrics(df: DataFrame, by: Sequence[str] = (), places: int | None = None) -> DataFrame:
    """Macro precision, recall and F1 over A-D; one hash aggregate whatever the grain."""
    out = _with_macro(df.groupBy(*by).agg(*_macro_counts()))
    if places is None:
        return out
    names = ("macro_precision", "macro_recall", "macro_f1")
    return out.withColumns({c: round_even(F.col(c), places) for c in names})


def _rounded(df: DataFrame, places: int, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), places) for c in columns})


def _with_quantiles(
    df: DataFrame, summary: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]], method: str
) -> DataFrame:
    """Join quantiles to a summary: "exact", "approx" (one pass, bounded sketches) or "none" (null)."""
    if method == "none":
        return summary.withColumns({name: F.lit(None).cast("double") for name in wanted})
    compute = {"exact": exact_quantiles, "approx": approx_quantiles}[method]
    return join_on(summary, compute(df, by, wanted), by, "left")


def summary_by_split(
    df: DataFrame, by: Sequence[str] | None = None, quantiles: str = "exact", sort: bool = True
) -> DataFrame:
    """Accuracy, invalid rate, latency, token and macro metrics per split and model.

    ``by`` are the keys of ``SPLIT_KEYS`` that the table has, unless given. Null keys form groups. Token
    and throughput columns are null for a group without any. ``quantiles`` is "exact", "approx" (bounded
    sketches in one pass) or "none" (null columns).
    """
    by = present(df, SPLIT_KEYS) if by is None else list(by)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(F.col("correct")).alias("n_correct"),
        rate(F.col("correct")).alias("accuracy"),
        rate(~L.is_valid_letter(F.col("pred_answer"))).alias("invalid_prediction_rate"),
        mean(F.col("latency_s")).alias("mean_latency_s"),
        int_mean(F.col("prompt_tokens")).alias("mean_prompt_tokens"),
        int_mean(F.col("completion_tokens")).alias("mean_completion_tokens"),
        int_mean(F.col("total_tokens")).alias("mean_total_tokens"),
        round_even(mean(F.col("tokens_per_sec")), 6).alias("mean_tokens_per_sec"),
        *_macro_counts(),
    )
    summary = _with_quantiles(
        df, _with_macro(base), by,
        {
            "median_latency_s": ("latency_s", 0.5),
            "p90_latency_s": ("latency_s", 0.9),
            "median_tokens_per_sec": ("tokens_per_sec", 0.5),
        },
        quantiles,
    )
    summary = _rounded(summary, 4, [
        "accuracy", "macro_precision", "macro_recall", "macro_f1", "invalid_prediction_rate",
        "mean_latency_s", "median_latency_s", "p90_latency_s",
    ])
    summary = summary.select(
        *by, "n_questions", "n_correct", "accuracy", "invalid_prediction_rate",
        "mean_latency_s", "median_latency_s", "p90_latency_s",
        "mean_prompt_tokens", "mean_completion_tokens", "mean_total_tokens",
        "mean_tokens_per_sec", "median_tokens_per_sec",
        "macro_precision", "macro_recall", "macro_f1",
    )
    if not sort:
        return summary
    return summary.orderBy(
        F.asc_nulls_last("eval_split_name"), F.desc_nulls_last("accuracy"),
        F.desc_nulls_last("macro_f1"), F.asc_nulls_last("mean_latency_s"),
    )


def summary_aggregated(by_split: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Mean over splits of already rounded split metrics; one split has deviation 0.

    ``by`` are the keys of ``MODEL_KEYS`` that the table has, unless given; rows with a null key are left out.
    """
    by = present(by_split, MODEL_KEYS) if by is None else list(by)
    means = {
        "mean_accuracy": "accuracy",
        "mean_macro_precision": "macro_precision",
        "mean_macro_recall": "macro_recall",
        "mean_macro_f1": "macro_f1",
        "mean_invalid_prediction_rate": "invalid_prediction_rate",
        "mean_latency_s": "mean_latency_s",
        "median_latency_s": "median_latency_s",
        "mean_p90_latency_s": "p90_latency_s",
    }
    keyed = by_split.where(_all_present(by))
    out = keyed.groupBy(*by).agg(
        F.count_distinct("eval_split_name").alias("n_test_sets"),
        F.sum("n_questions").alias("total_questions"),
        F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std_accuracy"),
        *[mean(F.col(c)).alias(name) for name, c in means.items()],
    )
    out = _rounded(out, 4, ["std_accuracy", *means])
    return out.orderBy(
        F.desc_nulls_last("mean_accuracy"), F.desc_nulls_last("mean_macro_f1"),
        F.asc_nulls_last("mean_latency_s"),
    )


def _all_present(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def summary_by_subject(df: DataFrame, by: Sequence[str] = tuple(SUBJECT_KEYS)) -> DataFrame:
    """Metrics per split, model and subject; a missing subject counts as its own."""
    known = df.withColumn(
        "subject_category", F.coalesce(F.col("subject_category"), F.lit(K.UNKNOWN_SUBJECT))
    )
    out = _with_macro(
        known.groupBy(*by, "subject_category").agg(
            F.count(F.lit(1)).alias("n_questions"),
            rate(F.col("correct")).alias("accuracy"),
            mean(F.col("latency_s")).alias("mean_latency_s"),
            *_macro_counts(),
        )
    )
    out = _rounded(out, 4, ["accuracy", "mean_latency_s", "macro_precision", "macro_recall", "macro_f1"])
    return out.orderBy(F.asc_nulls_last("subject_category"), F.desc_nulls_last("accuracy"))


def subject_rollup(by_subject: DataFrame, weighted: bool = False) -> DataFrame:
    """Per model and subject: mean of split accuracies, or the question-weighted accuracy."""
    if weighted:  # takes prediction rows
        return (
            by_subject.where(_all_present(["model_display_name", "subject_category"]))
            .groupBy("model_display_name", "subject_category")
            .agg(round_even(rate(F.col("correct")), 4).alias("accuracy"), F.count("correct").alias("n"))
        )
    return by_subject.groupBy("model_display_name", "subject_category").agg(
        round_even(mean(F.col("accuracy")), 4).alias("accuracy"), F.sum("n_questions").alias("n")
    )


def run_metrics(df: DataFrame, run: str = "run", subject: str = "subject_name") -> DataFrame:
    """Per run: overall accuracy, mean over subjects, per-subject map, confusion map."""
    counted = df.withColumn("__gt", F.col("ground_truth")).withColumn(
        "__pred", F.when(L.is_valid_letter(F.col("predicted")), F.col("predicted")).otherwise(K.NO_PREDICTION)
    )
    cells = counted.groupBy(run, F.coalesce(F.col(subject), F.lit(K.UNKNOWN_SUBJECT)).alias("__s")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col("is_correct")).alias("__c"),
        *[
            F.count_if((F.col("__gt") == g) & (F.col("__pred") == p)).alias(f"__{g}_{p}")
            for g in K.LABELS for p in [*K.LABELS, K.NO_PREDICTION]
        ],
    )
    accuracy = F.try_divide(F.col("__c").cast("double"), F.col("__n"))
    grouped = cells.groupBy(run).agg(
        F.sum("__n").alias("total_samples"),
        F.sum("__c").alias("correct"),
        round_even(mean(accuracy), 12).alias("macro_averaged_accuracy"),
        # one entry per subject of a run, after aggregation: the document form needs the map
        F.map_from_entries(
            F.collect_list(
                F.struct(F.col("__s"), F.struct(accuracy.alias("accuracy"), F.col("__n").alias("n")))
            )
        ).alias("per_subject_accuracy"),
        *[
            F.sum(f"__{g}_{p}").alias(f"__{g}_{p}")
            for g in K.LABELS for p in [*K.LABELS, K.NO_PREDICTION]
        ],
    )
    confusion = F.create_map(*[
        part
        for g in K.LABELS
        for part in (
            F.lit(g),
            F.create_map(*[x for p in [*K.LABELS, K.NO_PREDICTION] for x in (F.lit(p), F.col(f"__{g}_{p}"))]),
        )
    ])
    return grouped.select(
        run,
        F.try_divide(F.col("correct").cast("double"), F.col("total_samples")).alias("overall_accuracy"),
        "macro_averaged_accuracy", "total_samples", "correct", "per_subject_accuracy",
        confusion.alias("confusion_matrix"),
    )


def subject_accuracy(
    df: DataFrame, by: Sequence[str] = (), subject: str = "subject_name", actual: str = "cop",
    predicted: str = "predictions",
) -> DataFrame:
    """Share of rows per subject whose label column equals the prediction column."""
    return (
        df.where(F.col(subject).isNotNull())
        .groupBy(*by, subject)
        .agg(rate(F.coalesce(F.col(actual) == F.col(predicted), F.lit(False))).alias("acc"))
    )


def performance_summary(
    df: DataFrame, by: Sequence[str] = (), specs: DataFrame | None = None, quantiles: str = "exact"
) -> DataFrame:
    """Accuracy, latency, tokens, throughput and finish reasons per model (and split)."""
    keyed = df.where(_all_present([*by, "model_key"]))
    keys = [*by, "model_key"]
    base = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_questions"),
        rate(F.col("correct")).alias("accuracy"),
        mean(F.col("latency_s")).alias("mean_latency_s"),
        (total(F.col("latency_s")) / 60.0).alias("total_time_min"),
        int_mean(F.col("prompt_tokens")).alias("mean_prompt_tokens"),
        int_mean(F.col("completion_tokens")).alias("mean_completion_tokens"),
        int_mean(F.col("total_tokens")).alias("mean_total_tokens"),
        F.sum("total_tokens").alias("total_tokens_used"),
        mean(F.col("tokens_per_sec")).alias("mean_tokens_per_sec"),
        (rate(F.col("finish_reason") == "stop") * 100.0).alias("stop_pct"),
        (rate(F.col("finish_reason") == "length") * 100.0).alias("truncated_pct"),
    )
    out = _with_quantiles(
        keyed, base, keys,
        {
            "median_latency_s": ("latency_s", 0.5),
            "p90_latency_s": ("latency_s", 0.9),
            "median_tokens_per_sec": ("tokens_per_sec", 0.5),
        },
        quantiles,
    )
    places = {
        "accuracy": 4, "mean_latency_s": 2, "median_latency_s": 2, "p90_latency_s": 2, "total_time_min": 1,
        "mean_prompt_tokens": 0, "mean_completion_tokens": 0, "mean_total_tokens": 0,
        "mean_tokens_per_sec": 1, "median_tokens_per_sec": 1, "stop_pct": 1, "truncated_pct": 1,
    }
    out = out.withColumns({c: round_even(F.col(c), p) for c, p in places.items()})
    if specs is not None:
        out = with_model_spec(out, specs)
    return out.orderBy(*by, F.desc("accuracy"), "model_key")


def with_model_spec(df: DataFrame, specs: DataFrame) -> DataFrame:
    """Attach display name, size and quantisation; "?" where the model is not described."""
    joined = df.join(
        specs.select(
            "model_key", F.col("display_name").alias("__d"), F.col("param_count").alias("__p"),
            F.col("quantization").alias("__q"),
        ),
        "model_key", "left",
    )
    return joined.select(
        *df.columns,
        F.coalesce("__d", "model_key").alias("display_name"),
        F.coalesce("__p", F.lit("?")).alias("param_count"),
        F.coalesce("__q", F.lit("?")).alias("quantization"),
    )


def token_usage(df: DataFrame) -> DataFrame:
    """Mean prompt and completion tokens per model."""
    return df.groupBy("model_display_name").agg(
        int_mean(F.col("prompt_tokens")).alias("mean_prompt_tokens"),
        int_mean(F.col("completion_tokens")).alias("mean_completion_tokens"),
    )


def accuracy_ci(by_split: DataFrame, z: float = K.CONFIDENCE_Z) -> DataFrame:
    """Half-width of the confidence interval of the accuracy, and the parse-failure rate."""
    p, n = F.col("accuracy"), F.col("n_questions")
    return by_split.withColumn(
        "ci_half_width", round_even(F.lit(z) * F.sqrt(p * (1 - p) / n), 4)
    ).withColumn("parse_failure_rate", F.col("invalid_prediction_rate"))


# --- predictors that return probabilities ----------------------------------------------


def with_selection(df: DataFrame) -> DataFrame:
    """Add predicted index, letter and confidence from the option probabilities."""
    if "predicted_index" in df.columns:
        return df
    best = argmax_option(F.col("probs"))
    return df.withColumn("__best", best).select(
        *df.columns, F.col("__best.predicted_index"), F.col("__best.predicted_letter"), F.col("__best.confidence")
    )


def calibration(df: DataFrame, by: Sequence[str] = (), clamp: bool = False) -> DataFrame:
    """Accuracy per confidence decile; rows without a gold label are skipped.

    Confidence 1.0 has its own bucket "100-110%"; ``clamp`` moves it into "90-100%".
    """
    low = (F.floor(F.col("confidence") * 10) * 10).cast("int")
    if clamp:
        low = F.least(low, F.lit(90))
    return (
        with_selection(df).where(F.col("gold") >= 0)
        .withColumn("bucket", F.format_string("%d-%d%%", low, low + 10))
        .groupBy(*by, "bucket")
        .agg(
            F.count_if(F.col("predicted_index") == F.col("gold")).alias("correct"),
            F.count(F.lit(1)).alias("total"),
            rate(F.col("predicted_index") == F.col("gold")).alias("accuracy"),
        )
    )


def encoder_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over labelled rows and mean confidence over all rows."""
    labelled = F.coalesce(F.col("gold") >= 0, F.lit(False))
    out = with_selection(df).groupBy(*by).agg(
        F.count_if(labelled).alias("total"),
        F.count_if(labelled & (F.col("predicted_index") == F.col("gold"))).alias("correct"),
        F.coalesce(round_even(mean(F.col("confidence")), 9), F.lit(0.0)).alias("avg_confidence"),
    )
    return out.withColumn("accuracy", share(F.col("correct"), F.col("total")))


def encoder_by_subject(df: DataFrame, subject: str = "subject_name") -> DataFrame:
    """Labelled rows per subject: correct, total, accuracy."""
    return (
        with_selection(df).where(F.col("gold") >= 0)
        .groupBy(F.coalesce(F.col(subject), F.lit(K.UNKNOWN_SUBJECT)).alias(subject))
        .agg(
            F.count_if(F.col("predicted_index") == F.col("gold")).alias("correct"),
            F.count(F.lit(1)).alias("total"),
            rate(F.col("predicted_index") == F.col("gold")).alias("accuracy"),
        )
    )


def compare_predictors(encoder: DataFrame, generative: DataFrame) -> DataFrame:
    """Totals of two predictors over the same benchmark, their difference and the winner.

    ``encoder`` has predicted_index (or probs) and gold, ``generative`` has predictions and cop.
    Both are tagged, united and reduced by one aggregate.
    """
    enc = with_selection(encoder).where(F.col("gold") >= 0).select(
        F.lit("encoder").alias("__p"), (F.col("predicted_index") == F.col("gold")).alias("__ok")
    )
    gen = generative.select(
        F.lit("generative").alias("__p"),
        F.coalesce(F.col("predictions") == F.col("cop"), F.lit(False)).alias("__ok"),
    )
    both = enc.unionByName(gen)
    picked = []
    for p in ("encoder", "generative"):
        mine = F.col("__p") == p
        picked += [
            F.count_if(mine & F.col("__ok")).alias(f"{p}_correct"),
            F.count_if(mine).alias(f"{p}_total"),
        ]
    out = both.agg(*picked)
    for p in ("encoder", "generative"):
        out = out.withColumn(f"{p}_accuracy", share(F.col(f"{p}_correct"), F.col(f"{p}_total")))
    difference = F.col("encoder_accuracy") - F.col("generative_accuracy")
    return out.withColumn("difference", difference).withColumn(
        "winner", F.when(difference > 0, "encoder wins").otherwise("generative wins")
    )


def speed_summary(parts: dict[str, DataFrame], training: DataFrame | None = None, quantiles: str = "exact") -> DataFrame:
    """Latency and throughput per category and model; optional training rows are united below.

    ``training`` has model, hardware, precision, steps, runtime_s, samples_per_s, steps_per_s,
    train_loss, notes.
    """
    tagged = None
    for category, df in parts.items():
        one = df.select(
            F.lit(category).alias("category"), F.col("model_display_name").alias("model"),
            "latency_s", "tokens_per_sec",
        )
        tagged = one if tagged is None else tagged.unionByName(one)
    tagged = tagged.where(F.col("model").isNotNull())
    keys = ["category", "model"]
    base = tagged.groupBy(*keys).agg(
        mean(F.col("latency_s")).alias("mean_latency_s"),
        mean(F.col("tokens_per_sec")).alias("mean_tokens_per_sec"),
        (total(F.col("latency_s")) / 60.0).alias("total_time_min"),
        F.count(F.lit(1)).alias("n_questions"),
    )
    out = _with_quantiles(
        tagged, base, keys,
        {"median_latency_s": ("latency_s", 0.5), "p90_latency_s": ("latency_s", 0.9)}, quantiles,
    )
    out = out.select(
        *keys,
        L.hardware_label(F.col("category")).alias("hardware"),
        L.precision_label(F.col("model")).alias("precision"),
        *[
            round_even(F.col(c), p).alias(c)
            for c, p in (
                ("mean_latency_s", 2), ("median_latency_s", 2), ("p90_latency_s", 2),
                ("mean_tokens_per_sec", 2), ("total_time_min", 1),
            )
        ],
        "n_questions",
    )
    if training is None:
        return out
    trained = training.withColumn("category", F.lit("Training")).withColumn(
        "runtime_hrs", round_even(F.col("runtime_s") / 3600.0, 2)
    )
    return trained.unionByName(out, allowMissingColumns=True)
