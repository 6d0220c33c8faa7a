"""Consolidation of many runs: united summaries, exports' content, run documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.numeric import pct, round_even


def union_parts(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate tables whose column sets differ; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def label_union(parts: dict[str, DataFrame], label: str = "model") -> DataFrame:
    """Concatenate named tables with the name as first column."""
    return union_parts([df.select(F.lit(name).alias(label), "*") for name, df in parts.items()])


def per_subject_long(runs: DataFrame, run: str = "run") -> DataFrame:
    """Unfold the per-subject map of run documents."""
    return runs.select(run, F.explode("per_subject_accuracy").alias("subject", "__m")).select(
        F.col(run).alias("model"), "subject", pct(F.col("__m.accuracy")).alias("accuracy_pct"),
        F.col("__m.n").alias("n"),
    )


def per_subject_of_documents(docs: DataFrame) -> DataFrame:
    """The per-subject table of run documents (run, document variant) whatever their shape.

    The entry may be named per_subject_accuracy, per_subject or subject_accuracy, and be an object by
    subject or an array of objects that name it (subject or subject_name). Each entry is a plain number
    or an object with the share (accuracy or acc) and the count (n, count or total). Other keys of a
    document are passed over, and entries without a share are left out.
    """
    def first(value: str, names: Sequence[str], kind: str) -> str:
        return "coalesce(" + ", ".join(f"try_variant_get({value}, '$.{n}', '{kind}')" for n in names) + ")"

    return docs.sparkSession.sql(
        f"""with entries as (
          select d.run, p.value as entry, p.key as subject_key
          from {{docs}} d, lateral variant_explode(d.document) as t(pos, name, section), lateral variant_explode(t.section) as p(pos, key, value)
          where t.name in ('per_subject_accuracy', 'per_subject', 'subject_accuracy')
        ), read as (
          select run as model, coalesce(subject_key, {first("entry", ("subject", "subject_name"), "string")}) as subject,
            coalesce(try_variant_get(entry, '$', 'double'), {first("entry", ("accuracy", "acc"), "double")}) as share,
            {first("entry", ("n", "count", "total"), "bigint")} as n
          from entries)
        select * from read where share is not null""",
        docs=docs,
    ).select("model", "subject", pct(F.col("share")).alias("accuracy_pct"), "n")


def run_summary(runs: DataFrame, run: str = "run") -> DataFrame:
    """Run documents as percentages, best first."""
    return runs.select(
        F.col(run).alias("model"),
        pct(F.coalesce("overall_accuracy", F.lit(0.0))).alias("overall_accuracy"),
        pct(F.coalesce("macro_averaged_accuracy", F.lit(0.0))).alias("macro_avg_accuracy"),
        "total_samples", "correct",
    ).orderBy(F.desc_nulls_last("overall_accuracy"))


def consolidated_summary(
    aggregated: dict[str, DataFrame], runs: DataFrame, benchmark: str, run_benchmark: str,
    run_evaluation: str,
) -> DataFrame:
    """One row per model and evaluation type from aggregated summaries and run summaries.

    ``aggregated`` maps an evaluation type to the output of ``summary_aggregated``; ``runs`` is
    the output of ``run_summary``. Values a source does not have are null.
    """
    parts = [
        df.select(
            F.coalesce("model_display_name", "model_key").alias("model"),
            F.lit(benchmark).alias("benchmark"),
            F.lit(kind).alias("evaluation_type"),
            pct(F.col("mean_accuracy")).alias("accuracy_pct"),
            pct(F.col("std_accuracy")).alias("std_pct"),
            round_even(F.col("mean_macro_f1"), 4).alias("mean_f1"),
            F.col("total_questions").cast("bigint").alias("n_questions"),
        )
        for kind, df in aggregated.items()
    ]
    parts.append(
        runs.select(
            "model", F.lit(run_benchmark).alias("benchmark"), F.lit(run_evaluation).alias("evaluation_type"),
            F.col("overall_accuracy").alias("accuracy_pct"),
            F.col("total_samples").cast("bigint").alias("n_questions"),
        )
    )
    return union_parts(parts).orderBy("benchmark", F.desc_nulls_last("accuracy_pct"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
