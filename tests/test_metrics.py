"""Hand-computed cases and comparisons with plain Python for the metric operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.functions.numeric import mean, round_even, total
from gradeframe.operators import confusion as C
from gradeframe.operators import metrics as M
from gradeframe.operators import quantiles as Q
from gradeframe.operators import ranking as H

SIX = [("A", "A"), ("A", "B"), ("B", "B"), ("C", None), ("D", "D"), (None, "A")]
SCHEMA = (
    "experiment_tag string, eval_split_name string, model_key string, model_display_name string, gold_answer string, "
    "pred_answer string, correct boolean, latency_s double, prompt_tokens bigint, completion_tokens bigint, "
    "total_tokens bigint, tokens_per_sec double, subject_category string, finish_reason string"
)


def rows(pairs, split="s1", latency=None):
    return [
        ("t", split, "m", "M", g, p, g is not None and g == p, (latency or [1.0, 2.0, 4.0, 1.0, 2.0, 4.0])[i % 6],
         None, None, None, None, None, "stop")
        for i, (g, p) in enumerate(pairs)
    ]


def test_macro_metrics_golden(spark):
    out = M.macro_metrics(spark.createDataFrame(rows(SIX), SCHEMA)).first()
    assert out.macro_precision == pytest.approx(0.5)
    assert out.macro_recall == pytest.approx(0.625)
    assert out.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0 + 1) / 4)


def test_summary_by_split_golden(spark):
    out = M.summary_by_split(spark.createDataFrame(rows(SIX), SCHEMA)).first()
    assert (out.n_questions, out.n_correct, out.accuracy, out.invalid_prediction_rate) == (6, 3, 0.5, 0.1667)
    assert out.macro_f1 == 0.5417
    assert out.median_latency_s == 2.0
    assert out.p90_latency_s == 4.0
    assert out.mean_prompt_tokens is None and out.median_tokens_per_sec is None


def test_null_group_keys_are_kept(spark):
    data = [(None, *r[1:]) for r in rows(SIX)] + rows(SIX)
    out = M.summary_by_split(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.experiment_tag or "", r.median_latency_s) for r in out) == [("", 2.0), ("t", 2.0)]


def test_summary_aggregated_std_of_one_split_is_zero(spark):
    one = M.summary_aggregated(M.summary_by_split(spark.createDataFrame(rows(SIX), SCHEMA)))
    assert one.first().std_accuracy == 0.0
    two = spark.createDataFrame(rows(SIX) + rows(SIX[:4] + [("D", "D")] * 6, "s2"), SCHEMA)
    out = M.summary_aggregated(M.summary_by_split(two)).first()
    assert out.n_test_sets == 2 and out.mean_accuracy == 0.65
    assert out.std_accuracy == pytest.approx(np.std([0.5, 0.8], ddof=1), abs=1e-4)


def test_empty_input_keeps_the_schema(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = M.summary_by_split(empty)
    assert out.count() == 0 and "p90_latency_s" in out.columns
    assert M.summary_aggregated(out).count() == 0
    assert M.performance_summary(empty).count() == 0


def test_confusion_forms(spark):
    df = spark.createDataFrame(rows(SIX) + rows([("A", "E")]), SCHEMA)
    square = C.confusion(df).agg(F.sum("n")).first()[0]
    wide = {(r.gold, r.pred): r.n for r in C.confusion(df, none_col=True).collect()}
    assert square == 4
    assert len(wide) == 20 and sum(wide.values()) == 6 and wide[("C", "None")] == 1 and wide[("A", "None")] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = random.Random(seed)
    groups = {
        "hot": [round(rng.lognormvariate(0, 2), 4) for _ in range(4000)],
        "equal": [0.5] * 1000,
        "signed": [rng.uniform(-5, 5) for _ in range(501)] + [0.0, -0.0],
        "one": [3.25],
        None: [1.0, 2.0, 4.0],
    }
    data = [(g, v) for g, values in groups.items() for v in values] + [("allnull", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    wanted = {"q0": ("v", 0.0), "q25": ("v", 0.25), "q50": ("v", 0.5), "q90": ("v", 0.9), "q100": ("v", 1.0)}
    out = {r.g: r for r in Q.exact_quantiles(df, ["g"], wanted).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        for name, (_, p) in wanted.items():
            assert out[g][name] == pytest.approx(float(np.quantile(values, p)), abs=1e-9), (g, name)


def test_buckets_are_monotone(spark):
    values = sorted([0.0, -1.0, 5e-324, 1.7e308, -1.7e308, 1e-9, -1e-9, 1.0, 1.0000001, 2.0, 1.9999999, 359.9999])
    df = spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(Q.bucket_of(F.col("v")))
    got = [r[0] for r in df.collect()]
    assert got == sorted(got)


def test_a_million_values_in_one_bucket_equal_percentile(spark):
    narrow = spark.range(0, 1_000_000, 1, 8).select(
        F.lit("hot").alias("g"), (F.lit(1.0) + F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 1e12).alias("v")
    )
    wide = spark.range(0, 1000).select(F.lit("wide").alias("g"), F.exp((F.col("id") - 500) / 3.0).alias("v"))
    df = narrow.unionByName(wide)
    wanted = {"q1": ("v", 0.01), "q50": ("v", 0.5), "q90": ("v", 0.9)}
    out = {r.g: r for r in Q.exact_quantiles(df, ["g"], wanted).collect()}
    assert narrow.select(Q.bucket_of(F.col("v")).alias("b")).distinct().count() == 1
    same = df.groupBy("g").agg(*[F.percentile("v", p).alias(name) for name, (_, p) in wanted.items()])
    for r in same.collect():
        for name in wanted:
            assert out[r.g][name] == pytest.approx(r[name], rel=1e-15)


def test_neighbouring_doubles_are_told_apart(spark):
    values = [1.0]
    for _ in range(200):
        values.append(float(np.nextafter(values[-1], 2)))
    values += [5e-324 * n for n in range(50)] + [-v for v in values] + [float("inf"), 1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    wanted = {f"q{i}": ("v", i / (len(values) - 1)) for i in range(0, len(values), 7)}
    row = Q.exact_quantiles(df.withColumn("g", F.lit(1)), ["g"], wanted).first()
    ordered = sorted(values)
    for i in range(0, len(values), 7):
        assert ordered[max(0, i - 1)] <= row[f"q{i}"] <= ordered[min(len(values) - 1, i + 1)]


def test_nothing_runs_before_an_action(spark):
    df = spark.range(0, 10000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7.0).alias("v"))
    spark.sparkContext.setJobGroup("lazy", "lazy")
    Q.exact_quantiles(df, ["g"], {"m": ("v", 0.5)})
    C.box_stats(df, "v", ["g"])
    H.stratified_cap(df, ["g"], 10, id_columns=["v"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []
    spark.sparkContext.setJobGroup("", "")


def test_the_counts_are_shuffled_once(spark):
    df = spark.range(0, 10000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7.0).alias("v"))
    out = Q.exact_quantiles(df, ["g"], {"m": ("v", 0.5)})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (0, 10000") == 1 and "ReusedExchange" in plan


def test_two_configurations_of_a_model_are_two_rows(spark):
    df = spark.createDataFrame(rows(SIX), SCHEMA).withColumns({"hf_repo": F.lit("r"), "temperature": F.lit(0.0), "hf_file": F.lit("f")})
    warm = df.withColumn("temperature", F.lit(0.7))
    none = df.withColumn("temperature", F.lit(None).cast("double")).withColumn("hf_file", F.lit(None).cast("string"))
    by_split = M.summary_by_split(df.unionByName(warm).unionByName(none))
    assert [r.n_questions for r in by_split.collect()] == [6, 6, 6] and "max_tokens" not in by_split.columns
    out = M.summary_aggregated(by_split).collect()
    assert [(r.hf_file, r.total_questions) for r in out] == [("f", 12)]


def test_one_exchange_for_macro_metrics(spark):
    df = spark.createDataFrame(rows(SIX), SCHEMA)
    plan = M.macro_metrics(df, ["model_key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_summary_reads_only_its_columns(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "'a' as model_key", "l_returnflag as gold_answer", "l_linestatus as pred_answer", "l_tax as raw_output"
    )
    plan = M.macro_metrics(li, ["model_key"])._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(12.5,), (37.5,), (0.12345,), (-2.5,)], "v double")
    assert [r[0] for r in df.select(round_even(F.col("v"))).collect()] == [12.0, 38.0, 0.0, -2.0]


def test_sums_and_means_are_those_of_doubles(spark):
    values = [1e-7, 3e-7, 9.5e12, None, float("nan"), 2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [1e-7, 3e-7, 9.5e12, 2.5]
    row = df.agg(mean(F.col("v")), total(F.col("v"))).first()
    assert row[0] == pytest.approx(sum(known) / 4, rel=1e-15) and row[1] == pytest.approx(sum(known), rel=1e-15)
    small = spark.createDataFrame([(1e-7,)] * 4, "v double").agg(mean(F.col("v"))).first()
    assert small[0] == pytest.approx(1e-7)
    infinite = spark.createDataFrame([(1.0,), (float("inf"),)], "v double").agg(mean(F.col("v")), total(F.col("v"))).first()
    assert infinite[0] == infinite[1] == float("inf")


def test_quantiles_with_nan_and_infinity(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, float("nan"))] + [("b", v) for v in (1.0, float("inf"), float("inf"))] + [("c", float("-inf")), ("c", 4.0), ("c", 4.0)]
    out = {r.g: r.m for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], {"m": ("v", 0.5)}).collect()}
    assert out == {"a": 2.0, "b": float("inf"), "c": 4.0}



def test_calibration_buckets(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0, 0.0, 0.0], 0), ([0.75, 0.25, 0.0, 0.0], 1), ([0.75, 0.25, 0.0, 0.0], -1)], "probs array<double>, gold int"
    )
    out = {r.bucket: (r.correct, r.total) for r in M.calibration(df).collect()}
    assert out == {"100-110%": (1, 1), "70-80%": (0, 1)}
    assert "90-100%" in {r.bucket for r in M.calibration(df, clamp=True).collect()}
    enc = M.encoder_metrics(df).first()
    assert (enc.total, enc.correct) == (2, 1) and enc.avg_confidence == pytest.approx(2.5 / 3)


def test_box_stats_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("m", v) for v in values], "model_display_name string, v double")
    out = C.box_stats(df, "v").first()
    assert (out.q1, out.median, out.q3, out.whisker_low, out.whisker_high, out.n) == (2.0, 3.0, 4.0, 1.0, 4.0, 5)


def test_run_metrics_document(spark):
    df = spark.createDataFrame(
        [("r", "X & Y", "A", "A", True), ("r", "X & Y", "B", None, False), ("r", None, "C", "C", True)],
        "run string, subject_name string, ground_truth string, predicted string, is_correct boolean",
    )
    out = M.run_metrics(df).first()
    assert out.overall_accuracy == pytest.approx(2 / 3) and out.macro_averaged_accuracy == 0.75
    assert out.per_subject_accuracy["X & Y"].n == 2 and out.confusion_matrix["B"]["None"] == 1


def test_quantile_methods(spark):
    df = spark.createDataFrame(rows(SIX), SCHEMA)
    approx = M.summary_by_split(df, quantiles="approx").first()
    assert approx.p90_latency_s == 4.0 and approx.median_latency_s in (1.0, 2.0)
    assert M.summary_by_split(df, quantiles="none").first().median_latency_s is None
