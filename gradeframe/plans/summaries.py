"""Queries over the prediction table: summaries, confusion, pivots, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import confusion as C
from gradeframe.operators import metrics as M
from gradeframe.plans import oracle_views as O
from gradeframe.plans import views as V
from gradeframe.plans.registry import query

WITH = "with " + O.PREDICTIONS

MEASURES = f"""
    count(*) as n_questions, count(*) filter (where correct) as n_correct,
    {O.r(O.rate('correct'), 4)} as accuracy,
    {O.r(O.rate("not coalesce(pred_answer in ('A','B','C','D'), false)"), 4)} as invalid_prediction_rate,
    {O.r(O.mean('latency_s'), 4)} as mean_latency_s,
    {O.r(O.quantile('latency_s', 0.5), 4)} as median_latency_s,
    {O.r(O.quantile('latency_s', 0.9), 4)} as p90_latency_s,
    {O.mean_int('prompt_tokens')} as mean_prompt_tokens,
    {O.mean_int('completion_tokens')} as mean_completion_tokens,
    {O.mean_int('total_tokens')} as mean_total_tokens,
    {O.r(O.mean('tokens_per_sec'), 6)} as mean_tokens_per_sec,
    {O.quantile('tokens_per_sec', 0.5)} as median_tokens_per_sec,
    {O.macro()}"""

SUMMARY_BY_SPLIT = f"""
by_split as (
  select experiment_tag, eval_split_name, model_key, model_display_name, {MEASURES} from predictions group by all
)"""

# The configuration of ``views.configured``.
CONFIGURED = """configured as (select *,
    concat('srv-', l_suppkey % 5, case when second then '-q8' else '' end) as server_model_id,
    concat('org/m', l_suppkey % 5) as hf_repo,
    case when l_suppkey % 5 <> 3 then concat('m', l_suppkey % 5, case when second then '-q8' else '-q4' end, '.gguf') end as hf_file,
    case when second then 0.7::double else 0.0::double end as temperature,
    cast(case when l_suppkey % 5 = 2 then 512 else 1024 end as int) as max_tokens
  from (select *, l_suppkey % 5 = 1 and l_orderkey % 2 = 1 as second from predictions))"""

CONFIGURED_BY_SPLIT = f"""{CONFIGURED}, by_split as (
  select experiment_tag, eval_split_name, model_key, model_display_name, server_model_id, hf_repo, hf_file, temperature, max_tokens,
    {MEASURES} from configured group by all
)"""


@query("G1_macro_metrics", f"{WITH} select model_key, {O.macro()} from predictions group by model_key")
def g1(spark, sf):
    return M.macro_metrics(V.predictions(spark, sf), ["model_key"], places=4)


@query("G2_summary_by_split", f"{WITH}, {CONFIGURED_BY_SPLIT} select * from by_split")
def g2(spark, sf):
    return M.summary_by_split(V.configured(V.predictions(spark, sf)))


@query("G3_summary_aggregated", f"""{WITH}, {CONFIGURED_BY_SPLIT}
  select experiment_tag, model_key, model_display_name, hf_repo, hf_file, count(distinct eval_split_name) as n_test_sets,
    cast(sum(n_questions) as bigint) as total_questions,
    {O.r('coalesce(stddev_samp(accuracy), 0)', 4)} as std_accuracy,
    {O.r(O.mean('accuracy'), 4)} as mean_accuracy,
    {O.r(O.mean('macro_precision'), 4)} as mean_macro_precision,
    {O.r(O.mean('macro_recall'), 4)} as mean_macro_recall,
    {O.r(O.mean('macro_f1'), 4)} as mean_macro_f1,
    {O.r(O.mean('invalid_prediction_rate'), 4)} as mean_invalid_prediction_rate,
    {O.r(O.mean('mean_latency_s'), 4)} as mean_latency_s,
    {O.r(O.mean('median_latency_s'), 4)} as median_latency_s,
    {O.r(O.mean('p90_latency_s'), 4)} as mean_p90_latency_s
  from by_split where hf_file is not null group by all""")
def g3(spark, sf):
    return M.summary_aggregated(M.summary_by_split(V.configured(V.predictions(spark, sf)), sort=False))


# --- further summaries -------------------------------------------------------------------


@query("G4_summary_by_subject", f"""{WITH}
  select experiment_tag, eval_split_name, model_key, model_display_name,
    coalesce(subject_category, 'Unknown') as subject_category, count(*) as n_questions,
    {O.r(O.rate('correct'), 4)} as accuracy, {O.r(O.mean('latency_s'), 4)} as mean_latency_s,
    {O.macro()}
  from predictions group by 1, 2, 3, 4, 5""")
def g4(spark, sf):
    return M.summary_by_subject(V.predictions(spark, sf))


@query("G5_subject_rollup", f"""{WITH}, s as (
    select eval_split_name, model_key, model_display_name, coalesce(subject_category, 'Unknown') as subject_category,
      count(*) as n_questions, {O.r(O.rate('correct'), 4)} as accuracy
    from predictions group by 1, 2, 3, 4)
  select model_display_name, subject_category, {O.r(O.mean('accuracy'), 4)} as accuracy,
    cast(sum(n_questions) as bigint) as n
  from s group by 1, 2""")
def g5(spark, sf):
    return M.subject_rollup(M.summary_by_subject(V.predictions(spark, sf)))


@query("G5_subject_rollup_weighted", f"""{WITH}
  select model_display_name, subject_category, {O.r(O.rate('correct'), 4)} as accuracy, count(*) as n
  from predictions where subject_category is not null group by 1, 2""")
def g5_weighted(spark, sf):
    return M.subject_rollup(V.predictions(spark, sf), weighted=True)


def _run_rows(spark, sf):
    return V.predictions(spark, sf).select(
        F.col("model_key").alias("run"), F.col("subject_category").alias("subject_name"),
        F.coalesce("gold_answer", F.lit("A")).alias("ground_truth"),
        F.col("pred_answer").alias("predicted"),
        F.coalesce(F.col("pred_answer") == F.coalesce("gold_answer", F.lit("A")), F.lit(False)).alias("is_correct"),
    )


RUNS = f"""{WITH}, rows as (
    select model_key as run, coalesce(subject_category, 'Unknown') as subject, coalesce(gold_answer, 'A') as gt,
      pred_answer as pred, coalesce(pred_answer = coalesce(gold_answer, 'A'), false) as ok
    from predictions),
  s as (select run, subject, count(*) as n, count(*) filter (where ok) as c,
      cast(count(*) filter (where ok) as double) / count(*) as acc from rows group by 1, 2),
  runs as (select run, cast(sum(c) as double) / cast(sum(n) as double) as overall_accuracy,
      {O.r(O.mean('acc'), 12)} as macro_averaged_accuracy,
      cast(sum(n) as bigint) as total_samples, cast(sum(c) as bigint) as correct from s group by 1)"""


@query("G6_run_metrics", f"""{RUNS},
  cells as (select run, gt, case when pred in ('A','B','C','D') then pred else 'None' end as p, count(*) as n
    from rows group by 1, 2, 3)
  select r.*, n_subjects, worst, none_of_a, b_as_c
  from runs r
  join (select run, count(*) as n_subjects, min(acc) as worst from s group by 1) using (run)
  join (select run, cast(coalesce(sum(n) filter (where gt = 'A' and p = 'None'), 0) as bigint) as none_of_a,
          cast(coalesce(sum(n) filter (where gt = 'B' and p = 'C'), 0) as bigint) as b_as_c
        from cells group by 1) using (run)""")
def g6(spark, sf):
    out = M.run_metrics(_run_rows(spark, sf))
    per_subject = F.map_values("per_subject_accuracy")
    return out.select(
        "run", "overall_accuracy", "macro_averaged_accuracy", "total_samples", "correct",
        F.size("per_subject_accuracy").cast("bigint").alias("n_subjects"),
        F.array_min(F.transform(per_subject, lambda x: x["accuracy"])).alias("worst"),
        F.col("confusion_matrix")["A"]["None"].alias("none_of_a"),
        F.col("confusion_matrix")["B"]["C"].alias("b_as_c"),
    )


@query("L5_per_subject_long", f"""{RUNS}
  select run as model, subject, {O.r('acc * 100', 2)} as accuracy_pct, n from s""")
def l5(spark, sf):
    from gradeframe.operators.consolidate import per_subject_long

    return per_subject_long(M.run_metrics(_run_rows(spark, sf)))


@query("G7_subject_accuracy", """
  select p_brand as subject_name,
    cast(count(*) filter (where l_partkey % 4 + 1 =
      (case when (l_orderkey + l_linenumber) % 5 < 2 then l_partkey % 4 else (l_partkey + l_linenumber) % 4 end) + 1) as double)
      / count(*) as acc
  from lineitem join part on l_partkey = p_partkey where p_size % 17 <> 0 group by 1""")
def g7(spark, sf):
    return M.subject_accuracy(V.selector_output(spark, sf))


PERFORMANCE = f"""count(*) as total_questions, {O.r(O.rate('correct'), 4)} as accuracy,
    {O.r(O.mean('latency_s'), 2)} as mean_latency_s,
    {O.r(O.quantile('latency_s', 0.5), 2)} as median_latency_s,
    {O.r(O.quantile('latency_s', 0.9), 2)} as p90_latency_s,
    {O.r(O.total('latency_s') + ' / 60.0::double', 1)} as total_time_min,
    {O.r(O.mean_int('prompt_tokens'), 0)} as mean_prompt_tokens,
    {O.r(O.mean_int('completion_tokens'), 0)} as mean_completion_tokens,
    {O.r(O.mean_int('total_tokens'), 0)} as mean_total_tokens,
    cast(sum(total_tokens) as bigint) as total_tokens_used,
    {O.r(O.mean('tokens_per_sec'), 1)} as mean_tokens_per_sec,
    {O.r(O.quantile('tokens_per_sec', 0.5), 1)} as median_tokens_per_sec,
    {O.r(O.rate("finish_reason = 'stop'") + ' * 100.0::double', 1)} as stop_pct,
    {O.r(O.rate("finish_reason = 'length'") + ' * 100.0::double', 1)} as truncated_pct"""


@query("G8_performance_summary", f"""{WITH}, specs as (
    select concat('model_', i) as model_key, concat(4 + i, 'B') as param_count,
      case when i % 2 = 0 then 'Q4_K_M' else 'BF16' end as quantization from range(4) t(i))
  select p.*, coalesce(d, model_key) as display_name, coalesce(param_count, '?') as param_count,
    coalesce(quantization, '?') as quantization
  from (select model_key, {PERFORMANCE} from predictions group by 1) p
  left join (select *, ['org0/Model 0 Q4_K_M', 'org1/Model 1 LoRA', 'org2/Model 2 Q4_K_M', 'org3/Model 3 LoRA'][
      cast(right(model_key, 1) as int) + 1] as d from specs) using (model_key)""")
def g8(spark, sf):
    return M.performance_summary(V.predictions(spark, sf), specs=V.model_specs(spark))


@query("G8_performance_by_split", f"{WITH} select eval_split_name, model_key, {PERFORMANCE} from predictions group by 1, 2")
def g8_split(spark, sf):
    return M.performance_summary(V.predictions(spark, sf), by=["eval_split_name"])


GRID = """(select unnest(['A','B','C','D']) as gold)"""


@query("G10_confusion", f"""{WITH}, k as (select distinct model_display_name from predictions),
  g as (select * from k, {GRID}, (select unnest(['A','B','C','D']) as pred))
  select g.*, (select count(*) from predictions p where p.model_display_name = g.model_display_name
    and p.gold_answer = g.gold and p.pred_answer = g.pred) as n from g""")
def g10(spark, sf):
    return C.confusion(V.predictions(spark, sf), ["model_display_name"])


@query("G11_confusion_none", f"""{WITH}, g as (select * from {GRID}, (select unnest(['A','B','C','D','None']) as pred)),
  c as (select gold_answer as gold, coalesce(pred_answer, 'None') as pred, count(*) as n from predictions group by 1, 2)
  select gold, pred, coalesce(n, 0) as n from g left join c using (gold, pred)""")
def g11(spark, sf):
    return C.confusion(V.predictions(spark, sf), none_col=True)


@query("F9_confusion_grid", f"""{WITH}, k as (select distinct eval_split_name, model_key from predictions)
  select k.*, gold, pred, cast(0 as bigint) as n from k, {GRID}, (select unnest(['A','B','C','D','None']) as pred)""")
def f9(spark, sf):
    return C.confusion_grid(V.predictions(spark, sf).select("eval_split_name", "model_key"))


@query("G18_accuracy_ci", f"""{WITH}, {SUMMARY_BY_SPLIT}
  select eval_split_name, model_key, accuracy, n_questions, invalid_prediction_rate as parse_failure_rate,
    {O.r('1.96 * sqrt(accuracy * (1 - accuracy) / n_questions)', 4)} as ci_half_width from by_split""")
def g18(spark, sf):
    by_split = M.summary_by_split(V.predictions(spark, sf), quantiles="none", sort=False)
    return M.accuracy_ci(by_split).select(
        "eval_split_name", "model_key", "accuracy", "n_questions", "parse_failure_rate", "ci_half_width"
    )


@query("G19_token_usage", f"""{WITH} select model_display_name, {O.mean_int('prompt_tokens')} as mean_prompt_tokens,
  {O.mean_int('completion_tokens')} as mean_completion_tokens from predictions group by 1""")
def g19(spark, sf):
    return M.token_usage(V.predictions(spark, sf))


@query("G17_speed_summary", f"""{WITH}, parts as (
    select 'MCQ inference (DGX8)' as category, * from predictions
    union all select 'MCQ inference (local)', * from predictions where l_shipdate >= timestamp '1998-01-01')
  select category, model_display_name as model,
    case when category like '%DGX8%' then 'DGX8 GB10' else 'MacBook Pro (MPS/CPU)' end as hardware,
    case when model_display_name like '%LoRA%' then 'BF16' when model_display_name like '%Q4_K_M%' then 'Q4_K_M' else 'q4_0' end as precision,
    {O.r(O.mean('latency_s'), 2)} as mean_latency_s, {O.r(O.quantile('latency_s', 0.5), 2)} as median_latency_s,
    {O.r(O.quantile('latency_s', 0.9), 2)} as p90_latency_s, {O.r(O.mean('tokens_per_sec'), 2)} as mean_tokens_per_sec,
    {O.r(O.total('latency_s') + ' / 60.0::double', 1)} as total_time_min, count(*) as n_questions
  from parts group by 1, 2, 3, 4""")
def g17(spark, sf):
    preds = V.predictions(spark, sf)
    recent = preds.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    return M.speed_summary({"MCQ inference (DGX8)": preds, "MCQ inference (local)": recent})


# --- pivots, grids, distributions --------------------------------------------------------


def _pivot(alias, value):
    return ", ".join(
        f"""{value.format(m=m)} as "{m}{alias}\"""" for m in V.MODEL_NAMES
    )


@query("L1_pivot_split_model", f"""{WITH}, s as (select eval_split_name, model_display_name, {O.r(O.rate('correct'), 4)} as accuracy
    from predictions group by 1, 2)
  select eval_split_name, """ + _pivot("", "coalesce(max(accuracy) filter (where model_display_name = '{m}'), 0)")
  + " from s group by 1")
def l1(spark, sf):
    by_split = M.summary_by_split(V.predictions(spark, sf), quantiles="none", sort=False)
    return C.pivot_split_model(by_split, V.MODEL_NAMES)


@query("L2_pivot_subject_model", f"{WITH} select subject_category, " + _pivot(
    "_accuracy", "cast(count(*) filter (where correct and model_display_name = '{m}') as double) / "
    "nullif(count(*) filter (where model_display_name = '{m}'), 0)")
  + ", " + _pivot("_n", "nullif(count(*) filter (where model_display_name = '{m}'), 0)")
  + " from predictions where subject_category is not null group by 1")
def l2(spark, sf):
    return C.pivot_subject_model(V.predictions(spark, sf), V.MODEL_NAMES)


def _grid_sql(keys, extra):
    names = ", ".join(f"'{m}'" for m in [*V.MODEL_NAMES, "absent model"])
    return f"""{WITH}, c as (select {keys}, model_display_name, {O.rate('correct')} as acc from predictions
      where subject_category is not null group by all),
    g as (select * from (select distinct {keys} from c), (select unnest([{names}]) as model_display_name))
    select {keys}, model_display_name, coalesce(acc, 0) * 100.0::double as accuracy_pct
    from g left join c using ({keys}, model_display_name)"""


@query("L3_subject_grid", _grid_sql("subject_category", ""))
def l3(spark, sf):
    return C.subject_grid(V.predictions(spark, sf), [*V.MODEL_NAMES, "absent model"])


@query("L3_subject_grid_per_split", _grid_sql("subject_category, eval_split_name", ""))
def l3_split(spark, sf):
    return C.subject_grid(V.predictions(spark, sf), [*V.MODEL_NAMES, "absent model"], per_split=True)


def _box_sql(value):
    return f"""{WITH}, v as (select model_display_name, cast({value} as double) as v from predictions where {value} is not null),
      q as (select model_display_name, {O.quantile('v', 0.25)} as q1, {O.quantile('v', 0.5)} as median,
        {O.quantile('v', 0.75)} as q3 from v group by 1)
      select model_display_name, count(*) as n, {O.r(O.mean('v'), 6)} as mean, {O.r('q1', 6)} as q1,
        {O.r('median', 6)} as median, {O.r('q3', 6)} as q3,
        {O.r('least(min(v) filter (where v >= q1 - 1.5::double * (q3 - q1)), q1)', 6)} as whisker_low,
        {O.r('greatest(max(v) filter (where v <= q3 + 1.5::double * (q3 - q1)), q3)', 6)} as whisker_high
      from v join q using (model_display_name) group by model_display_name, q.q1, q.median, q.q3"""


@query("L4_box_latency", _box_sql("latency_s"))
def l4_latency(spark, sf):
    return C.box_stats(V.predictions(spark, sf), "latency_s")


@query("L4_box_throughput", _box_sql("tokens_per_sec"))
def l4_throughput(spark, sf):
    return C.box_stats(V.predictions(spark, sf), "tokens_per_sec")


@query("L4_box_tokens", _box_sql("total_tokens"))
def l4_tokens(spark, sf):
    return C.box_stats(V.predictions(spark, sf), "total_tokens")
