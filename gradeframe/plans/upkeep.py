"""Queries that maintain the prediction table and choose among runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import consolidate as J
from gradeframe.operators import items as I
from gradeframe.operators import maintenance as U
from gradeframe.operators import metrics as M
from gradeframe.operators import ranking as H
from gradeframe.plans import oracle_views as O
from gradeframe.plans import views as V
from gradeframe.plans.registry import query
from gradeframe.session import work_dir
from gradeframe.constants import PREDICTION_KEYS
from gradeframe.operators.incremental import renew, summary_of, summary_state
from gradeframe.plans.summaries import MEASURES, RUNS, SUMMARY_BY_SPLIT, WITH, _run_rows
from gradeframe.sources.buckets import write_bucketed
from gradeframe.sources.writers import upsert_table
from gradeframe.streaming.flows import prediction_table, upsert_batch

NEWEST = """newest as (select * exclude (rn) from (
    select *, row_number() over (partition by experiment_tag, eval_split_name, model_key, question_id
      order by l_shipdate desc, l_extendedprice desc, l_partkey desc, l_suppkey desc) as rn from predictions) where rn = 1)"""

KEPT = "eval_split_name, model_key, question_id, subject_category, gold_answer, pred_answer, latency_s, l_shipdate"
KEPT_COLUMNS = [c.strip() for c in KEPT.split(",")]


@query("H2_upsert", f"{WITH}, {NEWEST} select {KEPT} from newest")
def h2(spark, sf):
    rows, old = _old(spark, sf)
    merged = U.upsert(rows.where(old), rows.where(~old), recency=V.RECENCY)
    return merged.select(*KEPT_COLUMNS)


def _old(spark, sf):
    rows = V.predictions(spark, sf)
    old = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")
    return rows, old


@query("H2_merge_batch", f"{WITH}, {NEWEST} select {KEPT} from newest")
def h2_merge(spark, sf):
    rows, old = _old(spark, sf)
    # the batch holds older rows too, so both sides can win
    table = U.newest(rows.where(~old), recency=V.RECENCY)
    return U.merge_batch(table, rows.where(old), recency=V.RECENCY).select(*KEPT_COLUMNS)


@query("H2_upsert_table", f"{WITH}, {NEWEST} select {KEPT} from newest")
def h2_table(spark, sf):
    rows, old = _old(spark, sf)
    path = work_dir(spark, "prediction-table")
    for batch in (rows.where(old), rows.where(~old)):
        upsert_table(batch, path, recency=V.RECENCY)
    return spark.read.schema(rows.schema).parquet(path).select(*KEPT_COLUMNS)


@query("F4_pending_questions", f"""{WITH}, done as (select question_id from predictions where l_shipdate < timestamp '1998-01-01')
  select distinct question_id from predictions where question_id not in (select question_id from done)""")
def f4(spark, sf):
    rows = V.predictions(spark, sf)
    samples = rows.select("question_id").distinct()
    done = rows.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"))
    return U.pending_questions(samples, done)


@query("F4_pending_bucketed", f"""{WITH}, done as (select question_id from predictions where l_shipdate < timestamp '1998-01-01')
  select distinct question_id from predictions where question_id not in (select question_id from done)""")
def f4_bucketed(spark, sf):
    rows = V.predictions(spark, sf).select("question_id", "l_shipdate")
    done = rows.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"))
    kept = [write_bucketed(t, work_dir(spark, "bucketed"), ["question_id"], 8) for t in (rows, done)]
    # neither side is shuffled
    return U.pending_questions(kept[0].select("question_id").distinct(), kept[1])


@query("H2_newest_bucketed", f"{WITH}, {NEWEST} select {KEPT} from newest")
def h2_bucketed(spark, sf):
    table = write_bucketed(V.predictions(spark, sf), work_dir(spark, "bucketed"), PREDICTION_KEYS, 8)
    return U.newest(table, recency=V.RECENCY).select(*KEPT_COLUMNS)


@query("G2_incremental", f"""{WITH}, {NEWEST} select experiment_tag, eval_split_name, model_key, model_display_name, {MEASURES} from newest group by all"""
       .replace(f"    {O.r(O.quantile('latency_s', 0.5), 4)} as median_latency_s,\n", "").replace(f"    {O.r(O.quantile('latency_s', 0.9), 4)} as p90_latency_s,\n", "")
       .replace(f"    {O.quantile('tokens_per_sec', 0.5)} as median_tokens_per_sec,\n", ""))
def g2_incremental(spark, sf):
    rows, old = _old(spark, sf)
    table = prediction_table(spark, work_dir(spark, "predictions"), rows.schema)
    states = prediction_table(spark, work_dir(spark, "states"), summary_state(rows).schema)
    for n, batch in enumerate((rows.where(old), rows.where(~old))):
        touched = upsert_batch(table, batch, "batches", n, recency=V.RECENCY)
        renew(states, table, "batches", n, touched)
    return summary_of(states.read()).drop("median_latency_s", "p90_latency_s", "median_tokens_per_sec")


@query("G9_completed", f"""{WITH} select eval_split_name, model_key, count(*) as n from predictions
  group by 1, 2 having count(*) >= 225""")
def g9(spark, sf):
    return U.completed(V.predictions(spark, sf))


PENDING = f"""{WITH}, done as (select eval_split_name, model_key from predictions where finish_reason = 'length'
    group by 1, 2 having count(*) >= 550),
  pending as (select eval_split_name, model_key from (select distinct eval_split_name from predictions),
      (select unnest(['model_0','model_1','model_2','model_3','model_4','model_9']) as model_key)
    where (eval_split_name, model_key) not in (select eval_split_name, model_key from done))"""


@query("F5_pending_combos", f"{PENDING} select * from pending")
def f5(spark, sf):
    rows = V.predictions(spark, sf)
    return U.pending_combos(
        rows, [*V.MODELS, "model_9"], rows.where(F.col("finish_reason") == "length"), min_rows=550
    )


@query("F5_models_to_run", f"{PENDING} select model_key, count(*) as splits_left from pending group by 1")
def f5_models(spark, sf):
    return U.models_to_run(f5(spark, sf))


@query("J3_remaining", f"""{WITH} select distinct eval_split_name, model_key, subject_category from predictions p
  where not exists (select 1 from predictions d where d.finish_reason = 'length' and d.correct
    and d.eval_split_name = p.eval_split_name and d.model_key = p.model_key and d.subject_category = p.subject_category)""")
def j3(spark, sf):
    keys = ["eval_split_name", "model_key", "subject_category"]
    rows = V.predictions(spark, sf)
    done = rows.where(F.col("correct") & (F.col("finish_reason") == "length")).select(*keys).distinct()
    return U.remaining(rows.select(*keys).distinct(), done, keys)


@query("J4_distinct_sorted", f"{WITH} select distinct subject_category from predictions")
def j4(spark, sf):
    return J.distinct_sorted(V.predictions(spark, sf), "subject_category")


@query("F6_resolve_models", r"""with served as (select s_suppkey as position, concat('Org/', s_name, '-', n_name, '.gguf') as id
    from supplier join nation on s_nationkey = n_nationkey),
  n as (select *, regexp_replace(lower(id), '[^a-z0-9]+', '', 'g') as nid from served),
  m as (select 'first' as model_key, position, id from n where contains(nid, 'supplier') and contains(nid, 'nation1')
    union all select 'second', position, id from n where contains(nid, 'nation7') and contains(nid, 'gguf')
    union all select 'absent', position, id from n where contains(nid, 'nosuchmodel'))
  select model_key, arg_min(id, position) as server_model_id from m group by 1""")
def f6(spark, sf):
    supplier, nation = V.table(spark, sf, "supplier"), V.table(spark, sf, "nation")
    served = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("position"),
        F.concat(F.lit("Org/"), "s_name", F.lit("-"), "n_name", F.lit(".gguf")).alias("id"),
    )
    return U.resolve_models(served, {
        "first": ["Supplier", "NATION_1"], "second": ["nation-7", "gguf"], "absent": ["no such model"],
    })


# Which rows are drawn, in the order of the md5 of seed and id.
DRAWN = """rows as (select *, concat_ws('|', question_id, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as row_id from predictions),
  drawn as (select {by}, row_id, row_number() over (partition by {by} order by md5(concat('42|', row_id)), row_id) as rn from rows)
  select {by}, row_id from drawn where rn <= {n}"""


def _drawn(spark, sf, by, n):
    rows = V.predictions(spark, sf).withColumn("row_id", F.concat_ws(
        "|", "question_id", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    ))
    return H.stratified_cap(rows, [by], n, id_columns=["row_id"]).select(by, "row_id")


@query("H1_stratified_cap", f"{WITH}, {DRAWN.format(by='subject_category', n=800)}")
def h1(spark, sf):
    return _drawn(spark, sf, "subject_category", 800)


@query("H1_stratified_cap_large", f"{WITH}, {DRAWN.format(by='eval_split_name', n=5000)}")
def h1_large(spark, sf):
    return _drawn(spark, sf, "eval_split_name", 5000)


RECENT = "l_shipdate, l_extendedprice, l_partkey, l_suppkey, question_id"


@query("B18_cap_per_split", f"""{WITH} select eval_split_name, question_id, latency_s from (
    select *, row_number() over (partition by eval_split_name order by {RECENT}) as rn from predictions) where rn <= 100""")
def b18(spark, sf):
    return H.cap(V.predictions(spark, sf), 100, [c.strip() for c in RECENT.split(",")], ["eval_split_name"]).select(
        "eval_split_name", "question_id", "latency_s"
    )


@query("A15_error_sample", f"""{WITH} select question_id, gold_answer, pred_answer, latency_s from predictions
  where not correct order by {RECENT} limit 50""")
def a15(spark, sf):
    return H.error_sample(V.predictions(spark, sf), [c.strip() for c in RECENT.split(",")]).select(
        "question_id", "gold_answer", "pred_answer", "latency_s"
    )


@query("H8_sample_exam", """select concat('q', p_partkey) as question_id, p_name as question, p_type as topic from part
  order by md5(concat('7|q', p_partkey)), 1 limit 5""")
def h8(spark, sf):
    return H.sample_exam(V.question_bank(spark, sf), 5, seed=7).select("question_id", "question", "topic")


@query("H7_newest_first", f"""select concat('q', p_partkey) as question_id,
    case when p_partkey % 11 <> 0 then make_timestamp(cast(p_partkey * 3600 * 1000000 as bigint)) end as created_at from part""")
def h7(spark, sf):
    return H.newest_first(V.question_bank(spark, sf), "created_at", "question_id").select("question_id", "created_at")


LEADER = f"""{WITH}, {SUMMARY_BY_SPLIT}, agg as (
  select model_display_name, {O.r(O.mean('accuracy'), 4)} as mean_accuracy,
    {O.r(O.mean('macro_f1'), 4)} as mean_macro_f1, {O.r('coalesce(stddev_samp(accuracy), 0)', 4)} as std_accuracy,
    cast(sum(n_questions) as bigint) as total_questions
  from by_split group by 1)"""


@query("H4_leaderboard", f"""{LEADER}, b as (select mean_accuracy as best from agg order by mean_macro_f1 desc, model_display_name limit 1)
  select cast(row_number() over (order by mean_macro_f1 desc, model_display_name) as int) as rank, model_display_name,
    mean_accuracy, mean_macro_f1,
    cast(floor(mean_accuracy / (best * 1.05::double) * 100 + 0.5::double) as int) as bar_width,
    cast(floor(mean_accuracy * 100 + 0.5::double) as int) as bar_pct from agg, b""")
def h4(spark, sf):
    agg = M.summary_aggregated(M.summary_by_split(V.predictions(spark, sf), quantiles="none", sort=False))
    rows = agg.select("model_display_name", "mean_accuracy", "mean_macro_f1")
    return H.leaderboard(rows, "mean_macro_f1", "mean_accuracy")


@query("H3_select_model", f"""{RUNS}, c as (select run, {O.r('overall_accuracy', 4)} as overall_acc,
    {O.r('macro_averaged_accuracy', 4)} as macro_avg_acc, total_samples as n from runs)
  select *, cast(rank as int) = 1 as selected from (select *,
    cast(row_number() over (order by macro_avg_acc desc, overall_acc desc, run) as int) as rank,
    {O.r('macro_avg_acc - lead(macro_avg_acc) over (order by macro_avg_acc desc, overall_acc desc, run)', 4)} as margin
    from c)""")
def h3(spark, sf):
    runs = M.run_metrics(_run_rows(spark, sf)).select(
        "run", M.round_even(F.col("overall_accuracy"), 4).alias("overall_acc"),
        M.round_even(F.col("macro_averaged_accuracy"), 4).alias("macro_avg_acc"),
        F.col("total_samples").alias("n"),
    )
    return H.select_model(runs)


def _states(spark, sf):
    """Trainer state per supplier: one log entry per month, every third an evaluation."""
    month = F.date_trunc("month", "l_shipdate")
    return (
        V.table(spark, sf, "lineitem")
        .groupBy(F.concat(F.lit("run_"), F.col("l_suppkey")).alias("run"), month.alias("m"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_quantity") * 100).cast("bigint")).alias("q"))
        .withColumn("step", F.year("m").cast("bigint") * 12 + F.month("m"))
    )


STATES = """with e as (select concat('run_', l_suppkey) as run, date_trunc('month', l_shipdate) as m, count(*) as n,
    cast(sum(cast(l_quantity * 100 as bigint)) as bigint) as q from lineitem group by 1, 2),
  s as (select *, cast(year(m) * 12 + month(m) as bigint) as step from e)"""


@query("F7_with_trainer_state", f"""{STATES}, st as (select run, cast(min(q) as double) as best_eval_loss, max(step) as train_steps from s
    where run <> 'run_3' group by 1)
  select r.run, r.n, best_eval_loss, train_steps from (select run, cast(sum(n) as bigint) as n from s group by 1) r left join st using (run)""")
def f7(spark, sf):
    s = _states(spark, sf)
    runs = s.groupBy("run").agg(F.sum("n").alias("n"))
    states = s.where(F.col("run") != "run_3").groupBy("run").agg(
        F.min("q").cast("double").alias("best_metric"), F.max("step").alias("global_step")
    )
    return H.with_trainer_state(runs, states)


@query("G23_training_status", f"""{STATES},
  t as (select * from s where step % 3 <> 0), v as (select * from s where step % 3 = 0),
  runs as (select distinct run from s)
  select runs.run, t2.step, t2.loss as train_loss, v2.step as last_eval_step, v2.loss as last_eval_loss,
    v3.step as best_eval_step, v3.loss as best_eval_loss
  from runs left join (select run, max(step) as step, arg_max(cast(q as double), step) as loss from t group by 1) t2 using (run)
  left join (select run, max(step) as step, arg_max(cast(q as double), step) as loss from v group by 1) v2 using (run)
  left join (select run, arg_min(step, q * 100000 + step) as step, cast(min(q) as double) as loss from v group by 1) v3 using (run)""")
def g23(spark, sf):
    is_eval = F.col("step") % 3 == 0
    q = F.col("q").cast("double")
    entry = F.struct(
        "step", F.lit(None).cast("double").alias("epoch"), F.when(~is_eval, q).alias("loss"),
        F.lit(None).cast("double").alias("learning_rate"), F.when(is_eval, q).alias("eval_loss"),
    )
    # at most one entry per month and run
    states = _states(spark, sf).groupBy("run").agg(
        F.lit(0).cast("bigint").alias("max_steps"), F.lit(0).alias("num_train_epochs"),
        F.array_sort(F.collect_list(entry)).alias("log_history"),
    )
    return H.training_status(states).select(
        "run", "step", "train_loss", "last_eval_step", "last_eval_loss", "best_eval_step", "best_eval_loss"
    )


def _epochs(spark, sf):
    return _states(spark, sf).select(
        "run", F.col("step").alias("epoch"), (F.col("q") % 97 / 97.0).alias("val_acc"),
        F.col("n").cast("double").alias("time_s"),
    )


EPOCHS = f"""{STATES}, ep as (select run, step as epoch, q % 97 / 97.0::double as val_acc, cast(n as double) as time_s from s),
  a as (select *, val_acc > coalesce(max(val_acc) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), 0)
      as improved from ep),
  b as (select *, sum(cast(improved as int)) over (partition by run order by epoch) as isl from a),
  c as (select *, row_number() over (partition by run, isl order by epoch) - cast(isl > 0 as int) as counter from b),
  d as (select *, coalesce(max(cast(counter >= 4 as int)) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), 0) = 0
      as reached from c)"""


@query("H6_early_stop", f"{EPOCHS} select run, epoch, val_acc, improved, cast(counter as int) as patience_counter, reached from d")
def h6(spark, sf):
    return H.early_stop(_epochs(spark, sf), 4).select(
        "run", "epoch", "val_acc", "improved", "patience_counter", "reached"
    )


@query("G22_best_epoch", f"""{EPOCHS} select run, max(epoch) filter (where improved) as best_epoch,
  max(val_acc) filter (where improved) as best_metric, max(epoch) as last_epoch, bool_or(counter >= 4) as stopped_early,
  sum(time_s) as total_time_s from d where reached group by 1""")
def g22(spark, sf):
    return H.best_epoch(_epochs(spark, sf), 4)


@query("J1_consolidated_summary", f"""{LEADER}, runs as (select model_key as run, {O.rate('correct')} as acc, count(*) as n from predictions group by 1)
  select model_display_name as model, 'seven test sets' as benchmark, 'direct' as evaluation_type,
    {O.r('mean_accuracy * 100.0::double', 2)} as accuracy_pct, {O.r('std_accuracy * 100.0::double', 2)} as std_pct,
    mean_macro_f1 as mean_f1, total_questions as n_questions from agg
  union all select model_display_name, 'seven test sets', 'step by step',
    {O.r('mean_accuracy * 100.0::double', 2)}, {O.r('std_accuracy * 100.0::double', 2)}, mean_macro_f1, total_questions from agg
  union all select run, 'development split', 'run', {O.r('acc * 100.0::double', 2)}, null, null, n from runs""")
def j1(spark, sf):
    preds = V.predictions(spark, sf)
    agg = M.summary_aggregated(M.summary_by_split(preds, quantiles="none", sort=False))
    rows = preds.select(
        F.col("model_key").alias("run"), F.col("subject_category").alias("subject_name"),
        F.col("gold_answer").alias("ground_truth"), F.col("pred_answer").alias("predicted"),
        F.col("correct").alias("is_correct"),
    )
    runs = J.run_summary(M.run_metrics(rows))
    return J.consolidated_summary(
        {"direct": agg, "step by step": agg}, runs, "seven test sets", "development split", "run"
    )


@query("J2_label_union", f"""{WITH} select model_key as model, question_id, pred_answer, case when model_key in ('model_0', 'model_2', 'model_4') then latency_s end as latency_s,
    case when model_key in ('model_1', 'model_3') then subject_category end as subject_category from predictions""")
def j2(spark, sf):
    rows = V.predictions(spark, sf)
    own = {0: "latency_s", 1: "subject_category"}
    return J.label_union({
        m: rows.where(F.col("model_key") == m).select("question_id", "pred_answer", own[i % 2]) for i, m in enumerate(V.MODELS)
    })


@query("G16_top_counts", f"""{WITH}, c as (select coalesce(subject_category, 'Unknown') as value, count(*) as n from predictions group by 1)
  (select value, n, false as is_rest from c order by n desc, value limit 10)
  union all select '... more', greatest(count(*) - 10, 0), true from c having count(*) > 10""")
def g16(spark, sf):
    return I.top_counts(V.predictions(spark, sf), "subject_category")


@query("G20_split_profile", r"""with w as (select source as split, unnest(list_filter(regexp_split_to_array(text, '[\s\x0b\x85\pZ]+'), lambda x: x <> '')) as word, doc_id from documents),
  p as (select source as split, count(*) as n_questions,
     max(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x85\pZ]+'), lambda x: x <> ''))) as max_question_tokens,
     max(len(list_filter(regexp_split_to_array(lang, '[\s\x0b\x85\pZ]+'), lambda x: x <> ''))) as max_answer_tokens from documents group by 1)
  select p.*, v.vocabulary from p left join (select split, count(distinct word) as vocabulary from w group by 1) v using (split)""")
def g20(spark, sf):
    docs = V.table(spark, sf, "documents").withColumnRenamed("source", "split")
    return I.split_profile(docs, "text", ["lang"])
