"""Queries over vectors and option scores: retrieval, arg max, gating, calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradeframe.functions import options as P
from gradeframe.functions.numeric import round_even
from gradeframe.operators import hybrid as N
from gradeframe.operators import metrics as M
from gradeframe.operators import retrieval as R
from gradeframe.plans import oracle_views as O
from gradeframe.plans import views as V
from gradeframe.plans.registry import query

SELECTOR = """sel0 as (select concat(l_orderkey, '-', l_linenumber) as id, l_orderkey, l_partkey, l_linenumber,
    cast(case when l_orderkey % 41 = 0 then 16 else 4 + (l_orderkey + l_linenumber) % 12 end as int) as top,
    cast((l_partkey + case when (l_orderkey + l_linenumber) % 4 = 0 then 1 else 0 end) % 4 as int) as shift,
    cast(case when l_partkey % 53 = 0 then -1 else l_partkey % 4 end as int) as gold,
    case when p_size % 17 <> 0 then p_brand end as subject_name,
    case when l_orderkey % 6 = 0 then null else substr('ABCD', cast((l_partkey + l_orderkey % 2) % 4 as int) + 1, 1) end as llm_answer,
    cast(l_partkey % 4 + 1 as int) as cop,
    cast(case when (l_orderkey + l_linenumber) % 5 < 2 then l_partkey % 4 else (l_partkey + l_linenumber) % 4 end + 1 as int) as predictions
  from lineitem join part on l_partkey = p_partkey),
  sel1 as (select *, (16 - top) // 2 as p2, (16 - top - (16 - top) // 2) // 2 as p3 from sel0),
  sel2 as (select *, list_transform([0, 1, 2, 3], lambda i: (case when shift = i then top when shift = (i + 3) % 4 then p2
      when shift = (i + 2) % 4 then p3 else 16 - top - p2 - p3 end) / 16.0::double) as probs from sel1),
  selector as (select *, cast(list_position(probs, list_max(probs)) - 1 as int) as predicted_index, list_max(probs) as confidence,
    substr('ABCD', cast(list_position(probs, list_max(probs)) as int), 1) as predicted_letter from sel2)"""


@query("H9_argmax_option", f"with {SELECTOR} select id, l_partkey, probs, predicted_index, predicted_letter, confidence from selector"
       .replace("id, l_partkey, probs,", "id, array_to_string(list_transform(probs, lambda p: cast(p * 16 as int)), '|') as sixteenths,"))
def h9(spark, sf):
    return M.with_selection(V.selector_output(spark, sf)).select(
        "id", F.array_join(F.transform("probs", lambda p: (p * 16).cast("int").cast("string")), "|").alias("sixteenths"),
        "predicted_index", "predicted_letter", "confidence",
    )


@query("H9_softmax", f"""with e as (select vec_id, list_transform(embedding, lambda x: exp(cast(x as double) - cast(list_max(embedding) as double))) as s from embeddings)
  select vec_id, {O.r('list_max(s) / list_sum(s)', 6)} as top, {O.r('list_min(s) / list_sum(s)', 6)} as low from e""")
def h9_softmax(spark, sf):
    probs = V.table(spark, sf, "embeddings").select("vec_id", P.softmax(F.col("embedding")).alias("p"))
    return probs.select(
        "vec_id", round_even(F.array_max("p"), 6).alias("top"), round_even(F.array_min("p"), 6).alias("low")
    )


DECILE = "cast(floor(confidence * 10::double) * 10 as int)"


@query("G12_calibration", f"""with {SELECTOR} select concat({DECILE}, '-', {DECILE} + 10, '%') as bucket,
  count(*) filter (where predicted_index = gold) as correct, count(*) as total,
  cast(count(*) filter (where predicted_index = gold) as double) / count(*) as accuracy from selector where gold >= 0 group by 1""")
def g12(spark, sf):
    return M.calibration(V.selector_output(spark, sf))


@query("G13_encoder_metrics", f"""with {SELECTOR} select count(*) filter (where gold >= 0) as total,
  count(*) filter (where gold >= 0 and predicted_index = gold) as correct, {O.r(O.mean('confidence'), 9)} as avg_confidence,
  cast(count(*) filter (where gold >= 0 and predicted_index = gold) as double) / count(*) filter (where gold >= 0) as accuracy from selector""")
def g13(spark, sf):
    return M.encoder_metrics(V.selector_output(spark, sf))


@query("G13_encoder_by_subject", f"""with {SELECTOR} select coalesce(subject_name, 'Unknown') as subject_name,
  count(*) filter (where predicted_index = gold) as correct, count(*) as total,
  cast(count(*) filter (where predicted_index = gold) as double) / count(*) as accuracy from selector where gold >= 0 group by 1""")
def g13_subject(spark, sf):
    return M.encoder_by_subject(V.selector_output(spark, sf))


@query("F10_compare_predictors", f"""with {SELECTOR}, c as (select count(*) filter (where gold >= 0 and predicted_index = gold) as encoder_correct,
    count(*) filter (where gold >= 0) as encoder_total, count(*) filter (where predictions = cop) as generative_correct, count(*) as generative_total from selector),
  a as (select *, encoder_correct::double / encoder_total as encoder_accuracy, generative_correct::double / generative_total as generative_accuracy from c)
  select *, encoder_accuracy - generative_accuracy as difference,
    case when encoder_accuracy > generative_accuracy then 'encoder wins' else 'generative wins' end as winner from a""")
def f10(spark, sf):
    rows = V.selector_output(spark, sf)
    return M.compare_predictors(rows.select("probs", "gold"), rows.select("predictions", "cop"))


HYBRID = f"""{SELECTOR}, gated as (select *, confidence < 0.7::double as needs_ensemble from selector),
  hybrid as (select *, case when not needs_ensemble then 'encoder' when llm_answer = predicted_letter then 'encoder+llm_agree'
      when llm_answer is not null and confidence < 0.35::double then 'llm_override' else 'encoder_preferred' end as answer_source from gated),
  final as (select *, case when answer_source = 'llm_override' then llm_answer else predicted_letter end as final_answer,
    case when gold >= 0 then substr('ABCD', gold + 1, 1) end as gold_answer from hybrid)"""


@query("N1_gate", f"with {HYBRID} select needs_ensemble, count(*) as n, min(confidence) as low, max(confidence) as high from gated group by 1")
def n1(spark, sf):
    return N.gate(M.with_selection(V.selector_output(spark, sf))).groupBy("needs_ensemble").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high")
    )


def _hybrid(spark, sf):
    return N.hybrid_answer(M.with_selection(V.selector_output(spark, sf))).withColumn(
        "gold_answer", F.when(F.col("gold") >= 0, V.letter(F.col("gold")))
    )


@query("N2_hybrid_answer", f"with {HYBRID} select id, predicted_letter, llm_answer, confidence, final_answer, answer_source from final")
def n2(spark, sf):
    return _hybrid(spark, sf).select("id", "predicted_letter", "llm_answer", "confidence", "final_answer", "answer_source")


@query("N3_gate_report", f"""with {HYBRID} select answer_source, count(*) as n, count(*) filter (where coalesce(final_answer = gold_answer, false)) as correct,
  cast(count(*) filter (where coalesce(final_answer = gold_answer, false)) as double) / count(*) as accuracy from final group by 1""")
def n3(spark, sf):
    return N.gate_report(_hybrid(spark, sf))


def _scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a user's model: the arg max of each row of an Arrow batch."""
    probs = np.stack(batch["probs"].to_numpy()) if len(batch) else np.zeros((0, 4))
    return pd.DataFrame({
        "id": batch["id"], "predicted_index": probs.argmax(axis=1).astype("int32"), "confidence": probs.max(axis=1, initial=0.0),
    })


@query("O1_predict_batches", f"with {SELECTOR} select id, predicted_index, confidence from selector")
def o1(spark, sf):
    rows = V.selector_output(spark, sf).select("id", "probs")
    return R.predict_batches(rows, _scorer, "id string, predicted_index int, confidence double")


# --- retrieval: every vector asks for its nearest passages ---------------------------------

TOPK = """e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
  pairs as (select q.vec_id as query_id, d.vec_id, round_even(list_dot_product(q.v, d.v) * 1000000, 0) / 1000000 as score from e q, e d),
  topk as (select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from pairs
    qualify rank <= 20)"""


def _topk(spark, sf, **options):
    vectors = V.table(spark, sf, "embeddings")
    return R.retrieve_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors, **options)


@query("K1_retrieve_topk", f"with {TOPK} select * from topk")
def k1(spark, sf):
    return _topk(spark, sf)


@query("K1_retrieve_topk_blocks", f"with {TOPK} select * from topk")
def k1_blocks(spark, sf):
    return _topk(spark, sf, block_rows=64, pivots=16)


@query("F8_question_contexts", f"with {TOPK} select query_id, e.label as question_label, rank, topk.vec_id from topk join embeddings e on e.vec_id = query_id")
def f8(spark, sf):
    questions = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("question_label")
    )
    return R.question_contexts(questions, _topk(spark, sf)).select("query_id", "question_label", "rank", "vec_id")


PAIR = "list_transform([0, 1, 2, 3], lambda i: ((query_id * 31 + vec_id * 17 + i * 7) % 101)::double)"


def _pair_scores(topk):
    """Stand-in for the reader model: four option scores per (question, context)."""
    base = F.col("query_id") * 31 + F.col("vec_id") * 17
    return topk.select("query_id", "vec_id", F.array(*[((base + i * 7) % 101).cast("double") for i in range(4)]).alias("scores"))


BEST = f"""{TOPK}, s as (select query_id, rank, {PAIR} as scores from topk),
  u as (select query_id, rank - 1 as context, unnest(scores) as score, unnest([0, 1, 2, 3]) as choice from s),
  b as (select *, row_number() over (partition by query_id order by score desc, context, choice) as rn from u)"""


@query("H10_joint_argmax", f"""with {BEST} select query_id, cast(choice as int) as choice, substr('ABCD', choice + 1, 1) as letter,
  cast(context as int) as context, score from b where rn = 1""")
def h10(spark, sf):
    topk = _topk(spark, sf)
    rows = topk.join(_pair_scores(topk), ["query_id", "vec_id"]).withColumn("rank", F.col("rank") - 1)
    return R.joint_argmax(rows)


@query("K2_answer_with_contexts", f"""with {BEST} select query_id, cast(choice as int) as choice, substr('ABCD', choice + 1, 1) as letter,
  cast(context as int) as context, score from b where rn = 1""")
def k2(spark, sf):
    questions = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    topk = _topk(spark, sf)
    return R.answer_with_contexts(questions, topk, _pair_scores(topk))
