"""Queries of the exam side: scoring, scoreboards, listings, gating, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.functions import labels as L
from gradeframe.functions import text as T
from gradeframe.functions.numeric import pct
from gradeframe.operators import items as I
from gradeframe.operators import metrics as M
from gradeframe.operators import serving as S
from gradeframe.plans import oracle_views as O
from gradeframe.plans import views as V
from gradeframe.plans.registry import query
from gradeframe.session import work_dir
from gradeframe.sources.search import SearchIndex

BANK = """bank as (select concat('q', p_partkey) as question_id, p_name as question,
    concat(p_type, ' A') as option_a, concat(p_type, ' B') as option_b,
    lower(substr('ABCD', cast(p_partkey % 4 as int) + 1, 1)) as correct_answer,
    case when p_size % 17 = 0 then '' else p_brand end as subject, p_type as topic from part)"""

ANSWERS = """answers as (select submission_id, question_id, max(a) as student_answer from (
    select concat('s', l_orderkey) as submission_id,
      concat(case when l_partkey % 9 = 0 then 'x' else 'q' end, l_partkey) as question_id,
      case when l_orderkey % 2 = 0 then ans else lower(ans) end as a
    from (select *, substr('ABCD', cast((l_partkey + case when (l_orderkey + l_linenumber) % 3 = 0 then l_linenumber else 0 end) % 4 as int) + 1, 1)
      as ans from lineitem)) group by 1, 2)"""

MARKED = f"""with {BANK}, {ANSWERS}, marked as (select submission_id, question_id, student_answer, b.correct_answer,
    b.question_id is not null as known, coalesce(upper(b.correct_answer) = upper(student_answer), false) as is_correct
  from answers left join bank b using (question_id))"""


@query("F1_score_answers", f"{MARKED} select submission_id, question_id, student_answer, correct_answer, is_correct from marked where known")
def f1(spark, sf):
    return S.score_answers(V.submission_answers(spark, sf), V.question_bank(spark, sf)).select(
        "submission_id", "question_id", "student_answer", "correct_answer", "is_correct"
    )


@query("F2_score_answers_unknown", f"""{MARKED} select submission_id, question_id, student_answer, correct_answer, is_correct,
  case when not known then 'Question not found' end as error from marked""")
def f2(spark, sf):
    return S.score_answers(V.submission_answers(spark, sf), V.question_bank(spark, sf), unknown="count").select(
        "submission_id", "question_id", "student_answer", "correct_answer", "is_correct", "error"
    )


SCORES = f"""scores as (select submission_id, count(*) filter (where is_correct) as correct, count(*) as total_questions,
    cast(round_even(count(*) filter (where is_correct)::double / count(*) * 100.0::double, 0) as int) as score_percent
  from marked where known group by 1)"""


@query("G15_score_submission", f"{MARKED}, {SCORES} select * from scores")
def g15(spark, sf):
    return S.score_submission(f1(spark, sf))


@query("G15_score_one_decimal", f"""{MARKED} select submission_id, count(*) filter (where is_correct) as correct, count(*) as total_questions,
  {O.r('count(*) filter (where is_correct) * 100.0::double / count(*)', 1)} as score_percent from marked group by 1""")
def g15_decimal(spark, sf):
    return S.score_submission(f2(spark, sf), mode="decimal")


GRADED = """graded as (select concat('s', l_orderkey) as submission_id, concat('q', l_partkey) as question_id,
    concat('because ', l_partkey) as explanation, l_shipdate, l_linenumber, l_extendedprice, l_suppkey, l_orderkey, l_partkey
  from lineitem)"""


@query("F3_merge_explanations", f"""{MARKED}, {GRADED}, g as (select submission_id, question_id, concat('because ', l_suppkey, ' ', l_linenumber) as explanation
    from graded qualify row_number() over (partition by submission_id, question_id order by l_shipdate desc, l_linenumber desc, l_extendedprice desc, l_suppkey desc) = 1)
  select submission_id, question_id, student_answer, is_correct, coalesce(explanation, '') as explanation
  from marked left join g using (submission_id, question_id)""")
def f3(spark, sf):
    # copies of a question come with explanations of their own, the newest counts
    graded = V.model_answers(spark, sf).withColumn("explanation", F.concat(F.lit("because "), "l_suppkey", F.lit(" "), "l_linenumber"))
    marked = f2(spark, sf).select("submission_id", "question_id", "student_answer", "is_correct")
    return S.merge_explanation_rows(marked, graded, F.struct("event_time", "l_linenumber", "l_extendedprice", "l_suppkey"))


MODEL_ROWS = f"""{GRADED}, answered as (
    select submission_id, 'org/alpha' as model, (l_orderkey + l_linenumber) % 8 = 0 as ok from graded where l_partkey % 13 <> 0
    union all select submission_id, 'beta', (l_partkey + l_linenumber) % 3 = 0 from graded where l_partkey % 13 <> 0)"""


def _board(by=""):
    return f"""select {by} model, regexp_replace(model, '^[^/]*/', '') as short_name, count(*) filter (where ok) as correct,
      count(*) as total, cast(round_even(100.0::double * count(*) filter (where ok) / count(*), 0) as int) as accuracy_pct
      from answered group by all"""


@query("G14_model_scoreboard", f"with {MODEL_ROWS} {_board()}")
def g14(spark, sf):
    return S.model_scoreboard(V.model_answers(spark, sf))


@query("H5_scoreboard_with_student", f"""{MARKED}, {SCORES}, {MODEL_ROWS}, board as ({_board('submission_id,')}),
  u as (select submission_id, 'You' as name, score_percent as accuracy_pct, true as is_student, null::bigint as correct, null::bigint as total
      from scores
    union all select submission_id, short_name, accuracy_pct, false, correct, total from board)
  select *, cast(row_number() over (partition by submission_id order by accuracy_pct desc, is_student desc, name) as int) as rank from u""")
def h5(spark, sf):
    board = S.model_scoreboard(V.model_answers(spark, sf), ["submission_id"], sort=False)
    return S.scoreboard_with_student(board, g15(spark, sf))


@query("G21_topics", f"with {BANK} select distinct topic, subject from bank where subject <> ''")
def g21(spark, sf):
    return S.topics(V.question_bank(spark, sf), "subject", ["topic"])


@query("G21_topic_array", f"with {BANK} select topic, list_sort(list(distinct subject)) as topics from bank where subject <> '' group by 1")
def g21_array(spark, sf):
    return S.topic_array(V.question_bank(spark, sf), "subject", ["topic"])


GROUPS = """groups as (select n_nationkey as group_id, n_name as name from nation)"""


def _groups(spark, sf):
    """Exam groups: one per supplier, naming all parts it ships."""
    pairs = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group_id"), F.concat(F.lit("q"), F.col("l_partkey")).alias("question_id"))
    return pairs.groupBy("group_id").agg(F.collect_set("question_id").alias("question_ids"))


@query("F11_group_questions", f"""with {BANK} select question_id, subject from bank where question_id in (select concat('q', l_partkey) from lineitem)""")
def f11(spark, sf):
    return S.group_questions(_groups(spark, sf), V.question_bank(spark, sf)).select("question_id", "subject")


@query("F12_users_with_group", """select c_custkey as user_id, c_name as user_name, n_name as group_name
  from customer left join nation on n_nationkey = case when c_custkey % 7 = 0 then null else c_nationkey end""")
def f12(spark, sf):
    users = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("group_id"),
    )
    groups = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    return S.users_with_group(users, groups).select("user_id", "user_name", "group_name")


@query("B13_short_name", """select distinct regexp_replace(concat(p_brand, '/', p_type, '/', p_name), '^[^/]*/', '') as short_name from part""")
def b13(spark, sf):
    full = F.concat_ws("/", "p_brand", "p_type", "p_name")
    return V.table(spark, sf, "part").select(T.short_name(full).alias("short_name")).distinct()


@query("B14_score_band", f"""{MARKED}, {SCORES} select case when score_percent >= 70 then 'Excellent!' when score_percent >= 50 then 'Good effort'
  else 'Keep studying' end as band, count(*) as n from scores group by 1""")
def b14(spark, sf):
    return g15(spark, sf).groupBy(L.score_band(F.col("score_percent")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("B15_search_questions", f"""with {BANK} select question_id, question, subject from bank
  where contains(lower(question), 'brand#1') or contains(lower(subject), 'brand#1') or contains(lower(topic), 'brand#1')""")
def b15(spark, sf):
    return S.search_questions(V.question_bank(spark, sf), "BRAND#1").select("question_id", "question", "subject")


@query("B15_search_indexed", f"""with {BANK} select question_id, question, subject from bank
  where contains(lower(question), 'brand#23') or contains(lower(subject), 'brand#23') or contains(lower(topic), 'brand#23')""")
def b15_indexed(spark, sf):
    path = work_dir(spark, "bank")
    bank = V.question_bank(spark, sf)
    # files of neighbouring subjects, as a bank that is kept by subject has
    bank.repartitionByRange(F.col("subject")).write.parquet(f"{path}/rows")
    index = SearchIndex(spark, f"{path}/rows", f"{path}/trigrams", bank.schema).build()
    return index.search("Brand#23").select("question_id", "question", "subject")


@query("B16_filter_results", f"{MARKED} select submission_id, question_id, student_answer from marked where not is_correct")
def b16(spark, sf):
    return S.filter_results(f2(spark, sf), "wrong").select("submission_id", "question_id", "student_answer")


@query("B16_result_counts", f"""{MARKED} select submission_id, count(*) as "all", count(*) filter (where is_correct) as correct,
  count(*) filter (where not is_correct) as wrong from marked group by 1""")
def b16_counts(spark, sf):
    return S.result_counts(f2(spark, sf), ["submission_id"])


@query("B17_submission_list", """select concat('s', o_orderkey) as submission_id, o_custkey as user_id, o_orderdate as submitted_at from orders""")
def b17(spark, sf):
    subs = V.table(spark, sf, "orders").select(
        F.concat(F.lit("s"), "o_orderkey").alias("submission_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("submitted_at"), F.array("o_orderpriority").alias("results"),
    )
    return S.submission_list(subs)


@query("B2_missing_fields", f"""with {BANK}, m as (select question_id, list_filter([
    case when coalesce(question, '') = '' then 'question' end, case when coalesce(subject, '') = '' then 'subject' end,
    case when topic = 'PROMO' then 'topic' end, 'author'], lambda x: x is not null) as missing from bank)
  select array_to_string(missing, ',') as missing, count(*) as n from m group by 1""")
def b2(spark, sf):
    bank = V.question_bank(spark, sf).withColumn("topic", F.when(F.col("topic") == "PROMO", "").otherwise(F.col("topic")))
    out = S.missing_fields(bank, ["question", "subject", "topic", "author"])
    return out.groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("A13_export_questions", f"""with {BANK} select question_id as id, question, option_a, option_b, replace(option_a, ' A', ' C') as option_c,
  replace(option_a, ' A', ' D') as option_d, correct_answer, subject, topic, null::varchar as explanation from bank""")
def a13(spark, sf):
    from gradeframe.sources.writers import export_questions

    return export_questions(V.question_bank(spark, sf).withColumnRenamed("question_id", "id"))


# --- label logic over whole tables -------------------------------------------------------


@query("B3_cop_to_letter", """select l_linenumber as cop, case when l_linenumber between 1 and 4 then substr('ABCD', l_linenumber, 1) else 'A' end as letter,
  case when l_linenumber between 1 and 4 then substr('ABCD', l_linenumber, 1) end as letter_or_null, count(*) as n from lineitem group by 1""")
def b3(spark, sf):
    cop = F.col("l_linenumber")
    return V.table(spark, sf, "lineitem").groupBy(
        cop.alias("cop"), L.cop_to_letter(cop).alias("letter"), L.cop_to_letter(cop, None).alias("letter_or_null")
    ).agg(F.count(F.lit(1)).alias("n"))


LABELLED = "(select case when l_partkey % 10 = 0 then null else l_linenumber - 1 end as cop from lineitem)"


@query("B4_B5_label0", f"""select cop, case when cop is null then 0 when cop between 1 and 4 then cop - 1 else cop end as as_zero,
  case when cop is null then -1 when cop between 1 and 4 then cop - 1 else cop end as as_skipped, count(*) as n from {LABELLED} group by 1""")
def b4(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 10 != 0, F.col("l_linenumber") - 1).alias("cop"))
    cop = F.col("cop")
    return rows.groupBy("cop", L.label0(cop).alias("as_zero"), L.label0(cop, -1).alias("as_skipped")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("B6_records_to_mcq", """select l_orderkey, l_linenumber, coalesce(case when l_linenumber > 2 then l_returnflag end, '') as exp,
  l_linestatus as question, 'w' as opa, l_returnflag as opb, 'y' as opc, 'z' as opd, cast(l_partkey % 4 + 1 as int) as cop from lineitem""")
def b6(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("article"),
        F.col("l_linestatus").alias("question"),
        F.array(F.lit("w"), F.col("l_returnflag"), F.lit("y"), F.lit("z")).alias("options"),
        F.lower(V.letter(F.col("l_partkey"))).alias("answer"),
    )
    return I.records_to_mcq(rows)


@query("B7_fill_text", """select doc_id, case when doc_id % 3 = 0 then '' else text end as exp, lang as question from documents""")
def b7(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("exp"), F.col("lang").alias("question")
    )
    return I.fill_text(docs)


@query("B8_infer_subject", f"""select o_orderkey, coalesce(nullif(trim(a, ' \t'), ''), nullif(trim(b, ' \t'), ''), nullif(trim(c, ' \t'), '')) as subject_category
  from (select o_orderkey, case when o_orderkey % 2 = 0 then '  \t' else null end as a,
    case when o_orderkey % 3 = 0 then ' ' || o_orderstatus || '\t' else '' end as b,
    case when o_orderkey % 5 <> 0 then o_orderpriority end as c from orders)""")
def b8(spark, sf):
    k = F.col("o_orderkey")
    rows = V.table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, "  \t").alias("subject_category"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit("\t"))).otherwise("").alias("category"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("topic"),
    )
    return I.with_subject(rows).select("o_orderkey", "subject_category")


@query("B9_B11_score_rows", f"""with {O.PREDICTIONS} select eval_split_name, model_key, count(*) filter (where correct) as correct,
  count(gold_answer) as golds, {O.r(O.total('tokens_per_sec'), 2)} as tps from predictions group by 1, 2""")
def b9(spark, sf):
    raw = V.predictions(spark, sf).withColumn("answer", F.concat(F.lit(" "), F.lower("gold_answer"), F.lit("\n"))).drop(
        "gold_answer", "correct", "tokens_per_sec"
    )
    scored = M.score_rows(raw)
    return scored.groupBy("eval_split_name", "model_key").agg(
        F.count_if("correct").alias("correct"), F.count("gold_answer").alias("golds"),
        M.round_even(M.total(F.col("tokens_per_sec")), 2).alias("tps"),
    )


@query("B10_is_correct", f"""with {O.PREDICTIONS} select model_key, count(*) filter (where coalesce(pred_answer = coalesce(gold_answer, 'A'), false)) as correct
  from predictions group by 1""")
def b10(spark, sf):
    gold = F.coalesce("gold_answer", F.lit("A"))
    return V.predictions(spark, sf).groupBy("model_key").agg(
        F.count_if(L.is_correct(F.col("pred_answer"), gold)).alias("correct")
    )


@query("B12_pct", f"select l_orderkey, l_linenumber, l_discount, {O.r('l_discount * 100.0::double', 1)} as pct from lineitem")
def b12(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", pct(F.col("l_discount"), 1).alias("pct")
    )


@query("B19_text_only", "select p_partkey from part where p_size % 5 <> 0")
def b19(spark, sf):
    size = F.col("p_size")
    images = F.when(size % 5 == 0, F.array("p_name")).when(size % 5 == 1, F.array().cast("array<string>"))
    return I.text_only(V.table(spark, sf, "part").withColumn("images", images)).select("p_partkey")


@query("B20_ellipsize", r"""select doc_id, case when length(text) > 400 then substr(text, 1, 397) || '...' else text end as cut,
  case when length(text) > 120 then (case when contains(substr(text, 1, 120), ' ') then regexp_replace(substr(text, 1, 120), '(?s) [^ ]*\z', '')
    else substr(text, 1, 120) end) || '...' else text end as cut_words from documents""")
def b20(spark, sf):
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", T.ellipsize(text, 400).alias("cut"), T.ellipsize_words(text).alias("cut_words")
    )


@query("B21_with_model_spec", f"""with {O.PREDICTIONS}, m as (select distinct model_key, model_display_name from predictions)
  select model_key, model_display_name as display_name, case when model_key < 'model_4' then concat(4 + cast(right(model_key, 1) as int), 'B') else '?' end as param_count,
    case when model_key = 'model_4' then '?' when cast(right(model_key, 1) as int) % 2 = 0 then 'Q4_K_M' else 'BF16' end as quantization
  from (select model_key, case when model_key < 'model_4' then model_display_name else model_key end as model_display_name from m)""")
def b21(spark, sf):
    return M.with_model_spec(V.predictions(spark, sf).select("model_key").distinct(), V.model_specs(spark))


@query("B22_speed_labels", f"""with {O.PREDICTIONS} select distinct model_display_name,
  case when model_display_name like '%LoRA%' then 'BF16' when model_display_name like '%Q4_K_M%' then 'Q4_K_M' else 'q4_0' end as precision,
  case when eval_split_name like '%DGX8%' then 'DGX8 GB10' else 'MacBook Pro (MPS/CPU)' end as hardware from predictions""")
def b22(spark, sf):
    return V.predictions(spark, sf).select(
        "model_display_name", L.precision_label(F.col("model_display_name")).alias("precision"),
        L.hardware_label(F.col("eval_split_name")).alias("hardware"),
    ).distinct()
