"""Queries that write derived tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import chat as E
from gradeframe.operators import consolidate as J
from gradeframe.operators import items as I
from gradeframe.operators import metrics as M
from gradeframe.plans import oracle_views as O
from gradeframe.plans import views as V
from gradeframe.plans.registry import query
from gradeframe.plans.summaries import RUNS, WITH, _run_rows
from gradeframe.plans.texts import ITEMS, _items
from gradeframe.plans.upkeep import STATES
from gradeframe.plans.vectors import SELECTOR
from gradeframe.session import work_dir
from gradeframe.sources.blobs import write_text
from gradeframe.sources import readers as R
from gradeframe.sources import writers as A

ITEM_ROWS = f"""with {ITEMS} select cast(id as varchar) as id, question, opa, opb, opc, case when id % 5 <> 0 then 'none' end as opd,
  cast(cop as int) as cop, raw_exp as exp, case when id % 4 <> 0 then source end as subject_name, lang as topic_name from items"""
COLUMNS = ["id", "question", "opa", "opb", "opc", "opd", "cop", "exp", "subject_name", "topic_name"]


def _mcq(spark, sf):
    return _items(spark, sf).withColumn("id", F.col("id").cast("string")).withColumn("choice_type", F.lit("single")).select(
        "id", "question", "opa", "opb", "opc", "opd", "cop", "choice_type", "exp", "subject_name", "topic_name"
    )


@query("A1_A10_jsonl_round_trip", ITEM_ROWS)
def a1(spark, sf):
    path = work_dir(spark, "items")
    A.write_jsonl(_mcq(spark, sf), path)
    return R.read_mcq(spark, path).select(*COLUMNS)


@query("A1_mixed_folder", ITEM_ROWS)
def a1_mixed(spark, sf):
    # one folder with files of JSON lines and files of one JSON array
    path = work_dir(spark, "items")
    rows = _mcq(spark, sf)
    some = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    A.write_jsonl(rows.where(~some), path)
    # an array per few items, its first line an opening bracket alone
    group = F.pmod(F.xxhash64("id"), F.lit(39))
    arrays = rows.where(some).groupBy(group).agg(F.collect_list(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("items"))
    lines = arrays.select(F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]")).alias("value"), F.col("items")[0].alias("file"))
    lines.withColumn("file", F.md5("file")).write.mode("append").partitionBy("file").text(path + "/arrays")
    return R.read_mcq(spark, f"{path}/{{part-*,arrays/*}}").select(*COLUMNS)


@query("A2_csv_round_trip", ITEM_ROWS)
def a2(spark, sf):
    path = work_dir(spark, "items") + ".csv"
    rows = _mcq(spark, sf)
    rows.write.option("header", "true").option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return R.read_mcq(spark, path).select(*COLUMNS)


@query("B1_require_keys", """select cast(count(*) filter (where doc_id % 4 <> 0) as bigint) as kept, count(*) filter (where doc_id % 4 = 0) as dropped from documents""")
def b1(spark, sf):
    items = _mcq(spark, sf)
    with_nulls = F.to_json(F.struct("question", "opa", "opb", "opc", "opd", "cop"), {"ignoreNullFields": "false"})
    without_key = F.to_json(F.struct("question", "opa", "opb", "opc", "cop"))
    raw = items.select(F.when(F.col("id").cast("bigint") % 4 == 0, without_key).otherwise(with_nulls).alias("value"))
    return I.key_report(raw)


@query("A5_read_predictions", f"""{WITH} select eval_split_name, model_key, count(*) as n, count(pred_answer) as answered,
  cast(sum(prompt_tokens) as bigint) as prompt_tokens, {O.r(O.total('latency_s'), 4)} as latency, count(*) filter (where correct) as correct
  from predictions group by 1, 2""")
def a5(spark, sf):
    # three column sets below one folder: another order, a column less, a column that is not known
    path, missing = work_dir(spark, "predictions"), work_dir(spark, "missing")
    columns = ["eval_split_name", "model_key", "question_id", "pred_answer", "correct", "latency_s", "prompt_tokens"]
    rows = V.predictions(spark, sf).select(*columns, F.lit("x").alias("unknown"))
    kind = F.col("model_key").isin("model_0", "model_1").cast("int") + (F.col("model_key") == "model_4").cast("int") * 2
    for n, some in enumerate((columns, columns[::-1], ["unknown", *[c for c in columns if c != "prompt_tokens"]])):
        rows.where(kind == n).select(*some).write.option("header", "true").csv(f"{path}/set{n}")
    back = R.read_predictions(spark, [f"{path}/*", missing])
    return back.groupBy("eval_split_name", "model_key").agg(
        F.count(F.lit(1)).alias("n"), F.count("pred_answer").alias("answered"), F.sum("prompt_tokens").alias("prompt_tokens"),
        M.round_even(M.total(F.col("latency_s")), 4).alias("latency"), F.count_if("correct").alias("correct"),
    )


@query("A8_read_question_bank", """select concat('q', p_partkey) as question_id, p_name as question, p_type as topic from part""")
def a8(spark, sf):
    path = work_dir(spark, "bank")
    bank = V.question_bank(spark, sf)
    columns = [c for c in bank.columns if c != "created_at"]
    bank.select(*columns, "created_at").write.parquet(path)
    return R.read_question_bank(spark, path).select("question_id", "question", "topic")


@query("A9_union_parts", f"""{WITH} select question_id, model_key, latency_s, null::varchar as finish_reason from predictions where correct
  union all select question_id, null, null, finish_reason from predictions where not correct""")
def a9(spark, sf):
    rows = V.predictions(spark, sf)
    return J.union_parts([
        rows.where("correct").select("question_id", "model_key", "latency_s"),
        rows.where("not correct").select("question_id", "finish_reason"),
    ])


@query("A11_export_tables", f"{WITH} select model_key, count(*) as n from predictions group by 1")
def a11(spark, sf):
    path = work_dir(spark, "export")
    counts = V.predictions(spark, sf).groupBy("model_key").agg(F.count(F.lit(1)).alias("n"))
    written = A.export_tables({"counts": counts, "empty": counts.where("n < 0")}, path)
    return spark.read.schema("model_key string, n bigint").option("header", "true").csv([f"{path}/{x}" for x in written])


@query("A12_write_predictions", f"""{WITH} select eval_split_name, model_key, question_id, pred_answer, latency_s from predictions""")
def a12(spark, sf):
    path = work_dir(spark, "table")
    rows = V.predictions(spark, sf)
    A.write_predictions(rows.where("correct"), path)
    # partitions that are there are replaced as a whole, and all are read back
    A.write_predictions(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("eval_split_name", "model_key", "question_id", "pred_answer", "latency_s")


@query("A14_submission_file", f"""with {SELECTOR} select id, cast(predicted_index + 1 as int) as "Prediction (correct option)" from selector""")
def a14(spark, sf):
    return A.submission_file(M.with_selection(V.selector_output(spark, sf)))


@query("E1_chat_file", """select count(*) as n, cast(sum(length(text)) as bigint) as chars, 3 * count(*) as messages from documents""")
def e1_file(spark, sf):
    path = work_dir(spark, "chat")
    samples = E.to_chat(_items(spark, sf))
    A.write_jsonl(samples, path)
    back = spark.read.schema(samples.schema).json(path)
    question = F.regexp_extract(F.col("messages")[1]["content"], r"(?s)^Question: (.*)\nImage Description: \[not used", 1)
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(question)).alias("chars"),
        F.sum(F.size("messages")).cast("bigint").alias("messages"),
    )


@query("A4_read_exam_samples", """select concat(p_brand, ' ', p_type) as id, cast(count(*) as varchar) as question, p_type as a,
  case when p_brand < 'Brand#2' then 'given' else 'split_x' end as eval_split_name, p_brand as subject_category from part group by all""")
def a4(spark, sf):
    path = work_dir(spark, "samples")
    samples = V.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat_ws(" ", "p_brand", "p_type").alias("folder"), F.concat_ws(" ", "p_brand", "p_type").alias("id"),
        F.col("n").cast("string").alias("question"), F.create_map(F.lit("A"), "p_type").alias("choices"),
        F.when(F.col("p_brand") < "Brand#2", "given").otherwise("").alias("test_set"),
        F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("section"),
    )
    # one document per file
    samples.write.partitionBy("folder").json(path)
    back = R.read_exam_samples(spark, path, "split_x", recursive=True)
    return back.select("id", "question", F.col("choices")["A"].alias("a"), "eval_split_name", "subject_category")


@query("A6_read_run_metrics", f"""{RUNS}, w as (select run, count(*) as n_subjects from s group by 1)
  select concat('run=', run) as run, overall_accuracy, total_samples, correct, n_subjects from runs join w using (run)""")
def a6(spark, sf):
    path = work_dir(spark, "runs")
    M.run_metrics(_run_rows(spark, sf)).write.partitionBy("run").json(path)
    back = R.read_run_metrics(spark, path, "*.json")
    return back.select(
        "run", "overall_accuracy", "total_samples", "correct",
        F.size("per_subject_accuracy").cast("bigint").alias("n_subjects"),
    )


@query("A6_run_metrics_by_file", f"""{RUNS} select run, overall_accuracy, total_samples, correct from runs""")
def a6_by_file(spark, sf):
    path = work_dir(spark, "runs")
    docs = M.run_metrics(_run_rows(spark, sf)).select("run", F.to_json(F.struct("overall_accuracy", "total_samples", "correct")).alias("value"))
    _put_documents(docs, path)
    return R.read_run_metrics(spark, path, by_file=True).select("run", "overall_accuracy", "total_samples", "correct")


def _put_documents(docs, path):
    """Write (run, value) rows as files <run>_metrics.json in folders of several depths, each by the task that has it."""
    def put(batches):
        for batch in batches:
            for run, value in zip(batch["run"], batch["value"], strict=True):
                write_text(f"{path}/{run[-1]}/deeper/{run}_metrics.json", value)
            yield batch[["run"]]

    docs.mapInPandas(put, "run string").write.format("noop").mode("overwrite").save()


@query("L5_documents_of_any_shape", f"""{RUNS}
  select run as model, subject, {O.r('acc * 100', 2)} as accuracy_pct, n from s""")
def l5_documents(spark, sf):
    path = work_dir(spark, "documents")
    runs = M.run_metrics(_run_rows(spark, sf))
    entries = F.map_entries("per_subject_accuracy")
    listed = F.transform(entries, lambda e: F.struct(e["key"].alias("subject_name"), e["value"]["accuracy"].alias("acc"), e["value"]["n"].alias("count")))
    short = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.struct(e["value"]["accuracy"].alias("acc"), e["value"]["n"].alias("total")))))
    shape = F.substring("run", -1, 1).cast("int") % 3
    value = (
        F.when(shape == 0, F.to_json(F.struct("overall_accuracy", "per_subject_accuracy")))
        .when(shape == 1, F.to_json(F.struct(F.lit("extra").alias("note"), listed.alias("per_subject"))))
        .otherwise(F.to_json(F.struct(short.alias("subject_accuracy"), F.array(F.lit(1)).alias("history"))))
    )
    _put_documents(runs.select("run", value.alias("value")), path)
    return J.per_subject_of_documents(R.read_metrics_documents(spark, path))


@query("G7_subject_accuracy_folders", f"""with {SELECTOR} select concat('m', l_partkey % 3) as model,
    case when l_orderkey % 2 = 0 then 'dev' else 'test' end as file_type, subject_name,
    cast(count(*) filter (where cop = predictions) as double) / count(*) as acc
  from selector where subject_name is not null and (l_partkey % 3 <> 2 or l_orderkey % 2 = 0) group by 1, 2, 3""")
def g7_folders(spark, sf):
    path = work_dir(spark, "models")
    key, order = F.split("id", "-")[0].cast("bigint"), F.col("order")
    rows = V.selector_output(spark, sf).select("id", "subject_name", "cop", "predictions", "part").withColumn("order", key)
    for model in range(3):
        for name, rest in (("dev", 0), ("test", 1)):
            if (model, rest) != (2, 1):  # one model has no test file
                part = rows.where((F.col("part") % 3 == model) & (order % 2 == rest)).drop("part", "order")
                columns = ["predictions", "subject_name", "cop", "id"] if model == 1 else ["id", "subject_name", "cop", "predictions"]
                part.select(*columns).write.option("header", "true").csv(f"{path}/m{model}/{name}_results.csv")
    return M.subject_accuracy(R.read_result_files(spark, path), by=["model", "file_type"])


@query("A7_read_trainer_state", f"""{STATES}, c as (select l_suppkey % 10 as r, l_linenumber * 100 as step, count(*) as n from lineitem group by 1, 2)
  select concat('run=', r) as run, 'step=checkpoint-700' as checkpoint, cast(700 as bigint) as global_step, n as max_steps from c where step = 700""")
def a7(spark, sf):
    path = work_dir(spark, "checkpoints")
    step = (F.col("l_linenumber") * 100).cast("bigint")
    states = V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("run"), step.alias("global_step")).agg(
        F.count(F.lit(1)).alias("max_steps")
    )
    states.withColumn("step", F.concat(F.lit("checkpoint-"), "global_step")).write.partitionBy("run", "step").json(path)
    return R.read_trainer_state(spark, path, pattern="*.json").select("run", "checkpoint", "global_step", "max_steps")
