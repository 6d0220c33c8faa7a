"""Search index, buckets, incremental summaries, readers of documents and result files."""

import json

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import consolidate as J
from gradeframe.operators import incremental as I
from gradeframe.operators import maintenance as U
from gradeframe.operators import metrics as M
from gradeframe.operators import serving as S
from gradeframe.sources import readers as R
from gradeframe.sources.buckets import write_bucketed
from gradeframe.sources.search import SearchIndex
from gradeframe.streaming import flows


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


BANK = "question_id string, question string, subject string, topic string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bank"))
    words = ["Heart", "LIVER", "kidney", "Straße", "eye", "Über Zahn"]
    rows = [(f"q{i}", f"about {words[i % 6]} {i}", words[i % 6] if i % 4 else None, "" if i % 5 else None) for i in range(300)]
    bank = spark.createDataFrame(rows, BANK)
    bank.repartitionByRange(6, F.col("subject"), "question").write.parquet(f"{root}/rows")
    return SearchIndex(spark, f"{root}/rows", f"{root}/grams", bank.schema).build()


@pytest.mark.parametrize("text", ["heart", "LIVER", "kidney 2", "straße", "über", "ey", "a", "", "no such text", "about", "(", "Zahn 1"])
def test_indexed_search_finds_the_same_rows(spark, index, text):
    every = S.search_questions(spark.read.schema(BANK).parquet(index.table), text)
    assert sorted(map(tuple, index.search(text).collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)


def test_search_reads_fewer_files(spark, index):
    whole = spark.read.parquet(index.table).inputFiles()
    found = index.files("Straße")
    assert 0 < len(found) < len(whole) and index.files("no such text") == [] and index.files("ey") is None
    assert len(index.search("Straße").inputFiles()) == len(found)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    rows = spark.range(3000).select(
        F.concat(F.lit("q"), F.col("id") % 700).alias("question_id"), (F.col("id") % 5).cast("string").alias("model_key"), F.col("id").alias("run_seq")
    )
    big = write_bucketed(rows, str(tmp_path / "a"), ["question_id"], 4)
    done = write_bucketed(rows.where("run_seq % 3 = 0"), str(tmp_path / "b"), ["question_id"], 4)
    pending = U.pending_questions(big, done)
    latest = U.newest(big, ["question_id", "model_key"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(U.pending_questions(big, done)) and "Exchange" not in plan_of(latest)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = rows.join(rows.where("run_seq % 3 = 0").select("question_id").distinct(), "question_id", "left_anti")
    assert sorted(map(tuple, pending.select("run_seq").collect())) == sorted(map(tuple, plain.select("run_seq").collect()))
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, U.newest(rows, ["question_id", "model_key"]).collect()))


PRED = (
    "experiment_tag string, eval_split_name string, model_key string, model_display_name string, question_id string, gold_answer string, "
    "pred_answer string, correct boolean, latency_s double, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
    "tokens_per_sec double, run_seq bigint"
)


def predictions(spark, n, start=0):
    i = F.col("id") + start
    def letter(k):
        return F.substring(F.lit("ABCD"), (k % 4).cast("int") + 1, 1)
    return spark.range(n).select(
        F.lit("t").alias("experiment_tag"), F.concat(F.lit("s"), i % 3).alias("eval_split_name"), F.concat(F.lit("m"), i % 2).alias("model_key"),
        F.concat(F.lit("M"), i % 2).alias("model_display_name"), F.concat(F.lit("q"), i).alias("question_id"),
        letter(i).alias("gold_answer"), F.when(i % 7 != 0, letter(i + F.when(i % 5 == 0, 1).otherwise(0))).alias("pred_answer"),
        (i % 7 != 0).__and__(i % 5 != 0).alias("correct"), (F.pmod(i * 7919, F.lit(10007)) / 13.0).alias("latency_s"),
        F.when(i % 2 == 0, i).alias("prompt_tokens"), F.when(i % 2 == 0, i * 2).alias("completion_tokens"), F.when(i % 2 == 0, i * 3).alias("total_tokens"),
        F.when(i % 2 == 0, i / 7.0).alias("tokens_per_sec"), i.alias("run_seq"),
    )


EXACT = ["n_questions", "n_correct", "accuracy", "invalid_prediction_rate", "mean_latency_s", "mean_total_tokens", "mean_tokens_per_sec", "macro_f1"]


def test_incremental_summary_equals_a_full_run(spark, tmp_path):
    table = flows.prediction_table(spark, str(tmp_path / "p"), predictions(spark, 1).schema)
    states = flows.prediction_table(spark, str(tmp_path / "s"), I.summary_state(predictions(spark, 1)).schema)
    touched = flows.upsert_batch(table, predictions(spark, 9000), "b", 0)
    assert I.renew(states, table, "b", 0, touched)
    # a second batch with rows of one split and model only
    more = predictions(spark, 600, 6).where("eval_split_name = 's1' AND model_key = 'm1'").withColumn("run_seq", F.col("run_seq") + 10**6).withColumn("correct", F.lit(True))
    others = states.files([(f"s{i}", f"m{j}") for i in range(3) for j in range(2) if (i, j) != (1, 1)])
    touched = flows.upsert_batch(table, more, "b", 1)
    assert touched == [("s1", "m1")] and I.renew(states, table, "b", 1, touched)
    assert not I.renew(states, table, "b", 1, touched)
    assert set(others) <= set(states.files())
    got = {(r.eval_split_name, r.model_key): r for r in I.summary_of(states.read()).collect()}
    rows = table.read().drop("version")
    full = {(r.eval_split_name, r.model_key): r for r in M.summary_by_split(rows, list(I.KEYS)).collect()}
    assert got.keys() == full.keys() and len(got) == 6
    for key, r in full.items():
        assert [got[key][c] for c in EXACT] == [pytest.approx(r[c]) for c in EXACT]
        assert (got[key].median_tokens_per_sec is None) == (r.median_tokens_per_sec is None)
    # quantiles: the stated error of the sketch, measured in ranks
    for key, r in got.items():
        part = [x.latency_s for x in rows.where((F.col("eval_split_name") == key[0]) & (F.col("model_key") == key[1])).select("latency_s").collect()]
        for p, value in ((0.5, r.median_latency_s), (0.9, r.p90_latency_s)):
            assert abs(sum(x <= value for x in part) / len(part) - p) < 0.02
    # per model, from the same states
    by_model = {r.model_key: r for r in I.summary_of(I.merge_states(states.read(), ["model_key"]), ["model_key"]).collect()}
    assert {m: r.n_questions for m, r in by_model.items()} == {r.model_key: r["count"] for r in rows.groupBy("model_key").count().collect()}


def test_documents_of_any_shape(spark, tmp_path):
    share = {"A & B": 0.5, "Ü": 0.25}
    shapes = {
        "plain": {"per_subject_accuracy": {k: {"accuracy": v, "n": 4} for k, v in share.items()}, "other": {"x": [1]}},
        "bare": {"subject_accuracy": share},
        "listed": {"per_subject": [{"subject_name": k, "acc": v, "count": 4} for k, v in share.items()] + [{"subject": "none"}, 7, None]},
        "empty": {}, "array": [1, 2], "null": None,
    }
    for n, (run, doc) in enumerate(shapes.items()):
        put(tmp_path / "d" / ("deep/" * n) / f"{run}_metrics.json", json.dumps(doc, indent=1))
    put(tmp_path / "d" / "broken_metrics.json", "{")
    docs = R.read_metrics_documents(spark, str(tmp_path / "d"))
    assert docs.count() == 7
    rows = sorted((r.model, r.subject, r.accuracy_pct, r.n) for r in J.per_subject_of_documents(docs).collect() if r.subject is not None)
    expected = [(run, k, v * 100, None if run == "bare" else 4) for run in ("bare", "listed", "plain") for k, v in share.items()]
    assert rows == sorted(expected)
    assert J.per_subject_of_documents(R.read_metrics_documents(spark, str(tmp_path / "none"))).collect() == []


def test_metrics_by_file_at_any_depth(spark, tmp_path):
    for name, value in (("a/x_metrics.json", 0.5), ("a/b/y z_metrics.json", 0.25), ("c_metrics.json", 0.75), ("a/other.json", 0.1)):
        put(tmp_path / "r" / name, json.dumps({"overall_accuracy": value}))
    rows = R.read_run_metrics(spark, str(tmp_path / "r"), by_file=True).collect()
    assert sorted((r.run, r.overall_accuracy) for r in rows) == [("c", 0.75), ("x", 0.5), ("y z", 0.25)]


def test_result_files_of_all_model_folders(spark, tmp_path):
    put(tmp_path / "m" / "one" / "dev_results.csv", "id,subject_name,cop,predictions\n1,S,1,1\n2,S,2,1\n3,,1,1\n")
    put(tmp_path / "m" / "one" / "test_results.csv", "predictions,cop,subject_name,exp\n1,1,\"S, T\",\"two\nlines\"\n")
    put(tmp_path / "m" / "two" / "dev_results.csv", "id,subject_name,cop,predictions\n1,S,1,x\n")
    put(tmp_path / "m" / "three" / "other.csv", "id\n1\n")
    rows = M.subject_accuracy(R.read_result_files(spark, str(tmp_path / "m")), by=["model", "file_type"]).collect()
    assert sorted(map(tuple, rows)) == [("one", "dev", "S", 0.5), ("one", "test", "S, T", 1.0), ("two", "dev", "S", 0.0)]
    assert R.read_result_files(spark, str(tmp_path / "absent")).collect() == []


def test_topics_are_not_sorted_as_a_whole(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", ""), ("a", "x")], "topic string, subject string")
    assert "rangepartitioning" not in plan_of(S.topic_array(df, "subject", ["topic"]))
    assert [tuple(r) for r in S.topic_array(df, "subject", ["topic"]).collect()] == [("a", ["x", "y"])]
