"""Ranking, upkeep, serving, retrieval and decisions on small tables and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.functions import options as P
from gradeframe.operators import consolidate as J
from gradeframe.operators import hybrid as N
from gradeframe.operators import items as I
from gradeframe.operators import maintenance as U
from gradeframe.operators import ranking as H
from gradeframe.operators import retrieval as R
from gradeframe.operators import serving as S
from gradeframe.streaming import changes as M5


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranking ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one stratum, a null stratum, many small ones."""
    return spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 0, None)
        .otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("g"),
    )


@pytest.mark.parametrize("n", [50, 1500])
def test_stratified_cap_size_and_determinism(skewed, n):
    sizes = {r.g: r["count"] for r in skewed.groupBy("g").count().collect()}
    picks = [
        {r.id for r in H.stratified_cap(skewed.repartition(p), ["g"], n, seed=3).collect()} for p in (2, 9)
    ]
    assert picks[0] == picks[1]
    got = {r.g: r["count"] for r in H.stratified_cap(skewed, ["g"], n, seed=3).groupBy("g").count().collect()}
    assert got == {g: min(c, n) for g, c in sizes.items()}
    assert picks[0] != {r.id for r in H.stratified_cap(skewed, ["g"], n, seed=4).collect()}


def test_large_cap_equals_ranking_by_hash(skewed):
    key = {r.id: r.h for r in skewed.select("id", H.sample_key(skewed, ["id"], 3).alias("h")).collect()}
    hot = sorted((r.id for r in skewed.where("g = 'hot'").collect()), key=lambda i: (key[i], i))
    got = {r.id for r in H.stratified_cap(skewed, ["g"], 1500, seed=3).where("g = 'hot'").collect()}
    assert got == set(hot[:1500])


def test_a_stratum_is_ranked_slice_by_slice(skewed):
    plan = physical(H.stratified_cap(skewed, ["g"], 50))
    ranking = next(x for x in plan.splitlines() if "row_number()" in x and "Window" in x)
    assert "__b" in ranking.split("], [")[1]


def test_early_stop_and_best_epoch(spark):
    acc = [0.2, 0.5, 0.4, 0.5, 0.45, 0.9]
    df = spark.createDataFrame([("r", i, a, 1.0) for i, a in enumerate(acc)], "run string, epoch int, val_acc double, time_s double")
    out = H.early_stop(df, 3).orderBy("epoch").collect()
    assert [r.patience_counter for r in out][:5] == [0, 0, 1, 2, 3]
    assert [r.reached for r in out] == [True] * 5 + [False]
    best = H.best_epoch(df, 3).first()
    assert (best.best_epoch, best.best_metric, best.last_epoch, best.stopped_early, best.total_time_s) == (1, 0.5, 4, True, 5.0)


def test_select_model_margin(spark):
    df = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.6, 0.4), ("c", 0.7, 0.41)], "run string, overall_acc double, macro_avg_acc double")
    out = H.select_model(df).collect()
    assert [(r.run, r.rank, r.selected, r.margin) for r in out] == [("c", 1, True, 0.01), ("b", 2, False, 0.0), ("a", 3, False, None)]


def test_training_status_last_and_best_differ(spark):
    log = [(1, 0.1, 2.0, 1e-4, None), (2, 0.2, None, None, 0.9), (3, 0.3, 1.5, 1e-5, None), (4, 0.4, None, None, 1.1)]
    schema = "run string, max_steps bigint, num_train_epochs int, log_history array<struct<step:bigint,epoch:double,loss:double,learning_rate:double,eval_loss:double>>"
    out = {r.run: r for r in H.training_status(spark.createDataFrame([("r", 10, 1, log), ("empty", 5, 1, [])], schema)).collect()}
    r = out["r"]
    assert (r.step, r.train_loss, r.last_eval_loss, r.best_eval_loss, r.best_eval_step) == (3, 1.5, 1.1, 0.9, 2)
    assert out["empty"].step is None


# --- upkeep -------------------------------------------------------------------------------

PRED = "experiment_tag string, eval_split_name string, model_key string, question_id string, run_seq bigint, v string"


def test_upsert_is_idempotent_and_ignores_order(spark):
    old = spark.createDataFrame([("t", "s", "m", "q1", 1, "old"), ("t", "s", "m", "q2", 1, "keep"), (None, "s", "m", "q1", 1, "null key")], PRED)
    new = spark.createDataFrame([("t", "s", "m", "q1", 2, "new")], PRED)
    once = U.upsert(old, new)
    expected = sorted([("q1", "new"), ("q2", "keep"), ("q1", "null key")])
    for table in (once, U.upsert(new, old), U.upsert(once, new)):
        assert sorted((r.question_id, r.v) for r in table.collect()) == expected
    assert "WindowGroupLimit" in physical(once)


def test_merge_batch_keeps_the_newer_row_and_broadcasts_the_batch(spark, tmp_path):
    old = spark.createDataFrame([("t", "s", "m", "q1", 5, "old"), ("t", "s", "m", "q2", 1, "keep"), (None, "s", "m", "q3", 1, "null")], PRED)
    new = spark.createDataFrame([("t", "s", "m", "q1", 4, "late"), ("t", "s", "m", "q2", 1, "equal"), (None, "s", "m", "q3", 2, "new"), ("t", "s", "m", "q4", 0, "in")], PRED)
    out = sorted((r.question_id, r.v) for r in U.merge_batch(old, new).collect())
    assert out == [("q1", "old"), ("q2", "equal"), ("q3", "new"), ("q4", "in")]
    tables = []
    for name, df in (("old", old), ("new", new)):
        df.write.parquet(str(tmp_path / name))
        tables.append(spark.read.schema(PRED).parquet(str(tmp_path / name)))
    plan = physical(U.merge_batch(*tables))
    # both scans of the table join the batch's keys without a shuffle
    assert plan.count("BroadcastHashJoin") >= 2


def test_upsert_table_replaces_only_touched_partitions(spark, tmp_path):
    from gradeframe.sources.writers import upsert_table

    path = str(tmp_path / "t")
    upsert_table(spark.createDataFrame([("t", "s1", "m", "q1", 1, "a"), ("t", "s2", "m", "q1", 1, "b")], PRED), path)
    before = {p.name for p in (tmp_path / "t" / "eval_split_name=s2").rglob("*.parquet")}
    upsert_table(spark.createDataFrame([("t", "s1", "m", "q1", 2, "c"), ("t", "s1", "m", "q2", 1, "d")], PRED), path)
    assert {p.name for p in (tmp_path / "t" / "eval_split_name=s2").rglob("*.parquet")} == before
    rows = spark.read.schema(PRED).parquet(path).collect()
    assert sorted((r.eval_split_name, r.question_id, r.v) for r in rows) == [("s1", "q1", "c"), ("s1", "q2", "d"), ("s2", "q1", "b")]


def test_pending_and_done_partition_the_samples(spark):
    samples = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "question_id string")
    done = spark.createDataFrame([("q1",), ("q1",), (None,)], "question_id string")
    pending = {r[0] for r in U.pending_questions(samples, done).collect()}
    assert pending == {"q2", "q3"}


def test_pending_combos(spark):
    preds = spark.createDataFrame([("s1", "m1")] * 3 + [("s2", "m1")] * 2 + [(None, "m1")] * 9, "eval_split_name string, model_key string")
    out = {tuple(r) for r in U.pending_combos(preds.where("eval_split_name is not null"), ["m1", "m2"], preds, 3).collect()}
    assert out == {("s2", "m1"), ("s1", "m2"), ("s2", "m2")}


def test_resolve_models_first_position_wins(spark):
    served = spark.createDataFrame([(2, "org/Qwen3.5-9B.gguf"), (1, "x/qwen3_5-9b-lora"), (0, "other")], "position int, id string")
    out = {r.model_key: r.server_model_id for r in U.resolve_models(served, {"a": ["qwen3", "5", "9B"], "none": ["zz"]}).collect()}
    assert out == {"a": "x/qwen3_5-9b-lora"}
    assert "Cartesian" not in physical(U.resolve_models(served, {"a": ["q"]})) and "NestedLoop" not in physical(U.resolve_models(served, {"a": ["q"]}))


def test_union_and_summary(spark):
    a = spark.createDataFrame([("m", "M", 0.5, 0.1, 0.45, 10)], "model_key string, model_display_name string, mean_accuracy double, std_accuracy double, mean_macro_f1 double, total_questions bigint")
    runs = spark.createDataFrame([("r", 0.4242, 0.4, 7, 3)], "run string, overall_accuracy double, macro_averaged_accuracy double, total_samples bigint, correct bigint")
    out = J.consolidated_summary({"direct": a}, J.run_summary(runs), "tests", "dev", "run").collect()
    assert [(r.model, r.accuracy_pct, r.std_pct, r.n_questions) for r in out] == [("r", 42.42, None, 7), ("M", 50.0, 10.0, 10)]


# --- serving ------------------------------------------------------------------------------


def test_two_totals(spark):
    bank = spark.createDataFrame([("q1", "a"), ("q2", "B")], "question_id string, correct_answer string")
    subs = spark.createDataFrame([("s", {"q1": "A", "q2": "c", "qx": "A"}), ("empty", {})], "submission_id string, answers map<string,string>")
    skip = {r.submission_id: r for r in S.score_maps(subs, bank).collect()}
    assert (skip["s"].correct, skip["s"].total_questions, skip["s"].score_percent) == (1, 2, 50)
    assert (skip["empty"].total_questions, skip["empty"].score_percent) == (0, 0)
    count = {r.submission_id: r for r in S.score_maps(subs, bank, "count", "decimal").collect()}
    assert (count["s"].total_questions, count["s"].score_percent) == (3, 33.3)


def test_merge_explanations_keeps_order(spark):
    subs = spark.createDataFrame(
        [("s", "u", [("q2", True, None), ("q1", False, None)]), ("none", "u", [])],
        "submission_id string, user_id string, results array<struct<question_id:string,is_correct:boolean,explanation:string>>",
    )
    graded = spark.createDataFrame([("s", "q2", "old", 1), ("s", "q2", "new", 2)], "submission_id string, question_id string, explanation string, event_time int")
    out = {r.submission_id: r for r in S.merge_explanations(subs, graded).collect()}
    assert [(x.question_id, x.is_correct, x.explanation) for x in out["s"].results] == [("q2", True, "new"), ("q1", False, "")]
    assert out["none"].results == [] and out["none"].user_id == "u"


def test_scoreboard_half_even_and_order(spark):
    def event(i):
        return ("s", [("o/x", i == 0), ("y", i < 3), ("", True)]) if i else ("s", [("o/x", True), ("y", True), (None, True)])
    df = spark.createDataFrame([event(i) for i in range(8)] + [("s", None)], "submission_id string, model_answers array<struct<model:string,is_correct:boolean>>")
    out = [(r.model, r.short_name, r.correct, r.total, r.accuracy_pct) for r in S.model_scoreboard(df).collect()]
    assert out == [("y", "y", 3, 8, 38), ("o/x", "x", 1, 8, 12)]
    shuffled = S.model_scoreboard(df.orderBy(F.rand(1)).repartition(3)).collect()
    assert [tuple(r) for r in shuffled] == out


def test_listings(spark):
    bank = spark.createDataFrame([("q1", "Heart", "Bio", None), ("q2", "", " ", "heart")], "question_id string, question string, subject string, topic string")
    assert {r.question_id for r in S.search_questions(bank, "HEART").collect()} == {"q1", "q2"}
    assert S.search_questions(bank, "").count() == 2
    missing = {r.question_id: r.missing for r in S.missing_fields(bank, ["question", "subject"], trimmed=True).collect()}
    assert missing == {"q1": [], "q2": ["question", "subject"]}
    groups = spark.createDataFrame([(1, ["q2", "q9"])], "group_id int, question_ids array<string>")
    assert [r.question_id for r in S.group_questions(groups, bank).collect()] == ["q2"]
    assert I.text_only(spark.createDataFrame([([],), (["a"],), (None,)], "images array<string>")).count() == 2


def test_change_log(spark):
    schema = "question_id string, seq bigint, op string, changes map<string,string>, changed_at timestamp"
    import datetime as dt
    t = lambda n: dt.datetime(2024, 1, n)
    log = spark.createDataFrame([
        ("q1", 1, "update", {"question": "new", "hacker": "x"}, t(1)), ("q1", 2, "update", {"correct_answer": "b"}, t(2)),
        ("q1", 3, "update", {"hacker": "y"}, t(3)), ("unknown", 4, "update", {"question": "z"}, t(4)),
        ("q2", 5, "delete", None, t(5)), ("q2", 6, "update", {"question": "lost"}, t(6)), ("q2", 7, "create", {"question": "again"}, t(7)),
        ("q3", 8, "delete", {}, t(8)), ("q4", 9, "delete", None, t(9)),
    ], schema)
    snapshot = spark.createDataFrame([("q1", "old", "a", t(1)), ("q2", "two", "a", t(1)), ("q3", "three", "a", t(1))],
                                     "question_id string, question string, correct_answer string, created_at timestamp")
    for table in (log, log.orderBy(F.rand(2)), log.unionByName(log)):
        out = {r.question_id: r for r in M5.apply_changes(snapshot, table, ["question", "correct_answer"]).collect()}
        assert set(out) == {"q1", "q2"}
        assert (out["q1"].question, out["q1"].correct_answer, out["q1"].updated_at.day) == ("new", "B", 2)
        assert (out["q2"].question, out["q2"].correct_answer, out["q2"].updated_at) == ("again", "", None)


# --- two predictors and retrieval ---------------------------------------------------------


def test_hybrid_golden(spark):
    df = spark.createDataFrame(
        [("A", 0.30, "B"), ("A", 0.35, "B"), ("A", 0.50, "A"), ("A", 0.70, None), ("A", 0.1, None)],
        "predicted_letter string, confidence double, llm_answer string",
    )
    out = [(r.final_answer, r.answer_source) for r in N.hybrid_answer(df).collect()]
    assert out == [("B", "llm_override"), ("A", "encoder_preferred"), ("A", "encoder+llm_agree"), ("A", "encoder"), ("A", "encoder_preferred")]
    assert {r.answer_source for r in N.hybrid_answer(df, mode="never").collect()} == {"encoder"}


def test_argmax_and_softmax(spark):
    df = spark.createDataFrame([([0.25, 0.5, 0.5, 0.0],), ([1.0, 2.0, 3.0, 1000.0],)], "p array<double>")
    best = df.select(P.argmax_option(F.col("p")).alias("b")).collect()
    assert [(r.b.predicted_index, r.b.predicted_letter, r.b.confidence) for r in best] == [(1, "B", 0.5), (3, "D", 1000.0)]
    probs = df.select(P.softmax(F.col("p")).alias("s")).collect()
    assert sum(probs[0].s) == pytest.approx(1) and probs[1].s == [0.0, 0.0, 0.0, 1.0]
    flat = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.when(i == 41, 1.0).otherwise(0.0)).alias("s"))
    r = flat.select(R.flat_argmax(F.col("s")).alias("r")).first().r
    assert (r.choice, r.context) == (1, 10)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "pivots": 5}, {"block_rows": 1, "pivots": 1}])
def test_topk_with_hot_copies_matches_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    vectors = np.vstack([base, np.repeat(base[:1], 40, axis=0), np.zeros((5, 8))])  # many copies of one vector
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(base[:40])], "query_id bigint, embedding array<double>")
    out = R.retrieve_topk(queries, table.repartition(5), k=7, **sizes)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    scores = np.rint(base[:40] @ vectors.T * 1e6) / 1e6
    for q in range(40):
        order = sorted(range(len(vectors)), key=lambda i: (-scores[q, i], i))
        assert got[q] == order[:7]


def test_search_shuffles_queries_once_and_only_their_best(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id bigint, embedding array<float>")
    index = R.build_index(table, pivots=3, block_rows=2)
    assert len(index.blocks.collect()) >= 17
    out = R.search(index, table.withColumnRenamed("vec_id", "query_id"), k=3)
    plan = physical(out)
    # no rows of (block, query) that carry the query's vector: it goes to its task, the best of it to the ranking
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInPandas") == 1 and plan.count("Exchange ") <= 2
    assert {(r.query_id, r.rank): r.vec_id for r in out.collect()} == {(q, i): 50 - i if q else i - 1 for q in range(50) for i in (1, 2, 3)}


def test_queries_of_one_id_share_its_places(spark):
    table = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [-1.0, 0.0]])] * 2, "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, -1.0]), (3, None)], "query_id bigint, embedding array<double>")
    out = R.retrieve_topk(queries, table, k=3, pivots=2, block_rows=2)
    assert [(r.query_id, r.vec_id, r.score) for r in out.orderBy("query_id", "rank").collect()] == [
        (1, 1, 2.0), (1, 1, 2.0), (1, 2, 1.6), (2, 0, 0.0), (2, 0, 0.0), (2, 3, 0.0),
    ]


def test_blocks_are_compared_in_pieces_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, size=(90, 4)).astype(float)  # many equal scores
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    listed = R.build_index(table, pivots=4, block_rows=9).listed
    scores = vectors[:30] @ vectors.T
    for cells, rows in ((1, 1), (7, 2), (10_000, 100)):
        monkeypatch.setattr(R, "SCORE_CELLS", cells)
        monkeypatch.setattr(R, "BOUND_ROWS", rows)
        found = R._nearest(listed, vectors[:30], 5, 6)
        for q in range(30):
            assert found.ids[found.row == q].tolist() == sorted(range(90), key=lambda i: (-scores[q, i], i))[:5]


def test_joint_argmax_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0, [0.1, 0.9, 0.9, 0.0]), (1, 1, [0.9, 0.0, 0.0, 0.0])], "query_id int, rank int, scores array<double>")
    r = R.joint_argmax(df).first()
    assert (r.choice, r.letter, r.context) == (1, "B", 0)
