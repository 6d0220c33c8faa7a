"""Stateful streams over several batches and restarts: ledger tables, submissions, the question bank, sessions."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gradeframe import session
from gradeframe.operators import maintenance as U
from gradeframe.sources import writers as W
from gradeframe.streaming import changes as C
from gradeframe.streaming import flows as M
from gradeframe.streaming import lifecycle as ML
from gradeframe.streaming import sessions as S
from gradeframe.streaming.ledger import LedgerTable

PRED = "experiment_tag string, eval_split_name string, model_key string, question_id string, run_seq bigint, v string"
NAMES = [c.split()[0] for c in PRED.split(", ")]


def rows_of(df, columns=NAMES):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def table_at(spark, tmp_path):
    return M.prediction_table(spark, str(tmp_path / "table"), spark.createDataFrame([], PRED).schema)


def put(table, batch, rows, stream="s"):
    df = table.spark.createDataFrame(rows, PRED)
    def merged(new, touched, entry):
        return U.merge_batch(table.read(touched, entry).drop("version"), new), True
    return table.apply(stream, batch, df, merged)


def test_a_batch_counts_once_and_touches_only_its_partitions(spark, tmp_path):
    table = table_at(spark, tmp_path)
    assert rows_of(table.read()) == [] and table.files() == []
    assert put(table, 0, [("t", "s1", "m", "q1", 1, "a"), ("t", "s2", "m", "q1", 1, "b")])
    other = table.files([("s2", "m")])
    assert put(table, 1, [("t", "s1", "m", "q1", 2, "c"), ("t", "s1", "m", "q2", 1, "d")])
    expected = [("t", "s1", "m", "q1", 2, "c"), ("t", "s1", "m", "q2", 1, "d"), ("t", "s2", "m", "q1", 1, "b")]
    assert rows_of(table.read()) == expected
    assert table.files([("s2", "m")]) == other and other
    before = table.files()
    assert not put(table, 1, [("t", "s1", "m", "q1", 9, "again")]) and not put(table, 0, [("t", "s9", "m", "q1", 9, "old")])
    assert table.files() == before and rows_of(table.read()) == expected
    assert put(table, 0, [("t", "s2", "m", "q1", 5, "e")], stream="another")
    assert ("t", "s2", "m", "q1", 5, "e") in rows_of(table.read())


def test_a_batch_lost_before_its_entry_leaves_nothing(spark, tmp_path):
    table = table_at(spark, tmp_path)
    put(table, 0, [("t", "s1", "m", "q1", 1, "a")])
    # the files of the next version are there, its entry is not
    lost = spark.createDataFrame([("t", "s1", "m", "q1", 7, "lost")], PRED)
    lost.write.partitionBy("eval_split_name", "model_key").parquet(f"{table.path}/data/version=1")
    assert rows_of(table.read()) == [("t", "s1", "m", "q1", 1, "a")]
    put(table, 1, [("t", "s1", "m", "q1", 3, "b")])
    assert rows_of(table.read()) == [("t", "s1", "m", "q1", 3, "b")]


def test_old_files_are_removed_after_commits(spark, tmp_path):
    table = table_at(spark, tmp_path)
    for n in range(6):
        rows = [("t", "s1", "m", "q1", n, "x")] + ([("t", "s2", "m", "q1", n, "y")] if n in (0, 3) else [])
        put(table, n, rows)
    on_disk = {str(p).split("/data/")[1] for p in (tmp_path / "table" / "data").rglob("*.parquet")}
    folders = sorted({p.rsplit("/", 1)[0] for p in on_disk})
    # the current files, and those of the entry before
    assert folders == [
        "version=3/eval_split_name=s2/model_key=m", "version=4/eval_split_name=s1/model_key=m", "version=5/eval_split_name=s1/model_key=m",
    ]
    assert len(list((tmp_path / "table" / "ledger").glob("entry=*"))) == 2


def test_odd_partition_values(spark, tmp_path):
    table = table_at(spark, tmp_path)
    odd = ["a/b", "x=1", "ü %2F", None, "1.0", "001"]
    put(table, 0, [("t", s, m, "q", 1, "a") for s in odd for m in ("m", None)] + [("t", "", "m", "q2", 1, "a")])
    put(table, 1, [("t", s, "m", "q", 2, "b") for s in odd] + [("t", "", "", "q2", 2, "b")])
    expected = [("t", s, "m", "q", 2, "b") for s in odd] + [("t", s, None, "q", 1, "a") for s in odd]
    expected += [("t", None, "m", "q2", 1, "a"), ("t", None, None, "q2", 2, "b")]
    assert rows_of(table.read()) == sorted(expected, key=repr)


def test_an_empty_batch_is_committed_without_files(spark, tmp_path):
    table = table_at(spark, tmp_path)
    assert put(table, 0, []) and rows_of(table.read()) == []
    assert put(table, 1, [("t", "s", "m", "q", 1, "a")]) and not put(table, 0, [("t", "s", "m", "z", 1, "a")])


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_touched_partitions_are_literals_of_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("t", f"s{i}", "m", "q", 1, "a") for i in range(5)]
    W.upsert_table(spark.createDataFrame(rows, PRED), path)
    read = W.partitions_of(spark, path, spark.createDataFrame([], PRED).schema, [("s1", "m"), ("s3", None)])
    plan = plan_of(read)
    line = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert "s1" in line and "s3" in line and "Join" not in plan
    assert [r.eval_split_name for r in read.collect()] == ["s1"]
    W.upsert_table(spark.createDataFrame([("t", "s1", "m", "q", 2, "b"), ("t", "", "m", "q", 2, "b")], PRED), path)
    W.upsert_table(spark.createDataFrame([("t", "", "m", "q", 1, "c")], PRED), path)
    found = rows_of(spark.read.schema(PRED).parquet(path))
    assert ("t", "s1", "m", "q", 2, "b") in found and ("t", None, "m", "q", 2, "b") in found and len(found) == 6


def test_stream_upsert_goes_on_after_a_restart(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    everything = []
    for n in range(3):
        rows = [("t", f"s{i % 2}", "m", f"q{i % 5}", 10 * n + i, f"{n}") for i in range(7)]
        everything += rows
        spark.createDataFrame(rows, PRED).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PRED).option("maxFilesPerTrigger", 1).parquet(source)
        out = M.stream_upsert(stream, path, checkpoint)
        assert rows_of(out) == rows_of(U.newest(spark.createDataFrame(everything, PRED)))
    assert LedgerTable(spark, path, stream.schema, M.PREDICTION_PARTS).entry().number >= 5


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENT = "submission_id string, event_time timestamp, expected int, question_id string, answers string"
GOOD = json.dumps([{"model": "x", "is_correct": True}])


def follow(spark, tmp_path, batches, timeout="30 minutes", delay="45 minutes"):
    """Run the lifecycle over batches, with a restart before each."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        out = ML.track_submissions(spark.readStream.schema(EVENT).parquet(source), timeout, delay)
        out.writeStream.option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(ML.OUTPUT).parquet(path).collect()
    return sorted((r.submission_id, r.status, r.expected, r.graded, r.late_answers) for r in rows), checkpoint


def test_late_answers_are_named_and_orphans_are_freed(spark, tmp_path):
    rows, checkpoint = follow(spark, tmp_path, [
        [("a", at(0), 2, None, None), ("a", at(1), None, "q1", GOOD), ("a", at(31), None, "q3", GOOD), ("o", at(2), None, "q9", GOOD)],
        [("a", at(40), None, "q2", GOOD), ("a", at(39), None, "q2", GOOD), ("b", at(40), None, "q1", GOOD)],
        [("b", at(38), 1, None, None)],  # the start comes after its answer
        [("z", at(300), 1, None, None)],
        [("z", at(301), None, "q", GOOD)],
    ])
    assert rows == [
        ("a", "TIMED_OUT", 2, 1, ["q2", "q3"]), ("b", "COMPLETE", 1, 1, []), ("o", "LATE", None, 0, ["q9"]), ("z", "COMPLETE", 1, 1, []),
    ]
    state = spark.read.format("statestore").option("stateVarName", "head").load(checkpoint)
    assert [r[0] for r in state.select("key.submission_id").collect()] == ["z"]  # all others are freed


def test_an_earlier_copy_brings_an_answer_back_in_time(spark, tmp_path):
    rows, _ = follow(spark, tmp_path, [
        [("a", at(0), 1, None, None), ("a", at(35), None, "q1", GOOD)],
        [("a", at(20), None, "q1", GOOD)],
    ])
    assert rows == [("a", "COMPLETE", 1, 1, [])]


class Kept:
    """State variables and timers of one key, and how often each was called."""

    def __init__(self):
        self.value, self.entries, self.timers, self.calls = None, {}, set(), []

    def getValueState(self, *names):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        does = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "getValue": lambda k: self.entries.get(k), "updateValue": self.entries.__setitem__, "iterator": lambda: iter(list(self.entries.items())),
            "registerTimer": self.timers.add, "deleteTimer": self.timers.discard, "getCurrentWatermarkInMs": lambda: 0,
            "clear": lambda: (setattr(self, "value", None), self.entries.clear()),
        }[name]
        return lambda *a: self.calls.append(name) or does(*a)


def answered(question, minute):
    return Row(at=minute * 60_000_000, expected=None, question_id=question, answers=GOOD)


def test_a_small_submission_takes_one_read_and_one_write(spark):
    kept, processor = Kept(), ML.Submission(30 * 60_000_000)
    processor.init(kept)
    start = Row(at=0, expected=3, question_id=None, answers=None)
    assert not list(processor.handleInputRows(("a",), iter([start, answered("q1", 1), answered("q2", 2), start]), kept))
    assert sorted(c for c in kept.calls if c != "getCurrentWatermarkInMs") == ["get", "registerTimer", "update"]
    kept.calls.clear()
    assert not list(processor.handleInputRows(("a",), iter([answered("q1", 5), start]), kept))  # copies change nothing
    assert [c for c in kept.calls if c != "getCurrentWatermarkInMs"] == ["get"]


def test_a_large_submission_keeps_its_questions_apart(spark):
    kept, processor, n = Kept(), ML.Submission(30 * 60_000_000), 2 * ML.FEW
    processor.init(kept)
    out = []
    for q in range(n):
        out += processor.handleInputRows(("a",), iter([answered(f"q{q:02}", 29 if q % 2 else 31)]), kept)
    assert len(kept.entries) == n - ML.FEW and not out
    # an earlier copy of an answer that was late, in the head and apart; then the start
    for q in (0, n - 2):
        out += processor.handleInputRows(("a",), iter([answered(f"q{q:02}", 3)]), kept)
    out += processor.handleInputRows(("a",), iter([Row(at=0, expected=n, question_id=None, answers=None)]), kept)
    assert not out and kept.value[2] == n // 2 + 2
    row, = processor.handleExpiredTimer(("a",), kept, None)
    assert (row.status, row.graded, row.late_answers) == ("TIMED_OUT", n // 2 + 2, [f"q{q:02}" for q in range(2, n - 2, 2)])
    assert kept.value is None and not kept.entries


LOG = "question_id string, seq bigint, op string, changes map<string,string>, changed_at timestamp"


def change(q, seq, op, **values):
    return (q, seq, op, values, at(seq))


def test_bank_equals_the_whole_log_and_touches_only_its_buckets(spark, tmp_path):
    columns = ("question", "correct_answer", "subject")
    bank = C.Bank(spark, str(tmp_path / "bank"), columns, buckets=16, most=3)
    log = []
    import random

    rng = random.Random(3)
    seq = 0
    for n in range(9):
        rows = []
        for _ in range(12):
            seq += 1
            op = rng.choice(["create", "update", "update", "update", "delete"])
            values = {c: rng.choice(["a", "b", None]) for c in (*columns, "author") if rng.random() < 0.6}
            rows.append(change(f"q{rng.randint(0, 14)}", seq, op, **values))
        rng.shuffle(rows)
        log += rows
        assert bank.add(spark.createDataFrame(rows, LOG), "s", n)
        assert not bank.add(spark.createDataFrame(rows, LOG), "s", n)
    whole = spark.createDataFrame(log, LOG)
    names = ["question_id", *columns, "created_at", "updated_at"]
    assert rows_of(bank.current(whole), names) == rows_of(C.fold_changes(whole, columns), names)
    assert max(map(len, bank.table(whole).entry().versions.values())) <= 3
    # one question: one bucket gets one more file, all other files stay
    before = set(bank.table(whole).files())
    bank.add(spark.createDataFrame([change("q1", 10_000, "update", question="z")], LOG), "s", 99)
    after = set(bank.table(whole).files())
    bucket = spark.createDataFrame([("q1",)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(16))).first()[0]
    assert after - before and all(f"bucket={bucket}/" in f for f in after ^ before)


def test_bank_follows_a_stream(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    bank = C.Bank(spark, str(tmp_path / "bank"), ("question", "correct_answer"), buckets=4, most=2)
    batches = [
        [change("q1", 1, "create", question="a", correct_answer="b"), change("q2", 2, "update", question="x")],
        [change("q1", 4, "update", correct_answer="d"), change("q1", 3, "update", correct_answer="c")],
        [change("q3", 5, "create", question="n"), change("q3", 6, "delete")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        bank.follow(spark.readStream.schema(LOG).parquet(source), checkpoint).awaitTermination()
    assert rows_of(bank.current(spark.createDataFrame([], LOG)), ["question_id", "question", "correct_answer"]) == [("q1", "a", "D")]


def session_steps(spark, folder, ttl, *batches, wait=0):
    """Run the sessions over batches, with a restart before each; the rows put out, and the checkpoint."""
    schema, seen = "user string, event_time timestamp", []
    source, checkpoint = f"{folder}/in", f"{folder}/cp"

    def write(df, n):
        seen.append(sorted(tuple(r) for r in df.select("user", "events", "resumed").collect()))

    for n, rows in enumerate(batches):
        time.sleep(wait if n else 0)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = S.track_sessions(spark.readStream.schema(schema).parquet(source), "user", ttl)
        writer = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(once=True)
        assert writer.foreachBatch(write).start().awaitTermination(120)
    return seen, checkpoint


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    first, second = [("a", at(1)), ("a", at(0)), ("b", at(2)), (None, at(3)), ("c", None)], [("a", at(5))]
    seen, checkpoint = session_steps(spark, tmp_path, "1 day", first, second)
    assert seen == [[("a", 2, False), ("b", 1, False)], [("a", 3, True)]]
    live = {r.user: (r.events, r.last_seen - r.opened) for r in S.live_sessions(spark, checkpoint).collect()}
    assert live == {"a": (3, 300_000_000), "b": (1, 0)}


def test_sessions_expire_without_a_scan(spark, tmp_path):
    seen, checkpoint = session_steps(spark, tmp_path, "2 seconds", [("a", at(1)), ("b", at(2))], [("a", at(5))], wait=3)
    assert seen == [[("a", 1, False), ("b", 1, False)], [("a", 1, False)]]
    assert "b" not in [r.user for r in S.live_sessions(spark, checkpoint).collect()]


@pytest.mark.parametrize("text, expected", [("30 minutes", 1_800_000), ("1 day", 86_400_000), ("2 seconds", 2000)])
def test_durations(text, expected):
    assert ML.millis(text) == expected


def test_an_upsert_leaves_no_copies_of_its_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_local_root", lambda: str(tmp_path / "work"))
    path = str(tmp_path / "table")
    for n in range(2):
        W.upsert_table(spark.createDataFrame([("t", "s1", "m", f"q{i}", n, "a") for i in range(3)], PRED), path)
    assert rows_of(spark.read.schema(PRED).parquet(path)) == [("t", "s1", "m", f"q{i}", 1, "a") for i in range(3)]
    assert not list((tmp_path / "work").glob("*"))


def test_a_committed_batch_leaves_no_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_local_root", lambda: str(tmp_path / "work"))
    table = table_at(spark, tmp_path)
    assert put(table, 0, [("t", "s1", "m", "q1", 1, "a")]) and put(table, 1, [("t", "s1", "m", "q1", 2, "b")])
    assert rows_of(table.read()) == [("t", "s1", "m", "q1", 2, "b")] and not list((tmp_path / "work").glob("*"))
