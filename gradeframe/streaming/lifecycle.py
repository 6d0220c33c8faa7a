"""Lifecycle of exam submissions as keyed state: GRADING, COMPLETE or TIMED_OUT."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeframe.constants import PIPELINE_TIMEOUT
from gradeframe.session import with_rocksdb

OUTPUT = (
    "submission_id string, status string, expected int, graded int, scores string, finished_at timestamp, late_answers array<string>"
)
HEAD = "expected int, started bigint, graded int, done boolean, due bigint, few string, more boolean"
NO_HEAD = (-1, -1, 0, False, -1, "{}", False)
FEW = 16  # graded questions that the head of a submission holds itself
NO_TIME = -(2**63) // 1000  # of an event without one
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def millis(text: str) -> int:
    """Milliseconds of an amount and a unit, as "30 minutes"."""
    amount, unit = text.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000


def lifecycle_events(submissions: DataFrame, graded: DataFrame) -> DataFrame:
    """Both streams as one event table: start events with the expected count, graded events."""
    started = submissions.select(
        "submission_id", F.col("submitted_at").alias("event_time"), F.col("total_questions").cast("int").alias("expected"),
        F.lit(None).cast("string").alias("question_id"), F.lit(None).cast("string").alias("answers"),
    )
    marked = graded.select(
        "submission_id", "event_time", F.lit(None).cast("int").alias("expected"), "question_id",
        F.to_json("model_answers").alias("answers"),
    )
    return started.unionByName(marked)


class Submission(StatefulProcessor):
    """State of one submission: its head, and the earliest event of each graded question.

    Every call of the state goes to another process, so the first few questions lie in the head: a
    submission of few questions takes one read and one write a batch. Each question beyond them has an
    entry of its own, so a batch reads and writes only the questions that it has events of. One timer is
    armed at a time: the deadline, or for answers without a start event the time after which their start
    can't come any more. Whatever it finds is put out and freed.
    """

    def __init__(self, limit: int):
        self.limit = limit  # microseconds, like all event times here

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.questions = handle.getMapState("questions", "question_id string", "at bigint, answers string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = self.head.get() or NO_HEAD
        expected, started, graded, done, due, text, more = head
        few = json.loads(text)
        seen: dict[str, tuple[int, str]] = {}
        began, newest = started, -1
        for row in rows:
            at, question = row.at, row.question_id
            at = NO_TIME if at is None else at
            newest = max(newest, at)
            if question is None:
                expected, began = int(row.expected), at
            elif question not in seen or at < seen[question][0]:
                seen[question] = (at, row.answers)
        for question, value in seen.items():
            old = few.get(question) or (self.questions.getValue((question,)) if more else None)
            if old is None or value[0] < old[0]:
                if question in few or len(few) < FEW:
                    few[question] = value
                else:
                    self.questions.updateValue((question,), value)
                    more = True
                graded += began < 0 or value[0] <= began + self.limit
                graded -= old is not None and (began < 0 or old[0] <= began + self.limit)
        if began != started:  # only now it is known which answers came in time
            graded = sum(at <= began + self.limit for at, _, _ in self._answers(few, more))
        if not done and began >= 0 and graded >= expected:
            counted, late = self._split(began, few, more)
            counted = counted[:expected]
            yield _result(key[0], "COMPLETE", expected, counted, counted[-1][0] if counted else began, late)
            done = True
        if began >= 0:
            # a finished submission stays until its deadline, so repeated events are recognised
            when = (began + self.limit) // 1000 + 1
        else:
            when = max(due, (newest + self.limit) // 1000 + 1)
        when = max(when, timerValues.getCurrentWatermarkInMs() + 1)
        if when != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(when)
        new = (expected, began, graded, done, when, json.dumps(few), more)
        if new != head:
            self.head.update(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, started, _, done, _, text, more = self.head.get()
        if not done or started < 0:
            counted, late = self._split(started, json.loads(text), more)
            if started < 0:
                yield _result(key[0], "LATE", None, [], None, sorted(q for _, q, _ in counted))
            else:
                yield _result(key[0], "TIMED_OUT", expected, counted, started + self.limit, late)
        self.head.clear()
        if more:
            self.questions.clear()

    def close(self) -> None:
        pass

    def _answers(self, few: dict, more: bool) -> Iterator[tuple[int, str, str]]:
        """Time, question and answers of each graded question."""
        yield from ((at, question, answers) for question, (at, answers) in few.items())
        if more:
            yield from ((value[0], question[0], value[1]) for question, value in self.questions.iterator())

    def _split(self, started: int, few: dict, more: bool) -> tuple[list[tuple[int, str, str]], list[str]]:
        """Answers in time by time and question, and the questions answered behind the deadline."""
        rows = sorted(self._answers(few, more), key=lambda r: r[:2])
        in_time = [r for r in rows if started < 0 or r[0] <= started + self.limit]
        return in_time, sorted(q for at, q, _ in rows if started >= 0 and at > started + self.limit)


def track_submissions(events: DataFrame, timeout: str = PIPELINE_TIMEOUT, delay: str = "10 minutes") -> DataFrame:
    """One row per submission when every expected question is graded or the time is up.

    State holds the earliest event of each graded question of one submission, so repeated events
    change nothing and a restart continues from the checkpoint. The timer runs on event time; a
    graded event behind the deadline does not count and is named in ``late_answers``. Answers that
    no open submission waits for come out as a row with the status LATE, and their state is freed.
    The state is kept in RocksDB, so it need not fit in memory.
    """
    with_rocksdb(events.sparkSession)
    return (
        events.withColumn("at", F.unix_micros(F.col("event_time").cast("timestamp"))).withWatermark("event_time", delay)
        .groupBy("submission_id")
        .transformWithState(Submission(millis(timeout) * 1000), OUTPUT, "append", "EventTime")
    )


def _result(submission_id: str, status: str, expected: int | None, counted: list, at: int | None, late: list[str]) -> Row:
    """One output row with the scoreboard of the counted questions."""
    tallies: dict[str, list[int]] = {}
    for _, _, answers in counted:
        for m in json.loads(answers) if answers else []:
            if m.get("model"):
                tally = tallies.setdefault(m["model"], [0, 0])
                tally[0] += bool(m.get("is_correct"))
                tally[1] += 1
    board = [
        {"model": m, "correct": c, "total": t, "accuracy_pct": round(100 * c / t)} for m, (c, t) in tallies.items()
    ]
    board.sort(key=lambda x: (-x["accuracy_pct"], x["model"]))
    finished = None if at is None else EPOCH + dt.timedelta(microseconds=at)
    return Row(
        submission_id=submission_id, status=status, expected=expected, graded=len(counted), scores=json.dumps(board),
        finished_at=finished, late_answers=late,
    )


def submission_status(submissions: DataFrame, graded: DataFrame, timeout: str = PIPELINE_TIMEOUT) -> DataFrame:
    """The same outcome from complete tables, in batch: one row per submission."""
    seconds = millis(timeout) // 1000
    started = submissions.select(
        "submission_id", F.col("total_questions").cast("int").alias("expected"), "submitted_at"
    )
    first = graded.groupBy("submission_id", "question_id").agg(F.min("event_time").alias("event_time"))
    counted = started.join(first, "submission_id", "left")
    in_time = F.coalesce(
        F.col("event_time") <= F.timestamp_add("SECOND", F.lit(seconds), "submitted_at"), F.lit(False)
    )
    out = counted.groupBy("submission_id", "expected").agg(F.count_if(in_time).cast("int").alias("graded"))
    return out.withColumn("status", F.when(F.col("graded") >= F.col("expected"), "COMPLETE").otherwise("TIMED_OUT"))
