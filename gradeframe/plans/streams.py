"""Queries that run a stream over everything available and return its result table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gradeframe.constants import PREDICTION_KEYS, UPDATABLE_QUESTION_FIELDS
from gradeframe.operators.serving import model_scoreboard
from gradeframe.plans import views as V
from gradeframe.plans.exams import MODEL_ROWS, _board
from gradeframe.plans.registry import query
from gradeframe.plans.summaries import WITH
from gradeframe.plans.upkeep import KEPT, KEPT_COLUMNS, NEWEST
from gradeframe.session import work_dir
from gradeframe.streaming import changes as M5
from gradeframe.streaming import flows as M
from gradeframe.streaming import lifecycle as ML
from gradeframe.streaming import sessions as MS


def stream_of(spark, sf, name):
    """A given table as a file stream."""
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def in_batches(df, name, batches=3):
    """A table as a stream of several micro-batches: its files, of which each batch takes a share."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    files = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    stream = df.sparkSession.readStream.schema(df.schema)
    return stream.option("maxFilesPerTrigger", max(1, math.ceil(files / batches))).parquet(path)


@query("M1_stream_upsert", f"{WITH}, {NEWEST} select {KEPT} from newest")
def m1(spark, sf):
    stream = V.predictions(spark, sf, in_batches(V.table(spark, sf, "lineitem"), "lineitem"))
    current = M.stream_upsert(
        stream, work_dir(spark, "predictions"), work_dir(spark, "predictions-checkpoint"),
        keys=PREDICTION_KEYS, recency=V.RECENCY,
    )
    return current.select(*KEPT_COLUMNS)


def _lifecycle(events):
    """A submission per user and day that expects two kinds of event within twelve hours."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_trunc("day", "ts")
    return events.select(
        F.concat(F.col("user_id"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("submission_id"),
        F.explode(F.array(
            F.struct(day.alias("event_time"), F.lit(2).alias("expected"), F.lit(None).cast("string").alias("question_id"),
                     F.lit(None).cast("string").alias("answers")),
            F.struct(F.col("ts").alias("event_time"), F.lit(None).cast("int").alias("expected"),
                     F.col("event_type").alias("question_id"),
                     F.to_json(F.array(F.struct(F.lit("m").alias("model"), (F.col("value") > 10).alias("is_correct")))).alias("answers")),
        )).alias("e"),
    ).select("submission_id", "e.*")


FIRST = """first as (select concat(user_id, '/', strftime(ts, '%Y-%m-%d')) as submission_id, date_trunc('day', ts) as day, event_type, min(ts) as seen
    from events group by 1, 2, 3),
  counted as (select *, row_number() over (partition by submission_id order by seen, event_type) as rn from first where seen <= day + interval 12 hour)"""


@query("M2_track_submissions", f"""with {FIRST} select submission_id, 'COMPLETE' as status, cast(2 as int) as expected, cast(2 as int) as graded,
  epoch_us(max(seen)) as finished_us from counted where rn <= 2 group by 1 having count(*) = 2""")
def m2(spark, sf):
    out = ML.track_submissions(_lifecycle(stream_of(spark, sf, "events")), "12 hours", "60 days")
    done = M.run_to_table(out, "submissions")
    return done.select("submission_id", "status", "expected", "graded", F.unix_micros("finished_at").alias("finished_us"))


@query("M3_submission_timeout", """with first as (
    select concat(user_id, '/', strftime(ts, '%Y-%m-%d')) as submission_id, date_trunc('day', ts) as day, event_type, min(ts) as seen
    from events group by 1, 2, 3),
  found as (select submission_id, day, count(*) filter (where seen <= day + interval 12 hour) as n,
    coalesce(string_agg(event_type, ',' order by event_type) filter (where seen > day + interval 12 hour), '') as late_answers
    from first group by 1, 2)
  select submission_id, case when n >= 2 then 'COMPLETE' else 'TIMED_OUT' end as status, cast(2 as int) as expected,
    cast(least(n, 2) as int) as graded, late_answers
  from found where n >= 2 or day + interval 12 hour < (select max(ts) from events) - interval 1 day""")
def m3(spark, sf):
    # the watermark passes the deadlines of all submissions but those of the last day
    out = ML.track_submissions(_lifecycle(stream_of(spark, sf, "events")), "12 hours", "1 day")
    done = M.run_to_table(out, "submissions")
    return done.select("submission_id", "status", "expected", "graded", F.array_join("late_answers", ",").alias("late_answers"))


@query("M3_status_in_batch", f"""with {FIRST} select submission_id, cast(2 as int) as expected, cast(count(*) filter (where seen <= day + interval 12 hour) as int) as graded,
  case when count(*) filter (where seen <= day + interval 12 hour) >= 2 then 'COMPLETE' else 'TIMED_OUT' end as status from first group by 1""")
def m3_batch(spark, sf):
    events = _lifecycle(V.table(spark, sf, "events"))
    started = events.where(F.col("question_id").isNull()).select(
        "submission_id", F.col("expected").alias("total_questions"), F.col("event_time").alias("submitted_at")
    ).distinct()
    return ML.submission_status(started, events.where(F.col("question_id").isNotNull()), "12 hours")


@query("M4_stream_scoreboard", f"with {MODEL_ROWS} {_board()}")
def m4(spark, sf):
    graded = V.model_answers(spark, sf, stream_of(spark, sf, "lineitem"))
    return M.run_to_table(M.stream_scoreboard(graded), "scoreboard", "complete")


@query("M4_batch_scoreboard_by_month", f"""with g as (select date_trunc('month', l_shipdate) as month, 'org/alpha' as model, (l_orderkey + l_linenumber) % 8 = 0 as ok from lineitem where l_partkey % 13 <> 0
    union all select date_trunc('month', l_shipdate), 'beta', (l_partkey + l_linenumber) % 3 = 0 from lineitem where l_partkey % 13 <> 0)
  select strftime(month, '%Y-%m') as month, model, regexp_replace(model, '^[^/]*/', '') as short_name, count(*) filter (where ok) as correct, count(*) as total,
    cast(round_even(100.0::double * count(*) filter (where ok) / count(*), 0) as int) as accuracy_pct from g group by all""")
def m4_month(spark, sf):
    graded = V.model_answers(spark, sf).withColumn("month", F.date_format("event_time", "yyyy-MM"))
    return model_scoreboard(graded, ["month"])


COLUMNS = ["question", "option_a", "correct_answer", "subject"]
FIELDS = {"question": "p_name", "option_a": "p_type", "correct_answer": "l_returnflag", "subject": "l_linestatus", "author": "l_linestatus"}


def _snapshot(spark, sf):
    """Half of the parts are questions before the log starts."""
    parts = V.table(spark, sf, "part").where("p_partkey % 2 = 0")
    return parts.select(
        F.concat(F.lit("q"), "p_partkey").alias("question_id"), F.col("p_name").alias("question"), F.col("p_type").alias("option_a"),
        F.lit("a").alias("correct_answer"), F.col("p_brand").alias("subject"), F.lit("2000-01-01").cast("timestamp").alias("created_at"),
    )


def _log(spark, sf, lineitem):
    """One change per line item: mostly updates of some columns, some deletes and creates.

    The sequence number is made unique from the row's own columns.
    """
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    op = F.when(kind == 0, "delete").when(kind == 1, "create").otherwise("update")
    seq = (
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 10_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint") % 10_000
    ) * 100_000 + F.col("l_orderkey") % 10_000 * 10 + F.col("l_linenumber")
    none = F.lit(None).cast("string")
    def entry(name, value, present):
        return F.when(present, F.struct(F.lit(name).alias("key"), value.alias("value")))
    changes = F.map_from_entries(F.filter(F.array(
        entry("question", F.concat(F.lit("text "), "l_orderkey"), (kind == 1) | (kind == 2)),
        entry("correct_answer", F.lower("l_returnflag"), (kind == 1) | (kind >= 5)),
        entry("subject", F.when(kind != 3, F.col("l_linestatus")).otherwise(none), kind == 3),
        entry("author", F.col("l_linestatus"), kind == 4),
    ), lambda x: x.isNotNull()))
    return lineitem.select(
        F.concat(F.lit("q"), F.col("l_partkey") % 1000).alias("question_id"), seq.alias("seq"), op.alias("op"),
        changes.alias("changes"), F.col("l_shipdate").cast("timestamp").alias("changed_at"),
    )


LOG = """log as (select concat('q', l_partkey % 1000) as question_id, (l_orderkey + l_linenumber) % 10 as kind, l_shipdate as changed_at,
    (cast(epoch(l_shipdate) as bigint) * 10000 + cast(round(l_extendedprice * 100) as bigint) % 10000) * 100000 + l_orderkey % 10000 * 10 + l_linenumber as seq,
    concat('text ', l_orderkey) as question, lower(l_returnflag) as answer, l_linestatus from lineitem),
  snapshot as (select concat('q', p_partkey) as question_id, p_name, p_type, p_brand from part where p_partkey % 2 = 0),
  keys as (select question_id from log union select question_id from snapshot),
  created as (select k.question_id, case when max(l.seq) is not null then max(l.seq) when max(s.question_id) is not null then 0 end as cs
    from keys k left join (select * from log where kind = 1) l using (question_id) left join snapshot s using (question_id) group by 1),
  deleted as (select question_id, max(seq) as ds from log where kind = 0 group by 1),
  alive as (select question_id, cs from created left join deleted using (question_id) where cs is not null and cs > coalesce(ds, -1)),
  ups as (select l.* from log l join alive a on a.question_id = l.question_id and l.seq > a.cs and l.kind >= 2)"""


def _m5_sql():
    return f"""with {LOG}
    select a.question_id,
      coalesce((select arg_max(question, seq) from ups u where u.question_id = a.question_id and kind = 2), c.question, case when cs = 0 then s.p_name end, '') as question,
      coalesce(case when cs = 0 then s.p_type end, '') as option_a,
      upper(coalesce((select arg_max(answer, seq) from ups u where u.question_id = a.question_id and kind >= 5), c.answer, case when cs = 0 then 'a' end, '')) as correct_answer,
      case when exists (select 1 from ups u where u.question_id = a.question_id and kind = 3) then null
        else coalesce(case when cs = 0 then s.p_brand end, '') end as subject,
      coalesce(c.changed_at, timestamp '2000-01-01') as created_at,
      (select arg_max(changed_at, seq) from ups u where u.question_id = a.question_id and kind <> 4) as updated_at
    from alive a left join snapshot s using (question_id) left join (select * from log where kind = 1) c on c.question_id = a.question_id and c.seq = a.cs"""


@query("M5_apply_changes", _m5_sql())
def m5(spark, sf):
    log = _log(spark, sf, V.table(spark, sf, "lineitem"))
    return M5.apply_changes(_snapshot(spark, sf), log, COLUMNS)


@query("M5_apply_changes_stream", _m5_sql())
def m5_stream(spark, sf):
    bank = M5.Bank(spark, work_dir(spark, "bank"), tuple(COLUMNS), buckets=8, most=2)
    # the snapshot comes in as the oldest entries, the log after it in several batches
    bank.add(M5.snapshot_as_log(_snapshot(spark, sf), COLUMNS), "snapshot", 0)
    log = _log(spark, sf, in_batches(V.table(spark, sf, "lineitem"), "changes"))
    bank.follow(log, work_dir(spark, "bank-checkpoint")).awaitTermination()
    return bank.current(log)


@query("M5_replace_rows", """with l as (select concat('q', p_partkey) as question_id, p_name as question, p_brand as subject, cast(p_size as bigint) as seq,
    case when p_size % 7 = 0 then 'delete' else 'update' end as op from part),
  s as (select concat('q', p_partkey) as question_id, p_name as question, p_type as subject from part where p_partkey % 2 = 0)
  select s.question_id, case when l.op = 'update' then l.question else s.question end as question, l.subject
  from s join l using (question_id) where l.op = 'update'""")
def m5_replace(spark, sf):
    part = V.table(spark, sf, "part")
    key = F.concat(F.lit("q"), "p_partkey").alias("question_id")
    snapshot = part.where("p_partkey % 2 = 0").select(key, F.col("p_name").alias("question"), F.col("p_type").alias("subject"))
    log = part.select(
        key, F.col("p_size").cast("bigint").alias("seq"), F.when(F.col("p_size") % 7 == 0, "delete").otherwise("update").alias("op"),
        F.col("p_name").alias("question"), F.col("p_brand").alias("subject"),
    )
    return M5.replace_rows(snapshot, log)


@query("M6_active_sessions", """select event_id, user_id from events
  where case when event_type = 'signup' then null else ts + interval 12 hour end is null or ts + interval 12 hour > timestamp '2024-01-20'""")
def m6(spark, sf):
    sessions = V.table(spark, sf, "events").withColumn(
        "expires_at", F.when(F.col("event_type") != "signup", F.timestamp_add("HOUR", F.lit(12), "ts"))
    )
    return M.active_sessions(sessions, F.lit("2024-01-20").cast("timestamp")).select("event_id", "user_id")


@query("M6_session_stream", """select user_id, epoch_us(min(ts)) as opened_us, epoch_us(max(ts)) as last_seen_us, count(*) as events
  from events group by user_id""")
def m6_stream(spark, sf):
    events = stream_of(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_time"))
    out = M.run_to_table(MS.track_sessions(events, "user_id", ttl="1 day"), "sessions", "update", keys=["user_id"], once=True)
    return out.select("user_id", F.unix_micros("opened").alias("opened_us"), F.unix_micros("last_seen").alias("last_seen_us"), "events")


@query("M7_dedup_events", """select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all""")
def m7(spark, sf):
    stream = stream_of(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    kept = M.run_to_table(M.dedup_events(stream, ["user_id", "event_type"], delay="60 days"), "events")
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
