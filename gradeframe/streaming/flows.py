"""Structured Streaming jobs: prediction upsert, scoreboard, de-duplication, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gradeframe.constants import PREDICTION_KEYS
from gradeframe.functions.numeric import round_even
from gradeframe.functions.text import short_name
from gradeframe.operators.maintenance import merge_batch
from gradeframe.session import work_dir
from gradeframe.streaming.ledger import Entry, LedgerTable, stream_id


PREDICTION_PARTS = ("eval_split_name", "model_key")


def prediction_table(spark: SparkSession, path: str, schema: T.StructType) -> LedgerTable:
    """The upserted table below ``path``, partitioned by split and model."""
    return LedgerTable(spark, path, schema, PREDICTION_PARTS)


def upsert_batch(table: LedgerTable, batch: DataFrame, stream: str, number: int, keys: Sequence[str] = tuple(PREDICTION_KEYS),
                 recency: Sequence[str] = ("run_seq",)) -> list[tuple]:
    """Upsert a batch into the table; the partitions that it touched, none if it counts already."""
    seen: list[tuple] = []

    def merged(rows: DataFrame, touched: list[tuple], entry: Entry) -> tuple[DataFrame, bool]:
        seen.extend(touched)
        return merge_batch(table.read(touched, entry).drop("version"), rows, keys, recency), True

    table.apply(stream, number, batch, merged)
    return seen


def upsert_predictions(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = tuple(PREDICTION_KEYS),
                       recency: Sequence[str] = ("run_seq",)) -> StreamingQuery:
    """Upsert each micro-batch into the table: only partitions that it touches are read, merged and replaced.

    A batch counts once, by the ledger of the table, also when it comes again after a restart.
    """
    table = prediction_table(stream.sparkSession, path, stream.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(table, batch, stream_id(batch), batch_id, keys, recency)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = tuple(PREDICTION_KEYS),
                  recency: Sequence[str] = ("run_seq",)) -> DataFrame:
    """Upsert everything available and return the table: one row per key."""
    upsert_predictions(stream, path, checkpoint, keys, recency).awaitTermination()
    return prediction_table(stream.sparkSession, path, stream.schema).read().drop("version")


def dedup_events(stream: DataFrame, keys: Sequence[str], ts: str = "event_time", delay: str = "30 minutes") -> DataFrame:
    """Drop repeated events whose times lie within the delay; state is freed by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_scoreboard(graded: DataFrame) -> DataFrame:
    """Running correct, total and whole percent per model."""
    answers = graded.select(F.inline("model_answers")).where(F.coalesce(F.col("model"), F.lit("")) != "")
    return answers.groupBy("model").agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")
    ).select(
        "model", short_name(F.col("model")).alias("short_name"), "correct", "total",
        round_even(F.lit(100.0) * F.col("correct") / F.col("total")).cast("int").alias("accuracy_pct"),
    )


def active_sessions(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Session records that have not expired; records without an expiry stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = (), once: bool = False) -> DataFrame:
    """Run a stream over everything available and return its result table.

    ``once`` takes it as one batch: a stream whose state expires by the clock would else wait for that.

    The result and the checkpoint live in the shared folder. Complete and update output go
    through foreachBatch, because the file sink only appends: each batch has its own folder. The
    last batch is the result in complete mode, and the newest row per ``keys`` in update mode.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark = stream.sparkSession
    path, checkpoint = work_dir(spark, name), work_dir(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(once=True) if once else writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", path).parquet(path)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch").drop("batch")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return newest.select("row.*")
