"""Sessions as keyed state that the store itself lets expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeframe.session import with_rocksdb
from gradeframe.streaming.lifecycle import millis

SESSION = "opened bigint, last_seen bigint, events bigint"


class Session(StatefulProcessor):
    """One value per key, which is gone ``ttl`` after it was last written, by the clock of the cluster.

    An expired value is never read again and the store drops it while it compacts, so nothing scans
    the sessions to find old ones.
    """

    def __init__(self, key: str, ttl: int):
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", SESSION, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, last, events = self.session.get() if self.session.exists() else (None, None, 0)
        resumed = opened is not None
        for batch in rows:
            low, high = batch.event_time.min().value // 1000, batch.event_time.max().value // 1000
            opened = low if opened is None else min(opened, low)
            last = high if last is None else max(last, high)
            events += len(batch)
        self.session.update((opened, last, events))
        yield pd.DataFrame({
            self.key: [key[0]], "opened": [pd.Timestamp(opened, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")],
            "events": [events], "resumed": [resumed],
        })

    def close(self) -> None:
        pass


def track_sessions(events: DataFrame, key: str, ttl: str) -> DataFrame:
    """The session of each key that a batch has events of: opened, last_seen, events, resumed.

    ``events`` has the key and ``event_time``; events without a key or time belong to no session. A key
    whose session has expired opens a new one. Update mode: a row replaces earlier ones of its key.
    """
    with_rocksdb(events.sparkSession)
    id_type = events.schema[key].dataType.simpleString()
    known = events.where(F.col(key).isNotNull() & F.col("event_time").isNotNull()).select(key, "event_time")
    return known.groupBy(key).transformWithStateInPandas(
        Session(key, millis(ttl)), f"{key} {id_type}, opened timestamp, last_seen timestamp, events bigint, resumed boolean",
        "update", "ProcessingTime",
    )


def live_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that have not expired, read from the state of a stream of ``track_sessions``."""
    state = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    # a value that has expired may still lie in the store until it is compacted
    alive = F.col("value.ttlExpirationMs") > F.unix_millis(F.current_timestamp())
    return state.where(alive).select("key.*", "value.value.*")
