"""Question-bank change log: created, partially updated and deleted rows folded per question."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeframe.constants import UPDATABLE_QUESTION_FIELDS
from gradeframe.streaming.ledger import LedgerTable, stream_id


def change_state(
    log: DataFrame, columns: Sequence[str] = tuple(UPDATABLE_QUESTION_FIELDS), key: str = "question_id"
) -> DataFrame:
    """What a piece of a change log says of each question, in a form that merges with other pieces.

    Columns: the key, ``created`` (latest create with its row), ``deleted`` (latest delete), ``changed``
    (latest effective update) and ``new_<column>`` (latest update of each column), all led by ``seq``.
    """
    seq, op = F.col("seq"), F.col("op")
    value = lambda c: F.try_element_at(F.col("changes"), F.lit(c))
    is_create, is_update = op == "create", op == "update"
    effective = is_update & F.arrays_overlap(F.map_keys("changes"), F.array(*[F.lit(c) for c in columns]))
    base = F.struct(seq.alias("s"), F.col("changed_at").alias("at"), *[value(c).alias(c) for c in columns])
    updates = [
        F.max(F.when(is_update & F.map_contains_key("changes", c), F.struct(seq.alias("s"), value(c).alias("v")))).alias(f"new_{c}")
        for c in columns
    ]
    return log.groupBy(key).agg(
        F.max(F.when(is_create, base)).alias("created"), F.max(F.when(op == "delete", seq)).alias("deleted"),
        F.max(F.when(effective, F.struct(seq.alias("s"), F.col("changed_at").alias("v")))).alias("changed"), *updates,
    )


def merge_states(states: DataFrame, key: str = "question_id") -> DataFrame:
    """States of several pieces of a log as one; the order of the pieces does not matter."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(*[F.max(c).alias(c) for c in rest])


def bank_of(state: DataFrame, columns: Sequence[str] = tuple(UPDATABLE_QUESTION_FIELDS), key: str = "question_id") -> DataFrame:
    """The living rows that states of whole logs give."""
    alive = state.where(F.col("created.s") > F.coalesce("deleted", F.lit(-1)))

    def current(c):
        newer = F.col(f"new_{c}.s") > F.col("created.s")
        text = F.when(newer, F.col(f"new_{c}.v")).otherwise(F.coalesce(f"created.{c}", F.lit("")))
        return F.upper(text) if c == "correct_answer" else text

    return alive.select(
        key, *[current(c).alias(c) for c in columns], F.col("created.at").alias("created_at"),
        F.when(F.col("changed.s") > F.col("created.s"), F.col("changed.v")).alias("updated_at"),
    )


def fold_changes(
    log: DataFrame, columns: Sequence[str] = tuple(UPDATABLE_QUESTION_FIELDS), key: str = "question_id"
) -> DataFrame:
    """Final rows of a change log (key, seq, op, changes map, changed_at).

    ``create`` sets a whole row, ``update`` sets the allowed columns whose key it carries,
    ``delete`` removes the row; updates and deletes of a question that does not exist do
    nothing. Answers are kept in upper case. Written as one aggregate: the latest create, the
    latest delete and the latest update of each column suffice, so a question with very many
    changes is reduced before the shuffle.
    """
    return bank_of(change_state(log, columns, key), columns, key)


def snapshot_as_log(snapshot: DataFrame, columns: Sequence[str] = tuple(UPDATABLE_QUESTION_FIELDS), key: str = "question_id") -> DataFrame:
    """A bank as create entries older than any change."""
    entries = [x for c in columns if c in snapshot.columns for x in (F.lit(c), F.col(c))]
    return snapshot.select(
        key, F.lit(0).cast("bigint").alias("seq"), F.lit("create").alias("op"),
        F.create_map(*entries).alias("changes"), F.col("created_at").alias("changed_at"),
    )


def apply_changes(snapshot: DataFrame, log: DataFrame, columns: Sequence[str] = tuple(UPDATABLE_QUESTION_FIELDS)) -> DataFrame:
    """The bank after a change log; sequence numbers of the log start at 1."""
    return fold_changes(snapshot_as_log(snapshot, columns).unionByName(log), columns)


def replace_rows(snapshot: DataFrame, log: DataFrame, key: str = "question_id") -> DataFrame:
    """The variant in which an update replaces the whole row: the last entry per question wins."""
    rest = [c for c in snapshot.columns if c != key]
    old = snapshot.select(key, F.lit(0).cast("bigint").alias("seq"), F.lit("create").alias("op"), F.struct(*rest).alias("__row"))
    new = log.select(key, "seq", "op", F.struct(*rest).alias("__row"))
    merged = old.unionByName(new).groupBy(key).agg(
        F.max_by(F.struct("op", "__row"), "seq").alias("__l"), F.min_by("op", "seq").alias("__first")
    )
    # an update of an unknown question does not create it
    live = merged.where((F.col("__l.op") != "delete") & (F.col("__first") == "create"))
    return live.select(key, "__l.__row.*")


@dataclass(frozen=True)
class Bank:
    """A question bank kept from a stream of changes, merged on reading.

    Each batch is reduced to one state per question and adds a small file to the buckets it touches;
    other buckets are not opened. A bucket of more than ``most`` pieces is merged into one.
    """

    spark: SparkSession
    path: str
    columns: tuple[str, ...] = tuple(UPDATABLE_QUESTION_FIELDS)
    key: str = "question_id"
    buckets: int = 64
    most: int = 8

    def _dealt(self, state: DataFrame) -> DataFrame:
        return state.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def table(self, log: DataFrame) -> LedgerTable:
        """The table of states; ``log`` is any change log, for its types."""
        return LedgerTable(self.spark, self.path, self._dealt(change_state(log, self.columns, self.key)).schema, ("bucket",))

    def add(self, log: DataFrame, stream: str, batch: int) -> bool:
        """Take a batch of changes, unless it was taken already; True if it was taken now."""
        table = self.table(log)
        taken = table.apply(stream, batch, self._dealt(change_state(log, self.columns, self.key)), lambda rows, *_: (rows, False))
        entry = table.entry()
        full = [part for part, versions in entry.versions.items() if len(versions) > self.most]
        if full:
            # a question's pieces lie in one bucket, so its bucket stays with it
            table.rewrite(entry, self._dealt(merge_states(table.read(full, entry).drop("version", "bucket"), self.key)), full)
        return taken

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take everything available of a stream of changes."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.add(batch, stream_id(batch), batch_id)

        return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

    def current(self, log: DataFrame) -> DataFrame:
        """The living questions; ``log`` is any change log, for its types."""
        states = self.table(log).read().drop("version", "bucket")
        return bank_of(merge_states(states, self.key), self.columns, self.key)
