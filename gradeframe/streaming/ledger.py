"""A partitioned table that streams write batch by batch, with a ledger of the batches that count.

Files of a batch go to a folder of their own, ``data/version=<n>/<partition folders>``. The batch counts
once its ledger entry is there: the list of partitions with the versions that make up each of them.
A batch that comes again after it was committed changes nothing, one that was lost before its entry
leaves files that no entry names. Readers open the folders of the newest entry only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.functions.predicates import is_any_of
from gradeframe.session import delete_folder, materialised

KEEP_ENTRIES = 2  # entries whose files stay, so that a reader of the last but one is not disturbed


@dataclass(frozen=True)
class Entry:
    """A committed state: which versions make up each partition, and the last batch of each stream."""

    number: int
    versions: dict[tuple, list[int]]
    batches: dict[str, int]


NOTHING = Entry(-1, {}, {})


@dataclass(frozen=True)
class LedgerTable:
    """The table at ``path``; ``schema`` holds all columns, among them the partition columns ``parts``.

    The number of partitions is bounded by the caller, as for any partitioned table: their list goes
    through the driver. An empty text in a partition column is stored as null, as folders can't tell them apart.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: tuple[str, ...]

    @property
    def _part_fields(self) -> list[T.StructField]:
        return [self.schema[p] for p in self.parts]

    def _ledger_schema(self) -> T.StructType:
        return T.StructType([
            T.StructField("number", T.LongType()), T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()),
            T.StructField("versions", T.ArrayType(T.LongType())), *self._part_fields,
        ])

    def entry(self) -> Entry:
        """The newest committed entry."""
        try:
            rows = self.spark.read.schema(self._ledger_schema()).parquet(f"{self.path}/ledger")
        except AnalysisException:  # no batch has been committed yet
            return NOTHING
        newest = rows.agg(F.max("number")).first()[0]
        if newest is None:
            return NOTHING
        found = rows.where(F.col("number") == newest).collect()
        versions = {tuple(r[p] for p in self.parts): list(r.versions) for r in found if r.versions is not None}
        return Entry(newest, versions, {r.stream: r.batch for r in found if r.stream is not None})

    def read(self, only: Iterable[Sequence] | None = None, entry: Entry | None = None) -> DataFrame:
        """Current rows with their ``version``, of all partitions or ``only`` of some; other folders are not read."""
        entry = self.entry() if entry is None else entry
        chosen = entry.versions if only is None else {p: entry.versions[p] for p in map(tuple, only) if p in entry.versions}
        by_version: dict[int, list[tuple]] = {}
        for part, versions in chosen.items():
            for v in versions:
                by_version.setdefault(v, []).append(part)
        schema = T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])
        if not by_version:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/data/version={v}" for v in sorted(by_version)]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.where(is_any_of([(v, *p) for v, ps in sorted(by_version.items()) for p in ps], ["version", *self.parts]))

    def files(self, only: Iterable[Sequence] | None = None) -> list[str]:
        """Files of the current rows."""
        entry = self.entry()
        if not (entry.versions if only is None else any(tuple(p) in entry.versions for p in only)):
            return []
        return sorted(r[0] for r in self.read(only, entry).select("_metadata.file_path").distinct().collect())

    def apply(self, stream: str, batch: int, rows: DataFrame, change: Callable[[DataFrame, list[tuple], Entry], tuple[DataFrame, bool]]) -> bool:
        """Commit a batch of a stream unless it counts already; True if it was committed now.

        The batch is computed once. ``change`` gets it with the partitions it touches and the present
        entry, and returns the rows to write and whether they replace what these partitions held or add to it.
        """
        entry = self.entry()
        if batch <= entry.batches.get(stream, -1):
            return False
        texts = [p for p in self.parts if isinstance(self.schema[p].dataType, T.StringType)]
        with materialised(rows.withColumns({p: F.nullif(F.col(p), F.lit("")) for p in texts}), "batch") as kept:
            touched = [tuple(r) for r in kept.select(*self.parts).distinct().collect()]
            new, replaces = change(kept, touched, entry)
            self._commit(entry, new, touched, replaces, {**entry.batches, stream: batch})
        return True

    def rewrite(self, entry: Entry, rows: DataFrame, touched: list[tuple]) -> None:
        """Commit other files with the same content for some partitions, as a compaction does."""
        self._commit(entry, rows, touched, True, entry.batches)

    def _commit(self, entry: Entry, rows: DataFrame, touched: list[tuple], replaces: bool, batches: dict[str, int]) -> None:
        number = entry.number + 1
        versions = dict(entry.versions)
        if touched:
            data = rows.select(*[f.name for f in self.schema.fields])
            data.write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.path}/data/version={number}")
            for part in touched:
                versions[part] = [number] if replaces else [*versions.get(part, []), number]
        nothing = dict.fromkeys(self.parts)
        entries = [Row(number=number, stream=None, batch=None, versions=v, **dict(zip(self.parts, p, strict=True))) for p, v in versions.items()]
        entries += [Row(number=number, stream=s, batch=b, versions=None, **nothing) for s, b in batches.items()]
        schema = self._ledger_schema()
        listed = self.spark.createDataFrame([[r[f.name] for f in schema.fields] for r in entries], schema)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/entry={number}")
        self._remove_old(number)

    def _remove_old(self, number: int) -> None:
        """Delete entries but the last ``KEEP_ENTRIES``, and the files that none of these names."""
        rows = self.spark.read.schema(self._ledger_schema()).parquet(f"{self.path}/ledger").where("versions IS NOT NULL")
        pairs = rows.select("number", F.explode("versions").alias("version"), *self.parts).collect()
        kept = {tuple(r[1:]) for r in pairs if r.number > number - KEEP_ENTRIES}
        in_use = {pair[0] for pair in kept}
        # a folder in which some partitions still count loses the others
        stale = {tuple(r[1:]) for r in pairs if r.version in in_use} - kept
        if stale:
            every = Entry(number, {}, {})
            for version, *part in stale:
                every.versions.setdefault(tuple(part), []).append(version)
            for file in self.read(entry=every).select("_metadata.file_path").distinct().collect():
                self._delete(file[0])
        for old in self._listed_versions():
            if old not in in_use and old < number:
                self._delete(f"{self.path}/data/version={old}")
        for old in range(number - KEEP_ENTRIES, -1, -1):
            if not self._delete(f"{self.path}/ledger/entry={old}"):
                break  # the earlier ones have gone before

    def _files_of(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> bool:
        return delete_folder(self.spark, path)

    def _listed_versions(self) -> list[int]:
        hadoop, files = self._files_of(f"{self.path}/data")
        try:
            names = [s.getPath().getName() for s in files.listStatus(hadoop)]
        except Py4JJavaError:  # no batch has had a row yet
            return []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def stream_id(batch: DataFrame) -> str:
    """The id of the query that runs a batch; it stays the same over restarts from one checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
