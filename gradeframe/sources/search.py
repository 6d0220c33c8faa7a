"""Search in a table of files through an index of trigrams: only files that can hold the text are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeframe.operators.serving import search_questions

SEARCHED = ("question", "subject", "topic")


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, 3)))


@dataclass(frozen=True)
class SearchIndex:
    """Which files of the parquet table at ``table`` hold which trigrams; postings lie at ``path``, sorted by trigram."""

    spark: SparkSession
    table: str
    path: str
    schema: StructType
    columns: tuple[str, ...] = SEARCHED

    def build(self) -> SearchIndex:
        """Index the files that are there now; each gives every trigram at most once, whatever its rows."""
        rows = self.spark.read.schema(self.schema).parquet(self.table)
        every = F.flatten(F.array(*[_trigrams(F.coalesce(F.col(c), F.lit(""))) for c in self.columns]))
        postings = rows.select(F.explode(every).alias("trigram"), F.col("_metadata.file_path").alias("file")).distinct()
        postings.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(self.path)
        return self

    def files(self, text: str) -> list[str] | None:
        """Files that hold all trigrams of the text; None if it is too short to have any, so all must be read."""
        low = text.lower()
        wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not wanted:
            return None
        postings = self.spark.read.schema("trigram string, file string").parquet(self.path)
        hits = postings.where(F.col("trigram").isin(wanted)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        return sorted(r.file for r in hits.where(F.col("n") == len(wanted)).select("file").collect())

    def search(self, text: str) -> DataFrame:
        """The rows of ``search_questions`` over the whole table."""
        files = self.files(text)
        if files is not None and not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*([self.table] if files is None else files))
        return search_questions(rows, text, self.columns)
