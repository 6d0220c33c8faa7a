"""Sinks. Every writer is a distributed write of many part files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeframe import constants as K
from gradeframe.functions.predicates import is_any_of
from gradeframe.operators.maintenance import merge_batch
from gradeframe.session import materialised
from gradeframe.sources.readers import read_or_empty


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields are written, non-ASCII text is kept as it is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def export_tables(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Write each non-empty table as CSV with a header; returns the names written."""
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/{name}")
            written.append(name)
    return written


def write_predictions(df: DataFrame, path: str) -> None:
    """Replace only the (split, model) partitions that the table holds."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("eval_split_name", "model_key")
        .parquet(path)
    )


PARTITIONS = ("eval_split_name", "model_key")


def partitions_of(spark: SparkSession, path: str, schema: StructType, touched: Iterable[Sequence]) -> DataFrame:
    """Rows of some (split, model) partitions of a table on disk; the folders of others are not listed for reading."""
    table = read_or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))
    return table.where(is_any_of(touched, PARTITIONS))


def upsert_table(
    batch: DataFrame, path: str, keys: Sequence[str] = tuple(K.PREDICTION_KEYS), recency: Sequence[str] = ("run_seq",)
) -> None:
    """Upsert a batch into a partitioned prediction table on disk.

    The batch is computed once. The (split, model) pairs that it touches become a literal predicate,
    so only their partitions are read, merged and replaced. The merged rows are written to a staging folder
    of the table, and take the place of the partitions that they were made of when the whole job has ended.
    An empty split or model is stored as null, as folders can't tell them apart.
    """
    spark = batch.sparkSession
    with materialised(batch.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in PARTITIONS}), "batch") as rows:
        touched = [tuple(r) for r in rows.select(*PARTITIONS).distinct().collect()]
        existing = partitions_of(spark, path, rows.schema, touched)
        write_predictions(merge_batch(existing, rows, keys, recency), path)


def export_questions(df: DataFrame, columns: Sequence[str] = tuple(K.QUESTION_EXPORT_COLUMNS)) -> DataFrame:
    """The fixed export columns, absent ones empty, others left out."""
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns
    ])


def submission_file(df: DataFrame, id_column: str = "id", predicted: str = "predicted_index") -> DataFrame:
    """The two columns of a blind-test submission, predictions counted from 1.

    A prediction outside 1..4 fails the job instead of reaching the file.
    """
    value = (F.col(predicted) + 1).cast("int")
    checked = F.when(value.between(1, 4), value).otherwise(
        F.raise_error(F.concat(F.lit("prediction out of range for id "), F.col(id_column).cast("string"))).cast("int")
    )
    return df.select(F.col(id_column).alias("id"), checked.alias("Prediction (correct option)"))


def write_submission(df: DataFrame, path: str) -> None:
    """One CSV file, as the file contract asks; the test set has a few thousand rows."""
    submission_file(df).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
