"""Sources. Schemas are explicit and missing inputs give empty tables with the full schema."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe import schemas as S
from gradeframe.functions.text import blank_to_null
from gradeframe.operators.items import has_keys
from gradeframe.functions.labels import infer_subject


def read_or_empty(spark: SparkSession, schema: T.StructType, load) -> DataFrame:
    """The loaded table, or an empty one when no path exists."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _file_heads(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first non-blank line, from one distributed scan; only one line per file is kept.

    A file whose first line starts a JSON array is listed under "[" alone.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"),
    )
    value = F.when(F.ltrim("value").startswith("["), F.lit("[")).otherwise(F.col("value"))
    heads = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by(value, "at").alias("head"))
    found: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        found.setdefault(row["head"], []).append(_literal_path(row["file"]))
    return found


def _literal_path(uri: str) -> str:
    """A file's address as a path that is read as it stands, without patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_mcq(spark: SparkSession, path: str, schema: T.StructType = S.MCQ_ITEM, multi_line: bool = True) -> DataFrame:
    """Question items from CSV with a header, JSON lines, JSON arrays, or a folder of both JSON forms.

    The first non-blank line of each JSON file tells its form. JSON lines are split across tasks; a
    JSON array is read by one task, as is a CSV file while ``multi_line`` allows line breaks inside
    quotes.
    """
    if path.rstrip("/").endswith(".csv"):
        return (
            spark.read.schema(schema).option("header", "true").option("enforceSchema", "false")
            .option("multiLine", str(multi_line).lower()).option("escape", '"').csv(path)
        )
    heads = _file_heads(spark, [path])
    arrays = heads.pop("[", [])
    lines = [file for files in heads.values() for file in files]
    if not arrays:
        return spark.read.schema(schema).json(path)
    whole = spark.read.schema(schema).option("multiLine", "true").json(arrays)
    return whole.unionByName(spark.read.schema(schema).json(lines)) if lines else whole


def read_mcq_lines(spark: SparkSession, path: str, required: Sequence[str] | None = None) -> DataFrame:
    """JSON lines as raw text with the key test, so that an absent key differs from a null."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.withColumn("valid", has_keys(F.col("value"), required) if required else has_keys(F.col("value")))


def parse_items(raw: DataFrame, schema: T.StructType = S.MCQ_ITEM, column: str = "value") -> DataFrame:
    """Raw JSON rows to item columns."""
    return raw.select(F.from_json(column, schema).alias("__i")).select("__i.*")


def read_exam_samples(spark: SparkSession, path: str, split: str, recursive: bool = False) -> DataFrame:
    """A folder with one JSON document per file; file name, split and subject are attached."""
    def load():
        return (
            spark.read.schema(S.EXAM_SAMPLE).option("multiLine", "true").option("pathGlobFilter", "*.json")
            .option("recursiveFileLookup", str(recursive).lower()).json(path)
        )

    docs = read_or_empty(spark, S.EXAM_SAMPLE, load)
    source = F.col("_metadata.file_name") if "_metadata" in _hidden(docs) else F.lit(None).cast("string")
    named = docs.withColumn("source_json", source).withColumn(
        "eval_split_name", F.coalesce(F.nullif("test_set", F.lit("")), F.lit(split))
    )
    return named.withColumn("subject_category", infer_subject(named)).drop("subject", "category", "section", "topic")


def _hidden(df: DataFrame) -> set[str]:
    """Hidden metadata columns the table offers; an empty local table has none."""
    try:
        df.select("_metadata")
        return {"_metadata"}
    except AnalysisException:
        return set()


def read_predictions(
    spark: SparkSession, paths: str | Sequence[str], label: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Prediction CSVs whose column sets differ, as one table with the full schema.

    Files, folders and patterns may be mixed. Columns are matched by the header of each file: files
    are grouped by their header line and each group is one distributed read. Absent columns are null,
    unknown ones are left out, paths that do not exist are skipped. ``label`` names a column for the
    source: the folder of part files, else the file without its ending. ``multi_line=False`` lets
    large files without line breaks inside quotes be split across tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = _file_heads(spark, existing) if (existing := [p for p in paths if _exists(spark, p)]) else {}
    out = None
    for header, files in heads.items():
        one = _read_by_header(spark, header, files, label, multi_line)
        out = one if out is None else out.unionByName(one)
    if out is not None:
        return out
    empty = T.StructType([*S.PREDICTION.fields, *([T.StructField(label, T.StringType())] if label else [])])
    return spark.createDataFrame([], empty)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _read_by_header(spark: SparkSession, header: str, files: Sequence[str], label: str | None, multi_line: bool) -> DataFrame:
    """Read files with one header as text columns and cast them to the schema; absent ones are null."""
    names = [name.strip() for name in next(csv.reader([header.lstrip("\ufeff")]))]
    # of columns with the same name, the first counts
    fields = [T.StructField(name if name not in names[:n] else f"__{n}", T.StringType()) for n, name in enumerate(names)]
    options = {"header": "true", "multiLine": str(multi_line).lower(), "escape": '"'}
    raw = spark.read.schema(T.StructType(fields)).options(**options).csv(list(files))
    columns = [
        (blank_to_null(F.col(f"`{f.name}`")).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in S.PREDICTION.fields
    ]
    if label:
        parts = F.split("_metadata.file_path", "/")
        name = F.when(F.element_at(parts, -1).startswith("part-"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
        columns.append(F.regexp_replace(_decoded(name), r"\.csv$", "").alias(label))
    return raw.select(*columns)


def _decoded(name: Column) -> Column:
    """A path's part without URL escapes; a plus sign stays."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_run_metrics(spark: SparkSession, root: str, pattern: str = "*_metrics.json", by_file: bool = False) -> DataFrame:
    """One metrics document per run folder: the file named after the folder, else the first other.

    ``by_file`` takes every file at any depth as a run of its own, named by the file without "_metrics".
    """
    def load():
        return (
            spark.read.schema(S.RUN_METRICS).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).json(root)
            .select("*", F.col("_metadata.file_path").alias("__path"))
        )

    empty = T.StructType([*S.RUN_METRICS.fields, T.StructField("__path", T.StringType())])
    docs = read_or_empty(spark, empty, load)
    columns = [f.name for f in S.RUN_METRICS.fields]
    parts = F.split("__path", "/")
    file = _decoded(F.try_element_at(parts, F.lit(-1)))
    if by_file:
        return docs.select(_run_of_file(file).alias("run"), *columns)
    named = docs.withColumn("run", _decoded(F.try_element_at(parts, F.lit(-2)))).withColumn("__file", file)
    order = Window.partitionBy("run").orderBy(
        F.when(F.col("__file") == F.concat("run", F.lit("_metrics.json")), 0).otherwise(1), "__file"
    )
    kept = named.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") == 1)
    return kept.select("run", *columns)


def _run_of_file(file: Column) -> Column:
    return F.replace(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("_metrics"), F.lit(""))


def read_metrics_documents(spark: SparkSession, root: str, pattern: str = "*_metrics.json") -> DataFrame:
    """Every metrics document below a folder as it stands: run (by its file) and a variant.

    Nothing is assumed of the keys. A file that is no JSON has a null document.
    """
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("__path", T.StringType())])

    def load():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        return files.select(F.col("content").cast("string").alias("value"), F.col("_metadata.file_path").alias("__path"))

    file = _decoded(F.try_element_at(F.split("__path", "/"), F.lit(-1)))
    return read_or_empty(spark, schema, load).select(_run_of_file(file).alias("run"), F.try_parse_json("value").alias("document"))


RESULT_FILES = ("dev_results.csv", "test_results.csv")


def read_result_files(spark: SparkSession, root: str, names: Sequence[str] = RESULT_FILES) -> DataFrame:
    """Rows of the result files of all model folders: model, file_type (the name up to "_"), subject_name, cop, predictions.

    A folder may lack any of the files, and a file may be a folder of part files. Columns are matched by
    the header, so their order is free.
    """
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in ("subject_name", "cop", "predictions")])
    files = _file_heads(spark, found) if (found := [p for n in names for p in (f"{root}/*/{n}",) if _exists(spark, p)]) else {}
    out = spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField("__path", T.StringType())]))
    for header, paths in files.items():
        columns = [c.strip() for c in next(csv.reader([header.lstrip("\ufeff")]))]
        raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        rows = raw.option("header", "true").option("multiLine", "true").option("escape", '"').csv(paths)
        out = out.unionByName(rows.select(
            *[F.col(f"`{f.name}`") if f.name in columns else F.lit(None).cast("string").alias(f.name) for f in wanted.fields],
            F.col("_metadata.file_path").alias("__path"),
        ))
    parts = F.split("__path", "/")
    at = F.when(F.try_element_at(parts, F.lit(-1)).startswith("part-"), -2).otherwise(-1)
    return out.select(
        _decoded(F.try_element_at(parts, at - 1)).alias("model"),
        F.regexp_extract(_decoded(F.try_element_at(parts, at)), "^([^_]*)_", 1).alias("file_type"),
        "subject_name", F.col("cop").try_cast("int").alias("cop"), F.col("predictions").try_cast("int").alias("predictions"),
    )


def read_trainer_state(
    spark: SparkSession, root: str, numeric_order: bool = True, pattern: str = "trainer_state.json"
) -> DataFrame:
    """The state of the last checkpoint per run below ``root/<run>/checkpoint-N/``.

    ``numeric_order=False`` orders checkpoint names as text, which puts 200 behind 1000.
    """
    def load():
        return (
            spark.read.schema(S.TRAINER_STATE).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).json(root)
            .select("*", F.col("_metadata.file_path").alias("__path"))
        )

    empty = T.StructType([*S.TRAINER_STATE.fields, T.StructField("__path", T.StringType())])
    docs = read_or_empty(spark, empty, load)
    parts = F.split("__path", "/")
    named = docs.withColumn("checkpoint", F.try_element_at(parts, F.lit(-2))).withColumn(
        "run", _decoded(F.try_element_at(parts, F.lit(-3)))
    )
    step = F.regexp_extract("checkpoint", r"(\d+)$", 1).try_cast("bigint")
    order = Window.partitionBy("run").orderBy(*([F.desc_nulls_last(step)] if numeric_order else []), F.desc("checkpoint"))
    kept = named.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") == 1)
    return kept.select("run", "checkpoint", *[f.name for f in S.TRAINER_STATE.fields])


def read_question_bank(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The whole bank from parquet, or from its CSV export."""
    if fmt == "csv":
        columns = [*S.QUESTION_BANK.fieldNames()[:10]]
        schema = T.StructType([T.StructField("id" if c == "question_id" else c, T.StringType()) for c in columns])
        return (
            spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"')
            .csv(path).withColumnRenamed("id", "question_id")
        )
    return spark.read.schema(S.QUESTION_BANK).parquet(path)


def read_epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Epoch logs; the run is the folder of the file."""
    rows = spark.read.schema(S.EPOCH_METRICS).option("header", "true").csv(path)
    return rows.withColumn("run", F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-2)))
