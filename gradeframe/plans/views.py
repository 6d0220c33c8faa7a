"""Benchmark-shaped tables derived from the given parquet tables, as Spark DataFrames.

Every view reads whole tables, so the work of a query grows with them. The same views exist
as DuckDB text in ``oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.constants import LABELS
from gradeframe.functions.labels import is_correct, tokens_per_sec
from gradeframe.functions.numeric import round_even

SPLITS = [f"test_set_0{i}" for i in range(1, 8)]
MODELS = [f"model_{i}" for i in range(5)]
MODEL_NAMES = [f"org{i}/Model {i} {'LoRA' if i % 2 else 'Q4_K_M'}" for i in range(5)]


KEYS = {"lineitem": ["l_orderkey", "l_linenumber"], "documents": ["doc_id"], "pages": ["page_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, KEYS[name]) if name in KEYS else df


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deal a table to all cores when its files hold fewer row groups than there are cores.

    The given tables are single row groups, which one task must read. A large table has many
    more scan tasks than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() * 2 <= cores else df


def letter(n: Column) -> Column:
    return F.substring(F.lit("ABCD"), (n % 4).cast("int") + 1, 1)


def predictions(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One prediction per line item: split from the order, model from the supplier.

    The line items may come as a stream.
    """
    li = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    part = table(spark, sf_dir, "part")
    order, line, key, supp = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    model = (supp % 5).cast("string")
    no_usage = supp % 5 == 4  # this back end reports no token counts
    prompt = F.when(~no_usage, F.col("l_quantity").cast("bigint") * 10)
    completion = F.when(~no_usage, line.cast("bigint") * 25)
    rows = li.join(part, key == F.col("p_partkey")).select(
        F.lit("bench_v1").alias("experiment_tag"),
        F.concat(F.lit("test_set_0"), (order % 7 + 1).cast("string")).alias("eval_split_name"),
        F.concat(F.lit("model_"), model).alias("model_key"),
        F.try_element_at(F.array(*[F.lit(m) for m in MODEL_NAMES]), (supp % 5 + 1).cast("int")).alias("model_display_name"),
        F.concat(order, F.lit("-"), line).alias("question_id"),
        F.when(F.col("p_size") % 17 != 0, F.col("p_brand")).alias("subject_category"),
        F.when(key % 53 != 0, letter(key)).alias("gold_answer"),
        F.when(order % 29 == 0, None)
        .when((order + line) % 5 < 3, letter(key))
        .otherwise(letter(key + line)).alias("pred_answer"),
        round_even(F.col("l_extendedprice") / 1000.0, 4).alias("latency_s"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        F.when(F.col("l_returnflag") == "R", "length").otherwise("stop").alias("finish_reason"),
        "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber",
    )
    return rows.withColumn("correct", is_correct(F.col("pred_answer"), F.col("gold_answer"))).withColumn(
        "tokens_per_sec", tokens_per_sec(F.col("completion_tokens"), F.col("latency_s"))
    )


def configured(df: DataFrame) -> DataFrame:
    """Predictions with the configuration they were made with; model_1 ran with two, model_3 names no file."""
    model, second = F.col("l_suppkey") % 5, (F.col("l_suppkey") % 5 == 1) & (F.col("l_orderkey") % 2 == 1)
    return df.withColumns({
        "server_model_id": F.concat(F.lit("srv-"), model.cast("string"), F.when(second, "-q8").otherwise("")),
        "hf_repo": F.concat(F.lit("org/m"), model.cast("string")),
        "hf_file": F.when(model != 3, F.concat(F.lit("m"), model.cast("string"), F.when(second, "-q8").otherwise("-q4"), F.lit(".gguf"))),
        "temperature": F.when(second, 0.7).otherwise(0.0),
        "max_tokens": F.when(model == 2, 512).otherwise(1024).cast("int"),
    })


RECENCY = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]


def model_specs(spark: SparkSession) -> DataFrame:
    """Descriptions of four of the five models, as a configuration file would give them."""
    rows = [(MODELS[i], MODEL_NAMES[i], f"{4 + i}B", "Q4_K_M" if i % 2 == 0 else "BF16") for i in range(4)]
    return spark.createDataFrame(rows, "model_key string, display_name string, param_count string, quantization string")


def question_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part; the subject is the brand, the topic the type."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("q"), key).alias("question_id"),
        F.col("p_name").alias("question"),
        *[F.concat(F.col("p_type"), F.lit(f" {x}")).alias(f"option_{x.lower()}") for x in LABELS],
        F.lower(letter(key)).alias("correct_answer"),
        F.when(F.col("p_size") % 17 != 0, F.col("p_brand")).otherwise("").alias("subject"),
        F.col("p_type").alias("topic"),
        F.lit("").alias("image_url"),
        F.timestamp_seconds(F.when(key % 11 != 0, key * 3600)).alias("created_at"),
    )


def submission_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per (order, part); the order is the submission, its customer the student.

    Every ninth part key points beyond the bank, so unknown questions occur.
    """
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    question = F.when(key % 9 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit("q"), key))
    answer = F.when((F.col("l_orderkey") + line) % 3 == 0, letter(key + line)).otherwise(letter(key))
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("s"), F.col("l_orderkey")).alias("submission_id"),
            question.alias("question_id"),
            F.when(F.col("l_orderkey") % 2 == 0, answer).otherwise(F.lower(answer)).alias("student_answer"),
        )
        .groupBy("submission_id", "question_id")
        .agg(F.max("student_answer").alias("student_answer"))
    )


def model_answers(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Graded question events: one per line item, with the answers of three models."""
    key, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    def answer(name, shift, ok):
        return F.struct(
            F.lit(name).alias("model"), letter(key + shift).alias("answer"), ok.alias("is_correct")
        )
    answers = F.array(
        answer("org/alpha", 0, (order + line) % 8 == 0),
        answer("beta", 1, (key + line) % 3 == 0),
        answer("", 2, F.lit(True)),
    )
    li = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return li.select(
        F.concat(F.lit("s"), order).alias("submission_id"),
        F.concat(F.lit("q"), key).alias("question_id"),
        F.concat(F.lit("because "), key.cast("string")).alias("explanation"),
        F.when(key % 13 != 0, answers).alias("model_answers"),
        F.col("l_shipdate").alias("event_time"),
        "l_linenumber", "l_extendedprice", "l_suppkey",
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free model text: each document wrapped in one of seven answer styles."""
    style = F.col("doc_id") % 7
    text = F.col("text")
    pick = letter(F.floor(F.col("doc_id") / 7))
    def put(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = (
        F.when(style == 0, text)
        .when(style == 1, put("<think>", text, "</think>\nFinal answer: **", pick, "**"))
        .when(style == 2, put(text, "\n**", pick, "**."))
        .when(style == 3, put("Explanation: ", text, "\nAnswer: **", pick, "** then answer - c"))
        .when(style == 4, put("So the answer is ", pick, ". ", text))
        .when(style == 5, put(" ", F.lower(pick), "\n"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", "lang", raw.alias("raw_output"))


def selector_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option probabilities per line item in sixteenths, gold label, subject."""
    key, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    top = F.when(order % 41 == 0, 16).otherwise(4 + (order + line) % 12).cast("int")
    rest = (F.lit(16) - top)
    a = F.floor(rest / 2).cast("int")
    b = F.floor((rest - a) / 2).cast("int")
    c = rest - a - b
    shift = (key + F.when((order + line) % 4 == 0, 1).otherwise(0)) % 4
    four = [top, a, b, c]
    probs = F.array(*[
        (F.when(shift == i, four[0]).when(shift == (i + 3) % 4, four[1]).when(shift == (i + 2) % 4, four[2])
         .otherwise(four[3]) / 16.0).cast("double")
        for i in range(4)
    ])
    return li.join(part, key == F.col("p_partkey")).select(
        F.concat(order, F.lit("-"), line).alias("id"), key.alias("part"),
        probs.alias("probs"),
        F.when(key % 53 == 0, -1).otherwise(key % 4).cast("int").alias("gold"),
        F.when(F.col("p_size") % 17 != 0, F.col("p_brand")).alias("subject_name"),
        F.when(order % 6 == 0, None).otherwise(letter(key + order % 2)).alias("llm_answer"),
        (key % 4 + 1).cast("int").alias("cop"),
        (F.when((order + line) % 5 < 2, key % 4).otherwise((key + line) % 4) + 1).cast("int").alias("predictions"),
    )
