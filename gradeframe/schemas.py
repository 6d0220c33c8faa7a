"""Explicit schemas. Nothing in the library infers a schema."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


MCQ_ITEM = _struct(
    ("id", _S), ("question", _S), ("opa", _S), ("opb", _S), ("opc", _S), ("opd", _S), ("cop", _I),
    ("choice_type", _S), ("exp", _S), ("subject_name", _S), ("topic_name", _S),
)

EXAM_SAMPLE = _struct(
    ("id", _S), ("passage", _S), ("question", _S), ("choices", T.MapType(_S, _S)),
    ("images", T.ArrayType(_S)), ("answer", _S), ("source_file", _S), ("source_stem", _S),
    ("test_set", _S), ("subject_category", _S), ("subject", _S), ("category", _S), ("section", _S),
    ("topic", _S),
)

PREDICTION = _struct(
    ("experiment_tag", _S), ("eval_split_name", _S), ("model_key", _S), ("model_display_name", _S),
    ("backend", _S), ("server_model_id", _S), ("hf_repo", _S), ("hf_file", _S), ("base_model_id", _S),
    ("adapter_id", _S), ("adapter_path", _S), ("param_count", _S), ("quantization", _S),
    ("temperature", _D), ("max_tokens", _I), ("max_new_tokens", _I), ("question_id", _S),
    ("source_json", _S), ("source_file", _S), ("subject_category", _S), ("gold_answer", _S),
    ("pred_answer", _S), ("correct", _B), ("latency_s", _D), ("prompt_tokens", _L),
    ("completion_tokens", _L), ("total_tokens", _L), ("tokens_per_sec", _D), ("finish_reason", _S),
    ("raw_output", _S), ("question", _S), ("run_seq", _L),
)

QUESTION_BANK = _struct(
    ("question_id", _S), ("question", _S), ("option_a", _S), ("option_b", _S), ("option_c", _S),
    ("option_d", _S), ("correct_answer", _S), ("subject", _S), ("topic", _S), ("explanation", _S),
    ("image_url", _S), ("created_by", _S), ("created_at", _TS), ("updated_at", _TS),
)

GRADED_QUESTION = _struct(
    ("submission_id", _S), ("question_id", _S), ("explanation", _S),
    ("model_answers", T.ArrayType(_struct(("model", _S), ("answer", _S), ("is_correct", _B)))),
    ("event_time", _TS),
)

RUN_METRICS = _struct(
    ("overall_accuracy", _D), ("macro_averaged_accuracy", _D), ("total_samples", _L), ("correct", _L),
    ("per_subject_accuracy", T.MapType(_S, _struct(("accuracy", _D), ("n", _L)))),
    ("confusion_matrix", T.MapType(_S, T.MapType(_S, _L))),
)

TRAINER_STATE = _struct(
    ("best_metric", _D), ("global_step", _L), ("max_steps", _L), ("num_train_epochs", _I),
    ("log_history", T.ArrayType(_struct(
        ("step", _L), ("epoch", _D), ("loss", _D), ("learning_rate", _D), ("eval_loss", _D),
    ))),
)

EPOCH_METRICS = _struct(
    ("epoch", _I), ("train_loss", _D), ("train_acc", _D), ("val_loss", _D), ("val_acc", _D),
    ("lr", _D), ("time_s", _D),
)
