"""Readers of folders whose files differ in form or columns."""

import json

from gradeframe.sources import readers as R


def test_predictions_are_matched_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("question_id,model_key,pred_answer\nq1,m1,A\nq2,m1,\"B\"\n")
    (tmp_path / "b+c d.csv").write_text("\n\nmodel_key,question_id,backend,pred_answer\nm2,q9,gguf,C\n".lstrip())
    (tmp_path / "odd[1].csv").write_text("pred_answer,unknown,question_id,latency_s\nD,x,q3,1.5\n")
    for multi_line in (True, False):
        got = R.read_predictions(spark, f"{tmp_path}/*.csv", label="source", multi_line=multi_line).collect()
        rows = sorted((r.source, r.question_id, r.model_key, r.backend, r.pred_answer, r.latency_s) for r in got)
        assert rows == [
            ("a", "q1", "m1", None, "A", None), ("a", "q2", "m1", None, "B", None),
            ("b+c d", "q9", "m2", "gguf", "C", None), ("odd[1]", "q3", None, None, "D", 1.5),
        ]
    assert R.read_predictions(spark, [str(tmp_path / "none.csv")]).count() == 0
    assert R.read_predictions(spark, [str(tmp_path), str(tmp_path / "none.csv")]).count() == 4


def test_json_lines_and_arrays_in_one_folder(spark, tmp_path):
    items = [{"id": str(n), "question": f"q{n}"} for n in range(53)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, items[:50])))
    (tmp_path / "array.json").write_text("\n" + json.dumps(items[50:], indent=2))
    got = R.read_mcq(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.question) for r in got) == sorted((i["id"], i["question"]) for i in items)
    assert R.read_mcq(spark, str(tmp_path / "array.json")).count() == 3
    assert R.read_mcq(spark, str(tmp_path / "lines.json")).count() == 50


def test_run_names_keep_their_plus(spark, tmp_path):
    folder = tmp_path / "gemma+lora x"
    folder.mkdir()
    (folder / "gemma+lora x_metrics.json").write_text(json.dumps({"overall_accuracy": 0.5}))
    assert [r.run for r in R.read_run_metrics(spark, str(tmp_path)).collect()] == ["gemma+lora x"]
