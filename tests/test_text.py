"""Letter rules, prompts and page parsing on hand-written text."""

import pytest
from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.functions import extract as X
from gradeframe.functions import labels as L
from gradeframe.functions import text as T
from gradeframe.operators import chat as E
from gradeframe.operators import items as I
from gradeframe.operators import pages as D

GOLDEN = [
    ("b", "B", "B", "B", "B", "B"),
    ("A patient … Answer: C", "A", "C", "C", "C", "A"),
    ("Answer: B. On reflection, Answer: D", "B", "B", "D", "B", "B"),
    ("<think>maybe A</think>Final answer: **C**", "C", "C", "C", "C", "A"),
    ("x\n**D**.", "D", "D", "D", "D", "D"),
    ("no letter here", None, None, None, None, None),
    ("", None, None, None, None, None),
    (None, None, None, None, None, None),
    ("éA Ab B", "B", "B", "B", "B", "B"),
    ("<think>A</think>x<think>B</think> nothing", None, None, None, None, "A"),
    ("ANSWERD", "D", None, None, None, None),
    ("The  answer is **b** but choose c", "B", "B", "B", "C", "B"),
    ("one\nC.\nlast A line", "C", "C", "A", "A", "C"),
]


@pytest.mark.parametrize("i,rule", list(enumerate(X.RULES)))
def test_letter_rules(spark, i, rule):
    df = spark.createDataFrame([(n, g[0]) for n, g in enumerate(GOLDEN)], "n int, raw string")
    out = X.with_letter(df, "raw", rule).orderBy("n").collect()
    assert [r.pred_answer for r in out] == [g[i + 1] for g in GOLDEN]
    column = df.select("n", X.extract_letter(F.col("raw"), rule).alias("p")).orderBy("n").collect()
    assert [r.p for r in column] == [g[i + 1] for g in GOLDEN]


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "_jc") else v.alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_explanation(spark):
    text = "Explanation: because\nof this\nAnswer: B"
    assert one(spark, X.extract_explanation(F.col("t")), t=text) == "because\nof this"
    assert one(spark, X.extract_explanation(F.col("t")), t="x" * 600) == "x" * 500
    assert one(spark, X.extract_explanation(F.col("t"), None), t="x" * 600) == "x" * 600


def test_small_functions(spark):
    assert one(spark, T.strip(F.col("t")), t="  a b \x1c") == "a b"
    assert one(spark, T.normalize_text(F.col("t")), t="Qwen-3.5_9B é") == "qwen359b"
    assert one(spark, T.short_name(F.col("t")), t="org/a/b") == "a/b"
    assert one(spark, T.ellipsize_words(F.col("t"), 10), t="hello world again") == "hello..."
    assert one(spark, X.answer_from_solution(F.col("t")), t="The solution is c: x") == "C"
    assert one(spark, X.figure_refs(F.col("t")), t="see Table 2, Fig. 1; Table 2") == ["Fig. 1", "Table 2"]
    assert one(spark, X.image_list(F.col("t")), t="a [Image: p/1.png] b [Image: q]") == ["p/1.png", "q"]
    assert one(spark, L.cop_to_letter(F.col("t")), t=0) == "A"
    assert one(spark, L.cop_to_letter(F.col("t"), None), t=0) is None
    assert one(spark, L.tokens_per_sec(F.col("a"), F.col("b")), a=10, b=3.0) == 3.33
    assert one(spark, L.tokens_per_sec(F.col("a"), F.col("b")), a=0, b=3.0) is None


def test_top_label_first_of_equals(spark):
    df = spark.createDataFrame([([("A", 0.5), ("B", 0.5)],), ([("x", 0.1), ("C", 0.9)],)], "s array<struct<label:string,score:double>>")
    assert [r[0] for r in df.select(X.top_label(F.col("s"))).collect()] == ["A", "C"]


def test_required_keys_tell_null_from_absent(spark):
    full = '{"question":"q","opa":"a","opb":"b","opc":"c","opd":null,"cop":1}'
    df = spark.createDataFrame([(full,), (full.replace(',"opd":null', ""),), ("not json",)], "value string")
    assert I.key_report(df).first().asDict() == {"kept": 1, "dropped": 2}


PAGE = [
    "Skip to main content", "Done Reviewing", "The passage.", "More of it:", "Which?", "tail", "A.", "first", "B. second one",
    "C.", "D. last one", "Solution: The correct answer is B.", "A. not a choice", "Content & Skills", "B. no",
]


def test_first_layout(spark):
    out = D.parse_pages(spark.createDataFrame([(1, PAGE)], "doc_id int, lines array<string>")).first()
    assert out.passage == "The passage.\nMore of it:" and out.question == "Which?" and out.answer == "B"
    assert out.choices == {"A": "first", "B": "second one", "C": "[image]", "D": "last one"}


def test_first_layout_without_question_or_choices(spark):
    out = D.parse_pages(spark.createDataFrame([(1, ["just text", "more"])], "doc_id int, lines array<string>")).first()
    assert (out.passage, out.question, out.choices, out.answer) == ("just text\nmore", "", {}, None)


RECORD = [
    "Bank", "Step", "3/9", "Question", "What holds?", "A", "one", "B", "two", "Answer choice eliminated", "C", "D [Image: x.png]",
    "Solution: The correct answer is D.", "This question tests recall. Choice B is bad.", "Thus, D is the best answer.",
    "Correct", "Your Answer:", "D", "Content & Skills", "Skill: Recall", "CHEM", "phy",
]


def test_second_layout(spark):
    df = spark.createDataFrame([(1, "BB", RECORD), (2, "BB", ["Question", "x"])], "doc_id int, folder string, lines array<string>")
    out = {r.doc_id: r for r in D.parse_records(df).collect()}
    r = out[1]
    assert out[2].skipped == "missing marker" and r.skipped is None
    assert r.choices == {"A": "one", "B": "two", "C": "[image]", "D": "[Image: x.png]"}
    assert (r.correct_answer, r.user_answer, r.question_id, r.subject_code) == ("D", "D", "3", "PHY")
    assert r.content_skills == ["Recall", "CHEM", "phy"] and r.images == ["x.png"]
    assert r.elimination["B"] == "Choice B is bad." and r.elimination["D"] == "Correct. This question tests recall."
    assert r.elimination["A"] == "Incorrect based on the information provided."
    assert r.concept == "Physics — This question tests recall."
    assert r.why == "This question tests recall. Choice B is bad. Thus, D is the best answer."
    assert r.valid and r.messages[2].content.startswith("Concept:\nPhysics")
    report = D.parse_report(D.parse_records(df)).first()
    assert (report.total, report.written, report.skipped, report.warnings, report.images) == (2, 1, 1, 0, 1)


def test_tuned_messages_leave_out_blank_passage(spark):
    df = spark.createDataFrame([(" ", " Q? ", {"A": "x"})], "passage string, question string, choices map<string,string>")
    user = df.select(E.tuned_messages()[1]["content"]).first()[0]
    assert user == "Question: Q?\nOptions: A. x B.  C.  D. \n" + K.RESPONSE_FORMAT


def test_validation_names_the_rules(spark):
    data = [([("system", "s"), ("user", "Choices:"), ("assistant", "Answer:\nB\n\nWhy:")], "B"),
            ([("system", "s"), ("user", "x"), ("assistant", "Answer:\nB")], "C"), ([("user", "Choices:")], None)]
    df = spark.createDataFrame(data, "messages array<struct<role:string,content:string>>, correct_answer string")
    got = [set(r.violations) for r in E.validate_records(df).collect()]
    assert got[0] == set() and got[1] == {"answer_mismatch", "missing_choices"}
    assert got[2] == {"message_count", "role_0_not_system", "role_1_not_user", "role_2_not_assistant", "missing_answer", "missing_choices"}
