"""Queries that parse exam pages derived from the documents.

Each document becomes the passage of a page, with markers, choices and a solution around it.
The SQL states the parts a page was made of, so it checks the parser without being one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe import constants as K
from gradeframe.operators import items as I
from gradeframe.operators import pages as D
from gradeframe.plans import views as V
from gradeframe.plans.registry import query
from gradeframe.plans.texts import WS

DOC = f"""doc as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{WS}')), lambda x: x <> '') as body,
    substr('ABCD', cast((doc_id // 4) % 4 as int) + 1, 1) as pick from documents)"""


def _doc(spark, sf):
    return V.table(spark, sf, "documents").withColumn("body", D.page_lines(F.col("text"))).withColumn(
        "pick", V.letter(F.floor(F.col("doc_id") / 4))
    )


def _lines(*parts):
    """One array from texts, columns and arrays; null parts are left out."""
    arrays = [p if isinstance(p, tuple) else F.array(F.lit(p) if isinstance(p, str) else p) for p in parts]
    merged = F.concat(*[a[0] if isinstance(a, tuple) else a for a in arrays])
    return F.filter(merged, lambda x: x.isNotNull())


def exam_pages(spark, sf):
    """First layout: lettered choice lines."""
    d = F.col("doc_id")
    return _doc(spark, sf).select(
        "doc_id", F.col("source").alias("folder"),
        _lines(
            "Skip to main content", "Unscored Sample Test 1", (F.col("body"),),
            F.concat(F.lit("Which one fits "), "source", F.lit("?")),
            "A.", F.concat(F.lit("lang "), "lang"), F.concat(F.lit("B. "), "source"),
            F.when(d % 4 == 0, "C.").otherwise(F.concat(F.lit("C.c"), "n_chars")), "D. none of them",
            F.when(d % 5 != 0, F.concat(F.lit("Solution: The correct answer is "), "pick", F.lit("."))),
            F.when(d % 5 != 0, "A. is an example of a line behind the solution"),
            F.when(d % 3 == 0, "Content & Skills"), F.when(d % 3 == 0, "D. below the footer"),
        ).alias("lines"),
    )


PASSAGE = "array_to_string(body, chr(10))"
CHOICE_C = "case when doc_id % 4 = 0 then '[image]' else concat('c', n_chars) end"


# prose may open a line with a letter and a dot; such a line starts the choices
SPLIT = f"""{DOC}, opened as (select *, list_position(list_transform(body, lambda x: regexp_matches(x, '^[A-D]\\.([\\s\\x0b\\x85\\pZ]*$|[\\s\\x0b\\x85\\pZ]*[^\\s\\x0b\\x85\\pZ].+)')), true) as n from doc),
  pre as (select *, case when n > 0 then body[1:n - 1] else list_append(body, concat('Which one fits ', source, '?')) end as before from opened),
  asked as (select *, list_max(list_filter(list_transform(before, lambda x, i: case when regexp_matches(x, '[?:]$') then i end), lambda i: i is not null)) as q from pre),
  page as (select *, array_to_string(case when q is null then before else before[1:q - 1] end, chr(10)) as passage, coalesce(before[q], '') as question from asked)"""


@query("D2_D5_parse_pages", f"""with {SPLIT} select doc_id, source as folder, passage, question,
  concat('lang ', lang) as a, source as b, {CHOICE_C} as c, 'none of them' as d, case when doc_id % 5 <> 0 then pick end as answer from page""")
def d2(spark, sf):
    parsed = D.parse_pages(exam_pages(spark, sf))
    return parsed.select(
        "doc_id", "folder", "passage", "question",
        *[F.col("choices")[x].alias(x.lower()) for x in K.LABELS], "answer",
    )


@query("D2_trim_page", f"""with {DOC} select doc_id, cast(len(body) + case when doc_id % 5 <> 0 then 8 else 6 end as bigint) as n_lines,
  coalesce(body[1], concat('Which one fits ', source, '?')) as first_line from doc""")
def d2_trim(spark, sf):
    kept = exam_pages(spark, sf).withColumn("kept", D.trim_page(F.col("lines")))
    return kept.select(
        "doc_id", F.size("kept").cast("bigint").alias("n_lines"), F.col("kept")[0].alias("first_line")
    )


@query("D3_before_solution", f"""with {DOC} select doc_id, concat({PASSAGE}, case when len(body) > 0 then chr(10) else '' end, 'end') as question_text from doc""")
def d3(spark, sf):
    text = F.array_join(_lines((F.col("body"),), "end", "Solution: A", "more", "Solution: B"), "\n")
    return _doc(spark, sf).select("doc_id", D.before_solution(text).alias("question_text"))


@query("D4_parse_choices", f"""with {DOC} select doc_id, 'second' as a, {CHOICE_C} as c, cast(3 as bigint) as n from doc""")
def d4(spark, sf):
    d = F.col("doc_id")
    lines = _lines(
        "A. first", F.when(d % 4 == 0, "C.").otherwise(F.concat(F.lit("C. c"), "n_chars")), "D.", F.concat(F.lit("lang "), "lang"), "A.", "second",
        "B. x",
    )
    parsed = _doc(spark, sf).withColumn("choices", D.parse_choices(D.choice_lines(lines)))
    return parsed.select(
        "doc_id", F.col("choices")["A"].alias("a"), F.col("choices")["C"].alias("c"), F.size("choices").cast("bigint").alias("n")
    )


@query("D5_split_passage", f"""with {DOC} select doc_id, concat({PASSAGE}, chr(10), 'Not this?') as passage, 'Consider:' as question from doc where len(body) > 0
  union all select doc_id, 'Not this?', 'Consider:' from doc where len(body) = 0""")
def d5(spark, sf):
    split = D.split_passage(_lines((F.col("body"),), "Not this?", " Consider: ", "trailing words"))
    return _doc(spark, sf).withColumn("s", split).select("doc_id", F.col("s.passage").alias("passage"), F.col("s.question").alias("question"))


@query("D12_quality_report", f"""with {SPLIT} select source as folder, count(*) as samples, count(*) filter (where doc_id % 5 = 0) as missing_answers,
  count(*) filter (where question = '') as missing_questions, cast(0 as bigint) as incomplete_choices, count(*) filter (where doc_id % 4 = 0) as with_images from page group by 1""")
def d12(spark, sf):
    parsed = D.parse_pages(exam_pages(spark, sf))
    images = F.filter(F.map_values("choices"), lambda x: x == K.IMAGE_CHOICE)
    return I.quality_report(parsed.withColumn("images", images), ["folder"])


@query("D1_drop_boilerplate", f"""with {DOC}, l as (select doc_id, unnest(list_concat(body, ['Next Question 12', 'x Contact Us y', 'next question [Image: a b.png]', 'kept next question'])) as line from doc)
  select doc_id, string_agg(line, chr(10)) filter (where false) as none, count(*) as n from l
  where not (contains(line, 'Skip to main content') or contains(line, 'Done Reviewing') or contains(line, 'Provide Feedback') or contains(line, 'Contact Us')
    or contains(line, 'Web Accessibility') or contains(line, 'Terms and Conditions') or contains(line, 'Privacy Statement')
    or contains(line, chr(169) || ' 2026 AAMC') or contains(line, chr(169) || ' 2025 AAMC') or contains(line, chr(169) || ' 2024 AAMC')
    or regexp_matches(trim(regexp_replace(line, '\\[Image: [^\\]]+\\]', '', 'g'), '{WS}'), '(?i)^next question[\\s\\x0b\\x85\\pZ]*[0-9]*$'))
  group by 1""")
def d1(spark, sf):
    lines = _lines((F.col("body"),), "Next Question 12", "x Contact Us y", "next question [Image: a b.png]", "kept next question")
    kept = _doc(spark, sf).withColumn("kept", D.drop_boilerplate(lines))
    return kept.select("doc_id", F.lit(None).cast("string").alias("none"), F.size("kept").cast("bigint").alias("n"))


FOLDER = "case doc_id % 3 when 0 then 'BB' when 1 then 'CP' else 'CARS_d1' end"


def record_pages(spark, sf):
    """Second layout: marker lines, with three styles of explanation."""
    d = F.col("doc_id")
    folder = F.when(d % 3 == 0, "BB").when(d % 3 == 1, "CP").otherwise("CARS_d1")
    dealt, named, blocks = d % 3 == 0, d % 3 == 1, d % 3 == 2
    def given(test, *parts):
        return F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    lang, source, pick = F.col("lang"), F.col("source"), F.col("pick")
    return _doc(spark, sf).select(
        "doc_id", folder.alias("folder"),
        _lines(
            "Done Reviewing", "Plan", F.concat(F.lit("Bank "), lang), F.concat(F.lit("Section "), source),
            F.concat(d, F.lit("/59")), "Time Spent: 1:02", "Passage 3", (F.col("body"),), "Adapted from a book", "_",
            F.when(d % 11 == 0, "Item").otherwise("Question"), "Which reading of Table 2 holds,", F.concat(source, F.lit("?")),
            "A", lang, "Answer choice eliminated", "B", source, "or so",
            F.concat(F.lit("C [Image: img/"), d, F.lit(".png]")), "D",
            F.concat(F.lit("Solution: The correct answer is "), pick, F.lit(". It rests on the text.")),
            given(dealt, "Incorrect. Para of B."), given(dealt, "Para of C."), given(dealt, "Correct. Para of D."),
            given(named, "Choice A is too broad. Option B and (D) are off. This stays. Thus, C is the best answer."),
            given(blocks, "Item Rationale:"), given(blocks, "This is a Reasoning question because it asks."),
            given(blocks, "Option Rationale:"), given(blocks, "Option A: Correct. ", lang, ". Fits."),
            given(blocks, "Option B: Incorrect. Too much."), given(blocks, "More on B."), given(blocks, "Option C:"),
            "Incorrect", "Your Answer:", "B", "Correct Answer:", "A", "Confidence Level:",
            F.when(d % 2 == 0, "High").otherwise("Not Selected"), "Content & Skills", "Skill: Reasoning",
            F.when(d % 2 == 0, "bio"), "Next question 4", "PSY",
        ).alias("lines"),
    )


RECORD = f"""{DOC}, rec as (select doc_id, {FOLDER} as folder, body, lang, source, pick, doc_id % 3 as style,
    concat('img/', doc_id, '.png') as image, concat('Which reading of Table 2 holds, ', source, '?') as question from doc where doc_id % 11 <> 0)"""


@query("D6_find_markers", f"""with {DOC} select doc_id, case when doc_id % 11 <> 0 then 10 + cast(len(body) as int) end as question, 9 + cast(len(body) as int) as separator,
  21 + cast(len(body) as int) as solution, 21 + cast(len(body) as int) + case doc_id % 3 when 0 then 4 when 1 then 2 else 8 end as verdict from doc""")
def d6(spark, sf):
    fields = D.extract_fields(record_pages(spark, sf))
    return fields.select(
        "doc_id", F.col("markers.question").alias("question"), F.col("markers.separator").alias("separator"),
        F.col("markers.solution").alias("solution"), F.col("markers.verdict").alias("verdict"),
    )


PARTS = """case style when 0 then 'It rests on the text.|Incorrect. Para of B.|Para of C.|Correct. Para of D.'
    when 1 then 'It rests on the text.|Choice A is too broad. Option B and (D) are off. This stays. Thus, C is the best answer.'
    else concat('It rests on the text.|This is a Reasoning question because it asks.|Option A: Correct. ', lang, '. Fits.|Option B: Incorrect. Too much.|More on B.|Option C:') end"""


@query("D7_D8_extract_fields", f"""with {RECORD} select doc_id, concat('Bank ', lang) as source_title, concat('Section ', source) as section, cast(doc_id as varchar) as question_id,
  {PASSAGE} as passage, question, lang as a, concat(source, ' or so') as b, concat('[Image: ', image, ']') as c, '[image]' as d, {PARTS} as parts,
  pick as correct_answer, 'B' as user_answer, case when doc_id % 2 = 0 then 'High' end as confidence,
  case when doc_id % 2 = 0 then 'Reasoning|bio' else 'Reasoning' end as skills,
  case when doc_id % 2 = 0 then 'BIO' when style = 2 then 'CARS' when style = 1 then 'GCH' end as subject_code from rec""")
def d7(spark, sf):
    fields = D.extract_fields(record_pages(spark, sf)).where(F.col("skipped").isNull())
    return fields.select(
        "doc_id", "source_title", "section", "question_id", F.array_join("passage_parts", "\n").alias("passage"), "question",
        *[F.col("choices")[x].alias(x.lower()) for x in K.LABELS], F.array_join("solution_parts", "|").alias("parts"),
        "correct_answer", "user_answer", "confidence", F.array_join("content_skills", "|").alias("skills"), "subject_code",
    )


VERDICT = "case when pick = '{x}' then 'Correct. See explanation below.' else 'Incorrect based on the information provided.' end"
KEPT = "concat('Correct. It rests on the text. ', case when pick = 'A' then 'Choice A is too broad. ' else '' end, 'This stays.')"
ELIM = {
    "A": f"""case style when 0 then 'It rests on the text.' when 1 then case when pick = 'A' then {KEPT} else 'Choice A is too broad.' end
      else concat(case when pick = 'A' then 'Correct. ' else 'Incorrect. ' end, 'Fits.') end""",
    "B": f"""case style when 0 then 'Para of B.' when 1 then case when pick = 'B' then {KEPT} else 'Option B and (D) are off.' end
      else concat(case when pick = 'B' then 'Correct. ' else 'Incorrect. ' end, 'Too much. More on B.') end""",
    "C": f"""case style when 0 then 'Para of C.' when 1 then case when pick = 'C' then {KEPT} else {VERDICT.format(x='C')} end
      else case when pick = 'C' then 'Correct.' else 'Incorrect.' end end""",
    "D": f"""case style when 0 then 'Para of D.' when 1 then case when pick = 'D' then {KEPT} else 'Option B and (D) are off.' end
      else {VERDICT.format(x='D')} end""",
}
ELIMINATED = f"""{RECORD}, elim as (select *, {', '.join(f'{sql} as e{x}' for x, sql in ELIM.items())} from rec)"""
REASON = "regexp_replace(case pick when 'A' then eA when 'B' then eB when 'C' then eC else eD end, '^(Correct|Incorrect)\\.\\s*', '')"
CODE = "case when doc_id % 2 = 0 then 'Biology' when style = 2 then 'Critical Analysis and Reasoning Skills' when style = 1 then 'General Chemistry' else 'MCAT' end"
RECORDED = f"""{ELIMINATED}, why as (select *, concat({CODE}, ' ' || chr(8212) || ' reasoning about: ', question) as concept,
    case style when 2 then trim(concat('This is a Reasoning question because it asks. ', {REASON})) else replace({PARTS}, '|', ' ') end as why from elim)"""


@query("D9_eliminate", f"with {ELIMINATED} select doc_id, pick, eA, eB, eC, eD from elim")
def d9(spark, sf):
    fields = D.extract_fields(record_pages(spark, sf)).where(F.col("skipped").isNull())
    return D.eliminate(fields).select(
        "doc_id", F.col("correct_answer").alias("pick"), *[F.col("elimination")[x].alias(f"e{x}") for x in K.LABELS]
    )


@query("D10_concept_why", f"with {RECORDED} select doc_id, concept, why, concat('Contains Table 2; 1 image(s) extracted') as image_note from why")
def d10(spark, sf):
    records = D.parse_records(record_pages(spark, sf)).where(F.col("skipped").isNull())
    note = F.when(F.contains("image_note", F.lit("Table 2")) & F.endswith("image_note", F.lit("; 1 image(s) extracted")),
                  "Contains Table 2; 1 image(s) extracted")
    return records.select("doc_id", "concept", "why", note.alias("image_note"))


N = "chr(10)"


@query("E8_parsed_messages", f"""with {RECORDED} select doc_id, concat(case when len(body) > 0 then concat('Passage:', {N}, {PASSAGE}, {N}, {N}) else '' end, 'Question:', {N}, question, {N}, {N}, 'Choices:', {N},
    'A. ', lang, {N}, 'B. ', source, ' or so', {N}, 'C. [Image: ', image, ']', {N}, 'D. [image]') as user_text,
  concat('Concept:', {N}, concept, {N}, {N}, 'Elimination:', {N}, 'A. ', eA, {N}, 'B. ', eB, {N}, 'C. ', eC, {N}, 'D. ', eD, {N}, {N},
    'Answer:', {N}, pick, {N}, {N}, 'Why:', {N}, why) as assistant_text, true as valid from why""")
def e8(spark, sf):
    records = D.parse_records(record_pages(spark, sf)).where(F.col("skipped").isNull())
    return records.select(
        "doc_id", F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("assistant_text"), "valid"
    )


@query("D13_parse_report", """select count(*) as total, count(*) filter (where doc_id % 11 <> 0) as written, count(*) filter (where doc_id % 11 = 0) as skipped,
  cast(0 as bigint) as warnings, count(*) filter (where doc_id % 11 <> 0) as images from documents""")
def d13(spark, sf):
    return D.parse_report(D.parse_records(record_pages(spark, sf)))


@query("D12_page_layouts", """select page_id, len(list_filter(list_transform(string_split(html, '<'), lambda x: trim(x)), lambda x: x <> '')) as n_lines from pages""")
def d12_pages(spark, sf):
    lines = F.filter(F.transform(F.split("html", "<"), lambda x: F.trim(x)), lambda x: x != "")
    return V.table(spark, sf, "pages").select("page_id", F.size(D.drop_boilerplate(lines)).cast("bigint").alias("n_lines"))
